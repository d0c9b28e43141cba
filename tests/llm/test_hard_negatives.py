"""op13: equal to brute force over all pairs."""

import math
import random

import pytest

from pelagos.llm import hard_negatives
from pelagos.llm.queries import op13_hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, anchors, positives=5, negatives=3, low=50, high=95, scale=256):
    """rows: (id, vector, label)"""
    import numpy as np

    used = []
    for i, v, c in rows:
        if i is None or c is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        used.append((i, tuple(math.floor(scale * float(np.float32(x))) for x in v), c))
    out = []
    for i, v, c in dict.fromkeys(u for u in used if anchors(u[0])):
        scored = [(-sum(a * b for a, b in zip(v, w)), j, d) for j, w, d in used if len(w) == len(v)]
        for p, j, _ in sorted(s for s in scored if s[2] == c and s[1] != i)[:positives]:
            fits = sorted((s, k) for s, k, d in scored if d != c and low * -p <= 100 * -s <= high * -p)
            out += [(i, j, r + 1, k, -p, -s) for r, (s, k) in enumerate(fits[:negatives])]
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def test_query_equals_brute_force(spark, sf):
    rows = [(r.vec_id, r.embedding, None if r.label is None else (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    found = got(op13_hard_negatives(spark, sf))
    assert found == brute(rows, lambda i: i % 50 == 0) and len(found) > 50


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_clusters_ties_and_blocks_prune_nothing_wanted(spark, monkeypatch, seed):
    """Tight clusters, so that bounds bite, ties, many shares and groups of few anchors."""
    monkeypatch.setattr(hard_negatives, "BLOCK", 8)
    monkeypatch.setattr(hard_negatives, "SHARE_ROWS", 60)
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(4)] for _ in range(6)]
    rows = []
    for k in range(400):
        centre = rng.choice(centres)
        rows.append((k, [c + rng.choice([0, 0, 0.02, 0.3]) * rng.gauss(0, 1) for c in centre], rng.randrange(3) if seed < 3 else 0 if k % 5 else 1))
    assert got(hard_negatives.mine(spark.createDataFrame(rows, SCHEMA).repartition(5), "vec_id % 7 = 0" and (__import__("pyspark").sql.functions.col("vec_id") % 7 == 0))) == brute(rows, lambda i: i % 7 == 0)


def test_awkward_rows(spark):
    from pyspark.sql import functions as F

    nan, inf = float("nan"), float("inf")
    rows = [(0, [0.0, 0.0], 1), (0, [0.0, 0.0], 1), (0, [1.0, 0.5], 1), (0, [1.0, 0.5], 2), (1, [1.0, 0.4], 1), (2, [-1.0, 0.0], 1), (3, [0.5, 0.5], 2), (3, [0.5, 0.5], 2), (4, [0.7, 0.1], 3), (5, None, 1), (6, [], 1), (7, [nan, 1.0], 1), (8, [inf, 1.0], 1)]
    rows += [(9, [None, 1.0], 1), (None, [1.0, 1.0], 1), (10, [1.0, 1.0], None), (11, [1.0, 2.0, 3.0], 1), (12, [1.0, 2.0, 2.0], 1), (13, [1.0, 1.0, 1.2], 4), (14, [0.0, 0.0], 2), (15, [0.0, 1.0], 5), (16, [-1.0, -0.2], 2)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("v", "id", "dim", "grp", "q", "key")})
    assert got(hard_negatives.mine(df, F.lit(True))) == brute(rows, lambda i: True)
    assert got(hard_negatives.mine(df, F.lit(None).cast("boolean"))) == []
    assert hard_negatives.mine(spark.createDataFrame([], SCHEMA), F.lit(True)).count() == 0


def test_bounds_keep_rows_away(spark, monkeypatch):
    """In clusters far apart, most rows go to no group that does not want them."""
    import numpy as np

    seen = []
    real = hard_negatives.Cells.groups_of

    def counted(self, dim, serves):
        for g, at in real(self, dim, serves):
            seen.append(len(at))
            yield g, at

    monkeypatch.setattr(hard_negatives, "BLOCK", 8)
    rng = np.random.default_rng(5)
    at = np.eye(8)[rng.integers(0, 8, 800)] * 4 + rng.normal(0, 0.01, (800, 8))
    space = hard_negatives.Space((at * 256).astype(np.int64), float(np.sqrt((at**2).sum(axis=1)).max() * 256))
    import pandas as pd

    away = space.to_pivots(space.anchors((at * 256).astype(np.int64)))
    cell = away.argmin(axis=1)
    found = pd.DataFrame({"dim": 8, "cell": cell, "radius": away[np.arange(800), cell]}).groupby(["dim", "cell"]).agg(radius=("radius", "max"), n=("radius", "size")).reset_index()
    cells = hard_negatives.Cells(found, {8: space})
    rows = space.to_pivots(space.rows((at * 256).astype(np.int64)))
    list(counted(cells, 8, rows <= 3 * cells.radius[8] + 40))
    assert sum(seen) < 0.5 * 800 * len(np.unique(cells.group[8]))

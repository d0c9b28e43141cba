"""Hard negatives by a Voronoi-partitioned distributed kNN join on inner products.

Vectors are augmented with sqrt(M**2 - |x|**2), M the largest norm, and anchors scaled to norm M (those of norm 0 stand on
an axis of their own): then the squared distance of an anchor and a row is 2 * M**2 - 2 * score * M / |anchor|, so that
the rows of highest score are the nearest.
Pivots, fitted on a bounded sample, cut space into cells. An anchor lies in the cell of its nearest pivot; a cell's
radius is the largest distance from its pivot to its anchors. Each row's distance to a cell's pivot, more or less the
radius, bounds its distance to every anchor of the cell, and bounds on how far the cell's anchors must look tell which
rows might serve it:

* positives (k nearest rows of the anchor's own label): k + 1 rows of that label lie within t of the pivot (one of them
  may be the anchor itself), so none farther than t + 2 * radius from the pivot is wanted;
* negatives (rows of other labels whose score lies between `low` and `high` of a positive's): none beyond the floor of
  the cell's lowest positive, none nearer than the ceiling of its highest, and none farther than rows that are surely
  under every ceiling and enough for each label.

Cells make groups of some BLOCK anchors. A row goes once to each group with a cell that it might serve, packed with the
others of its batch as one matrix; anchors go to all SHARDS shares of their group's rows. A share meets its anchors in an
exact integer join, and the shares' short lists merge by rank. Bounds are taken with SLACK for rounding, so they can only
let through too many rows, never too few. Work grows with rows times anchors where bounds do not bite.

Defined cases: rows whose id, label or vector is null, or whose vector is empty or holds null or non-finite components,
take no part; vectors of unlike length do not meet; rows that repeat an id are candidates each, but never of an anchor of
that id; of anchors that repeat id, label and vector one is asked; ties go to the smaller id; a positive below 0 has no
negatives; numbers beyond 64 bits are held at the largest of that sign. Labels are whole numbers.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pelagos.llm.tables import written
from pelagos.llm.topk import _product

#: Pivots, rows of the sample that they are fitted on, anchors a group and rows a share (about).
PIVOTS, SAMPLE, BLOCK, SHARE_ROWS = 64, 4096, 1024, 65_536
SLACK = 1e-5
PACKED = "grp int, share int, dim int, ids binary, labels binary, extra binary, width int, vectors binary"


class Space:
    """The augmented space of one vector length: its norm bound and pivots. Bounded by PIVOTS rows."""

    def __init__(self, sample: np.ndarray, norm: float):
        self.norm = max(norm, 1.0)
        points = self.rows(sample if len(sample) else np.zeros((1, sample.shape[1])))
        picked = [0]
        away = self._to(points, points[:1])[:, 0]
        for _ in range(min(PIVOTS, len(points)) - 1):  # the farthest from those picked, so that cells spread over all of space
            picked.append(int(away.argmax()))
            away = np.minimum(away, self._to(points, points[picked[-1:]])[:, 0])
        pivots = points[picked]
        for _ in range(5):
            own = self._to(points, pivots).argmin(axis=1)
            pivots = np.stack([points[own == k].mean(axis=0) if (own == k).any() else pivots[k] for k in range(len(pivots))])
        self.pivots = pivots

    def rows(self, x: np.ndarray) -> np.ndarray:
        x = x.astype(np.float64)
        return np.c_[x, np.sqrt(np.maximum(self.norm**2 - (x**2).sum(axis=1), 0)), np.zeros(len(x))]

    def anchors(self, x: np.ndarray) -> np.ndarray:
        x = x.astype(np.float64)
        size = np.sqrt((x**2).sum(axis=1, keepdims=True))
        return np.c_[x * self.norm / np.where(size > 0, size, 1), np.zeros(len(x)), np.where(size > 0, 0, self.norm)]

    @staticmethod
    def _to(points: np.ndarray, others: np.ndarray) -> np.ndarray:
        square = (points**2).sum(axis=1)[:, None] + (others**2).sum(axis=1)[None, :] - 2 * points @ others.T
        return np.sqrt(np.maximum(square, 0))

    def to_pivots(self, points: np.ndarray) -> np.ndarray:
        return self._to(points, self.pivots)

    def distance(self, score: np.ndarray, size: np.ndarray) -> np.ndarray:
        """How far a row of this score is from an anchor of this size."""
        return np.sqrt(np.maximum(2 * self.norm**2 - 2 * score * self.norm / np.where(size > 0, size, 1), 0))

    @property
    def slack(self) -> float:
        return SLACK * self.norm


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype(np.int64)


def _by_dim(pdf: pd.DataFrame) -> Iterator[tuple[int, pd.DataFrame]]:
    yield from ((int(d), x) for d, x in pdf.groupby("dim", sort=False))


def _pack(grp: int, share: int, ids, labels, extra, values: np.ndarray) -> dict:
    """A matrix of whole numbers in the narrowest width that holds it."""
    most = max(int(values.max(initial=0)), -int(values.min(initial=0)) - 1)
    width = next(w for w in (2, 4, 8) if most < 1 << (8 * w - 1))
    return {"grp": grp, "share": share, "dim": values.shape[1], "ids": ids.astype(np.int64).tobytes(), "labels": labels.astype(np.int64).tobytes(), "extra": extra.astype(np.int64).tobytes(), "width": width, "vectors": values.astype(f"<i{width}").tobytes()}


def _unpack(t, side: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    ids, labels, extra = (np.frombuffer(getattr(t, f"{side}_{c}"), np.int64) for c in ("ids", "labels", "extra"))
    return ids, labels, extra, np.frombuffer(getattr(t, f"{side}_vectors"), f"<i{getattr(t, f'{side}_width')}").reshape(len(ids), t.dim).astype(np.int64)


def best(score: np.ndarray, fit: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k highest scores of each row among those that fit, ties to the smaller id."""
    low = np.iinfo(np.int64).min
    held = np.where(fit, score, low)
    n = min(k, held.shape[1])
    floor = np.partition(held, held.shape[1] - n, axis=1)[:, held.shape[1] - n]
    row, col = np.nonzero(fit & (held >= floor[:, None]))
    order = np.lexsort((ids[col], -score[row, col], row))
    row, col = row[order], col[order]
    start = np.flatnonzero(np.r_[np.ones(min(1, len(row)), bool), row[1:] != row[:-1]])
    rank = np.arange(len(row)) - np.repeat(start, np.diff(np.r_[start, len(row)]))
    return row[rank < k], col[rank < k]


class Cells:
    """What each cell of a space holds and how its anchors are grouped. PIVOTS rows a vector length."""

    def __init__(self, found: pd.DataFrame, spaces: dict[int, Space]):
        self.radius, self.group, self.blocks, groups = {}, {}, {}, 0
        for dim, space in spaces.items():
            mine = found[found["dim"] == dim]
            radius = np.zeros(len(space.pivots))
            count = np.zeros(len(space.pivots), np.int64)
            radius[mine["cell"]], count[mine["cell"]] = mine["radius"], mine["n"]
            # near cells make a group: a walk from pivot to nearest pivot, cut into runs of some BLOCK anchors
            near = space.to_pivots(space.pivots)
            left, at, group = set(range(len(near))), 0, np.zeros(len(near), np.int32)
            held = 0
            while left:
                left.remove(at)
                if held and held + count[at] > BLOCK:
                    groups, held = groups + 1, 0
                group[at] = groups
                held += int(count[at])
                at = min(left, key=lambda k: near[at, k]) if left else at  # noqa: B023
            groups += 1
            of = np.bincount(group, count, groups)
            self.radius[dim], self.group[dim], self.blocks[dim] = radius, group, np.ceil(of[group] / BLOCK).clip(1).astype(np.int64)

    def groups_of(self, dim: int, serves: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(group, rows that might serve one of its cells)"""
        for g in np.unique(self.group[dim]).tolist():
            rows = np.flatnonzero(serves[:, self.group[dim] == g].any(axis=1))
            if len(rows):
                yield g, rows


def mine(
    vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label"
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor and each of its first
    `positives` rows of the same label, the first `negatives` rows of other labels that score from low % to high % of it."""
    usable = F.col(embedding).isNotNull() & (F.size(embedding) > 0) & F.forall(embedding, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < F.lit(float("inf")))) & F.col(vec_id).isNotNull() & F.col(label).isNotNull()
    rows = vectors.filter(usable).select(
        F.col(vec_id).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.size(embedding).alias("dim"), F.transform(F.col(embedding).cast("array<double>"), lambda c: F.floor(c * F.lit(float(scale)))).alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("q")
    )
    rows = written(rows, "vectors")
    of = {r["dim"]: r for r in rows.groupBy("dim").agg(F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c))).alias("norm"), F.count("*").alias("n")).collect()}
    # pivots come from a sample by hash; whatever they are, results are exact
    likely = F.coalesce(*[F.when(F.col("dim") == d, F.lit(4 * SAMPLE / r["n"])) for d, r in of.items()], F.lit(1.0))
    drawn = rows.select("dim", "v", F.xxhash64("id", "v").alias("h")).filter(F.pmod("h", F.lit(1 << 20)) < likely * (1 << 20))
    drawn = drawn.withColumn("k", F.row_number().over(Window.partitionBy("dim").orderBy("h"))).filter(F.col("k") <= SAMPLE).select("dim", "v").toPandas()
    samples = {int(d): _matrix(x["v"]) for d, x in drawn.groupby("dim")}
    spaces = {int(d): Space(samples.get(d, np.zeros((0, d))), float(r["norm"])) for d, r in of.items()}
    shares = max(1, -(-sum(r["n"] for r in of.values()) // SHARE_ROWS))
    asked = rows.filter("q").dropDuplicates(["id", "label", "v"]).withColumn("key", F.xxhash64("label", "v"))

    # ---- the cells' anchors

    def into_cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for dim, x in _by_dim(pdf):
                away = spaces[dim].to_pivots(spaces[dim].anchors(_matrix(x["v"])))
                cell = away.argmin(axis=1)
                yield pd.DataFrame({"id": x["id"], "label": x["label"], "key": x["key"], "dim": dim, "v": x["v"], "cell": cell, "away": away[np.arange(len(x)), cell]})

    anchors = written(asked.select("id", "label", "key", "dim", "v").mapInPandas(into_cells, "id long, label long, key long, dim int, v array<long>, cell int, away double"), "anchors")
    cells = Cells(anchors.groupBy("dim", "cell").agg(F.max("away").alias("radius"), F.count("*").alias("n")).toPandas(), spaces)

    # ---- positives: how far the anchors of each label must look

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The positives + 1 least distances to each pivot, by label: no more rows wanted in a batch's part."""
        for pdf in batches:
            for dim, x in _by_dim(pdf):
                away = spaces[dim].to_pivots(spaces[dim].rows(_matrix(x["v"])))
                for lab, at in x.reset_index(drop=True).groupby("label").groups.items():
                    least = np.sort(away[at], axis=0)[: positives + 1]
                    yield pd.DataFrame({"dim": dim, "label": lab, "k": np.repeat(np.arange(least.shape[1]), len(least)), "away": least.T.reshape(-1)})

    least = rows.select("dim", "label", "v").mapInPandas(nearest, "dim int, label long, k int, away double")
    enough = least.withColumn("r", F.row_number().over(Window.partitionBy("dim", "label", "k").orderBy("away"))).filter(F.col("r") == positives + 1)
    reach = enough.select("dim", "label", F.col("k").alias("cell"), "away")
    # one row a label: how far from each pivot its rows may lie and still be wanted; -1 where the cell has no anchor of it
    here = anchors.groupBy("dim", "label", "cell").agg(F.max("away").alias("radius"))
    wanted = here.join(reach, ["dim", "label", "cell"], "left").select("dim", "label", "cell", (F.coalesce("away", F.lit(float("inf"))) + 2 * F.col("radius")).alias("reach"))
    by_label = wanted.groupBy("dim", "label").agg(F.map_from_entries(F.collect_list(F.struct("cell", "reach"))).alias("reach"))
    by_label = by_label.select("dim", "label", F.transform(F.sequence(F.lit(0), F.lit(PIVOTS - 1)), lambda c: F.coalesce(F.element_at("reach", c), F.lit(-1.0))).alias("reach"))

    def serve_positives(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for dim, x in _by_dim(pdf):
                values = _matrix(x["v"])
                away = spaces[dim].to_pivots(spaces[dim].rows(values))
                serves = away <= np.stack(x["reach"].to_numpy())[:, : away.shape[1]] + spaces[dim].slack
                ids, labels = x["id"].to_numpy(), x["label"].to_numpy()
                for g, at in cells.groups_of(dim, serves):
                    out.append(_pack(g, zlib.crc32(ids[:1].tobytes()) % shares, ids[at], labels[at], ids[at], values[at]))
            if out:
                yield pd.DataFrame(out)

    def pack_anchors(pdf: pd.DataFrame) -> pd.DataFrame:
        dim, values = int(pdf["dim"].iloc[0]), _matrix(pdf["v"])
        return pd.DataFrame([_pack(int(pdf["grp"].iloc[0]), 0, pdf["id"].to_numpy(), pdf["label"].to_numpy(), pdf["key"].to_numpy(), values)])

    def tiles(of: DataFrame, table: DataFrame) -> DataFrame:
        """Each block of anchors beside each batch of rows of its group."""
        a = of.select(*[F.col(c).alias(f"a_{c}") for c in ("ids", "labels", "extra", "width", "vectors")], "grp", "dim", *([F.col("a_asks")] if "a_asks" in of.columns else []), F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share"))
        return a.join(table.select(*[F.col(c).alias(f"r_{c}") for c in ("ids", "labels", "extra", "width", "vectors")], "grp", "dim", "share"), ["grp", "dim", "share"])

    in_blocks = lambda of: of.withColumns({"grp": _lookup(cells.group), "block": F.pmod(F.xxhash64("id", "key"), _lookup(cells.blocks))})
    blocks = in_blocks(anchors)
    packed = blocks.groupBy("grp", "dim", "block").applyInPandas(pack_anchors, PACKED)
    served = rows.select("id", "label", "dim", "v").join(by_label, ["dim", "label"]).mapInPandas(serve_positives, PACKED)

    def join_positives(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for t in pdf.itertuples(index=False):
                a_id, a_label, a_key, a = _unpack(t, "a")
                r_id, r_label, _, r = _unpack(t, "r")
                score = _product(a, r)
                row, col = best(score, (a_label[:, None] == r_label[None, :]) & (a_id[:, None] != r_id[None, :]), r_id, positives)
                size = np.sqrt((a[row].astype(np.float64) ** 2).sum(axis=1))
                yield pd.DataFrame({"anchor_id": a_id[row], "key": a_key[row], "positive_id": r_id[col], "score": score[row, col], "size": size})

    met = tiles(packed, served).mapInPandas(join_positives, "anchor_id long, key long, positive_id long, score long, size double")
    first = met.withColumn("nth", F.row_number().over(Window.partitionBy("anchor_id", "key").orderBy(F.desc("score"), "positive_id"))).filter(F.col("nth") <= positives)
    asks = first.groupBy("anchor_id", "key").agg(F.sort_array(F.collect_list(F.struct("nth", "positive_id", "score"))).alias("asks"), F.first("size").alias("size"))
    asking = written(anchors.join(asks.withColumnRenamed("anchor_id", "id"), ["id", "key"]), "positives")

    # ---- negatives: between which distances the anchors of each cell look

    floor_, ceiling = F.col("a.score") * (low / 100), F.col("a.score") * (high / 100)
    spans = asking.select("dim", "cell", "size", F.explode("asks").alias("a")).filter("a.score >= 0").groupBy("dim", "cell").agg(F.min(floor_ / F.greatest("size", F.lit(1e-300))).alias("least"), F.max(ceiling / F.greatest("size", F.lit(1e-300))).alias("most"), F.min(ceiling / F.greatest("size", F.lit(1e-300))).alias("under"))
    near, far, sure = {}, {}, {}
    found = spans.toPandas()
    for dim, space in spaces.items():
        mine_ = found[found["dim"] == dim]
        radius = cells.radius[dim]
        near[dim], far[dim], sure[dim] = np.full(len(radius), np.inf), np.full(len(radius), -np.inf), np.full(len(radius), np.inf)
        of_size_one = lambda s: space.distance(s.to_numpy(), np.ones(len(s)))  # noqa: B023, E731
        near[dim][mine_["cell"]] = of_size_one(mine_["most"])
        far[dim][mine_["cell"]] = of_size_one(mine_["least"])
        sure[dim][mine_["cell"]] = of_size_one(mine_["under"])
        near[dim], far[dim], sure[dim] = near[dim] - radius - space.slack, far[dim] + radius + space.slack, sure[dim] + radius + space.slack

    def under_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The least distances of rows that lie under the ceilings of all anchors of a cell, by label."""
        for pdf in batches:
            for dim, x in _by_dim(pdf):
                away = spaces[dim].to_pivots(spaces[dim].rows(_matrix(x["v"])))
                away = np.where(away >= sure[dim][None, :], away, np.inf)
                for lab, at in x.reset_index(drop=True).groupby("label").groups.items():
                    least = np.sort(away[at], axis=0)[:negatives]
                    part = pd.DataFrame({"dim": dim, "label": lab, "k": np.repeat(np.arange(least.shape[1]), len(least)), "away": least.T.reshape(-1)})
                    yield part[np.isfinite(part["away"])]

    under = rows.select("dim", "label", "v").mapInPandas(under_all, "dim int, label long, k int, away double")
    third = under.withColumn("r", F.row_number().over(Window.partitionBy("dim", "label", "k").orderBy("away"))).filter(F.col("r") == negatives)
    # the least such distance serves anchors of all labels but its own, the second least those too
    second = third.withColumn("r", F.row_number().over(Window.partitionBy("dim", "k").orderBy("away"))).filter(F.col("r") == 2).toPandas()
    for dim in spaces:
        mine_ = second[second["dim"] == dim]
        bound = np.full(len(far[dim]), np.inf)
        bound[mine_["k"]] = mine_["away"]
        far[dim] = np.minimum(far[dim], bound + 2 * cells.radius[dim] + spaces[dim].slack)

    def serve_negatives(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for dim, x in _by_dim(pdf):
                values = _matrix(x["v"])
                away = spaces[dim].to_pivots(spaces[dim].rows(values))
                ids, labels = x["id"].to_numpy(), x["label"].to_numpy()
                for g, at in cells.groups_of(dim, (away >= near[dim]) & (away <= far[dim])):
                    out.append(_pack(g, zlib.crc32(ids[:1].tobytes()) % shares, ids[at], labels[at], ids[at], values[at]))
            if out:
                yield pd.DataFrame(out)

    asked_for = f"struct<{', '.join(f'{c}: binary' for c in ('at', 'positive', 'score'))}>"

    def pack_asks(pdf: pd.DataFrame) -> pd.DataFrame:
        flat = [(k, a["positive_id"], a["score"]) for k, asks in enumerate(pdf["asks"]) for a in asks if a["score"] >= 0]
        at, positive, score = (np.array([f[c] for f in flat], np.int64).tobytes() for c in range(3))
        return pack_anchors(pdf).assign(a_asks=[{"at": at, "positive": positive, "score": score}])

    blocks = in_blocks(asking)
    packed = blocks.groupBy("grp", "dim", "block").applyInPandas(pack_asks, f"{PACKED}, a_asks {asked_for}")
    served = rows.select("id", "label", "dim", "v").mapInPandas(serve_negatives, PACKED)

    def join_negatives(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for t in pdf.itertuples(index=False):
                a_id, a_label, a_key, a = _unpack(t, "a")
                r_id, r_label, _, r = _unpack(t, "r")
                at, positive, wanted = (np.frombuffer(t.a_asks[c], np.int64) for c in ("at", "positive", "score"))
                floor = np.array([-(-low * s // 100) for s in wanted.tolist()], np.int64)  # whole numbers, however large
                top = np.array([high * s // 100 for s in wanted.tolist()], np.int64)
                score, other = _product(a, r), a_label[:, None] != r_label[None, :]
                for k in range(0, len(at), BLOCK):
                    of = at[k : k + BLOCK]
                    s = score[of]
                    row, col = best(s, other[of] & (s >= floor[k : k + BLOCK, None]) & (s <= top[k : k + BLOCK, None]), r_id, negatives)
                    yield pd.DataFrame({"anchor_id": a_id[of[row]], "key": a_key[of[row]], "positive_id": positive[k + row], "positive_score": wanted[k + row], "nth": k + row, "negative_id": r_id[col], "negative_score": s[row, col]})

    met = tiles(packed, served).mapInPandas(join_negatives, "anchor_id long, key long, positive_id long, positive_score long, nth long, negative_id long, negative_score long")
    rank = F.row_number().over(Window.partitionBy("anchor_id", "key", "nth").orderBy(F.desc("negative_score"), "negative_id"))
    return met.withColumn("rank", rank).filter(F.col("rank") <= negatives).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _lookup(group: dict[int, np.ndarray]) -> Column:
    """What a table of PIVOTS numbers for each vector length says of a cell."""
    found = F.lit(None).cast("int")
    for dim, of in group.items():
        found = F.when(F.col("dim") == dim, F.element_at(F.array(*[F.lit(int(g)) for g in of]), F.col("cell") + 1)).otherwise(found)
    return found

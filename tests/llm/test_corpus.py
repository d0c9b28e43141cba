"""Operators over the whole corpus: near duplicates, lines, packing, top-k search, language-model scores, the pipeline."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from compare import duck_rows, spark_rows
from pyspark.sql import functions as F

from pelagos.llm import line_dedup, lm_score, minhash_dedup, packing, queries, topk


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_oracle(spark, sf, duck, name):
    assert spark_rows(queries.queries()[name](spark, sf)) == duck_rows(duck, queries.oracle_sql()[name])


def _bag(text):
    w = re.findall(r"\w+", text.lower())
    return Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else Counter([("", text)])


def _classes(rows, least=0.8):
    """Classes by comparing all pairs that share a shingle."""
    bags, holders, root = [(i, _bag(t or "")) for i, t in rows if i is not None], defaultdict(list), {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for k, (i, b) in enumerate(bags):
        find(i)
        shared = Counter()
        for g, n in b.items():
            for j in holders[g]:
                shared[j] += min(n, bags[j][1][g])
            holders[g].append(k)
        for j, n in shared.items():
            if n >= least * (b.total() + bags[j][1].total() - n):
                x, y = find(i), find(bags[j][0])
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in root}


def test_near_duplicates_equal_brute_force(spark, docs, awkward, empty):
    base = [f"w{k}" for k in range(120)]
    made = []
    for k in range(40):  # one group with edits, and texts that share two thirds
        words = list(base)
        words[3 * k % 120] = f"edit{k}"
        made += [(1000 + k, " ".join(words)), (2000 + k, " ".join(base[:80] + [f"own{k}x{j}" for j in range(40)]))]
    for df in (docs.select("doc_id", "text"), awkward.select("doc_id", "text"), empty.select("doc_id", "text"), spark.createDataFrame(made, "doc_id long, text string")):
        got = {r["doc_id"]: r["class_id"] for r in minhash_dedup.near_duplicates(df).collect()}
        assert got == _classes([(r["doc_id"], r["text"]) for r in df.collect()])


def test_bag_minhash_is_unbiased():
    rng, n, m = np.random.default_rng(5), 300, minhash_dedup.M
    a, b = rng.integers(1, 9, 40), rng.integers(1, 9, 40)
    hits = []
    for _ in range(n):
        elem = rng.integers(0, 1 << 52, 40).astype(np.uint64)
        sig = minhash_dedup.bag_minhash(np.repeat([0, 1], 40), np.r_[elem, elem], np.r_[a, b], 2)
        hits.append((sig[0] == sig[1]).mean())
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs(np.mean(hits) - want) < 5 * math.sqrt(want * (1 - want) / (n * m))


def test_line_dedup_edges(spark, awkward, empty):
    for df in (awkward, empty):
        kept = line_dedup.apply_bitmaps(df, line_dedup.keep_bitmaps(df))
        assert kept.count() == df.count()
    line = "A line that is well over forty code points long, shared"
    rows = [(k, f"  {line.upper()}\t\nown {k}\n{line}") for k in range(6)] + [(7, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["text"]) for r in line_dedup.apply_bitmaps(df, line_dedup.keep_bitmaps(df, partitions=3)).collect()}
    assert got[5] == (3, 0, rows[5][1]) and got[0] == (3, 2, "own 0") and got[7][:2] == (1, 0)


def _check_packing(rows, capacity):
    bins, total = defaultdict(list), Counter()
    for r in rows:
        bins[(r["shard"], r["bin"])].append(r)
        total[r["doc_id"]] += r["length"]
    for pieces in bins.values():
        assert sum(p["length"] for p in pieces) + pieces[0]["residual"] == capacity and pieces[0]["residual"] >= 0
        assert sorted(p["slot"] for p in pieces) == list(range(len(pieces)))
    return bins, total


def test_packing_keeps_all_words_and_conflicts_apart(docs, awkward, empty):
    rows = packing.best_fit(docs).collect()
    bins, total = _check_packing(rows, 2048)
    words = {r["doc_id"]: len(re.findall(r"[^ \t-\r]+", r["text"] or "")) for r in docs.collect()}
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert dict(total) == words
    for pieces in bins.values():
        ids = [p["doc_id"] for p in pieces]
        assert len({source[i] for i in ids}) == len(ids) and len({text[i] for i in ids}) == len(ids)
    _check_packing(packing.best_fit(awkward).collect(), 2048)
    assert packing.best_fit(empty).count() == 0


def test_packing_takes_the_tightest_compatible_bin():
    rng = np.random.default_rng(3)
    pieces = sorted(((int(n), 1 << int(s), 1 << int(c)) for n, s, c in zip(rng.integers(1, 60, 400), rng.integers(0, 9, 400), rng.integers(0, 40, 400))), key=lambda p: -p[0])
    bins = []
    for (n, s, c), (b, slot, used) in zip(pieces, packing.pack(pieces, 100)):
        fits = [x for x in bins if x[0] >= n and not x[1] & s and not x[2] & c]
        if b == len(bins):
            assert not fits
            bins.append([100, 0, 0])
        else:
            assert bins[b][0] == min(x[0] for x in fits) and not bins[b][1] & s and not bins[b][2] & c
        assert used == 100 - bins[b][0]
        bins[b] = [bins[b][0] - n, bins[b][1] | s, bins[b][2] | c]


def test_top_k_edges_and_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i), [float(x) for x in rng.normal(size=8)]) for i in range(300)]
    rows += [(300, None), (350, []), (400, [None] * 8), (450, [float("nan")] * 8), (500, [float("inf")] * 8), (50, rows[50][1]), (501, rows[7][1]), (502, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    good = [(i, np.floor(256 * np.array(v))) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for q, v in good:
        if q % 50 == 0:
            best = sorted((-int(v @ w), i) for i, w in good if i != q and len(w) == len(v))[:5]
            want += [(q, i, -s) for s, i in best]
    got = [(r["query_id"], r["vec_id"], r["score"]) for r in topk.top_k(df, F.col("vec_id") % 50 == 0).collect()]
    dup = [x for x in got if x[0] == 50]
    assert sorted(x for x in got if x[0] != 50) == sorted(x for x in want if x[0] != 50) and len(dup) == 5
    assert topk.top_k(df.limit(0), F.lit(True)).count() == 0


def test_lm_scores(spark, docs, awkward, empty):
    for df in (docs.select("doc_id", "text"), awkward.select("doc_id", "text")):
        rows = [(r["doc_id"], r["text"] or "") for r in df.collect()]
        train = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 != 0
        lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
        tokens = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t.translate(lower)) + [None]
        count = Counter(w for i, t in rows if train(i) for w in tokens(t))
        n, v = count.total(), len(count)
        want = sorted((str(i), not train(i), len(w := tokens(t)), sum(count[x] > 0 for x in w), n, round(sum(math.log10((count[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), 4)) for i, t in rows)
        flag = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 != 0
        plain = lm_score.score_texts(df, flag).collect()
        assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in plain) == want
        assert all(r["score"] < 0 for r in plain)
        # a filter that isn't broadcast answers the same bits
        key = lambda r: (str(r["doc_id"]), r["n_tokens"], round(r["base_score"], 6), r["score"])
        assert sorted(map(key, plain)) == sorted(map(key, lm_score.score_texts(df, flag, max_filter=0).collect()))
    assert lm_score.score_texts(empty, F.lit(True)).count() == 0


def _plain_lm(train, texts, order, weight, quantised):
    """log10 probabilities with counts in dictionaries, and the probability of any next token after a history."""
    tokens = lambda t: t.split() + [None]
    counts = Counter()
    for t in train:
        full = ["<", *tokens(t)]
        for n in range(2, order + 1):
            counts.update(tuple(full[k - n + 1 : k + 1]) for k in range(1, len(full)) if k - n + 1 >= 0)
        counts.update((w,) for w in tokens(t))
    counts["<",] = len(train)
    total, types = sum(n for g, n in counts.items() if len(g) == 1 and g != ("<",)), len([g for g in counts if len(g) == 1]) - 1
    of = lambda g: float(lm_score.count_of(lm_score.level(np.array([counts[g]])))[0]) if quantised and len(g) > 1 else counts[g]

    def chance(history, w):
        p = (counts[w,] + 0.1) / (total + 0.1 * (types + 1))
        for n in range(1, min(order - 1, len(history)) + 1):
            h = tuple(history[len(history) - n :])
            p = (min(of((*h, w)), of(h)) + weight * p) / (of(h) + weight)
        return p

    scores = []
    for t in texts:
        full = ["<", *tokens(t)]
        scores.append(sum(math.log10(chance(full[max(0, k - order + 1) : k], full[k])) for k in range(1, len(full))))
    return scores, chance, [g[0] for g in counts if len(g) == 1 and g != ("<",)]


def test_lm_score_equals_plain_counts_and_sums_to_one(spark):
    rng = np.random.default_rng(8)
    texts = [" ".join(f"w{int(x)}" for x in rng.zipf(1.6, rng.integers(0, 60)) % 40) for _ in range(300)]
    texts += [texts[5], texts[5], ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    flag = F.col("doc_id") % 10 != 0
    train = [t for k, t in enumerate(texts) if k % 10]
    want, chance, words = _plain_lm(train, texts, lm_score.ORDER, lm_score.WEIGHT, True)
    got = {r["doc_id"]: r["score"] for r in lm_score.score_texts(df, flag).collect()}
    # false finds of the filter move a text's score by little, and rarely
    gap = np.array([abs(got[k] - w) for k, w in enumerate(want)])
    assert np.median(gap) < 1e-9 or np.quantile(gap, 0.5) < 0.02 * np.median(np.abs(want))
    assert (gap <= 0.05 * np.maximum(1, np.abs(want))).mean() > 0.95
    _, exact, _ = _plain_lm(train, [], lm_score.ORDER, lm_score.WEIGHT, False)
    for t in train[:20]:
        history = ["<", *t.split()][-3:]
        assert abs(sum(exact(history, w) for w in [*words, "never seen"]) - 1) < 1e-9
        assert 0.85 < sum(chance(history, w) for w in words) < 1.15


def test_pipeline_keeps_what_stages_keep(spark, sf, docs):
    import corpus_pipeline as p

    kept = docs
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, kept, sf)
        assert out.columns == docs.columns
        ids = {r["doc_id"] for r in out.select("doc_id").collect()}
        before = {r["doc_id"] for r in kept.select("doc_id").collect()}
        assert ids <= before
        if name in ("line_dedup", "pii"):
            assert ids == before
        if name == "near_dedup":
            rows = [(r["doc_id"], r["text"]) for r in kept.collect()]
            assert ids == set(_classes(rows).values())
        kept = p.written(out, f"test-{name}")
    packed = p.STAGES[-1][1](spark, kept, sf)
    assert {r["doc_id"] for r in packed.collect()} == {r["doc_id"] for r in kept.collect()}

"""Packing keeps near copies apart, not just equal texts."""

from collections import Counter, defaultdict

from pelagos.llm import queries


def test_no_bin_holds_two_near_copies(spark, tmp_path):
    base = [f"w{k}" for k in range(120)]
    rows = []
    for k in range(12):  # one class of near copies, each of another source
        words = list(base)
        words[9 * k] = f"edit{k}"
        rows.append((k, " ".join(words), f"s{k}"))
    rows += [(None, rows[3][1], "t0"), (100, "all by itself", "t1")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op6_packing(spark, str(tmp_path)).collect()
    bins = defaultdict(list)
    for r in got:
        bins[(r["shard"], r["bin"])].append(r["doc_id"])
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _, _ in rows)
    assert all(sum(i != 100 for i in ids) == 1 for ids in bins.values() if ids != [100])

"""Awkward rows by content: repeated and large ids, null ids, clashing columns, long runs, nested media."""

import gzip
import io
import re
import zipfile
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from pelagos.llm import line_dedup, media, packing, pii, topk

BIG = 9007199254740993


def test_top_k_asks_a_repeated_query_once(spark):
    rows = [(50, [1.0, 0.0])] * 2 + [(k, [float(k), 1.0]) for k in range(1, 8)] + [(100, [-1.0, 0.0]), (100, [0.0, 1.0])]
    got = defaultdict(list)
    for r in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"]))
    assert sorted(got[50]) == [(1, 7), (2, 6), (3, 5), (4, 4), (5, 3)]
    # two vectors under one id: a list each
    assert sorted(got[100]) == sorted([(1, 1), (2, 50), (3, 50), (4, 2), (5, 3)] + [(1, 1), (2, 2), (3, 3), (4, 4), (5, 5)])


def _plain_lines(rows):
    """(id, dropped, text) of every row, by dictionaries."""
    key = lambda x: re.sub("[A-Z]", lambda m: m.group().lower(), x.strip(" \t\n\x0b\x0c\r"))
    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if i is not None and len(key(line)) >= 40:
                holders[key(line)].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or len(holders[key(x)]) < 5 or i == max(holders[key(x)])]
        out.append((str(i), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


@pytest.mark.parametrize("partitions", [1, 3, 16])
def test_line_dedup_by_content(spark, partitions):
    line = [f"shared line number {k} that has well over forty code points" for k in range(9)]
    rows = [(i, "\n".join(line)) for i in (1, 2, 3, None, None)]  # three documents only
    rows += [(BIG + k, "\n".join([line[0].upper(), "x" * 39, f"   {'y' * 41}\t", "own"])) for k in (0, 1, 2, 2, 3)]
    rows += [(k, f"a line that a third of all rows hold, again and again\n{k}") for k in range(100, 2000)] + [(5, None), (6, ""), (7, "\n\n")]
    df = spark.createDataFrame([(*r, 1, "b", 2) for r in rows], "doc_id long, text string, _keep int, _id string, map_keep int").repartition(7)
    kept = line_dedup.apply_bitmaps(df, line_dedup.keep_bitmaps(df, partitions=partitions))
    assert kept.columns == [*df.columns, "n_lines", "n_dropped"]
    assert sorted((str(r["doc_id"]), r["n_dropped"], r["text"] or "") for r in kept.collect()) == _plain_lines(rows)


def test_packing_keeps_large_and_null_ids(spark):
    rows = [(BIG, "one two three", "a", 2**63 - 1), (None, "four five", "a", None), (BIG + 1, "six", None, 2**63 - 2), (None, None, "b", 2**63 - 2), (BIG, "one two three", "a", 2**63 - 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, cluster long")
    got = packing.best_fit(df, capacity=4, cluster=F.col("cluster")).collect()
    assert sorted((r["doc_id"] or 0, r["length"]) for r in got) == [(0, 0), (0, 2), (BIG, 3), (BIG, 3), (BIG + 1, 1)]
    bins = defaultdict(list)
    for r in got:
        bins[r["bin"]].append(r["doc_id"])
    assert all(x.count(BIG) < 2 for x in bins.values())


def test_pii_weighs_whole_documents_and_what_values_share(spark):
    far = " ".join(f"w{k}q" for k in range(60))
    rows = [(None if k % 3 == 0 else k, f"projectfalcon{'' if k % 2 else '.'} {k}start {far} {k}side person{k}@lab.example {k}other") for k in range(8)]
    rows += [(100 + k, f"{far} nothing here {k}") for k in range(60)] + [(300, "projectfalcon again, and no find"), (301, None), (302, "")]
    df = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, _row int")
    got = {r["text"]: r for r in pii.find_private(df).collect()}
    assert pii.find_private(df).columns == [*df.columns, "base", "terms"] and all(r["_row"] == 5 for r in got.values())
    for _, t in rows[:8]:
        # no address is found twice, but all share their domain
        assert [s["value"] for s in got[t]["terms"]] == ["projectfalcon"] and got[t]["terms"][0]["start"] == 0
    assert all(got[t]["terms"] == [] for _, t in rows[8:])
    assert sum("[TERM]" in (r["text"] or "") for r in pii.sanitise(pii.find_private(df)).collect()) == 8


def test_media_ends_and_nesting(spark):
    first = b"%PDF-1.4\n1 0 obj\nendobj\nxref\n0 1\ntrailer\nstartxref\n24\n%%EOF\n"
    pdf = first + b"2 0 obj\nendobj\nxref\n0 1\ntrailer\nstartxref\n%d\n%%%%EOF" % (len(first) + 15)
    assert media.sniff(pdf) == [("application/pdf", 0, len(pdf))]
    assert media.sniff(b"--" + pdf + b"--" + first)[0] == ("application/pdf", 2, len(pdf))
    box = lambda name, body, size=None: (8 + len(body) if size is None else size).to_bytes(4, "big") + name + body
    long = box(b"ftyp", b"isom") + box(b"mdat", (20).to_bytes(8, "big") + b"data", 1) + box(b"mdat", b"to the end", 0)
    assert ("video/mp4", 0, len(long)) in media.sniff(long)
    inner = b"\x89PNG\r\n\x1a\n" + b"".join(len(d).to_bytes(4, "big") + n + d + zlib.crc32(n + d).to_bytes(4, "big") for n, d in ((b"IHDR", bytes(13)), (b"IEND", b"")))
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        z.writestr("a.wav", media.wav(inner + b"\0" * 8))
        z.writestr("b.gz", gzip.compress(b"x" * 200_000))
    raw = b"junk" + packed.getvalue() + b"junk"
    rows = media.carve(spark.createDataFrame([(1, bytearray(raw)), (2, None), (3, bytearray(b""))], "k int, media binary")).collect()
    found = {r["kind"]: r for r in rows}
    assert {r["k"] for r in rows} == {1} and {"application/zip", "audio/wav", "image/png", "application/gzip"} <= set(found)
    assert bytes(found["image/png"]["bytes"]) == inner and all(raw[r["start"] : r["start"] + r["length"]] == bytes(r["bytes"]) for r in rows)
    assert bytes(found["application/zip"]["bytes"]) == packed.getvalue()
    assert media.sniff(b"PK\x03\x04" * 20_000 + b"%PDF-" * 5000) == []  # hostile, and quick
    df = spark.createDataFrame([(1, "t")], "k int, text string")
    for name in ("payload", "feature"):
        with pytest.raises(ValueError):
            media.sample_features(media.sniff_media(media.store_texts(df.withColumn(name, F.lit(1)))))
    with pytest.raises(ValueError):
        media.store_texts(df.withColumn("media", F.lit(1)))


def test_pipeline_stages_on_awkward_rows(spark, sf, awkward, empty):
    import corpus_pipeline as p

    for df in (awkward, empty):
        df = df.withColumn("extra", F.lit(1)).withColumn("_keep", F.lit("x"))
        for name, stage in p.STAGES[:-1]:
            out = stage(spark, df, sf)
            assert out.columns == df.columns
            rows = out.collect()
            if name in ("line_dedup", "pii"):
                assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(r["doc_id"]) for r in df.collect())
            if name == "near_dedup" and df.columns and rows:
                assert sorted(str(r["doc_id"]) for r in rows) == ["1", "3", "4", "5", "6", "None"]
        packed = p.STAGES[-1][1](spark, df, sf).collect()
        assert {str(r["doc_id"]) for r in packed} == {str(r["doc_id"]) for r in df.collect()}

"""Loose bins of many shards are pooled: nothing is lost, nothing conflicts, and no more bins than before."""

import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from pelagos.llm import packing

CAPACITY = 512


def _bins(rows):
    bins = defaultdict(list)
    for r in rows:
        bins[(r["shard"], r["bin"])].append(r)
    for pieces in bins.values():
        assert sum(p["length"] for p in pieces) + pieces[0]["residual"] == CAPACITY and pieces[0]["residual"] >= 0
        assert len({p["residual"] for p in pieces}) == 1 and sorted(p["slot"] for p in pieces) == list(range(len(pieces)))
    return bins


def _room(bins):
    return sum(p[0]["residual"] for p in bins.values())


@pytest.mark.parametrize("pieces", [16, 50])
def test_pools_save_room(spark, docs, monkeypatch, pieces):
    many = docs.unionByName(docs.withColumn("doc_id", F.col("doc_id") + 10**6).withColumn("text", F.concat(F.col("text"), F.lit(" twice")))).select("doc_id", "text", "source")
    whole = _bins(packing.best_fit(many, CAPACITY).collect())
    monkeypatch.setattr(packing, "SHARD_PIECES", pieces)
    pooled = packing.best_fit(many, CAPACITY).collect()
    with monkeypatch.context() as m:
        m.setattr(packing, "_pooled", lambda placed, *_: placed)
        apart = _bins(packing.best_fit(many, CAPACITY).collect())
    bins = _bins(pooled)
    assert len(whole) <= len(bins) < len(apart) and _room(bins) < _room(apart)
    words, source, text = {}, {}, {}
    for r in many.collect():
        words[r["doc_id"]], source[r["doc_id"]], text[r["doc_id"]] = len(re.findall(r"[^ \t-\r]+", r["text"] or "")), r["source"], r["text"]
    total, spans = Counter(), defaultdict(list)
    for r in pooled:
        total[r["doc_id"]] += r["length"]
        spans[r["doc_id"]].append((r["start"], r["length"], r["piece"]))
    assert dict(total) == words
    for parts in spans.values():  # the pieces of a document follow each other
        parts.sort()
        assert [p[2] for p in parts] == list(range(len(parts))) and all(a[0] + a[1] == b[0] for a, b in zip(parts, parts[1:]))
    for held in bins.values():
        ids = [p["doc_id"] for p in held]
        assert len({source[i] for i in ids if source[i]}) == sum(source[i] is not None for i in ids) and len({text[i] for i in ids}) == len(ids)


def test_one_source_cannot_be_pooled(spark, monkeypatch):
    # every bin holds one document, all of them loose: pools would not get fewer, so that the rounds end
    monkeypatch.setattr(packing, "SHARD_PIECES", 8)
    rows = [(None if k % 9 == 0 else k % 50, f"one two {k % 40}", "same") for k in range(100)] + [(7, None, None), (None, "", None)]
    got = packing.best_fit(spark.createDataFrame(rows, "doc_id long, text string, source string"), CAPACITY).collect()
    assert len(got) == 102 and len(_bins(got)) >= 100 and sum(r["doc_id"] is None for r in got) == 13

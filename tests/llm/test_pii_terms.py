"""Revealing terms planted into documents: how many are found, and how many that reveal nothing."""

import random
import re

import pytest
from pyspark.sql import functions as F

from pelagos.llm import pii


@pytest.fixture(scope="module")
def planted(spark, docs):
    """Documents with words put in: ten that tell of a domain, ten that stand anywhere, five that go with a domain in three of ten cases."""
    rng = random.Random(7)
    texts = [r["text"] or "" for r in docs.orderBy("doc_id").select("text").collect()]
    rows = [(k, re.sub(r"[^\w\s]", " ", t)) for k, t in enumerate(texts)]
    telling, plain, weak = ([f"{name}{c}ulo" for c in "abcdefghij"] for name in ("quex", "brov", "zilm"))
    weak = weak[:5]

    def put(k, words):
        parts = rows[k][1].split()
        for w in words:
            parts.insert(rng.randrange(len(parts) + 1), w)
        rows[k] = (k, " ".join(parts))

    free = list(range(len(rows)))
    rng.shuffle(free)
    alone = {}
    for n, w in enumerate(telling):
        for m in range(9):
            put(free.pop(), [w, f"person{n}x{m}@firm{n}.example"])
        alone[w] = free.pop()  # once without the address
        put(alone[w], [w.capitalize()])
    for w in plain:
        for k in rng.sample(range(len(rows)), 12):
            put(k, [w])
    for n, w in enumerate(weak):
        for m in range(10):
            put(free.pop(), [w, *([f"someone{m}@shop{n}.example"] if m < 3 else [])])
    return spark.createDataFrame(rows, "doc_id long, text string"), set(telling), set(plain) | set(weak), alone


def test_planted_terms(planted):
    df, telling, others, alone = planted
    found = pii.find_private(df, everywhere=True).select("doc_id", F.expr("transform(terms, t -> t.value)").alias("got")).collect()
    got = {v for r in found for v in r["got"]}
    assert got >= telling and not got & others
    # nothing else either: what the documents hold by themselves reveals nothing
    assert len(got & telling) / len(got) >= 0.9, got - telling
    # all documents that hold a telling word lose it, the one without an address too
    holds = {r["doc_id"]: {w for w in re.findall(r"\w{3,}", r["text"].lower())} & telling for r in df.collect()}
    assert {r["doc_id"]: set(r["got"]) & telling for r in found} == holds
    assert all(w in holds[k] for w, k in alone.items())


def test_terms_stay_where_the_entity_is_not(planted):
    df, telling, _, alone = planted
    found = {r["doc_id"]: r["terms"] for r in pii.find_private(df).collect()}
    assert all(found[k] == [] for k in alone.values())
    assert {s["value"] for t in found.values() for s in t} >= telling


def test_common_entities_ask_for_more_evidence(spark):
    # a third of all rows hold the domain: a word that is met there three times by chance tells nothing, one met 40 times does
    rows = [(k, f"line {k}q {'rarely ' if k < 9 and k % 3 == 0 else ''}{'often ' if k % 3 == 0 and k < 120 else ''}x{k}y " + (f"p{k}@common.example" if k % 3 == 0 else "")) for k in range(300)]
    found = pii.find_private(spark.createDataFrame(rows, "doc_id long, text string"), everywhere=True).collect()
    assert {s["value"] for r in found for s in r["terms"]} == {"often"}


def test_share_bounds_grow_with_evidence(spark):
    got = spark.range(1).select(*(pii._surely(F.lit(p), F.lit(n)).alias(f"c{k}") for k, (p, n) in enumerate([(1.0, 3), (1.0, 30), (0.5, 3), (0.5, 3000)]))).first()
    assert 0.52 < got[0] < 0.53 and 0.91 < got[1] < 0.92 and got[2] < 0.3 and 0.48 < got[3] < 0.5


def test_repeated_texts_and_extra_columns(spark):
    rows = [(k % 4 if k % 5 else None, f"about zarquon {'abcdefghij'[k % 6]}bc mail m{k % 6}@one.example end", k) for k in range(60)] + [(900 + k, f"else {k}", k) for k in range(200)] + [(None, None, 1), (7, "", 2), (8, "zarquon", 3), (8, "zarquon", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, key long").withColumn("Mine", F.lit(1)).withColumn("a.b", F.lit(2))
    got = pii.find_private(df, everywhere=True)
    assert got.columns == [*df.columns, "base", "terms"] and got.count() == df.count()
    assert got.filter("array_contains(transform(terms, t -> t.value), 'zarquon')").count() == 62

"""Toxicity that only a whole text tells."""

import numpy as np
from pyspark.sql import functions as F

from pelagos.llm import queries, toxicity


def test_stem_that_toxic_texts_repeat(spark):
    """A stem that a clean text may hold once, and a toxic one holds several times, each time with another ending."""
    rng = np.random.default_rng(4)
    word = lambda: "".join(rng.choice(list("aeioustrmd"), 5))

    def text(times):
        return " ".join(rng.permutation([word() for _ in range(20)] + [f"bolgent{word()}" for _ in range(times)]))

    rows = [(k, text(4), 1) if k < 60 else (k, text(k % 2), 0) for k in range(240)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"))
    fresh = spark.createDataFrame([(times, text(times)) for times in (0, 1, 4) for _ in range(20)], "times int, text string")
    share = {r["times"]: r["share"] for r in toxicity.score_toxicity(fresh, model).groupBy("times").agg(F.avg("predicted").alias("share")).collect()}
    assert share[4] > 0.9 and share[0] < 0.1 and share[1] < 0.1


def test_toxicity_recall_by_language(spark):
    """Most held-out toxic texts are found in each language, not just those with an English insult."""
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet").filter("toxic = 1").select("doc_id")
    lang = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    got = queries.op8_toxicity(spark, sf).filter("held_out").join(labels, "doc_id").join(lang, "doc_id").groupBy("lang").agg(F.avg("predicted").alias("recall")).collect()
    assert {r["lang"] for r in got} == {"en", "fr", "de", "es"} and min(r["recall"] for r in got) >= 0.5

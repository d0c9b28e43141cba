"""A corpus pipeline of five stages: each takes what the one before kept, written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pelagos.llm import line_dedup, minhash_dedup, packing, pii, toxicity
from pelagos.llm.queries import training_labels
from pelagos.llm.tables import read, text_of, written


def _counted(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of documents, n_chars anew where the text may have changed."""
    if "n_chars" in columns:
        docs = docs.withColumn("n_chars", F.length(text_of()).cast("long"))
    return docs.select(*columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the classifier rejects."""
    model = toxicity.train(docs.select("doc_id", "text"), training_labels(spark, sf_dir))
    return toxicity.score_toxicity(docs, model).filter("predicted = 0").select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without long lines that many documents share, but in the last of them."""
    return _counted(line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs)), docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: that of the smallest doc_id. Of rows that repeat a doc_id one stays."""
    others = minhash_dedup.near_duplicates(docs).filter("doc_id <> class_id").select("doc_id")
    kept = docs.join(others, "doc_id", "left_anti")
    return kept.filter("doc_id IS NULL").unionByName(kept.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"])).select(*docs.columns)


def hide_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data, and terms that give it away, generalised to their kinds."""
    return _counted(pii.sanitise(pii.find_private(docs, everywhere=True)), docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept documents' pieces in bins of 2048 words."""
    return packing.best_fit(docs)


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_lines), ("near_dedup", drop_near_copies), ("pii", hide_private), ("packing", pack)]

#: Stages one, three and five have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

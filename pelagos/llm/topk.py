"""Exact top-k search: tiled integer matrix products, partial selection per tile, tree merging of per-query lists.

Vectors are dealt by a hash of their id into shards, queries into blocks; each is packed into one matrix a row. A tile is
one block against one shard: a matrix product and a partial selection of k (with the ties' order kept exact) a query.
The lists of a query are merged in two levels, first over groups of shards.

A component x counts as floor(scale * x). Products run in float64 where all sums stay below 2**53, else in Python integers.

Defined cases: vectors that are null, empty, or hold null or non-finite components take no part; vectors of unlike
length do not meet; rows that repeat a vec_id are candidates each, but never of a query with that id; of query rows that
repeat both id and vector one is asked, those that repeat the id alone get a list each; ties go to the smaller id; a query
with fewer than k candidates gets all of them; with none, it has no rows. floor(scale * x) and scores beyond 64 bits are
held at the largest number of that sign.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHARD_ROWS, BLOCK_ROWS, GROUP = 8192, 1024, 16


def _packed(rows: DataFrame, parts: int) -> DataFrame:
    """(dim, part, ids, keys, values): the vectors of a part, ids ascending, as one row-major matrix of int64; keys tell vectors apart."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = pdf["id"].to_numpy(np.int64)
        order = np.argsort(ids, kind="stable")
        values = np.stack(pdf["v"].to_numpy())[order].astype(np.int64)
        return pd.DataFrame({"dim": [values.shape[1]], "part": [pdf["part"].iloc[0]], "ids": [ids[order].tobytes()], "keys": [pdf["key"].to_numpy(np.int64)[order].tobytes()], "values": [values.tobytes()]})

    dealt = rows.withColumn("key", F.xxhash64("v")).withColumn("part", F.pmod(F.xxhash64("id", "v"), F.lit(parts)).cast("int"))
    return dealt.groupBy("dim", "part").applyInPandas(pack, "dim int, part int, ids binary, keys binary, values binary")


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    # as floats: the lowest 64-bit number has no absolute value among whole ones
    most = float(np.abs(a.astype(np.float64)).max(initial=0)) * float(np.abs(b.astype(np.float64)).max(initial=0)) * a.shape[1]
    if most < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return np.clip(a.astype(object) @ b.astype(object).T, -(2**63) + 1, 2**63 - 1).astype(np.int64)


def best_of_tile(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, values: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of the query, id, score) of the k best a query, ties to the smaller id; ids must be ascending."""
    score = _product(queries, values)
    own = query_ids[:, None] == ids[None, :]
    score[own] = np.iinfo(np.int64).min
    n = min(k, score.shape[1])
    floor = np.partition(score, score.shape[1] - n, axis=1)[:, score.shape[1] - n]
    row, col = np.nonzero((score >= floor[:, None]) & ~own)
    order = np.lexsort((ids[col], -score[row, col], row))
    row, col = row[order], col[order]
    start = np.flatnonzero(np.r_[np.ones(min(1, len(row)), bool), row[1:] != row[:-1]])
    rank = np.arange(len(row)) - np.repeat(start, np.diff(np.r_[start, len(row)]))
    row, col = row[rank < k], col[rank < k]
    return row, ids[col], score[row, col]


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best candidates of each query row, over all other rows."""
    x = F.col(embedding).cast("array<double>")
    usable = F.col(embedding).isNotNull() & (F.size(embedding) > 0) & F.forall(embedding, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    rows = vectors.filter(usable & F.col(vec_id).isNotNull()).select(F.col(vec_id).cast("long").alias("id"), F.size(embedding).alias("dim"), F.transform(x, lambda c: F.floor(c * F.lit(float(scale)))).alias("v"), is_query.alias("q"))
    n, queries = rows.agg(F.count("*"), F.count_if("q")).first()
    shards, blocks = max(1, -(-n // SHARD_ROWS)), max(1, -(-queries // BLOCK_ROWS))
    tiles = (
        _packed(rows.filter("q").select("id", "dim", "v").dropDuplicates(["id", "v"]), blocks)
        .select("dim", F.col("ids").alias("query_ids"), F.col("keys").alias("query_keys"), F.col("values").alias("queries"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("part"))
        .hint("shuffle_hash")
        .join(_packed(rows.select("id", "dim", "v"), shards).drop("keys"), ["dim", "part"])
    )

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for t in pdf.itertuples(index=False):
                of = lambda raw, d=t.dim: np.frombuffer(raw, np.int64).reshape(-1, d)
                ids = np.frombuffer(t.query_ids, np.int64)
                q, c, s = best_of_tile(ids, of(t.queries), np.frombuffer(t.ids, np.int64), of(t.values), k)
                yield pd.DataFrame({"query_id": ids[q], "query_key": np.frombuffer(t.query_keys, np.int64)[q], "vec_id": c, "score": s, "grp": t.part // GROUP})

    lists = tiles.mapInPandas(search, "query_id long, query_key long, vec_id long, score long, grp int")
    best = [F.col("score").desc(), F.col("vec_id")]
    for by in (["query_id", "query_key", "grp"], ["query_id", "query_key"]):  # a tree of two levels
        lists = lists.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*best))).filter(F.col("rank") <= k)
    return lists.select("query_id", "rank", "vec_id", "score")

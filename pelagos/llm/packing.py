"""Best-fit packing under conflicts: pieces of documents into bins of a fixed capacity.

Longest pieces first, each goes to the bin with the least room left that holds it and does not conflict: a bin holds no
two pieces of one source, and none of one duplicate cluster. Bins carry both sets as bitmaps over the sources and
clusters of their shard. Open bins are kept by residual; the search steps from the smallest residual that fits to the
next (successor) until a compatible bin turns up, else a new bin opens.

Documents are dealt to shards by a hash, so many that a shard has about SHARD_PIECES pieces however large the input is
and whatever source most rows have; each shard is packed on its own. What this leaves loose, bins with a LOOSE-th of their
room or more, is pooled: the loose bins of many shards, about SHARD_PIECES pieces together, are packed anew, and the new bins
are taken if they are fewer. What is still loose is pooled with that of other pools, in rounds, until one pool holds all of
it or pools don't get fewer. A text longer than the capacity is cut into full pieces and a rest: full pieces are bins of
their own.

Defined cases: a null or empty text has length 0 and takes a place without room; null sources conflict with nothing;
equal texts are one cluster where no cluster column is named; a null cluster conflicts with nothing; repeated rows are
packed each; an empty table gives no bins.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pelagos.llm.tables import text_of, written

SHARD_PIECES, LOOSE = 4096, 8
PACKED = ["doc_id", "piece", "shard", "bin", "slot", "start", "length", "residual"]
#: No nulls among the numbers: pandas would make floats of them, which don't hold large ids.
_PLACED = "named boolean, doc_id long, piece int, shard long, bin int, slot int, start long, length long, residual long, source string, cluster string"


class Residuals:
    """Open bins by residual, with a bitmap of the residuals that any bin has."""

    def __init__(self):
        self.bins: dict[int, dict[int, list[int]]] = {}  # residual -> source bitmap -> bins
        self.present = 0

    def add(self, residual: int, sources: int, bin_: int) -> None:
        self.bins.setdefault(residual, {}).setdefault(sources, []).append(bin_)
        self.present |= 1 << residual

    def take(self, length: int, source: int, cluster: int, clusters: list[int]) -> tuple[int, int, int] | None:
        """The tightest compatible bin, taken out: (residual, sources, bin)."""
        rest = self.present >> length
        residual = length
        while rest:
            step = (rest & -rest).bit_length() - 1
            residual += step
            groups = self.bins[residual]
            for sources in groups:
                if sources & source:
                    continue
                for at, bin_ in enumerate(groups[sources]):
                    if not clusters[bin_] & cluster:
                        groups[sources].pop(at)
                        if not groups[sources]:
                            del groups[sources]
                        if not groups:
                            del self.bins[residual]
                            self.present &= ~(1 << residual)
                        return residual, sources, bin_
            rest >>= step + 1
            residual += 1
        return None


def pack(pieces: list[tuple[int, int, int]], capacity: int) -> list[tuple[int, int, int]]:
    """(bin, slot, room used before it) of each (length, source bit, cluster bit), which must come longest first."""
    open_, clusters, filled, slots, out = Residuals(), [], [], [], []
    for length, source, cluster in pieces:
        found = open_.take(length, source, cluster, clusters)
        if found is None:
            residual, sources, bin_ = capacity, 0, len(clusters)
            clusters.append(0)
            filled.append(0)
            slots.append(0)
        else:
            residual, sources, bin_ = found
        out.append((bin_, slots[bin_], filled[bin_]))
        clusters[bin_] |= cluster
        filled[bin_] += length
        slots[bin_] += 1
        open_.add(residual - length, sources | source, bin_)
    return out


def n_words(text: str = "text") -> Column:
    """How many words a text has."""
    return F.regexp_count(text_of(text), F.lit(r"[^ \t-\r]+")).cast("long")


def _bits(pdf: pd.DataFrame) -> tuple[pd.Series, pd.Series]:
    """Bits of sources, and of the clusters that more than one row has."""
    source = {s: 1 << k for k, s in enumerate(pd.unique(pdf["source"].dropna()))}
    cluster = {c: 1 << k for k, c in enumerate(pdf.loc[pdf["cluster"].duplicated() & pdf["cluster"].notna(), "cluster"].unique())}
    bits = lambda names, of: pd.Series([of.get(x, 0) for x in names], index=names.index, dtype=object)
    return bits(pdf["source"], source), bits(pdf["cluster"], cluster)


def _placed(pieces: pd.DataFrame, shard: int, first: int, capacity: int) -> pd.DataFrame:
    """pieces in bins of their own, numbered from `first` on."""
    pieces = pieces.sort_values(["length", "named", "doc_id", "piece", "cluster", "source"], ascending=[False, True, True, True, True, True], kind="stable")
    source, cluster = _bits(pieces)
    found = pack(list(zip(pieces["length"].tolist(), source, cluster)), capacity)
    pieces = pieces.assign(shard=shard, bin=[first + b for b, _, _ in found], slot=[k for _, k, _ in found])
    return pieces.assign(residual=capacity - pieces.groupby("bin")["length"].transform("sum"))


def best_fit(docs: DataFrame, capacity: int = 2048, length: Column | None = None, cluster: Column | None = None, doc_id: str = "doc_id", text: str = "text", source: str = "source", deal: Column | None = None) -> DataFrame:
    """One row a piece: where it lies in its document (piece, start, length) and its bin (shard, bin, slot, residual of the bin at the end).

    Lengths are the text's words unless a column tells them; equal texts are one cluster unless a column names clusters;
    documents are dealt to shards by `deal`, a number, else by a hash of id and text. With all three no text is read.
    """
    size = n_words(text) if length is None else F.coalesce(length.cast("long"), F.lit(0))
    same = F.xxhash64(text_of(text)) if cluster is None else F.when(cluster.isNotNull(), F.xxhash64(cluster))
    shards = max(1, -(-docs.count() // SHARD_PIECES))
    named = F.col(doc_id).cast("long")
    rows = docs.select(F.coalesce(named, F.lit(0)).alias("doc_id"), named.isNotNull().alias("named"), size.alias("size"), F.col(source).cast("string").alias("source"), same.cast("string").alias("cluster"), F.pmod(F.xxhash64(F.col(doc_id), text_of(text)) if deal is None else deal, F.lit(shards)).alias("shard"))
    order = [c.split()[0] for c in _PLACED.split(", ")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        shard, full = pdf["shard"].iloc[0], pdf["size"] // capacity
        made = pdf.loc[pdf.index.repeat(full)].sort_values(["named", "doc_id", "size", "cluster", "source"], kind="stable")
        piece = made.groupby(level=0).cumcount()
        made = made.assign(piece=piece, start=piece * capacity, length=capacity, bin=range(len(made)), slot=0, residual=0)
        rest = pdf["size"] % capacity
        rests = pdf.assign(piece=full, start=full * capacity, length=rest)[(rest > 0) | (full == 0)]
        return pd.concat([made[order], _placed(rests, shard, len(made), capacity)[order]])

    placed = rows.groupBy("shard").applyInPandas(run, _PLACED)
    if shards > 1:
        placed = _pooled(placed, capacity, shards, order)
    return placed.select(F.when(F.col("named"), F.col("doc_id")).alias("doc_id"), *PACKED[1:])


def _again(capacity: int, first: int, order: list[str]):
    """Packs a pool of bins anew; keeps the old bins if the new ones aren't fewer."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        new = _placed(pdf, first + pdf["pool"].iloc[0], 0, capacity)
        return (new if new["bin"].nunique() < len(pdf[["shard", "bin"]].drop_duplicates()) else pdf)[order]

    return run


def _pooled(placed: DataFrame, capacity: int, shards: int, order: list[str]) -> DataFrame:
    """placed with the loose bins of many shards packed anew, in rounds; what a pool makes is a shard with a number of its own."""
    parts, pools, level = [], shards, 0
    loose = F.col("residual") * LOOSE >= capacity
    placed = written(placed, "packed")
    while True:
        count, held = placed.filter(loose).agg(F.count("*"), F.count_distinct("shard")).first()
        fewer = max(1, -(-count // SHARD_PIECES))
        if held < 2 or fewer >= pools:
            return reduce(DataFrame.unionByName, [*parts, placed])
        pools, level = fewer, level + 1
        parts.append(placed.filter(~loose))
        # a shard's loose bins stay together, so that old bins and new ones can be counted
        placed = written(placed.filter(loose).withColumn("pool", F.pmod(F.xxhash64("shard"), F.lit(pools))).groupBy("pool").applyInPandas(_again(capacity, shards * level, order), _PLACED), "packed")

"""A Merkle manifest of a dataset: a tree of digests a group, a tree over the groups' roots, and each row's proof.

Rows get their places in their group by a range sort: a range counts its rows of each group, and the counts of the ranges
before it give where it begins, so that a group of any size is spread over all tasks. Levels are made by windows: a window
over (group, parent) in order of place collects all nodes of a run, which are both the parent's preimage and each other's
siblings; the first row of each run goes on as the parent. LEVELS levels share one partitioning, by group and block of
2**LEVELS places, so a shuffle serves LEVELS of them; rows that have met in a block leave it with the siblings they saw,
and meet those of the block's own node again by one join.

Digests are lowercase hex of sha256, inputs concatenated, digests as hex text. A run is two nodes, the last maybe one,
which is hashed alone; a lone node is its tree's root. Siblings travel as binary(32), null where a run has one node only.

Defined cases: null ids come first; rows that repeat an id stand in order of their leaf; the null group is a group and
the first; an empty table gives no rows; other columns are not returned, so no name can clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pelagos.llm.tables import written

#: Levels between shuffles: a block holds up to 2**LEVELS rows with as many siblings each.
LEVELS = 8


def preimage(*values: Column) -> Column:
    """All values as one text: `-` for null, else the UTF-8 byte count, `:` and the value (integers decimal)."""
    texts = [v.cast("string") for v in values]
    return F.concat(*[F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts])


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _hex(node: Column) -> Column:
    return F.coalesce(F.lower(F.hex(node)), F.lit(""))


def placed(rows: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """rows with `place`, from 0 in their group by `order`, and `n`, the group's rows. Written as Parquet."""
    ranged = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order).withColumn("_at", F.monotonically_increasing_id()).withColumn("_range", F.spark_partition_id())
    kept = written(ranged, name)
    counts = kept.groupBy(group, "_range").agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    whole = Window.partitionBy(group)
    bases = counts.select(
        group, "_range", "_first", (F.sum("_rows").over(whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_rows")).alias("_base"), F.sum("_rows").over(whole).alias("n")
    )
    return kept.join(bases, [group, "_range"]).withColumn("place", F.col("_at") - F.col("_first") + F.col("_base")).drop("_at", "_range", "_first", "_base")


def _block(nodes: DataFrame, start: int, levels: int) -> DataFrame:
    """Levels start + 1 to start + levels of (g, n, at, node): one row for each node of the last, with the siblings that those below it met.

    -> (g, n, at, node, met array<struct<at, path>>): at is the place in the new level, met the places in the old one.
    """
    rows = nodes.withColumn("block", F.shiftright("at", levels)).withColumn("low", F.col("at")).withColumn("met", F.array(F.struct(F.col("at").alias("at"), F.array().cast("array<binary>").alias("path"))))
    rows = rows.repartition("g", "block")
    for level in range(start, start + levels):
        parent = rows.withColumn("parent", F.shiftright("low", 1))
        run = Window.partitionBy("g", "block", "parent").orderBy("low").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        seen = parent.withColumn("run", F.collect_list(F.struct("node", "met")).over(run))
        # the group's tree is taller than this level if its nodes of this level are many
        grows = F.col("n") > F.lit(1 << level)
        sibling = lambda i: F.when(F.size("run") > 1, F.unhex(F.get("run", 1 - i)["node"]))
        told = F.flatten(F.transform("run", lambda child, i: F.transform(child["met"], lambda m: F.struct(m["at"].alias("at"), F.concat(m["path"], F.array(sibling(i))).alias("path")))))
        rows = seen.filter((F.col("low") % 2) == 0).select(
            "g", "n", "at", "block", F.col("parent").alias("low"), F.when(grows, digest(F.array_join(F.transform("run", lambda c: c["node"]), ""))).otherwise(F.col("node")).alias("node"), F.when(grows, told).otherwise(F.col("met")).alias("met")
        )
    return rows.select("g", "n", F.col("block").alias("at"), "node", "met")


def trees(leaves: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Of (g, n, place, node): (g, place, path) with each node's siblings from its own level upwards, and (g, root).

    One job for each LEVELS levels of the tallest tree; upper ones are smaller by 2**LEVELS each.
    """
    tallest = leaves.agg(F.max("n")).first()[0] or 1
    nodes, start, layers = leaves.select("g", "n", F.col("place").alias("at"), "node"), 0, []
    height = (tallest - 1).bit_length()
    while start < height or not layers:
        levels = min(LEVELS, height - start)
        layer = written(_block(nodes, start, levels), f"{name}-{start}")
        layers.append(layer)
        nodes, start = layer.select("g", "n", "at", "node"), start + levels
    paths = None
    for layer in reversed(layers):
        own = layer.select("g", F.col("at").alias("_up"), F.explode("met").alias("m")).select("g", "_up", F.col("m.at").alias("at"), F.col("m.path").alias("path"))
        if paths is not None:
            above = paths.select("g", F.col("at").alias("_up"), F.col("path").alias("_more"))
            own = own.join(above, ["g", "_up"]).withColumn("path", F.concat("path", "_more"))
        paths = own.select("g", "at", "path")
    return paths.withColumnRenamed("at", "place"), nodes.select("g", F.col("node").alias("root"))


def fold(node: Column, place: Column, path: Column) -> Column:
    """The root that a node gives with the siblings of its path: a bit of the place tells on which side it stands."""
    up = F.aggregate(
        path,
        F.struct(node.alias("node"), place.alias("at")),
        lambda acc, s: F.struct(
            digest(F.when(acc["at"] % 2 == 1, F.concat(_hex(s), acc["node"])).otherwise(F.concat(acc["node"], _hex(s)))).alias("node"),
            F.shiftright(acc["at"], 1).alias("at"),
        ),
    )
    return up["node"]


def manifest(rows: DataFrame, group: str, order: str, leaf: Column, tampered: Column, name: str = "merkle") -> DataFrame:
    """(order, leaf, subroot, root, proof_sha256, folded_root, verified) of each row: folded_root is made from `tampered`, a leaf (null: the row's own), and the siblings."""
    # a text that sorts the null group first, and the others by their bytes
    base = rows.select(F.concat(F.lit("+"), F.col(group).cast("string")).alias("g"), F.col(order).alias("id"), leaf.alias("node"), tampered.alias("other")).fillna({"g": ""})
    leaves = placed(base, "g", ["id", "node"], f"{name}-leaves")
    paths, subroots = trees(leaves, f"{name}-tree")
    subroots = written(subroots, f"{name}-subroots")
    tops = placed(subroots.select(F.lit(0).alias("one"), F.col("g").alias("of"), F.col("root").alias("node")), "one", ["of"], f"{name}-tops").withColumnRenamed("one", "g")
    above, root = trees(tops.select("g", "n", "place", "node"), f"{name}-top")
    known = tops.select(F.col("of").alias("g"), F.col("place").alias("top"), F.col("node").alias("subroot"), F.lit(0).alias("one")).join(above.select(F.col("g").alias("one"), F.col("place").alias("top"), F.col("path").alias("over")), ["one", "top"])
    known = known.join(root.select(F.col("g").alias("one"), "root"), "one").drop("one")
    whole = leaves.join(paths, ["g", "place"]).join(known, "g")
    folded = fold(fold(F.coalesce("other", "node"), F.col("place"), F.col("path")), F.col("top"), F.col("over"))
    proof = digest(F.concat_ws("", F.transform(F.concat("path", "over"), _hex)))
    return whole.select(F.col("id").alias(order), F.col("node").alias("leaf"), "subroot", "root", proof.alias("proof_sha256"), folded.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))

"""Line dedup: hashes of lines, range-partitioned and sorted, give each document a compressed bitmap of kept lines.

The rows (hash, document, position) are range-partitioned by hash and document and sorted within partitions, largest
document first, so that the first occurrence of a hash leads its run. One pass over a partition decides each run that
lies inside it. A run that touches a partition's edge may go on next door, as a line that a third of all documents hold
does: its rows are passed on as they come, counted with partial aggregates and joined with those counts; so are those of
runs of over LONG rows, so that no more than these are ever held. There are few such hashes a partition, two and one for
each LONG rows, so the counts are small enough to broadcast at any size of input.

A key is a line, stripped of blanks at both ends and lower-cased (A-Z); only keys of `min_chars` code points or more
take part. A key found in `min_docs` documents or more loses all its lines but those of the largest doc_id.

Defined cases: a null or empty text is one empty line; rows without a doc_id count as no document and keep all their lines;
rows that repeat a doc_id count as one document, and each keeps its own lines; an empty table gives an empty table; columns
other than doc_id and the text are left alone, whatever their names, but for n_lines and n_dropped, which raise ValueError.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pelagos.llm.tables import free, free_of, text_of, written

BLANKS = " \t\n\x0b\x0c\r"
#: Rows of a run that are held to be decided at once; rows of documents for each range.
LONG, DOCS_PER_RANGE = 65_536, 100_000
LINES = "h1 long, h2 long, doc_id long, row_hash long, pos int"


def _with_row(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, whole text and a hash of it, which tells rows of one doc_id apart."""
    whole = text_of(text)
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), whole.alias("text"), F.xxhash64(whole).alias("row_hash"))


def line_hashes(docs: DataFrame, min_chars: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(h1, h2, doc_id, row_hash, pos) of each line whose key is long enough; h1 and h2 are 128 bits of the key's hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, len(batch), 512):
                part = batch.slice(k, 512)
                lines = pc.split_pattern(part.column(1), "\n")
                size = np.array(lines.value_lengths(), np.int64)
                pos = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                row = np.repeat(np.arange(len(size)), size)
                keys = pc.ascii_lower(pc.utf8_trim(lines.flatten(), BLANKS))
                long = np.flatnonzero(np.array(pc.utf8_length(keys)) >= min_chars)
                digest = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys.take(pa.array(long)).to_pylist())), ">i8").reshape(-1, 2).astype(np.int64)
                of = pa.array(row[long])
                yield pa.RecordBatch.from_arrays([pa.array(digest[:, 0]), pa.array(digest[:, 1]), part.column(0).take(of), part.column(2).take(of), pa.array(pos[long].astype(np.int32))], names=["h1", "h2", "doc_id", "row_hash", "pos"])

    return _with_row(docs, doc_id, text).filter("doc_id IS NOT NULL").mapInArrow(run, LINES)


def _runs(min_docs: int):
    """Passes once over a sorted partition: yields rows to drop, and (edge) all rows of long runs and of those at its two edges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held, rows, passing = None, [], 0, True  # passing: the run that is open goes on as edge rows
        for batch in batches:
            if not len(batch):
                continue
            start = _starts(batch, last)
            last = (batch.column("h1")[-1], batch.column("h2")[-1])
            head = batch.slice(0, start[0]) if len(start) else batch
            if passing:
                yield from _marked(head, True)
            elif len(head):
                held, rows = [*held, head], rows + len(head)
            if len(start):
                if held:
                    table = pa.Table.from_batches(held).combine_chunks()
                    yield from _decided(table, np.zeros(1, np.int64), min_docs)
                yield from _decided(pa.Table.from_batches([batch.slice(start[0], start[-1] - start[0])]), start[:-1] - start[0], min_docs)
                tail = batch.slice(start[-1])
                held, rows, passing = [tail], len(tail), False
            if rows > LONG:
                for part in held:
                    yield from _marked(part, True)
                held, rows, passing = [], 0, True
        for part in held:
            yield from _marked(part, True)

    return run


def _starts(batch: pa.RecordBatch, last: tuple | None) -> np.ndarray:
    """Where runs begin; the first row of a partition begins none, since its run may have begun before."""
    h1, h2 = np.array(batch.column("h1")), np.array(batch.column("h2"))
    first = last is not None and (h1[0] != last[0].as_py() or h2[0] != last[1].as_py())
    return np.flatnonzero(np.r_[first, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])])


def _decided(table: pa.Table, start: np.ndarray, min_docs: int) -> Iterator[pa.RecordBatch]:
    """The first row of each run is of the largest document; in runs of enough documents the others' rows go."""
    if not len(start):
        return
    doc = np.array(table.column("doc_id"))
    length = np.diff(np.r_[start, len(doc)])
    other = np.r_[True, doc[1:] != doc[:-1]]
    other[start] = True
    docs = np.add.reduceat(other.astype(np.int64), start)
    out = np.repeat(docs >= min_docs, length) & (doc != np.repeat(doc[start], length))
    yield from _marked(table.filter(pa.array(out)), False)


def _marked(table: pa.Table | pa.RecordBatch, edge: bool) -> Iterator[pa.RecordBatch]:
    for batch in table.to_batches() if isinstance(table, pa.Table) else [table]:
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(batch), edge))], names=[*batch.schema.names, "edge"])


def keep_bitmaps(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, doc_id: str = "doc_id", text: str = "text", partitions: int | None = None) -> DataFrame:
    """(doc_id, row_hash, n_dropped, drops): documents that lose lines, and a compressed bitmap with 0 for each line that goes.

    The bitmap's bits are in line order, lowest bit first; lines beyond its end stay.
    """
    spark = docs.sparkSession
    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-docs.count() // DOCS_PER_RANGE))
    lines = line_hashes(docs, min_chars, doc_id, text)
    order = [F.col("h1"), F.col("h2"), F.col("doc_id").desc(), F.col("row_hash"), F.col("pos")]
    sorted_ = lines.repartitionByRange(n, *order[:3]).sortWithinPartitions(*order)
    out = written(sorted_.mapInArrow(_runs(min_docs), f"{LINES}, edge boolean"), "line-runs")
    edges = out.filter("edge")
    # few hashes a partition: small at any size
    counts = edges.groupBy("h1", "h2", "doc_id").agg(F.lit(1).alias("one")).groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("keeper"))
    late = edges.join(F.broadcast(counts.filter(F.col("n_docs") >= min_docs)), ["h1", "h2"]).filter("doc_id <> keeper")
    drops = out.filter("NOT edge").select("doc_id", "row_hash", "pos").unionByName(late.select("doc_id", "row_hash", "pos"))
    by_doc = drops.groupBy("doc_id", "row_hash").agg(F.collect_set("pos").alias("lines"))  # bounded by a document's lines

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, maps = [], []
            for x in batch.column("lines"):
                at = np.array(x.values, np.int64)
                bits = np.ones(int(at.max()) // 8 * 8 + 8, bool)
                bits[at] = False
                size.append(len(at))
                maps.append(zlib.compress(np.packbits(bits, bitorder="little").tobytes(), 1))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row_hash"), pa.array(size, pa.int64()), pa.array(maps, pa.binary())], names=["doc_id", "row_hash", "n_dropped", "keep"])

    return by_doc.mapInArrow(pack, "doc_id long, row_hash long, n_dropped long, keep binary")


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with only the kept lines in the text, joined by \\n, and columns n_lines and n_dropped (before: of the same names: error)."""
    free_of(docs, "n_lines", "n_dropped")
    names, where = docs.columns, docs.columns.index(text)
    id_, row, keep_ = (free(names, x) for x in ("map_id", "map_row", "map_keep"))
    maps = bitmaps.select(F.col("doc_id").alias(id_), F.col("row_hash").alias(row), F.col("keep").alias(keep_))
    joined = docs.join(maps, (F.col(doc_id).cast("long") == F.col(id_)) & (F.xxhash64(text_of(text)) == F.col(row)), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, dropped, texts = [], [], []
            for t, keep in zip(batch.column(where), batch.column(len(names))):
                t, keep = t.as_py(), keep.as_py()
                size.append((t or "").count("\n") + 1)
                gone = 0
                if keep is not None:
                    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), bitorder="little")
                    kept = [x for k, x in enumerate(t.split("\n")) if k >= len(bits) or bits[k]]
                    gone, t = size[-1] - len(kept), "\n".join(kept)
                dropped.append(gone)
                texts.append(t)
            cols = [pa.array(texts, pa.string()) if k == where else c for k, c in enumerate(batch.columns[: len(names)])]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(size, pa.int64()), pa.array(dropped, pa.int64())], names=[*names, "n_lines", "n_dropped"])

    schema = [T.StructField(f.name, T.StringType()) if f.name == text else f for f in docs.schema.fields]
    return joined.select(*names, keep_).mapInArrow(run, T.StructType([*schema, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())]))

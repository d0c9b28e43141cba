"""Near-duplicate documents by BagMinHash signatures, banding, and a check of the multiset overlap.

A document is the multiset of its five-word shingles. Each shingle has a Poisson process for each of the intervals
(0, 1], (1, 2], (2, 4], (4, 8] ... of its weight; an interval's points arrive at a rate of its width for each of the
`M` components, and each point belongs to one component and to one unit of the interval, found by halving it. A
document takes the points of the units up to its weight, so that two documents see the same points wherever both have
weight. A component of the signature is its earliest point; two signatures agree in a component with a probability of
the weighted Jaccard similarity. Points later than a limit, under which nearly all components find their earliest
point, are never made; documents for which it was too early are done again with a later one.

Documents of equal multisets are one node. Nodes that share a band of rows are one bucket. In each bucket the members
are checked against pivots: a pivot and the members that match it are linked, and a pivot that has met all others
leaves. Where the sketches, one bit of each component, tell that a pair is far from alike, no multisets are compared. A
bucket is settled as soon as all its members are in one component. So no bucket is turned into all its pairs, yet no
pair of different components stays unchecked; rounds go on until no bucket is left. Each node meets one pivot first, that
with which it shares most buckets; the members of buckets that this leaves unsettled are dealt to buckets anew, by their rarest shingles, since
bands also bring together what shares a frequent passage and is else unlike.

Words are runs of letters, digits and underscores in lower case. Defined cases: a text of fewer than five words is one
shingle; texts without words are near duplicates only if they are equal (null counts as empty); rows without a doc_id
have no row in the result, since nothing could name them there, and link no others; rows that repeat a
doc_id are one document, in the smallest class that any of them belongs to; the class id is the smallest doc_id of the
class; an empty table gives an empty table; columns other than doc_id and the text play no part.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pelagos.llm.tables import drop, text_of, written

#: Of pairs that are alike by 0.8, 2 in 10,000 share no band; of those alike by 0.5, one in four does.
WORDS, BANDS, ROWS = 5, 36, 7
M = BANDS * ROWS
#: One bit of each component, in 64-bit words. Bits of pairs alike by s differ at a rate of (1 - s) / 2, so that over
#: FAR_BITS differ in one of two million pairs that are alike by 0.8.
SKETCH, FAR_BITS = ("s0", "s1", "s2", "s3"), 50
#: Pivots that a bucket gets in the first round, and times more in each round after it: what is still open then is in small
#: components each, and few of these pairs pass the filters.
PIVOTS, MORE = 16, 8
#: Ids that may be broadcast (8 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
_GAP = re.compile(r"\W")
CHUNK_CHARS, CHUNK_DOCS = 500_000, 1000
#: Code points whose words are hashed at once, and letters from which on a word is long.
STEP_CHARS, LONG_WORD = 1 << 19, 500
#: Points that processes take in one step, if each takes more than one.
BLOCK = 20_000
GOLD = np.uint64(0x9E3779B97F4A7C15)
BASE = 0x5851F42D4C957F2D


def _mix(x: np.ndarray) -> np.ndarray:
    y = x >> np.uint64(30)
    y ^= x
    y *= np.uint64(0xBF58476D1CE4E5B9)
    z = y >> np.uint64(27)
    y ^= z
    y *= np.uint64(0x94D049BB133111EB)
    np.right_shift(y, np.uint64(31), out=z)
    y ^= z
    return y


#: Odd factors of a shingle's words.
SALTS = _mix(np.arange(1, WORDS + 1, dtype=np.uint64) * GOLD) | np.uint64(1)


def _times(a: int, b: int) -> np.uint64:
    return np.uint64(a * b & 0xFFFFFFFFFFFFFFFF)


@cache
def _is_word() -> np.ndarray:
    """Which code points are parts of words, as a regular expression has it."""
    return np.fromiter((c.isalnum() or c == "_" for c in map(chr, range(0x110000))), bool, 0x110000)


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of BASE, and of its inverse modulo 2**64."""
    one, base = np.ones(1, np.uint64), np.uint64(BASE)
    inverse = np.uint64(pow(BASE, -1, 2**64))
    return np.cumprod(np.r_[one, np.full(n - 1, base)]), np.cumprod(np.r_[one, np.full(n - 1, inverse)])


def word_hashes(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of each word of a text in lower case.

    A word's letters are digits of a number in base BASE, modulo 2**64; differences of running sums give those of all words at
    once. Long words, of which some would be sure to have the same number, are hashed by themselves.
    """
    starts, hashes, at = [], [], 0
    while at < len(text):
        gap = _GAP.search(text, at + STEP_CHARS) if at + STEP_CHARS < len(text) else None
        part, first = text[at : gap.end() if gap else None], at
        at += len(part)
        code = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)
        edges = np.flatnonzero(np.diff(_is_word()[code], prepend=False, append=False))
        start, end = edges[::2], edges[1::2]
        size = 1 << max(STEP_CHARS.bit_length(), len(code).bit_length())
        up, down = _powers(size) if size <= 2 * STEP_CHARS else _powers.__wrapped__(size)
        total = np.zeros(len(code) + 1, np.uint64)
        np.cumsum((code + np.uint32(1)) * up[: len(code)], out=total[1:])
        found = _mix((total[end] - total[start]) * down[start])
        for k in np.flatnonzero(end - start > LONG_WORD):
            found[k] = xxhash.xxh3_64_intdigest(code[start[k] : end[k]].tobytes())
        starts.append(start + first)
        hashes.append(found)
    return np.concatenate(starts or [np.zeros(0, np.int64)]), np.concatenate(hashes or [np.zeros(0, np.uint64)])


def bags_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle, weight), sorted by text and shingle; shingles have 52 bits."""
    lower = [t.lower() for t in texts]
    at, h = word_hashes("\n".join([*lower, ""]))
    ends = np.searchsorted(at, np.cumsum(np.fromiter(map(len, lower), np.int64, len(lower)) + 1))
    size = np.diff(ends, prepend=0)
    # the sum of five words from each on, mixed; those that begin in the last four of a text don't count
    acc = h * SALTS[0]
    for k in range(1, WORDS):
        acc[:-k] += h[k:] * SALTS[k]
    left = np.repeat(ends, size) - np.arange(len(h))
    held = np.flatnonzero(left >= WORDS)
    text = np.repeat(np.arange(len(lower)), size)[held]
    few = np.flatnonzero((size > 0) & (size < WORDS))
    short = np.zeros(len(few), np.uint64)
    for k in range(WORDS):
        short += np.where(size[few] > k, h[np.minimum((ends - size)[few] + k, len(h) - 1)], np.uint64(k + 1)) * SALTS[k]
    text, acc = np.r_[text, few], _mix(np.r_[acc[held], short])
    key = np.sort(text.astype(np.uint64) << np.uint64(52) | acc >> np.uint64(12))
    start = np.flatnonzero(np.r_[np.ones(min(1, len(key)), bool), key[1:] != key[:-1]])
    weight = np.diff(np.r_[start, len(key)])
    key = key[start]
    return (key >> np.uint64(52)).astype(np.int64), key & np.uint64((1 << 52) - 1), weight


def _arrivals(best: np.ndarray, to: np.ndarray, seed: np.ndarray, until: np.ndarray, rate: np.ndarray | float, m: int, inside=None) -> None:
    """Takes each process's points up to `until` into best, from to[process] on; `inside` tells which of them count.

    While many processes run, all take one step at once; when few are left, each takes many, so that the short texts, whose
    processes have thousands of points, don't cost thousands of tiny steps. The points are the same either way.
    """
    t, step, at = np.zeros(len(seed)), 0, np.arange(len(seed))
    while len(t):
        many = max(1, min(64, BLOCK // len(t)))
        steps = np.arange(step + 1, step + many + 1, dtype=np.uint64)
        step += many
        u = _mix(seed[:, None] + steps * GOLD)
        when = ((u >> np.uint64(24)) + np.uint64(1)) * 2.0**-40
        np.log(when, out=when)
        when /= -rate if np.isscalar(rate) else -rate[at][:, None]
        when[:, 0] += t
        if many > 1:
            np.cumsum(when, axis=1, out=when)
        on = when <= until[:, None]
        hit = np.flatnonzero(on)
        r = hit if many == 1 else hit // many
        v, found, place = u.ravel()[hit], when.ravel()[hit], to[at[r]]
        if inside is not None:
            held = np.flatnonzero(inside(_mix(v ^ GOLD), at[r]))
            v, found, place = v[held], found[held], place[held]
        # a point's lower 24 bits tell its component, the others its time
        np.minimum.at(best, place + ((v & np.uint64(0xFFFFFF)) * np.uint64(m) >> np.uint64(24)).astype(np.int64), found)
        go = hit if many == 1 else np.flatnonzero(on[:, -1])
        t, until, seed, at = when[go, -1], until[go], seed[go], at[go]


def bag_minhash(doc: np.ndarray, elem: np.ndarray, weight: np.ndarray, n: int, m: int = M) -> np.ndarray:
    """Earliest arrival for each of n documents and m components; infinite for documents without elements."""
    total = np.bincount(doc, weights=weight, minlength=n)
    limit = (np.log(m) + 3) / np.maximum(total, 1)
    best = np.full(n * m, np.inf)
    higher = np.ceil(np.log2(np.maximum(weight, 1))).astype(np.int64)  # intervals beyond the first
    todo = total > 0
    while todo.any():
        live = np.flatnonzero(todo[doc])
        d = doc[live]
        _arrivals(best, d * m, _mix(elem[live] * np.uint64(64) + GOLD), limit[d], float(m), m)
        of = np.repeat(live, higher[live])
        if len(of):
            k = higher[live]
            level = np.arange(len(of)) - np.repeat(np.cumsum(k) - k, k) + 1
            d, w, width = doc[of], weight[of], np.int64(1) << (level - 1)
            # widths are powers of 2: each bit halves the interval
            inside = lambda v, at: width[at] + 1 + ((v & np.uint64(0xFFFFFFFF)).astype(np.int64) & (width[at] - 1)) <= w[at]
            _arrivals(best, d * m, _mix(elem[of] * np.uint64(64) + level.astype(np.uint64) + GOLD), limit[d], width * float(m), m, inside)
        todo &= np.isinf(best.reshape(n, m)).any(axis=1)
        best.reshape(n, m)[todo] = np.inf
        limit = limit * 2
    return best.reshape(n, m)


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[list, list[str]]]:
    ids, texts, size = [], [], 0
    for i, t in zip(batch.column(0).to_pylist(), batch.column(1)):
        ids.append(i)
        texts.append(t.as_py() or "")
        size += len(texts[-1])
        if size >= CHUNK_CHARS or len(ids) >= CHUNK_DOCS:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def signatures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, h1, h2, bands, s0 .. s3): 128 bits that stand for the multiset, 64 bits of each band, and one bit of each component; without words, no bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in _chunks(batch):
                doc, elem, weight = bags_of(texts)
                n = len(texts)
                best = bag_minhash(doc, elem, weight, n)
                short = _mix(best.view(np.uint64)) >> np.uint64(32)
                band = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (n, BANDS))
                for k in range(ROWS):
                    band = _mix(band * np.uint64(31) + short.reshape(n, BANDS, ROWS)[:, :, k] + GOLD)
                bits = np.zeros((n, 64 * len(SKETCH)), bool)
                bits[:, :M] = short & np.uint64(1) > 0
                sketch = np.packbits(bits, axis=1).view(np.int64)
                keys = []
                for salt in (1, 2):  # sums of mixed elements don't depend on their order
                    one = _mix(elem ^ (weight.astype(np.uint64) * GOLD) ^ _times(salt, 0xA0761D6478BD642F))
                    total = np.r_[np.uint64(0), np.cumsum(one, dtype=np.uint64)]
                    ends = np.searchsorted(doc, np.arange(n + 1))
                    keys.append((total[ends[1:]] - total[ends[:-1]]).view(np.int64))
                has = np.isfinite(best[:, 0])
                for k in np.flatnonzero(~has):
                    raw = xxhash.xxh3_128_digest(texts[k])
                    keys[0][k], keys[1][k] = np.frombuffer(raw, np.int64)
                bands = [band[k].tobytes() if has[k] else None for k in range(n)]
                columns = [pa.array(ids, pa.int64()), pa.array(keys[0]), pa.array(keys[1]), pa.array(bands, pa.binary()), *(pa.array(sketch[:, k]) for k in range(len(SKETCH)))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "h1", "h2", "bands", *SKETCH])

    return docs.select(F.col(doc_id).cast("long"), text_of(text)).mapInArrow(run, f"doc_id long, h1 long, h2 long, bands binary, {', '.join(f'{s} long' for s in SKETCH)}")


def _bands(nodes: DataFrame) -> DataFrame:
    """(bucket, node): a row for each band of a node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = np.frombuffer(b"".join(x.as_py() for x in batch.column("bands")), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.repeat(np.array(batch.column("node")), BANDS))], names=["bucket", "node"])

    return nodes.select("node", "bands").mapInArrow(run, "bucket long, node long")


def _shingle_sets(docs: DataFrame) -> DataFrame:
    """(node, bag): each shingle hashed with the number of its occurrence, so that multisets meet as sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in _chunks(batch):
                doc, elem, weight = bags_of(texts)
                nth = np.arange(weight.sum()) - np.repeat(np.cumsum(weight) - weight, weight)
                each = _mix(np.repeat(elem, weight) + nth.astype(np.uint64) * GOLD).view(np.int64)
                ends = np.r_[0, np.cumsum(np.bincount(doc, weights=weight, minlength=len(ids)))].astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(each))], names=["node", "bag"])

    return docs.mapInArrow(run, "node long, bag array<long>")


def _are_stars(edges: DataFrame) -> bool:
    """Whether no node that has an edge to a smaller one has two of these, or edges from larger ones."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(False).alias("top")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(True).alias("top")))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.bool_or("top").alias("top")).filter("up > 1 OR up = 1 AND top").count() == 0


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) of all nodes with an edge to a smaller one: the smallest node they reach, by alternating large and small stars."""
    stars = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "stars")
    while not _are_stars(stars):
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))  # no more than there are edges
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(smallest, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").filter("u <> v").distinct()
        old, stars = stars, written(small, "stars")
        drop(old)
    return stars.select(F.col("u").alias("node"), F.col("v").alias("comp"))


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels after more links: only links between different components count, each once."""
    of = lambda x: labels.select(F.col("node").alias(x), F.col("comp").alias(f"{x}_comp"))
    between = links.join(of("u"), "u", "left").join(of("v"), "v", "left").select(F.coalesce("u_comp", "u").alias("u"), F.coalesce("v_comp", "v").alias("v"))
    up = components(between)
    moved = labels.join(up.select(F.col("node").alias("comp"), F.col("comp").alias("to")), "comp", "left").select("node", F.coalesce("to", "comp").alias("comp"))
    return written(moved.unionByName(up.join(labels.select("node"), "node", "left_anti")), "labels")


def _settle(rows: DataFrame, labels: DataFrame, *needs: Column) -> DataFrame:
    """rows with the components of `labels`, of the buckets whose members are not yet all in one (and which hold what needs tell)."""
    rows = rows.drop("comp").join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    mixed = rows.groupBy("bucket").agg(F.min("comp").alias("a"), F.max("comp").alias("b"), *(F.bool_or(x).alias("need") for x in needs)).filter("a <> b")
    return rows.join((mixed.filter("need") if needs else mixed).select("bucket"), "bucket")


def _met(rows: DataFrame, pivots: DataFrame, threshold: float) -> DataFrame:
    """(node, pivot): the members that each bucket's pivots meet in other components, but for those whose sketches are far apart,
    those that have a bucket before this in common, where they meet, and those that have too few shingles from this one on.
    """
    other = pivots.select(F.col("bucket").alias("b"), F.col("node").alias("pivot"), F.col("comp").alias("pivot_comp"), *(F.col(s).alias(f"p_{s}") for s in (*SKETCH, "size", "rest", "before")))
    apart = sum(F.bit_count(F.col(s).bitwiseXOR(F.col(f"p_{s}"))) for s in SKETCH)
    on = (F.col("bucket") == F.col("b")) & (F.col("comp") != F.col("pivot_comp")) & (apart <= FAR_BITS)
    on &= F.least("rest", "p_rest") * (1 + threshold) + 1e-6 >= threshold * (F.col("size") + F.col("p_size"))
    on &= ~F.arrays_overlap("before", "p_before")
    return rows.join(other, on).select("node", "pivot")


def _verified(pairs: DataFrame, bags: DataFrame, threshold: float) -> DataFrame:
    """(u, v): the pairs (node, pivot) whose multisets overlap enough."""
    pairs = pairs.select(F.least("node", "pivot").alias("u"), F.greatest("node", "pivot").alias("v")).distinct()
    one, two = bags.select(F.col("node").alias("u"), F.col("bag").alias("a")), bags.select(F.col("node").alias("v"), F.col("bag").alias("b"))
    both = pairs.join(one, "u").join(two, "v").withColumn("both", F.size(F.array_intersect("a", "b")))
    return both.filter(F.col("both") >= threshold * (F.size("a") + F.size("b") - F.col("both"))).select("u", "v")


def near_duplicates(docs: DataFrame, threshold: float = 0.8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, class_id) for every document: classes are joined by links of weighted Jaccard `threshold` (0.8 or more)."""
    if threshold < 0.8:
        raise ValueError("bands and sketches are made for a threshold of 0.8 or more")
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text")).filter("doc_id IS NOT NULL")
    sigs = written(signatures(source), "signatures")
    firsts = sigs.groupBy("h1", "h2").agg(F.min("doc_id").alias("node"))
    members = written(sigs.select("doc_id", "h1", "h2").join(firsts, ["h1", "h2"]).select("doc_id", "node"), "members")
    nodes = written(sigs.filter("bands IS NOT NULL").join(firsts.select("h1", "h2", F.col("node").alias("doc_id")), ["h1", "h2", "doc_id"], "left_semi").select(F.col("doc_id").alias("node"), "bands", *SKETCH).dropDuplicates(["node"]), "nodes")
    drop(sigs)
    bands = _bands(nodes)
    shared = bands.groupBy("bucket").agg(F.count("*").alias("n"), F.min("node").alias("pivot")).filter("n > 1").select("bucket", "pivot")
    rows = written(bands.join(shared, "bucket").withColumn("comp", F.col("node")), "rows")  # a node's bands differ, since they hold their number
    # first, each node meets one of the smallest members of its buckets, that with which it shares most: this joins most large groups
    common = rows.filter("node <> pivot").groupBy("node", "pivot").agg(F.count("*").alias("n")).groupBy("node").agg(F.min(F.struct((-F.col("n")).alias("n"), F.col("pivot"))).alias("m")).select("node", "m.pivot")
    sketch = lambda node: nodes.select(F.col("node").alias(node), F.struct(*SKETCH).alias(f"of_{node}"))
    near = sum(F.bit_count(F.col(f"of_node.{s}").bitwiseXOR(F.col(f"of_pivot.{s}"))) for s in SKETCH) <= FAR_BITS
    likest = written(common.join(sketch("node"), "node").join(sketch("pivot"), "pivot").filter(near).select("node", "pivot"), "pairs")
    bags = written(_bags_of(likest, source), "bags")
    links = written(_verified(likest, bags, threshold), "links")
    drop(likest, bags)
    labels = components(links)
    # then the nodes of buckets that are still of several components meet anew, by their rarest shingles
    open_ = _settle(rows, labels)
    left = written(nodes.select("node", *SKETCH).join(open_.select("node").distinct(), "node", "left_semi"), "left")
    bags = written(_bags_of(left.select("node", F.col("node").alias("pivot")), source), "bags")
    old, rows = rows, written(_rarest(bags, threshold).join(left, "node"), "rows")
    drop(old, left, nodes)
    # of an alike pair, the smaller one has so many shingles from the first common one on
    pivots = PIVOTS
    small = F.col("rest") * (1 + threshold) + 1e-6 >= 2 * threshold * F.col("size")
    while True:
        old, rows = rows, written(_settle(rows, labels, small), "rows")
        drop(old)
        if rows.isEmpty():
            break
        # members of the smallest components first: the others need no pivot if these have met all
        sizes = rows.groupBy("bucket", "comp").agg(F.count("*").alias("n"))
        ranked = rows.filter(small).join(sizes, ["bucket", "comp"]).withColumn("nth", F.row_number().over(Window.partitionBy("bucket").orderBy("n", "node"))).filter(F.col("nth") <= pivots)
        chosen = written(ranked.drop("n", "nth"), "pivots")
        pairs = written(_met(rows, chosen, threshold).distinct(), "pairs")
        found = written(_verified(pairs, bags, threshold), "links")
        if found.count():
            labels = _merged(labels, found)
        drop(pairs, found)
        rest = written(rows.join(chosen.select("bucket", "node"), ["bucket", "node"], "left_anti"), "rows")
        drop(rows, chosen)
        rows, pivots = rest, pivots * MORE
    drop(bags)
    return members.join(labels, "node", "left").groupBy("doc_id").agg(F.min(F.coalesce("comp", "node")).alias("class_id"))


def _rarest(bags: DataFrame, threshold: float) -> DataFrame:
    """(bucket, node, size, rest, before): the rarest shingles of each node, how many it has, how many from this one on, and the buckets before.

    Alike nodes share threshold times either's shingles at least, whatever the order of shingles, so that they share one of
    the first |A| - ceil(threshold |A|) + 1 of both. Rarest first, a passage that many documents hold makes few buckets.
    """
    each = bags.select("node", F.explode("bag").alias("bucket"))
    known = each.groupBy("bucket").agg(F.count("*").alias("df"))
    first = F.size("all") - F.ceil(F.lit(threshold) * F.size("all")).cast("int") + 1
    ordered = each.join(known, "bucket").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("df", "bucket"))).alias("all"))  # bounded by a document's words
    placed = ordered.select("node", F.size("all").alias("size"), F.slice("all", F.lit(1), first).alias("first")).select("node", "size", F.filter("first", lambda x: x["df"] > 1)["bucket"].alias("shared"), F.posexplode("first"))
    before = F.slice("shared", F.lit(1), F.array_position("shared", F.col("col.bucket")).cast("int") - 1)
    return placed.filter("col.df > 1").select("col.bucket", "node", "size", (F.col("size") - F.col("pos")).alias("rest"), before.alias("before"))


def _bags_of(pairs: DataFrame, source: DataFrame) -> DataFrame:
    """The multisets of all nodes in pairs."""
    ids = pairs.select(F.explode(F.array("node", "pivot")).alias("doc_id")).distinct()
    few = ids.count() <= BROADCAST_IDS
    return _shingle_sets(source.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi").dropDuplicates(["doc_id"]))

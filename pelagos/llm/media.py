"""Media columns: signature sniffing, declared types corrected, embedded media carved, and texts stored as samples.

An Aho-Corasick automaton finds the magic bytes of all known formats in one pass. A validator for each format then
follows its structure and lengths from there; only what it confirms counts.

Defined cases: null bytes count as empty, which is no known format; bytes that no validator confirms at 0 keep
their declared type; media that begin inside other confirmed media are reported as embedded in it, and inside those
`carve` looks again, level by level; a medium whose end is cut off is none; repeated rows are each sniffed; an output name that clashes with a column raises ValueError.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from pelagos.llm.tables import free_of

#: Magic bytes of each format, and where in a file they stand.
MAGIC = [
    ("image/png", b"\x89PNG\r\n\x1a\n", 0),
    ("image/jpeg", b"\xff\xd8\xff", 0),
    ("image/gif", b"GIF87a", 0),
    ("image/gif", b"GIF89a", 0),
    ("image/bmp", b"\x00\x00\x28\x00\x00\x00", 12),
    ("audio/wav", b"WAVE", 8),
    ("image/webp", b"WEBP", 8),
    ("application/pdf", b"%PDF-", 0),
    ("application/gzip", b"\x1f\x8b\x08", 0),
    ("application/zip", b"PK\x03\x04", 0),
    ("audio/flac", b"fLaC", 0),
    ("audio/ogg", b"OggS", 0),
    ("video/mp4", b"ftyp", 4),
]
#: Bytes that are taken at once from a compressed stream, and from a batch of rows.
STEP, CHUNK_BYTES = 1 << 16, 8 << 20


def wav(payload: bytes, rate: int = 8000) -> bytes:
    """Mono 8-bit PCM with the payload as its samples."""
    pad = len(payload) % 2
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload) + pad, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload)) + payload + b"\0" * pad


def wav_samples(data: bytes) -> bytes:
    """The samples of an 8-bit PCM file, found by walking its chunks."""
    at = 12
    while at + 8 <= len(data):
        name, size = struct.unpack_from("<4sI", data, at)
        if name == b"data":
            return data[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


def _times(a: int, b: int) -> int:
    """Product of two polynomials over two elements, modulo that of the CRC; bits stand in reverse order."""
    out, bit = 0, 1 << 31
    while bit:
        if a & bit:
            out ^= b
        bit >>= 1
        b = (b >> 1) ^ 0xEDB88320 if b & 1 else b >> 1
    return out


class _Crcs:
    """CRCs of ranges, from those of all prefixes up to each MARK bytes: a long range costs no more than a short one."""

    MARK = 4096

    def __init__(self, d: bytes):
        self.d, self.marks, self.powers = d, [0], [1 << 23]  # x ** 8: one byte

    def _prefix(self, end: int) -> int:
        k = end // self.MARK
        while len(self.marks) <= k:
            at = (len(self.marks) - 1) * self.MARK
            self.marks.append(zlib.crc32(self.d[at : at + self.MARK], self.marks[-1]))
        return zlib.crc32(self.d[k * self.MARK : end], self.marks[k])

    def of(self, begin: int, end: int) -> int:
        if end - begin <= 4 * self.MARK:
            return zlib.crc32(self.d[begin:end])
        moved, n, k = self._prefix(begin), end - begin, 0
        while n:  # the prefix before, moved on by the range's length
            if k == len(self.powers):
                self.powers.append(_times(self.powers[-1], self.powers[-1]))
            if n & 1:
                moved = _times(self.powers[k], moved)
            n, k = n >> 1, k + 1
        return moved ^ self._prefix(end)


class _Pngs:
    """Lengths of PNG files by their start. Chains of chunks are followed once, wherever they are entered; CRCs are taken last."""

    def __init__(self, d: bytes):
        self.d, self.crcs, self.ends, self.sound = d, _Crcs(d), {}, {}

    def _end(self, k: int) -> int:
        """Where the chain of chunks from k on ends with IEND; 0 if it does not."""
        path, end = [], 0
        while k not in self.ends and k + 12 <= len(self.d):
            size, name = struct.unpack_from(">I4s", self.d, k)
            if k + 12 + size > len(self.d) or name == b"IHDR":
                break
            path.append(k)
            k += 12 + size
            if name == b"IEND":
                end = k
                break
        end = end or self.ends.get(k, 0)
        self.ends.update(dict.fromkeys(path, end))
        return end

    def _right(self, k: int) -> bool:
        size = struct.unpack_from(">I", self.d, k)[0]
        return self.crcs.of(k + 4, k + 8 + size) == struct.unpack_from(">I", self.d, k + 8 + size)[0]

    def size(self, at: int) -> int:
        first = at + 8
        if first + 25 > len(self.d) or struct.unpack_from(">I4s", self.d, first) != (13, b"IHDR") or not (end := self._end(first + 25)):
            return 0
        path, k, good = [], first + 25, self._right(first)
        while good and k < end and k not in self.sound:
            path.append(k)
            good = self._right(k)
            k += 12 + struct.unpack_from(">I", self.d, k)[0]
        good = good and self.sound.get(k, True)
        self.sound.update(dict.fromkeys(path, good))
        return end - at if good else 0


def _jpeg(d: bytes, at: int) -> int:
    k = at + 2
    while k + 4 <= len(d) and d[k] == 0xFF:
        mark = d[k + 1]
        k += 2 + struct.unpack_from(">H", d, k + 2)[0]
        if mark == 0xDA:  # entropy-coded data up to a marker that is neither stuffing nor a restart
            while (k := d.find(b"\xff", k)) >= 0 and k + 1 < len(d):
                if d[k + 1] == 0xD9:
                    return k + 2 - at
                if d[k + 1] and not 0xD0 <= d[k + 1] <= 0xD7:
                    break
                k += 2
            if k < 0:
                return 0
    return 0


def _gif(d: bytes, at: int) -> int:
    if at + 13 > len(d):
        return 0
    table = lambda flags: 3 << ((flags & 7) + 1) if flags & 0x80 else 0
    k = at + 13 + table(d[at + 10])
    while k < len(d):
        if d[k] == 0x3B:
            return k + 1 - at
        if d[k] == 0x2C and k + 10 < len(d):
            k += 11 + table(d[k + 9])
        elif d[k] == 0x21:
            k += 2
        else:
            return 0
        while k < len(d) and d[k]:
            k += 1 + d[k]
        k += 1
    return 0


def _bmp(d: bytes, at: int) -> int:
    if d[at : at + 2] != b"BM" or at + 54 > len(d):
        return 0
    size, _, start = struct.unpack_from("<III", d, at + 2)
    planes = struct.unpack_from("<H", d, at + 26)[0]
    return size if planes == 1 and 54 <= start <= size <= len(d) - at else 0


def _riff(d: bytes, at: int) -> int:
    if d[at : at + 4] != b"RIFF" or at + 12 > len(d):
        return 0
    end = at + 8 + struct.unpack_from("<I", d, at + 4)[0]
    k = at + 12
    while k + 8 <= end <= len(d):
        k += 8 + (size := struct.unpack_from("<I", d, k + 4)[0]) + size % 2
    return end - at if k == end and k > at + 12 else 0


def _pdf(d: bytes, at: int) -> int:
    """Up to the last end mark, before the next header, whose startxref leads to a cross-reference: files grow by appended parts."""
    limit = d.find(b"%PDF-", at + 5)
    end = limit = len(d) if limit < 0 else limit
    while (end := d.rfind(b"%%EOF", at, end)) > 0:
        sign = d.rfind(b"startxref", at, end)
        to = d[sign + 9 : end].strip() if 0 < sign and end - sign < 64 else b""
        if to.isdigit() and (int(to) == 0 or d[at + int(to) : at + int(to) + 4] == b"xref" or d[at + int(to) : at + int(to) + 1].isdigit()) and at + int(to) < end:
            return end + 5 - at
    return 0


def _gzip(d: bytes, at: int) -> int:
    if at + 18 > len(d) or d[at + 3] & 0xE0:
        return 0
    reader, k, view = zlib.decompressobj(31), at, memoryview(d)
    try:
        while k < len(d) and not reader.eof:  # nothing unpacked is kept
            part = view[k : k + STEP]
            k += len(part)
            while len(part) and not reader.eof:
                reader.decompress(part, STEP)
                part = reader.unconsumed_tail
        return k - at - len(reader.unused_data) if reader.eof else 0
    except zlib.error:
        return 0


def _zips(d: bytes) -> dict[int, int]:
    """Start and length of the archives that each end record tells of."""
    out, end = {}, d.find(b"PK\x05\x06")
    while 0 <= end <= len(d) - 22:
        size, start, note = struct.unpack_from("<IIH", d, end + 12)
        if end - start - size >= 0 and end + 22 + note <= len(d):
            out.setdefault(end - start - size, start + size + 22 + note)
        end = d.find(b"PK\x05\x06", end + 4)
    return out


def _flac(d: bytes, at: int) -> int:
    k, first = at + 4, True
    while k + 4 <= len(d):
        last, kind, size = d[k] & 0x80, d[k] & 0x7F, int.from_bytes(d[k + 1 : k + 4], "big")
        if first and (kind or size != 34) or kind == 127 or k + 4 + size > len(d):
            return 0
        k, first = k + 4 + size, False
        if last:  # frames carry no length: they go on to the end
            return len(d) - at if k == len(d) or d[k : k + 1] == b"\xff" else 0
    return 0


def _ogg_pages(d: bytes, at: int) -> list[int]:
    """Where the pages of a stream begin, and at last where it ends; nothing if a page is cut off."""
    pages = [at]
    while d[(k := pages[-1]) : k + 4] == b"OggS" and k + 27 <= len(d):
        parts = d[k + 26]
        pages.append(k + 27 + parts + sum(d[k + 27 : k + 27 + parts]))
        if pages[-1] > len(d):
            return []
    return pages


def _mp4(d: bytes, at: int) -> int:
    k, boxes = at, set()
    while at >= 0 and k + 8 <= len(d):
        size, name = struct.unpack_from(">I4s", d, k)
        least = 8
        if size == 1 and k + 16 <= len(d):  # the length stands in 64 bits behind the name
            size, least = struct.unpack_from(">Q", d, k + 8)[0], 16
        elif size == 0 and name == b"mdat":  # the last box, up to the end
            size = len(d) - k
        if size < least or k + size > len(d) or (k == at) != (name == b"ftyp"):
            break
        k += size
        boxes.add(name)
    return k - at if boxes & {b"moov", b"mdat", b"moof"} else 0


VALID = {"image/jpeg": _jpeg, "image/gif": _gif, "image/bmp": _bmp, "audio/wav": _riff, "image/webp": _riff, "application/pdf": _pdf, "application/gzip": _gzip, "audio/flac": _flac, "video/mp4": _mp4}


@cache
def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for kind, magic, offset in MAGIC:
        found.add_word(magic.decode("latin-1"), (kind, len(magic), offset))
    found.make_automaton()
    return found


def sniff(data: bytes, known: frozenset[int] = frozenset()) -> list[tuple[str, int, int]]:
    """Kind, start and length of each confirmed medium: by start, then longest first; nested media but one level deep.

    Later pages of an Ogg stream are parts of it and no media of their own; `known` has the starts of such pages.
    """
    hits = sorted({(end + 1 - size - offset, kind) for end, (kind, size, offset) in _automaton().iter(data.decode("latin-1"))})
    found, outer, inner, zips, pngs, pages = [], 0, 0, None, _Pngs(data), set(known)
    for at, kind in hits:
        if at < 0 or at < inner or kind == "audio/ogg" and at in pages:
            continue
        if kind == "application/zip":
            zips = _zips(data) if zips is None else zips
            size = zips.get(at, 0)
        elif kind == "image/png":
            size = pngs.size(at)
        elif kind == "audio/ogg":
            stream = _ogg_pages(data, at)
            pages.update(stream)
            size = stream[-1] - at if stream else 0
        else:
            size = VALID[kind](data, at)
        if size:
            found.append((kind, at, size))
            if at >= outer:
                outer, inner = at + size, at
            else:
                inner = at + size
    return found


def _parts(batches: Iterator[pa.RecordBatch], col: str) -> Iterator[pa.RecordBatch]:
    """The batches in parts of CHUNK_BYTES of a column, or of one row."""
    for batch in batches:
        first, size = 0, 0
        for k, x in enumerate(batch.column(col)):
            size += len(x.as_buffer() or b"") if x.is_valid else 0
            if size >= CHUNK_BYTES or k == len(batch) - 1:
                yield batch.slice(first, k + 1 - first)
                first, size = k + 1, 0


SNIFFED = T.StructType([
    T.StructField("media_type", T.StringType()),
    T.StructField("corrected", T.BooleanType()),
    T.StructField("media", T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType())]))),
])


def sniff_media(df: DataFrame, data: str = "media", declared: str | None = None, out: str = "sniffed") -> DataFrame:
    """df with a struct column: the type that the bytes have (else the declared one), whether it differs, and all media found."""
    free_of(df, out)
    kinds = pa.struct([("media_type", pa.string()), ("corrected", pa.bool_()), ("media", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("length", pa.int64())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches, data):
            said = batch.column(declared).to_pylist() if declared else [None] * len(batch)
            made = []
            for x, was in zip(batch.column(data), said):
                media = sniff(x.as_py() or b"")
                kind = next((k for k, at, _ in media if at == 0), was)
                made.append({"media_type": kind, "corrected": kind != was, "media": [{"kind": k, "start": a, "length": n} for k, a, n in media]})
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, kinds)], names=[*batch.schema.names, out])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, SNIFFED)]))


def carve(df: DataFrame, data: str = "media", levels: int = 3) -> DataFrame:
    """A row for each medium in df's bytes, and in these again, down to so many levels: df's other columns, level, kind, start, length and bytes.

    start counts from the beginning of df's bytes.
    """
    names = ["level", "kind", "start", "length", "bytes"]
    others = [f for f in df.schema.fields if f.name != data]
    free_of(df.drop(data), *names)

    def inside(raw: bytes, offset: int, level: int, known: frozenset[int] = frozenset()) -> Iterator[tuple[int, str, int, bytes]]:
        for kind, at, size in sniff(raw, known):
            whole = (at, size) == (0, len(raw))
            if level == 1 or not whole:  # a medium is not in itself
                yield level, kind, offset + at, raw[at : at + size]
            if level < levels and not (whole and level > 1):
                yield from ((n, k, a, x) for n, k, a, x in inside(raw[at + 1 : at + size], offset + at + 1, level + 1, frozenset(p - at - 1 for p in (*known, *(_ogg_pages(raw, at) if kind == "audio/ogg" else ())))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches, data):
            for k, x in enumerate(batch.column(data)):
                # what is nested in a medium that sniff() already reports is found once, at its place
                found = {(at, kind): (level, kind, at, raw) for level, kind, at, raw in inside(x.as_py() or b"", 0, 1)}
                rows = sorted(found.values(), key=lambda r: (r[2], -len(r[3]), r[1]))
                here = batch.select([f.name for f in others]).take(pa.array([k] * len(rows), pa.int32()))
                made = [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64()), pa.array([len(r[3]) for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.binary())]
                yield pa.RecordBatch.from_arrays([*here.columns, *made], names=[*here.schema.names, *names])

    return df.mapInArrow(run, T.StructType([*others, T.StructField("level", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("bytes", T.BinaryType())]))


def store_texts(df: DataFrame, text: str = "text", block: int = 64, out: str = "media") -> DataFrame:
    """df without its text, with the text's UTF-8 (null: empty) and 0 bytes up to a positive multiple of `block`, as 8-bit samples."""
    free_of(df, out, "n_bytes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches, text):
            raw = [(t.as_py() or "").encode() for t in batch.column(text)]
            media = pa.array([wav(t + b"\0" * (max(block, -(-len(t) // block) * block) - len(t))) for t in raw], pa.binary())
            kept = [(c, n) for c, n in zip(batch.columns, batch.schema.names) if n != text]
            yield pa.RecordBatch.from_arrays([*(c for c, _ in kept), pa.array(map(len, raw), pa.int64()), media], names=[*(n for _, n in kept), "n_bytes", out])

    return df.mapInArrow(run, T.StructType([*(f for f in df.schema.fields if f.name != text), T.StructField("n_bytes", T.LongType()), T.StructField(out, T.BinaryType())]))


def sample_features(df: DataFrame, data: str = "media", sniffed: str = "sniffed") -> DataFrame:
    """df with `payload`, read back from the stored samples, and `feature`: type, media found, and moments of the samples."""
    free_of(df, "payload", "feature")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches, data):
            payloads, features = [], []
            for x, s in zip(batch.column(data), batch.column(sniffed).to_pylist()):
                payload = wav_samples(x.as_py())
                count = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
                total, value = len(payload), np.arange(256)
                # sums of integers: the same on every machine
                moments = f"n={total};sum={int(count @ value)};sq={int(count @ value**2)};peak={int(np.flatnonzero(count)[-1])};zero={int(count[0])}"
                inner = ",".join(f"{m['kind']}@{m['start']}+{m['length']}" for m in s["media"][1:])
                payloads.append(payload)
                features.append(f"type={s['media_type']};corrected={int(s['corrected'])};{moments};embedded={inner}")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(payloads, pa.binary()), pa.array(features, pa.string())], names=[*batch.schema.names, "payload", "feature"])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("payload", T.BinaryType()), T.StructField("feature", T.StringType())]))

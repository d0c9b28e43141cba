"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

A text is cut at places that no piece spans, so that the parts ("words") merge on their own. All words that a
task has not met before are laid out as one flat numpy array of symbols. A round finds the smallest pair rank
of every word (segmented minimum), merges its leftmost occurrences at once, and compacts the array; it ends
when no pair is left. Ids equal those of the sentencepiece library for models without a normalizer table.

Defined cases: null and empty texts give no ids; ids null or empty decode to ""; repeated rows are each encoded;
other columns pass through unchanged, and a clash with the output's name raises ValueError.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from pelagos.llm.tables import free_of

SPACE = "▁"
WORD = re.compile(f"{SPACE}+[^{SPACE}]*")
NO_RANK = np.int64(1) << 40
#: A merge is its rank and, in the low bits, the id that it makes.
ID_BITS, NO_PAIR = 21, np.int64(1) << 61
#: Words that a task remembers before it starts anew, and characters of texts in work at once.
CACHE_WORDS, CHUNK_CHARS = 250_000, 1_000_000


class Vocabulary:
    """A model's pieces as numpy tables, of a size that the vocabulary bounds."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        spec, trainer = proto.normalizer_spec, proto.trainer_spec
        if trainer.model_type != 2 or not trainer.byte_fallback:
            raise ValueError("a BPE model with byte fallback is needed")
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces or not spec.add_dummy_prefix or trainer.treat_whitespace_as_suffix:
            raise ValueError("a model with identity normalisation, dummy prefix and escaped spaces is needed")
        if any(p.type in (4, 5) for p in proto.pieces):
            raise ValueError("user-defined and unused pieces are not supported")
        normal = {p.piece: (i, p.score) for i, p in enumerate(proto.pieces) if p.type == 1}
        self.size = len(proto.pieces)
        self.first_byte = next(i for i, p in enumerate(proto.pieces) if p.type == 6)
        order = {s: r for r, s in enumerate(sorted({s for _, s in normal.values()}, reverse=True))}
        self.rank = np.full(self.size, NO_RANK)
        for i, s in normal.values():
            self.rank[i] = order[s]
        self.char = np.full(0x110000, -1, np.int32)  # symbol of a single character
        pairs, parts, bigrams = {}, {}, set()
        for piece, (i, _) in normal.items():
            if len(piece) == 1:
                self.char[ord(piece)] = i
                continue
            bigrams.update(zip(piece, piece[1:]))
            for k in range(1, len(piece)):
                if piece[:k] in normal and piece[k:] in normal:
                    a, b = normal[piece[:k]][0], normal[piece[k:]][0]
                    pairs[a * self.size + b] = i
                    for part in (a, b):
                        parts[part] = min(parts.get(part, NO_RANK), self.rank[i])
        self._lay_out(pairs)
        # a piece is safe if nothing made with it comes before it: then all its occurrences merge in one round
        self.safe = np.array([parts.get(i, NO_RANK) > self.rank[i] for i in range(self.size)])
        self.bigram = np.array(sorted(ord(a) * 0x110000 + ord(b) for a, b in bigrams), np.int64)
        runs = sorted(len(p) for p in normal if set(p) == {SPACE})
        same = len({normal[SPACE * n][1] for n in runs if n > 1}) == 1
        self.run = runs[-1] if runs == list(range(1, len(runs) + 1)) and len(runs) > 1 and same else 0
        self.run_id = normal[SPACE * self.run][0] if self.run else -1
        if any(SPACE in p.lstrip(SPACE) for p in normal):
            raise ValueError("a model whose pieces hold spaces at their start only is needed")
        raw = [bytes([i - self.first_byte]) if p.type == 6 else b"" if p.type == 3 else " ⁇ ".encode() if p.type == 2 else p.piece.replace(SPACE, " ").encode() for i, p in enumerate(proto.pieces)]
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_len = np.array([len(x) for x in raw], np.int64)
        self.raw_at = np.cumsum(self.raw_len) - self.raw_len
        self.leads = np.array([p.type == 1 and p.piece.startswith(SPACE) for p in proto.pieces])
        self.silent = np.array([p.type == 3 for p in proto.pieces])

    def _lay_out(self, pairs: dict[int, int]) -> None:
        """A hash table of pairs: each stands in the slot of its own hash or in one of the next few."""
        bits = max(8, (4 * len(pairs)).bit_length())
        key = np.array(list(pairs), np.int64)
        made = np.array(list(pairs.values()), np.int64)
        self.shift = np.uint64(64 - bits)
        slot = self._slot(key)
        self.pair, self.value = np.full((1 << bits) + 64, -1, np.int64), np.full((1 << bits) + 64, NO_PAIR)
        self.steps = 0
        while len(key):  # those that find their slot taken move on together
            free = self.pair[slot + self.steps] < 0
            _, first = np.unique(np.where(free, slot, -1), return_index=True)
            took = np.zeros(len(key), bool)
            took[first] = free[first]
            at = slot[took] + self.steps
            self.pair[at], self.value[at] = key[took], self.rank[made[took]] << ID_BITS | made[took]
            key, made, slot = key[~took], made[~took], slot[~took]
            self.steps += 1

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).view(np.int64)

    def merges(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank << ID_BITS | id of what each pair makes; NO_PAIR where it makes nothing."""
        key = np.where((a >= 0) & (b >= 0), a.astype(np.int64) * self.size + b, -2)
        slot = self._slot(key)
        found = self.pair[slot]
        value = np.where(found == key, self.value[slot], NO_PAIR)
        open_ = np.flatnonzero((found != key) & (found >= 0))
        for step in range(1, self.steps):
            if not len(open_):
                break
            at = slot[open_] + step
            found = self.pair[at]
            hit = found == key[open_]
            value[open_[hit]] = self.value[at[hit]]
            open_ = open_[~hit & (found >= 0)]
        return value


def merge_rounds(v: Vocabulary, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words, one after the other, and how many each has."""
    cut = _cut(v, words)
    chars, piece_len, owner = cut
    sym = v.char[chars]
    seg = np.repeat(np.arange(len(piece_len)), piece_len)
    done_seg, done_pos, done_sym = [], [], []
    pos = np.arange(len(sym))
    pair = np.full(len(sym), NO_PAIR)
    at = np.flatnonzero(seg[1:] == seg[:-1])
    pair[at] = v.merges(sym[at], sym[at + 1])
    while len(sym):
        starts = np.flatnonzero(np.r_[True, seg[1:] != seg[:-1]])
        least = np.minimum.reduceat(pair, starts)
        length = np.diff(np.r_[starts, len(seg)])
        ended = least == NO_PAIR
        if ended.any():
            out = np.repeat(ended, length)
            done_seg.append(seg[out])
            done_pos.append(pos[out])
            done_sym.append(sym[out])
            stay = ~out
            sym, seg, pos, pair = sym[stay], seg[stay], pos[stay], pair[stay]
            least, length = least[~ended], length[~ended]
            if not len(sym):
                break
        hit = np.flatnonzero(pair >> ID_BITS == np.repeat(least >> ID_BITS, length))
        made = (pair[hit] & ((1 << ID_BITS) - 1)).astype(sym.dtype)
        first = np.r_[True, seg[hit[1:]] != seg[hit[:-1]]]
        free = first | v.safe[made] & (sym[hit] != sym[hit + 1])
        hit = hit[free]
        sym[hit] = made[free]
        keep = np.ones(len(sym), bool)
        keep[hit + 1] = False
        new = np.cumsum(keep) - 1
        sym, seg, pos, pair = sym[keep], seg[keep], pos[keep], pair[keep]
        at = new[hit]
        near = np.zeros(len(sym), bool)  # the pairs on either side of what was made
        near[at], near[at[at > 0] - 1] = True, True
        at = np.flatnonzero(near)
        nxt = np.minimum(at + 1, len(sym) - 1)
        inside = (at + 1 < len(sym)) & (seg[nxt] == seg[at])
        pair[at] = NO_PAIR
        pair[at[inside]] = v.merges(sym[at[inside]], sym[nxt[inside]])
    if not done_pos:
        return np.zeros(0, np.int32), np.zeros(len(words), np.int64)
    pos, sym = np.concatenate(done_pos), np.concatenate(done_sym)
    order = np.argsort(pos, kind="stable")
    pos, sym, seg = pos[order], sym[order], np.concatenate(done_seg)[order]
    word = owner[seg]
    ids, word = _spell(v, sym, chars[pos], word)
    return ids, np.bincount(word, minlength=len(words))


def _cut(v, words):
    """Code points of all words, the lengths of the parts between which no piece reaches, and each part's word."""
    chars = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
    size = np.fromiter(map(len, words), np.int64, len(words))
    word = np.repeat(np.arange(len(words)), size)
    key = chars[:-1] * 0x110000 + chars[1:]
    at = np.minimum(np.searchsorted(v.bigram, key), len(v.bigram) - 1)
    start = np.r_[True, (v.bigram[at] != key) | (word[1:] != word[:-1])] if len(chars) else np.zeros(0, bool)
    if v.run:  # a long run of spaces becomes the longest piece again and again, from the left
        space = chars == ord(SPACE)
        if space.any():
            begins = np.flatnonzero(space & np.r_[True, ~space[:-1] | (word[1:] != word[:-1])])
            ends = np.flatnonzero(space & np.r_[~space[1:] | (word[1:] != word[:-1]), True]) + 1
            for b, e in zip(begins, ends):
                if e - b > v.run:
                    start[b : b + (e - b - 1) // v.run * v.run + 1 : v.run] = True
    at = np.flatnonzero(start)
    return chars, np.diff(np.r_[at, len(chars)]), word[at]


def _spell(v, sym, chars, word):
    """Symbols outside the vocabulary become the ids of their UTF-8 bytes."""
    out = sym < 0
    if not out.any():
        return sym.astype(np.int32), word
    found, code = np.unique(chars[out], return_inverse=True)
    spelt = [chr(c).encode("utf-8", "surrogatepass") for c in found]
    n = np.ones(len(sym), np.int64)
    n[out] = np.array([len(s) for s in spelt])[code]
    ids = np.repeat(sym, n).astype(np.int32)
    ids[np.repeat(out, n)] = np.frombuffer(b"".join([spelt[c] for c in code]), np.uint8).astype(np.int32) + v.first_byte
    return ids, np.repeat(word, n)


class Encoder:
    """Encodes lists of texts; remembers words it has met, up to CACHE_WORDS."""

    def __init__(self, v: Vocabulary):
        self.v = v
        self._clear()

    def _clear(self):
        self.code: dict[str, int] = {}
        self.flat, self.used, self.count = np.zeros(1 << 16, np.int32), 0, np.zeros(0, np.int64)

    def _learn(self, words: list[str]) -> None:
        ids, count = merge_rounds(self.v, [SPACE + w for w in words])
        if self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.used], np.zeros(max(len(ids), self.used), np.int32)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        self.code.update(zip(words, range(len(self.code), len(self.code) + len(words))))
        self.count = np.concatenate([self.count, count])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and how many each has."""
        if len(self.code) > CACHE_WORDS:
            self._clear()
        lists = [_words(t) if t else [] for t in texts]
        words = [w for ws in lists for w in ws]
        code = np.fromiter(map(self.code.get, words, repeat(-1)), np.int64, len(words))
        if len(new := np.flatnonzero(code < 0)):
            met = [words[k] for k in new.tolist()]
            self._learn(list(dict.fromkeys(met)))
            code[new] = np.fromiter(map(self.code.__getitem__, met), np.int64, len(met))
        count = self.count[code]
        ids = _gather(self.flat, (np.cumsum(self.count) - self.count)[code], count)
        sums = np.r_[0, np.cumsum(count)]
        ends = np.cumsum([0, *map(len, lists)])
        return ids, np.diff(sums[ends])


def _words(text: str) -> list[str]:
    """The text cut before each run of spaces, each word without the first space (the first word's is added in front)."""
    if "  " in text or SPACE in text or text[0] == " ":
        return [w[1:] for w in WORD.findall(SPACE + text.replace(" ", SPACE))]
    return text.split(" ")


def _gather(flat: np.ndarray, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The slices flat[start : start + count], one after the other."""
    ends = np.cumsum(count)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(start - (ends - count), count) + np.arange(total)]


def decode(v: Vocabulary, ids: np.ndarray, count: np.ndarray) -> list[str]:
    """Texts of ids that stand one after the other. Bytes that are no UTF-8 become U+FFFD, ids that don't exist raise."""
    if len(ids) and (ids.min() < 0 or ids.max() >= v.size):
        raise ValueError("id out of range")
    size = v.raw_len[ids]
    data = _gather(v.raw, v.raw_at[ids], size).tobytes()
    byte_at = np.r_[0, np.cumsum(size)]
    ends = np.cumsum(np.r_[0, count])
    texts = []
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
        k = a
        while k < b and v.silent[ids[k]]:
            k += 1
        lo = int(byte_at[a]) + int(k < b and v.leads[ids[k]])  # the dummy prefix
        raw = data[lo : int(byte_at[b])]
        try:
            texts.append(raw.decode())
        except UnicodeDecodeError:
            texts.append(_mend(raw))
    return texts


def _mend(raw: bytes) -> str:
    """Each byte that is part of no character becomes one U+FFFD."""
    out, k = [], 0
    while k < len(raw):
        try:
            out.append(raw[k:].decode())
            break
        except UnicodeDecodeError as e:
            out.append(raw[k : k + e.start].decode() + "�")
            k += e.start + 1
    return "".join(out)


def _chunks(texts: Iterable[str]) -> Iterator[list[str]]:
    chunk, size = [], 0
    for t in texts:
        chunk.append(t)
        size += len(t)
        if size >= CHUNK_CHARS:
            yield chunk
            chunk, size = [], 0
    if chunk:
        yield chunk


def _with_column(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    free_of(df, name)
    return T.StructType([*df.schema.fields, T.StructField(name, kind)])


def encode_text(df: DataFrame, model: bytes, text: str = "text", ids: str = "ids", keep_text: bool = True, decoded: str | None = None) -> DataFrame:
    """df with a column of ids of each whole text, no begin or end ids. keep_text=False drops the text column.

    decoded names a further column for the text that the ids decode to, made in the same pass.
    """
    schema = _with_column(df, ids, T.ArrayType(T.IntegerType()))
    if decoded:
        schema = T.StructType([*schema.fields, _with_column(df, decoded, T.StringType())[decoded]])
    if not keep_text:
        schema = T.StructType([f for f in schema.fields if f.name != text])
    shared = df.sparkSession.sparkContext.broadcast(Vocabulary(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in batches:
            at = 0
            for chunk in _chunks(t.as_py() or "" for t in batch.column(text)):
                part = batch.slice(at, len(chunk))
                at += len(chunk)
                flat, count = encoder.encode(chunk)
                made = [pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(count)].astype(np.int32)), pa.array(flat))]
                if decoded:
                    made.append(pa.array(decode(shared.value, flat, count), pa.string()))
                kept = [(c, n) for c, n in zip(part.columns, part.schema.names) if keep_text or n != text]
                yield pa.RecordBatch.from_arrays([c for c, _ in kept] + made, names=[n for _, n in kept] + [ids] + ([decoded] if decoded else []))

    return df.mapInArrow(run, schema)


def decode_ids(df: DataFrame, model: bytes, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """df with a column of the text that each list of ids decodes to."""
    schema = _with_column(df, text, T.StringType())
    shared = df.sparkSession.sparkContext.broadcast(Vocabulary(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, len(batch), 256):
                part = batch.slice(k, 256)
                col = part.column(ids)
                count = np.array(col.value_lengths().fill_null(0), np.int64)
                texts = decode(shared.value, np.array(col.flatten(), np.int64), count)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*part.schema.names, text])

    return df.mapInArrow(run, schema)

"""Toxicity by a support vector machine on a subsequence string kernel, with Nyström landmarks, trained on labelled texts.

The kernel of two strings counts their common subsequences of three letters, gaps allowed, each weighted by DECAY to the
length it stretches over in both, up to REACH letters. Divided by the landmark's own kernel it tells how much of a
landmark a word holds, wherever in the word, with letters put in or left out (at most 1); to the power of POWER, so that
what many words share by chance counts little. Letters that stand alone one after the other ("i d i o t", "i.d.i.o.t")
are joined to a word, and marks inside a word are left out.

Landmarks are stems of four letters that labelled toxic texts hold most above their rate among clean ones. A text is the
bag of its words: for each landmark the sum of its words' kernels, as a logarithm, so that a stem counts that a clean text
may hold once but a toxic one holds several times. The landmarks' own kernel matrix turns these sums into Nyström
features; a linear machine with squared hinge loss is solved on them, with the text's length, by Newton steps, and a
logistic curve turns its margin into a score. Nothing else is in a score.

Fitting uses at most `max_docs` labelled texts of each class, those of the smallest hash; texts that are near copies of
others among them count once. `landmarks` bounds the number of landmarks. Scoring reads every whole text.

Defined cases: null and empty texts, and texts without letters, score as a text that shares nothing with any landmark;
labels that are null are not used; without toxic or without clean labels every text scores the smoothed rate of toxic
labels; repeated rows score alike; output names that clash, in any case of letters, raise ValueError.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pelagos.llm.tables import free_of, text_of

DECAY, REACH = 0.6, 5
MAX_DOCS, LANDMARKS = 2500, 128
#: Picked by four folds inside the training rows at sf0.1 (recall 0.926, false alarms 0.4 %, AUC 0.979 there): the power of the kernel, and the machine's ridge. Kernels under FLOOR
#: count as 0; to that power they are under 0.0001.
POWER, RIDGE, FLOOR = 8, 1e-4, 0.3
#: A stem tells if it is held TELLING times as often by toxic texts, where to hold it once, twice or four times counts.
TIMES, TELLING = (1, 2, 4), 2.0
BLOCK_WORDS = 1000  # words whose kernels are computed at once
WORD_LETTERS = 32  # longer runs of letters are taken in overlapping pieces of so many
CACHE_WORDS, CHUNK_CHARS = 500_000, 500_000
_OTHER = re.compile(r"[\W\d_]+")
PRIME = np.uint64(0x9E3779B97F4A7C15)


def clean(token: str) -> str:
    """The letters of a token in lower case."""
    return token if token.isalpha() else _OTHER.sub("", token)


def pieces(word: str) -> list[str]:
    if len(word) <= WORD_LETTERS:
        return [word]
    return [word[k : k + WORD_LETTERS] for k in range(0, len(word) - WORD_LETTERS // 2, WORD_LETTERS // 2)]


def segments(text: str) -> list[str]:
    """The words of a text, and what letters standing alone one after the other spell."""
    words = [clean(t) for t in text.lower().split()]
    out = [p for w in words for p in pieces(w)]
    run: list[str] = []
    for token in _OTHER.split(text.lower()) + [""]:
        if len(token) == 1:
            run.append(token)
        elif token or len(run):
            if len(run) > 2:
                out += pieces("".join(run))
            run = []
    return out


def subsequences(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, feature, weight), merged and sorted by word and feature."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    chars = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    word = np.repeat(np.arange(len(words)), size)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(chars))  # letters from here to the word's end
    ws, fs, gs = [], [], []
    for j in range(1, REACH - 1):
        for k in range(j + 1, REACH):
            at = np.flatnonzero(left > k)
            fs.append((chars[at] << np.uint64(42)) | (chars[at + j] << np.uint64(21)) | chars[at + k])
            ws.append(word[at])
            gs.append(np.full(len(at), DECAY ** (k + 1)))
    w, f, g = np.concatenate(ws), np.concatenate(fs), np.concatenate(gs)
    # one sort key: the word's number above 42 bits of the feature's hash
    key = (w.astype(np.uint64) << np.uint64(42)) | (f * PRIME) >> np.uint64(22)
    order = np.argsort(key)
    key, g = key[order], g[order]
    start = np.flatnonzero(np.r_[np.ones(min(1, len(key)), bool), key[1:] != key[:-1]])
    return w[order][start], key[start] & np.uint64((1 << 42) - 1), np.add.reduceat(g, start) if len(start) else g


class Landmarks:
    """Strings whose subsequences are sought in words; a word's ends count as the letters ^ and $."""

    def __init__(self, strings: list[str]):
        w, f, g = subsequences(strings)
        self.count = len(strings)
        self.names, code = np.unique(f, return_inverse=True)
        own = np.bincount(w, weights=g**2, minlength=len(strings))
        self.table = np.zeros((len(self.names), len(strings)), np.float32)
        self.table[code, w] = g / own[w]
        unit = np.zeros((len(strings), len(self.names)))
        unit[w, code] = g / np.sqrt(own[w])
        value, vector = np.linalg.eigh((unit @ unit.T) ** POWER)
        keep = value > 1e-6
        self.root = vector[:, keep] / np.sqrt(value[keep])  # Nyström: K(x, L) @ root are the features

    def kernels(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word, landmark, kernel) of those that count, in order of words."""
        rows, columns, values = [], [], []
        for k in range(0, len(words), BLOCK_WORDS):
            w, f, g = subsequences([f"^{x}$" for x in words[k : k + BLOCK_WORDS]])
            at = np.minimum(np.searchsorted(self.names, f), len(self.names) - 1)
            hit = np.flatnonzero(self.names[at] == f)
            if not len(hit):
                continue
            start = np.flatnonzero(np.r_[True, w[hit][1:] != w[hit][:-1]])
            like = np.minimum(np.add.reduceat(self.table[at[hit]] * g[hit, None].astype(np.float32), start, axis=0), 1)
            row, column = np.nonzero(like > FLOOR)
            rows.append(k + w[hit][start][row])
            columns.append(column)
            values.append(like[row, column].astype(np.float64) ** POWER)
        join = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind)
        return join(rows, np.int64), join(columns, np.int64), join(values, np.float64)

    def vectors(self, sums: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Of texts, from their sums of kernels with each landmark and their numbers of words."""
        return np.c_[np.log1p(sums) @ self.root, np.log1p(words)]


@dataclass
class Model:
    """A machine over the vectors of texts (whole: their weights, and at last the bias), and the curve of its scores."""

    landmarks: Landmarks | None
    whole: np.ndarray
    slope: float
    offset: float
    constant: float | None = None

    def margins(self, sums: np.ndarray, words: np.ndarray) -> np.ndarray:
        return np.zeros(len(words)) if self.landmarks is None else self.landmarks.vectors(sums, words) @ self.whole[:-1] + self.whole[-1]

    def score(self, margin: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(margin), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -40, 40)))


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-4) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss, by Newton steps on the examples inside the margin."""
    x1 = np.c_[x, np.ones(len(x))]
    v = np.zeros(x1.shape[1])
    reg = np.diag([ridge * weight.sum()] * x.shape[1] + [1e-6])
    for _ in range(30):
        inside = y * (x1 @ v) < 1
        a = x1[inside] * weight[inside, None]
        new = np.linalg.solve(a.T @ x1[inside] + reg, a.T @ y[inside])
        if np.allclose(new, v, atol=1e-7):
            break
        v = new
    return v[:-1], float(v[-1])


def _logistic(m: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of Platt's curve, with a small ridge."""
    x, v = np.c_[m, np.ones(len(m))], np.zeros(2)
    target = np.where(y > 0, 1 - 1 / ((y > 0).sum() + 2), 1 / ((y <= 0).sum() + 2))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ v, -40, 40)))
        grad = x.T @ (p - target) + 1e-3 * v
        hess = (x * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        v = v - step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-7:
            break
    return float(v[0]), float(v[1])


def _groups(word: str) -> set[str]:
    full = f"^{word}$"
    return {full[k : k + 4] for k in range(max(1, len(full) - 3))}


@dataclass
class Bags:
    """Labelled texts as bags of words: text k holds vocab[code[j]] n[j] times, for j from ends[k] up to ends[k + 1]."""

    y: np.ndarray
    ends: np.ndarray
    code: np.ndarray
    n: np.ndarray
    vocab: list[str]


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1 and so on, size[0] numbers, then those of start[1]."""
    return np.arange(size.sum()) + np.repeat(start - (np.cumsum(size) - size), size)


def _word_groups(vocab: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """(names, flat, first, size): the letter groups of word k are names[g] for g in flat[first[k]:][:size[k]]."""
    ids: dict[str, int] = {}
    flat, size = array("i"), np.zeros(len(vocab), np.int64)
    for k, w in enumerate(vocab):
        if len(w) > 2:
            groups = _groups(w)
            size[k] = len(groups)
            flat.extend(ids.setdefault(g, len(ids)) for g in groups)
    return list(ids), np.array(flat, np.int32), np.cumsum(size) - size, size


def fit(bags: Bags, landmarks: int = LANDMARKS) -> Model:
    """A model from labelled texts' bags of words."""
    y, ends, code, n, vocab = bags.y, bags.ends, bags.code, bags.n, bags.vocab
    toxic, fine = int((y > 0).sum()), int((y <= 0).sum())
    base = Model(None, np.zeros(0), 0.0, 0.0, (toxic + 1) / (toxic + fine + 2))
    if not toxic or not fine:
        return base
    names, flat, first, size = _word_groups(vocab)
    count = np.zeros((len(TIMES), 2, len(names)), np.int32)  # in how many toxic and clean texts a stem is so many times
    for k in range(len(y)):
        words, times = code[ends[k] : ends[k + 1]], n[ends[k] : ends[k + 1]]
        group, at = np.unique(flat[_ranges(first[words], size[words])], return_inverse=True)
        held = np.bincount(at, weights=np.repeat(times, size[words]), minlength=len(group))
        for m, least in zip(count, TIMES):
            m[0 if y[k] > 0 else 1, group[held >= least]] += 1
    # standard deviations above what the rate among clean texts lets expect, where it is well above it
    expected = toxic / fine * count[:, 1]
    above = (count[:, 0] - expected) / np.sqrt(expected + 1)
    best_of = np.where(count[:, 0] >= TELLING * (expected + 0.5), above, 0.0).max(axis=0)
    telling = sorted(np.flatnonzero(best_of > 0).tolist(), key=lambda g: (-best_of[g], names[g]))[:landmarks]
    if not telling:
        return base
    marks = Landmarks([names[g] for g in telling])
    word, column, value = marks.kernels(vocab)
    many = np.bincount(word, minlength=len(vocab))
    text = np.repeat(np.arange(len(y)), np.diff(ends))
    at = _ranges((np.cumsum(many) - many)[code], many[code])
    sums = np.bincount(np.repeat(text, many[code]) * marks.count + column[at], weights=value[at] * np.repeat(n, many[code]), minlength=len(y) * marks.count).reshape(len(y), marks.count)
    x = marks.vectors(sums, np.bincount(text, weights=n, minlength=len(y)))
    sign = np.where(y > 0, 1, -1)
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6) * np.sqrt(x.shape[1])
    v, bias = _svm((x - mean) / scale, sign, np.where(sign > 0, 1 / toxic, 1 / fine), RIDGE)
    whole = np.r_[v / scale, bias - (mean / scale) @ v]
    return Model(marks, whole, *_logistic(x @ whole[:-1] + whole[-1], sign))


def _prints(text: str) -> list[int]:
    """Four min-hashes of the text's three-token shingles, by which near copies are told."""
    tokens = text.lower().split()
    h = np.array([xxhash.xxh3_64_intdigest(" ".join(tokens[k : k + 3])) for k in range(max(1, len(tokens) - 2))], np.uint64)
    return [int(((h ^ np.uint64(s * 0x5851F42D4C957F2D & (2**64 - 1))) * PRIME).min() >> np.uint64(1)) for s in range(4)]


def _apart(y: list[int], prints: list[list[int]]) -> np.ndarray:
    """Which texts share fewer than two of four min-hashes with an earlier one of the same label."""
    met, out = set(), np.zeros(len(y), bool)
    for k, (label, text) in enumerate(zip(y, prints)):
        keys = [(label, s, p) for s, p in enumerate(text)]
        out[k] = sum(key in met for key in keys) < 2
        met.update(keys)
    return out


def train(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS, landmarks: int = LANDMARKS, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Fits on at most max_docs labelled texts of each class. Only their words and counts reach the driver."""
    known = labels.filter(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("_id")).agg(F.max(label).cast("int").alias("_y"))
    order = F.xxhash64("_id")
    # at most 2 * max_docs ids
    chosen = known.filter("_y = 1").orderBy(order, "_id").limit(max_docs).unionByName(known.filter("_y = 0").orderBy(order, "_id").limit(max_docs))
    rows = docs.select(F.col(doc_id).alias("_id"), text_of(text).alias("_text")).join(F.broadcast(chosen), "_id").select("_id", "_y", F.xxhash64("_text").alias("_hash"), "_text")

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                text = batch.column(3)[k].as_py()
                found = sorted((w, n) for w, n in Counter(segments(text)).items() if w)
                columns = [pa.array([[w for w, _ in found]], pa.list_(pa.string())), pa.array([[n for _, n in found]], pa.list_(pa.int32())), pa.array([_prints(text)], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(k, 1) for c in range(3)), *columns], names=["_id", "_y", "_hash", "words", "n", "prints"])

    schema = T.StructType([*rows.schema.fields[:3], T.StructField("words", T.ArrayType(T.StringType())), T.StructField("n", T.ArrayType(T.IntegerType())), T.StructField("prints", T.ArrayType(T.LongType()))])
    found = rows.mapInArrow(words, schema).toArrow()
    found = found.take(pc.sort_indices(found.select(["_id", "_hash"]), [("_id", "ascending"), ("_hash", "ascending")]))
    found = found.filter(pa.array(_apart(found["_y"].to_pylist(), found["prints"].to_pylist())))
    code = pc.list_flatten(found["words"]).combine_chunks().dictionary_encode()
    ends = np.r_[0, np.cumsum(np.array(pc.list_value_length(found["words"]), np.int64))].astype(np.int64)
    return fit(Bags(np.array(found["_y"]), ends, np.array(code.indices, np.int64), np.array(pc.list_flatten(found["n"]), np.int64), code.dictionary.to_pylist()), landmarks)


class Scorer:
    """Margins of texts; remembers the kernels of words it has met, and the words of tokens, up to CACHE_WORDS tokens."""

    def __init__(self, model: Model):
        self.model = model
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {}  # tokens, by the row of their words below
        self.row: dict[tuple[str, ...], int] = {}
        self.words, self.many = np.zeros(0, np.int64), np.zeros(0, np.int64)  # of each row: words it has, kernels that count
        self.column, self.value = np.zeros(0, np.int64), np.zeros(0)

    def _learn(self, tokens: list[str]) -> None:
        spelt = [tuple(pieces(clean(t))) for t in tokens]
        new = [ps for ps in dict.fromkeys(spelt) if ps not in self.row]
        word, column, value = self.model.landmarks.kernels([p for ps in new for p in ps])
        owner = np.repeat(np.arange(len(new)), [len(ps) for ps in new])
        self.row.update(zip(new, range(len(self.row), len(self.row) + len(new))))
        self.known.update(zip(tokens, map(self.row.__getitem__, spelt)))
        self.words = np.r_[self.words, [sum(map(bool, ps)) for ps in new]].astype(np.int64)
        self.many = np.r_[self.many, np.bincount(owner[word], minlength=len(new))]
        self.column, self.value = np.r_[self.column, column], np.r_[self.value, value]
        self.first = np.cumsum(self.many) - self.many

    def margins(self, texts: list[str]) -> np.ndarray:
        if self.model.landmarks is None:
            return np.zeros(len(texts))
        if len(self.known) > CACHE_WORDS:
            self._clear()
        lists = [t.lower().split() + _spelt(t) for t in texts]
        tokens = [w for ws in lists for w in ws]
        if new := [t for t in dict.fromkeys(tokens) if t not in self.known]:
            self._learn(new)
        code = np.fromiter(map(self.known.__getitem__, tokens), np.int64, len(tokens))
        text = np.repeat(np.arange(len(texts)), [len(ws) for ws in lists])
        words = np.bincount(text, weights=self.words[code], minlength=len(texts))
        held = np.flatnonzero(self.many[code])
        code, text, count = code[held], text[held], self.model.landmarks.count
        many = self.many[code]
        at = _ranges(self.first[code] if len(code) else code, many)
        sums = np.bincount(np.repeat(text, many) * count + self.column[at], weights=self.value[at], minlength=len(texts) * count)
        return self.model.margins(sums.reshape(len(texts), count), words)


_ALONE = re.compile(r"(?<![^\W\d_])[^\W\d_](?:[\W\d_]+[^\W\d_](?![^\W\d_])){2,}")


def _spelt(text: str) -> list[str]:
    return [p for m in _ALONE.finditer(text) for p in pieces(_OTHER.sub("", m.group()).lower())]


def score_toxicity(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with `score` (0 to 1) and `predicted` (1 from 0.5 on) for each whole text."""
    free_of(docs, "score", "predicted")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            margins, part, size = [], [], 0
            for t in batch.column(text):
                part.append(t.as_py() or "")
                size += len(part[-1])
                if size > CHUNK_CHARS:
                    margins.append(scorer.margins(part))
                    part, size = [], 0
            score = shared.value.score(np.concatenate([*margins, scorer.margins(part)]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=[*batch.schema.names, "score", "predicted"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))

"""Secret scans: candidates by pattern, false positives removed by a random forest.

A candidate is a key of a fixed format, a value that is assigned to a telling name, or a run of key letters that is long
and mixed enough, each without the punctuation behind it. Features: its length, how
its characters follow one another (class changes, entropy, shares of digits and capitals, and how likely its letter pairs
are by a table of transitions), how much of it words of a dictionary cover, its path (slashes, an address before it), and
the words beside it and in its path, by the odds at which labelled findings hold them. Transitions and dictionary are
learned from all documents: the table has a row for each pair of letters, the dictionary at most DICTIONARY words. The
forest and the odds are learned from labelled findings; `generated_findings` makes such a set from the public formats of
keys and of things that look like them, with words of the dictionary, and a user's own labelled findings (columns before,
value, after, label) can take its place or join it.

Defined cases: null and empty texts have no findings; of equal candidates each occurrence counts; repeated rows are
each scanned; an empty table stays empty; other columns pass through, clashing output names raise ValueError.
"""

from __future__ import annotations

import math
import random
import re
import string
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pelagos.llm.tables import free_of, text_of, written

CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_.-])[A-Za-z0-9+/_.-]{12,}+={0,2}(?![A-Za-z0-9+/_=.-])")
#: Keys that their format tells, wherever they stand.
FIXED = re.compile(
    r"(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{30,}+|sk[-_](?:live|test)[-_][A-Za-z0-9]{16,}+|xox[abprs]-[A-Za-z0-9-]{10,}+|AIza[0-9A-Za-z_-]{35}|eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+(?:\.[A-Za-z0-9_-]++)?)(?![A-Za-z0-9])"
)
#: A sign that assigns, the name that must stand before it, with a telling word anywhere in it, and the value behind it: up
#: to its closing quote, or else to a blank or to a separator behind which the next name or nothing stands.
SIGN = re.compile(r"[:=]")
NAMED = re.compile(r"(?:password|passwd|pwd|secret|token|key|auth(?!or(?!iz))|bearer|credential)[A-Za-z0-9_.-]{0,40}[\"']?\s{0,3}:?$", re.I)
VALUE = re.compile(r"\s{0,3}(?:(?:bearer|basic)\s{1,3})?(?:\"([^\s\"]{6,}+)\"|'([^\s']{6,}+)'|[\"']?((?:[^\s\"'&;,]|[&;,](?![\s\"')\]}]|$|[A-Za-z0-9_.-]{1,60}\s?[=:])){6,}+))", re.I)
#: Words of which generated findings are made where the documents have none.
SYLLABLES = ("the", "and", "ing", "ion", "ent", "ter", "est", "ment", "ness", "able", "con", "pre", "com", "per", "ver", "man", "day", "age", "ful", "int", "str", "get", "set", "data", "time", "name", "file", "test", "main", "view", "list", "type", "user", "page", "read", "work", "land", "light", "book", "form")
#: Most words of the dictionary, and how often the documents must hold one; how often findings must hold a word to have odds.
DICTIONARY, SEEN, TOLD = 50_000, 5, 8
LETTERS = "^abcdefghijklmnopqrstuvwxyz$"
FEATURES = 20
WINDOW = 40
FOUND = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("value", T.StringType()), T.StructField("probability", T.DoubleType())]))


def candidates(text: str) -> list[tuple[int, int]]:
    """Spans of candidates, left to right, without overlaps; code points, end exclusive."""
    sure = [m.span() for m in FIXED.finditer(text)]
    spans = []
    for sign in SIGN.finditer(text):
        if NAMED.search(text, max(0, sign.start() - 64), sign.start()) and (m := VALUE.match(text, sign.end())):
            a, b = m.span(m.lastindex)
            b = _ended(text, a, b) if m.lastindex == 3 else b
            if b - a >= 6:
                spans.append((a, b))
    for m in CANDIDATE.finditer(text):
        a, b = m.start(), _ended(text, *m.span())
        if b - a >= 12 and _mixed(text[a:b]):
            spans.append((a, b))
    out: list[tuple[int, int]] = []
    for a, b in sure + sorted(spans, key=lambda s: (s[0], -s[1])):
        # those of a fixed format come first, the others fill what room they leave
        at = bisect_left(out, (a, b))
        if (at == 0 or out[at - 1][1] <= a) and (at == len(out) or b <= out[at][0]):
            out.insert(at, (a, b))
    return out


def _ended(text: str, a: int, b: int) -> int:
    """The end of a span without the punctuation behind it: stops, and brackets that it does not open."""
    while b > a and (text[b - 1] in ".,;:" or (opens := {")": "(", "]": "[", "}": "{", ">": "<"}.get(text[b - 1])) and opens not in text[a:b]):
        b -= 1
    return b


def _mixed(s: str) -> bool:
    return any(c.isdigit() for c in s) and any(c.isalpha() for c in s) or len(s) >= 24 and s.lower() != s and s.upper() != s


def _class(c: str) -> int:
    return 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3


@dataclass
class Language:
    """log2 probabilities of a letter after another (^ begins a word, $ ends it), and frequent words."""

    pairs: np.ndarray
    words: frozenset[str]


def learn_language(docs: DataFrame, text: str = "text") -> Language:
    """From the words of all documents, counted by Spark; what reaches the driver is bounded by letters and DICTIONARY."""
    found = F.explode(F.regexp_extract_all(F.lower(text_of(text)), F.lit(r"(?<![\p{L}\p{N}])[a-z]{2,24}+(?![\p{L}\p{N}])"), F.lit(0)))
    words = written(docs.select(found.alias("word")).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= SEEN), "secret-words")
    full = F.concat(F.lit("^"), "word", F.lit("$"))
    pairs = words.select("n", F.explode(F.transform(F.sequence(F.lit(1), F.length(full) - 1), lambda k: F.substr(full, k, F.lit(2)))).alias("pair")).groupBy("pair").agg(F.sum("n").alias("n"))
    count = np.ones((len(LETTERS), len(LETTERS)))
    for pair, n in pairs.collect():  # at most 28 * 28
        count[LETTERS.index(pair[0]), LETTERS.index(pair[1])] += n
    top = words.filter(F.length("word") > 2).orderBy(F.col("n").desc(), "word").limit(DICTIONARY).select("word").collect()
    return Language(np.log2(count / count.sum(axis=1, keepdims=True)), frozenset(r["word"] for r in top))


def _transitions(low: str, language: Language) -> tuple[float, float]:
    """Mean and least log2 probability of the letter pairs of all runs of letters."""
    got = [language.pairs[LETTERS.index(x), LETTERS.index(y)] for run in re.findall("[a-z]+", low) for x, y in zip("^" + run, run + "$")]
    return (float(np.mean(got)), float(min(got))) if got else (0.0, 0.0)


def _covered(low: str, language: Language) -> float:
    """The share of characters that words of the dictionary cover."""
    hit = np.zeros(len(low), bool)
    for m in re.finditer("[a-z]{3,}", low):
        for k in range(m.start(), m.end() - 2):
            for end in range(min(m.end(), k + 12), k + 2, -1):
                if low[k:end] in language.words:
                    hit[k:end] = True
                    break
    return float(hit.mean()) if len(low) else 0.0


def neighbours(before: str, after: str) -> list[str]:
    """The words beside a candidate: up to four before, nearest first, and one after; parts of its path before a slash."""
    near = re.findall(r"[a-z0-9]+", before[-WINDOW:].lower())[:-5:-1]
    path = re.findall(r"[^\s\"'=:]*[/\\]$", before[-WINDOW:].lower())
    parts = [f"/{w}" for w in re.findall(r"[a-z0-9]+", path[0])] if path else []
    return [f"{k}<{w}" for k, w in enumerate(near[:2])] + [f"<{w}" for w in near] + [f">{w}" for w in re.findall(r"[a-z0-9]+", after[:WINDOW].lower())[:1]] + parts


def learn_odds(findings: list[tuple[str, str, str, int]]) -> dict[str, float]:
    """Log odds of a secret for each neighbour that at least TOLD findings have."""
    held = [Counter(w for b, _, a, y in findings if y == label for w in set(neighbours(b, a))) for label in (0, 1)]
    n = [sum(y == label for *_, y in findings) for label in (0, 1)]
    return {w: math.log((held[1][w] + 0.5) / (n[1] + 1)) - math.log((held[0][w] + 0.5) / (n[0] + 1)) for w in held[0] | held[1] if held[0][w] + held[1][w] >= TOLD}


def features(before: str, value: str, after: str, language: Language, odds: dict[str, float]) -> list[float]:
    n = len(value)
    kinds = [_class(c) for c in value]
    changes = sum(a != b for a, b in zip(kinds, kinds[1:])) / max(1, n - 1)
    entropy = -sum(k / n * math.log2(k / n) for k in Counter(value).values()) if n else 0.0
    low = value.lower()
    told = [odds[w] for w in dict.fromkeys(neighbours(before, after)) if w in odds]
    mean, least = _transitions(low, language)
    return [
        float(n),
        changes,
        entropy,
        entropy / math.log2(n) if n > 1 else 0.0,
        kinds.count(2) / max(1, n),
        kinds.count(1) / max(1, n),
        kinds.count(3) / max(1, n),
        sum(c in "aeiou" for c in low) / max(1, n),
        mean,
        least,
        _covered(low, language),
        float(all(c in "0123456789abcdefABCDEF" for c in value)),
        float(bool(re.fullmatch(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", value))),
        float(bool(FIXED.fullmatch(value))),
        float(value.count("/")),
        float(bool(re.search(r"[/\\@]$|https?:\S*$|www\.\S*$", before))),
        float(bool(re.search(r"[:=]\s*[\"']?$", before))),
        float(sum(told)),
        max(told, default=0.0),
        float(max((len(r) for r in re.findall(r"[a-z]+", value)), default=0)) / max(1, n),
    ]


def generated_findings(n: int = 4000, seed: int = 7, words: Sequence[str] = SYLLABLES) -> list[tuple[str, str, str, int]]:
    """(before, value, after, label): keys in public formats (1), and digests, ids, paths, names and versions (0)."""
    rng = random.Random(seed)
    pick = lambda letters, k: "".join(rng.choice(letters) for _ in range(k))
    words = sorted(words) or SYLLABLES
    word = lambda: rng.choice(words)
    hexa, alnum, b64 = "0123456789abcdef", string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/"
    prose = lambda: " ".join(word() for _ in range(rng.randint(0, 6)))
    uuid = lambda: "-".join(pick(hexa, k) for k in (8, 4, 4, 4, 12))
    out = []
    for k in range(n):
        quote = rng.choice(["", '"', "'"])
        sign = rng.choice(["=", ": ", " = ", ":", "= "])
        name = rng.choice(["password", "passwd", "secret", "token", "api_key", "apikey", "auth", "access_key", "db_password", "client_secret"])
        secret = [
            ("", "AKIA" + pick(string.ascii_uppercase + string.digits, 16), ""),
            ("", "ghp_" + pick(alnum, 36), ""),
            ("", "sk_live_" + pick(alnum, 24), ""),
            ("", "xoxb-" + pick(string.digits, 12) + "-" + pick(alnum, 24), ""),
            ("", "AIza" + pick(alnum + "-_", 35), ""),
            (f"{name}{sign}{quote}", pick(hexa, rng.choice([16, 18, 20, 24, 32, 40])), quote),
            (f"{name}{sign}{quote}", pick(b64, rng.choice([20, 32, 40, 44])), quote),
            (f"{name}{sign}{quote}", pick(alnum + "!$%&*#", rng.randint(10, 24)), quote),
            ("Authorization: Bearer ", "eyJ" + pick(alnum, 30) + "." + pick(alnum, 40) + "." + pick(alnum, 30), ""),
        ][k % 9]
        other = [
            (rng.choice(["commit ", "sha256:", "md5 ", "checksum: ", "hash=", "digest "]), pick(hexa, rng.choice([32, 40, 64])), ""),
            (rng.choice(["id=", "uuid: ", "", "request "]), uuid(), ""),
            ("", "/".join(word() for _ in range(rng.randint(3, 6))) + f"/{word()}{rng.randint(1, 99)}.html", ""),
            ("https://www.", f"{word()}.com/{word()}/{word()}-{rng.randint(100, 99999)}", ""),
            ("version ", f"{word()}-{rng.randint(0, 20)}.{rng.randint(0, 20)}.{rng.randint(0, 20)}-build{rng.randint(1, 999)}", ""),
            ("", f"{word()}_{word()}_{word()}{rng.randint(0, 99)}", ""),
            (f"{name}{sign}{quote}", rng.choice(["changeme", "example", "undefined", "required", "placeholder", "your_password_here", "xxxxxxxxxxxx", "<password>", "${PASSWORD}"]), quote),
            ("", f"{word()}{word()}.{rng.randint(1, 99)}@{word()}.example.com", ""),
            ("", "".join(w.capitalize() for w in (word(), word(), word(), word())), ""),
        ][k % 9]
        for (b, v, a), label in ((secret, 1), (other, 0)):
            out.append((f"{prose()} {b}"[-WINDOW:], v, f"{a} {prose()}"[:WINDOW], label))
    return out


@dataclass
class Forest:
    """Trees as flat arrays: a node sends x[feature] <= limit to left, else to right; feature -1 marks a leaf with its vote."""

    feature: np.ndarray
    limit: np.ndarray
    left: np.ndarray
    right: np.ndarray
    vote: np.ndarray
    roots: np.ndarray

    def probability(self, x: np.ndarray) -> np.ndarray:
        """The share of trees that vote for 1."""
        at = np.repeat(self.roots[None, :], len(x), axis=0)
        while True:
            inner = self.feature[at] >= 0
            if not inner.any():
                return self.vote[at].mean(axis=1)
            value = np.take_along_axis(x, np.maximum(self.feature[at], 0), axis=1)
            at = np.where(inner, np.where(value <= self.limit[at], self.left[at], self.right[at]), at)


_SPLIT = re.compile(r"If \(feature (\d+) <= (\S+)\)")
_LEAF = re.compile(r"Predict: (\S+)")


def _flat(described: str) -> Forest:
    """The forest that a trained model describes, line by line, in preorder."""
    rows: list[list[float]] = []
    roots, open_ = [], []  # open_: inner nodes that still miss a child

    def attach(node: int) -> None:
        if not open_:
            roots.append(node)
            return
        parent = open_[-1]
        if rows[parent][2] < 0:
            rows[parent][2] = node
        else:
            rows[parent][3] = node
            open_.pop()

    for line in described.splitlines():
        if m := _SPLIT.search(line):
            rows.append([int(m[1]), float(m[2]), -1, -1, 0.0])
            attach(len(rows) - 1)
            open_.append(len(rows) - 1)
        elif m := _LEAF.search(line):
            rows.append([-1, 0.0, -1, -1, float(m[1])])
            attach(len(rows) - 1)
    feature, limit, left, right, vote = map(np.array, zip(*rows))
    return Forest(feature.astype(int), limit, left.astype(int), right.astype(int), vote, np.array(roots))


@dataclass
class Model:
    forest: Forest
    language: Language
    odds: dict[str, float]

    def probability(self, found: list[tuple[str, str, str]]) -> np.ndarray:
        """The chance that each (before, value, after) is a secret."""
        return self.forest.probability(np.array([features(*f, self.language, self.odds) for f in found]).reshape(-1, FEATURES))


def train(docs: DataFrame, findings: list[tuple[str, str, str, int]] | None = None, text: str = "text", trees: int = 40, depth: int = 8, seed: int = 11) -> Model:
    """A model with the documents' language, from labelled findings; from generated ones if none are given."""
    language = learn_language(docs, text)
    findings = generated_findings(words=sorted(language.words)) if findings is None else findings
    odds = learn_odds(findings)
    rows = [(features(b, v, a, language, odds), float(y)) for b, v, a, y in findings]
    data = docs.sparkSession.createDataFrame(rows, "features array<double>, label double").select(array_to_vector("features").alias("features"), "label")
    return Model(_flat(RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featuresCol="features", labelCol="label").fit(data).toDebugString), language, odds)


def scan(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """docs with `candidates` (how many) and `secrets`: spans, values and probabilities of those the forest keeps."""
    free_of(docs, "candidates", "secrets")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most trees * 2 ** (depth + 1) nodes and DICTIONARY words
    item = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("value", pa.string()), ("probability", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_py() or "" for t in batch.column(text)]
            spans = [candidates(t) for t in texts]
            chance = iter(shared.value.probability([(t[max(0, a - WINDOW) : a], t[a:b], t[b : b + WINDOW]) for t, s in zip(texts, spans) for a, b in s]).tolist())
            kept = [[{"start": a, "end": b, "value": t[a:b], "probability": p} for a, b in s if (p := next(chance)) >= threshold] for t, s in zip(texts, spans)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(map(len, spans)), pa.int64()), pa.array(kept, pa.list_(item))], names=[*batch.schema.names, "candidates", "secrets"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("candidates", T.LongType()), T.StructField("secrets", FOUND)]))

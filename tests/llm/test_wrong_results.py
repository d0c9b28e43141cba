"""Results that were wrong once."""

import random
import time
import zlib

import pytest
from pyspark.sql import functions as F

from pelagos.llm import line_dedup, media, pii, secrets, sentencepiece_bpe, topk, toxicity


def page(body: bytes, flags: int = 0) -> bytes:
    return b"OggS\0" + bytes([flags]) + bytes(20) + bytes([1, len(body)]) + body


def test_pages_of_a_stream_are_no_media(spark):
    raw = page(b"0123456789") * 3
    assert media.sniff(raw) == [("audio/ogg", 0, len(raw))]
    inner = media.wav(b"x" * 64)
    held = page(inner) + page(b"more")
    assert media.sniff(b"ab" + held) == [("audio/ogg", 2, len(held)), ("audio/wav", 30, len(inner))]
    rows = media.carve(spark.createDataFrame([(1, bytearray(held))], "k int, media binary")).collect()
    assert sorted((r["kind"], r["start"]) for r in rows) == [("audio/ogg", 0), ("audio/wav", 28)]


def chunk(name: bytes, data: bytes = b"", crc: int | None = None) -> bytes:
    return len(data).to_bytes(4, "big") + name + data + (zlib.crc32(name + data) if crc is None else crc).to_bytes(4, "big")


SIGN = b"\x89PNG\r\n\x1a\n"


def test_png_chunks():
    rng = random.Random(1)
    good = SIGN + chunk(b"IHDR", bytes(13)) + chunk(b"IDAT", rng.randbytes(100_000)) + chunk(b"IEND")
    assert media.sniff(b"xy" + good + b"tail") == [("image/png", 2, len(good))]
    assert media.sniff(good[:50_000] + b"?" + good[50_001:]) == []  # a CRC over a long range
    assert media.sniff(SIGN + chunk(b"IHDR", bytes(12)) + chunk(b"IEND")) == []
    assert media.sniff(SIGN + chunk(b"IHDR", bytes(13)) + chunk(b"IHDR", bytes(13)) + chunk(b"IEND")) == []
    assert media.sniff(SIGN + chunk(b"IHDR", bytes(13)) + chunk(b"IDAT", b"x", 7) + chunk(b"IEND")) == []


def test_png_validation_does_not_grow_with_the_square():
    """Each signature has a chunk that reaches almost to the end, where one IEND serves all."""

    def hostile(n: int) -> bytes:
        unit = len(SIGN) + 25 + 8
        parts = [SIGN + chunk(b"IHDR", bytes(13)) + (unit * (n - k - 1) + 4096).to_bytes(4, "big") + b"IDAT" for k in range(n)]
        return b"".join(parts) + bytes(4096) + bytes(4) + chunk(b"IEND")

    took = []
    for n in (4000, 16_000):
        data = hostile(n)
        began = time.process_time()
        assert media.sniff(data) == []
        took.append(time.process_time() - began)
    assert took[1] < 9 * max(took[0], 0.05), took


@pytest.mark.parametrize("n", [0, 1, 5000, 20_000, 70_000])
def test_crcs_of_ranges(n):
    d = random.Random(n).randbytes(90_000)
    crcs = media._Crcs(d)
    for a in (0, 1, 4096, 12_345):
        assert crcs.of(a, a + n) == zlib.crc32(d[a : a + n])


def test_scores_beyond_64_bits(spark):
    low = -(2.0**63) / 256
    rows = [(50, [low, low]), (1, [low, low]), (2, [1.0, 1.0])]
    got = {r["vec_id"]: r["score"] for r in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 50).collect()}
    assert got == {1: 2**63 - 1, 2: -(2**63) + 1}


@pytest.mark.parametrize("name", ["N_LINES", "Score", "PREDICTED", "Base", "Candidates", "IDS", "Media", "N_Bytes"])
def test_clashing_names_in_another_case(spark, name):
    docs = spark.createDataFrame([(1, "some text")], "doc_id long, text string").withColumn(name, F.lit(1))
    model = toxicity.Model(None, None, 0.0, 0.0, 0.5)
    calls = {
        "n_lines": lambda: line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs)), "score": lambda: toxicity.score_toxicity(docs, model), "predicted": lambda: toxicity.score_toxicity(docs, model),
        "base": lambda: pii.find_private(docs), "candidates": lambda: secrets.scan(docs, None), "ids": lambda: sentencepiece_bpe.encode_text(docs, b""), "media": lambda: media.store_texts(docs), "n_bytes": lambda: media.store_texts(docs),
    }
    with pytest.raises(ValueError, match="already has a column"):
        calls[name.lower()]()

"""Words are hashed in bulk, and a linked graph that is settled is not gone through again."""

import re

import numpy as np

from pelagos.llm import minhash_dedup


def test_words_are_those_of_the_expression(monkeypatch):
    monkeypatch.setattr(minhash_dedup, "STEP_CHARS", 8)
    texts = ["", "a", "One two  three", "x_y ½ ² ١٢ 漢字", "İstanbul ß\n", " a " * 30, "b" * 700 + " " + "b" * 699 + "c"]
    seen = {}
    for text in texts:
        low = text.lower()
        start, found = minhash_dedup.word_hashes(low)
        words = list(re.finditer(r"\w+", low))
        assert start.tolist() == [m.start() for m in words]
        for m, h in zip(words, found.tolist()):
            assert seen.setdefault(m.group(), h) == h
    assert len(set(seen.values())) == len(seen)


def test_bags_count_shingles():
    texts = ["a b c d e a b c d e", "", "a b", "a b c d e", "A, B", "b a"]
    text, shingle, weight = minhash_dedup.bags_of(texts)
    assert np.bincount(text, weights=weight, minlength=6).tolist() == [6, 0, 1, 1, 1, 1]
    of = lambda k: set(shingle[text == k].tolist())
    assert of(3) < of(0) and of(2) == of(4) != of(5) and weight[text == 0].max() == 2


def test_settled_stars_are_written_once(spark, monkeypatch):
    names, real = [], minhash_dedup.written
    monkeypatch.setattr(minhash_dedup, "written", lambda df, name: names.append(name) or real(df, name))
    edges = spark.createDataFrame([(2, 1), (3, 1), (7, 5)], "u long, v long")
    assert sorted(map(tuple, minhash_dedup.components(edges).collect())) == [(2, 1), (3, 1), (7, 5)]
    assert names == ["stars"]  # twice before: one more round told that nothing changed
    chain = spark.createDataFrame([(k + 1, k) for k in range(40)] + [(9, 3), (60, 50), (60, 55)], "u long, v long")
    assert sorted(map(tuple, minhash_dedup.components(chain).collect())) == [(k, 0) for k in range(1, 41)] + [(55, 50), (60, 50)]

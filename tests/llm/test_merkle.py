"""op12: equal to a tree built level by level in plain Python."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from pelagos.llm import merkle
from pelagos.llm.queries import op12_merkle


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(doc_id, source, lang, n_chars, text):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)])


def tree(leaves):
    """(root, siblings of each leaf upwards) with (sibling or None, left)."""
    paths, nodes, at = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(nodes) > 1:
        for k, a in enumerate(at):
            mate = a ^ 1
            paths[k].append((nodes[mate] if mate < len(nodes) else None, mate < a))
        nodes = [h(*nodes[k : k + 2]) for k in range(0, len(nodes), 2)]
        at = [a // 2 for a in at]
    return nodes[0], paths


def brute(rows):
    """rows: (doc_id, source, lang, n_chars, text)"""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    members, subroots, out = {}, [], []
    for g in names:
        members[g] = sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(*r)))
        subroots.append(tree([leaf_of(*r) for r in members[g]]))
    root, tops = tree([s for s, _ in subroots])
    for g, (sub, paths), top in zip(names, subroots, tops):
        for r, path in zip(members[g], paths):
            path = path + top
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None
            node = leaf_of(*r[:3], r[3] + 1, r[4]) if tampered else leaf_of(*r)
            for mate, left in path:
                node = h(node) if mate is None else h(mate, node) if left else h(node, mate)
            out.append((r[0], leaf_of(*r), sub, root, h(*[m for m, _ in path if m]), node, node == root))
    return sorted(out, key=str)


def run(spark, rows, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").write.parquet(f"{path}/documents.parquet")
    return sorted(map(tuple, op12_merkle(spark, path).collect()), key=str)


def test_query_equals_a_plain_tree(spark, sf, docs):
    rows = [tuple(r) for r in docs.select("doc_id", "source", "lang", "n_chars", "text").collect()]
    got = sorted(map(tuple, op12_merkle(spark, sf).collect()), key=str)
    assert got == brute(rows) and {g[-1] for g in got} == {True, False}


@pytest.mark.parametrize("n", [1, 2, 3, 7, 300])
def test_trees_of_all_sizes_and_many_groups(spark, tmp_path, n):
    rows = [(k, None, [None, "en", "", "é", "z"][k % 5] if n < 300 else "en" if k % 3 else f"g{k:03d}", k if k % 4 else None, f"t{k}") for k in range(n)]
    assert run(spark, rows, tmp_path) == brute(rows)


def test_more_levels_than_a_block_holds(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(merkle, "LEVELS", 2)
    rows = [(k * 3, "s", "en" if k % 10 else "fr", k, "x") for k in range(77)]
    assert run(spark, rows, tmp_path) == brute(rows)


def test_awkward_rows(spark, awkward, tmp_path):
    rows = [tuple(r) for r in awkward.select("doc_id", "source", "lang", "n_chars", "text").collect()] + [(None, None, None, None, None)] * 2
    assert run(spark, rows, tmp_path) == brute(rows)


def test_empty_table_and_extra_columns(spark, empty, docs):
    leaf = merkle.digest(merkle.preimage(F.col("doc_id"), F.col("text")))
    none = F.lit(None).cast("string")
    assert merkle.manifest(empty, "lang", "doc_id", leaf, none).count() == 0
    extra = docs.withColumns({c: F.lit(1) for c in ("node", "path", "place", "n", "g", "run", "met", "_at", "root")})
    got = merkle.manifest(extra, "lang", "doc_id", leaf, none)
    assert got.filter("verified").count() == docs.count()

"""The queries of this subpackage: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pelagos.llm import hard_negatives, line_dedup, lm_score, media, merkle, minhash_dedup, packing, pii, secrets, sentencepiece_bpe, token_files, topk, toxicity
from pelagos.llm.tables import read, text_of, written

MODEL, WORD_MODEL = "piece_bpe_32k.model", "word_bpe_49k.json"


def _digest(col: str):
    return F.sha2(F.col(col).cast("binary"), 256)


def _remainder(n: int):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def op1_sentencepiece(spark: SparkSession, sf_dir: str, model_path: str | None = None) -> DataFrame:
    if model_path is None:
        import public_tokenizers

        model_path = public_tokenizers.path(MODEL)
    model = Path(model_path).read_bytes()
    coded = sentencepiece_bpe.encode_text(read(spark, sf_dir, "documents").select("doc_id", "text"), model, keep_text=False, decoded="decoded")
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"), _digest("decoded").alias("decoded_sha256")
    )


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = media.store_texts(read(spark, sf_dir, "documents").select("doc_id", "text", F.lit("application/octet-stream").alias("declared")))
    done = media.sample_features(media.sniff_media(stored, declared="declared"))
    return done.select(
        "doc_id",
        "n_bytes",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -64, 64)).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_private(read(spark, sf_dir, "documents").select("doc_id", "text"), everywhere=True)
    counts = [F.size(F.filter("base", pii.of_kind(k))).cast("long").alias(f"n_{k}") for k in pii.PATTERNS]
    return found.select("doc_id", *counts, F.sha2(pii.spelt(F.col("base")).cast("binary"), 256).alias("base_sha256"), pii.spelt(F.concat("base", "terms")).alias("spans"))


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    kept = line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(text_of().cast("binary"), 256).alias("kept_sha256"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    classes = minhash_dedup.near_duplicates(docs.select("doc_id", "text")).groupBy("doc_id").agg(F.min("class_id").alias("class_id"))
    # what packing needs to know of a text is a number each; texts themselves meet no classes
    sized = docs.select("doc_id", "source", packing.n_words().alias("words"), F.xxhash64(text_of()).alias("same"), F.xxhash64("doc_id", text_of()).alias("deal"))
    classed = written(sized.join(classes, "doc_id", "left"), "classed")
    # rows without an id have no class of their own: equal texts lend them theirs
    lent = classed.filter("class_id IS NOT NULL").groupBy("same").agg(F.min("class_id").alias("lent"))
    orphans = classed.filter("doc_id IS NULL").join(lent, "same", "left")
    rows = classed.filter("doc_id IS NOT NULL").withColumn("lent", F.lit(None).cast("long")).unionByName(orphans)
    return packing.best_fit(rows, length=F.col("words"), cluster=F.coalesce("class_id", "lent", "same"), deal=F.col("deal"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.scan(docs, secrets.train(docs))
    spelt = F.array_join(F.transform("secrets", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select("doc_id", "candidates", F.size("secrets").cast("long").alias("n_secrets"), spelt.alias("spans"))


def training_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All labels but those of the held-out fifth."""
    return read(spark, sf_dir, "labels").filter(_remainder(5) != 0).select("doc_id", "toxic")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score_toxicity(docs, toxicity.train(docs, training_labels(spark, sf_dir)))
    return scored.select("doc_id", (_remainder(5) == 0).alias("held_out"), "score", "predicted")


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score_texts(read(spark, sf_dir, "documents").select("doc_id", "text"), _remainder(10) != 0)


def op11_token_files(spark: SparkSession, sf_dir: str, model_path: str | None = None) -> DataFrame:
    if model_path is None:
        import public_tokenizers

        model_path = public_tokenizers.path(WORD_MODEL)
    path = token_files.new_folder(spark, "token-files")
    token_files.write_tokens(read(spark, sf_dir, "documents"), path, Path(model_path).read_text(), end_id=2)
    return token_files.read_tokens(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    leaf = lambda n_chars: merkle.digest(merkle.preimage(F.col("doc_id"), F.col("source"), F.col("lang"), n_chars, F.col("text")))
    tampered = F.when((_remainder(7) == 0) & F.col("n_chars").isNotNull(), leaf(F.col("n_chars") + 1))
    return merkle.manifest(docs, "lang", "doc_id", leaf(F.col("n_chars")), tampered)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(read(spark, sf_dir, "embeddings").withColumn("label", label), F.col("vec_id") % 50 == 0)


def queries() -> dict:
    return {f.__name__: f for f in (op1_sentencepiece, op2_media, op3_pii, op4_minhash, op5_line_dedup, op6_packing, op7_secrets, op8_toxicity, op9_topk, op10_lm_score, op11_token_files, op12_merkle, op13_hard_negatives)}


def oracle_sql() -> dict[str, str]:
    return {
        "op5_line_dedup": r"""
            WITH lines AS (
              SELECT doc_id, pos, line, translate(trim(line, E' \t\n\x0B\x0C\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
              FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), E'\n')) AS line, unnest(range(len(string_split(coalesce(text, ''), E'\n')))) AS pos FROM documents)),
            dup AS (SELECT key, max(doc_id) AS keeper FROM lines WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
            marked AS (SELECT l.doc_id, l.pos, l.line, d.key IS NOT NULL AND l.doc_id <> d.keeper AS gone FROM lines l LEFT JOIN dup d USING (key))
            SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
                   sha256(coalesce(string_agg(line, E'\n' ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
            FROM marked GROUP BY doc_id""",
        "op9_topk": """
            WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * x::DOUBLE) AS BIGINT)) AS e FROM embeddings
                       WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
            s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
                  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
            r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
            SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
        "op12_merkle": """
            WITH RECURSIVE marked AS (
              SELECT *, list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::UBIGINT)),
                lambda c, b: list_reduce(list_prepend(xor(c, b), list_transform(range(8), lambda i: 0::UBIGINT)), lambda x, i: xor(x >> 1, 3988292384::UBIGINT * (x & 1::UBIGINT)))) AS crc FROM documents),
            spelt AS (SELECT doc_id, lang, n_chars IS NOT NULL AND xor(crc, 4294967295::UBIGINT) % 7 = 0 AS bad,
                {d} || {s} || {l} AS head, {n} AS n, {n1} AS n1, {t} AS tail FROM marked),
            leaves AS (SELECT doc_id, lang, CASE WHEN lang IS NULL THEN '' ELSE '+' || lang END AS g, sha256(head || n || tail) AS leaf, CASE WHEN bad THEN sha256(head || n1 || tail) ELSE sha256(head || n || tail) END AS other FROM spelt),
            placed AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS size FROM leaves),
            up AS (SELECT g, 0 AS level, pos, leaf AS node, size FROM placed
                   UNION ALL SELECT g, level + 1, pos // 2, sha256(string_agg(node, '' ORDER BY pos)), any_value((size + 1) // 2) FROM up WHERE size > 1 GROUP BY g, level, pos // 2),
            subroots AS (SELECT g, node AS subroot, row_number() OVER (ORDER BY encode(g)) - 1 AS pos, count(*) OVER () AS size FROM up WHERE size = 1),
            top AS (SELECT 0 AS level, pos, subroot AS node, size FROM subroots
                    UNION ALL SELECT level + 1, pos // 2, sha256(string_agg(node, '' ORDER BY pos)), any_value((size + 1) // 2) FROM top WHERE size > 1 GROUP BY level, pos // 2),
            steps AS (
              SELECT p.doc_id, p.leaf, u.level AS step, (p.pos >> u.level) % 2 AS side, m.node AS mate FROM placed p JOIN up u ON u.g = p.g AND u.size > 1 AND u.pos = p.pos >> u.level
                LEFT JOIN up m ON m.g = u.g AND m.level = u.level AND m.pos = xor(u.pos, 1)
              UNION ALL
              SELECT p.doc_id, p.leaf, 1000 + t.level, (s.pos >> t.level) % 2, m.node FROM placed p JOIN subroots s USING (g) JOIN top t ON t.size > 1 AND t.pos = s.pos >> t.level LEFT JOIN top m ON m.level = t.level AND m.pos = xor(t.pos, 1)),
            paths AS (SELECT p.doc_id, p.leaf, any_value(p.other) AS other, any_value(p.g) AS g, coalesce(list({{side: s.side, mate: s.mate}} ORDER BY s.step) FILTER (WHERE s.step IS NOT NULL), []) AS path
                      FROM placed p LEFT JOIN steps s ON s.doc_id IS NOT DISTINCT FROM p.doc_id AND s.leaf = p.leaf GROUP BY p.doc_id, p.leaf, p.pos),
            fold AS (SELECT doc_id, leaf, g, path, 1 AS k, other AS node FROM paths
                     UNION ALL SELECT doc_id, leaf, g, path, k + 1, sha256(CASE WHEN path[k].side = 1 THEN coalesce(path[k].mate, '') || node ELSE node || coalesce(path[k].mate, '') END) FROM fold WHERE k <= len(path))
            SELECT f.doc_id, f.leaf, s.subroot, r.node AS root, sha256(list_aggregate(list_prepend('', list_filter(list_transform(f.path, lambda x: x.mate), lambda x: x IS NOT NULL)), 'string_agg', '')) AS proof_sha256,
                   f.node AS folded_root, f.node = r.node AS verified
            FROM fold f JOIN subroots s USING (g) CROSS JOIN (SELECT node FROM top WHERE size = 1) r WHERE f.k = len(f.path) + 1""".format(
            **{name: f"CASE WHEN {c} IS NULL THEN '-' ELSE octet_length(encode({v}::VARCHAR)) || ':' || {v} END" for name, c, v in (("d", "doc_id", "doc_id"), ("s", "source", "source"), ("l", "lang", "lang"), ("n", "n_chars", "n_chars"), ("n1", "n_chars", "(n_chars + 1)"), ("t", "text", "text"))}
        ),
        "op13_hard_negatives": """
            WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * x::DOUBLE) AS BIGINT)) AS e FROM embeddings
                       WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
            s AS (SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, CAST(list_sum(list_transform(list_zip(a.e, r.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
                  FROM v a JOIN v r ON a.vec_id % 50 = 0 AND len(a.e) = len(r.e)),
            p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same AND anchor_id <> vec_id QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
            n AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
                  FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
            SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3""",
    }

"""The registered queries of the corpus operators, with production parameters over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.llm import byte_bpe, conversation_repair, hard_negatives, lang_id, line_dedup, mixing, ngram_join, quality, simhash, substring_dedup, token_store, topk, toxicity
from siftwell.llm.shared import table


def _fold(n: int):
    return F.crc32(F.col("doc_id").cast("string")) % n


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"), n=5, similarity=0.8, recall=0.9999)


def op2_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.quantised(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    found = topk.search(vectors, vectors.filter("key % 20 = 0"), k=20)
    return found.select("query_id", "rank", F.col("key").alias("vec_id"), "score")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.apply(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.decisions(table(spark, sf_dir, "documents"))
    return found.withColumn("prob", F.round("prob", 6))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A null doc_id belongs to no fold: it is not learned from and not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    models = lang_id.fit(docs.filter(_fold(3) != 1))
    found = lang_id.identify(docs.select("doc_id", "text"), models)
    return found.select("doc_id", F.coalesce(_fold(3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.removed_lines(table(spark, sf_dir, "documents"), similarity=0.8)
    return found.select(F.col("key").alias("doc_id"), "line", F.col("keep_key").alias("keep_doc_id"), "keep_line")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.repeated(table(spark, sf_dir, "documents"))
    return found.select(F.col("key").alias("doc_id"), "start", "stop", "n_words", F.col("first_key").alias("first_doc_id"))


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    store = token_store.write(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    found = store.read(store.lookup(token_store.all_keys(docs)))
    return found.select(F.col("key").alias("doc_id"), "start", F.col("length").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.digests(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A null doc_id belongs to no fold: it is not learned from and not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    machine = toxicity.fit(docs, table(spark, sf_dir, "labels").filter(_fold(5) != 0))
    found = toxicity.score(docs, machine)
    return found.select("doc_id", F.coalesce(_fold(5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(vectors.withColumn("label", label), lambda vec_id: vec_id % 100 == 0)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repaired_conversations(table(spark, sf_dir, "conversations"))


def op13_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), radius=4)
    return found.select(F.col("key").alias("doc_id"), "fingerprint", "component_id", "n_copies")


QUERIES = {"op1_ngram_join": op1_ngram_join, "op2_topk_search": op2_topk_search, "op3_quality_rules": op3_quality_rules, "op4_mixing": op4_mixing, "op5_language_id": op5_language_id, "op6_line_dedup": op6_line_dedup, "op7_substring_dedup": op7_substring_dedup, "op8_token_store": op8_token_store, "op9_byte_bpe": op9_byte_bpe, "op10_toxicity": op10_toxicity, "op11_hard_negatives": op11_hard_negatives, "op12_conversation_repair": op12_conversation_repair, "op13_simhash_dedup": op13_simhash_dedup}
ORACLES: dict[str, str] = {
    "op2_topk_search": """
        WITH clean AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND vec_id IS NOT NULL
        ), scored AS (
            SELECT q.vec_id AS query_id, d.vec_id, list_inner_product(q.v, d.v)::BIGINT AS score
            FROM clean q JOIN clean d ON q.vec_id <> d.vec_id WHERE q.vec_id % 20 = 0
        ), ranked AS (
            SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM scored
        )
        SELECT query_id, r::INTEGER AS "rank", vec_id, score FROM ranked WHERE r <= 20""",
    "op4_mixing": mixing.oracle(),
    "op11_hard_negatives": """
        WITH clean AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND vec_id IS NOT NULL AND label IS NOT NULL
        ), scored AS (
            SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
            FROM clean a JOIN clean b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
        ), positive AS (
            SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
        )
        SELECT anchor_id, positive_id, row_number() OVER w::INTEGER AS "rank", n.vec_id AS negative_id, positive_score, n.score AS negative_score
        FROM positive JOIN scored n USING (anchor_id)
        WHERE NOT same AND 30 * positive_score <= 100 * n.score AND 100 * n.score <= 90 * positive_score
        WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY n.score DESC, n.vec_id) QUALIFY row_number() OVER w <= 10""",
    "op12_conversation_repair": """
        WITH RECURSIVE keyed AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ord(x)::BIGINT) AS codes
            FROM conversations
        ), hashed AS (
            SELECT *, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, codes), lambda s, b: list_reduce(list_prepend(xor(s, b), range(8)),
                lambda t, i: CASE WHEN t % 2 = 1 THEN xor(t // 2, 3988292384) ELSE t // 2 END))) % 20 AS fault FROM keyed
        ), damaged AS (
            SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
                CASE fault WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
                unnest(CASE WHEN fault = 3 THEN [1, 2] ELSE [1] END) AS copy
            FROM hashed WHERE fault <> 0
        ), placed AS (
            SELECT *, dense_rank() OVER (ORDER BY conv_id) AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
                rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare, left(role, 1) AS initial FROM damaged
        ), judged AS (
            SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 THEN 'duplicate'
                WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault, lag(initial) OVER (PARTITION BY c ORDER BY i) || initial AS two FROM placed
        ), added(s, letters, paid, t, lines) AS (
            VALUES (0, '', 0, 0, []::VARCHAR[]), (1, '', 0, 1, []), (2, '', 0, 2, []), (3, '', 0, 3, []), (0, 'I', 3, 2, ['user:']), (1, 'I', 3, 2, ['user:']),
                (2, 'I', 3, 3, ['assistant:']), (3, 'I', 3, 2, ['user:']), (0, 'II', 6, 3, ['user:', 'assistant:']), (1, 'II', 6, 3, ['user:', 'assistant:']),
                (2, 'II', 6, 2, ['assistant:', 'user:']), (3, 'II', 6, 3, ['user:', 'assistant:'])
        ), allowed(s, edit, initial, t, role) AS (
            VALUES (0, 'K', 's', 1, ''), (0, 'K', 'u', 2, ''), (1, 'K', 'u', 2, ''), (2, 'K', 'a', 3, ''), (3, 'K', 'u', 2, ''), (0, 'R', '', 2, 'user'),
                (1, 'R', '', 2, 'user'), (2, 'R', '', 3, 'assistant'), (3, 'R', '', 2, 'user'), (0, 'D', '', 0, ''), (1, 'D', '', 1, ''), (2, 'D', '', 2, ''), (3, 'D', '', 3, '')
        ), steps(c, i, s, cost, audit, lines) AS (
            SELECT DISTINCT c, 0::BIGINT, 0, 0, '', []::VARCHAR[] FROM placed
            UNION ALL
            SELECT p.c, p.i + 1, e.t, p.cost + a.paid + CASE e.edit WHEN 'D' THEN 4 WHEN 'R' THEN 3 ELSE 0 END + CASE WHEN e.edit <> 'D' AND r.fault = 'truncated' THEN 3 ELSE 0 END AS spent,
                p.audit || a.letters || e.edit AS edits, list_concat(p.lines, a.lines, CASE e.edit WHEN 'D' THEN []::VARCHAR[] WHEN 'R' THEN [e.role || ':' || r.text] ELSE [r.role || ':' || r.text] END)
            FROM steps p JOIN judged r ON r.c = p.c AND r.i = p.i + 1 JOIN added a ON a.s = p.s JOIN allowed e ON e.s = a.t
            WHERE (e.edit = 'D' OR r.fault NOT IN ('blank', 'duplicate')) AND (e.edit <> 'K' OR e.initial = r.initial)
            QUALIFY row_number() OVER (PARTITION BY p.c, p.i, e.t ORDER BY spent, edits) = 1
        ), ended AS (
            SELECT p.c, p.cost + a.paid AS cost, p.audit || a.letters AS audit, sha256(array_to_string(list_concat(p.lines, a.lines), chr(10))) AS repaired_sha256
            FROM steps p JOIN added a USING (s) JOIN (SELECT c, max(i) AS i FROM placed GROUP BY c) USING (c, i) WHERE a.t IN (0, 3)
            QUALIFY row_number() OVER (PARTITION BY p.c ORDER BY p.cost + a.paid, p.audit || a.letters) = 1
        ), counted AS (
            SELECT any_value(conv_id) AS conv_id, c, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count_if(fault = 'blank') AS blank, count_if(fault = 'duplicate') AS duplicate,
                count_if(fault = 'truncated') AS truncated, count_if(two NOT IN ('su', 'ua', 'au')) AS illegal FROM judged GROUP BY c
        )
        SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
            coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, coalesce(repaired_sha256, sha256('')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN (counted JOIN ended USING (c)) f ON o.conv_id IS NOT DISTINCT FROM f.conv_id""",
}

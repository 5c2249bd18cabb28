"""Thin queries over the driver's tables, one for each operator of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import alignment, embed_dedup, imatch, langid, lexical, packing, pieces, quality, simhash, token_counts, toxicity, url_filter, warc
from cairn.sources.tables import table


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def fold(by: int, id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo ``by``."""
    return F.crc32(F.col(id_col).cast("string")) % by


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = table(spark, sf_dir, "documents"), F.coalesce(fold(5) == 0, F.lit(False))
    scored = quality.score(docs, table(spark, sf_dir, "labels"), ~held)
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= quality.LIMIT).cast("int").alias("predicted"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = table(spark, sf_dir, "documents"), F.coalesce(fold(5) == 0, F.lit(False))
    scored = toxicity.score(docs, table(spark, sf_dir, "labels"), ~held)
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= toxicity.LIMIT).cast("int").alias("predicted"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op7_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.edited_and_next(table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.read_archives(warc.archive(table(spark, sf_dir, "pages")))
    page = lambda c: F.when(F.col(c).startswith("urn:page:"), F.substring_index(c, ":", -1).cast("bigint"))
    return read.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = table(spark, sf_dir, "documents"), F.coalesce(fold(4) == 2, F.lit(False))
    found = langid.identify(docs, tokenizer_file("piece_bpe_32k.model"), ~held)
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(lexical.build(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_url_filter, op2_simhash, op3_sentencepiece, op4_quality, op5_toxicity, op6_embedding_dedup, op7_imatch, op8_packing, op9_warc, op10_language_id, op11_token_counts, op12_alignment, op13_lexical_search]
    return {f.__name__: f for f in found}


#: DuckDB forms where SQL can express the whole result.
ORACLE_SQL: dict[str, str] = {
    "op9_warc": """
        SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest,
               CASE WHEN f IS NULL OR f = page_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN f <> page_id THEN f END AS refers_to
        FROM (SELECT page_id, html, CASE WHEN octet_length(encode(coalesce(html, ''))) >= 100
                     THEN min(page_id) OVER (PARTITION BY sha256(coalesce(html, ''))) END AS f FROM pages)
    """,
    "op13_lexical_search": r"""
        WITH t AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
        size AS (SELECT doc_id, count(*) AS n FROM t GROUP BY 1), total AS (SELECT count(*) AS nn, sum(n)::BIGINT AS ll FROM size),
        post AS (SELECT term, doc_id, count(*) AS tf FROM t GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM post GROUP BY 1),
        q AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
        s AS (SELECT item_id, doc_id, sum(floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * df + 1)))::BIGINT * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * nn) // ll))))::BIGINT AS score
              FROM q JOIN df USING (term) JOIN post USING (term) JOIN size USING (doc_id), total GROUP BY 1, 2)
        SELECT item_id, rank::INT AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 20
    """,
    "op6_embedding_dedup": """
        WITH RECURSIVE good AS (
            SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
            WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_sum(list_transform(embedding, lambda x: abs(x))) > 0),
        link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.9),
        reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
        comp AS (SELECT a, min(b) AS c FROM reach GROUP BY a)
        SELECT e.vec_id, (SELECT count(*) FROM link WHERE link.a = e.vec_id) AS n_links, comp.c AS component_id, e.vec_id = comp.c AS kept
        FROM embeddings e JOIN comp ON comp.a = e.vec_id
    """,
}

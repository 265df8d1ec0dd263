"""Queries over the training-data tables: each applies an operator with production parameters to its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessel.llm import decontaminate, language_id, lexical, line_dedup, media, mixing, ppm, quality, simhash, superminhash, token_store, url_filter, whitening
from tessel.llm.common import table

#: Rules of the URL query.
URL_RULES = [
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
]
MIX_WEIGHTS, MIX_SHARE, MIX_CAP = [3, 1, 2], 1.5, 2.0


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def fold(id_col: str = "doc_id"):
    """crc32 of the id as text, mod 5; null for a null id."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5))


def op1_simhash_dedup(spark, sf_dir):
    return simhash.simhash_groups(table(spark, sf_dir, "documents"), width=4, radius=4)


def op2_media_transport_stream(spark, sf_dir):
    points = [F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("pts", "pts_offset", "random_access")]
    return media.media_digests(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", *points)


def op3_url_filter(spark, sf_dir):
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op4_mix_sources(spark, sf_dir):
    return mixing.mix_sources(table(spark, sf_dir, "documents"), MIX_WEIGHTS, MIX_SHARE, MIX_CAP).select("doc_id", "size", "source_size", "target", "taken")


def op5_quality_classifier(spark, sf_dir):
    return quality.classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_lm_scoring(spark, sf_dir):
    return ppm.score_documents(table(spark, sf_dir, "documents"), fold() == 1)


def op7_token_ids(spark, sf_dir):
    return token_store.token_digests(table(spark, sf_dir, "documents"), tokenizer_path(), end_id=1)


def op8_line_dedup(spark, sf_dir):
    return line_dedup.drop_recurring_lines(table(spark, sf_dir, "documents")).withColumn("dropped", F.array_join(F.col("dropped").cast("array<string>"), ","))


def op9_decontaminate(spark, sf_dir):
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_language_id(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    pred = language_id.identify_language(documents.withColumn("held_out", F.coalesce(fold() == 0, F.lit(False))), ~F.coalesce(fold() == 0, F.lit(False)), tokenizer_path("piece_bpe_32k.model"))
    return pred.select("doc_id", F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op11_lexical_search(spark, sf_dir):
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


def op12_superminhash_dedup(spark, sf_dir):
    return superminhash.near_duplicate_groups(table(spark, sf_dir, "documents"))


def op13_whitening(spark, sf_dir):
    out = whitening.whiten(table(spark, sf_dir, "embeddings"))
    return out.withColumn("deviation", F.expr("try_cast(deviation AS long)"))


QUERIES = {f.__name__: f for f in (op1_simhash_dedup, op2_media_transport_stream, op3_url_filter, op4_mix_sources, op5_quality_classifier, op6_lm_scoring, op7_token_ids, op8_line_dedup, op9_decontaminate, op10_language_id, op11_lexical_search, op12_superminhash_dedup, op13_whitening)}

ORACLE_SQL = {
    "op3_url_filter": r"""
        WITH parts AS (
            SELECT page_id,
                   translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
            FROM pages),
        ruled AS (
            SELECT page_id, host, path,
                   CASE WHEN ends_with('.' || host, '.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
                        WHEN ends_with('.' || host, '.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
                        WHEN ends_with('.' || host, '.net') AND starts_with(path, '/es/') THEN 'net/es/'
                        WHEN ends_with('.' || host, '.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
                        WHEN ends_with('.' || host, '.com') AND starts_with(path, '/') THEN 'com/' END AS rule
            FROM parts)
        SELECT page_id, host, path, rule,
               CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' ELSE 'allow' END AS verdict
        FROM ruled""",
    "op11_lexical_search": r"""
        WITH words AS (
            SELECT doc_id, row_number() OVER () AS doc, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9A-Za-z\x{80}-\x{10FFFF}]+') AS terms
            FROM documents WHERE text IS NOT NULL),
        docs AS (SELECT doc_id, doc, terms, len(terms) AS n FROM words WHERE len(terms) > 0),
        totals AS (SELECT count(*) AS docs, sum(n)::BIGINT AS length FROM docs),
        tfs AS (SELECT doc, term, count(*) AS tf FROM (SELECT doc, unnest(terms) AS term FROM docs) GROUP BY ALL),
        weights AS (SELECT term, floor(1000 * ln((2.0::DOUBLE * any_value(t.docs) + 2) / (2.0::DOUBLE * count(*) + 1)))::BIGINT AS w FROM tfs, totals t GROUP BY term),
        items AS (
            SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9A-Za-z\x{80}-\x{10FFFF}]+')) AS term
            FROM benchmark),
        scores AS (
            SELECT item_id, doc_id, doc, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * t.docs) // t.length))))::BIGINT AS score
            FROM items JOIN tfs USING (term) JOIN weights USING (term) JOIN docs USING (doc), totals t
            GROUP BY item_id, doc_id, doc),
        ranked AS (SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, doc))::INTEGER AS rank, doc_id, score FROM scores WHERE score > 0)
        SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10""",
}

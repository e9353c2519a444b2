"""The queries of this subpackage: thin functions that apply an operator to a whole table and derive the contract's columns."""

from __future__ import annotations

import os
import secrets
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, byte_bpe, exact_dedup, html_text, language_id, near_dedup, packing, pii, substring_dedup, url_filter
from ._shared import table

# Rules of the URL query: host, path, verdict.
URL_RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)
PII_KEY_CONF = "spark.rowloom.pii.key"  # set it to a secret of your own: without it, each session draws a key that nobody else has


def tokenizer_file(name: str) -> str:
    """A file of the public tokenizers: below $ROWLOOM_TOKENIZERS if set, else from their package."""
    if folder := os.environ.get("ROWLOOM_TOKENIZERS"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def split_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def pii_key(spark: SparkSession) -> str:
    """The session's key. One that is drawn stays in the session's settings, so that its pseudonyms are linked and can be undone there."""
    if not (key := spark.conf.get(PII_KEY_CONF, "")):
        key = secrets.token_hex(32)
        spark.conf.set(PII_KEY_CONF, key)
    return key


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    found = ann.search(vectors, F.col("vec_id") % 20 == 0, k=20)
    return found.select("query_id", "rank", "vec_id", "score")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(list(URL_RULES), "host string, path string, verdict string")
    return url_filter.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_file("byte_bpe_50k.tiktoken")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    both = byte_bpe.decode(byte_bpe.encode(docs, path, split_pattern()), path)
    return both.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(byte_bpe.ids_text(F.col("ids")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))


def packed(docs: DataFrame) -> DataFrame:
    pieces = packing.tokenize_pieces(docs, tokenizer_file("byte_bpe_50k.json"), split_pattern())
    return packing.place(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(table(spark, sf_dir, "documents").select("doc_id", "text"), size=4, threshold=80)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html_text.extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.withColumn("n_chars", F.char_length("text").cast("bigint"))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.pseudonymise(docs, pii_key(spark)).select("doc_id", "text", F.size("pii").alias("n_pii"), F.col("pii.kind").alias("kinds"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    held_out = F.coalesce(language_id.fold_number(F.col("doc_id")) == 1, F.lit(False))
    samples = language_id.learn(docs.filter(~held_out & F.col("doc_id").isNotNull()))
    return language_id.identify(docs.select("doc_id", held_out.alias("held_out"), "text"), samples).select("doc_id", "held_out", "lang_pred", "score")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_learned_partition_ann": op1,
    "op2_url_filter": op2,
    "op3_byte_bpe": op3,
    "op4_substring_dedup": op4,
    "op5_exact_dedup": op5,
    "op6_best_fit_packing": op6,
    "op7_minhash_near_dedup": op7,
    "op8_html_extraction": op8,
    "op9_pii_pseudonyms": op9,
    "op10_language_id": op10,
    "pipeline": pipeline,
}

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_RULES_SQL = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)

ORACLE_SQL: dict[str, str] = {
    "op2_url_filter": f"""
        WITH u AS (SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
        s AS (SELECT page_id, url, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_UPPER.lower()}'), '') AS host,
                     coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
        r(rule_host, rule_path, v) AS (VALUES {_RULES_SQL}),
        m AS (SELECT page_id, url, host, path, rule_host || rule_path AS rule, v,
                     row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host || rule_path) DESC NULLS LAST) AS rn
              FROM s LEFT JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
        SELECT page_id, url, host, path, rule, coalesce(v, 'allow') AS verdict FROM m WHERE rn = 1""",
    "op4_substring_dedup": r"""
        WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
        s AS (SELECT doc_id, i, md5(array_to_string(words[i:i + 49], ' ')) AS k FROM w, unnest(range(1, len(words) - 48)) AS t(i)),
        f AS (SELECT k, min(doc_id) AS first FROM s GROUP BY k),
        g AS (SELECT DISTINCT s.doc_id, s.i + j AS at FROM s JOIN f USING (k), unnest(range(0, 50)) AS t(j) WHERE f.first < s.doc_id),
        p AS (SELECT doc_id, i AS at, words[i] AS word FROM w, unnest(range(1, len(words) + 1)) AS t(i)),
        o AS (SELECT p.doc_id, count(*) FILTER (g.at IS NOT NULL) AS gone, string_agg(word, ' ' ORDER BY p.at) FILTER (g.at IS NULL) AS kept
              FROM p LEFT JOIN g ON p.doc_id = g.doc_id AND p.at = g.at GROUP BY p.doc_id)
        SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(gone, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM w LEFT JOIN o ON w.doc_id = o.doc_id""",
    "op7_minhash_near_dedup": rf"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\x20\x09-\x0D]+') AS words FROM documents),
        s AS (SELECT DISTINCT doc_id, array_to_string(words[i:i + 3], ' ') AS k
              FROM w, unnest(range(1, CASE WHEN len(words) = 0 THEN 1 ELSE greatest(len(words) - 2, 2) END)) AS t(i)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s AS a JOIN s AS b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY ALL),
        e AS (SELECT a, b FROM p JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
        g AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
        r(doc_id, near) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, g.b FROM r JOIN g ON r.near = g.a)
        SELECT d.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(r.near) AS component_id, min(r.near) = d.doc_id AS kept
        FROM documents AS d JOIN r ON r.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id""",
    "op5_exact_dedup": f"""
        SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
        FROM (SELECT doc_id, translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}') AS t FROM documents)""",
}

"""The registered queries of the text operators, with their oracle SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelkit.llm import bpe, decontaminate, exact_dedup, html_text, near_dedup, pii, quality, ranked_search, resample, secret_scan, substring_dedup, token_counts, token_files
from panelkit.llm.text import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

_ASCII_LOWER = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def query(sql: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLE[function.__name__] = sql
        return function

    return add


@query(
    f"""
    WITH d AS (SELECT doc_id, sha256({_ASCII_LOWER.format('text')}) AS text_sha256 FROM documents)
    SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
    FROM d WINDOW w AS (PARTITION BY text_sha256)
    """
)
def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


@query()
def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@query()
def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score_documents(docs, quality.train(docs, table(spark, sf_dir, "labels")))


@query()
def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


@query()
def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query()
def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query()
def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"), html_text.default_model())


@query()
def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(table(spark, sf_dir, "documents"), pii.default_model()))


@query()
def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@query()
def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"), secret_scan.train(secret_scan.labelled_findings(spark)))


@query()
def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.digest(token_files.write_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))


@query(
    r"""
    WITH RECURSIVE step AS (
        SELECT i, i AS c, 0 AS k FROM range(256) AS t (i)
        UNION ALL SELECT i, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, k + 1 FROM step WHERE k < 8
    ),
    crc AS (SELECT list(c ORDER BY i) AS codes FROM step WHERE k = 8),
    lowered AS (
        SELECT 'd' AS side, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
        UNION ALL SELECT 'b', item_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark
    ),
    words AS (SELECT side, doc_id, unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM lowered),
    counted AS (SELECT side, doc_id, word, count(*) AS n FROM words GROUP BY ALL),
    spelled AS (SELECT word, hex(encode(word)) AS code FROM (SELECT DISTINCT word FROM counted)),
    buckets AS (
        SELECT word, xor(4294967295, list_reduce(
            list_prepend(4294967295, list_transform(range(CAST(length(code) AS BIGINT) // 2), lambda k: CAST('0x' || substr(code, 2 * k + 1, 2) AS BIGINT))),
            lambda c, b: xor(c // 256, codes[CAST(xor(c % 256, b) + 1 AS BIGINT)]))) % 10000 AS bucket
        FROM spelled, crc
    ),
    sums AS (
        SELECT i AS bucket, coalesce(sum(n) FILTER (side = 'd'), 0) AS s, coalesce(sum(n) FILTER (side = 'b'), 0) AS t
        FROM range(10000) AS all_buckets (i) LEFT JOIN (SELECT side, bucket, n FROM counted JOIN buckets USING (word)) AS c ON c.bucket = i GROUP BY i
    ),
    totals AS (SELECT sum(s) AS all_s, sum(t) AS all_t FROM sums),
    gains AS (
        SELECT bucket, CAST(floor(1000 * ln(CAST((t + 1) * (all_s + 10000) AS DOUBLE) / CAST((s + 1) * (all_t + 10000) AS DOUBLE))) AS BIGINT) AS gain FROM sums, totals
    ),
    weights AS (
        SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_features, CAST(sum(n * gain) AS BIGINT) AS weight
        FROM counted JOIN buckets USING (word) JOIN gains USING (bucket) WHERE side = 'd' GROUP BY doc_id
    ),
    scored AS (
        SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
               coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) + 0.5) / 4294967296))) AS BIGINT) AS score
        FROM documents LEFT JOIN weights USING (doc_id)
    ),
    ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
    SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * n // 100 THEN place END AS rank FROM scored LEFT JOIN ranked USING (doc_id)
    """
)
def op12_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query(
    r"""
    WITH lowered AS (
        SELECT 'd' AS side, doc_id AS id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
        UNION ALL SELECT 'b', item_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark
    ),
    words AS (SELECT side, id, unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM lowered),
    counted AS (SELECT side, id, term, count(*) AS tf FROM words GROUP BY ALL),
    lengths AS (SELECT id, CAST(sum(tf) AS BIGINT) AS n FROM counted WHERE side = 'd' GROUP BY id),
    totals AS (SELECT count(*) AS all_n, CAST(sum(n) AS BIGINT) AS all_l FROM lengths),
    weights AS (
        SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(all_n) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
        FROM counted, totals WHERE side = 'd' AND term IN (SELECT term FROM counted WHERE side = 'b') GROUP BY term
    ),
    parts AS (
        SELECT b.id AS item_id, d.id AS doc_id, w * ((1000000000 * d.tf) // (1000 * d.tf + 20 * (50 + (50 * n * all_n) // all_l))) AS part
        FROM (SELECT * FROM counted WHERE side = 'b') AS b JOIN (SELECT * FROM counted WHERE side = 'd') AS d USING (term)
        JOIN weights USING (term) JOIN lengths ON lengths.id = d.id, totals
    ),
    scored AS (SELECT item_id, doc_id, CAST(sum(part) AS BIGINT) AS score FROM parts GROUP BY item_id, doc_id HAVING sum(part) > 0),
    ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scored)
    SELECT * FROM ranked WHERE rank <= 50
    """
)
def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))

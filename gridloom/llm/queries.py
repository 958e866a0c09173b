"""The queries op1_... to op10_... over the driver's tables, and their SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .byte_bpe import encode_bpe
from .common import table
from .labelled import remainder
from .line_dedup import dedup_lines
from .media_columns import media_columns
from .quality_model import score_quality
from .quality_rules import judge_quality
from .secret_scan import BASE, scan_secrets
from .simhash import near_duplicates
from .source_mix import mix_sources, taken
from .substring_dedup import dedup_substrings
from .toxicity import score_toxicity

#: The six white-space characters as a DuckDB expression.
SQL_WS = "(' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
SQL_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", *columns)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(documents(spark, sf_dir)).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256")
    )


OP1_SQL = f"""
WITH split AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), lines AS (
  SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM split
), keyed AS (
  SELECT *, {SQL_LOWER.format(f"trim(line, {SQL_WS})")} AS k FROM lines
), common AS (
  SELECT k, min(doc_id) AS keeper FROM keyed WHERE length(k) >= 10
  GROUP BY k HAVING count(DISTINCT doc_id) > 1
), marked AS (
  SELECT keyed.*, common.k IS NOT NULL AND doc_id <> keeper AS gone
  FROM keyed LEFT JOIN common USING (k)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken(mix_sources(documents(spark, sf_dir, "source"))).select(
        F.col("row.doc_id").alias("doc_id"), "size", "source_size", "target", "taken"
    )


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(documents(spark, sf_dir)).select(
        "doc_id",
        "n_bytes",
        "payload_bytes",
        "payload_sha256",
        "tail_crc32",
        F.col("length").alias("media_bytes"),
        "media_sha256",
        "feature",
    )


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge_quality(documents(spark, sf_dir, "lang", "source"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256")
    )


def tokenizer() -> tuple[str, str]:
    """The default rank file and splitting pattern; both are parameters of the operator."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = encode_bpe(documents(spark, sf_dir), *tokenizer(), want_ids=False)
    return encoded.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def judged(scored: DataFrame, held_out) -> DataFrame:
    return scored.select(
        "doc_id",
        held_out.alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
    )


def op4_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    part = remainder("doc_id", 3)
    scored = score_quality(documents(spark, sf_dir), labels, train=part != 1)
    return judged(scored, part == 1)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    part = remainder("doc_id", 5)
    scored = score_toxicity(documents(spark, sf_dir), labels, train=part != 0)
    return judged(scored, part == 0)


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = scan_secrets(documents(spark, sf_dir))
    spans = F.col("spans")
    base = F.filter(spans, lambda s: s["kind"].isin(*BASE))
    text = lambda found: F.array_join(
        F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )
    count = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
    return scanned.select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in BASE],
        F.sha2(text(base), 256).alias("base_sha256"),
        text(spans).alias("spans"),
    )


OP9_SQL = r"""
WITH texts AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS t FROM documents
), parts AS (
  SELECT doc_id, lang, source, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls
  FROM texts
), windows AS (
  SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS x
  FROM parts, unnest(range(1, len(ws) - 1)) AS u(i)
), twice AS (
  SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, x) > 1
), covered AS (
  SELECT doc_id, count(DISTINCT i + k.range) AS n FROM twice, range(3) AS k GROUP BY doc_id
), counted AS (
  SELECT doc_id, lang, source, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, len(ls)::BIGINT AS n_lines, coalesce(n, 0) AS n_repeat_words
  FROM parts LEFT JOIN covered USING (doc_id)
), m AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         n_symbols * 1000 // greatest(n_words, 1) AS r_symbols, word_chars * 100 // greatest(n_words, 1) AS r_length,
         n_dup_lines * 1000 // greatest(n_lines, 1) AS r_lines, n_repeat_words * 1000 // greatest(n_words, 1) AS r_repeat
  FROM counted
), long AS (
  SELECT lang, source, base_failed, unnest(['r_symbols', 'r_length', 'r_lines', 'r_repeat']) AS ratio,
         unnest([r_symbols, r_length, r_lines, r_repeat]) AS v, unnest([100, 200, 500, 300]) AS least_reach
  FROM m
), cells AS (
  SELECT lang, source, ratio, least_reach, (v >> greatest(0, length(bin(v)) - 5)) << greatest(0, length(bin(v)) - 5) AS bucket, count(*) AS n
  FROM long WHERE NOT base_failed GROUP BY ALL
), own AS (
  SELECT *, sum(n) OVER (PARTITION BY lang, source, ratio) AS total, sum(n) OVER (PARTITION BY lang, source, ratio ORDER BY bucket) AS upto FROM cells
), everywhere AS (
  SELECT ratio, bucket, sum(n) AS n FROM cells GROUP BY ALL
), ranked AS (
  SELECT *, sum(n) OVER (PARTITION BY ratio) AS total, sum(n) OVER (PARTITION BY ratio ORDER BY bucket) AS upto FROM everywhere
), whole AS (
  SELECT ratio, min(bucket) FILTER (upto * 4 >= total) AS w1, min(bucket) FILTER (upto * 4 >= total * 3) AS w3 FROM ranked GROUP BY ratio
), quartiles AS (
  SELECT lang, source, ratio, least_reach, any_value(total) AS docs,
         min(bucket) FILTER (upto * 4 >= total) AS q1, min(bucket) FILTER (upto * 4 >= total * 3) AS q3
  FROM own GROUP BY ALL
), picked AS (
  SELECT lang, source, ratio, least_reach, ((docs * q1 + 30 * w1) // (docs + 30))::BIGINT AS q1, ((docs * q3 + 30 * w3) // (docs + 30))::BIGINT AS q3
  FROM quartiles JOIN whole USING (ratio)
), fences AS (
  SELECT lang, source, ratio, q1 - greatest((q3 - q1) * 4, least_reach) AS lo, q3 + greatest((q3 - q1) * 4, least_reach) AS hi FROM picked
), wide AS (
  SELECT lang, source, max(hi) FILTER (ratio = 'r_symbols') AS h1, max(hi) FILTER (ratio = 'r_length') AS h2,
         max(hi) FILTER (ratio = 'r_lines') AS h3, max(hi) FILTER (ratio = 'r_repeat') AS h4, max(lo) FILTER (ratio = 'r_length') AS l2
  FROM fences GROUP BY lang, source
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce(r_symbols <= h1 AND r_length <= h2 AND r_lines <= h3 AND r_repeat <= h4 AND r_length >= l2, false) AS kept
FROM m LEFT JOIN wide ON m.lang IS NOT DISTINCT FROM wide.lang AND m.source IS NOT DISTINCT FROM wide.source
"""


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_quality_model": op4_quality_model,
    "op5_secret_scan": op5_secret_scan,
    "op6_toxicity": op6_toxicity,
    "op7_source_mix": op7_source_mix,
    "op8_media_columns": op8_media_columns,
    "op9_quality_rules": op9_quality_rules,
    "op10_simhash": op10_simhash,
}
ORACLES = {"op1_line_dedup": OP1_SQL, "op9_quality_rules": OP9_SQL}

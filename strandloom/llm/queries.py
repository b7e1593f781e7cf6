"""One query per operator, with its production parameters on its whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm import (
    bpe, collocations, decontam, license_scan, line_dedup, mixing, quality, simhash, spelling, token_counts, token_files, url_lists, winnow,
)
from strandloom.llm.license_texts import TEMPLATES


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statements in every document: their names, the best containment and its first word."""
    found = license_scan.scan_documents(_table(spark, sf_dir, "documents"), TEMPLATES)
    best = F.array_max(F.transform("found", lambda x: F.struct(
        x["containment"].alias("containment"), (-x["word"]).alias("w"))))
    return found.select(
        "doc_id", F.size("found").cast("long").alias("n_licenses"),
        F.array_join(F.transform("found", lambda x: x["template"]), ",").alias("licenses"),
        F.coalesce(best["containment"], F.lit(0.0)).alias("containment"), (-best["w"]).alias("first_word"),
    )


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = token_files.new_folder(spark)
    token_files.write_files(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"), folder)
    return token_files.checksums(token_files.read_files(spark, folder)).withColumnRenamed("id", "doc_id")


def op3_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


def _day(number: Column) -> Column:
    return F.date_add(F.lit("2024-01-01").cast("date"), (number % 365).cast("int"))


def _dated_entries(captures: DataFrame) -> DataFrame:
    """Three dated list entries for every host: blocked, its parent domain allowed, blocked again."""
    hosts = captures.select(url_lists.host(F.col("url")).alias("h")).where("h IS NOT NULL").distinct()
    made = hosts.select("h", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k"))
    code = lambda i: F.ascii(F.substring(F.md5(F.concat_ws("|", "h", F.col("k").cast("string"))), i, 1))
    parent = F.regexp_replace("h", r"^[^.]*\.", "")
    return made.select(
        F.when(F.col("k") == 1, parent).otherwise(F.col("h")).alias("domain"),
        _day(code(1) * 13 + code(2) * 29).alias("day"),
        F.when(F.col("k") == 1, "allow").otherwise("block").alias("action"),
    )


def op4_url_list_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages carry no fetch day and there is no list table, so both are derived from the pages."""
    captures = _table(spark, sf_dir, "pages").select("page_id", "url", _day(F.col("page_id") * 37).alias("day"))
    judged = url_lists.judge(captures, _dated_entries(captures))
    return judged.withColumn("day", F.col("day").cast("string"))


OP4_SQL = r"""
WITH caps AS (
  SELECT page_id, NULLIF(REGEXP_REPLACE(REGEXP_EXTRACT(LOWER(TRIM(url)),
           '^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1), '\.$', ''), '') AS host,
         DATE '2024-01-01' + CAST((page_id * 37) % 365 AS INT) AS day FROM pages),
made AS (
  SELECT h, k, MD5(CONCAT(h, '|', CAST(k AS VARCHAR))) AS m
  FROM (SELECT DISTINCT host AS h FROM caps WHERE host IS NOT NULL) t0, (VALUES (0), (1), (2)) t1(k)),
entries AS (
  SELECT CASE WHEN k = 1 THEN REGEXP_REPLACE(h, '^[^.]*\.', '') ELSE h END AS domain,
         DATE '2024-01-01' + CAST((ASCII(SUBSTR(m, 1, 1)) * 13 + ASCII(SUBSTR(m, 2, 1)) * 29) % 365 AS INT) AS day,
         CASE WHEN k = 1 THEN 'allow' ELSE 'block' END AS action FROM made),
valid AS (
  SELECT domain, valid_from, action, LEAD(valid_from) OVER (PARTITION BY domain ORDER BY valid_from) AS valid_to
  FROM (SELECT domain, day AS valid_from, MAX(action) AS action FROM entries GROUP BY domain, day) t2),
asked AS (SELECT DISTINCT host, day FROM caps WHERE host IS NOT NULL),
ups AS (
  SELECT host, day, i, ARRAY_TO_STRING(LIST_SLICE(STRING_SPLIT(host, '.'), i, LEN(STRING_SPLIT(host, '.'))), '.') AS domain
  FROM (SELECT host, day, UNNEST(RANGE(1, LEN(STRING_SPLIT(host, '.')) + 1)) AS i FROM asked) t3),
found AS (
  SELECT host, day, domain, action FROM (
    SELECT u.host, u.day, u.domain, v.action, ROW_NUMBER() OVER (PARTITION BY u.host, u.day ORDER BY u.i) AS r
    FROM ups u JOIN valid v ON u.domain = v.domain AND u.day >= v.valid_from
      AND (v.valid_to IS NULL OR u.day < v.valid_to)) t4 WHERE r = 1)
SELECT c.page_id, c.host, CAST(c.day AS VARCHAR) AS day, f.domain AS listed_domain, f.action AS listed_action,
       COALESCE(f.action, '') = 'block' AS blocked
FROM caps c LEFT JOIN found f ON c.host = f.host AND c.day = f.day
"""


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score"
    )


def op7_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode_decode(_table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"))
    return coded.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op8_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    compared = winnow.compare_with_edit(_table(spark, sf_dir, "documents"))
    return compared.select(
        F.col("id").alias("doc_id"), "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        winnow.digest(F.col("prints")).alias("fingerprint"),
        winnow.digest(F.col("edited_prints")).alias("edited_fingerprint"),
        winnow.likeness(F.col("prints"), F.col("edited_prints")).alias("near_edited"),
        winnow.likeness(F.col("prints"), F.col("next_prints")).alias("near_next"),
    )


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many lines every document has and loses, and a digest of the text that stays."""
    return line_dedup.line_report(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_lines", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256")
    )


def op10_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken"
    )


OP10_SQL = r"""
WITH rows0 AS (
  SELECT doc_id, source, LEN(REGEXP_EXTRACT_ALL(COALESCE(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
weighed AS (SELECT *, CAST(GREATEST(1, FLOOR(SQRT(CAST(size AS DOUBLE)))) AS BIGINT) AS v FROM rows0),
sources AS (
  SELECT source, CAST(SUM(size) AS BIGINT) AS s, CAST(SUM(v * size) AS DOUBLE) AS mass,
         (ROW_NUMBER() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM weighed GROUP BY source),
placed AS (
  SELECT *, SUM(s) OVER (ORDER BY s / CAST(w AS DOUBLE), source NULLS LAST ROWS UNBOUNDED PRECEDING) - s AS bs,
         SUM(w) OVER (ORDER BY s / CAST(w AS DOUBLE), source NULLS LAST ROWS UNBOUNDED PRECEDING) - w AS bw,
         SUM(s) OVER () AS words, SUM(w) OVER () AS weights FROM sources),
marked AS (SELECT *, 3 * s * (weights - bw) < (words - 3 * bs) * w AS is_full FROM placed),
held AS (
  SELECT *, COALESCE(SUM(CASE WHEN is_full THEN s END) OVER (), 0) AS hs,
         COALESCE(SUM(CASE WHEN is_full THEN w END) OVER (), 0) AS hw FROM marked),
quota AS (
  SELECT source, s, mass, CASE WHEN is_full THEN 3.0 * CAST(s AS DOUBLE)
    ELSE CAST(words - 3 * hs AS DOUBLE) * CAST(w AS DOUBLE) / CAST(GREATEST(1, weights - hw) AS DOUBLE) END AS target FROM held),
copied AS (
  SELECT *, CASE WHEN s > 0 THEN LEAST(3, CAST(FLOOR(target / s) AS BIGINT)) ELSE 0 END AS c FROM quota),
rested AS (SELECT *, CASE WHEN c < 3 THEN target - CAST(c * s AS DOUBLE) ELSE 0.0 END AS rest FROM copied),
drawn AS (
  SELECT d.doc_id, d.source, d.size, q.s, q.target, q.c, q.rest,
         CASE WHEN q.rest > 0 AND d.size > 0 THEN LEAST(q.rest * CAST(d.v AS DOUBLE) / q.mass, 1.0) END AS p,
         (CAST(CAST('0x' || SUBSTR(MD5(CONCAT('mix-1|', COALESCE(d.source, '-'), '|', CAST(d.doc_id AS VARCHAR))), 1, 13)
           AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0 AS u
  FROM weighed d JOIN rested q ON d.source IS NOT DISTINCT FROM q.source),
ranked AS (SELECT *, CASE WHEN p IS NOT NULL THEN (u / (1.0 - u)) * (1.0 - p) / p END AS rnk FROM drawn),
summed AS (
  SELECT *, CASE WHEN rnk IS NOT NULL
    THEN SUM(size) OVER (PARTITION BY source, rnk IS NULL ORDER BY rnk RANGE UNBOUNDED PRECEDING) <= rest ELSE FALSE END AS inside,
    SUM(size) OVER (PARTITION BY source, rnk IS NULL ORDER BY rnk RANGE UNBOUNDED PRECEDING) AS cum FROM ranked),
gaps AS (
  SELECT *, rest - COALESCE(MAX(CASE WHEN inside THEN cum END) OVER (PARTITION BY source), 0) AS missing FROM summed),
last AS (
  SELECT source, rnk FROM (
    SELECT source, rnk, ROW_NUMBER() OVER (PARTITION BY source ORDER BY ABS(missing - size), rnk) AS r FROM gaps
    WHERE rnk IS NOT NULL AND NOT inside AND ABS(missing - size) < missing) t0 WHERE r = 1)
SELECT g.doc_id, g.size, g.s AS source_size, g.target,
       g.size * LEAST(3, g.c + CASE WHEN g.inside OR g.rnk = l.rnk THEN 1 ELSE 0 END) AS taken
FROM gaps g LEFT JOIN last l ON g.source IS NOT DISTINCT FROM l.source
"""

def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of the vocabulary with its near words, its form and its root."""
    return spelling.variant_groups(_table(spark, sf_dir, "documents"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 phrases of every language."""
    return collocations.collocations(_table(spark, sf_dir, "documents"))


def op13_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in a window of a benchmark item, and those items."""
    found = decontam.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


QUERIES = {
    f.__name__: f for f in (
        op1_license_scan, op2_token_files, op3_simhash_groups, op4_url_list_filter, op5_token_counts,
        op6_quality_rules, op7_bpe_encode_decode, op8_winnowing, op9_line_dedup, op10_pareto_mix,
        op11_spelling_variants, op12_collocations, op13_decontaminate,
    )
}
ORACLES = {"op4_url_list_filter": OP4_SQL, "op10_pareto_mix": OP10_SQL}

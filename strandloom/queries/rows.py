"""Queries of filters, validation, mapping, de-duplication and row joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandloom import fixed_values as fv
from strandloom.functions import names
from strandloom.operators import audit, canonical, dedup, enrich, mapping, validate
from strandloom.queries.derived import derived
from strandloom.queries.registry import CHECKS, query
from strandloom.queries.scalars import _FAULT, _sql_any, _sql_list
from strandloom.session import durable
from strandloom.sources import curated

_OK_DNA = "(regexp_full_match({0}, '[ATGC]+') AND length({0}) BETWEEN 20 AND 120)"

# --- validation -------------------------------------------------------------

CHECKS["bad_records"] = """
  SELECT row_id, unnest([
    CASE WHEN trim(aptamer_sequence) = '' THEN 'required' END,
    CASE WHEN nucleic_acid_type NOT IN ('ssDNA','ssRNA','LNA','other') THEN 'vocabulary' END,
    CASE WHEN target_type NOT IN ('protein','small_molecule') THEN 'vocabulary' END,
    CASE WHEN kd_unit NOT IN ('pM','nM') THEN 'vocabulary' END,
    CASE WHEN source_type = 'blog' THEN 'vocabulary' END,
    CASE WHEN confidence_score = 'flagged' THEN 'vocabulary' END,
    CASE WHEN split = 'unassigned' THEN 'vocabulary' END,
    CASE WHEN kd_value IS NOT NULL AND TRY_CAST(kd_value AS DOUBLE) IS NULL THEN 'not numeric' END,
    CASE WHEN TRY_CAST(kd_value AS DOUBLE) < 0 THEN 'negative' END,
    CASE WHEN kd_value IS NOT NULL AND kd_unit IS NULL THEN 'unit missing' END,
    CASE WHEN kd_value IS NULL AND kd_unit IS NOT NULL THEN 'value missing' END,
    CASE WHEN ph <> '' AND TRY_CAST(ph AS DOUBLE) IS NULL THEN 'not numeric' END,
    CASE WHEN TRY_CAST(ph AS DOUBLE) NOT BETWEEN 0 AND 14 THEN 'range' END,
    CASE WHEN TRY_CAST(mg_concentration_mM AS DOUBLE) NOT BETWEEN 0 AND 1000 THEN 'range' END]) AS e
  FROM text_records"""
CHECKS["record_flags"] = """
  SELECT t.*, coalesce(n, 0) AS n_errors FROM text_records t LEFT JOIN
    (SELECT row_id AS rid, count(e) AS n FROM bad_records GROUP BY row_id) b ON b.rid = t.row_id"""


@query(
    "validate_record",
    "SELECT row_id, n_errors = 0 AS valid, CAST(n_errors AS INTEGER) AS n_errors FROM record_flags",
)
def validate_record(spark, sf):
    checked = validate.validate_record(derived(spark, sf, "text_records"))
    return checked.select("row_id", "valid", F.size("errors").alias("n_errors"))


@query(
    "to_record_frame",
    """SELECT aptamer_sequence, nucleic_acid_type, modifications, target_name, target_type, target_id, target_id_source,
         TRY_CAST(kd_value AS DOUBLE) AS kd_value, kd_unit, assay_type, selection_buffer, binding_buffer,
         TRY_CAST(ph AS DOUBLE) AS ph, TRY_CAST(na_concentration_mM AS DOUBLE) AS na_concentration_mM,
         TRY_CAST(mg_concentration_mM AS DOUBLE) AS mg_concentration_mM, TRY_CAST(temperature_C AS DOUBLE) AS temperature_C,
         source_doi, source_type, confidence_score, split FROM text_records""",
)
def to_record_frame(spark, sf):
    return validate.to_records(derived(spark, sf, "text_records"))


CHECKS["faults"] = f"""
  SELECT row_id, k, t, CASE WHEN s IS NULL THEN 'not_a_string' ELSE {_FAULT.replace('AUGC', 'ATGC').replace('U{9,}', 'T{9,}')} END AS fault
  FROM (SELECT row_id, upper(trim(sequence)) AS s, upper(trim(sequence)) AS k, lower(trim(target_protein)) AS t,
          length(regexp_replace(upper(sequence), '[^GC]', '', 'g')) / length(sequence) AS gc FROM legacy) x"""
CHECKS["validated"] = """
  SELECT row_id, CASE WHEN fault = '' AND row_number() OVER (PARTITION BY k, t, fault = '' ORDER BY row_id) > 1 THEN 'duplicate' ELSE fault END AS fail_reason
  FROM faults"""


@query("validate_sequence", "SELECT row_id, fail_reason = '' AS valid, fail_reason FROM validated")
def validate_sequence(spark, sf):
    return validate.validate_sequences(derived(spark, sf, "legacy")).select(
        "row_id", "valid", "fail_reason"
    )


@query(
    "validation_report",
    """SELECT coalesce(reason, 'total') AS reason, count(*) AS n FROM (SELECT CASE WHEN fail_reason = '' THEN 'passed'
         ELSE regexp_replace(fail_reason, ' \\(.*$', '') END AS reason FROM validated) x GROUP BY ROLLUP (reason)""",
)
def validation_report(spark, sf):
    return validate.validation_report(validate.validate_sequences(derived(spark, sf, "legacy")))


CHECKS["kinds"] = """
  SELECT *, CASE WHEN sequence IS NULL THEN 'unknown' WHEN contains(upper(sequence), 'U') THEN 'ssRNA'
         WHEN regexp_full_match(sequence, '[ATGCatgc]+') THEN 'ssDNA' ELSE 'other' END AS nucleic_acid_type FROM legacy"""
CHECKS["quarantined"] = """
  SELECT *, CASE WHEN nucleic_acid_type <> 'ssDNA' THEN 'non_ssDNA_type' WHEN length(sequence) < 20 THEN concat('too_short (', length(sequence), ' < 20)')
         WHEN length(sequence) > 120 THEN concat('too_long (', length(sequence), ' > 120)') END AS removal_reason FROM kinds"""


@query("quarantine_split", "SELECT row_id, nucleic_acid_type, removal_reason FROM quarantined")
def quarantine_split(spark, sf):
    kept, removed = validate.quarantine(derived(spark, sf, "legacy"))
    return kept.select(
        "row_id", "nucleic_acid_type", F.lit(None).cast("string").alias("removal_reason")
    ).unionByName(removed.select("row_id", "nucleic_acid_type", "removal_reason"))


@query(
    "export_audit",
    """WITH seqs AS (SELECT upper(aptamer_sequence) AS s, bool_or(split = 'train') AS a, bool_or(split = 'val') AS b, bool_or(split = 'test') AS c FROM records GROUP BY 1),
         shares AS (SELECT s, floor(1000.0 * count(*) FILTER (split = s) / count(*) FILTER (split IN ('train','val','test')))::BIGINT AS n
           FROM records, (VALUES ('val'), ('test')) v(s) GROUP BY s)
       SELECT 'vocabulary:source_type' AS "check", count(*) AS n FROM records WHERE row_id % 17 = 0 HAVING count(*) > 0
       UNION ALL SELECT 'null:target_name', count(*) FROM records WHERE row_id % 19 = 0
       UNION ALL SELECT 'charset', count(*) FROM records WHERE row_id % 23 = 0
       UNION ALL SELECT 'too_long', count(*) FROM records WHERE row_id % 23 = 0 AND length(aptamer_sequence) = 120
       UNION ALL SELECT concat('share_below_5pct:', s), n FROM shares WHERE n < 50
       UNION ALL SELECT 'overlap:train_val', count(*) FROM seqs WHERE a AND b HAVING count(*) > 0
       UNION ALL SELECT 'overlap:train_test', count(*) FROM seqs WHERE a AND c HAVING count(*) > 0
       UNION ALL SELECT 'overlap:val_test', count(*) FROM seqs WHERE b AND c HAVING count(*) > 0""",
)
def export_audit(spark, sf):
    return validate.export_audit(_exportable(spark, sf)).where(
        "check NOT LIKE 'overlap%'"
    ).unionByName(
        validate.export_audit(_exportable(spark, sf, dirty=False)).where("check LIKE 'overlap%'")
    )


def _exportable(spark, sf, dirty=True):
    """Records with the cleaned columns, some of them damaged on purpose."""
    bad = lambda n: (F.col("row_id") % n == 0) & F.lit(dirty)
    return derived(spark, sf, "records").select(
        "row_id",
        F.when(bad(23), F.concat("aptamer_sequence", F.lit("N"))).otherwise(F.col("aptamer_sequence"))
        .alias("aptamer_sequence"),
        F.lit("ssDNA").alias("nucleic_acid_type"), F.lit("none").alias("modifications"),
        F.when(~bad(19), F.col("target_name")).alias("target_name"), "target_type",
        F.lit("curated").alias("confidence_score"),
        F.when(bad(17), "blog").otherwise("paper").alias("source_type"), "split",
    )


# --- filters ----------------------------------------------------------------


@query(
    "filter_targets",
    """SELECT row_id, target_name FROM records WHERE contains(translate(lower(target_name), '_-', '  '), 'serum')
         OR contains(translate(lower(target_name), '_-', '  '), 'troponin i') OR contains('insulin b chain', translate(lower(target_name), '_-', '  '))
         OR contains(translate(lower(target_name), '_-', '  '), 'insulin b chain')""",
)
def filter_targets(spark, sf):
    return mapping.filter_targets(
        derived(spark, sf, "records"), ["serum", "Troponin_I", "insulin-B chain"]
    ).select("row_id", "target_name")


@query(
    "training_ready",
    """SELECT row_id, 'augment' AS variant FROM records WHERE protein_sequence IS NOT NULL AND target_type = 'protein'
       UNION ALL SELECT row_id, 'train' FROM records WHERE protein_sequence IS NOT NULL
       UNION ALL SELECT row_id, 'finetune' FROM records WHERE protein_sequence IS NOT NULL AND split IN ('train','val','test')""",
)
def training_ready(spark, sf):
    df = derived(spark, sf, "records")
    parts = [
        mapping.training_ready(df, v).select("row_id", F.lit(v).alias("variant"))
        for v in ("augment", "train", "finetune")
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_CLEAN_KIND = f"""CASE WHEN length(protein_sequence) > 10 THEN 'protein' WHEN target_protein IS NULL THEN 'other'
  WHEN {_sql_any('lower(target_protein)', fv.GARBAGE_PHRASES)} OR lower(target_protein) = 'unknown' THEN 'other'
  WHEN lower(target_protein) IN ({_sql_list(fv.SMALL_MOLECULES)}) OR {_sql_any('lower(target_protein)', fv.SMALL_MOLECULE_PARTS)} THEN 'small_molecule'
  WHEN {_sql_any('lower(target_protein)', fv.ION_PARTS)} THEN 'ion' WHEN {_sql_any('lower(target_protein)', fv.CELL_PARTS)} THEN 'cell'
  WHEN {_sql_any('lower(target_protein)', fv.ORGANISM_PARTS)} THEN 'organism' ELSE 'protein' END"""


@query(
    "clear_wrong_ids",
    f"""SELECT row_id, k AS target_type, CASE WHEN k = 'protein' THEN uniprot_id END AS target_id,
         CASE WHEN k = 'protein' THEN 'UniProt' END AS target_id_source FROM (SELECT *, {_CLEAN_KIND} AS k FROM legacy) x""",
)
def clear_wrong_ids(spark, sf):
    typed = derived(spark, sf, "legacy").withColumn(
        "target_type", names.classify_clean(F.col("target_protein"), F.col("protein_sequence"))
    )
    return mapping.clear_wrong_ids(typed).select(
        "row_id", "target_type", "target_id", "target_id_source"
    )


# --- mapping ----------------------------------------------------------------


@query(
    "detect_schema",
    """SELECT row_id, sequence AS aptamer_sequence, target_protein AS target_name, uniprot_id AS target_id, Kd_nM AS kd_value,
         source AS source_type FROM legacy""",
)
def detect_schema(spark, sf):
    out = mapping.canonicalise(derived(spark, sf, "legacy"))
    return mapping.canonicalise(out).select(
        "row_id", "aptamer_sequence", "target_name", "target_id", "kd_value", "source_type"
    )


@query(
    "fill_condition_defaults",
    """SELECT row_id, coalesce(ph, 7.4) AS ph, coalesce(na_concentration_mM, 150.0) AS na_concentration_mM,
         coalesce(mg_concentration_mM, 2.0) AS mg_concentration_mM, coalesce(temperature_C, 37.0) AS temperature_C,
         coalesce(binding_buffer, 'PBS') AS binding_buffer FROM records""",
)
def fill_condition_defaults(spark, sf):
    return mapping.fill_defaults(derived(spark, sf, "records")).select(
        "row_id", "ph", "na_concentration_mM", "mg_concentration_mM", "temperature_C", "binding_buffer"
    )


def _buffer_sql(c):
    return (f"CASE WHEN {c} IS NULL THEN 0 WHEN contains(lower({c}), 'pbs') OR contains(lower({c}), 'phosphate') THEN 0 "
            f"WHEN contains(lower({c}), 'hepes') THEN 1 WHEN contains(lower({c}), 'tris') THEN 2 ELSE 3 END")


CHECKS["as_legacy"] = f"""
  SELECT row_id, upper(trim(aptamer_sequence)) AS sequence, trim(target_name) AS target_protein,
    CASE WHEN trim(target_id_source) = 'UniProt' THEN target_id END AS uniprot_id,
    CASE WHEN TRY_CAST(kd_value AS DOUBLE) >= 0 THEN TRY_CAST(kd_value AS DOUBLE) END AS Kd_nM,
    coalesce(TRY_CAST(ph AS DOUBLE), 7.4) AS pH, coalesce(TRY_CAST(na_concentration_mM AS DOUBLE), 150.0) AS salt_mM,
    coalesce(TRY_CAST(temperature_C AS DOUBLE), 37.0) AS temp_C, coalesce(TRY_CAST(mg_concentration_mM AS DOUBLE), 2.0) AS mg_mM,
    CAST({_buffer_sql("coalesce(CASE WHEN trim(binding_buffer) NOT IN ('', 'nan') THEN binding_buffer END, selection_buffer)")} AS INTEGER) AS buffer_type,
    nullif(trim(source_doi), '') AS source_pmid,
    CASE source_type WHEN 'paper' THEN 'pubmed' WHEN 'patent' THEN 'patent' WHEN 'database' THEN 'database' WHEN 'preprint' THEN 'biorxiv' ELSE 'scraped' END AS source
  FROM text_records"""


@query("record_to_legacy", "SELECT * FROM as_legacy")
def record_to_legacy(spark, sf):
    return mapping.to_legacy(derived(spark, sf, "text_records")).select(
        "row_id", "sequence", "target_protein", "uniprot_id", "Kd_nM", "pH", "salt_mM", "temp_C",
        "mg_mM", "buffer_type", "source_pmid", "source",
    )


_SOURCE_ID = """CASE WHEN source_pmid IS NULL THEN NULL WHEN starts_with(source_pmid, '10.') THEN source_pmid
  WHEN starts_with(source_pmid, 'https://doi.org/') THEN replace(source_pmid, 'https://doi.org/', '')
  WHEN TRY_CAST(source_pmid AS DOUBLE) IS NOT NULL THEN concat('PMID:', CAST(TRY_CAST(source_pmid AS DOUBLE) AS BIGINT)) ELSE source_pmid END"""
_CONFIDENCE = f"""CASE WHEN {_sql_any('lower(target_protein)', fv.UNCERTAIN_PHRASES)} THEN 'uncertain'
  WHEN source = 'li2014' THEN 'extracted' WHEN source = 'utexas' AND Kd_nM IS NOT NULL THEN 'curated'
  WHEN source IN ('utexas','aptamerbase','pubmed') THEN 'extracted' ELSE 'non-curated' END"""
_SOURCE_TYPE = """CASE source WHEN 'li2014' THEN 'paper' WHEN 'pubmed' THEN 'paper' WHEN 'utexas' THEN 'database' WHEN 'aptamerbase' THEN 'database'
  WHEN 'database' THEN 'database' WHEN 'patent' THEN 'patent' WHEN 'biorxiv' THEN 'preprint' ELSE 'other' END"""


@query(
    "legacy_to_cleaned",
    f"""SELECT row_id, upper(sequence) AS aptamer_sequence, target_protein AS target_name, Kd_nM AS kd_value,
         CASE WHEN Kd_nM IS NOT NULL THEN 'nM' END AS kd_unit,
         CASE buffer_type WHEN 0 THEN 'PBS' WHEN 1 THEN 'HEPES' WHEN 2 THEN 'Tris' WHEN 3 THEN 'other' END AS binding_buffer,
         pH AS ph, {_SOURCE_ID} AS source_doi, {_SOURCE_TYPE} AS source_type, {_CONFIDENCE} AS confidence_score, label, training_tier FROM legacy""",
)
def legacy_to_cleaned(spark, sf):
    return mapping.to_cleaned(derived(spark, sf, "legacy")).select(
        "row_id", "aptamer_sequence", "target_name", "kd_value", "kd_unit", "binding_buffer", "ph",
        "source_doi", "source_type", "confidence_score", "label", "training_tier",
    )


# --- sources ----------------------------------------------------------------

_TIER = f"CAST(CASE WHEN {_sql_any('lower({0})', fv.VALIDATION_TARGETS)} THEN 2 ELSE 1 END AS INTEGER)"
CHECKS["assayed_rows"] = f"""
  SELECT row_id, nullif(replace(regexp_replace(upper(seq), '[^ATGCU]', '', 'g'), 'U', 'T'), '') AS sequence, trim(target) AS target_protein,
    kd AS Kd_nM, coalesce(ph, 7.4) AS pH, CAST({_buffer_sql('buf')} AS INTEGER) AS buffer_type, CAST(1 AS INTEGER) AS label,
    nullif(regexp_extract(link, 'gov/([0-9]+)', 1), '') AS source_pmid, {_TIER.format('target')} AS training_tier,
    false AS needs_sequence_enrichment, 'utexas' AS source
  FROM assayed WHERE nucleic = 'ssDNA'"""
CHECKS["benchmark_rows"] = f"""
  SELECT row_id, CAST(NULL AS VARCHAR) AS sequence, trim(replace(target_id, '_', ' ')) AS target_protein, CAST(NULL AS DOUBLE) AS Kd_nM, 7.4::DOUBLE AS pH,
    CAST(0 AS INTEGER) AS buffer_type, CAST(CASE WHEN lower(trim(class)) = 'positive' THEN 1 ELSE 0 END AS INTEGER) AS label,
    nullif(regexp_extract(aptamer_id, '^([0-9]+)-', 1), '') AS source_pmid, {_TIER.format("replace(target_id, '_', ' ')")} AS training_tier,
    true AS needs_sequence_enrichment, 'li2014' AS source
  FROM pairlist"""
_MASTER = ["row_id", "sequence", "target_protein", "Kd_nM", "pH", "buffer_type", "label", "source_pmid",
           "training_tier", "needs_sequence_enrichment", "source"]


def _assayed(spark, sf):
    return curated.from_assayed(
        derived(spark, sf, "assayed").select(
            "row_id", F.col("nucleic").alias("Type of Nucleic Acid"),
            F.col("seq").alias("Aptamer Sequence"), F.col("target").alias("Target"),
            F.col("kd").alias("Kd (nM)"), F.col("ph").alias("pH"),
            F.col("buf").alias("Type of the buffer"), F.col("link").alias("Link to PubMed Entry"),
        )
    )


@query("parse_source_assayed", "SELECT * FROM assayed_rows")
def parse_source_assayed(spark, sf):
    return _assayed(spark, sf).select(*_MASTER)


@query("parse_source_benchmark", "SELECT * FROM benchmark_rows")
def parse_source_benchmark(spark, sf):
    return curated.from_benchmark(derived(spark, sf, "pairlist")).select(*_MASTER)


@query(
    "build_master",
    """SELECT count(*) AS total, count(sequence) AS with_sequence, count(*) FILTER (needs_sequence_enrichment) AS pending,
         count(*) FILTER (training_tier = 1) AS tier_1, count(*) FILTER (training_tier = 2) AS tier_2,
         count(*) FILTER (label = 1) AS positive, count(*) FILTER (label = 0) AS negative
       FROM (SELECT * FROM assayed_rows UNION ALL SELECT * FROM benchmark_rows) x""",
)
def build_master(spark, sf):
    master = curated.build_master(
        _assayed(spark, sf), curated.from_benchmark(derived(spark, sf, "pairlist"))
    )
    return curated.master_summary(master)


@query(
    "load_curated_db",
    """SELECT row_id, sq AS aptamer_sequence, trim(target) AS target_name, CASE WHEN k > 0 THEN k END AS kd_value,
         CASE WHEN k > 0 THEN 'nM' END AS kd_unit, doi AS source_doi, conf AS confidence_score
       FROM (SELECT *, TRY_CAST(kd AS DOUBLE) AS k, upper(CASE WHEN src = 'aptamerbase' THEN replace(sequence, '-', '') ELSE sequence END) AS sq
         FROM curated_export, (VALUES ('utexas','10.5281/zenodo.8264921','curated'), ('aptamerbase','github.com/micheldumontier/aptamerbase','non-curated'),
           ('li2014','10.1371/journal.pone.0086729','curated')) v(src, doi, conf)) x
       WHERE trim(target) <> '' AND regexp_full_match(sq, '[ATGC]+') AND length(sq) BETWEEN 20 AND 120 AND NOT (src = 'utexas' AND na_type = 'ssRNA')""",
)
def load_curated_db(spark, sf):
    export = derived(spark, sf, "curated_export")
    named = export.select(
        "row_id", F.col("sequence").alias("Sequence"), F.col("target").alias("Target"),
        F.col("kd").alias("Kd (nM)"), F.col("na_type").alias("Type"), F.col("ph").alias("pH"),
        F.col("buf").alias("Buffer"),
    )
    parts = [
        curated.load_curated(named, "utexas"),
        curated.load_curated(export, "aptamerbase"), curated.load_curated(export, "li2014"),
    ]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return out.select(
        "row_id", "aptamer_sequence", "target_name", "kd_value", "kd_unit", "source_doi", "confidence_score"
    )


# --- de-duplication ---------------------------------------------------------

CHECKS["deduped"] = """
  SELECT * FROM legacy QUALIFY row_number() OVER (PARTITION BY upper(sequence), lower(target_protein) ORDER BY row_id) = 1"""
CHECKS["rc_rows"] = """
  SELECT d.row_id, upper(sequence) AS s, reverse(translate(upper(sequence), 'ATGC', 'TACG')) AS r,
    least(upper(sequence), reverse(translate(upper(sequence), 'ATGC', 'TACG'))) AS g FROM deduped d WHERE sequence IS NOT NULL"""
CHECKS["rc_side"] = """
  SELECT *, s = r AS pal, s = first_value(s) OVER (PARTITION BY g ORDER BY row_id) AS is_a FROM rc_rows"""
CHECKS["rc_group"] = """
  SELECT g, bool_or(pal) AS pal, count(*) AS n, max(row_id) AS last_all, max(row_id) FILTER (is_a) AS last_a, min(row_id) FILTER (NOT is_a) AS first_b,
    max(row_id) FILTER (NOT is_a) AS last_b, count(*) FILTER (NOT is_a) AS n_b FROM rc_side GROUP BY g"""
CHECKS["rc_gone"] = """
  SELECT row_id FROM rc_side JOIN rc_group USING (g) WHERE (rc_group.pal AND n > 1 AND row_id = last_all)
    OR (NOT rc_group.pal AND n_b > 0 AND (row_id = last_b OR (n_b >= 2 AND first_b < last_a AND row_id = last_a)
      OR (n_b >= 2 AND first_b > last_a AND NOT is_a)))"""


@query("exact_dedup", "SELECT row_id, sequence, target_protein, source FROM deduped")
def exact_dedup(spark, sf):
    return dedup.exact_dedup(derived(spark, sf, "legacy")).select(
        "row_id", "sequence", "target_protein", "source"
    )


@query(
    "rc_pair_dedup",
    """SELECT row_id, CASE WHEN row_id IN (SELECT row_id FROM rc_gone) THEN 'dropped' ELSE 'kept' END AS fate FROM deduped""",
)
def rc_pair_dedup(spark, sf):
    rows = derived(spark, sf, "legacy").select("row_id", "sequence", "target_protein")
    first = durable(dedup.exact_dedup(rows))  # the rules of a group and its rows read it
    return dedup.rc_marked(first).select("row_id", F.when(F.col("rc_gone"), "dropped").otherwise("kept").alias("fate"))


CHECKS["known_keys"] = """
  SELECT DISTINCT upper(trim(sequence)) AS s, lower(trim(target_protein)) AS t FROM master"""


def _master(spark, sf):
    return derived(spark, sf, "master")


CHECKS["batch_fate"] = """
  SELECT row_id, source_type, n_errors, s IS NOT NULL AS known,
    row_number() OVER (PARTITION BY n_errors = 0, upper(trim(aptamer_sequence)), lower(trim(target_name)) ORDER BY row_id) AS rn
  FROM record_flags LEFT JOIN known_keys ON s = upper(trim(aptamer_sequence)) AND t = lower(trim(target_name))"""


@query(
    "dedup_against_master",
    """SELECT row_id, CASE WHEN rn = 1 AND NOT known THEN 'unique' ELSE 'duplicate' END AS fate FROM
         (SELECT row_id, s IS NOT NULL AS known, row_number() OVER (PARTITION BY upper(trim(aptamer_sequence)), lower(trim(target_name)) ORDER BY row_id) AS rn
          FROM text_records LEFT JOIN known_keys ON s = upper(trim(aptamer_sequence)) AND t = lower(trim(target_name))) x""",
)
def dedup_against_master(spark, sf):
    marked = dedup.mark_against(derived(spark, sf, "text_records"), _master(spark, sf))
    return marked.select("row_id", F.when(F.col("is_new"), "unique").otherwise("duplicate").alias("fate"))


@query(
    "merge_stats",
    """SELECT coalesce(source_type, 'total') AS source_type, count(*) AS incoming, count(*) FILTER (n_errors = 0) AS valid, count(*) FILTER (n_errors > 0) AS invalid,
         count(*) FILTER (n_errors = 0 AND known) AS known_duplicates, count(*) FILTER (n_errors = 0 AND NOT known AND rn > 1) AS batch_duplicates,
         count(*) FILTER (n_errors = 0 AND NOT known AND rn = 1) AS new_rows FROM batch_fate GROUP BY ROLLUP (source_type)""",
)
def merge_stats(spark, sf):
    return audit.batch_stats(derived(spark, sf, "text_records"), _master(spark, sf))


@query(
    "merge_scraped",
    f"""SELECT l.* FROM as_legacy l JOIN text_records t ON t.row_id = l.row_id
        WHERE t.nucleic_acid_type = 'ssDNA' AND t.target_type = 'protein' AND {_OK_DNA.format('l.sequence')} AND l.target_protein <> ''
          AND NOT EXISTS (SELECT 1 FROM known_keys k WHERE k.s = l.sequence AND k.t = lower(l.target_protein))
        QUALIFY row_number() OVER (PARTITION BY l.sequence, l.target_protein ORDER BY l.row_id) = 1""",
)
def merge_scraped(spark, sf):
    return enrich.merge_scraped(derived(spark, sf, "text_records"), _master(spark, sf)).select(
        "row_id", "sequence", "target_protein", "uniprot_id", "Kd_nM", "pH", "salt_mM", "temp_C",
        "mg_mM", "buffer_type", "source_pmid", "source",
    )


@query(
    "except_master",
    """SELECT DISTINCT upper(trim(aptamer_sequence)) AS s, lower(trim(target_name)) AS t FROM text_records EXCEPT SELECT s, t FROM known_keys""",
)
def except_master(spark, sf):
    s, t = dedup.record_key(F.col("aptamer_sequence"), F.col("target_name"))
    new = derived(spark, sf, "text_records").select(s.alias("s"), t.alias("t"))
    ks, kt = dedup.record_key(F.col("sequence"), F.col("target_protein"))
    return new.subtract(_master(spark, sf).select(ks.alias("s"), kt.alias("t")))


@query("distinct_keys", "SELECT DISTINCT target_name, upper(aptamer_sequence) AS seq FROM records")
def distinct_keys(spark, sf):
    return derived(spark, sf, "records").select(
        "target_name", F.upper("aptamer_sequence").alias("seq")
    ).distinct()


@query(
    "union_sources",
    """SELECT source, count(*) AS n, count(sequence) AS with_sequence FROM
         (SELECT source, sequence FROM assayed_rows UNION ALL SELECT source, sequence FROM benchmark_rows UNION ALL SELECT source, sequence FROM legacy) x GROUP BY source""",
)
def union_sources(spark, sf):
    master = curated.build_master(
        _assayed(spark, sf), curated.from_benchmark(derived(spark, sf, "pairlist")),
        derived(spark, sf, "legacy"),
    )
    return master.groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.count("sequence").alias("with_sequence")
    )


# --- interaction tables -----------------------------------------------------

CHECKS["pairs"] = """
  SELECT a.inter, a.participant AS aptamer_uri, a.kd_molar, b.participant_label AS target_name, t.label, t.has_modification_details,
    nullif(regexp_extract(trim(t.label), '^([0-9]+)', 1), '') AS pmid, upper(t.sequence) AS sequence_clean
  FROM participants a JOIN participants b ON a.inter = b.inter AND starts_with(b.participant, 'tgt')
  JOIN aptamer_table t ON t.id = a.participant WHERE t.sequence IS NOT NULL"""


_PAIR_ORDER = ("int", "aptamer_uri", "target_name", "kd_molar")


def _pairs(spark, sf):
    p = derived(spark, sf, "participants").select(
        F.col("inter").alias("int"), F.col("participant").alias("has_participant"),
        "participant_label", F.col("kd_molar").alias("dissociation_constant_value"),
    )
    return enrich.interaction_pairs(derived(spark, sf, "aptamer_table"), p)


@query(
    "interaction_pairs",
    "SELECT inter, aptamer_uri, target_name, kd_molar, label, pmid, sequence_clean FROM pairs",
)
def interaction_pairs(spark, sf):
    out = _pairs(spark, sf)
    return out.select(
        F.col("int").alias("inter"), "aptamer_uri", "target_name", "kd_molar", "label", "pmid", "sequence_clean"
    )


CHECKS["first_label"] = """
  SELECT lower(trim(label)) AS label_key, sequence_clean, pmid, target_name, kd_molar FROM pairs
  QUALIFY row_number() OVER (PARTITION BY lower(trim(label)) ORDER BY inter, aptamer_uri, target_name, kd_molar NULLS FIRST) = 1"""


@query("label_lookup", "SELECT * FROM first_label")
def label_lookup(spark, sf):
    return enrich.label_lookup(_pairs(spark, sf), _PAIR_ORDER)


@query(
    "backfill_sequences",
    """SELECT row_id, coalesce(CASE WHEN flag THEN sequence_clean END, sequence) AS sequence,
         CASE WHEN flag AND sequence_clean IS NOT NULL AND kd_molar IS NOT NULL THEN kd_molar * 1e9 ELSE Kd_nM END AS Kd_nM,
         flag AND sequence_clean IS NULL AS needs_sequence_enrichment
       FROM (SELECT row_id, sequence, Kd_nM, row_id % 2 = 1 AS flag, lower(concat(1000 + row_id % 300, '-', target_protein, '-1')) AS k FROM legacy) m
       LEFT JOIN (SELECT * FROM first_label WHERE regexp_full_match(sequence_clean, '[ATGC]+') AND length(sequence_clean) BETWEEN 20 AND 120) l ON l.label_key = m.k AND m.flag""",
)
def backfill_sequences(spark, sf):
    key = F.concat((F.col("row_id") % 300 + 1000).cast("string"), F.lit("-"), "target_protein", F.lit("-1"))
    master = derived(spark, sf, "legacy").select(
        "row_id", "sequence", "Kd_nM", (F.col("row_id") % 2 == 1).alias("needs_sequence_enrichment"),
        key.alias("label_key"),
    )
    return enrich.backfill_sequences(master, enrich.label_lookup(_pairs(spark, sf), _PAIR_ORDER))


@query(
    "new_rows_anti",
    f"""SELECT sequence_clean AS sequence, target_name AS target_protein, round(kd_molar * 1e9, 6) AS Kd_nM, pmid AS source_pmid FROM pairs
        WHERE has_modification_details IS NULL AND {_OK_DNA.format('sequence_clean')}
          AND sequence_clean NOT IN (SELECT upper(trim(CASE WHEN row_id % 20 < 4 THEN sequence ELSE sequence || 'AC' END)) FROM legacy WHERE sequence IS NOT NULL)
        QUALIFY row_number() OVER (PARTITION BY sequence_clean, target_name ORDER BY inter, aptamer_uri, target_name, kd_molar NULLS FIRST) = 1""",
)
def new_rows_anti(spark, sf):
    master = derived(spark, sf, "legacy").withColumn(
        "sequence", F.when(F.col("row_id") % 20 < 4, F.col("sequence")).otherwise(F.concat("sequence", F.lit("AC")))
    )
    return enrich.new_rows(_pairs(spark, sf), master, _PAIR_ORDER).select(
        "sequence", "target_protein", F.round("Kd_nM", 6).alias("Kd_nM"), "source_pmid"
    )


# --- fills and lookups ------------------------------------------------------


@query(
    "curated_merge",
    """SELECT row_id, upper(sequence) AS seq, target_protein AS target_name, label, CAST(training_tier AS INTEGER) AS training_tier FROM master
       UNION ALL SELECT row_id, aptamer_sequence, target_name, 1, 2 FROM text_records t WHERE NOT EXISTS
         (SELECT 1 FROM master l WHERE upper(l.sequence) = upper(t.aptamer_sequence) AND lower(l.target_protein) = lower(t.target_name))""",
)
def curated_merge(spark, sf):
    base = mapping.to_cleaned(_master(spark, sf))
    out = enrich.curated_merge(base, derived(spark, sf, "text_records"))
    return out.select(
        "row_id", F.col("aptamer_sequence").alias("seq"), "target_name", "label", "training_tier"
    )


@query(
    "backfill_protein_by_id",
    """SELECT r.row_id, coalesce(r.protein_sequence, f.ps) AS protein_sequence FROM records r LEFT JOIN
         (SELECT target_id, arg_min(protein_sequence, row_id) AS ps FROM records WHERE length(protein_sequence) > 10 AND target_id IS NOT NULL GROUP BY target_id) f USING (target_id)""",
)
def backfill_protein_by_id(spark, sf):
    return enrich.backfill_by_id(derived(spark, sf, "records")).select("row_id", "protein_sequence")


CHECKS["assigned"] = """
  SELECT l.*, coalesce(['train','val','test'][r], 'unassigned') AS split FROM legacy l LEFT JOIN
    (SELECT upper(sequence) AS s, lower(target_protein) AS t, min(CASE split WHEN 'train' THEN 1 WHEN 'val' THEN 2 ELSE 3 END) AS r
     FROM old_splits WHERE split <> 'train' OR NOT augmented GROUP BY 1, 2) o ON o.s = upper(l.sequence) AND o.t = lower(l.target_protein)"""


@query("assign_existing_splits", "SELECT row_id, split FROM assigned")
def assign_existing_splits(spark, sf):
    return enrich.assign_existing(
        derived(spark, sf, "legacy"), derived(spark, sf, "old_splits")
    ).select("row_id", "split")


@query(
    "merge_extra_data",
    """SELECT row_id, aptamer_sequence, target_name, label, training_tier, split FROM records
       UNION ALL SELECT row_id, aptamer_sequence, target_name, 1, 2, split FROM text_records WHERE regexp_full_match(aptamer_sequence, '[ATGC]+')
         AND (contains(lower(target_name), 'insulin') OR contains(lower(target_name), 'albumin') OR contains('albumin', lower(target_name)) OR contains('insulin', lower(target_name)))""",
)
def merge_extra_data(spark, sf):
    columns = ["row_id", "aptamer_sequence", "target_name", "label", "training_tier", "split"]
    base = derived(spark, sf, "records").select(*columns)
    return enrich.merge_extra(
        base, derived(spark, sf, "text_records"), ["insulin", "albumin"]
    ).select(*columns)


@query(
    "resolve_override",
    """SELECT row_id, target_name, p.accession, p.protein_sequence AS found_sequence FROM records r
       LEFT JOIN (SELECT lower(trim(name)) AS k, min(accession) AS accession FROM overrides GROUP BY 1) o ON o.k = lower(trim(r.target_name))
       LEFT JOIN proteins p ON p.accession = o.accession""",
)
def resolve_override(spark, sf):
    return enrich.resolve_override(
        derived(spark, sf, "records").select("row_id", "target_name"), derived(spark, sf, "overrides"),
        derived(spark, sf, "proteins"),
    )


CHECKS["protein_names"] = """
  SELECT accession, protein_sequence, split_part('Human serum albumin precursor|lysozyme C|Thrombin heavy chain|nucleolin|insulin chain B|streptavidin core|binding protein GTP', '|',
    CAST(CAST(substr(accession, 4) AS BIGINT) % 7 + 1 AS INT)) AS protein_name, CAST(substr(accession, 4) AS BIGINT) % 2 = 0 AS is_human FROM proteins"""


@query(
    "resolve_exact_fuzzy",
    f"""WITH cand AS (
          SELECT t.target_name, p.accession, 0 AS strategy, 1.0::DOUBLE AS score FROM (SELECT DISTINCT target_name FROM records) t
          JOIN (SELECT lower(trim(name)) AS k, min(accession) AS accession FROM overrides GROUP BY 1) o ON o.k = lower(trim(t.target_name))
          JOIN proteins p ON p.accession = o.accession
          UNION ALL
          SELECT t.target_name, p.accession, CASE WHEN p.is_human THEN 1 ELSE 2 END AS strategy, 1.0::DOUBLE AS score
          FROM (SELECT DISTINCT target_name FROM records) t JOIN protein_names p ON lower(p.protein_name) = lower(t.target_name)
          UNION ALL
          SELECT q.target_name, p.accession, CASE WHEN p.is_human THEN 3 ELSE 4 END, len(list_intersect(q.w, p.r)) / len(q.w)
          FROM (SELECT target_name, list_distinct(regexp_extract_all(array_to_string(toks, ' '), '\\b\\w+\\b')) AS w FROM
                 (SELECT target_name, list_filter(regexp_extract_all(lower(target_name), '\\b[\\w-]+\\b'), lambda x: length(x) > 1 AND x NOT IN ({_sql_list(fv.NOISE_WORDS)})) AS toks
                  FROM (SELECT DISTINCT target_name FROM records) d) e
                WHERE len(toks) > 0 AND array_to_string(toks, ' ') <> lower(target_name)) q,
               (SELECT accession, is_human, list_distinct(regexp_extract_all(lower(protein_name), '\\b\\w+\\b')) AS r FROM protein_names) p
          WHERE len(list_intersect(q.w, p.r)) / len(q.w) >= 0.8)
        SELECT target_name, accession, CAST(strategy AS INTEGER) AS strategy, score FROM cand
        QUALIFY row_number() OVER (PARTITION BY target_name ORDER BY strategy, score DESC, accession) = 1""",
)
def resolve_exact_fuzzy(spark, sf):
    number = F.substring("accession", 4, 10).cast("bigint")
    full = F.split_part(
        F.lit("Human serum albumin precursor|lysozyme C|Thrombin heavy chain|nucleolin|insulin chain B|"
              "streptavidin core|binding protein GTP"), F.lit("|"), (number % 7 + 1).cast("int"),
    )
    proteins = derived(spark, sf, "proteins").select(
        "accession", "protein_sequence", full.alias("protein_name"), (number % 2 == 0).alias("is_human")
    )
    twice = proteins.unionByName(proteins.where(number % 3 == 0))  # landed again
    return enrich.resolve_names(derived(spark, sf, "records"), twice, derived(spark, sf, "overrides")).select(
        "target_name", "accession", "strategy", "score"
    )


@query(
    "resolve_compound_ids",
    """SELECT row_id, CASE WHEN target_type = 'small_molecule' AND cid IS NOT NULL THEN concat('CID:', cid) ELSE target_id END AS target_id,
         CASE WHEN target_type = 'small_molecule' AND cid IS NOT NULL THEN 'PubChem' ELSE target_id_source END AS target_id_source, 'row' AS part, NULL AS miss
       FROM records LEFT JOIN compound_ids ON name = target_name
       UNION ALL SELECT DISTINCT NULL::BIGINT, NULL, NULL, 'miss', target_name FROM records WHERE target_type = 'small_molecule' AND target_name NOT IN (SELECT name FROM compound_ids)""",
)
def resolve_compound_ids(spark, sf):
    filled, misses = enrich.resolve_compounds(
        derived(spark, sf, "records"), derived(spark, sf, "compound_ids")
    )
    return filled.select(
        "row_id", "target_id", "target_id_source", F.lit("row").alias("part"),
        F.lit(None).cast("string").alias("miss"),
    ).unionByName(
        misses.select(F.lit("miss").alias("part"), F.col("target_name").alias("miss")),
        allowMissingColumns=True,
    )


CHECKS["found_proteins"] = """
  SELECT DISTINCT CASE WHEN length(target_name) % 2 = 0 THEN target_name ELSE concat(target_name, '?') END AS target_name,
    concat('Q', substr(md5(target_name), 1, 5)) AS accession, concat('MKF', upper(md5(target_name))) AS seq FROM records"""


@query(
    "enrich_fill",
    """SELECT row_id, CASE WHEN h THEN accession ELSE target_id END AS target_id, CASE WHEN h THEN 'UniProt' ELSE target_id_source END AS target_id_source,
         CASE WHEN h THEN seq ELSE protein_sequence END AS protein_sequence
       FROM (SELECT r.*, f.accession, f.seq, f.seq IS NOT NULL AND r.protein_sequence IS NULL AS h FROM records r LEFT JOIN
         (SELECT * FROM found_proteins WHERE target_name IN (SELECT target_name FROM records WHERE protein_sequence IS NULL AND target_type = 'protein')) f ON f.target_name = r.target_name) y""",
)
def enrich_fill(spark, sf):
    df = derived(spark, sf, "records")
    digest = F.md5(F.col("target_name").cast("binary"))
    known = F.when(F.length("target_name") % 2 == 0, F.col("target_name")).otherwise(F.concat("target_name", F.lit("?")))
    found = df.select(
        known.alias("target_name"), F.concat(F.lit("Q"), F.substring(digest, 1, 5)).alias("accession"),
        F.concat(F.lit("MKF"), F.upper(digest)).alias("protein_sequence"),
    ).distinct()
    return enrich.enrich_fill(df, found).select(
        "row_id", "target_id", "target_id_source", "protein_sequence"
    )


@query(
    "top_targets",
    """SELECT target_name, count(*) AS n FROM records WHERE protein_sequence IS NULL GROUP BY 1 ORDER BY n DESC, target_name LIMIT 10""",
)
def top_targets(spark, sf):
    return enrich.top_targets(derived(spark, sf, "records"), 10)


@query(
    "corrections_patch",
    """SELECT row_id, CASE WHEN row_id % 50 = 0 THEN row_id / 2.0 ELSE kd_value END AS kd_value, CASE WHEN row_id % 50 = 0 AND row_id % 100 = 0 THEN 'fixed' ELSE target_name END AS target_name FROM records
       UNION ALL SELECT row_id + 1000000000, row_id / 2.0, CASE WHEN row_id % 100 = 0 THEN 'fixed' END FROM records WHERE row_id % 50 = 0""",
)
def corrections_patch(spark, sf):
    df = derived(spark, sf, "records").select("row_id", "kd_value", "target_name")
    patch = df.where("row_id % 50 = 0").select(
        "row_id", (F.col("row_id") / 2.0).alias("kd_value"),
        F.when(F.col("row_id") % 100 == 0, "fixed").alias("target_name"),
    )
    added = patch.withColumn("row_id", F.col("row_id") + 1000000000)
    return enrich.apply_patch(df, patch.unionByName(added), ["row_id"], ["kd_value", "target_name"])


@query(
    "limit_per_source",
    "SELECT row_id, source FROM legacy QUALIFY row_number() OVER (PARTITION BY source ORDER BY row_id) <= 100",
)
def limit_per_source(spark, sf):
    return audit.limit_per_source(derived(spark, sf, "legacy"), 100, "source").select("row_id", "source")


# --- names ------------------------------------------------------------------

CHECKS["spellings"] = """
  SELECT target_name AS name, lower(trim(target_name)) AS norm, count(*) AS n FROM records GROUP BY 1, 2"""
CHECKS["best_spelling"] = """
  SELECT norm, CASE WHEN count(*) FILTER (ascii(name) BETWEEN 65 AND 90) = 1 THEN min(name) FILTER (ascii(name) BETWEEN 65 AND 90)
    ELSE coalesce(min(name) FILTER (regexp_matches(name, '^[^A-Za-z]*[A-Z]')), min(name)) END AS canonical
  FROM (SELECT *, max(n) OVER (PARTITION BY norm) AS top FROM spellings) x WHERE n = top GROUP BY norm"""


@query(
    "canonical_name",
    "SELECT row_id, canonical AS target_name FROM records JOIN best_spelling ON norm = lower(trim(records.target_name))",
)
def canonical_name(spark, sf):
    return canonical.canonicalise_names(derived(spark, sf, "records")).select("row_id", "target_name")


@query(
    "rename_log",
    "SELECT name AS old_value, canonical AS new_value, n AS rows_affected FROM spellings JOIN best_spelling USING (norm) WHERE name <> canonical",
)
def rename_log(spark, sf):
    return canonical.rename_log(derived(spark, sf, "records"))


@query(
    "casing_contamination",
    """SELECT lower(trim(target_name)) AS norm, count(DISTINCT target_name) AS variants, count(*) FILTER (split = 'train') AS train_rows,
         count(*) FILTER (split = 'val') AS val_rows, count(*) FILTER (split = 'test') AS test_rows, count(*) FILTER (split = 'unassigned') AS unassigned_rows,
         count(DISTINCT CASE WHEN split <> 'unassigned' THEN split END) AS splits FROM records GROUP BY 1 HAVING count(DISTINCT target_name) > 1""",
)
def casing_contamination(spark, sf):
    return canonical.casing_contamination(derived(spark, sf, "records"))


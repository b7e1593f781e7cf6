"""Curated binder tables and the master built from them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom import fixed_values as fv
from strandloom.functions import measure, names, sequence
from strandloom.operators.mapping import legacy_row
from strandloom.operators.validate import keep_valid
from strandloom.functions.space import strip


def from_assayed(df: DataFrame) -> DataFrame:
    """Assayed binders: ssDNA rows only, cleaned sequence, label 1."""
    target = strip("Target")
    carried = ["row_id"] if "row_id" in df.columns else []
    return df.where(F.col("Type of Nucleic Acid") == "ssDNA").select(
        *carried,
        *legacy_row(
            sequence=sequence.clean_sequence(F.col("Aptamer Sequence")),
            target_protein=target,
            Kd_nM=F.col("Kd (nM)").cast("double"),
            pH=F.coalesce(F.col("pH").cast("double"), F.lit(fv.DEFAULT_PH)),
            buffer_type=measure.buffer_code(F.col("Type of the buffer")),
            source_pmid=names.pmid_from_url(F.col("Link to PubMed Entry")),
            training_tier=names.assign_tier(target),
            source=F.lit("utexas"),
        ),
    )


def from_benchmark(df: DataFrame) -> DataFrame:
    """Positive/negative pairs without sequences, flagged for enrichment."""
    target = strip(F.translate("target_id", "_", " "))
    carried = ["row_id"] if "row_id" in df.columns else []
    return df.select(
        *carried,
        *legacy_row(
            sequence=F.lit(None).cast("string"),
            target_protein=target,
            label=F.when(F.lower(strip("class")) == "positive", 1).otherwise(0),
            source_pmid=measure.group(F.col("aptamer_id"), r"^(\d+)-", 1),
            training_tier=names.assign_tier(target),
            needs_sequence_enrichment=F.lit(True),
            source=F.lit("li2014"),
        ),
    )


def build_master(*parts: DataFrame) -> DataFrame:
    """Union of the sources in the legacy column order."""
    if not parts:
        raise ValueError("no sources")
    joined = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    lead = ["row_id"] if "row_id" in joined.columns else []
    return joined.select(*lead, *fv.LEGACY_COLUMNS)


def master_summary(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("sequence").isNotNull()).alias("with_sequence"),
        F.count_if("needs_sequence_enrichment").alias("pending"),
        F.count_if(F.col("training_tier") == 1).alias("tier_1"),
        F.count_if(F.col("training_tier") == 2).alias("tier_2"),
        F.count_if(F.col("label") == 1).alias("positive"),
        F.count_if(F.col("label") == 0).alias("negative"),
    )


def _first_alias(df: DataFrame, aliases) -> Column:
    found = [F.nullif(strip(F.col(f"`{a}`")), F.lit("")) for a in aliases if a in df.columns]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def _positive(c: Column) -> Column:
    x = strip(c).try_cast("double")
    return F.when(x > 0, x)


def load_curated(df: DataFrame, source: str) -> DataFrame:
    """A curated export as valid records; RNA and foreign letters are skipped.

    ``df`` has string columns under any of the known headers.
    """
    spec = fv.CURATED_SOURCES[source]
    if source == "utexas":
        df = df.withColumnsRenamed({k: v for k, v in fv.CURATED_RENAMES.items() if k in df.columns})
    raw = F.upper(F.translate(_first_alias(df, fv.SEQUENCE_ALIASES), " -" if spec["strip_dash"] else " ", ""))
    target = strip(_first_alias(df, fv.TARGET_ALIASES))
    kd = _positive(F.col("kd_value") if source == "utexas" and "kd_value" in df.columns
                   else _first_alias(df, fv.KD_ALIASES))
    null = F.lit(None).cast("string")

    def condition(name):
        known = source == "utexas" and name in df.columns
        return _positive(F.col(name)) if known else F.lit(None).cast("double")

    rows = df
    if source == "utexas" and "nucleic_acid_type" in df.columns:
        rows = rows.where(~F.coalesce(F.lower("nucleic_acid_type").contains("rna"), F.lit(False)))
    carried = ["row_id"] if "row_id" in df.columns else []
    out = {
        "aptamer_sequence": raw, "nucleic_acid_type": F.lit("ssDNA"), "modifications": F.lit("none"),
        "target_name": target, "target_type": names.classify_rules(target), "target_id": null,
        "target_id_source": null, "kd_value": kd, "kd_unit": F.when(kd.isNotNull(), "nM"),
        "assay_type": null,
        "selection_buffer": F.nullif(strip("selection_buffer"), F.lit(""))
        if source == "utexas" and "selection_buffer" in df.columns else null,
        "binding_buffer": null, "ph": condition("ph"),
        "na_concentration_mM": condition("na_concentration_mM"),
        "mg_concentration_mM": condition("mg_concentration_mM"),
        "temperature_C": condition("temperature_C"),
        "source_doi": F.lit(spec["source_doi"]), "source_type": F.lit("database"),
        "confidence_score": F.lit(spec["confidence"]), "split": F.lit("train"),
    }
    records = rows.where(
        target.isNotNull() & raw.rlike("^[ATGC]+$") & F.length(raw).between(fv.SEQ_MIN_LEN, fv.SEQ_MAX_LEN)
    ).select(*carried, *[c.alias(n) for n, c in out.items()])
    return keep_valid(records)

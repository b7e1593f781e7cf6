"""Schema mapping between the legacy, record and cleaned tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom import fixed_values as fv
from strandloom.functions import measure, names
from strandloom.functions.space import strip


def blank_to_null(c: Column) -> Column:
    text = strip(c.cast("string"))
    return F.when(~F.lower(text).isin("", "nan", "n/a", "na"), text)


def canonicalise(df: DataFrame) -> DataFrame:
    """Rename legacy columns to the cleaned names; a cleaned frame stays."""
    if {"target_name", "aptamer_sequence"} <= set(df.columns):
        return df
    renames = {
        "sequence": "aptamer_sequence", "target_protein": "target_name",
        "uniprot_id": "target_id", "Kd_nM": "kd_value", "pH": "ph",
        "salt_mM": "na_concentration_mM", "mg_mM": "mg_concentration_mM",
        "temp_C": "temperature_C", "source_pmid": "source_doi", "source": "source_type",
    }
    return df.withColumnsRenamed({k: v for k, v in renames.items() if k in df.columns})


def fill_defaults(df: DataFrame) -> DataFrame:
    return df.na.fill(
        {
            "ph": fv.DEFAULT_PH, "na_concentration_mM": fv.DEFAULT_SALT_MM,
            "mg_concentration_mM": fv.DEFAULT_MG_MM, "temperature_C": fv.DEFAULT_TEMP_C,
            "binding_buffer": fv.DEFAULT_BUFFER_NAME,
        }
    )


def legacy_row(**columns: Column) -> list[Column]:
    """Legacy columns in order; what is not given takes its default."""
    base = {
        "uniprot_id": F.lit(None).cast("string"),
        "protein_sequence": F.lit(None).cast("string"),
        "Kd_nM": F.lit(None).cast("double"),
        "pH": F.lit(fv.DEFAULT_PH), "salt_mM": F.lit(fv.DEFAULT_SALT_MM),
        "temp_C": F.lit(fv.DEFAULT_TEMP_C), "mg_mM": F.lit(fv.DEFAULT_MG_MM),
        "buffer_type": F.lit(fv.DEFAULT_BUFFER_CODE), "label": F.lit(1),
        "source_pmid": F.lit(None).cast("string"), "training_tier": F.lit(1),
        "augmented": F.lit(False), "aug_method": F.lit(None).cast("string"),
        "needs_sequence_enrichment": F.lit(False),
        **columns,
    }
    return [base[n].alias(n) for n in fv.LEGACY_COLUMNS]


def to_legacy(df: DataFrame) -> DataFrame:
    """Record rows as legacy rows; a ``row_id`` is carried along when present."""
    kd = F.col("kd_value").try_cast("double")

    def default(name, value):
        return F.coalesce(F.col(name).try_cast("double"), F.lit(value))

    buffer = F.coalesce(
        blank_to_null(F.col("binding_buffer")), blank_to_null(F.col("selection_buffer"))
    )
    carried = ["row_id"] if "row_id" in df.columns else []
    return df.select(
        *carried,
        *legacy_row(
            sequence=F.upper(strip(F.col("aptamer_sequence"))),
            target_protein=strip(F.col("target_name")),
            uniprot_id=F.when(
                strip(F.col("target_id_source")) == "UniProt", blank_to_null(F.col("target_id"))
            ),
            Kd_nM=F.when(kd >= 0, kd),
            pH=default("ph", fv.DEFAULT_PH),
            salt_mM=default("na_concentration_mM", fv.DEFAULT_SALT_MM),
            temp_C=default("temperature_C", fv.DEFAULT_TEMP_C),
            mg_mM=default("mg_concentration_mM", fv.DEFAULT_MG_MM),
            buffer_type=measure.buffer_code(buffer),
            source_pmid=blank_to_null(F.col("source_doi")),
            source=names.map_values(F.col("source_type"), fv.TYPE_TO_SOURCE, "scraped"),
        ),
    )


def to_cleaned(df: DataFrame) -> DataFrame:
    """Legacy rows (with the columns the earlier phases added) as cleaned rows."""
    has = set(df.columns)
    opt = lambda n, default: F.col(n) if n in has else default
    null = F.lit(None).cast("string")
    carried = ["row_id"] if "row_id" in has else []
    out = {
        "aptamer_sequence": F.upper("sequence"),
        "nucleic_acid_type": opt("nucleic_acid_type", F.lit("ssDNA")),
        "modifications": opt("modifications", F.lit("none")),
        "target_name": F.col("target_protein"),
        "target_type": opt("target_type", F.lit("protein")),
        "target_id": opt("target_id", F.col("uniprot_id")),
        "target_id_source": opt("target_id_source", null),
        "kd_value": F.col("Kd_nM"),
        "kd_unit": F.when(F.col("Kd_nM").isNotNull(), "nM"),
        "assay_type": null, "selection_buffer": null,
        "binding_buffer": measure.buffer_name(F.col("buffer_type")),
        "ph": F.col("pH"), "na_concentration_mM": F.col("salt_mM"),
        "mg_concentration_mM": F.col("mg_mM"), "temperature_C": F.col("temp_C"),
        "source_doi": names.format_source_id(F.col("source_pmid"), F.col("source")),
        "source_type": names.map_values(F.col("source"), fv.SOURCE_TO_TYPE, "other"),
        "confidence_score": names.confidence(
            F.col("source"), F.col("target_protein"), F.col("Kd_nM")
        ),
        "split": opt("split", F.lit("unassigned")),
        "protein_sequence": F.col("protein_sequence"),
        "label": F.col("label"), "training_tier": F.col("training_tier"),
    }
    return df.select(*carried, *[c.alias(n) for n, c in out.items()])


def clear_wrong_ids(df: DataFrame) -> DataFrame:
    """Only proteins and peptides may carry a UniProt id."""
    ok = F.col("target_type").isin("protein", "peptide")
    return df.withColumn("target_id", F.when(ok, F.col("uniprot_id"))).withColumn(
        "target_id_source", F.when(ok, "UniProt")
    )


def training_ready(df: DataFrame, variant: str = "augment") -> DataFrame:
    """Rows fit for training.

    augment: protein targets with both sequences; train: both sequences;
    finetune: both sequences and an assigned split.
    """
    ready = F.col("aptamer_sequence").isNotNull() & F.col("protein_sequence").isNotNull()
    if variant == "augment":
        ready = ready & (F.col("target_type") == "protein")
    elif variant == "finetune":
        ready = ready & F.col("split").isin(*fv.SPLITS)
    return df.where(ready)


def filter_targets(df: DataFrame, wanted, column: str = "target_name") -> DataFrame:
    return df.where(names.matches_targets(F.col(column), list(wanted)))

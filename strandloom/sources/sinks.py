"""Sinks: append-only records, provenance, splits, snapshots and reports."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from strandloom import fixed_values as fv
from strandloom import schemas
from strandloom.functions.text import utc_stamp
from strandloom.operators import dedup, validate


def _existing(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.schema(schemas.RECORD).parquet(path)
    except AnalysisException as problem:
        if "PATH_NOT_FOUND" in str(problem):
            return None
        raise


def append_unique(df: DataFrame, master_path: str, out_path: str) -> dict:
    """Append valid records neither master nor output has; never touch the master.

    ``df`` holds record columns and a unique ``row_id``.  The record contract is checked once, on the way to
    one verdict per key; the statistics come from there, and new rows are fetched by the ids in it.  Without
    new rows an empty table with the record schema is left behind.
    """
    if out_path.rstrip("/") == master_path.rstrip("/"):
        raise ValueError("the output must not be the master")
    spark = df.sparkSession
    known = [spark.read.parquet(master_path)]
    before = _existing(spark, out_path)
    if before is not None:
        known.append(before)
    seen = Observation("append_unique")
    checked = validate.validate_record(df).observe(
        seen, F.count(F.lit(1)).alias("incoming"), F.count_if("valid").alias("valid"), F.count_if(~F.col("valid")).alias("invalid"),
    )
    verdicts = dedup.merge_verdicts(checked, *known)
    new = verdicts.where(~F.col("_known"))
    added = df.join(new.select(F.col("_lead").alias("row_id")), "row_id", "left_semi")
    validate.to_records(added).write.mode("append").parquet(out_path)
    sums = verdicts.agg(
        F.coalesce(F.sum(F.when(F.col("_known"), F.col("_n"))), F.lit(0)).alias("known_duplicates"),
        F.coalesce(F.sum(F.when(~F.col("_known"), F.col("_n") - 1)), F.lit(0)).alias("batch_duplicates"),
        F.count_if(~F.col("_known")).alias("new_rows"),
    ).first()
    return {**seen.get, **sums.asDict()}


def provenance_rows(records: DataFrame) -> DataFrame:
    """Provenance columns of extracted records with the run's time stamp."""
    have = set(records.columns)
    out = []
    for f in schemas.PROVENANCE:
        if f.name == "extraction_timestamp":
            out.append(utc_stamp().alias(f.name))
        elif f.name in have:
            out.append(F.col(f.name).cast(f.dataType).alias(f.name))
        else:
            out.append(F.lit(None).cast(f.dataType).alias(f.name))
    return records.select(*out)


def write_provenance(records: DataFrame, path: str) -> None:
    provenance_rows(records).write.mode("append").json(path)


def write_splits(df: DataFrame, path: str) -> None:
    """One folder per split, so a reader of one split reads only that."""
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def phase_snapshot(df: DataFrame, folder: str, phase: int) -> DataFrame:
    """Write a phase and go on from the written table."""
    path = f"{folder.rstrip('/')}/phase{phase}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def report_text(stats: dict, title: str = "Run summary", stamp: datetime | None = None) -> str:
    """Plain-text report of a small dictionary of counts."""
    at = (stamp or datetime.now(timezone.utc)).strftime("%Y-%m-%d %H:%M:%S UTC")
    rule = "=" * 55
    width = max((len(k) for k in stats), default=0)
    lines = [f"{k:<{width}} : {v}" for k, v in stats.items()]
    return "\n".join([rule, title, f"Run at {at}", rule, *lines, rule]) + "\n"


def write_report(spark: SparkSession, stats: dict, path: str, title: str = "Run summary") -> None:
    one = spark.createDataFrame([(report_text(stats, title),)], "value string")
    one.coalesce(1).write.mode("overwrite").text(path)

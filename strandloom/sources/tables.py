"""Typed scans of landed tables and JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from strandloom import schemas


def read_table(
    spark: SparkSession, path: str, schema: T.StructType = schemas.LEGACY,
    as_text: bool = False, blank: bool = False, sep: str = ",",
) -> DataFrame:
    """CSV scan: typed by default, every column a string, or blanks for NULLs."""
    if as_text or blank:
        schema = T.StructType([T.StructField(f.name, T.StringType()) for f in schema])
    df = (
        spark.read.schema(schema)
        .option("header", True).option("sep", sep).option("enforceSchema", False)
        .option("nullValue", "").option("quote", '"').option("escape", '"')
        .csv(path)
    )
    return df.na.fill("") if blank else df


def read_records(
    spark: SparkSession, path: str, schema: T.StructType = schemas.RECORD
) -> DataFrame:
    """JSON lines; malformed lines are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_provenance(spark: SparkSession, path: str) -> DataFrame:
    return read_records(spark, path, schemas.PROVENANCE)


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Binary scan of landed documents: path, length, content."""
    return (
        spark.read.format("binaryFile").option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", True).load(path)
    )


def fingerprint(df: DataFrame, content: str = "content") -> DataFrame:
    """Add the SHA-256 of the content as ``source_file_hash``."""
    from pyspark.sql import functions as F

    return df.withColumn("source_file_hash", F.sha2(F.col(content), 256))

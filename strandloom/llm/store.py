"""Intermediate tables that outlive a lost executor."""

from __future__ import annotations

from pyspark.sql import DataFrame

from strandloom.queries.registry import scratch

#: Shuffle files of a finished write are of no further use.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet under the folder that the cluster shares, and read it back.

    This cuts the lineage like a checkpoint, but takes less room, and later reads need only the columns they use.
    """
    spark = df.sparkSession
    path = f"{scratch(spark)}-stored"
    before = spark.conf.get(CLEAN, None)
    spark.conf.set(CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEAN)
        else:
            spark.conf.set(CLEAN, before)
    return spark.read.schema(df.schema).parquet(path)

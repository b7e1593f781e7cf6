"""One spelling per name, and the audits that go with it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom import fixed_values as fv
from strandloom.functions import names
from strandloom.operators import skew


def name_table(df: DataFrame, column: str = "target_name") -> DataFrame:
    """(norm, name, n, canonical) of every spelling.

    Majority wins.  On a tie a spelling with an upper-case start wins if it is
    the only one; else the alphabetically first whose first letter is upper
    case; else the alphabetically first.
    """
    counts = (
        df.where(F.col(column).isNotNull())
        .groupBy(F.col(column).alias("name")).agg(F.count(F.lit(1)).alias("n"))
        .withColumn("norm", names.deep_norm(F.col("name")))
    )
    titled = F.col("name").rlike(r"^\p{Lu}")
    letter = F.col("name").rlike(r"^\P{L}*\p{Lu}")
    group = counts.groupBy("norm", "n").agg(
        F.min(F.when(titled, F.col("name"))).alias("_titled"),
        F.count_if(titled).alias("_n_titled"),
        F.min(F.when(letter, F.col("name"))).alias("_letter"),
        F.min("name").alias("_plain"),
    )
    pick = F.when(F.col("_n_titled") == 1, F.col("_titled")).otherwise(
        F.coalesce("_letter", "_plain")
    )
    best = (
        group.groupBy("norm")
        .agg(F.max(F.struct("n", pick.alias("c")))["c"].alias("canonical"))
    )
    return counts.join(best, "norm")


def rename_log(df: DataFrame, column: str = "target_name") -> DataFrame:
    return name_table(df, column).where(F.col("name") != F.col("canonical")).select(
        F.col("name").alias("old_value"), F.col("canonical").alias("new_value"),
        F.col("n").alias("rows_affected"),
    )


def canonicalise_names(df: DataFrame, column: str = "target_name") -> DataFrame:
    """Rewrite the column; only spellings that change are joined."""
    log = rename_log(df, column).select(
        F.col("old_value").alias(column), F.col("new_value").alias("_new"), "rows_affected"
    )
    out = skew.spread_join(df, log, [column], "rows_affected")
    return out.withColumn(column, F.coalesce("_new", column)).select(*df.columns)


def casing_contamination(df: DataFrame) -> DataFrame:
    """Per normalised name with several spellings: spellings and split counts."""
    return (
        df.groupBy(names.deep_norm(F.col("target_name")).alias("norm"), "target_name", "split")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("norm")
        .agg(
            F.count_distinct("target_name").alias("variants"),
            *[
                F.sum(F.when(F.col("split") == s, F.col("n")).otherwise(0)).alias(f"{s}_rows")
                for s in (*fv.SPLITS, "unassigned")
            ],
            F.count_distinct(F.when(F.col("split").isin(*fv.SPLITS), F.col("split")))
            .alias("splits"),
        )
        .where("variants > 1")
    )

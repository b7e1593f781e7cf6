"""Seeded sampling by hash order; results do not depend on partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.operators import skew
from strandloom.session import durable


def hash_order(seed: int, key: str = "row_id") -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")).cast("binary"))


def sample_n(df: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """min(n, N) rows in hash order (the sampling operator's own limit)."""
    return df.withColumn("_h", hash_order(seed)).orderBy("_h", "row_id").limit(n).drop("_h")


def pick_per_class(df: DataFrame, n: int, label: str = "label", seed: int = 42) -> DataFrame:
    """n rows of every class in hash order."""
    hashed = df.withColumn("_h", hash_order(seed))
    return skew.first_n(hashed, [label], ["_h", "row_id"], n).drop("_h")


def balanced_sample(df: DataFrame, n: int, label: str = "label", seed: int = 42) -> DataFrame:
    """Exactly n draws with replacement, every class equally likely.

    Each draw hashes to the number of a class and to a rank within it.  Classes are a table, numbered in their
    order, with the interval of ranks that their rows take; a draw meets its class by number and its row by rank.  Only the
    number of classes comes to the driver.
    """
    counts = durable(df.groupBy(F.col(label).alias("_label")).agg(F.count(F.lit(1)).alias("rows_of")))
    order = [F.col("_label")]
    numbered = skew.global_rank(skew.running_totals(counts, order, ["rows_of"]), order, "_class")
    classes = numbered.select((F.col("_class") - 1).alias("_class"), F.col("rows_of").alias("_rows"), (F.col("cum_rows_of") - F.col("rows_of")).alias("_before"))
    ranked = skew.global_rank(df, [F.col(label), F.col("row_id")], "_pos")  # class by class: a class is a range of ranks
    draw = df.sparkSession.range(n).select(
        F.col("id").alias("draw"), F.pmod(_digits(seed, "class"), F.lit(counts.count())).alias("_class"), _digits(seed, "rank").alias("_u")
    )
    placed = draw.join(classes, "_class").select("draw", (F.pmod("_u", F.col("_rows")) + F.col("_before") + 1).alias("_pos"))
    return placed.join(ranked, "_pos").drop("_pos")


def _digits(seed: int, salt: str) -> Column:
    """A number from the first 15 hex digits of a hash of the draw."""
    h = F.md5(F.concat(F.lit(f"{seed}|{salt}|"), F.col("id").cast("string")).cast("binary"))
    return F.conv(F.substring(h, 1, 15), 16, 10).cast("bigint")

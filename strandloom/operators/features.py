"""Incremental feature caches keyed by the normalised sequence."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom import fixed_values as fv
from strandloom import schemas
from strandloom.operators import skew
from strandloom.session import durable
from strandloom.functions.space import strip


def cache_missing(df: DataFrame, cache: DataFrame, seq: str = "aptamer_sequence") -> DataFrame:
    """Distinct normalised sequences that are not in the cache."""
    keys = df.select(F.upper(strip(seq)).alias("sequence")).where("sequence IS NOT NULL").distinct()
    return keys.join(cache.select("sequence"), "sequence", "left_anti")


def attach_features(df: DataFrame, cache: DataFrame, seq: str = "aptamer_sequence") -> DataFrame:
    """Five structure features (zero when absent) and length/120."""
    names = ["mfe", "stem_count", "loop_count", "bp_prob_mean", "bp_prob_max"]
    table = cache.select(F.col("sequence").alias("_key"), *names)
    joined = skew.attach(df.withColumn("_key", F.upper(strip(seq))), table, ["_key"])
    present = F.col("mfe").isNotNull()
    out = [F.coalesce(F.col(n).cast("double"), F.lit(0.0)).alias(n) for n in names]
    return joined.select(
        *df.columns, *out,
        F.when(present, F.length("_key") / F.lit(float(fv.SEQ_MAX_LEN))).otherwise(0.0)
        .alias("rel_length"),
    )


def cache_coverage(df: DataFrame, cache: DataFrame, seq: str = "aptamer_sequence") -> DataFrame:
    """Rows and rows without a cached sequence per split."""
    per = df.groupBy(
        F.upper(strip(seq)).alias("sequence"), F.coalesce("split", F.lit("unassigned")).alias("split")
    ).agg(F.count(F.lit(1)).alias("n"))
    known = cache.select("sequence").distinct().withColumn("_hit", F.lit(True))
    return (
        per.join(known, "sequence", "left").groupBy("split")
        .agg(
            F.sum("n").alias("n"),
            F.sum(F.when(F.col("_hit").isNull() & F.col("sequence").isNotNull(), F.col("n"))
                  .otherwise(0)).alias("missing"),
        )
        .withColumn("missing_share", F.col("missing") / F.col("n"))
    )


def require_coverage(df: DataFrame, cache: DataFrame, limit: float = 0.01) -> None:
    """Raise when more than ``limit`` of a split is missing (one row per split)."""
    bad = cache_coverage(df, cache).where(F.col("missing_share") > limit).collect()
    if bad:
        gaps = ", ".join(f"{r['split']}: {r['missing']} of {r['n']}" for r in bad)
        raise ValueError(f"feature cache is incomplete ({gaps})")


def _empty(seq: str) -> dict:
    return {
        "sequence": seq, "mfe": 0.0, "structure": "." * len(seq), "stem_count": 0,
        "loop_count": 0, "bp_prob_mean": 0.0, "bp_prob_max": 0.0,
    }


def compute_features(keys: DataFrame, fold: Callable[[str], dict]) -> DataFrame:
    """Run a pluggable folding function over sequences; a failure gives zeros."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for s in batch["sequence"]:
                try:
                    rows.append({**_empty(s), **fold(s)})
                except Exception:
                    rows.append(_empty(s))
            yield pd.DataFrame(rows, columns=[f.name for f in schemas.STRUCTURE_FEATURES])

    return keys.mapInPandas(run, schemas.STRUCTURE_FEATURES)


def update_cache(df: DataFrame, cache: DataFrame, fold: Callable[[str], dict]) -> DataFrame:
    """The rows to append to the cache for the sequences it does not have."""
    return compute_features(cache_missing(df, cache), fold)


def empty_like(cache: DataFrame) -> DataFrame:
    """A cache in the full schema; columns it does not have are NULL."""
    have = set(cache.columns)
    return cache.select(*[
        (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in schemas.STRUCTURE_FEATURES
    ])


def append_cache(df: DataFrame, path: str, fold: Callable[[str], dict]) -> None:
    """Append what the cache at ``path`` does not have; safe to run again."""
    cache = df.sparkSession.read.schema(schemas.STRUCTURE_FEATURES).parquet(path)
    durable(update_cache(df, cache, fold)).write.mode("append").parquet(path)

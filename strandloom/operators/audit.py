"""Counting audits over splits, targets and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom import fixed_values as fv
from strandloom.functions import names, sequence
from strandloom.operators import dedup, skew, validate
from strandloom.operators.validate import split_membership
from strandloom.session import durable


def label_conflicts(df: DataFrame) -> DataFrame:
    """All rows of (sequence, target) pairs that carry different labels."""
    keys = ["aptamer_sequence", "target_name"]
    bad = (
        df.groupBy(*keys)
        .agg(F.min("label").alias("_lo"), F.max("label").alias("_hi"), F.count(F.lit(1)).alias("_n"))
        .where(F.col("_lo") != F.col("_hi")).select(*keys, "_n")
    )
    return skew.spread_join(df, bad, keys, "_n", how="inner").withColumn(
        "conflict_type", F.lit("exact_sequence_label_conflict")
    )


def leakage_moves(df: DataFrame, seq: str = "aptamer_sequence") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(repaired, moved, targets): val/test rows of a sequence in several splits go to train.

    ``moved`` has each moved row once, with ``seq_up``; ``targets`` has the distinct train targets of
    every such sequence.  Which row met which target is their join on ``seq_up``; it is not written out, as a sequence may
    have many of both.
    """
    member = split_membership(df, seq)
    spread = sum(F.col(f"in_{s}").cast("int") for s in fv.SPLITS) >= 2
    leaky = member.where(spread).select("seq_up", "n")
    keyed = df.withColumn("seq_up", F.upper(F.col(seq)))
    tagged = skew.spread_join(keyed, leaky.withColumn("_leaky", F.lit(True)), ["seq_up"], "n")
    move = F.coalesce(F.col("_leaky"), F.lit(False)) & F.col("split").isin(*fv.HOLDOUT)
    repaired = tagged.withColumn("split", F.when(move, "train").otherwise(F.col("split")))
    targets = (
        keyed.where(F.col("split") == "train")
        .join(leaky.select("seq_up"), "seq_up", "left_semi")
        .select("seq_up", F.col("target_name").alias("train_target")).distinct()
    )
    moved = tagged.where(move).select(
        "seq_up", "row_id", F.col(seq), "target_name", F.col("split").alias("current_split"),
        F.lit("3_leakage").alias("phase"),
        F.concat(F.lit("same_seq_diff_target_leak_"), "split", F.lit("_moved_to_train"))
        .alias("reason"),
    )
    return repaired.select(*df.columns), moved, targets


def repair_leakage(df: DataFrame, seq: str = "aptamer_sequence") -> tuple[DataFrame, DataFrame]:
    """(repaired, moved) of ``leakage_moves``, a row of ``moved`` for each distinct train target of its sequence."""
    repaired, moved, targets = leakage_moves(df, seq)
    return repaired, moved.join(targets, "seq_up", "left").drop("seq_up")


def holdout_guard(df: DataFrame, seq: str = "aptamer_sequence") -> DataFrame:
    """Drop train rows whose sequence also occurs in val or test."""
    held = F.col("split").isin(*fv.HOLDOUT)
    table = (
        df.groupBy(seq).agg(F.bool_or(held).alias("_h"), F.count_if(~held).alias("_n"))
        .where(F.col("_h") & (F.col("_n") > 0)).select(seq, "_n")
    )
    out = skew.spread_join(df.where(~held), table, [seq], "_n", how="anti")
    return out.unionByName(df.where(held))


def guard_against(df: DataFrame, held: DataFrame, seq: str = "aptamer_sequence") -> DataFrame:
    """Drop rows whose sequence occurs in another frame."""
    return skew.attach(df, held.select(seq).distinct(), [seq], how="anti")


def coverage_audit(df: DataFrame, patterns=fv.PRIORITY_PATTERNS) -> DataFrame:
    """Rows and rows with a Kd per priority target and split; one scan."""
    labels = F.array_compact(
        F.array(*[F.when(F.col("target_name").rlike(p), name) for name, p in patterns])
    )
    per = [
        F.count_if(F.coalesce(F.col("split"), F.lit("unassigned")) == s).alias(f"{s}_rows")
        for s in (*fv.SPLITS, "unassigned")
    ]
    with_kd = [
        F.count_if((F.col("split") == s) & F.col("kd_value").isNotNull()).alias(f"{s}_kd")
        for s in fv.SPLITS
    ]
    found = (
        df.select(F.explode(labels).alias("priority"), "split", "kd_value")
        .groupBy("priority").agg(F.count(F.lit(1)).alias("total"), *per, *with_kd)
    )
    every = df.sparkSession.createDataFrame([(n,) for n, _ in patterns], "priority string")
    counted = [c for c in found.columns if c != "priority"]
    return (
        every.join(found, "priority", "left").na.fill(0, counted)
        .withColumn(
            "warning",
            F.when(F.col("total") == 0, "absent")
            .when((F.col("val_rows") == 0) & (F.col("test_rows") == 0), "no val or test rows")
            .otherwise(""),
        )
    )


def split_share(df: DataFrame) -> DataFrame:
    """Rows per assigned split and their share in percent (3 result rows)."""
    counts = (
        df.where(F.col("split").isin(*fv.SPLITS)).groupBy("split")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    total = F.sum("n").over(Window.partitionBy())
    return counts.select("split", "n", F.round(F.col("n") * 100.0 / total, 4).alias("pct"))


def target_counts(df: DataFrame, column: str = "target_name") -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def class_weights(df: DataFrame) -> DataFrame:
    """Rows and 1/rows weight per label."""
    return df.groupBy("label").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "weight", F.lit(1.0) / F.col("n")
    )


def enrichment_gap(df: DataFrame) -> DataFrame:
    """Protein-less rows by root cause, rows and distinct targets.

    The cause is what the name says it is; a protein name without an id is a
    lookup miss.
    """
    kind = names.classify_rules(F.col("target_name"))
    cause = (
        F.when(kind != "protein", F.concat(F.lit("not a protein: "), kind))
        .when(F.col("target_id").isNotNull(), "accession without sequence")
        .otherwise("protein not found")
    )
    return (
        df.where(F.col("protein_sequence").isNull())
        .groupBy(cause.alias("cause"))
        .agg(F.count(F.lit(1)).alias("n"), F.count_distinct("target_name").alias("targets"))
    )


def ready_by_split(df: DataFrame) -> DataFrame:
    """Training-ready and missing rows per split."""
    ready = F.col("aptamer_sequence").isNotNull() & F.col("protein_sequence").isNotNull()
    return df.groupBy(F.coalesce("split", F.lit("unassigned")).alias("split")).agg(
        F.count_if(ready).alias("ready"), F.count_if(~ready).alias("missing")
    )


def merge_stats(df: DataFrame, valid: str = "valid", new: str = "is_new", in_batch: str = "in_batch") -> DataFrame:
    """Incoming/valid/invalid/duplicate/new counts in total and per source.

    Copies within the batch and copies of known rows are told apart.
    """
    v = F.col(valid)
    return df.rollup("source_type").agg(
        F.count(F.lit(1)).alias("incoming"),
        F.count_if(v).alias("valid"),
        F.count_if(~v).alias("invalid"),
        F.count_if(v & ~F.col(new) & ~F.col(in_batch)).alias("known_duplicates"),
        F.count_if(v & ~F.col(new) & F.col(in_batch)).alias("batch_duplicates"),
        F.count_if(v & F.col(new)).alias("new_rows"),
    ).withColumn("source_type", F.coalesce("source_type", F.lit("total")))


def batch_stats(df: DataFrame, *known: DataFrame) -> DataFrame:
    """``merge_stats`` of a batch of records; what the record contract says is written narrow, so it is checked once."""
    checked = durable(validate.validate_record(df).select("row_id", "source_type", "aptamer_sequence", "target_name", "valid"))
    return merge_stats(dedup.merge_decisions(checked, *known))


def homopolymer_audit(df: DataFrame, k: int, seq: str = "aptamer_sequence") -> DataFrame:
    """The k rows with the longest runs of at least 3 (a top-k report)."""
    run = sequence.longest_run_base(F.col(seq))
    return (
        df.select("row_id", "target_name", seq, run.alias("run"))
        .withColumn("run_length", F.length("run"))
        .where("run_length >= 3")
        .orderBy(F.desc("run_length"), "row_id").limit(k)
    )


def homopolymer_counts(df: DataFrame, seq: str = "aptamer_sequence") -> DataFrame:
    n = sequence.longest_run(F.col(seq))
    return df.select(n.alias("n"), F.col(seq).alias("s")).agg(
        F.count_if(F.col("n") >= 3).alias("run_3"), F.count_if(F.col("n") >= 5).alias("run_5"),
        F.count_if(F.col("n") >= 6).alias("run_6"),
        F.count_if(F.upper("s").rlike("G{6,}")).alias("g_run_6"),
    )


def limit_per_source(df: DataFrame, n: int, source: str = "source_type") -> DataFrame:
    """At most n rows per source, lowest row_id first."""
    return skew.first_n(df, [source], ["row_id"], n)

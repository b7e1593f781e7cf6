"""Augmentation of training rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom import fixed_values as fv
from strandloom.functions import sequence
from strandloom.operators import audit, dedup, mapping, skew
from strandloom.session import durable

# order in which the variants of one method come (first copy wins)
GENERATION = {
    None: 0, "rev_comp": 1, "trunc_L2": 2, "trunc_R2": 3, "trunc_L3": 4, "trunc_R3": 5,
    "cross_neg": 6, "scrambled": 7,
}


def variants(df: DataFrame, seed: int = 42) -> DataFrame:
    """Originals and their sequence variants: one explode over one scan."""
    s = F.col("aptamer_sequence")

    def variant(method, seq, keeps_label):
        return F.struct(
            F.lit(GENERATION[method]).alias("gen_rank"),
            F.lit(method).cast("string").alias("aug_method"),
            seq.alias("seq"), F.lit(keeps_label).alias("keeps_label"),
        )

    made = [variant("rev_comp", sequence.reverse_complement(s), False)]
    made += [
        variant(name, sequence.truncate(s, side, n), True)
        for name, side, n in sequence.TRUNCATIONS
    ]
    made.append(variant("scrambled", sequence.scramble(s, F.col("row_id"), seed), False))
    original = variant(None, s, True)
    positive = F.col("label") == 1
    usable = F.filter(F.array(*made), lambda v: sequence.is_augment_valid(v["seq"]))
    every = F.when(positive, F.concat(F.array(original), usable)).otherwise(F.array(original))
    x = df.withColumn("_v", F.explode(every))
    keep = F.col("_v.keeps_label")
    return x.select(
        *[
            c for c in df.columns
            if c not in ("aptamer_sequence", "label", "kd_value", "kd_unit", "augmented", "aug_method")
        ],
        F.col("_v.seq").alias("aptamer_sequence"),
        F.when(keep, F.col("label")).otherwise(0).alias("label"),
        F.when(keep, F.col("kd_value")).alias("kd_value"),
        F.when(keep, F.col("kd_unit")).alias("kd_unit"),
        (F.col("_v.gen_rank") > 0).alias("augmented"),
        F.col("_v.aug_method").alias("aug_method"),
        F.col("_v.gen_rank").alias("gen_rank"),
    )


def target_ring(df: DataFrame) -> DataFrame:
    """Distinct targets with a position, their row counts and first row's attributes."""
    firsts = df.where(F.col("target_name").isNotNull()).groupBy("target_name").agg(
        F.min(F.struct("row_id", "target_id", "target_id_source", "protein_sequence")).alias("_f"),
        F.count(F.lit(1)).alias("n_rows"),
    )
    ranked = skew.global_rank(firsts, [F.col("target_name")], "pos")
    return ranked.select(
        "target_name", "n_rows", (F.col("pos") - 1).alias("pos"), "_f.target_id",
        "_f.target_id_source", "_f.protein_sequence",
    )


def cross_negatives(df: DataFrame, seed: int = 42) -> DataFrame:
    """Every positive once with another target and that target's attributes.

    Targets are numbered 0..m-1; the partner is (own + 1 + hash mod (m-1)) mod m,
    so it always differs and no cross product is needed.
    """
    ring = durable(target_ring(df))
    m = ring.count()
    if m < 2:
        return df.limit(0).withColumn("gen_rank", F.lit(GENERATION["cross_neg"]))
    own = ring.select("target_name", "n_rows", "pos")
    positives = df.where((F.col("label") == 1) & F.col("target_name").isNotNull())
    placed = skew.spread_join(positives, own, ["target_name"], "n_rows", how="inner")
    digest = F.conv(
        F.substring(
            F.md5(F.concat(F.lit(f"{seed}|"), F.col("row_id").cast("string")).cast("binary")), 1, 8
        ), 16, 10,
    ).cast("bigint")
    partner = F.pmod(F.col("pos") + 1 + F.pmod(digest, F.lit(m - 1)), F.lit(m))
    other = ring.select(
        F.col("pos").alias("_partner"), F.col("target_name").alias("_t"),
        F.col("target_id").alias("_id"), F.col("target_id_source").alias("_ids"),
        F.col("protein_sequence").alias("_ps"),
    )
    # a hash over all other targets: partners of a hot target are spread evenly
    joined = placed.withColumn("_partner", partner).join(other, "_partner")
    replaced = {
        "target_name": F.col("_t"), "target_id": F.col("_id"), "target_id_source": F.col("_ids"),
        "protein_sequence": F.col("_ps"), "label": F.lit(0),
        "kd_value": F.lit(None).cast("double"), "kd_unit": F.lit(None).cast("string"),
        "augmented": F.lit(True), "aug_method": F.lit("cross_neg"),
    }
    return joined.select(
        *[replaced.get(c, F.col(c)).alias(c) for c in df.columns],
        F.lit(GENERATION["cross_neg"]).alias("gen_rank"),
    )


def augment_rows(train: DataFrame, seed: int = 42, cross_neg: bool = True) -> DataFrame:
    """Training rows with all their variants, one row per (sequence, target)."""
    base = train.withColumn("augmented", F.lit(False)).withColumn(
        "aug_method", F.lit(None).cast("string")
    )
    out = variants(base, seed)
    if cross_neg:
        out = out.unionByName(cross_negatives(base, seed))
    return dedup.dedup_first(out)


def augment_train(
    df: DataFrame, seed: int = 42, cross_neg: bool = True
) -> tuple[DataFrame, DataFrame]:
    """(augmented train, untouched val and test) of a cleaned table."""
    ready = mapping.fill_defaults(mapping.training_ready(df, "augment")).withColumn(
        "split", F.coalesce("split", F.lit("unassigned"))
    )
    guarded = durable(audit.holdout_guard(ready))
    held = guarded.where(F.col("split").isin(*fv.HOLDOUT))
    train = guarded.where(~F.col("split").isin(*fv.HOLDOUT)).withColumn("split", F.lit("train"))
    rows = durable(augment_rows(train, seed, cross_neg))
    return audit.guard_against(rows, held), held

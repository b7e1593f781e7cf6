"""Exact and complement de-duplication, and de-duplication against a master."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom import fixed_values as fv
from strandloom.functions import sequence
from strandloom.operators import skew
from strandloom.functions.space import strip
from strandloom.session import durable


def record_key(seq: Column, target: Column) -> list[Column]:
    return [F.upper(strip(seq)), F.lower(strip(target))]


def exact_dedup(df: DataFrame, seq: str = "sequence", target: str = "target_protein") -> DataFrame:
    """Keep the first row of every (upper sequence, lower target)."""
    return skew.keep_first(df, [F.upper(F.col(seq)), F.lower(F.col(target))])


def dedup_first(df: DataFrame) -> DataFrame:
    """First row per (sequence, target) in generation order, case-sensitive."""
    return skew.keep_first(
        df, [F.col("aptamer_sequence"), F.col("target_name")], order=("gen_rank", "row_id")
    )


def complement_groups(df: DataFrame, seq: str) -> DataFrame:
    """One row per unordered {sequence, reverse complement} with counts.

    ``a_*`` describes the spelling that sorts first, ``b_*`` the other one.
    """
    s = F.upper(F.col(seq))
    rc = sequence.reverse_complement_iupac(s)
    tagged = df.where(s.isNotNull()).select(
        "row_id", F.least(s, rc).alias("pair_key"), (s <= rc).alias("is_a"), (s == rc).alias("palindrome")
    )
    a, b = F.when(F.col("is_a"), F.col("row_id")), F.when(~F.col("is_a"), F.col("row_id"))
    return tagged.groupBy("pair_key").agg(
        F.first("palindrome").alias("palindrome"),
        F.count(F.lit(1)).alias("n"),
        F.count(a).alias("a_n"), F.min(a).alias("a_first"), F.max(a).alias("a_last"),
        F.count(b).alias("b_n"), F.min(b).alias("b_first"), F.max(b).alias("b_last"),
    )


def rc_marked(df: DataFrame, seq: str = "sequence", mode: str = "reference", flag: str = "rc_gone") -> DataFrame:
    """Add ``flag``: the row repeats a molecule in its complement spelling.

    ``reference`` keeps the closed form of the sequential rule: with A the
    spelling of the group's first row and B the other one, last(B) goes; with
    several B rows either last(A) goes too (when B starts before A ends) or all
    of B does.  A palindrome with several rows loses its last one.
    ``canonical`` drops every B.
    """
    g = complement_groups(df, seq).where(
        (F.col("palindrome") & (F.col("n") > 1)) | ((F.col("a_n") > 0) & (F.col("b_n") > 0))
    )
    lead_is_a = F.col("a_first") < F.col("b_first")
    pick = lambda x, y: F.when(lead_is_a, F.col(x)).otherwise(F.col(y))
    first_b, last_b = pick("b_first", "a_first"), pick("b_last", "a_last")
    last_a, many_b = pick("a_last", "b_last"), pick("b_n", "a_n") >= 2
    rules = g.select(
        "pair_key", "n", "palindrome",
        lead_is_a.alias("lead_is_a"),
        F.when(F.col("palindrome"), F.col("a_last")).otherwise(last_b).alias("gone_b"),
        F.when(~F.col("palindrome") & many_b & (first_b < last_a), last_a).alias("gone_a"),
        (~F.col("palindrome") & ((many_b & (first_b >= last_a)) | F.lit(mode == "canonical")))
        .alias("all_b"),
    )
    s = F.upper(F.col(seq))
    rc = sequence.reverse_complement_iupac(s)
    keyed = df.withColumn("pair_key", F.least(s, rc)).withColumn("_is_a", s <= rc)
    joined = skew.spread_join(keyed, rules, ["pair_key"], "n")
    is_b = F.col("_is_a") != F.col("lead_is_a")
    if mode == "canonical":
        gone = F.when(F.col("palindrome"), F.lit(False)).otherwise(is_b)
    else:
        gone = (
            (F.col("row_id") == F.col("gone_b"))
            | (F.col("row_id") == F.coalesce(F.col("gone_a"), F.lit(-1)))
            | (F.col("all_b") & is_b)
        )
    return joined.select(*df.columns, F.coalesce(gone, F.lit(False)).alias(flag))


def rc_dedup(
    df: DataFrame, seq: str = "sequence", mode: str = "reference"
) -> tuple[DataFrame, DataFrame]:
    """(kept, audit) of ``rc_marked``; who reads both should take the flag, or write it first."""
    flagged = rc_marked(df, seq, mode, "_gone")
    return flagged.where(~F.col("_gone")).select(*df.columns), rc_audit(flagged, "_gone")


def rc_audit(marked: DataFrame, flag: str = "rc_gone") -> DataFrame:
    """The rows that ``rc_marked`` takes out, with phase and reason."""
    return marked.where(flag).select(
        F.lit("1_rc_pair").alias("phase"),
        F.lit("reverse_complement_pair_deduplicated").alias("reason"),
        *[c for c in marked.columns if c != flag],
    )


def mark_against(
    df: DataFrame, *known: DataFrame, seq: str = "aptamer_sequence", target: str = "target_name", flag: str = "is_new"
) -> DataFrame:
    """Add ``flag``: the row is the first of its key in the batch, and no known table has the key.

    One aggregate over the union of keys decides; known tables only send their
    distinct keys.  ``known`` frames use either schema's column names.
    """
    s, t = record_key(F.col(seq), F.col(target))
    batch = df.withColumn("_s", s).withColumn("_t", t)
    keys = batch.select("_s", "_t", "row_id", F.lit(False).alias("_known"))
    for table in known:
        ks, kt = record_key(
            F.col(alias_of(table, fv.SEQUENCE_ALIASES)), F.col(alias_of(table, fv.TARGET_ALIASES))
        )
        keys = keys.unionByName(
            table.select(
                ks.alias("_s"), kt.alias("_t"), F.lit(None).cast("bigint").alias("row_id"),
                F.lit(True).alias("_known"),
            ).where((F.col("_s") != "") & (F.col("_t") != "")).distinct()
        )
    verdict = keys.groupBy("_s", "_t").agg(
        F.min("row_id").alias("row_id"), F.max("_known").alias("_known")
    )
    winners = verdict.where(~F.col("_known") & F.col("row_id").isNotNull()).select("row_id", F.lit(True).alias(flag))
    return df.join(winners, "row_id", "left").select(*df.columns, F.coalesce(flag, F.lit(False)).alias(flag))


def dedup_against(
    df: DataFrame, *known: DataFrame, seq: str = "aptamer_sequence", target: str = "target_name"
) -> tuple[DataFrame, DataFrame]:
    """(unique, duplicates) of ``mark_against``; who reads both should take the flag, or write it first."""
    marked = mark_against(df, *known, seq=seq, target=target, flag="_new")
    return marked.where("_new").drop("_new"), marked.where(~F.col("_new")).drop("_new")


def merge_verdicts(
    df: DataFrame, *known: DataFrame, seq: str = "aptamer_sequence", target: str = "target_name"
) -> DataFrame:
    """(_s, _t, _lead, _known, _n) for every key of the valid rows of a batch: its first row, is it known, and its rows.

    It is written once, so the rules behind ``valid`` are not run again by each of its readers.
    """
    s, t = record_key(F.col(seq), F.col(target))
    keys = df.where("valid").select(
        s.alias("_s"), t.alias("_t"), "row_id", F.lit(False).alias("_known"), F.lit(1).alias("_one")
    )
    for table in known:
        ks, kt = record_key(
            F.col(alias_of(table, fv.SEQUENCE_ALIASES)), F.col(alias_of(table, fv.TARGET_ALIASES))
        )
        keys = keys.unionByName(
            table.select(
                ks.alias("_s"), kt.alias("_t"), F.lit(None).cast("bigint").alias("row_id"),
                F.lit(True).alias("_known"), F.lit(0).alias("_one"),
            )
        )
    return durable(
        keys.groupBy("_s", "_t")
        .agg(F.min("row_id").alias("_lead"), F.max("_known").alias("_known"), F.sum("_one").alias("_n"))
        .where("_n > 0")
    )


def merge_decisions(
    df: DataFrame, *known: DataFrame, seq: str = "aptamer_sequence", target: str = "target_name"
) -> DataFrame:
    """Add ``is_new`` and ``in_batch`` to a batch with a ``valid`` column.

    is_new: first valid row of a key no known table has.  in_batch: the key is
    not known, so a row that is not new repeats an earlier row of the batch.
    ``df`` is read twice; who computes ``valid`` should write it first.
    """
    s, t = record_key(F.col(seq), F.col(target))
    tagged = skew.spread_join(
        df.withColumn("_s", s).withColumn("_t", t), merge_verdicts(df, *known, seq=seq, target=target), ["_s", "_t"], "_n"
    )
    fresh = F.coalesce(~F.col("_known"), F.lit(False)) & F.col("valid")
    return tagged.select(
        *df.columns, (fresh & (F.col("row_id") == F.col("_lead"))).alias("is_new"),
        fresh.alias("in_batch"),
    )


def alias_of(df: DataFrame, aliases) -> str:
    """First of the aliases that the frame has (an error without one)."""
    for name in aliases:
        if name in df.columns:
            return name
    raise ValueError(f"none of {aliases} in {df.columns}")


def upgrade_dedup(df: DataFrame, keys=("doc_id", "sequence")) -> DataFrame:
    """First record per sequence, or the first one that has an affinity."""
    ranked = df.withColumn("_late", F.col("kd_nM").isNull())
    out = skew.keep_first(ranked, [F.col(k) for k in keys], order=("_late", "ord"))
    return out.drop("_late")

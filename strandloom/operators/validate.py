"""Record contract, sequence rules and the export audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom import fixed_values as fv
from strandloom.functions import sequence
from strandloom.functions.bind import bind, once
from strandloom.operators import skew
from strandloom.functions.space import strip


def record_errors(df: DataFrame) -> Column:
    """All violations of the record contract as array<string>.

    The columns are packed once and the rules read the packed row: a filter on
    the result then mentions every input once, however many rules look at it.
    """
    names = [c for c in fv.RECORD_COLUMNS if c in df.columns]
    packed = F.named_struct(
        *[x for n in names for x in (F.lit(n), strip(F.col(n).cast("string")))]
    )

    def rules(row):
        def shown(name):
            return row[name] if name in names else F.lit(None).cast("string")

        def given(name):
            return shown(name) != ""

        checks = []
        for name in fv.REQUIRED:
            checks.append(F.when(F.coalesce(shown(name), F.lit("")) == "",
                                 f"required field missing or empty: {name}"))
        for name, allowed in fv.VOCABULARY.items():
            checks.append(
                F.when(given(name) & ~shown(name).isin(*allowed),
                       F.concat(F.lit(f"invalid value for {name}: "), shown(name)))
            )
        has_kd = F.coalesce(given("kd_value"), F.lit(False))
        has_unit = F.coalesce(given("kd_unit"), F.lit(False))
        number = shown("kd_value").try_cast("double")
        checks += [
            F.when(has_kd & number.isNull(), F.concat(F.lit("kd_value is not numeric: "), shown("kd_value"))),
            F.when(number < 0, "kd_value must be >= 0"),
            F.when(has_kd & ~has_unit, "kd_value present but kd_unit is missing"),
            F.when(has_unit & ~has_kd, "kd_unit present but kd_value is missing"),
        ]
        for name, (lo, hi) in fv.BOUNDS.items():
            value = shown(name).try_cast("double")
            checks += [
                F.when(given(name) & value.isNull(), F.concat(F.lit(f"{name} is not numeric: "), shown(name))),
                F.when(~value.between(lo, hi), f"{name} out of expected range [{lo}, {hi}]"),
            ]
        return F.array_compact(F.array(*checks))

    return bind(packed, rules)


def validate_record(df: DataFrame) -> DataFrame:
    return once(df, "errors", record_errors(df)).withColumn("valid", F.size("errors") == 0)


def keep_valid(df: DataFrame) -> DataFrame:
    """Only the rows without a violation."""
    return validate_record(df).where("valid").select(*df.columns)


def to_records(df: DataFrame) -> DataFrame:
    """Fixed column order, extras dropped, the five numeric columns coerced."""
    out = []
    for name in fv.RECORD_COLUMNS:
        c = F.col(name) if name in df.columns else F.lit(None)
        kind = "double" if name in fv.RECORD_NUMERIC else "string"
        out.append((c.try_cast(kind) if kind == "double" else c.cast(kind)).alias(name))
    return df.select(*out)


def validate_sequences(
    df: DataFrame, seq: str = "sequence", target: str | None = "target_protein"
) -> DataFrame:
    """Add ``valid`` and ``fail_reason``; later copies of a valid key fail."""
    tagged = once(df, "fail_reason", sequence.sequence_fault(F.col(seq)))
    other = F.lower(strip(F.col(target))) if target else F.lit("")
    marked = skew.mark_first(
        tagged, [F.upper(strip(F.col(seq))), other], "_first", among=F.col("fail_reason") == ""
    )
    return (
        marked.withColumn(
            "fail_reason",
            F.when((F.col("fail_reason") == "") & ~F.col("_first"), "duplicate")
            .otherwise(F.col("fail_reason")),
        )
        .withColumn("valid", F.col("fail_reason") == "")
        .select(*df.columns, "valid", "fail_reason")
    )


def validation_report(checked: DataFrame) -> DataFrame:
    """Rows per failure kind with a total line."""
    kind = F.when(F.col("valid"), "passed").otherwise(
        F.regexp_replace("fail_reason", r" \(.*$", "")
    )
    return (
        checked.select(kind.alias("reason"))
        .rollup("reason").agg(F.count(F.lit(1)).alias("n"))
        .select(F.coalesce("reason", F.lit("total")).alias("reason"), "n")
    )


def removal_reason(seq: Column) -> Column:
    kind, size = sequence.nucleic_acid_type(seq), F.length(seq)
    return (
        F.when(kind != "ssDNA", "non_ssDNA_type")
        .when(size < fv.SEQ_MIN_LEN,
              F.concat(F.lit("too_short ("), size, F.lit(f" < {fv.SEQ_MIN_LEN})")))
        .when(size > fv.SEQ_MAX_LEN,
              F.concat(F.lit("too_long ("), size, F.lit(f" > {fv.SEQ_MAX_LEN})")))
    )


def quarantine(df: DataFrame, seq: str = "sequence") -> tuple[DataFrame, DataFrame]:
    """(kept, removed): two filters over one computed reason column."""
    tagged = df.withColumn("nucleic_acid_type", sequence.nucleic_acid_type(F.col(seq))).withColumn(
        "removal_reason", removal_reason(F.col(seq))
    )
    kept = tagged.where(F.col("removal_reason").isNull()).drop("removal_reason")
    return kept, tagged.where(F.col("removal_reason").isNotNull())


def export_audit(df: DataFrame) -> DataFrame:
    """Issue table (check, n) of the cleaned table, one pass plus the overlap.

    Shares below 5 % are reported in tenths of a percent.
    """
    seq = F.col("aptamer_sequence")
    dna = F.col("nucleic_acid_type") == "ssDNA"
    assigned = F.col("split").isin(*fv.SPLITS)
    sums = {f"null:{c}": F.count_if(F.col(c).isNull()) for c in fv.REQUIRED}
    sums["charset"] = F.count_if(dna & ~F.coalesce(F.upper(strip(seq)).rlike("^[ATGC]+$"), F.lit(False)))
    sums["too_short"] = F.count_if(dna & (F.length(seq) < fv.SEQ_MIN_LEN))
    sums["too_long"] = F.count_if(dna & (F.length(seq) > fv.SEQ_MAX_LEN))
    for name, allowed in fv.CLEANED_VOCABULARY.items():
        sums[f"vocabulary:{name}"] = F.count_if(~F.col(name).isin(*allowed))
    for s in ("val", "test"):
        share = F.try_divide(F.count_if(F.col("split") == s) * 1000, F.count_if(assigned))
        sums[f"share_below_5pct:{s}"] = F.when(share < 50, F.floor(share))
    wide = df.agg(*[v.cast("bigint").alias(k) for k, v in sums.items()])
    long = wide.unpivot([], list(sums), "check", "n")
    overlap = split_overlap(df).unpivot([], ["train_val", "train_test", "val_test"], "check", "n")
    return long.where(
        (F.col("n") > 0) | (F.col("check").startswith("share") & F.col("n").isNotNull())
    ).unionByName(
        overlap.where("n > 0").withColumn("check", F.concat(F.lit("overlap:"), F.col("check")))
    )


def downgrade_bad_sequences(df: DataFrame) -> DataFrame:
    """ssDNA rows with foreign letters become uncertain."""
    bad = (F.col("nucleic_acid_type") == "ssDNA") & ~F.coalesce(
        F.upper(strip(F.col("aptamer_sequence"))).rlike("^[ATGC]+$"), F.lit(False)
    )
    return df.withColumn(
        "confidence_score", F.when(bad, "uncertain").otherwise(F.col("confidence_score"))
    )


def split_membership(df: DataFrame, seq: str = "aptamer_sequence", split: str = "split") -> DataFrame:
    """Per upper-cased sequence: is it in train / val / test, and its row count."""
    return (
        df.groupBy(F.upper(F.col(seq)).alias("seq_up"))
        .agg(
            *[F.bool_or(F.coalesce(F.col(split) == s, F.lit(False))).alias(f"in_{s}") for s in fv.SPLITS],
            F.count(F.lit(1)).alias("n"),
        )
        .where(F.col("seq_up").isNotNull())
    )


def split_overlap(df: DataFrame, seq: str = "aptamer_sequence", split: str = "split") -> DataFrame:
    m = split_membership(df, seq, split)
    both = lambda a, b: F.count_if(F.col(f"in_{a}") & F.col(f"in_{b}"))
    return m.agg(
        both("train", "val").alias("train_val"),
        both("train", "test").alias("train_test"),
        both("val", "test").alias("val_test"),
    )

"""Evaluation metrics of a prediction table (y_true, y_prob, kd_true, kd_pred)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.functions.bind import bind
from strandloom.operators import skew


def confusion(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    hit, pos = F.col("y_prob") >= threshold, F.col("y_true") == 1
    return df.agg(
        F.count_if(hit & pos).alias("tp"), F.count_if(hit & ~pos).alias("fp"),
        F.count_if(~hit & pos).alias("fn"), F.count_if(~hit & ~pos).alias("tn"),
    )


def threshold_metrics(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """MCC (NULL and a flag when undefined), sensitivity, specificity."""
    c = confusion(df, threshold)
    tp, fp, fn, tn = (F.col(x).cast("double") for x in ("tp", "fp", "fn", "tn"))
    margins = F.sqrt(tp + fp) * F.sqrt(tp + fn) * F.sqrt(tn + fp) * F.sqrt(tn + fn)
    return c.select(
        "tp", "fp", "fn", "tn",
        (margins == 0).alias("mcc_degenerate"),
        F.when(margins > 0, (tp * tn - fp * fn) / margins).alias("mcc"),
        F.coalesce(F.try_divide(tp, tp + fn), F.lit(0.0)).alias("sensitivity"),
        F.coalesce(F.try_divide(tn, tn + fp), F.lit(0.0)).alias("specificity"),
    )


def _by_score(df: DataFrame) -> DataFrame:
    """Positives and negatives per distinct score, cumulated from the top."""
    per = df.groupBy("y_prob").agg(
        F.count_if(F.col("y_true") == 1).alias("pos"),
        F.count_if(F.col("y_true") != 1).alias("neg"),
    )
    return skew.running_totals(per, [F.desc("y_prob")], ["pos", "neg"])


def ranking_metrics(df: DataFrame) -> DataFrame:
    """AUROC with ties counted half, and step-wise average precision.

    Both are sums over distinct scores, so the global order is needed once and
    never on raw rows.  NULL when only one class is present.
    """
    s = _by_score(df)
    above = F.col("cum_pos") - F.col("pos")
    area = F.sum(F.col("neg") * (above + F.col("pos") / 2.0))
    precision = F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))
    p, n = F.sum("pos"), F.sum("neg")
    return s.agg(
        F.when((p > 0) & (n > 0), area / (p * n.cast("double"))).alias("auroc"),
        F.when((p > 0) & (n > 0), F.sum(F.col("pos") * precision) / p).alias("average_precision"),
    )


def auroc(df: DataFrame) -> DataFrame:
    return ranking_metrics(df).select("auroc")


def average_precision(df: DataFrame) -> DataFrame:
    return ranking_metrics(df).select("average_precision")


def pearson(df: DataFrame) -> DataFrame:
    """n, r and p over rows with both values, r and p NULL below three of them."""
    both = df.where(
        F.col("kd_true").isNotNull() & F.col("kd_pred").isNotNull()
        & ~F.isnan("kd_true") & ~F.isnan("kd_pred")
    )
    n = F.count(F.lit(1))
    found = both.agg(n.alias("n"), F.when(n >= 3, F.corr("kd_true", "kd_pred")).alias("r"))
    return found.withColumn("p", pearson_p(F.col("r"), F.col("n")))


def _gamma_ratio(a: Column) -> Column:
    """gamma(a + 1/2) / gamma(a): its series for large numbers, brought down by the recurrence from a + 40."""
    z = a + 40
    series = F.lit(0.0)
    for c in (869 / 4194304, -399 / 262144, -21 / 32768, 5 / 1024, 1 / 128, -1 / 8, 1.0):
        series = series / z + c
    steps = F.sequence(F.lit(0), F.lit(39)).cast("array<double>")
    return F.sqrt(z) * series * F.aggregate(steps, F.lit(1.0), lambda acc, j: acc * (a + j) / (a + j + 0.5))


def _beta_fraction(a: Column, b: Column, x: Column, steps: Column) -> Column:
    """Continued fraction of the incomplete beta function, two of its terms a step."""

    def term(s, t):
        d = 1 / (1 + t * s["d"])
        c = 1 + t / s["c"]
        return F.struct(c.alias("c"), d.alias("d"), (s["h"] * c * d).alias("h"))

    def step(s, k):
        m = k.cast("double")
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        return bind(term(s, even), lambda mid: term(mid, odd))

    start = 1 / (1 - (a + b) * x / (a + 1))
    first = F.struct(F.lit(1.0).alias("c"), start.alias("d"), start.alias("h"))
    return F.aggregate(F.sequence(F.lit(1), steps), first, step, lambda s: s["h"])


def pearson_p(r: Column, n: Column) -> Column:
    """Two-sided p of a correlation of n pairs: the regularised incomplete beta function at 1 - r * r.

    The fraction takes a number of steps that grows with the root of n (a million at most), on one row.
    """
    a, half = (n - 2) / F.lit(2.0), F.lit(0.5)
    size, x = F.abs(r), 1 - r * r
    front = F.exp(a * F.log1p(-r * r)) * size * _gamma_ratio(a) / math.sqrt(math.pi)
    steps = F.least(F.lit(1_000_000), 200 + 5 * F.sqrt(n.cast("double"))).cast("int")
    near = front * _beta_fraction(a, half, x, steps) / a
    far = 1 - front * _beta_fraction(half, a, r * r, steps) / half
    return F.when(n < 3, F.lit(None)).when(size >= 1, 0.0).when(x < (a + 1) / (a + 2.5), near).otherwise(far)


def loss_metrics(
    df: DataFrame, negative_weight: float = 1.0, bce_weight: float = 1.0, kd_weight: float = 0.5
) -> DataFrame:
    """Mean weighted log loss (logs cut at -100) plus masked squared error."""
    cut = lambda x: F.greatest(F.coalesce(F.ln(x), F.lit(-100.0)), F.lit(-100.0))
    pos = F.col("y_true") == 1
    log_loss = F.when(pos, -cut(F.col("y_prob"))).otherwise(
        -cut(1 - F.col("y_prob")) * negative_weight
    )
    miss = F.col("kd_pred") - F.col("kd_true")
    return df.agg(
        F.avg(log_loss).alias("bce"), F.coalesce(F.avg(miss * miss), F.lit(0.0)).alias("mse")
    ).withColumn("loss", bce_weight * F.col("bce") + kd_weight * F.col("mse"))

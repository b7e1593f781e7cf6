"""Mix sources to target weights by Pareto order sampling.

Every source gets a target in words.  A source whose target is at least its
size takes whole copies of all its documents first.  The rest of the target
is a fixed-size sample in words: documents are ranked by their random odds divided
by their inclusion odds, u/(1-u) : p/(1-p), and taken from the least on as long as
they fit; one last document closes the gap as well as any can.  Inclusion probabilities grow with
the square root of the length, so the sample is of unequal probability.

The place where the taking stops is found without sorting a source: words are
summed per source and bin of the rank, the bin where the target falls is found
from these sums, and only documents of this bin are put in order.  A source may hold
any share of the rows.

Random numbers come from a digest of source and document id, so reruns agree; rows with the
same id and rank are taken or left together.  Null texts and texts
without words have size 0 and are never sampled; a null source is a source of its own.
Without any words all targets are 0.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.llm.text import unit, word_count
from strandloom.operators.skew import global_rank, running_totals
from strandloom.session import durable

SEED = "mix-1"
BINS = 4096  # per doubling of the rank
MOST = 3


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, source, size) of every document."""
    return docs.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size")
    )


def _weight(size: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.sqrt(size.cast("double")))).cast("long")


def targets(rows: DataFrame, cycle: int = 3, most: int = MOST) -> DataFrame:
    """(source, source_size, mass, target): words of a source, weighted words, words it should give.

    Sources in code point order, null last, weigh 1, 2, ... ``cycle``, repeating.
    A target stops at ``most`` times its source; what is left over goes to the others by weight.
    """
    sums = durable(rows.groupBy("source").agg(
        F.sum("size").alias("source_size"),
        F.sum((_weight(F.col("size")) * F.col("size")).cast("decimal(38,0)")).cast("double").alias("mass"),
    ))
    ranked = global_rank(sums, [F.col("source").asc_nulls_last()], "_n").withColumn(
        "weight", (F.col("_n") - 1) % cycle + 1
    ).drop("_n")
    # fill from the source that is full first; one level holds for all that are not full
    placed = running_totals(
        ranked.withColumn("_full", F.col("source_size") / F.col("weight")),
        [F.col("_full"), F.col("source").asc_nulls_last()], ["source_size", "weight"],
    )
    whole = placed.agg(F.sum("source_size").alias("_all"), F.sum("weight").alias("_weights")).first()
    words, weights = int(whole["_all"] or 0), int(whole["_weights"] or 0)
    wide = "decimal(38,0)"
    before = (F.col("cum_source_size") - F.col("source_size")).cast(wide)
    left = F.lit(weights).cast(wide) - (F.col("cum_weight") - F.col("weight"))
    full = most * F.col("source_size").cast(wide) * left < (F.lit(words).cast(wide) - most * before) * F.col("weight")
    marked = durable(placed.select("source", "source_size", "mass", "weight", full.alias("_is_full")))
    held = marked.where("_is_full").agg(F.sum("source_size").alias("s"), F.sum("weight").alias("w")).first()
    free = words - most * int(held["s"] or 0)
    over = max(1, weights - int(held["w"] or 0))
    share = F.lit(float(free)) * F.col("weight") / F.lit(float(over))
    return marked.select(
        "source", "source_size", "mass",
        F.when(F.col("_is_full"), float(most) * F.col("source_size").cast("double")).otherwise(share).alias("target"),
    )


def _with_rank(rows: DataFrame, quota: DataFrame, seed: str, most: int) -> DataFrame:
    """Rows with whole copies and the rank in the order sample; null rank: not in the sample."""
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    quota = quota.withColumn("_copies", F.least(copies, F.lit(most)).cast("long")).withColumn(
        "_rest", F.when(F.col("_copies") < most, F.col("target") - F.col("_copies") * F.col("source_size"))
        .otherwise(F.lit(0.0))
    ).withColumnRenamed("source", "_source")
    joined = rows.join(quota, rows["source"].eqNullSafe(quota["_source"]), "left").drop("_source")
    p = F.least(F.col("_rest") * _weight(F.col("size")) / F.col("mass"), F.lit(1.0))
    u = unit(seed, F.col("source"), F.col("id"))
    rank = (u / (1.0 - u)) * (1.0 - p) / p
    return joined.withColumn("_rank", F.when((F.col("_rest") > 0) & (F.col("size") > 0), rank)).withColumn(
        "_bin", F.when(F.col("_rank") > 0, F.floor(F.log2("_rank") * BINS)).when(F.col("_rank") == 0, F.lit(-1 << 40))
    )


def _inside() -> Column:
    """The row comes before the place where the taking stops."""
    return (F.col("_bin") < F.col("_at_bin")) | (
        (F.col("_bin") == F.col("_at_bin")) & (F.col("_rank") <= F.col("_at_rank"))
    )


def cuts(ranked: DataFrame) -> DataFrame:
    """(source, _at_bin, _at_rank, _last_rank): where the taking stops in every source.

    All ranks up to _at_rank go in; together they stay within the target. One
    more document closes the sample: among those left, the one whose size comes nearest to
    what is missing, if that brings the words nearer to the target.
    """
    sample = ranked.where(F.col("_rank").isNotNull())
    bins = sample.groupBy("source", "_bin").agg(F.sum("size").alias("words"), F.max("_rest").alias("rest"))
    upto = Window.partitionBy("source").orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    edge = (
        bins.withColumn("done", F.sum("words").over(upto) - F.col("words"))
        .where((F.col("done") <= F.col("rest")) & (F.col("done") + F.col("words") > F.col("rest")))
        .select(F.col("source").alias("_s"), F.col("_bin").alias("_at_bin"), "done", "rest")
    )
    inside = sample.drop("_rest").join(
        edge, sample["source"].eqNullSafe(edge["_s"]) & (F.col("_bin") == F.col("_at_bin"))
    ).groupBy("source", "_at_bin", "done", "rest", "_rank").agg(F.sum("size").alias("words"))
    order = Window.partitionBy("source").orderBy("_rank").rowsBetween(Window.unboundedPreceding, 0)
    steps = inside.withColumn("taken", F.col("done") + F.sum("words").over(order))
    fits = F.col("taken") <= F.col("rest")
    stop = steps.groupBy(F.col("source").alias("_s"), "_at_bin").agg(
        F.coalesce(F.max(F.when(fits, F.col("_rank"))), F.lit(-1.0)).alias("_at_rank"),
        F.min(F.col("rest") - F.greatest("done", F.when(fits, F.col("taken")))).alias("_missing"),
    )
    left = sample.select("source", "size", "_rank", "_bin").join(
        stop, sample["source"].eqNullSafe(stop["_s"])
    ).where(~_inside()).groupBy("source", "_missing", "size").agg(
        F.min("_rank").alias("_rank")
    )
    off = F.abs(F.col("_missing") - F.col("size"))
    last = left.where(off < F.col("_missing")).groupBy(F.col("source").alias("_t")).agg(
        F.min(F.struct(off, "_rank"))["_rank"].alias("_last_rank")
    )
    return stop.join(last, F.col("_s").eqNullSafe(F.col("_t")), "left").select(
        F.col("_s").alias("source"), "_at_bin", "_at_rank", "_last_rank"
    )


def decide(rows: DataFrame, seed: str = SEED, cycle: int = 3, most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """(quota, cuts) for rows of (id, source, size): all that a row needs to know of the others."""
    quota = durable(targets(rows, cycle, most))
    return quota, durable(cuts(_with_rank(rows, quota, seed, most)))


def copies(
    rows: DataFrame, quota: DataFrame, at: DataFrame, seed: str = SEED, most: int = MOST
) -> DataFrame:
    """``rows`` with source_size, target and _n, how often the mix takes the row."""
    ranked = _with_rank(rows, quota, seed, most)
    at = at.withColumnRenamed("source", "_cut_source")
    joined = ranked.join(at, ranked["source"].eqNullSafe(at["_cut_source"]), "left")
    extra = F.when(_inside() | (F.col("_rank") == F.col("_last_rank")), F.lit(1)).otherwise(F.lit(0))
    n = F.least(F.col("_copies") + extra, F.lit(most)).cast("long")
    return joined.withColumn("_n", n).drop(
        "_cut_source", "_copies", "_rest", "mass", "_rank", "_bin", "_at_bin", "_at_rank", "_last_rank"
    )


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    seed: str = SEED, cycle: int = 3, most: int = MOST,
) -> DataFrame:
    """(id, size, source_size, target, copies, taken) of every document."""
    rows = durable(sized(docs, id_col, text_col, source_col))
    out = copies(rows, *decide(rows, seed, cycle, most), seed, most)
    return out.select(
        F.col("id").alias(id_col), "size", "source_size", "target", F.col("_n").alias("copies"),
        (F.col("_n") * F.col("size")).alias("taken"),
    )


def mixed_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    seed: str = SEED, cycle: int = 3, most: int = MOST,
) -> DataFrame:
    """The documents of the mix with all their columns, each as often as it is taken."""
    names = [f"_c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)
    at = dict(zip(docs.columns, names))
    rows = durable(sized(docs, id_col, text_col, source_col))
    keyed = plain.withColumns({
        "id": F.col(at[id_col]), "source": F.col(at[source_col]), "size": word_count(F.col(at[text_col])),
    })
    out = copies(keyed, *decide(rows, seed, cycle, most), seed, most).where("_n > 0")
    return out.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int")))).select(
        *[F.col(n).alias(c) for c, n in at.items()]
    )

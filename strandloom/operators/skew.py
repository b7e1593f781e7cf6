"""Building blocks that stay balanced when one key holds a third of all rows.

* ``keep_first`` collapses a group with a map-side combined aggregate, so a hot
  group never meets in one task.
* ``spread_join`` attaches one-row-per-key attributes.  Keys with very many
  rows are few by counting (at most ``max_hot`` are taken, so the broadcast is
  bounded); they are joined by broadcast and their rows are spread evenly over
  the shuffle.  Every other key has fewer rows than the ``max_hot``-th largest.
* ``block_join`` joins two tables of which a key may hold very many rows in both.
* ``global_rank`` and ``running_totals`` give a total order without a
  single-partition window: range partitions, local ranks, then one offset per
  partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.session import durable

HOT_ROWS = 1_000_000
MAX_HOT = 10_000
BLOCK_ROWS = 100_000
TASK_ROWS = 1_000_000


def parts_for(df: DataFrame, rows: int = TASK_ROWS) -> int:
    """Partitions that hold about ``rows`` rows of ``df`` each, at least as many as the session has; counts the rows."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // rows))


def keep_first(
    df: DataFrame, keys: Sequence[Column], order: Sequence[str] = ("row_id",)
) -> DataFrame:
    """The first row of every key; NULL keys are equal to each other.

    In the order of a unique ``row_id`` only ids are aggregated, so the rows may
    have columns of any type and are not sorted by their keys.
    """
    if tuple(order) == ("row_id",):
        firsts = df.select(*[k.alias(f"_k{i}") for i, k in enumerate(keys)], "row_id").groupBy(
            *[f"_k{i}" for i in range(len(keys))]
        ).agg(F.min("row_id").alias("row_id"))
        return df.join(firsts.select("row_id"), "row_id", "left_semi").select(*df.columns)
    columns = list(order) + [c for c in df.columns if c not in order]
    named = [k.alias(f"_k{i}") for i, k in enumerate(keys)]
    return (
        df.select(*named, F.struct(*columns).alias("_row"))
        .groupBy(*[f"_k{i}" for i in range(len(keys))])
        .agg(F.min("_row").alias("_row"))
        .select(*[F.col("_row")[c].alias(c) for c in df.columns])
    )


def mark_first(
    df: DataFrame, keys: Sequence[Column], flag: str, among: Column | None = None
) -> DataFrame:
    """Add ``flag``: row is the first of its key (among the rows of ``among``).

    The join back runs on ``row_id``, which is unique, so it cannot be skewed.
    """
    pool = df if among is None else df.where(among)
    firsts = (
        pool.select(*[k.alias(f"_k{i}") for i, k in enumerate(keys)], "row_id")
        .groupBy(*[f"_k{i}" for i in range(len(keys))])
        .agg(F.min("row_id").alias("row_id"))
        .select("row_id", F.lit(True).alias(flag))
    )
    return df.join(firsts, "row_id", "left").withColumn(
        flag, F.coalesce(F.col(flag), F.lit(False))
    )


def first_n(
    df: DataFrame, group: Sequence[str], order: Sequence[str], n: int
) -> DataFrame:
    """The first n rows of every group.

    A group is first cut down in as many buckets as the shuffle has partitions,
    so a hot group is never sorted by one task; the second step sees at most
    n rows per bucket.
    """
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bucketed = df.withColumn("_b", F.pmod(F.xxhash64(*order), F.lit(width)))
    local = Window.partitionBy(*group, "_b").orderBy(*order)
    final = Window.partitionBy(*group).orderBy(*order)
    return (
        bucketed.withColumn("_r", F.row_number().over(local)).where(F.col("_r") <= n)
        .withColumn("_r", F.row_number().over(final)).where(F.col("_r") <= n)
        .drop("_b", "_r")
    )


def spread_join(
    facts: DataFrame,
    lookup: DataFrame,
    on: Sequence[str],
    size: str,
    how: str = "left",
    hot_rows: int = HOT_ROWS,
    max_hot: int = MAX_HOT,
) -> DataFrame:
    """Join ``facts`` with a ``lookup`` that has one row per key.

    ``size`` names the lookup column with the number of fact rows per key; it
    is not part of the result.  ``how`` is left, inner, semi or anti.
    """
    on = list(on)
    attributes = [c for c in lookup.columns if c not in on and c != size]
    rows = lookup.select(
        *on, size, F.struct(F.lit(True).alias("_hit"), *attributes).alias("_a")
    )
    hot = (
        rows.where(F.col(size) >= hot_rows)
        .orderBy(F.desc(size), *on).limit(max_hot)
        .select(*on, F.col("_a").alias("_hot"))
    )
    # pmod(size, 1) is 0 for every row but not a literal, so the optimiser keeps
    # it as a join key and the spread rows cannot be gathered by key again
    cold = rows.select(*on, F.pmod(F.col(size), F.lit(1)).cast("int").alias("_slot"), "_a")
    away = F.col("_hot").isNotNull()
    for k in on:
        away = away | F.col(k).isNull()
    slot = F.when(away, F.pmod(F.xxhash64(*facts.columns), F.lit(1 << 16)).cast("int") + 1)
    joined = (
        facts.join(F.broadcast(hot), on, "left")
        .withColumn("_slot", slot.otherwise(F.lit(0)))
        .join(cold, [*on, "_slot"], "left")
        .withColumn("_a", F.coalesce("_hot", "_a"))
    )
    hit = F.col("_a._hit").isNotNull()
    if how in ("inner", "semi"):
        joined = joined.where(hit)
    elif how == "anti":
        joined = joined.where(~hit)
    if how in ("semi", "anti"):
        return joined.select(*facts.columns)
    return joined.select(*facts.columns, *[F.col("_a")[c].alias(c) for c in attributes])


def block_join(
    a: DataFrame, b: DataFrame, on: Sequence[str], block: int = BLOCK_ROWS, max_hot: int = MAX_HOT, parts: int | None = None
) -> DataFrame:
    """Inner join in which a key may hold very many rows on both sides.

    A key with m and n rows is cut in ceil(m / block) times ceil(n / block) cells.  A row goes to one block of its
    own side, by a hash of all its columns, and is repeated for the blocks of the other side, so a cell joins about ``block``
    with ``block`` rows and cells are spread over the shuffle.  Keys of up to ``block`` rows on both sides are one cell: their
    rows are not repeated.  Equal rows share a block; collapse them first if there may be very many.  NULL keys meet nothing.
    With ``parts`` the cells are dealt over so many partitions, so a task's memory does not grow with the tables.
    """
    on = list(on)
    mine = [c for c in a.columns if c not in on]
    theirs = [c for c in b.columns if c not in on]
    sizes = (
        a.select(*on, F.lit(1).alias("_m"), F.lit(0).alias("_n"))
        .unionByName(b.select(*on, F.lit(0).alias("_m"), F.lit(1).alias("_n")))
        .groupBy(*on).agg(F.sum("_m").alias("_m"), F.sum("_n").alias("_n"))
        .where((F.greatest("_m", "_n") > block) & (F.least("_m", "_n") > 0))
    )
    cuts = durable(sizes.select(
        *on, (F.col("_m") + F.col("_n")).alias("_size"),
        F.ceil(F.col("_m") / block).cast("int").alias("_ga"), F.ceil(F.col("_n") / block).cast("int").alias("_gb"),
    ))

    few = cuts.limit(max_hot + 1).count() <= max_hot

    def cells(df: DataFrame, own: str, other: str, first: bool) -> DataFrame:
        if few:  # no row moves to learn its cuts
            cut = df.join(F.broadcast(cuts.drop("_size")), on, "left")
        else:
            cut = spread_join(df, cuts, on, "_size", hot_rows=block, max_hot=max_hot)
        at = F.pmod(F.xxhash64(*df.columns), F.coalesce(own, F.lit(1))).cast("int")
        every = F.explode(F.sequence(F.lit(0), F.coalesce(other, F.lit(1)) - 1))
        pick = [at.alias("_i"), every.alias("_j")] if first else [at.alias("_j"), every.alias("_i")]
        return cut.select(*df.columns, *pick)

    at, one, two = [*on, "_i", "_j"], cells(a, "_ga", "_gb", True), cells(b, "_gb", "_ga", False)
    if parts is not None:
        one, two = one.repartition(parts, *at), two.repartition(parts, *at)
    return one.join(two, at).select(*on, *mine, *theirs)


def attach(
    facts: DataFrame, table: DataFrame, on: Sequence[str], how: str = "left"
) -> DataFrame:
    """Join ``facts`` with a lookup ``table`` of unknown hotness.

    The lookup is reduced to one row per key first, the least one, so a key that
    was landed twice doubles no fact.  It is a plain join: a hot key is split by
    the adaptive skew join, as the facts are on its streamed side.
    """
    on = list(on)
    rest = [c for c in table.columns if c not in on]
    if rest:
        one = table.groupBy(*on).agg(F.min(F.struct(*rest)).alias("_v")).select(*on, "_v.*")
    else:
        one = table.select(*on).distinct()
    names = {"left": "left", "inner": "inner", "semi": "left_semi", "anti": "left_anti"}
    joined = facts.join(one, on, names[how])
    return joined.select(*facts.columns, *(rest if how in ("left", "inner") else []))


def _ordered(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Range partition and sort; written out so both readers see one layout."""
    local = df.repartitionByRange(*order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id()
    return durable(
        local.withColumn("_at", at)
        .withColumn("_part", F.shiftright(F.col("_at"), 33))
        .withColumn("_pos", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
    )


def global_rank(df: DataFrame, order: Sequence[Column], name: str = "rank") -> DataFrame:
    """Add the 1-based position in a total order.

    The offsets table has one row per partition, a count fixed by the session.
    """
    placed = _ordered(df, order)
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    offsets = _prefix(sizes, ["_n"])
    return (
        placed.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_pos") + F.col("_before_n") + 1)
        .select(*df.columns, name)
    )


def running_totals(
    df: DataFrame, order: Sequence[Column], sums: Sequence[str]
) -> DataFrame:
    """Add ``cum_<x>``: the total of x up to and including the row.

    ``df`` must have unique order keys (group by them first).
    """
    placed = _ordered(df, order)
    totals = placed.groupBy("_part").agg(*[F.sum(s).alias(s) for s in sums])
    offsets = _prefix(totals, sums).select(
        "_part", *[F.col("_before" + (s if s.startswith("_") else "_" + s)) for s in sums]
    )
    here = (
        Window.partitionBy("_part").orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    )
    out = placed.join(F.broadcast(offsets), "_part")
    for s in sums:
        out = out.withColumn(f"cum_{s}", F.sum(s).over(here) + F.col(f"_before_{s}"))
    return out.select(*df.columns, *[f"cum_{s}" for s in sums])


def _prefix(totals: DataFrame, names: Sequence[str]) -> DataFrame:
    """Exclusive prefix sums over the partition number (one row per partition)."""
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(
        "_part",
        *[
            F.coalesce(F.sum(n).over(before), F.lit(0))
            .alias("_before" + (n if n.startswith("_") else "_" + n))
            for n in names
        ],
    )

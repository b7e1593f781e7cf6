"""Split assignment without leakage between near-duplicates.

All graph work is done on distinct sequences.  Rows of one sequence behave
alike: they share all near-duplicate neighbours, so a sequence with a neighbour
forms one node, and rows of a sequence without any are components of one row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom import fixed_values as fv
from strandloom.operators import graph, skew
from strandloom.session import durable

SEQ = "aptamer_sequence"


def _both(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("seq_a").alias("seq"), F.col("seq_b").alias("other")).unionByName(
        pairs.select(F.col("seq_b").alias("seq"), F.col("seq_a").alias("other"))
    )


def _members(df: DataFrame) -> DataFrame:
    return df.groupBy(F.col(SEQ).alias("seq")).agg(
        *[F.bool_or(F.col("split") == s).alias(f"in_{s}") for s in (*fv.SPLITS, "unassigned")],
        F.count(F.lit(1)).alias("n"),
    )


def _set_where(df: DataFrame, table: DataFrame, value: Column, when: Column) -> DataFrame:
    """Rewrite ``split`` of the rows whose sequence is in ``table``."""
    joined = skew.spread_join(df, table.withColumnRenamed("seq", SEQ), [SEQ], "n")
    new = F.when(when & value.isNotNull(), value).otherwise(F.col("split"))
    return joined.withColumn("split", new).select(*df.columns)


def fix_cross(df: DataFrame, pairs: DataFrame) -> DataFrame:
    """Train rows with a near-duplicate in test move to test."""
    m = _members(df)
    tested = m.where("in_test").select(F.col("seq").alias("other"))
    hit = _both(pairs).join(tested, "other", "left_semi").select("seq").distinct()
    table = m.where("in_train").join(hit, "seq", "left_semi").select("seq", "n").withColumn(
        "to", F.lit("test")
    )
    return _set_where(df, table, F.col("to"), F.col("split") == "train")


def tier_to_val(df: DataFrame) -> DataFrame:
    """Unassigned rows of the validation tier go to val."""
    move = (F.col("split") == "unassigned") & (F.col("training_tier") == 2)
    return df.withColumn("split", F.when(move, "val").otherwise(F.col("split")))


def unassigned_components(df: DataFrame, pairs: DataFrame) -> DataFrame:
    """(seq, component) over edges whose both ends have unassigned rows."""
    free = _members(df).where("in_unassigned").select("seq")
    inner = pairs.join(free.withColumnRenamed("seq", "seq_a"), "seq_a", "left_semi").join(
        free.withColumnRenamed("seq", "seq_b"), "seq_b", "left_semi"
    )
    return graph.connected_components(inner, "seq_a", "seq_b").withColumnRenamed("node", "seq")


def forced_split(df: DataFrame, pairs: DataFrame, components: DataFrame) -> DataFrame:
    """Unassigned near-duplicates of held-out rows join them; test beats val.

    The choice spreads through the unassigned component.
    """
    m = _members(df)
    held = m.where(F.col("in_val") | F.col("in_test")).select(
        F.col("seq").alias("other"), F.when(F.col("in_test"), 2).otherwise(1).alias("rank")
    )
    direct = (
        _both(pairs).join(held, "other").groupBy("seq").agg(F.max("rank").alias("rank"))
        .join(m.where("in_unassigned").select("seq", "n"), "seq")
    )
    grouped = direct.join(components, "seq", "left").withColumn(
        "component", F.coalesce("component", "seq")
    )
    per = grouped.groupBy("component").agg(F.max("rank").alias("rank"))
    spread = components.join(per, "component").select("seq", "rank").unionByName(
        grouped.where(F.col("component") == F.col("seq")).select("seq", "rank")
    ).groupBy("seq").agg(F.max("rank").alias("rank"))
    table = spread.join(m.select("seq", "n"), "seq")
    to = F.when(F.col("rank") == 2, "test").when(F.col("rank") == 1, "val")
    return _set_where(df, table, to, F.col("split") == "unassigned")


def free_components(df: DataFrame, components: DataFrame) -> DataFrame:
    """(row_id, component_id, size) of the rows that are still unassigned.

    component_id is the least row id of the component.  The rows of a sequence
    without neighbours are components of their own.
    """
    free = df.where(F.col("split") == "unassigned").select("row_id", F.col(SEQ).alias("seq"))
    per_seq = free.groupBy("seq").agg(F.min("row_id").alias("lo"), F.count(F.lit(1)).alias("n"))
    linked = per_seq.join(components, "seq")
    per = linked.groupBy("component").agg(F.min("lo").alias("component_id"), F.sum("n").alias("size"))
    table = linked.join(per, "component").select("seq", "n", "component_id", "size")
    rows = skew.spread_join(free, table, ["seq"], "n")
    return rows.select(
        "row_id", F.coalesce("component_id", "row_id").alias("component_id"),
        F.coalesce("size", F.lit(1)).cast("bigint").alias("size"),
    )


def budget_plan(sizes: list[tuple[int, int]], budget: dict[str, int]) -> list[tuple[int, int, int, str]]:
    """Ranges (size, first rank, last rank, split) for components by size.

    ``sizes`` is the histogram (size, count).  Components go, largest first, to
    the first of val, test, train that still has room, else to the split with
    the largest remainder (ties train, val, test).  Because the remainders
    together always cover the rows left, the last rule applies at most twice
    per size, so the work depends on the histogram alone.
    """
    left = dict(budget)
    out = []
    for size, count in sorted(sizes, reverse=True):
        rank = 1
        while count:
            room = next((s for s in ("val", "test", "train") if left[s] >= size), None)
            if room:
                take = min(count, left[room] // size)
            else:
                room = max(("train", "val", "test"), key=lambda s: left[s])
                take = 1
            out.append((size, rank, rank + take - 1, room))
            left[room] -= take * size
            rank, count = rank + take, count - take
    return out


def budget_assign(df: DataFrame, components: DataFrame) -> DataFrame:
    """Spread the free components over the splits by an 80/10/10 budget."""
    free = free_components(df, components)
    n = {r["split"]: r["n"] for r in df.groupBy("split").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(n.values())
    goal = {"train": math.ceil(total * 0.8), "val": math.ceil(total * 0.1)}
    goal["test"] = total - goal["train"] - goal["val"]
    budget = {s: max(0, goal[s] - n.get(s, 0)) for s in ("train", "val", "test")}
    comps = free.groupBy("component_id").agg(F.first("size").alias("size"))
    ranked = skew.global_rank(comps, [F.desc("size"), F.asc("component_id")], "pos")
    # the histogram has at most sqrt(2 n) different sizes
    histogram = ranked.groupBy("size").agg(
        F.count(F.lit(1)).alias("c"), F.min("pos").alias("start")
    ).collect()
    start = {r["size"]: r["start"] for r in histogram}
    ranges = [
        (size, start[size] + lo - 1, start[size] + hi - 1, split)
        for size, lo, hi, split in budget_plan([(r["size"], r["c"]) for r in histogram], budget)
    ]
    # a handful of rank ranges per size: an equi-join on size, then the range
    plan = df.sparkSession.createDataFrame(ranges, "size bigint, lo bigint, hi bigint, to string")
    placed = ranked.join(F.broadcast(plan), "size").where(F.col("pos").between(F.col("lo"), F.col("hi")))
    table = free.select("row_id", "component_id").join(
        placed.select("component_id", "to"), "component_id"
    ).select("row_id", "to")
    joined = df.join(table, "row_id", "left")
    return joined.withColumn("split", F.coalesce("to", "split")).select(*df.columns)


def converge(df: DataFrame, pairs: DataFrame) -> DataFrame:
    """Every near-duplicate component with held-out rows becomes held-out.

    One pass over whole components (test before val) replaces repeated ordered
    passes and reaches the same fixpoint.
    """
    comp = graph.connected_components(pairs, "seq_a", "seq_b").withColumnRenamed("node", "seq")
    m = _members(df).select(
        "seq", "n", F.when(F.col("in_test"), 2).when(F.col("in_val"), 1).otherwise(0).alias("rank")
    )
    linked = m.join(comp, "seq")
    per = linked.groupBy("component").agg(F.max("rank").alias("to_rank")).where("to_rank > 0")
    table = linked.join(per, "component").select("seq", "n", "to_rank")
    to = F.when(F.col("to_rank") == 2, "test").when(F.col("to_rank") == 1, "val")
    return _set_where(df, table, to, F.lit(True))


def assign_splits(df: DataFrame, pairs: DataFrame) -> DataFrame:
    """All steps in order; NULL splits count as unassigned."""
    rows = df.withColumn("split", F.coalesce("split", F.lit("unassigned")))
    rows = durable(tier_to_val(fix_cross(rows, pairs)))
    components = unassigned_components(rows, pairs)
    rows = durable(forced_split(rows, pairs, components))
    rows = durable(budget_assign(rows, components))
    return converge(rows, pairs)


def family_split(
    df: DataFrame, seed: int = 42, train: float = 0.7, val: float = 0.15
) -> DataFrame:
    """Whole targets to train / val / test by a seeded hash order."""
    families = df.where(F.col("target_name").isNotNull()).groupBy("target_name").agg(
        F.count(F.lit(1)).alias("n_rows")
    )
    order = F.md5(F.concat(F.lit(f"{seed}|"), F.col("target_name")).cast("binary"))
    ranked = skew.global_rank(
        families.withColumn("_o", order), [F.col("_o"), F.col("target_name")], "pos"
    )
    n = families.count()
    n_train, n_val = max(1, int(n * train)), max(1, int(n * val))
    split = (
        F.when(F.col("pos") <= n_train, "train")
        .when(F.col("pos") <= n_train + n_val, "val").otherwise("test")
    )
    table = ranked.select("target_name", "n_rows", split.alias("family_split"))
    return skew.spread_join(df, table, ["target_name"], "n_rows", how="inner")

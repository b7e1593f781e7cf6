"""Near-duplicate sequences within edit distance 2, exact and skew-safe.

Blocking.  Cut a string of length L into k even segments.  Two edits touch at
most two segments, so for some i < j the rest of the string - prefix P before
segment i, middle M between i and j, suffix S after j - survives in the other
string, with M shifted by the length change of segment i.  Strings therefore
meet on the key (L, i, j, P, M, S): one key per (i, j) on the longer side, eight
shift variants on the other side.  No pair within distance 2 is missed, for any
k and any length (checked against brute force in the tests).

Hot keys.  Constant flanks or low-complexity parts can put very many strings
under one key.  A key whose candidate product exceeds ``bucket_pairs`` is not
expanded; every string under such a key is sent on to the next tier, cut into
more segments.  A pair that met under a hot key has both its strings there, so
it meets again in the next tier.  The last tier's keys fix all but two segments
of a few bases; what still shares one meets in blocks (``skew.block_join``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom import fixed_values as fv
from strandloom.operators import skew
from strandloom.session import durable

TIERS = (4, 12, 30)
BUCKET_PAIRS = 4_000_000
PAIR_BLOCK = 10_000  # rows of a sequence that meet in one task

# (length of longer minus shorter, shift of the middle part)
_SHIFTS = [
    (d, s) for d in (0, 1, 2) for s in (-2, -1, 0, 1, 2) if abs(s) + abs(-d - s) <= 2
]


def _cut(length: str, at: str, k: int):
    return F.expr(f"CAST(floor(({length}) * ({at}) / {k}) AS INT)")


def _combos(df: DataFrame, k: int) -> DataFrame:
    return df.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(k - 2)))).withColumn(
        "j", F.explode(F.sequence(F.col("i") + 1, F.lit(k - 1)))
    )


def _key():
    return F.xxhash64("L", "i", "j", "P", "M", "S")


def _index_keys(seqs: DataFrame, k: int) -> DataFrame:
    """Keys of every string as the longer side."""
    x = _combos(seqs.withColumn("L", F.length("seq")), k)
    p_end, i_end = _cut("L", "i", k), _cut("L", "i + 1", k)
    j_at, j_end = _cut("L", "j", k), _cut("L", "j + 1", k)
    return x.select(
        "seq", "L", "i", "j",
        F.substring("seq", F.lit(1), p_end).alias("P"),
        F.substring("seq", i_end + 1, j_at - i_end).alias("M"),
        F.substring("seq", j_end + 1, F.col("L") - j_end).alias("S"),
    ).select(_key().alias("bkey"), "seq")


def _probe_keys(seqs: DataFrame, k: int) -> DataFrame:
    """Keys under which every string looks for an equal or longer one."""
    shifts = F.array(*[F.struct(F.lit(d).alias("d"), F.lit(s).alias("s")) for d, s in _SHIFTS])
    x = _combos(seqs, k).withColumn("v", F.explode(shifts))
    x = x.select(
        "seq", "i", "j", F.col("v.d").alias("d"), F.col("v.s").alias("s"),
        (F.length("seq") + F.col("v.d")).alias("L"),
    )
    p_end, i_end = _cut("L", "i", k), _cut("L", "i + 1", k)
    j_at, j_end = _cut("L", "j", k), _cut("L", "j + 1", k)
    fits = (i_end - p_end + F.col("s") >= 0) & (j_end - j_at - F.col("d") - F.col("s") >= 0)
    return (
        x.where(fits)
        .select(
            "seq", "L", "i", "j",
            F.substring("seq", F.lit(1), p_end).alias("P"),
            F.substring("seq", i_end + F.col("s") + 1, j_at - i_end).alias("M"),
            F.substring("seq", j_end - F.col("d") + 1, F.col("L") - j_end).alias("S"),
        )
        .select(_key().alias("bkey"), "seq")
    )


def near_dupe_sequences(
    df: DataFrame,
    seq: str = "aptamer_sequence",
    distance: int = fv.MAX_EDIT_DISTANCE,
    tiers: Sequence[int] = TIERS,
    bucket_pairs: int = BUCKET_PAIRS,
) -> DataFrame:
    """Distinct pairs (seq_a < seq_b, dist) with 1 <= edit distance <= 2.

    Runs its jobs when called: whether a tier has hot keys decides if another
    tier is needed, and the result is written out because every consumer reads
    it more than once.
    """
    if not 1 <= distance <= 2:
        raise ValueError("distance must be 1 or 2")
    # every string turns into dozens of keys, so the few bytes of the distinct
    # strings are spread over all partitions instead of being coalesced
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pool = durable(
        df.where(F.col(seq).isNotNull()).select(F.col(seq).alias("seq")).distinct().repartition(width)
    )
    found = None
    for tier, k in enumerate(tiers):
        index, probe = _index_keys(pool, k), _probe_keys(pool, k)
        deferred = None
        hot = _hot_keys(index, probe, bucket_pairs) if tier < len(tiers) - 1 else None
        if hot is not None and not hot.isEmpty():
            hot = durable(hot)
            deferred = durable(
                skew.spread_join(index.unionByName(probe), hot, ["bkey"], "n", how="semi")
                .select("seq").distinct().repartition(width)
            )
            index = skew.spread_join(index, hot, ["bkey"], "n", how="anti")
            probe = skew.spread_join(probe, hot, ["bkey"], "n", how="anti")
        left = index.select("bkey", F.col("seq").alias("x"))
        right = probe.select("bkey", F.col("seq").alias("y"))
        last = tier == len(tiers) - 1
        met = skew.block_join(left, right, ["bkey"], max(1, int(bucket_pairs ** 0.5))) if last else _meet(left, right)
        near = (
            met.where((F.col("x") != F.col("y"))
                   & F.levenshtein(F.col("x"), F.col("y"), distance).between(1, distance))
            .select(F.least("x", "y").alias("seq_a"), F.greatest("x", "y").alias("seq_b"))
        )
        found = near if found is None else found.unionByName(near)
        if deferred is None:
            break
        pool = deferred
    return durable(
        found.distinct().withColumn("dist", F.levenshtein("seq_a", "seq_b", distance))
    )


def _meet(left: DataFrame, right: DataFrame) -> DataFrame:
    """Inner join on the key, with a shuffle: keys are exploded from a small table, whose size Spark would take for theirs and broadcast them."""
    return left.join(right.hint("merge"), "bkey")


def _hot_keys(index: DataFrame, probe: DataFrame, bucket_pairs: int) -> DataFrame:
    """Keys whose candidate product is too large, with their row counts."""
    sizes = (
        index.select("bkey", F.lit(1).alias("a"), F.lit(0).alias("b"))
        .unionByName(probe.select("bkey", F.lit(0).alias("a"), F.lit(1).alias("b")))
        .groupBy("bkey").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    )
    return sizes.where(F.col("a") * F.col("b") > bucket_pairs).select(
        "bkey", (F.col("a") + F.col("b")).alias("n")
    )


def near_dupe_members(df: DataFrame, pairs: DataFrame) -> DataFrame:
    """(seq, split, label, n): rows of the sequences that have a near-duplicate.

    With the sequence pairs this says all that the row pairs say about numbers, in one row for each class.
    """
    linked = pairs.select(F.col("seq_a").alias("seq")).unionByName(pairs.select(F.col("seq_b").alias("seq"))).distinct()
    return df.groupBy(
        F.col("aptamer_sequence").alias("seq"), F.coalesce("split", F.lit("unassigned")).alias("split"), "label"
    ).agg(F.count(F.lit(1)).alias("n")).join(linked, "seq", "left_semi")


def near_dupe_pairs(df: DataFrame, pairs: DataFrame, block: int = PAIR_BLOCK) -> DataFrame:
    """Row pairs of the sequence pairs with targets, labels and splits.

    A sequence of n rows is cut in ceil(n / block) blocks and a pair of sequences in one cell for each pair of
    blocks, so neither join meets more than a block of rows under one key of its row side, and the cells of
    a hot sequence are tasks of their own.  ``near_dupe_members`` is the result without row pairs.
    """
    side = df.select(
        F.col("row_id"), F.col("aptamer_sequence").alias("seq"), "target_name", "label",
        F.coalesce("split", F.lit("unassigned")).alias("split"),
    )
    sizes = side.groupBy("seq").agg(F.count(F.lit(1)).alias("n")).where("seq IS NOT NULL")
    cuts = sizes.where(F.col("n") > block).select("seq", "n", F.ceil(F.col("n") / block).cast("int").alias("g"))
    g = F.coalesce("g", F.lit(1))
    at = F.pmod(F.xxhash64("row_id"), g).cast("int")
    placed = skew.spread_join(side, cuts, ["seq"], "n", hot_rows=block).select(*side.columns, at.alias("at"))
    cells = pairs
    for x in ("a", "b"):
        named = cuts.select(F.col("seq").alias(f"seq_{x}"), "g")
        cells = cells.join(named, f"seq_{x}", "left").withColumn(f"at_{x}", F.explode(F.sequence(F.lit(0), g - 1))).drop("g")
    a = placed.select(*[F.col(c).alias(f"{c}_a") for c in placed.columns])
    b = placed.select(*[F.col(c).alias(f"{c}_b") for c in placed.columns])
    both = cells.join(a, ["seq_a", "at_a"]).join(b, ["seq_b", "at_b"])
    swap = F.col("row_id_a") > F.col("row_id_b")

    def pick(name, first):
        x, y = F.col(f"{name}_a"), F.col(f"{name}_b")
        return F.when(swap, y).otherwise(x) if first else F.when(swap, x).otherwise(y)

    out = both.select(
        pick("row_id", True).alias("idx_a"), pick("row_id", False).alias("idx_b"),
        pick("seq", True).alias("seq_a"), pick("seq", False).alias("seq_b"),
        pick("target_name", True).alias("target_a"), pick("target_name", False).alias("target_b"),
        pick("label", True).alias("label_a"), pick("label", False).alias("label_b"),
        pick("split", True).alias("split_a"), pick("split", False).alias("split_b"),
        F.col("dist").alias("levenshtein_dist"),
    )
    return out.withColumn("cross_split", _crosses("split_a", "split_b"))


def _crosses(a: str, b: str):
    held = F.col(a).isin(*fv.HOLDOUT) | F.col(b).isin(*fv.HOLDOUT)
    return held & (F.col(a) != F.col(b))


def split_counts(df: DataFrame, pairs: DataFrame) -> DataFrame:
    """Per sequence pair and split combination the number of row pairs.

    Built from per-sequence counts, so no row pair is ever materialised.
    """
    n = df.groupBy(
        F.col("aptamer_sequence").alias("seq"),
        F.coalesce("split", F.lit("unassigned")).alias("split"),
    ).agg(F.count(F.lit(1)).alias("n"))
    a = n.select(F.col("seq").alias("seq_a"), F.col("split").alias("split_a"), F.col("n").alias("n_a"))
    b = n.select(F.col("seq").alias("seq_b"), F.col("split").alias("split_b"), F.col("n").alias("n_b"))
    return pairs.join(a, "seq_a").join(b, "seq_b").withColumn("row_pairs", F.col("n_a") * F.col("n_b"))


def pair_matrix(df: DataFrame, pairs: DataFrame) -> DataFrame:
    """Row pairs by unordered split combination and distance."""
    return (
        split_counts(df, pairs)
        .groupBy(
            F.least("split_a", "split_b").alias("split_low"),
            F.greatest("split_a", "split_b").alias("split_high"),
            F.col("dist").alias("levenshtein_dist"),
        )
        .agg(F.sum("row_pairs").alias("n"))
    )


def cross_left(df: DataFrame, pairs: DataFrame) -> DataFrame:
    """How many row pairs cross a held-out border (one row)."""
    return split_counts(df, pairs).where(_crosses("split_a", "split_b")).agg(
        F.coalesce(F.sum("row_pairs"), F.lit(0)).alias("cross_pairs")
    )


def verify_no_cross(df: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row with cross_pairs = 0; the query fails where a near-duplicate pair crosses a held-out border."""
    n = F.col("cross_pairs")
    said = F.concat(n.cast("string"), F.lit(" near-duplicate row pairs cross a held-out border"))
    return cross_left(df, pairs).select(F.when(n > 0, F.raise_error(said).cast("bigint")).otherwise(n).alias("cross_pairs"))

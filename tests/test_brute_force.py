"""Scalable operators against small brute-force models, also on skewed data."""

import math
import random

import pytest
from pyspark.sql import functions as F

from strandloom.operators import dedup, enrich, graph, metrics, neardupe, sampling, skew, splits


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def mutate(rng, s, n):
    for _ in range(n):
        i, kind = rng.randrange(len(s) + 1), rng.choice("ids")
        if kind == "i":
            s = s[:i] + rng.choice("ACGT") + s[i:]
        elif s and i < len(s):
            s = s[:i] + (rng.choice("ACGT") if kind == "s" else "") + s[i + 1:]
    return s


def family(rng, n, low, high, flank=""):
    out = []
    while len(out) < n:
        core = "".join(rng.choice("ACGT") for _ in range(rng.randint(low, high)))
        s = flank + core + flank
        out += [s] + [mutate(rng, s, k) for k in (1, 2, 3)]
    return sorted(set(x for x in out if x))


@pytest.mark.parametrize(
    "low,high,flank,bucket",
    [(20, 60, "", 10**9), (0, 9, "", 10**9), (6, 12, "ACGTACGTACGTAAAA", 30), (1, 7, "AAAAAAAAAAAA", 4)],
)
def test_near_dupes_match_brute_force(spark, low, high, flank, bucket):
    seqs = family(random.Random(low * 7 + high), 160, low, high, flank)
    want = {(a, b, lev(a, b)) for i, a in enumerate(seqs) for b in seqs[i + 1:]
            if abs(len(a) - len(b)) <= 2 and lev(a, b) <= 2}
    df = spark.createDataFrame([(s,) for s in seqs], "aptamer_sequence string")
    got = neardupe.near_dupe_sequences(df, tiers=(4, 8, 16), bucket_pairs=bucket).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_near_dupe_distance_one(spark):
    seqs = family(random.Random(3), 80, 18, 30)
    df = spark.createDataFrame([(s,) for s in seqs], "aptamer_sequence string")
    got = {tuple(r)[:2] for r in neardupe.near_dupe_sequences(df, distance=1).collect()}
    assert got == {(a, b) for i, a in enumerate(seqs) for b in seqs[i + 1:] if lev(a, b) == 1}


RC = str.maketrans("ACGT", "TGCA")


def rc_model(rows):
    """The sequential rule: the later row of a complement pair goes."""
    last = {s: i for i, s in rows}
    gone = set()
    for i, s in rows:
        j = last.get(s.translate(RC)[::-1])
        if i in gone or j is None or j == i or j in gone:
            continue
        gone.add(max(i, j))
    return gone


def test_rc_dedup_matches_sequential_rule(spark):
    rng = random.Random(5)
    rows, want, at = [], set(), 0
    for g in range(400):  # groups with their own letters cannot meet
        base = "".join(rng.choice("ACGT") for _ in range(30)) if g % 5 else "ACGT" * (g // 5 + 3)
        group = [base if rng.random() < 0.5 else base.translate(RC)[::-1] for _ in range(rng.randint(1, 6))]
        rows += [(at + i, s) for i, s in enumerate(group)]
        at += len(group)
    want = rc_model(rows)
    df = spark.createDataFrame(rows, "row_id bigint, sequence string")
    kept, audit = dedup.rc_dedup(df)
    assert {r.row_id for r in audit.collect()} == want
    assert {r.row_id for r in kept.collect()} == {i for i, _ in rows} - want
    canonical, _ = dedup.rc_dedup(df, mode="canonical")
    spellings = canonical.select("sequence").distinct().collect()
    seen = {r.sequence for r in spellings}
    assert all(s.translate(RC)[::-1] not in seen or s == s.translate(RC)[::-1] for s in seen)


def test_components_match_union_find(spark):
    rng = random.Random(11)
    edges = [(f"n{rng.randrange(300):03d}", f"n{rng.randrange(300):03d}") for _ in range(200)]
    edges += [("hub", f"leaf{i}") for i in range(100)] + [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(70)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            ra, rb = sorted((find(a), find(b)))
            parent[rb] = ra
    df = spark.createDataFrame(edges, "a string, b string")
    got = {r.node: r.component for r in graph.connected_components(df).collect()}
    assert got == {n: find(n) for n in parent}


def test_spread_join_with_hot_keys(spark):
    rows = [(i, "hot" if i % 3 == 0 else None if i % 11 == 0 else f"k{i % 40}") for i in range(600)]
    facts = spark.createDataFrame(rows, "row_id bigint, k string")
    table = facts.where("k IS NOT NULL AND k <> 'k7'").groupBy("k").agg(
        F.count("*").alias("n"), F.max("row_id").alias("top")
    )
    want = {r.k: r.top for r in table.collect()}
    for hot_rows, max_hot in ((10, 1), (10**9, 1), (1, 1000)):
        kw = {"hot_rows": hot_rows, "max_hot": max_hot}
        left = skew.spread_join(facts, table, ["k"], "n", **kw).collect()
        assert sorted((r.row_id, r.top) for r in left) == [(i, want.get(k)) for i, k in rows]
        for how, keep in (("semi", True), ("anti", False), ("inner", True)):
            got = {r.row_id for r in skew.spread_join(facts, table, ["k"], "n", how=how, **kw).collect()}
            assert got == {i for i, k in rows if (k in want) == keep}


def test_spread_join_keeps_hot_rows_apart(spark):
    """A shuffled join spreads the rows of a hot key over all tasks."""
    facts = spark.range(4000).select(
        "id", F.when(F.col("id") % 3 < 2, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k")
    )
    table = facts.groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("top"))
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        joined = skew.spread_join(facts, table, ["k"], "n", hot_rows=1000)
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(k" in plan and ", _slot" in plan
        shares = joined.groupBy(F.spark_partition_id()).count().collect()
        assert max(r["count"] for r in shares) < 4000 * 0.4
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_attach_counts_once_per_key(spark):
    facts = spark.createDataFrame([(i, f"k{i % 5}" if i % 7 else None) for i in range(100)], "row_id bigint, k string")
    table = spark.createDataFrame([("k1", 10), ("k2", 20), ("k9", 90)], "k string, v int")
    got = {r.row_id: r.v for r in skew.attach(facts, table, ["k"]).collect()}
    assert got == {i: ({"k1": 10, "k2": 20}.get(f"k{i % 5}") if i % 7 else None) for i in range(100)}


def test_global_rank_and_running_totals(spark):
    rng = random.Random(2)
    rows = [(i, rng.randrange(50)) for i in range(500)]
    df = spark.createDataFrame(rows, "id int, x int")
    order = [F.desc("x"), F.asc("id")]
    got = {r.id: r["rank"] for r in skew.global_rank(df, order).collect()}
    want = sorted(rows, key=lambda r: (-r[1], r[0]))
    assert got == {i: n for n, (i, _) in enumerate(want, 1)}
    per = df.groupBy("x").agg(F.count("*").alias("n"))
    sums = {r.x: r.cum_n for r in skew.running_totals(per, [F.desc("x")], ["n"]).collect()}
    assert sums == {x: sum(1 for _, y in rows if y >= x) for x in {y for _, y in rows}}


def test_ranking_metrics_match_definition(spark):
    rng = random.Random(8)
    rows = [(int(rng.random() < 0.4), round(rng.random(), 2), None, None) for _ in range(400)]
    pos, neg = [s for y, s, *_ in rows if y], [s for y, s, *_ in rows if not y]
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    ap, before = 0.0, 0
    for t in sorted({s for _, s, *_ in rows}, reverse=True):
        hit = sum(p >= t for p in pos)
        ap += (hit - before) / len(pos) * hit / (hit + sum(n >= t for n in neg))
        before = hit
    df = spark.createDataFrame(rows, "y_true int, y_prob double, kd_true double, kd_pred double")
    got = metrics.ranking_metrics(df).first()
    assert got.auroc == pytest.approx(auc) and got.average_precision == pytest.approx(ap)
    one = metrics.ranking_metrics(df.where("y_true = 1")).first()
    assert one.auroc is None and one.average_precision is None
    flat = metrics.threshold_metrics(df, threshold=-1.0).first()
    assert flat.mcc_degenerate and flat.mcc is None and flat.sensitivity == 1.0


def greedy(sizes, budget):
    used = dict.fromkeys(budget, 0)
    out = []
    for size, count in sorted(sizes, reverse=True):
        for rank in range(1, count + 1):
            room = next((s for s in ("val", "test", "train") if budget[s] - used[s] >= size), None)
            room = room or max(("train", "val", "test"), key=lambda s: budget[s] - used[s])
            used[room] += size
            out.append((size, rank, room))
    return out


def test_budget_plan_equals_one_by_one_greedy():
    rng = random.Random(4)
    for _ in range(300):
        sizes = [(s, rng.randint(1, 12)) for s in rng.sample(range(1, 15), rng.randint(1, 6))]
        total = sum(s * c for s, c in sizes)
        cut = sorted(rng.randint(0, total) for _ in range(2))
        budget = {"train": cut[0], "val": cut[1] - cut[0], "test": total - cut[1]}
        plan = splits.budget_plan(sizes, budget)
        flat = [(size, r, to) for size, lo, hi, to in plan for r in range(lo, hi + 1)]
        assert sorted(flat) == sorted(greedy(sizes, budget))


def test_assign_splits_leaves_no_crossing(spark):
    rng = random.Random(9)
    seqs = family(rng, 120, 20, 40)
    rows = [
        (i, rng.choice(seqs), rng.choice(["train", "val", "test", None, None, None]), 2 if i % 17 == 0 else 1)
        for i in range(300)
    ]
    df = spark.createDataFrame(rows, "row_id bigint, aptamer_sequence string, split string, training_tier int")
    pairs = neardupe.near_dupe_sequences(df)
    out = splits.durable(splits.assign_splits(df, pairs))
    assert out.count() == len(rows) and out.where("split IS NULL OR split = 'unassigned'").count() == 0
    assert neardupe.cross_left(out, pairs).first().cross_pairs == 0
    shuffled = splits.assign_splits(df.orderBy(F.rand(1)).repartition(7), pairs)
    assert {tuple(r) for r in shuffled.collect()} == {tuple(r) for r in out.collect()}


def test_balanced_sample_is_exact_and_balanced(spark):
    df = spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(500)], "row_id bigint, label int")
    got = sampling.balanced_sample(df, 1000).collect()
    ones = sum(r.label for r in got)
    assert len(got) == 1000 and 400 < ones < 600
    assert {r.row_id % 10 == 0 for r in got if r.label} == {True}


def test_p_value(spark):
    # tabled critical values of r, and one and three degrees of freedom in closed form
    cases = [(0.576, 12, 0.05), (0.7079, 12, 0.01), (0.1946, 102, 0.05), (0.0, 30, 1.0), (1.0, 9, 0.0), (-1.0, 3, 0.0), (0.5, 3, 2 / 3),
             (0.0062, 99_998, 0.05), (0.3, 5, None), (0.9, 2, None)]
    df = spark.createDataFrame([(float(r), n) for r, n, _ in cases], "r double, n bigint")
    got = [x.p for x in df.select(metrics.pearson_p(F.col("r"), F.col("n")).alias("p")).collect()]
    t = 0.3 * (3 / 0.91) ** 0.5  # Student's t with three degrees of freedom
    want3 = 1 - 2 / math.pi * (math.atan(t / 3 ** 0.5) + (t / 3 ** 0.5) / (1 + t * t / 3))
    for (r, n, want), p in zip(cases, got):
        if n == 5:
            assert p == pytest.approx(want3, rel=1e-9)
        else:
            assert p == (None if want is None else pytest.approx(want, rel=5e-3, abs=1e-12)), (r, n)


def test_balanced_sample_of_many_classes(spark):
    df = spark.range(30_000).select(F.col("id").alias("row_id"), (F.col("id") % 10_000).alias("label"))
    got = sampling.balanced_sample(df, 20_000)
    assert got.count() == 20_000 and got.where("label <> row_id % 10000").count() == 0
    assert 8_000 < got.select("label").distinct().count() < 9_200  # 10,000 (1 - 1/e ** 2)


# --- keys that hold a third of the rows on both sides -----------------------------


def test_block_join_equals_a_plain_join(spark):
    rng = random.Random(4)
    key = lambda: rng.choice(["hot", "hot", None, *"abcdefgh"])
    a = spark.createDataFrame([(key(), i) for i in range(300)], "k string, x int")
    b = spark.createDataFrame([(key(), i, "y") for i in range(200)], "k string, z int, y string")
    got = skew.block_join(a, b, ["k"], block=7)
    assert got.columns == ["k", "x", "z", "y"]
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, a.join(b, "k").collect()))
    assert skew.block_join(a, b.limit(0), ["k"]).count() == 0


def test_interactions_with_a_hot_one(spark):
    rng = random.Random(5)
    aptamers = [(f"a{i}", f"{i}-x", "ACGT" if i % 5 else None, None) for i in range(40)]
    rows = []
    for _ in range(400):
        i = rng.choice(["hot", "hot", None, *range(20)])
        who = rng.choice([f"a{rng.randrange(40)}", f"t{rng.randrange(9)}"])
        rows.append((None if i is None else str(i), who, f"target {who}", rng.choice([None, 1.0])))
    got = enrich.interaction_pairs(
        spark.createDataFrame(aptamers, "id string, label string, sequence string, has_modification_details string"),
        spark.createDataFrame(rows, "int string, has_participant string, participant_label string, dissociation_constant_value double"),
        block=10,
    ).select("int", "aptamer_uri", "target_name", "kd_molar", "pmid", "sequence_clean").collect()
    seq = {a[0]: a[2] for a in aptamers}
    want = [(i, p, label, kd, p[1:], "ACGT") for i, p, _, kd in rows for j, q, label, _ in rows
            if i is not None and i == j and seq.get(p) and q[0] == "t"]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_row_pairs_of_a_hot_sequence(spark):
    rng = random.Random(6)
    seqs = family(rng, 12, 20, 24)
    hot = seqs[0]
    rows = [(i, hot if i % 3 == 0 else rng.choice(seqs), f"t{i % 4}", i % 2, rng.choice(["train", "val", None])) for i in range(240)]
    df = spark.createDataFrame(rows, "row_id bigint, aptamer_sequence string, target_name string, label int, split string")
    pairs = neardupe.near_dupe_sequences(df)
    got = neardupe.near_dupe_pairs(df, pairs, block=9).select("idx_a", "idx_b", "levenshtein_dist").collect()
    want = [(a[0], b[0], lev(a[1], b[1])) for a in rows for b in rows if a[0] < b[0] and a[1] != b[1] and lev(a[1], b[1]) <= 2]
    assert sorted(map(tuple, got)) == sorted(want)
    members = neardupe.near_dupe_members(df, pairs).collect()
    linked = {x for p in pairs.collect() for x in p[:2]}
    assert sum(r.n for r in members) == sum(r[1] in linked for r in rows)


def test_border_check_fails_inside_the_plan(spark):
    df = spark.createDataFrame(
        [(1, "ACGTACGTACGTACGTACGT", "train"), (2, "ACGTACGTACGTACGTACGA", "test")], "row_id bigint, aptamer_sequence string, split string")
    pairs = neardupe.near_dupe_sequences(df)
    with pytest.raises(Exception, match="1 near-duplicate row pairs cross"):
        neardupe.verify_no_cross(df, pairs).collect()
    mended = df.withColumn("split", F.lit("test"))
    assert neardupe.verify_no_cross(mended, pairs).first().cross_pairs == 0

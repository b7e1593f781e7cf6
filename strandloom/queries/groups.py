"""Queries of audits, near-duplicates, splits, augmentation, sampling, features and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandloom.operators import (
    audit, augment, features, graph, metrics, neardupe, sampling, splits, validate,
)
from strandloom.queries.derived import derived
from strandloom.queries.registry import CHECKS, query, scratch

# --- audits -----------------------------------------------------------------


def _few_targets(df):
    """Records with coarse targets, so that one sequence meets contradicting labels."""
    return df.withColumn("target_name", F.concat(F.lit("target "), (F.col("row_id") % 2).cast("string")))


@query(
    "label_conflicts",
    """SELECT row_id, aptamer_sequence, t AS target_name, label FROM (SELECT *, concat('target ', row_id % 2) AS t FROM records) r
       WHERE (aptamer_sequence, t) IN (SELECT (aptamer_sequence, concat('target ', row_id % 2)) FROM records GROUP BY aptamer_sequence, row_id % 2 HAVING count(DISTINCT label) > 1)""",
)
def label_conflicts(spark, sf):
    return audit.label_conflicts(_few_targets(derived(spark, sf, "records"))).select(
        "row_id", "aptamer_sequence", "target_name", "label"
    )


CHECKS["membership"] = """
  SELECT upper(aptamer_sequence) AS s, bool_or(split = 'train') AS a, bool_or(split = 'val') AS b, bool_or(split = 'test') AS c FROM records GROUP BY 1"""


@query(
    "split_overlap",
    "SELECT count(*) FILTER (a AND b) AS train_val, count(*) FILTER (a AND c) AS train_test, count(*) FILTER (b AND c) AS val_test FROM membership",
)
def split_overlap(spark, sf):
    return validate.split_overlap(derived(spark, sf, "records"))


@query(
    "intersect_splits",
    """SELECT upper(aptamer_sequence) AS seq FROM records WHERE split = 'train' INTERSECT SELECT upper(aptamer_sequence) FROM records WHERE split = 'test'""",
)
def intersect_splits(spark, sf):
    df = derived(spark, sf, "records").select(F.upper("aptamer_sequence").alias("seq"), "split")
    return df.where("split = 'train'").select("seq").intersect(df.where("split = 'test'").select("seq"))


@query(
    "leakage_to_train",
    """SELECT row_id, CASE WHEN split IN ('val','test') AND (a::INT + b::INT + c::INT) >= 2 THEN 'train' ELSE split END AS split FROM records JOIN membership ON s = upper(aptamer_sequence)""",
)
def leakage_to_train(spark, sf):
    return audit.repair_leakage(derived(spark, sf, "records"))[0].select("row_id", "split")


@query(
    "leakage_review",
    """SELECT row_id, split AS current_split, concat('same_seq_diff_target_leak_', split, '_moved_to_train') AS reason, train_target
       FROM records JOIN membership ON s = upper(aptamer_sequence) LEFT JOIN
         (SELECT DISTINCT upper(aptamer_sequence) AS ts, target_name AS train_target FROM records WHERE split = 'train') q ON ts = s WHERE split IN ('val','test') AND (a::INT + b::INT + c::INT) >= 2""",
)
def leakage_review(spark, sf):
    return audit.repair_leakage(derived(spark, sf, "records"))[1].select(
        "row_id", "current_split", "reason", "train_target"
    )


@query(
    "holdout_guard",
    """SELECT row_id, split FROM records WHERE split IN ('val','test') OR aptamer_sequence NOT IN (SELECT aptamer_sequence FROM records WHERE split IN ('val','test'))""",
)
def holdout_guard(spark, sf):
    return audit.holdout_guard(derived(spark, sf, "records")).select("row_id", "split")


CHECKS["priority_hits"] = """
  SELECT p.name AS priority, r.* FROM records r JOIN (VALUES ('Insulin','\\binsulin\\b'),('Myoglobin','\\bmyoglobin\\b'),('Troponin','\\btroponin\\b'),
    ('NT-proBNP','nt.?probnp|pro.?bnp'),('Albumin','\\balbumin\\b')) p(name, pat) ON regexp_matches(target_name, p.pat, 'i')"""
_PRIORITY_COUNTS = """count(row_id) AS total, count(*) FILTER (split = 'train') AS train_rows, count(*) FILTER (split = 'val') AS val_rows,
  count(*) FILTER (split = 'test') AS test_rows, count(*) FILTER (split = 'unassigned') AS unassigned_rows"""


@query(
    "coverage_audit",
    f"""SELECT priority, total, train_rows, val_rows, test_rows, unassigned_rows, CASE WHEN val_rows = 0 AND test_rows = 0 THEN 'no val or test rows' ELSE '' END AS warning
        FROM (SELECT priority, {_PRIORITY_COUNTS} FROM priority_hits GROUP BY priority) x""",
)
def coverage_audit(spark, sf):
    return audit.coverage_audit(derived(spark, sf, "records")).select(
        "priority", "total", "train_rows", "val_rows", "test_rows", "unassigned_rows", "warning"
    )


@query(
    "coverage_with_values",
    """SELECT priority, count(*) AS total, count(*) FILTER (split = 'train') AS train_rows, count(kd_value) FILTER (split = 'train') AS train_kd,
         count(*) FILTER (split = 'val') AS val_rows, count(kd_value) FILTER (split = 'val') AS val_kd,
         count(*) FILTER (split = 'test') AS test_rows, count(kd_value) FILTER (split = 'test') AS test_kd FROM priority_hits GROUP BY priority""",
)
def coverage_with_values(spark, sf):
    return audit.coverage_audit(derived(spark, sf, "records")).select(
        "priority", "total", "train_rows", "train_kd", "val_rows", "val_kd", "test_rows", "test_kd"
    )


@query(
    "split_share",
    """SELECT split, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS pct FROM records WHERE split <> 'unassigned' GROUP BY split""",
)
def split_share(spark, sf):
    return audit.split_share(derived(spark, sf, "records"))


@query("target_counts", "SELECT target_name, count(*) AS n FROM records GROUP BY 1")
def target_counts(spark, sf):
    return audit.target_counts(derived(spark, sf, "records"))


@query("class_balance", "SELECT label, count(*) AS n, 1.0::DOUBLE / count(*) AS weight FROM records GROUP BY 1")
def class_balance(spark, sf):
    return audit.class_weights(derived(spark, sf, "records"))


CHECKS["rule_kinds"] = """
  SELECT *, CASE WHEN regexp_matches(target_name, '\\bHeLa\\b', 'i') THEN 'cell' WHEN regexp_matches(target_name, '\\bSalmonella\\b', 'i') THEN 'organism'
    WHEN regexp_matches(target_name, '\\bmercury\\b', 'i') THEN 'ion' WHEN regexp_matches(target_name, '\\bochratoxin\\b', 'i') THEN 'toxin'
    WHEN regexp_matches(target_name, '\\b(cocaine|malachite green|GTP|ATP|adenosine)\\b', 'i') THEN 'small_molecule'
    WHEN regexp_matches(target_name, 'insulin B chain', 'i') THEN 'peptide' ELSE 'protein' END AS kind FROM records"""


@query(
    "enrichment_gap",
    """SELECT CASE WHEN kind <> 'protein' THEN concat('not a protein: ', kind) WHEN target_id IS NOT NULL THEN 'accession without sequence' ELSE 'protein not found' END AS cause,
         count(*) AS n, count(DISTINCT target_name) AS targets FROM rule_kinds WHERE protein_sequence IS NULL GROUP BY 1""",
)
def enrichment_gap(spark, sf):
    return audit.enrichment_gap(derived(spark, sf, "records"))


@query(
    "ready_by_split",
    """SELECT split, count(*) FILTER (protein_sequence IS NOT NULL) AS ready, count(*) FILTER (protein_sequence IS NULL) AS missing FROM records GROUP BY split""",
)
def ready_by_split(spark, sf):
    return audit.ready_by_split(derived(spark, sf, "records"))


CHECKS["run_table"] = """
  SELECT row_id, target_name, aptamer_sequence, list_aggregate(list_transform(regexp_extract_all(aptamer_sequence, 'A+|C+|G+|T+'), lambda x: length(x)), 'max') AS n,
    regexp_extract_all(aptamer_sequence, 'A+|C+|G+|T+') AS runs FROM records"""


@query(
    "longest_run",
    """SELECT row_id, aptamer_sequence, list_filter(runs, lambda x: length(x) = n)[1] AS run, CAST(n AS INTEGER) AS run_length FROM run_table WHERE n >= 3 ORDER BY n DESC, row_id LIMIT 20""",
)
def longest_run(spark, sf):
    return audit.homopolymer_audit(derived(spark, sf, "records"), 20).select(
        "row_id", "aptamer_sequence", "run", "run_length"
    )


@query(
    "homopolymer_counts",
    """SELECT count(*) FILTER (n >= 3) AS run_3, count(*) FILTER (n >= 5) AS run_5, count(*) FILTER (n >= 6) AS run_6, count(*) FILTER (regexp_matches(aptamer_sequence, 'G{6,}')) AS g_run_6 FROM run_table""",
)
def homopolymer_counts(spark, sf):
    return audit.homopolymer_counts(derived(spark, sf, "records"))


# --- near-duplicates --------------------------------------------------------

CHECKS["seqs"] = "SELECT DISTINCT aptamer_sequence AS seq FROM recs"
CHECKS["near"] = """
  SELECT a.seq AS seq_a, b.seq AS seq_b, CAST(levenshtein(a.seq, b.seq) AS INTEGER) AS dist FROM seqs a JOIN seqs b
    ON a.seq < b.seq AND abs(length(a.seq) - length(b.seq)) <= 2 AND levenshtein(a.seq, b.seq) <= 2"""
CHECKS["near_rows"] = """
  SELECT least(a.row_id, b.row_id) AS idx_a, greatest(a.row_id, b.row_id) AS idx_b,
    CASE WHEN a.row_id < b.row_id THEN a.split ELSE b.split END AS split_a, CASE WHEN a.row_id < b.row_id THEN b.split ELSE a.split END AS split_b,
    CASE WHEN a.row_id < b.row_id THEN a.label ELSE b.label END AS label_a, CASE WHEN a.row_id < b.row_id THEN b.label ELSE a.label END AS label_b,
    CASE WHEN a.row_id < b.row_id THEN a.target_name ELSE b.target_name END AS target_a, CASE WHEN a.row_id < b.row_id THEN b.target_name ELSE a.target_name END AS target_b,
    dist AS levenshtein_dist FROM near JOIN recs a ON a.aptamer_sequence = seq_a JOIN recs b ON b.aptamer_sequence = seq_b"""
CHECKS["near_cross"] = """
  SELECT *, (split_a IN ('val','test') OR split_b IN ('val','test')) AND split_a <> split_b AS cross_split FROM near_rows"""


def _near(spark, sf):
    df = derived(spark, sf, "recs")
    return df, neardupe.near_dupe_sequences(df)


@query("near_dupe_sequences", "SELECT * FROM near")
def near_dupe_sequences(spark, sf):
    return _near(spark, sf)[1]


@query(
    "near_dupe_pairs",
    "SELECT idx_a, idx_b, target_a, target_b, label_a, label_b, split_a, split_b, levenshtein_dist, cross_split FROM near_cross",
)
def near_dupe_pairs(spark, sf):
    return neardupe.near_dupe_pairs(*_near(spark, sf)).drop("seq_a", "seq_b")


@query(
    "pair_split_matrix",
    """SELECT least(split_a, split_b) AS split_low, greatest(split_a, split_b) AS split_high, levenshtein_dist, count(*) AS n FROM near_rows GROUP BY ALL""",
)
def pair_split_matrix(spark, sf):
    return neardupe.pair_matrix(*_near(spark, sf))


@query("cross_pairs_left", "SELECT count(*) FILTER (cross_split) AS cross_pairs FROM near_cross")
def cross_pairs_left(spark, sf):
    return neardupe.cross_left(*_near(spark, sf))


@query(
    "near_dupe_members",
    """SELECT aptamer_sequence AS seq, split, label, count(*) AS n FROM recs
       WHERE aptamer_sequence IN (SELECT seq_a FROM near UNION SELECT seq_b FROM near) GROUP BY ALL""",
)
def near_dupe_members(spark, sf):
    return neardupe.near_dupe_members(*_near(spark, sf))


# --- components and splits --------------------------------------------------

CHECKS["both_ways"] = "SELECT seq_a AS x, seq_b AS y FROM near UNION ALL SELECT seq_b, seq_a FROM near"
CHECKS["reach"] = """
  SELECT x AS node, x AS other FROM both_ways UNION SELECT r.node, b.y FROM reach r JOIN both_ways b ON b.x = r.other"""
CHECKS["comp"] = "SELECT node, min(other) AS component FROM reach GROUP BY node"


@query("connected_components", "SELECT node, component FROM comp", recursive=True)
def connected_components(spark, sf):
    return graph.connected_components(_near(spark, sf)[1], "seq_a", "seq_b")


CHECKS["step2"] = """
  SELECT r.row_id, r.aptamer_sequence AS seq, r.training_tier, CASE WHEN split = 'train' AND EXISTS (SELECT 1 FROM both_ways JOIN recs o ON o.aptamer_sequence = y WHERE x = r.aptamer_sequence AND o.split = 'test') THEN 'test' ELSE split END AS split FROM recs r"""
CHECKS["step3"] = """
  SELECT row_id, seq, CASE WHEN split = 'unassigned' AND training_tier = 2 THEN 'val' ELSE split END AS split FROM step2"""
CHECKS["free_edges"] = """
  SELECT x, y FROM both_ways WHERE x IN (SELECT seq FROM step3 WHERE split = 'unassigned') AND y IN (SELECT seq FROM step3 WHERE split = 'unassigned')"""
CHECKS["free_reach"] = """
  SELECT x AS node, x AS other FROM free_edges UNION SELECT r.node, b.y FROM free_reach r JOIN free_edges b ON b.x = r.other"""
# rows of a sequence without free neighbours are components of their own
CHECKS["free_comp"] = """
  SELECT s.row_id, s.seq, coalesce(c.component, concat('row ', s.row_id)) AS component FROM step3 s
  LEFT JOIN (SELECT node, min(other) AS component FROM free_reach GROUP BY node) c ON c.node = s.seq WHERE s.split = 'unassigned'"""
CHECKS["forced"] = """
  SELECT component, max(CASE WHEN o.split = 'test' THEN 2 WHEN o.split = 'val' THEN 1 ELSE 0 END) AS rank FROM free_comp f
  JOIN both_ways b ON b.x = f.seq JOIN step3 o ON o.seq = b.y GROUP BY component"""
CHECKS["step4"] = """
  SELECT s.row_id, s.seq, CASE WHEN s.split = 'unassigned' AND rank = 2 THEN 'test' WHEN s.split = 'unassigned' AND rank = 1 THEN 'val' ELSE s.split END AS split
  FROM step3 s LEFT JOIN free_comp f ON f.row_id = s.row_id LEFT JOIN forced g ON g.component = f.component"""
CHECKS["free_groups"] = """
  SELECT f.component, count(*) AS size, min(f.row_id) AS lead FROM free_comp f JOIN step4 s ON s.row_id = f.row_id WHERE s.split = 'unassigned' GROUP BY 1"""
CHECKS["queue"] = "SELECT component, size, row_number() OVER (ORDER BY size DESC, lead) AS pos FROM free_groups"
CHECKS["budget"] = """
  SELECT greatest(0, ceil(n * 0.8) - tr)::BIGINT AS b_train, greatest(0, ceil(n * 0.1) - va)::BIGINT AS b_val, greatest(0, n - ceil(n * 0.8) - ceil(n * 0.1) - te)::BIGINT AS b_test
  FROM (SELECT count(*) AS n, count(*) FILTER (split = 'train') AS tr, count(*) FILTER (split = 'val') AS va, count(*) FILTER (split = 'test') AS te FROM step4) x"""
CHECKS["greedy"] = """
  SELECT 0::BIGINT AS pos, b_train AS t, b_val AS v, b_test AS e, '' AS pick FROM budget
  UNION ALL
  SELECT q.pos, g.t - CASE WHEN p.pick = 'train' THEN size ELSE 0 END, g.v - CASE WHEN p.pick = 'val' THEN size ELSE 0 END, g.e - CASE WHEN p.pick = 'test' THEN size ELSE 0 END, p.pick
  FROM greedy g JOIN queue q ON q.pos = g.pos + 1,
    LATERAL (SELECT CASE WHEN g.v >= q.size THEN 'val' WHEN g.e >= q.size THEN 'test' WHEN g.t >= q.size THEN 'train'
      WHEN g.t >= g.v AND g.t >= g.e THEN 'train' WHEN g.v >= g.e THEN 'val' ELSE 'test' END AS pick) p"""
CHECKS["step5"] = """
  SELECT s.row_id, s.seq, CASE WHEN s.split = 'unassigned' THEN g.pick ELSE s.split END AS split FROM step4 s LEFT JOIN free_comp f ON f.row_id = s.row_id
  LEFT JOIN queue q ON q.component = f.component LEFT JOIN greedy g ON g.pos = q.pos"""
CHECKS["step6"] = """
  SELECT s.row_id, s.seq, CASE WHEN m.rank = 2 THEN 'test' WHEN m.rank = 1 THEN 'val' ELSE s.split END AS split FROM step5 s LEFT JOIN comp c ON c.node = s.seq
  LEFT JOIN (SELECT component, max(CASE WHEN split = 'test' THEN 2 WHEN split = 'val' THEN 1 ELSE 0 END) AS rank FROM step5 JOIN comp ON node = seq GROUP BY component) m ON m.component = c.component"""


@query("fix_cross_pairs", "SELECT row_id, split FROM step2")
def fix_cross_pairs(spark, sf):
    return splits.fix_cross(*_near(spark, sf)).select("row_id", "split")


@query(
    "tier_to_val",
    "SELECT row_id, CASE WHEN split = 'unassigned' AND training_tier = 2 THEN 'val' ELSE split END AS split FROM recs",
)
def tier_to_val(spark, sf):
    return splits.tier_to_val(derived(spark, sf, "recs")).select("row_id", "split")


def _step3(spark, sf):
    df, near = _near(spark, sf)
    return splits.durable(splits.tier_to_val(splits.fix_cross(df, near))), near


@query("forced_split", "SELECT row_id, split FROM step4", recursive=True)
def forced_split(spark, sf):
    rows, near = _step3(spark, sf)
    comps = splits.unassigned_components(rows, near)
    return splits.forced_split(rows, near, comps).select("row_id", "split")


@query("budget_assign", "SELECT row_id, split FROM step5", recursive=True)
def budget_assign(spark, sf):
    rows, near = _step3(spark, sf)
    comps = splits.unassigned_components(rows, near)
    rows = splits.durable(splits.forced_split(rows, near, comps))
    return splits.budget_assign(rows, comps).select("row_id", "split")


@query("convergence_pass", "SELECT row_id, split FROM step6", recursive=True)
def convergence_pass(spark, sf):
    df, near = _near(spark, sf)
    return splits.assign_splits(df, near).select("row_id", "split")


@query(
    "verify_no_cross",
    """SELECT count(*) FILTER ((a.split IN ('val','test') OR b.split IN ('val','test')) AND a.split <> b.split) AS cross_pairs
       FROM near JOIN step6 a ON a.seq = seq_a JOIN step6 b ON b.seq = seq_b""",
    recursive=True,
)
def verify_no_cross(spark, sf):
    """Fails unless the assigned splits keep near-duplicates together."""
    df, near = _near(spark, sf)
    return neardupe.verify_no_cross(splits.durable(splits.assign_splits(df, near)), near)


@query(
    "family_split",
    """SELECT row_id, CASE WHEN p <= greatest(1, floor(n * 0.7)) THEN 'train' WHEN p <= greatest(1, floor(n * 0.7)) + greatest(1, floor(n * 0.15)) THEN 'val' ELSE 'test' END AS family_split
       FROM records JOIN (SELECT target_name, row_number() OVER (ORDER BY md5(concat('42|', target_name)), target_name) AS p, count(*) OVER () AS n FROM (SELECT DISTINCT target_name FROM records) d) o USING (target_name)""",
)
def family_split(spark, sf):
    return splits.family_split(derived(spark, sf, "records")).select("row_id", "family_split")


# --- augmentation -----------------------------------------------------------

_VALID = """length({0}) BETWEEN 20 AND 120 AND length(regexp_replace({0}, '[^GC]', '', 'g')) / length({0}) BETWEEN 0.2 AND 0.8"""
CHECKS["ready_rows"] = """
  SELECT * FROM recs WHERE protein_sequence IS NOT NULL AND target_type = 'protein'"""
CHECKS["held_rows"] = "SELECT * FROM ready_rows WHERE split IN ('val','test')"
CHECKS["train_rows"] = """
  SELECT * FROM ready_rows WHERE split NOT IN ('val','test') AND aptamer_sequence NOT IN (SELECT aptamer_sequence FROM held_rows)"""
CHECKS["shuffled"] = """
  SELECT row_id, string_agg(b, '' ORDER BY o, b) AS s FROM (SELECT row_id, substr(aptamer_sequence, CAST(i AS INT), 1) AS b, md5(concat('42|', row_id, '|', i)) AS o
    FROM (SELECT row_id, aptamer_sequence, unnest(range(1, length(aptamer_sequence) + 1)) AS i FROM train_rows WHERE label = 1) x) y GROUP BY row_id"""
CHECKS["ring"] = """
  SELECT target_name, row_number() OVER (ORDER BY target_name) - 1 AS pos, count(*) OVER () AS m FROM (SELECT DISTINCT target_name FROM train_rows) d"""
CHECKS["partners"] = """
  SELECT t.row_id, t.aptamer_sequence, o.target_name FROM train_rows t JOIN ring r ON r.target_name = t.target_name
  JOIN ring o ON o.pos = (r.pos + 1 + CAST('0x' || substr(md5(concat('42|', t.row_id)), 1, 8) AS BIGINT) % (r.m - 1)) % r.m WHERE t.label = 1"""
CHECKS["made"] = f"""
  SELECT row_id, aptamer_sequence, target_name, label, CAST(NULL AS VARCHAR) AS aug_method, 0 AS gen FROM train_rows
  UNION ALL SELECT row_id, s, target_name, 0, 'rev_comp', 1 FROM (SELECT *, reverse(translate(aptamer_sequence, 'ACGT', 'TGCA')) AS s FROM train_rows WHERE label = 1) x WHERE {_VALID.format('s')}
  UNION ALL SELECT row_id, s, target_name, 1, 'trunc_L2', 2 FROM (SELECT *, substr(aptamer_sequence, 3) AS s FROM train_rows WHERE label = 1) x WHERE {_VALID.format('s')}
  UNION ALL SELECT row_id, s, target_name, 1, 'trunc_R2', 3 FROM (SELECT *, substr(aptamer_sequence, 1, length(aptamer_sequence) - 2) AS s FROM train_rows WHERE label = 1) x WHERE {_VALID.format('s')}
  UNION ALL SELECT row_id, s, target_name, 1, 'trunc_L3', 4 FROM (SELECT *, substr(aptamer_sequence, 4) AS s FROM train_rows WHERE label = 1) x WHERE {_VALID.format('s')}
  UNION ALL SELECT row_id, s, target_name, 1, 'trunc_R3', 5 FROM (SELECT *, substr(aptamer_sequence, 1, length(aptamer_sequence) - 3) AS s FROM train_rows WHERE label = 1) x WHERE {_VALID.format('s')}
  UNION ALL SELECT row_id, aptamer_sequence, target_name, 0, 'cross_neg', 6 FROM partners
  UNION ALL SELECT t.row_id, s, target_name, 0, 'scrambled', 7 FROM train_rows t JOIN shuffled h ON h.row_id = t.row_id WHERE {_VALID.format('s')}"""


@query(
    "augment_train",
    """SELECT row_id, aptamer_sequence, target_name, CAST(label AS INTEGER) AS label, aug_method FROM
         (SELECT * FROM made QUALIFY row_number() OVER (PARTITION BY aptamer_sequence, target_name ORDER BY gen, row_id) = 1) u
       WHERE aptamer_sequence NOT IN (SELECT aptamer_sequence FROM held_rows)""",
)
def augment_train(spark, sf):
    rows, _ = augment.augment_train(derived(spark, sf, "recs"))
    return rows.select("row_id", "aptamer_sequence", "target_name", "label", "aug_method")


@query(
    "augment_dedup",
    "SELECT row_id, aug_method FROM (SELECT * FROM made WHERE gen <> 6 QUALIFY row_number() OVER (PARTITION BY aptamer_sequence, target_name ORDER BY gen, row_id) = 1) u",
)
def augment_dedup(spark, sf):
    train = _train_rows(spark, sf)
    return augment.augment_rows(train, cross_neg=False).select("row_id", "aug_method")


def _train_rows(spark, sf):
    from strandloom.operators import mapping

    ready = mapping.training_ready(derived(spark, sf, "recs"), "augment")
    return audit.holdout_guard(ready).where(~F.col("split").isin("val", "test"))


@query("cross_target_negative", "SELECT row_id, target_name FROM partners")
def cross_target_negative(spark, sf):
    base = _train_rows(spark, sf).withColumn("augmented", F.lit(False)).withColumn(
        "aug_method", F.lit(None).cast("string")
    )
    return augment.cross_negatives(base).select("row_id", "target_name")


# --- sampling ---------------------------------------------------------------


@query("random_sample", "SELECT row_id FROM records ORDER BY md5(concat('42|', row_id)), row_id LIMIT 200")
def random_sample(spark, sf):
    return sampling.sample_n(derived(spark, sf, "records"), 200).select("row_id")


@query(
    "stratified_pick",
    "SELECT row_id, label FROM records QUALIFY row_number() OVER (PARTITION BY label ORDER BY md5(concat('42|', row_id)), row_id) <= 40",
)
def stratified_pick(spark, sf):
    return sampling.pick_per_class(derived(spark, sf, "records"), 40).select("row_id", "label")


@query(
    "balanced_sample",
    """WITH ranked AS (SELECT row_id, label, row_number() OVER (PARTITION BY label ORDER BY row_id) AS r, count(*) OVER (PARTITION BY label) AS c FROM records),
         draws AS (SELECT i AS draw, CAST('0x' || substr(md5(concat('42|class|', i)), 1, 15) AS BIGINT) % 2 AS k, CAST('0x' || substr(md5(concat('42|rank|', i)), 1, 15) AS BIGINT) AS u
           FROM range((SELECT count(*) FROM records)) t(i))
       SELECT draw, row_id, label FROM draws JOIN ranked ON label = k AND r = u % c + 1""",
)
def balanced_sample(spark, sf):
    df = derived(spark, sf, "records")
    return sampling.balanced_sample(df, df.count()).select("draw", "row_id", "label")


# --- features ---------------------------------------------------------------


@query(
    "cache_missing",
    "SELECT DISTINCT upper(trim(sequence)) AS sequence FROM legacy WHERE sequence IS NOT NULL AND upper(trim(sequence)) NOT IN (SELECT sequence FROM feature_cache)",
)
def cache_missing(spark, sf):
    return features.cache_missing(
        derived(spark, sf, "legacy"), derived(spark, sf, "feature_cache"), "sequence"
    )


@query(
    "attach_features",
    """SELECT row_id, coalesce(mfe, 0) AS mfe, coalesce(stem_count, 0)::DOUBLE AS stem_count, coalesce(loop_count, 0)::DOUBLE AS loop_count, coalesce(bp_prob_mean, 0) AS bp_prob_mean,
         coalesce(bp_prob_max, 0) AS bp_prob_max, CASE WHEN mfe IS NULL THEN 0 ELSE length(aptamer_sequence) / 120 END AS rel_length
       FROM records LEFT JOIN feature_cache ON sequence = aptamer_sequence""",
)
def attach_features(spark, sf):
    return features.attach_features(
        derived(spark, sf, "records"), derived(spark, sf, "feature_cache")
    ).select("row_id", "mfe", "stem_count", "loop_count", "bp_prob_mean", "bp_prob_max", "rel_length")


@query(
    "cache_coverage_guard",
    """SELECT split, count(*) AS n, count(*) FILTER (sequence IS NULL) AS missing, count(*) FILTER (sequence IS NULL) / count(*) AS missing_share
       FROM records LEFT JOIN feature_cache ON sequence = aptamer_sequence GROUP BY split""",
)
def cache_coverage_guard(spark, sf):
    return features.cache_coverage(derived(spark, sf, "records"), derived(spark, sf, "feature_cache"))


def hairpin_features(seq: str) -> dict:
    """A stand-in folding function: pairs mirrored complementary ends."""
    pair = {"A": "T", "T": "A", "G": "C", "C": "G"}
    arm = 0
    while arm < len(seq) // 2 - 1 and pair.get(seq[arm]) == seq[-1 - arm]:
        arm += 1
    structure = "(" * arm + "." * (len(seq) - 2 * arm) + ")" * arm
    return {"structure": structure, "stem_count": int(arm > 0), "loop_count": int(arm > 0), "mfe": 0.0 - 1.5 * arm}


@query(
    "feature_cache_update",
    """WITH missing AS (SELECT DISTINCT upper(trim(aptamer_sequence)) AS s FROM records WHERE aptamer_sequence IS NOT NULL
           EXCEPT SELECT sequence FROM feature_cache),
         folded AS (SELECT s, least(coalesce(list_min(list_filter(range(1, length(s) + 1), lambda i: substr(s, i, 1) <> substr(r, i, 1))) - 1, length(s)),
             greatest(length(s) // 2 - 1, 0)) AS arm FROM (SELECT s, reverse(translate(s, 'ATGC', 'TACG')) AS r FROM missing) x)
       SELECT s AS sequence, concat(repeat('(', arm), repeat('.', length(s) - 2 * arm), repeat(')', arm)) AS structure, CAST(0.0 - 1.5 * arm AS DOUBLE) AS mfe,
         CAST(arm > 0 AS INTEGER) AS stem_count, CAST(arm > 0 AS INTEGER) AS loop_count FROM folded""",
)
def feature_cache_update(spark, sf):
    """The rows that the cache has gained; the second run adds nothing."""
    path = scratch(spark)
    cache = derived(spark, sf, "feature_cache")
    features.empty_like(cache).write.parquet(path)
    for _ in range(2):
        features.append_cache(derived(spark, sf, "records"), path, hairpin_features)
    return spark.read.parquet(path).where("structure IS NOT NULL").select(
        "sequence", "structure", "mfe", "stem_count", "loop_count"
    )


# --- metrics ----------------------------------------------------------------

CHECKS["conf"] = """
  SELECT count(*) FILTER (y_prob >= 0.5 AND y_true = 1) AS tp, count(*) FILTER (y_prob >= 0.5 AND y_true = 0) AS fp, count(*) FILTER (y_prob < 0.5 AND y_true = 1) AS fn,
    count(*) FILTER (y_prob < 0.5 AND y_true = 0) AS tn FROM predictions"""


@query("confusion", "SELECT tp, fp, fn, tn FROM conf")
def confusion(spark, sf):
    return metrics.confusion(derived(spark, sf, "predictions"))


@query(
    "mcc_sens_spec",
    """SELECT false AS mcc_degenerate, round((tp::DOUBLE * tn - fp::DOUBLE * fn) / (sqrt((tp + fp)::DOUBLE) * sqrt((tp + fn)::DOUBLE) * sqrt((tn + fp)::DOUBLE) * sqrt((tn + fn)::DOUBLE)), 9) AS mcc,
         round(tp / (tp + fn), 9) AS sensitivity, round(tn / (tn + fp), 9) AS specificity FROM conf""",
)
def mcc_sens_spec(spark, sf):
    m = metrics.threshold_metrics(derived(spark, sf, "predictions"))
    return m.select("mcc_degenerate", *[F.round(c, 9).alias(c) for c in ("mcc", "sensitivity", "specificity")])


CHECKS["scores"] = """
  SELECT y_prob, count(*) FILTER (y_true = 1) AS p, count(*) FILTER (y_true = 0) AS n FROM predictions GROUP BY 1"""
CHECKS["curve"] = """
  SELECT *, sum(p) OVER (ORDER BY y_prob DESC) AS cp, sum(n) OVER (ORDER BY y_prob DESC) AS cn, sum(p) OVER () AS tp, sum(n) OVER () AS tn FROM scores"""


@query("auroc", "SELECT round(sum(n * (cp - p + p / 2)) / (any_value(tp)::DOUBLE * any_value(tn)), 9) AS auroc FROM curve")
def auroc(spark, sf):
    return metrics.auroc(derived(spark, sf, "predictions")).select(F.round("auroc", 9).alias("auroc"))


@query(
    "average_precision",
    "SELECT round(sum(p * (cp / (cp + cn))) / any_value(tp)::DOUBLE, 9) AS average_precision FROM curve",
)
def average_precision(spark, sf):
    return metrics.average_precision(derived(spark, sf, "predictions")).select(
        F.round("average_precision", 9).alias("average_precision")
    )


@query(
    "pearson_masked",
    """WITH found AS (SELECT count(*) AS n, corr(kd_true, kd_pred) AS r FROM predictions WHERE kd_true IS NOT NULL AND kd_pred IS NOT NULL),
         grid AS (SELECT i, CASE WHEN i IN (0, 200000) THEN 0.5 ELSE 1.0 END AS w, asin(abs(r)) AS t, n, r FROM found, range(200001) g(i)),
         areas AS (SELECT any_value(n) AS n, any_value(r) AS r, sum(w * pow(cos(t + (pi() / 2 - t) * i / 200000), n - 3)) * (pi() / 2 - any_value(t)) AS tail,
           sum(w * pow(cos(pi() / 2 * i / 200000), n - 3)) * pi() / 2 AS whole FROM grid)
       SELECT n, round(r, 9) AS r, round(tail / whole, 6) AS p FROM areas""",
)
def pearson_masked(spark, sf):
    """The p of the checking SQL is the share of the density of r under independence beyond it, summed on a grid."""
    return metrics.pearson(derived(spark, sf, "predictions")).select("n", F.round("r", 9).alias("r"), F.round("p", 6).alias("p"))


@query(
    "weighted_bce_masked_mse",
    """SELECT round(avg(b), 9) AS bce, round(avg(e), 9) AS mse, round(avg(b) + 0.5 * avg(e), 9) AS loss FROM
         (SELECT CASE WHEN y_true = 1 THEN -greatest(CASE WHEN y_prob > 0 THEN ln(y_prob) ELSE -100 END, -100) ELSE -3 * greatest(CASE WHEN y_prob < 1 THEN ln(1 - y_prob) ELSE -100 END, -100) END AS b,
            (kd_pred - kd_true) * (kd_pred - kd_true) AS e FROM predictions) x""",
)
def weighted_bce_masked_mse(spark, sf):
    m = metrics.loss_metrics(derived(spark, sf, "predictions"), negative_weight=3.0)
    return m.select(*[F.round(c, 9).alias(c) for c in ("bce", "mse", "loss")])



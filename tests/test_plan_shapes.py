"""Plans: exploded sides are not gathered in the driver, wide rows not shuffled without need."""

import re
from collections import Counter

import duckdb
from pyspark.sql import functions as F

from strandloom.operators import enrich, neardupe, skew
from strandloom.queries import derived, docs
from strandloom.queries.registry import ORACLES
from strandloom.session import durable


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_near_duplicate_keys_are_not_broadcast(spark):
    pool = durable(spark.range(200).select(F.md5(F.col("id").cast("string")).alias("seq")))
    left = neardupe._index_keys(pool, 4).select("bkey", F.col("seq").alias("x"))
    right = neardupe._probe_keys(pool, 4).select("bkey", F.col("seq").alias("y"))
    plan = _plan(neardupe._meet(left, right))
    assert "BroadcastExchange" not in plan and "SortMergeJoin" in plan


def test_near_duplicates_of_a_small_pool_are_found_without_broadcast(spark, monkeypatch):
    df = spark.sql("SELECT explode(array('ACGTACGTACGTACGTACGT', 'ACGTACGTACGTACGTACGA', 'TTTTTTTTTTCCCCCCCCCC')) AS aptamer_sequence")
    plans = []

    def watched(frame):
        plans.append(_plan(frame))
        return durable(frame)

    monkeypatch.setattr(neardupe, "durable", watched)
    found = neardupe.near_dupe_sequences(df).collect()
    assert [tuple(r) for r in found] == [("ACGTACGTACGTACGTACGA", "ACGTACGTACGTACGTACGT", 1)]
    assert "BroadcastHashJoin" not in plans[-1]


def test_derived_tables_shuffle_the_narrow_columns(spark, tmp_path):
    spark.range(40).selectExpr("id AS o_orderkey", "id AS o_custkey", "CAST(id AS DOUBLE) AS o_totalprice", "repeat('x', 50) AS o_orderpriority").write.parquet(f"{tmp_path}/orders.parquet")
    made = derived._made(spark, str(tmp_path), "legacy")
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Repartition") == 1 and plan.index("md5(") < plan.index("Repartition")
    assert "o_orderpriority" not in plan[plan.index("Repartition"):].split("Relation")[0]
    assert made.count() == 40


def test_a_stream_lands_in_as_many_files_as_its_rows_have_partitions(spark, tmp_path):
    rows = spark.range(0, 6000, 1, 12).withColumnRenamed("id", "row_id")
    docs._two_triggers(rows, "row_id", f"{tmp_path}/in")
    files = sorted((tmp_path / "in").glob("*.parquet"), key=lambda f: f.stat().st_mtime_ns)
    assert len(files) == 24
    spans = [spark.read.parquet(str(f)).selectExpr("min(row_id)", "max(row_id)", "count(*)").first() for f in files]
    assert sum(s[2] for s in spans) == 6000 and max(s[2] for s in spans) < 600
    assert max(s[1] for s in spans[:12]) < min(s[0] for s in spans[12:])


def test_plain_words_come_before_patterns(spark):
    """Assays and buffers are looked for by plain words first, and found as by the patterns alone."""
    from strandloom import fixed_values as fv
    from strandloom.functions import extract

    said = [
        "by CE-SELEX", "capillary  electrophoresis selection", "micro-fluidic aptamer", "whole-cell SELEX", "Cell-Systematic", "capture SELEX",
        "TOGGLE selex", "magnetic particle selection", "bead-based SELEX", "MACS-SELEX", "SPR", "surface\tplasmon resonance", "biacore", "itc",
        "isothermal titration calorimetry", "emsa", "electrophoretic mobility shift", "Gel shift assay", "band shift assay", "MST",
        "microscale thermophoresis", "BLI", "biolayer interferometry", "bio-layer interferometry", "Octet", "nitrocellulose filter",
        "filter binding assay", "membrane filter assay", "fluorescence polarization", "FA assay", "flow cytometry", "FACS screening", "SELEX",
        "systematic evolution of ligands", "ſelex", "ſPR and Biacore", "band ſhift assay", "PBſ", "buﬀer", "µ and flow cytometry",
        "PBS", "phosphate-buffered saline", "HEPES", "Tris-HCl", "selection buffer. Then Tris", "sodium phosphate", "any buffer", "none", "", None,
    ]
    df = spark.createDataFrame([(t,) for t in said], "text string")
    c = F.col("text")

    def plain(patterns):
        out = None
        for name, pattern in patterns:
            out = F.when(c.rlike("(?iU)" + pattern), name) if out is None else out.when(c.rlike("(?iU)" + pattern), name)
        return out

    got = df.select("text", extract.extract_assay(c).alias("a"), extract._buffer_of(c).alias("b"))
    want = df.select("text", F.coalesce(plain(fv.ASSAY_PATTERNS), F.lit("")), plain(fv.BUFFER_PATTERNS))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, map(tuple, want.collect())))
    assert set(extract.ASSAY_WORDS) == {n for n, _ in fv.ASSAY_PATTERNS} and set(extract.BUFFER_WORDS) == {n for n, _ in fv.BUFFER_PATTERNS}
    assert "Contains(" in _plan(df.select(extract.extract_assay(c)))


def test_table_cells_are_parsed_once(spark):
    """The pattern of affinities is tried twice for a cell, for its value and its unit, and once where no header names a column."""
    from strandloom.plans import harvest

    docs_ = spark.sql("SELECT 1 AS doc_id, '' AS fallback_target, array(struct('' AS label, '' AS caption, array(array('a')) AS rows)) AS tables FROM range(3)")
    plan = harvest.table_hits(docs_)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("(pM|nM|[µu]M|mM)\\b") == 3


def test_sequences_of_cells_are_those_of_the_text(spark):
    from strandloom.functions import extract

    good, poor = "ACGTTGCAAGCTTGCATCGA", "A" * 24
    cells = ["", None, good, good.lower(), f"5'-{good}-3'", f"{good} {good}", f"{poor} {good}", f"{good} {good.replace('T', 'U')}",
             " ".join(good[i:i + 5] for i in range(0, 20, 5)), good[:19], good.replace("T", "U"), f"x{good}", f"{good}, {good[::-1]}"]
    df = spark.createDataFrame(list(enumerate(cells)), "id int, s string")
    got = extract.sequence_rows(df, "s").orderBy("id", "hit_no").select("id", "sequence").collect()
    want = df.select("id", F.posexplode(extract.extract_sequences(F.col("s"))).alias("i", "h")).orderBy("id", "i").select("id", "h.sequence").collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in want] and len(want) >= 9


def test_columns_without_headers_are_still_found_by_their_cells(spark):
    from strandloom.plans import harvest

    good = "ACGTTGCAAGCTTGCATCGA"
    tables = [([["a", "b", "c"], [" ", "5 nM", good], ["y", "x", good]], (2, 1, None)),
              ([["sequence", "oligo", "Kd"], ["x", good, "1"], [good, good, "2"]], (1, 2, None)),
              ([["sequence", "oligo", "target"], [good, good, "1"]], (0, None, 2)), ([["a", "b"], ["1", "2"], [None, "4"]], (None, None, None))]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(tables)], "id int, rows array<array<string>>")
    got = harvest.detect_columns(df).orderBy("id").select("seq_col", "kd_col", "target_col").collect()
    assert [tuple(r) for r in got] == [w for _, w in tables]


def test_works_landed_twice_are_parsed_and_rebuilt_once(spark, tmp_path):
    """The index is made in the row, without a shuffle of words; of two arrivals only the first is rebuilt."""
    spark.sql("SELECT id AS doc_id, CASE id WHEN 0 THEN NULL WHEN 1 THEN ' ' WHEN 3 THEN 'b a  b\\nc' ELSE 'a' END AS text FROM range(5)").write.parquet(f"{tmp_path}/documents.parquet")
    out = docs.normalise_inverted_index(spark, str(tmp_path))
    assert [tuple(r) for r in out.select("source_id", "text").orderBy("source_id").collect()] == [("W3", "An aptamer\nb a b c"), ("W4", "A SELEX\na")]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [") == 1 and "Union" not in plan


def test_works_are_cut_at_the_blanks_of_the_sql(spark, tmp_path):
    """A vertical tab is part of a word there."""
    texts = ["a\x0bb c", "\x0b", " one\ttwo\r\ntwo\fone\x0b ", "x\u0085y \x1c \u00a0 z", '"q\\" {w}: [1]']
    docs_ = spark.createDataFrame([(3 * i, s) for i, s in enumerate(texts)], "doc_id bigint, text string")
    docs_.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = docs.normalise_inverted_index(spark, str(tmp_path)).select("source_id", "text", "doi", "url").collect()
    want = con.execute(ORACLES["normalise_inverted_index"]).fetchall()
    assert len(want) == len(texts) and sorted(map(tuple, got)) == sorted(want)


def test_interactions_are_dealt_by_their_number(spark, monkeypatch):
    aptamers = spark.createDataFrame(
        [("a1", "12-x", "acgt", None), ("a2", "y", "ggcc", "m"), ("a3", "z", None, None)], "id string, label string, sequence string, has_modification_details string")
    rows = [(i, f"a{k}", None, 1.0 * k) for i in range(40) for k in (1, 2, 2, 3)] + [(i, f"t{k}", f"T{k}", None) for i in range(40) for k in (1, 1, 2)] + [(None, "a1", None, 1.0), (None, "t1", "T1", None)]
    interactions = spark.createDataFrame(rows, "int int, has_participant string, participant_label string, dissociation_constant_value double")
    assert skew.parts_for(interactions) == 4 and skew.parts_for(interactions, 10) == 29
    monkeypatch.setattr(skew, "parts_for", lambda df: 7)
    want = {(i, a, t): n for i in range(40) for a, t, n in (("a1", "T1", 2), ("a1", "T2", 1), ("a2", "T1", 4), ("a2", "T2", 2))}
    for block in (100, 2):
        df = enrich.interaction_pairs(aptamers, interactions, block)
        assert df.columns == ["aptamer_uri", "int", "kd_molar", "target_name", "label", "has_modification_details", "sequence_clean", "pmid"]
        assert dict(Counter((r.int, r.aptamer_uri, r.target_name) for r in df.collect())) == want
    plan = _plan(df)
    dealt = re.findall(r"hashpartitioning\([^)]*, 7\), REPARTITION_BY_NUM", plan.split("Initial Plan")[0])
    assert len(dealt) >= 4, plan

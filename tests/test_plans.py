"""Plans of several steps: what they shuffle and what they say about doubled or hot inputs."""

import re

from strandloom import schemas
from strandloom.plans import clean, harvest
from strandloom.queries.derived import derived

SF = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_cleaned_rows_are_put_together_without_a_shuffle(spark):
    done = clean.clean(
        derived(spark, SF, "legacy"), derived(spark, SF, "old_splits"), derived(spark, SF, "compound_ids")
    )
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables of size
    try:
        plan = plan_of(done.rows.select("*"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert not re.search(r"Exchange (hash|range|Round|Single)", plan), plan
    assert plan.count("SortMergeJoin") == 2
    rows = done.rows.select("row_id").collect()
    assert len(rows) == len({r.row_id for r in rows}) > 500


def test_review_queue_writes_no_cleaned_rows(spark, monkeypatch):
    tables = [derived(spark, SF, n) for n in ("legacy", "old_splits", "compound_ids")]
    whole = clean.clean(*tables).review
    monkeypatch.setattr(clean, "bucketed", None)  # a call fails
    alone = clean.review(*tables)
    assert alone.columns == whole.columns and alone.count() == whole.count() > 20
    assert alone.exceptAll(whole).isEmpty()
    assert clean.review(*tables[:2]).where("phase = '5_pubchem'").isEmpty()
    monkeypatch.undo()
    from strandloom.queries import docs

    monkeypatch.setattr(docs.cleaning, "clean", None)
    assert docs.review_queue(spark, SF).count() == alone.count()


def test_curated_rows_take_proteins_by_id(spark):
    kept, gone = "ACGT" * 8, "ACGTT" * 5
    legacy = derived(spark, SF, "legacy").limit(0)
    some = spark.createDataFrame(
        [(1, kept, "VEGF", "P1", "MKVLLLLLLLLLL"), (2, kept[4:] + "AAAA", "Insulin", "P1", None), (3, "ACGU" * 8, "x", None, None)],
        "row_id long, sequence string, target_protein string, uniprot_id string, protein_sequence string")
    legacy = legacy.unionByName(some, allowMissingColumns=True)
    curated = spark.createDataFrame(
        [(1, kept.lower(), "vegf", "P1", "ssDNA"), (2, gone, "new", "P1", "ssDNA"), (3, "AC-GT", "bad", "P9", "ssDNA"), (4, None, None, None, None)],
        "row_id long, aptamer_sequence string, target_name string, target_id string, nucleic_acid_type string")
    splits = spark.createDataFrame(
        [(kept, "VEGF", "test", False)], "sequence string, target_protein string, split string, augmented boolean")
    done = clean.clean(legacy, splits, curated=curated)
    got = {(r.row_id, r.target_name): (r.split, r.protein_sequence, r.confidence_score == "uncertain") for r in done.rows.collect()}
    protein = "MKVLLLLLLLLLL"
    assert got[1, "VEGF"][:2] == ("test", protein) and got[2, "Insulin"][:2] == ("unassigned", protein)
    assert got[2, "new"][:2] == ("train", protein) and got[3, "bad"] == ("train", None, True)
    assert len(got) == 5 and (1, "vegf") not in got and (4, None) in got
    assert [(r.row_id, r.removal_reason) for r in done.removed.collect()] == [(3, "non_ssDNA_type")]
    assert {r.check for r in done.checks.collect()} >= {"null:target_name", "charset"}
    assert {r.priority: r.warning for r in done.coverage.collect()}["Insulin"] == "no val or test rows"


def documents(spark, rows):
    cell = "struct<label:string,caption:string,rows:array<array<string>>>"
    return spark.createDataFrame(
        rows, f"doc_id int, text string, target_name string, url string, doi string, source_type string, tables array<{cell}>")


DNA = ["GGTTGGTGTGGTTGGACGTA", "CCAACCTTGGAACCTTGGAC", "ATGCATGCATGCATGCATGCATGC"]


def test_documents_landed_twice_and_without_tables(spark):
    table = ("T1", "", [["Sequence", "Kd (nM)"], [DNA[0], "5"], [DNA[0], ""]])
    full = (1, f"Kd = 7 nM. We saw 5'-{DNA[0]}-3' and 5'-{DNA[1]}-3'.", "VEGF", "u1", "d1", "paper", [table])
    plain = (2, f"Kd = 9 nM for 5'-{DNA[0]}-3'.", "IgE", "u2", "d2", "patent", None)
    bare = (3, None, "IgG", "u3", "d3", "paper", [table, ("T2", "", [["a"]])])
    more = spark.createDataFrame([(2, f"5'-{DNA[2]}-3'"), (2, f"5'-{DNA[0]}-3'"), (9, f"5'-{DNA[2]}-3'")], "doc_id int, text string")
    docs = documents(spark, [full, full, plain, bare, plain])
    rows = harvest.document_records(docs, more).collect()
    got = {(r.doc_id, r.aptamer_sequence, r.kd_value, r.source_doi, r.extraction_method.split(":")[0]) for r in rows}
    assert got == {
        (1, DNA[0], 5.0, "d1", "table"), (1, DNA[1], 7.0, "d1", "prime"), (2, DNA[0], 9.0, "d2", "prime"), (3, DNA[0], 5.0, "d3", "table"),
        (2, DNA[2], None, "d2", "prime"), (2, DNA[0], None, "d2", "prime")}
    assert len(rows) == 6
    assert harvest.records_from_tables(docs.withColumn("fallback_target", docs.target_name)).count() == 2


def test_python_runs_once_for_each_kind_of_text(spark):
    docs = documents(spark, [])
    nodes = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython")
    assert nodes(harvest.records_from_text(docs)) == 1
    assert nodes(harvest.document_records(docs)) == 2
    assert schemas.RAW_HITS.names == ["sequences", "affinities"]

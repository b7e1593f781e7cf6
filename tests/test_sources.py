"""Parsers, landed documents, sinks and streaming."""

import os

import pytest
from pyspark.sql import functions as F

from strandloom import schemas
from strandloom.operators import audit, canonical, enrich, features, mapping, validate
from strandloom.plans import harvest
from strandloom.sources import documents, landed, sinks, tables
from strandloom.streaming import ingest

DNA = ["GGTTGGTGTGGTTGGACGTA", "CCAACCTTGGAACCTTGGAC", "ATGCATGCATGCATGCATGCATGC"]


def record(i, seq, target, **kw):
    base = dict.fromkeys([f.name for f in schemas.RECORD])
    base.update(
        row_id=i, aptamer_sequence=seq, nucleic_acid_type="ssDNA", modifications="none",
        target_name=target, target_type="protein", confidence_score="extracted", split="train",
        source_type="paper",
    )
    base.update(kw)
    return base


def records(spark, rows):
    schema = "row_id bigint, " + ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schemas.RECORD)
    return spark.createDataFrame(rows, schema)


def test_page_parser(spark):
    html = (
        "<html><head><title> Hi </title><style>x{}</style></head><body><nav>menu</nav>"
        "<p>one<br>two</p><script>var a='<p>';</script><table><tr><th>A</th><td>b <b>c</b></td></tr></table>"
        "<div>tail &amp; end</div><!-- note --><footer>foot</footer></body></html>"
    )
    row = documents.parse_pages(spark.createDataFrame([(html,), (None,)], "html string")).collect()
    assert row[0].title == "Hi" and row[0].tables == [[["A", "b c"]]]
    assert [t.strip() for t in row[0].text.split("\n") if t.strip()] == ["Hi", "one", "two", "Ab c", "tail & end"]
    assert row[1].text == "" and row[1].tables == []
    native = documents.page_text_native(F.lit(html))
    assert "menu" not in spark.range(1).select(native).first()[0]


def test_article_parser_survives_broken_tail(spark):
    good = (
        '<article xmlns:xlink="http://www.w3.org/1999/xlink"><article-id pub-id-type="doi">10.1/a</article-id>'
        "<article-title>T <i>x</i></article-title><abstract><p>abs</p></abstract><body><p>body</p>"
        "<table-wrap><label>Table 1</label><caption>cap</caption><tr><td>a</td><td>b</td></tr></table-wrap>"
        '<fig><caption>fig</caption></fig><supplementary-material xlink:href="s.csv"/></body>'
    )
    df = spark.createDataFrame([(good + "</article>",), (good + "<open",), ("no xml",)], "xml string")
    a, b, c = documents.parse_articles(df).collect()
    assert a.full_text == "T x\n\nabs\n\nbody\n\n[Table 1] cap\na\tb\n\n\nfig" and a.doi == "10.1/a"
    assert a.parse_ok and a.error is None and b.parse_ok and b.full_text == a.full_text
    assert a.supplements == ["s.csv"] and not c.parse_ok


def test_delimited_parser(spark):
    body = f'id,probe,blank,data\n1,x,,{DNA[0]}\n,,,\n2,"y,z",,{DNA[1]}\n'
    row = documents.parse_delimited(spark.createDataFrame([(body,)], "body string")).first()
    assert row.header == ["id", "probe", "data"] and row.seq_columns == ["probe", "data"]
    assert row.rows == [["1", "x", DNA[0]], ["2", "y,z", DNA[1]]]


@pytest.mark.parametrize("href,want", [
    ("https://a.org/f.csv", "https://a.org/f.csv"), ("f.csv", "https://x.org/p/bin/f.csv"),
    ("/f.csv", "https://x.org/f.csv"), ("../f.csv", "https://x.org/p/f.csv"), ("./f.csv", "https://x.org/p/bin/f.csv"),
    ("//c.org/f.csv", "https://c.org/f.csv"),
])
def test_resolve_url(spark, href, want):
    got = spark.range(1).select(documents.resolve_url(F.lit(href), F.lit("https://x.org/p/bin/"))).first()[0]
    assert got == want


def test_supplement_limit_counts_parsed_files_only(spark):
    links = [(f"f{i}.csv", 10, i % 2 == 0) for i in range(20)] + [("z.zip", 1, True)]
    df = spark.createDataFrame(
        [(1, "https://x.org/", links)], "doc_id int, base_url string, hrefs array<struct<href:string,bytes:bigint,ok:boolean>>"
    )
    got = documents.select_supplements(df, keep=8).orderBy("pos").collect()
    assert [r.url for r in got] == [f"https://x.org/f{i}.csv" for i in range(0, 16, 2)]
    every = documents.select_supplements(df).orderBy("pos").collect()
    assert [r.url for r in every] == [f"https://x.org/f{i}.csv" for i in range(0, 20, 2)]


def test_inverted_index_later_word_wins(spark):
    value = '{"id":"W1","title":"An aptamer","doi":"10.1/x","abstract_inverted_index":{"b":[1],"a":[0,2],"c":[1]}}'
    df = spark.createDataFrame([(1, value), (2, value.replace("An aptamer", "SELEX"))], "ord bigint, value string")
    row, = landed.from_openalex(df).collect()
    assert row.text == "An aptamer\na c a" and row.url == "https://doi.org/10.1/x"


def test_bad_json_gives_no_rows(spark):
    df = spark.createDataFrame([(1, "{broken"), (2, "{}")], "ord bigint, value string")
    assert landed.from_preprint(df).count() == 0 and landed.from_biblio(df).count() == 0


def test_table_columns_and_header_unit(spark):
    rows = [["Name", "Data", "Kd (µM)", "Protein"], ["a", DNA[0], "2.5", "VEGF"], ["b", DNA[1], ">3 nM", "n/a"],
            ["c", "none", "1", "x"], ["d", DNA[0].lower(), "n.d.", "VEGF"]]
    docs = spark.createDataFrame(
        [(1, "Thrombin", "u", "d", "paper", [("Table 1", "", rows)])],
        "doc_id int, fallback_target string, url string, doi string, source_type string, "
        "tables array<struct<label:string,caption:string,rows:array<array<string>>>>",
    )
    got = {r.aptamer_sequence: r for r in harvest.records_from_tables(docs).collect()}
    assert set(got) == {DNA[0], DNA[1]}
    assert (got[DNA[0]].kd_value, got[DNA[0]].kd_unit, got[DNA[0]].target_name) == (2500.0, "µM", "VEGF")
    assert (got[DNA[1]].kd_value, got[DNA[1]].kd_unit, got[DNA[1]].target_name) == (3.0, "nM", "Thrombin")
    plain = harvest.records_from_tables(docs, faithful=True).where(F.col("aptamer_sequence") == DNA[0]).first()
    assert plain.kd_value == 2.5 and plain.kd_unit == "nM"


def test_text_records_store_a_legal_unit(spark):
    docs = spark.createDataFrame(
        [(1, f"The aptamer 5'-{DNA[0]}-3' has Kd = 2.3e-9 M in PBS at pH 7.4.", "VEGF", "u", "d", "paper"),
         (2, None, "VEGF", "u", "d", "paper"), (3, f"x {DNA[1]} y", "", "u", "d", "paper")],
        "doc_id int, text string, target_name string, url string, doi string, source_type string",
    )
    row, = harvest.records_from_text(docs).collect()
    assert (row.kd_value, row.kd_unit, row.ph, row.binding_buffer) == (2.3, "nM", 7.4, "PBS")
    prov = sinks.provenance_rows(harvest.records_from_text(docs)).first()
    assert prov.extraction_method == "prime" and prov.byte_offset == 15 and prov.extraction_timestamp.endswith("Z")


def test_record_contract(spark):
    rows = [
        record(1, DNA[0], "VEGF"), record(2, "", "VEGF"), record(3, DNA[0], "VEGF", kd_value=5.0),
        record(4, DNA[0], "VEGF", kd_unit="nM"), record(5, DNA[0], "VEGF", kd_value=-1.0, kd_unit="nM"),
        record(6, DNA[0], "VEGF", ph=15.0), record(7, DNA[0], "VEGF", split="unassigned"),
        record(8, DNA[0], "VEGF", kd_value=5.0, kd_unit="µM", target_id_source="UniProt"),
    ]
    got = {r.row_id: r for r in validate.validate_record(records(spark, rows)).collect()}
    assert [i for i, r in got.items() if r.valid] == [1, 8]
    assert all(len(got[i].errors) == 1 for i in range(2, 8))


def test_append_unique(spark, tmp_path):
    master, out = str(tmp_path / "m"), str(tmp_path / "o")
    spark.createDataFrame([(DNA[0].lower(), " vegf ")], "sequence string, target_protein string").write.parquet(master)
    batch = records(spark, [
        record(1, DNA[0], "VEGF"), record(2, DNA[1], "VEGF"), record(3, DNA[1], "vegf "),
        record(4, DNA[2], "IgE"), record(5, "", "IgE"),
    ])
    first = sinks.append_unique(batch, master, out)
    assert first == {"incoming": 5, "valid": 4, "invalid": 1, "known_duplicates": 1, "batch_duplicates": 1, "new_rows": 2}
    again = sinks.append_unique(batch, master, out)
    assert again["new_rows"] == 0 and again["known_duplicates"] == 4
    assert spark.read.parquet(out).count() == 2
    with pytest.raises(ValueError):
        sinks.append_unique(batch, master, master)
    empty = str(tmp_path / "e")
    sinks.append_unique(batch.where("row_id = 1"), master, empty)
    assert spark.read.parquet(empty).count() == 0
    assert "new_rows" in sinks.report_text(first)


def test_contract_of_a_batch_is_checked_once(spark, tmp_path, monkeypatch):
    master, out = str(tmp_path / "m"), str(tmp_path / "o")
    known = spark.createDataFrame([(DNA[0], "VEGF"), (DNA[0], "vegf"), (None, None)], "sequence string, target_protein string")
    known.write.parquet(master)
    read = spark.sparkContext.accumulator(0)

    @F.udf("boolean")
    def counted(row):
        read.add(1)
        return row != 5

    def checked(df):
        return df.withColumn("valid", counted.asNondeterministic()(F.col("row_id")))

    monkeypatch.setattr(validate, "validate_record", checked)
    batch = records(spark, [
        record(1, DNA[0], "VEGF"), record(2, DNA[1], "VEGF"), record(3, DNA[1], "vegf "), record(4, DNA[2], "IgE"), record(5, "", "IgE"),
    ])
    first = sinks.append_unique(batch, master, out)
    assert read.value == 5
    assert first == {"incoming": 5, "valid": 4, "invalid": 1, "known_duplicates": 1, "batch_duplicates": 1, "new_rows": 2}
    assert sorted(r.aptamer_sequence for r in spark.read.parquet(out).collect()) == sorted(DNA[1:3])
    total = audit.batch_stats(batch, known).where("source_type = 'total'").first()
    assert read.value == 10
    assert {k: v for k, v in total.asDict().items() if k != "source_type"} == first


def test_read_table_variants(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text(",".join(f.name for f in schemas.LEGACY) + "\n" + "ACGT,VEGF,,,5.5,7.4,,,0,,1,,1,false,,true,utexas\n")
    typed = tables.read_table(spark, str(path)).first()
    assert typed.Kd_nM == 5.5 and typed.uniprot_id is None and typed.needs_sequence_enrichment is True
    as_text = tables.read_table(spark, str(path), as_text=True).first()
    assert as_text.Kd_nM == "5.5" and as_text.salt_mM is None
    assert tables.read_table(spark, str(path), blank=True).first().salt_mM == ""


def test_streaming_ingest_restarts_without_doubles(spark, tmp_path):
    src, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    master = spark.createDataFrame([(DNA[0], "vegf")], "sequence string, target_protein string")
    schema = records(spark, [record(1, DNA[0], "VEGF")]).schema
    stats, plans = [], []

    def run():
        stream = ingest.read_stream(spark, src, schema, files_per_trigger=1)
        query = ingest.ingest_records(stream, master, out, state)
        query.awaitTermination()
        stats.extend(ingest.trigger_stats(spark, query).where("source_type = 'total'").collect())
        plans.append(query._jsq.streamingQuery().explainInternal(False))
        return sorted(r.row_id for r in spark.read.parquet(out).collect())

    def land(*rows):
        records(spark, list(rows)).coalesce(1).write.mode("append").parquet(src)
        return run()

    assert land(record(1, DNA[0], "VEGF"), record(3, DNA[1], "vegf"), record(2, DNA[1], "VEGF"), record(4, "", "x")) == [2]
    assert land(record(5, DNA[1], "VEGF"), record(6, DNA[2], "IgE"), record(8, DNA[2], "ige")) == [2, 6]
    # a trigger whose commit is lost runs again, from the same state, into the same folder
    for f in sorted(os.listdir(f"{state}/commits")):
        if f.strip(".").startswith("1"):
            os.remove(f"{state}/commits/{f}")
    assert run() == [2, 6]
    assert land(record(7, DNA[2], "IgE"), record(9, DNA[0] + "AC", "IgE")) == [2, 6, 9]
    count = lambda r: (r.incoming, r.valid, r.invalid, r.known_duplicates, r.batch_duplicates, r.new_rows)
    assert [(r.batch_id, count(r)) for r in stats] == [
        (0, (4, 3, 1, 1, 1, 1)), (1, (3, 3, 0, 0, 2, 1)), (1, (3, 3, 0, 0, 2, 1)), (2, (2, 2, 0, 0, 1, 1))]
    assert all("StateStoreSave" in p and out not in p for p in plans)  # the sink is not read


def test_canonical_names_golden(spark):
    counts = {
        "(S)-ibuprofen": 2, "(s)-ibuprofen": 2, "Egg white lysozyme": 3, "egg white lysozyme": 3,
        "L-tyrosinamide": 3, "L-Tyrosinamide": 2, "Thrombin": 34, "THROMBIN": 5, "thrombin": 1,
        "nucleolin": 13, "Nucleolin": 4, "VEGF ": 1, "vegf": 1,
    }
    rows = [(n,) for n, k in counts.items() for _ in range(k)]
    log = {r.old_value: (r.new_value, r.rows_affected) for r in
           canonical.rename_log(spark.createDataFrame(rows, "target_name string")).collect()}
    assert log == {
        "(s)-ibuprofen": ("(S)-ibuprofen", 2), "egg white lysozyme": ("Egg white lysozyme", 3),
        "L-Tyrosinamide": ("L-tyrosinamide", 2), "THROMBIN": ("Thrombin", 5), "thrombin": ("Thrombin", 1),
        "Nucleolin": ("nucleolin", 4), "vegf": ("VEGF ", 1),
    }


def test_resolve_names_order(spark):
    proteins = spark.createDataFrame(
        [("A1", "VEGF", False, "S1"), ("A2", "VEGF", True, "S2"), ("A3", "serum albumin precursor", True, "S3"),
         ("A4", "thrombin light chain alpha", False, "S4")],
        "accession string, protein_name string, is_human boolean, protein_sequence string",
    )
    targets = spark.createDataFrame(
        [("vegf",), ("Human serum albumin",), ("the thrombin light chain beta",), ("Odd one",), ("nothing",)], "target_name string"
    )
    overrides = spark.createDataFrame([("odd one", "A4")], "name string, accession string")
    rows = enrich.resolve_names(targets, proteins.unionByName(proteins), overrides, block=2).collect()
    got = {r.target_name: (r.accession, r.strategy) for r in rows}
    assert len(rows) == 3 and got == {"vegf": ("A2", 1), "Human serum albumin": ("A3", 3), "Odd one": ("A4", 0)}


def test_feature_failure_gives_zeros_and_guard_raises(spark):
    df = spark.createDataFrame([(" acgt ", "train"), ("GGCC", "val")], "aptamer_sequence string, split string")
    cache = spark.createDataFrame([("GGCC", -1.0, "....", 1, 1, 0.5, 0.9)], schemas.STRUCTURE_FEATURES)

    def fold(s):
        raise RuntimeError("no fold")

    new, = features.update_cache(df, cache, fold).collect()
    assert (new.sequence, new.structure, new.mfe) == ("ACGT", "....", 0.0)
    with pytest.raises(ValueError):
        features.require_coverage(df, cache)
    features.require_coverage(df, cache.unionByName(features.update_cache(df, cache, fold)))


def test_merge_extra_and_schema_detection(spark):
    base = spark.createDataFrame([(DNA[0], "VEGF")], "aptamer_sequence string, target_name string")
    extra = spark.createDataFrame(
        [(DNA[1], "human insulin"), ("acgu", "insulin"), (DNA[2], "VEGF")], "aptamer_sequence string, target_name string"
    )
    got = enrich.merge_extra(base, extra, ["insulin"])
    assert sorted(r.aptamer_sequence for r in got.collect()) == sorted([DNA[0], DNA[1]])
    assert mapping.filter_targets(extra, []).count() == 0
    legacy = spark.createDataFrame([("A", "b")], "sequence string, target_protein string")
    assert mapping.canonicalise(legacy).columns == ["aptamer_sequence", "target_name"]

"""Values as they come: white space of all kinds, doubled lookups, links of any depth."""

from urllib.parse import urldefrag, urljoin

import pytest
from pyspark.sql import functions as F

from strandloom.functions.space import strip
from strandloom.operators import dedup, enrich, features, skew
from strandloom.sources import documents, landed


def test_strip_equals_python(spark):
    some = ["\t a \n", "\x1f b\x85", " c　", "", " ", "d\te", None, "​f"]
    got = spark.createDataFrame([(s,) for s in some], "s string").select(strip("s")).collect()
    assert [r[0] for r in got] == [s if s is None else s.strip() for s in some]


def test_tabs_do_not_make_a_new_sequence(spark):
    seq = "ACGTACGTACGTACGTACGTAC"
    new = spark.createDataFrame([(1, f"\t{seq}\n", "Insulin "), (2, seq, "insulin")],
                                "row_id long, aptamer_sequence string, target_name string")
    master = spark.createDataFrame([], "sequence string, target_protein string")
    unique, dups = dedup.dedup_against(new, master)
    assert [r.row_id for r in unique.collect()] == [1] and dups.count() == 1


def test_doubled_lookup_keys_double_no_row(spark):
    rows = spark.createDataFrame([(1, "AC", "ATP", "small_molecule", None, None)],
                                 "row_id long, aptamer_sequence string, target_name string, target_type string, "
                                 "target_id string, target_id_source string")
    ids = spark.createDataFrame([("ATP", "7"), ("ATP", "5")], "name string, cid string")
    filled, misses = enrich.resolve_compounds(rows, ids)
    assert [r.target_id for r in filled.collect()] == ["CID:5"] and misses.count() == 0
    cache = spark.createDataFrame([("AC", -1.0, 1, 1, 0.5, 0.5)] * 2,
                                  "sequence string, mfe double, stem_count int, loop_count int, bp_prob_mean double, bp_prob_max double")
    assert features.attach_features(rows, cache).count() == 1
    split = rows.withColumn("split", F.lit("train"))
    assert features.cache_coverage(split, cache).collect()[0][1] == 1


def test_first_row_of_any_column_type(spark):
    df = spark.createDataFrame([(2, "a", {"x": 1}), (1, "a", {"y": 2}), (3, None, {})], "row_id long, k string, m map<string,int>")
    got = skew.keep_first(df, [F.col("k")]).orderBy("row_id").collect()
    assert [(r.row_id, r.m) for r in got] == [(1, {"y": 2}), (3, {})]


BASES = ["http://h/a/b/c/d/e/f/", "https://h.org:8/x/y.html?q=1#f", "http://h", "http://h/one"]
LINKS = ["../../../../../x.csv", "x.csv", "./x.csv", "../x", "/x/../y/./z.pdf", "//other/p/../q", "?a=b", "#top", "", "..", ".",
         "a/./b/../c.txt?x=../y", "https://z/k/../m", "../../../../../../../../../up.csv", "dir/", "/"]


@pytest.mark.parametrize("base", BASES)
def test_links_resolve_as_in_the_standard(spark, base):
    df = spark.createDataFrame([(x, base) for x in LINKS], "h string, b string")
    got = [r[0] for r in df.select(documents.resolve_url(F.col("h"), F.col("b"))).collect()]
    want = [x if x.startswith("https:") else urljoin(base, x) for x in LINKS]
    # the standard library leaves dots in a link to another host alone, and keeps a fragment of the base for an empty link
    want = [("http" + ("s" if base.startswith("https") else "") + ":" + x) if x.startswith("//") else w for x, w in zip(LINKS, want)]
    want = [urldefrag(base)[0] if x == "" else w for x, w in zip(LINKS, want)]
    assert got == want


def test_no_supplement_is_lost(spark):
    links = [(f"s{i}.csv", i * 10_000_000, i != 3) for i in range(12)] + [("x.zip", 1, True)]
    df = spark.createDataFrame([(1, "http://h/a/", links)],
                               "id long, base_url string, hrefs array<struct<href: string, bytes: long, ok: boolean>>")
    assert [r.pos for r in documents.select_supplements(df).orderBy("pos").collect()] == list(range(11))
    refused = {r.url: r.reason for r in documents.refused_supplements(df, keep=2, max_bytes=50_000_000).collect()}
    assert refused["http://h/a/s3.csv"] == "unreadable" and refused["http://h/a/x.zip"] == "extension"
    assert refused["http://h/a/s9.csv"] == "size" and refused["http://h/a/s2.csv"] == "limit" and len(refused) == 11


def test_sequences_far_down_a_column_count(spark):
    body = "note,col\n" + "\n".join(["n,"] * 3 + ["n,words"] * 6 + ["n,ACGTACGTACGTACGTACGTACGT"] * 6)
    got = documents.parse_delimited(spark.createDataFrame([(body,)], "body string")).collect()[0]
    assert got.seq_columns == ["col"]


def test_papers_of_one_title_stay_apart_and_broken_xml_is_told(spark):
    hits = [(i, f'{{"title": "{"The same start of a title that is long enough"} {i}", "abstract": "aptamer"}}') for i in range(2)]
    assert landed.from_hits(spark.createDataFrame(hits, "ord long, value string")).count() == 2
    xml = [(1, "<MedlineCitation><PMID>5</PMID></MedlineCitation>"), (2, "<broken"), (3, None), (4, "<broken")]
    got = landed.from_citations(spark.createDataFrame(xml, "ord long, value string")).collect()
    assert sorted(r.error is not None for r in got) == [False, True, True, True]

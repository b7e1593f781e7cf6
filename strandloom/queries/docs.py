"""Queries of sources, parsing, extraction, sinks, streaming and the cleaning plan."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandloom import fixed_values as fv
from strandloom import schemas
from strandloom.functions import extract, text
from strandloom.functions.bind import bind, once
from strandloom.operators import audit, dedup, enrich, validate
from strandloom.plans import clean as cleaning
from strandloom.plans import harvest
from strandloom.queries.derived import derived, path_of, table
from strandloom.queries.registry import CHECKS, query, scratch
from strandloom.queries.groups import _PRIORITY_COUNTS
from strandloom.queries.rows import _CLEAN_KIND, _CONFIDENCE, _SOURCE_ID, _SOURCE_TYPE
from strandloom.queries.scalars import _FAULT
from strandloom.session import durable
from strandloom.sources import documents, landed, sinks, tables
from strandloom.streaming import ingest

# --- scans and sinks --------------------------------------------------------


@query(
    "read_table",
    "SELECT sequence, target_protein, Kd_nM, pH, buffer_type, label, augmented, source FROM legacy",
)
def read_table(spark, sf):
    path = scratch(spark)
    derived(spark, sf, "legacy").select(*fv.LEGACY_COLUMNS).write.csv(path, header=True, nullValue="")
    return tables.read_table(spark, path).select(
        "sequence", "target_protein", "Kd_nM", "pH", "buffer_type", "label", "augmented", "source"
    )


@query(
    "read_records_jsonl",
    "SELECT aptamer_sequence, target_name, kd_value, kd_unit, ph, split FROM records WHERE row_id % 10 <> 9",
)
def read_records_jsonl(spark, sf):
    path = scratch(spark)
    line = F.to_json(F.struct("aptamer_sequence", "target_name", "kd_value", "kd_unit", "ph", "split"))
    # every tenth line is cut in the middle and has to be skipped
    cut = F.when(F.col("row_id") % 10 == 9, F.substring(line, 1, 30)).otherwise(line)
    derived(spark, sf, "records").select(cut.alias("value")).write.text(path)
    return tables.read_records(spark, path).select(
        "aptamer_sequence", "target_name", "kd_value", "kd_unit", "ph", "split"
    )


@query("file_fingerprint", "SELECT page_id, sha256(html) AS source_file_hash FROM pages")
def file_fingerprint(spark, sf):
    df = table(spark, sf, "pages").select("page_id", F.col("html").cast("binary").alias("content"))
    return tables.fingerprint(df).drop("content")


@query(
    "write_provenance",
    """SELECT aptamer_sequence, target_name, concat('u', row_id) AS source_url, 'paper' AS source_type, 'prime' AS extraction_method, row_id AS byte_offset FROM records""",
)
def write_provenance(spark, sf):
    path = scratch(spark)
    rows = derived(spark, sf, "records").select(
        "aptamer_sequence", "target_name", F.concat(F.lit("u"), "row_id").alias("source_url"),
        F.lit("paper").alias("source_type"), F.lit("prime").alias("extraction_method"),
        F.col("row_id").alias("byte_offset"),
    )
    sinks.write_provenance(rows, path)
    return tables.read_provenance(spark, path).where("extraction_timestamp IS NOT NULL").select(
        "aptamer_sequence", "target_name", "source_url", "source_type", "extraction_method", "byte_offset"
    )


@query(
    "append_unique_sink",
    """SELECT t.aptamer_sequence, t.target_name, TRY_CAST(t.kd_value AS DOUBLE) AS kd_value FROM text_records t JOIN batch_fate b ON b.row_id = t.row_id WHERE b.n_errors = 0 AND NOT b.known AND b.rn = 1""",
)
def append_unique_sink(spark, sf):
    folder = scratch(spark)
    batch = derived(spark, sf, "text_records")
    for _ in range(2):  # the second run must add nothing
        sinks.append_unique(batch, path_of(spark, sf, "master"), f"{folder}/out")
    return spark.read.schema(schemas.RECORD).parquet(f"{folder}/out").select(
        "aptamer_sequence", "target_name", "kd_value"
    )


@query("write_splits", "SELECT row_id, split FROM records")
def write_splits(spark, sf):
    path = scratch(spark)
    sinks.write_splits(derived(spark, sf, "records").select("row_id", "split"), path)
    return spark.read.parquet(path).select("row_id", "split")


@query("phase_checkpoint", "SELECT row_id, target_name FROM records")
def phase_checkpoint(spark, sf):
    return sinks.phase_snapshot(
        derived(spark, sf, "records").select("row_id", "target_name"), scratch(spark), 1
    )


_STATS = ("incoming", "valid", "invalid", "known_duplicates", "batch_duplicates", "new_rows")


@query(
    "coverage_report",
    f"""WITH t AS (SELECT count(*) AS incoming, count(*) FILTER (n_errors = 0) AS valid, count(*) FILTER (n_errors > 0) AS invalid,
          count(*) FILTER (n_errors = 0 AND known) AS known_duplicates, count(*) FILTER (n_errors = 0 AND NOT known AND rn > 1) AS batch_duplicates,
          count(*) FILTER (n_errors = 0 AND NOT known AND rn = 1) AS new_rows FROM batch_fate)
        SELECT repeat('=', 55) AS value FROM range(3) UNION ALL SELECT 'Run summary' UNION ALL SELECT 'Run at <time> UTC'
        UNION ALL SELECT concat(rpad('source_type', 16, ' '), ' : total')
        {' '.join(f"UNION ALL SELECT concat(rpad('{c}', 16, ' '), ' : ', {c}) FROM t" for c in _STATS)}""",
)
def coverage_report(spark, sf):
    """One line of the report each; the time of the run is masked."""
    stats = audit.batch_stats(derived(spark, sf, "text_records"), derived(spark, sf, "master"))
    total = stats.where("source_type = 'total'").first()
    path = scratch(spark)
    sinks.write_report(spark, total.asDict(), path)
    lines = spark.read.text(path).where("value <> ''")
    return lines.select(F.regexp_replace("value", r"^Run at \d{4}-\d\d-\d\d \d\d:\d\d:\d\d UTC$", "Run at <time> UTC").alias("value"))


# --- plain parsing ----------------------------------------------------------


@query("parse_html_pages")
def parse_html_pages(spark, sf):
    return documents.parse_pages(table(spark, sf, "pages")).select(
        "page_id", "title", "text", F.size("tables").alias("n_tables")
    )


@query("parse_html_native")
def parse_html_native(spark, sf):
    return table(spark, sf, "pages").select(
        "page_id", documents.page_text_native(F.col("html")).alias("text")
    )


@query(
    "tables_to_text",
    """SELECT p_partkey, concat(CASE WHEN p_partkey % 3 = 0 THEN '[Table]' ELSE concat('[Table ', p_size, '] ', p_name) END, chr(10), 'name', chr(9), 'brand', chr(10), p_name, chr(9), p_brand, chr(10), chr(10),
         '[Table]', chr(10), p_type, chr(10)) AS body FROM part""",
)
def tables_to_text(spark, sf):
    named = F.col("p_partkey") % 3 != 0
    first = F.struct(
        F.when(named, F.concat(F.lit("Table "), "p_size")).otherwise("").alias("label"),
        F.when(named, F.col("p_name")).otherwise("").alias("caption"),
        F.array(F.array(F.lit("name"), F.lit("brand")), F.array("p_name", "p_brand")).alias("rows"),
    )
    second = F.struct(
        F.lit("").alias("label"), F.lit("").alias("caption"), F.array(F.array("p_type")).alias("rows")
    )
    return table(spark, sf, "part").select(
        "p_partkey", text.tables_to_text(F.array(first, second)).alias("body")
    )


@query(
    "parse_delimited_docs",
    """SELECT row_id, CASE WHEN row_id % 4 = 0 THEN 'oligo' WHEN length(aptamer_sequence) >= 20 THEN 'col a' ELSE '' END AS seq_columns,
         concat('=== Sheet: sheet1 ===', chr(10), h, chr(9), 'note', chr(10), aptamer_sequence, chr(9), 'a,b', chr(10), aptamer_sequence, chr(9), '') AS sheet_text
       FROM (SELECT *, CASE WHEN row_id % 4 = 0 THEN 'oligo' ELSE 'col a' END AS h FROM records) x""",
)
def parse_delimited_docs(spark, sf):
    head = F.when(F.col("row_id") % 4 == 0, "oligo").otherwise("col a")
    body = F.concat(
        head, F.lit(",empty,note\n"), "aptamer_sequence", F.lit(',,"a,b"\n,,\n'), "aptamer_sequence", F.lit(",,\n")
    )
    df = derived(spark, sf, "records").select("row_id", body.alias("body"))
    return documents.parse_delimited(df).select(
        "row_id", F.array_join("seq_columns", ",").alias("seq_columns"), "sheet_text"
    )


_EXT = "'.csv?v=1','.PDF','.zip','','.txt','.xlsx#s'"
CHECKS["links"] = f"""
  SELECT page_id, url, i, concat(h, [{_EXT}][(i - 1) % 6 + 1]) AS href, (i - 1) * 1000000 AS bytes, (i - 1) % 5 <> 4 AS ok
  FROM (SELECT page_id, url, unnest(list_concat(hs, hs, hs)) AS h, generate_subscripts(list_concat(hs, hs, hs), 1) AS i
    FROM (SELECT page_id, url, regexp_extract_all(html, 'href="([^"]*)"', 1) AS hs FROM pages) a) b"""


@query(
    "supplement_router",
    """SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS INTEGER) AS pos, concat(regexp_extract(url, '^(https?://[^/]*)', 1), href) AS url,
         lower(regexp_extract(regexp_replace(href, '[?#].*$', ''), '(\\.[^./]*)$', 1)) AS ext
       FROM links WHERE ok AND lower(regexp_extract(regexp_replace(href, '[?#].*$', ''), '(\\.[^./]*)$', 1)) IN ('.csv','.pdf','.txt','.xlsx')""",
)
def supplement_router(spark, sf):
    hrefs = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))
    thrice = F.concat(hrefs, hrefs, hrefs)
    ends = F.array(*[F.lit(e) for e in (".csv?v=1", ".PDF", ".zip", "", ".txt", ".xlsx#s")])
    made = F.transform(
        thrice,
        lambda h, i: F.struct(
            F.concat(h, F.get(ends, i % 6)).alias("href"), (i.cast("bigint") * 1000000).alias("bytes"),
            (i % 5 != 4).alias("ok"),
        ),
    )
    pages = table(spark, sf, "pages").select("page_id", F.col("url").alias("base_url"), made.alias("hrefs"))
    return documents.select_supplements(pages).select("page_id", "pos", "url", "ext")


def _article_xml():
    return F.concat(
        F.lit('<article xmlns:xlink="http://www.w3.org/1999/xlink"><front><article-id pub-id-type="doi">10.5/'),
        F.col("p_partkey"), F.lit("</article-id><article-title>On <i>"), "p_name",
        F.lit("</i> work</article-title><abstract><p>First "), "p_brand", F.lit(".</p><p>Second.</p></abstract></front><body><sec><title>Methods</title><p>Used "),
        "p_type", F.lit(' here.</p></sec><table-wrap><label>Table 1</label><caption>Hits</caption><table><tr><th>Sequence</th><th>Kd</th></tr><tr><td>'),
        "p_name", F.lit("</td><td>5 nM</td></tr></table></table-wrap><fig><caption>Figure text</caption></fig>"),
        F.lit('<supplementary-material xlink:href="s1.csv"/></body>'),
        F.when(F.col("p_partkey") % 10 == 3, "<broken").otherwise("</article>"),
    )


@query(
    "parse_article_xml",
    """SELECT p_partkey, concat('10.5/', p_partkey) AS doi, concat('On ', p_name, ' work') AS title, concat('First ', p_brand, '.', chr(10), 'Second.') AS abstract,
         concat('On ', p_name, ' work', chr(10), chr(10), 'First ', p_brand, '.', chr(10), 'Second.', chr(10), chr(10), 'Methods', chr(10), 'Used ', p_type, ' here.', chr(10), chr(10),
           '[Table 1] Hits', chr(10), 'Sequence', chr(9), 'Kd', chr(10), p_name, chr(9), '5 nM', chr(10), chr(10), chr(10), 'Figure text') AS full_text, 's1.csv' AS supplements, true AS parse_ok FROM part""",
)
def parse_article_xml(spark, sf):
    df = table(spark, sf, "part").select("p_partkey", _article_xml().alias("xml"))
    return documents.parse_articles(df).select(
        "p_partkey", "doi", "title", "abstract", "full_text",
        F.array_join("supplements", ",").alias("supplements"), "parse_ok",
    )


# --- landed JSON and XML ----------------------------------------------------


def _twice(df, key):
    """Every document lands twice; the later copy must not win."""
    again = F.struct(
        (F.col("ord") + 10_000_000_000).alias("ord"), F.replace("value", F.lit("An aptamer"), F.lit("An aptamer again")).alias("value")
    )
    made = once(df.withColumnRenamed("value", "_made"), "value", F.col("_made"))  # once for both copies
    return made.select(F.explode(F.array(F.struct(F.col("ord").cast("bigint").alias("ord"), "value"), again)).alias("d")).select("d.*")


def _json(*columns):
    return F.to_json(F.struct(*columns))


def _inverted(df, words):
    """Add ``m``, {word: [positions]} of an array of words, made in the row itself: words are sorted and cut where they change."""
    placed = F.sort_array(F.transform("_w", lambda w, i: F.struct(w.alias("w"), i.alias("at"))))
    a, last = F.col("_a"), F.size("_a")
    change = lambda i: (i == 0) | (F.get(a, i)["w"] != F.get(a, i - 1)["w"])
    starts = F.filter(F.sequence(F.lit(0), last - 1), change)
    entries = bind(starts, lambda s: F.transform(s, lambda b, k: F.struct(
        F.get(a, b)["w"].alias("key"),
        F.transform(F.sequence(b, F.coalesce(F.get(s, k + 1), last) - 1), lambda j: F.get(a, j)["at"]).alias("value"),
    )))
    x = once(df, "_w", words).where(F.size("_w") > 0).transform(once, "_a", placed)
    return once(x, "m", F.map_from_entries(entries)).select(*df.columns, "m")


_TITLE = "CASE {0} % 3 WHEN 0 THEN 'An aptamer' WHEN 1 THEN 'A SELEX' ELSE 'Other' END"


def _title(key):
    return F.expr(_TITLE.format(key))


@query(
    "normalise_inverted_index",
    f"""SELECT concat('W', doc_id) AS source_id, concat({_TITLE.format('doc_id')}, chr(10), array_to_string(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> ''), ' ')) AS text,
         CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN concat('10.1/', doc_id) ELSE concat('https://doi.org/10.1/', doc_id) END AS doi,
         CASE doc_id % 4 WHEN 0 THEN concat('W', doc_id) ELSE concat('https://doi.org/10.1/', doc_id) END AS url FROM documents WHERE doc_id % 3 <> 2""",
)
def normalise_inverted_index(spark, sf):
    words = F.array_remove(F.split("text", r"[ \t\n\f\r]+"), "")  # the blanks of the SQL's \s, without \v
    index = _inverted(table(spark, sf, "documents").select("doc_id", "text"), words)
    doi = F.expr(
        "CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN concat('10.1/', doc_id) ELSE concat('https://doi.org/10.1/', doc_id) END"
    )
    value = _json(
        F.concat(F.lit("W"), "doc_id").alias("id"), _title("doc_id").alias("title"), doi.alias("doi"),
        F.col("m").alias("abstract_inverted_index"),
    )
    works = index.select(F.col("doc_id").alias("ord"), value.alias("value"))
    return landed.from_openalex(_twice(works, "ord")).select("source_id", "text", "doi", "url")


@query(
    "normalise_citation_xml",
    """SELECT CAST(p_partkey AS VARCHAR) AS pmid, concat('On ', p_name) AS title, concat(p_brand, ' ', p_type) AS abstract,
         CASE WHEN p_partkey % 2 = 0 THEN '2010' ELSE '1999' END AS year, FALSE AS broken FROM part
       UNION ALL SELECT NULL, NULL, NULL, NULL, TRUE FROM part WHERE p_partkey % 10 = 3""",
)
def normalise_citation_xml(spark, sf):
    date = F.when(F.col("p_partkey") % 2 == 0, "<Year>2010</Year>").otherwise("<MedlineDate>1999 Jan-Feb</MedlineDate>")
    value = F.concat(
        F.lit("<PubmedArticle><MedlineCitation><PMID>"), "p_partkey",
        F.lit("</PMID><Article><Journal><JournalIssue><PubDate>"), date,
        F.lit("</PubDate></JournalIssue></Journal><ArticleTitle>On "), "p_name",
        F.lit("</ArticleTitle><Abstract><AbstractText>"), "p_brand", F.lit("</AbstractText><AbstractText>"),
        "p_type", F.lit("</AbstractText></Abstract></Article></MedlineCitation></PubmedArticle>"),
    )
    df = table(spark, sf, "part").select(F.col("p_partkey").alias("ord"), value.alias("value"))
    broken = table(spark, sf, "part").where("p_partkey % 10 = 3").select(
        (-F.col("p_partkey")).alias("ord"), F.lit("<PubmedArticle><MedlineCitation>").alias("value")
    )
    return landed.from_citations(_twice(df, "ord").unionByName(broken)).select(
        "pmid", "title", "abstract", "year", F.col("error").isNotNull().alias("broken")
    )


@query(
    "id_crosswalk",
    """SELECT o_orderkey AS pmid, concat('PMC', CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey * 5 ELSE o_orderkey * 3 END) AS pmcid FROM orders WHERE o_orderkey % 4 <> 3""",
)
def id_crosswalk(spark, sf):
    link = lambda db, f: F.struct(db.alias("db_to"), (F.col("o_orderkey") * f).cast("string").alias("id"))
    pmc = F.when(F.col("o_orderkey") % 4 != 3, "pmc").otherwise("omim")
    first = F.when(F.col("o_orderkey") % 3 == 0, "pubmed").otherwise(pmc)
    df = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("pmid"), F.array(link(first, 3), link(pmc, 5), link(pmc, 7)).alias("links")
    )
    return landed.crosswalk(df)


def _part(spark, sf, *columns):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("ord"), _json(*columns).alias("value"))


@query(
    "normalise_paper_search",
    f"""SELECT concat('p', p_partkey) AS source_id, concat({_TITLE.format('p_partkey')}, chr(10), CASE WHEN p_partkey % 5 <> 0 THEN p_name ELSE '' END) AS text,
         CASE WHEN p_partkey % 4 = 0 THEN '' ELSE concat('10.2/', p_partkey) END AS doi,
         CASE WHEN p_partkey % 4 = 0 THEN concat('https://www.semanticscholar.org/paper/p', p_partkey) ELSE concat('https://doi.org/10.2/', p_partkey) END AS url FROM part""",
)
def normalise_paper_search(spark, sf):
    doi = F.when(F.col("p_partkey") % 4 != 0, F.concat(F.lit("10.2/"), "p_partkey"))
    df = _part(
        spark, sf, F.concat(F.lit("p"), "p_partkey").alias("paperId"), _title("p_partkey").alias("title"),
        F.when(F.col("p_partkey") % 5 != 0, F.col("p_name")).alias("abstract"),
        F.struct(doi.alias("DOI")).alias("externalIds"),
    )
    return landed.from_paper_search(_twice(df, "ord")).select("source_id", "text", "doi", "url")


@query(
    "normalise_preprint",
    f"""SELECT concat('10.3/', p_partkey) AS doi, concat({_TITLE.format('p_partkey')}, chr(10), p_name) AS text, concat('https://www.biorxiv.org/content/10.3/', p_partkey) AS url
        FROM part WHERE p_partkey % 3 <> 2 AND p_size % 2 = 0""",
)
def normalise_preprint(spark, sf):
    kind = F.when(F.col("p_size") % 2 == 0, "Molecular Biology").otherwise("ecology")
    df = _part(
        spark, sf, kind.alias("category"), _title("p_partkey").alias("title"), F.col("p_name").alias("abstract"),
        F.concat(F.lit("10.3/"), "p_partkey").alias("doi"),
    )
    return landed.from_preprint(df).select("doi", "text", "url")


@query(
    "normalise_patent_json",
    f"""SELECT CAST(p_partkey AS VARCHAR) AS source_id, concat({_TITLE.format('p_partkey')}, chr(10), p_name) AS text, concat('US', p_partkey) AS doi,
         concat('https://patents.google.com/patent/US', p_partkey) AS url FROM part""",
)
def normalise_patent_json(spark, sf):
    number = F.col("p_partkey").cast("string")
    df = _part(
        spark, sf, F.when(F.col("p_partkey") % 2 == 0, number).alias("patent_id"), number.alias("patent_number"),
        _title("p_partkey").alias("patent_title"), F.col("p_name").alias("patent_abstract"),
    )
    return landed.from_patentsview(_twice(df, "ord")).select("source_id", "text", "doi", "url")


@query(
    "normalise_scholar_patent_hits",
    f"""SELECT 'scholarly' AS kind, CASE WHEN p_partkey % 4 = 1 AND p_partkey % 3 <> 0 THEN md5(concat({_TITLE.format('p_partkey')}, chr(10), p_name)) ELSE concat('L', p_partkey) END AS source_id, concat({_TITLE.format('p_partkey')}, chr(10), p_name) AS text,
         CASE WHEN p_partkey % 2 = 0 THEN concat('10.4/', p_partkey) ELSE '' END AS doi,
         CASE WHEN p_partkey % 2 = 0 THEN concat('https://doi.org/10.4/', p_partkey) ELSE 'https://lens.org/search' END AS url FROM part
         QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY p_partkey) = 1
       UNION ALL SELECT 'patent', concat('L', p_partkey), concat('On ', p_type, chr(10), p_name, chr(10), '1. A ', p_brand, ' 2. B'), concat('L', p_partkey), concat('https://lens.org/lens/patent/EP_', p_partkey) FROM part
       UNION ALL SELECT 'pct', concat('L', p_partkey), concat('On ', p_type, chr(10), p_name, chr(10), '1. A ', p_brand, ' 2. B'), concat('L', p_partkey), concat('https://lens.org/lens/patent/WO_', p_partkey) FROM part""",
)
def normalise_scholar_patent_hits(spark, sf):
    ids = F.array(
        F.struct(F.lit("pmid").alias("type"), F.lit("7").alias("value")),
        F.struct(F.when(F.col("p_partkey") % 2 == 0, "doi").otherwise("magid").alias("type"),
                 F.concat(F.lit("10.4/"), "p_partkey").alias("value")),
    )
    claim = lambda *parts: F.struct(F.array(*parts).alias("claim_text"))
    claims = F.array(
        F.struct(F.array(claim(F.lit("1. A"), F.col("p_brand"))).alias("claims")),
        F.struct(F.array(claim(F.lit("2. B"))).alias("claims")),
    )
    df = _part(
        spark, sf, F.concat(F.lit("L"), "p_partkey").alias("lens_id"),
        F.col("p_partkey").cast("string").alias("doc_number"), F.lit("EP").alias("jurisdiction"),
        _title("p_partkey").alias("title"), F.col("p_name").alias("abstract"), ids.alias("external_ids"),
        F.struct(F.array(F.struct(F.concat(F.lit("On "), "p_type").alias("text"))).alias("invention_title"))
        .alias("biblio"),
        claims.alias("claims"),
    )
    # some papers have no id; their titles are all alike
    nameless = (F.col("ord") % 4 == 1) & (F.col("ord") % 3 != 0)
    papers = df.withColumn("value", F.when(
        nameless, F.regexp_replace("value", '"lens_id":"L[0-9]+",', "")).otherwise(F.col("value")))
    parts = [
        landed.from_hits(_twice(papers if k == "scholarly" else df, "ord"), k).select(F.lit(k).alias("kind"), "source_id", "text", "doi", "url")
        for k in ("scholarly", "patent", "pct")
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "normalise_biblio_polymorphic",
    """SELECT concat('EP', p_partkey, 'A1') AS source_id, CASE p_partkey % 3 WHEN 0 THEN concat('Title ', p_name, chr(10), p_brand)
         WHEN 1 THEN concat('English ', p_name, chr(10), p_brand, ' ', p_type) ELSE concat('Title ', p_name, chr(10), 'plain ', p_type) END AS text FROM part WHERE p_partkey % 7 <> 6""",
)
def normalise_biblio_polymorphic(spark, sf):
    name, brand, kind = F.col("p_name"), F.col("p_brand"), F.col("p_type")
    txt = lambda *c: F.concat(F.lit('"'), *c, F.lit('"'))
    one = F.concat(F.lit('{"@lang":"en","$":'), txt(F.lit("Title "), name), F.lit("}"))
    many = F.concat(F.lit('[{"@lang":"de","$":"Titel"},{"@lang":"EN","$":'), txt(F.lit("English "), name), F.lit("}]"))
    para = F.concat(F.lit('{"@lang":"en","p":{"$":'), txt(brand), F.lit("}}"))
    paras = F.concat(
        F.lit('[{"@lang":"fr","p":{"$":"non"}},{"@lang":"en","p":[{"$":'), txt(brand), F.lit('},{"$":'), txt(kind), F.lit("}]}]")
    )
    plain = F.concat(F.lit('{"p":'), txt(F.lit("plain "), kind), F.lit("}"))
    shape = F.col("p_partkey") % 3
    doc = F.concat(
        F.lit('{"@country":"EP","@doc-number":"'), "p_partkey", F.lit('","@kind":"A1","bibliographic-data":{"invention-title":'),
        F.when(shape == 1, many).otherwise(one), F.lit('},"abstract":'),
        F.when(shape == 0, para).when(shape == 1, paras).otherwise(plain), F.lit("}"),
    )
    item = F.concat(F.lit('{"exchange-document":'), F.when(shape == 2, F.concat(F.lit("["), doc, F.lit("]"))).otherwise(doc), F.lit("}"))
    result = F.when(
        F.col("p_partkey") % 7 == 6,
        F.concat(F.lit('{"ops:publication-reference":{"@document-id":{"doc-number":{"$":"'), "p_partkey", F.lit('"}}}}')),
    ).otherwise(F.concat(F.lit('{"exchange-documents":'), F.when(shape == 0, item).otherwise(F.concat(F.lit("["), item, F.lit("]"))), F.lit("}")))
    value = F.concat(
        F.lit('{"ops:world-patent-data":{"ops:biblio-search":{"ops:search-result":'), result, F.lit("}}}")
    )
    df = table(spark, sf, "part").select(F.col("p_partkey").alias("ord"), value.alias("value"))
    return landed.from_biblio(df).select("source_id", "text")


@query(
    "normalise_patent_snippets",
    f"""SELECT concat('US', p_partkey) AS source_id, CASE WHEN p_partkey % 2 = 0 THEN concat('Full ', p_type) ELSE concat({_TITLE.format('p_partkey')}, ' ', p_name) END AS text,
         concat('https://patents.google.com/patent/US', p_partkey) AS url FROM part WHERE p_partkey % 3 <> 2""",
)
def normalise_patent_snippets(spark, sf):
    hit = F.struct(
        F.struct(F.concat(F.lit("US "), "p_partkey").alias("publication_number"), _title("p_partkey").alias("title"))
        .alias("patent"),
        F.struct(F.col("p_name").alias("text")).alias("snippet"),
    )
    df = _part(
        spark, sf,
        F.struct(F.array(F.struct(F.array(hit, hit).alias("result"))).alias("cluster")).alias("results"),
    )
    # every page lands twice; those of odd keys belong to other patents
    office = F.when(F.col("p_partkey") % 2 == 0, "US").otherwise("EP")
    pages = table(spark, sf, "part").select(
        F.concat(office, "p_partkey").alias("patent_id"), F.concat(F.lit("Full "), "p_type").alias("page_text")
    )
    return landed.from_snippets(df, pages.unionByName(pages)).select("source_id", "text", "url")


# --- extraction -------------------------------------------------------------

CHECKS["planted"] = f"""
  SELECT doc_id, target_name, s AS sequence, {_FAULT.replace('AUGC', 'ATGC').replace('U{9,}', 'T{9,}')} AS fault
  FROM (SELECT doc_id, target_name, planted AS s, length(regexp_replace(planted, '[^GC]', '', 'g')) / length(planted) AS gc FROM sentences) x"""


@query(
    "extract_sequences",
    "SELECT doc_id, sequence, 'prime' AS pattern, 'ssDNA' AS nucleic_acid_type, fault = '' AS valid, fault AS fail_reason FROM planted",
)
def extract_sequences(spark, sf):
    hits = extract.extract_sequences(F.col("text"), valid_only=False)
    return derived(spark, sf, "sentences").select("doc_id", F.explode(hits).alias("h")).select(
        "doc_id", "h.sequence", "h.pattern", "h.nucleic_acid_type", "h.valid", "h.fail_reason"
    )


_AS_DNA = _FAULT.replace("AUGC", "ATGC").replace("U{9,}", "T{9,}")
CHECKS["form_hits"] = f"""
  SELECT doc_id, target_name, s AS sequence, CASE WHEN rna THEN 'ssRNA' ELSE 'ssDNA' END AS nucleic_acid_type,
    CASE form WHEN 0 THEN 'prime' WHEN 1 THEN CASE WHEN rna THEN 'rna_prime' ELSE 'prime' END WHEN 2 THEN 'primary' WHEN 3 THEN 'spaced'
      ELSE CASE WHEN rna THEN 'rna' ELSE 'primary' END END AS pattern, CASE WHEN rna THEN {_FAULT} ELSE {_AS_DNA} END AS fault
  FROM (SELECT doc_id, target_name, form, planted AS s, contains(planted, 'U') AS rna, length(regexp_replace(planted, '[^GC]', '', 'g')) / length(planted) AS gc FROM forms) x"""


@query(
    "extract_sequence_forms",
    "SELECT doc_id, sequence, pattern, nucleic_acid_type, fault = '' AS valid, fault AS fail_reason FROM form_hits",
)
def extract_sequence_forms(spark, sf):
    """All five forms of a sequence."""
    hits = extract.extract_sequences(F.col("text"), valid_only=False)
    return derived(spark, sf, "forms").select("doc_id", F.explode(hits).alias("h")).select(
        "doc_id", "h.sequence", "h.pattern", "h.nucleic_acid_type", "h.valid", "h.fail_reason"
    )


@query(
    "records_from_forms",
    "SELECT doc_id, sequence AS aptamer_sequence, nucleic_acid_type, pattern AS extraction_method FROM form_hits WHERE fault = ''",
)
def records_from_forms(spark, sf):
    docs = derived(spark, sf, "forms").select(
        "doc_id", "text", "target_name", F.lit("https://x/").alias("url"), F.lit("10.9/1").alias("doi"), F.lit("paper").alias("source_type"))
    return harvest.records_from_text(docs).select("doc_id", "aptamer_sequence", "nucleic_acid_type", "extraction_method")


def _group(pattern, n):
    return f"regexp_extract(text, '{pattern}', {n}, 'i')"


CHECKS["affinities"] = f"""
  SELECT doc_id, kind, round(v * CASE u WHEN 'nm' THEN 1.0 WHEN 'pm' THEN 0.001 WHEN 'um' THEN 1000.0 WHEN 'mm' THEN 1000000.0 END, 6)::DOUBLE AS value_nm FROM (
    SELECT doc_id, 'kd' AS kind, TRY_CAST(nullif({_group(fv.KD_TEXT, 1)}, '') AS DOUBLE) AS v, lower({_group(fv.KD_TEXT, 2)}) AS u FROM sentences
    UNION ALL SELECT doc_id, lower({_group(fv.KD_PROXY, 1)}), TRY_CAST(nullif({_group(fv.KD_PROXY, 2)}, '') AS DOUBLE), lower({_group(fv.KD_PROXY, 3)}) FROM sentences) x WHERE v IS NOT NULL"""


@query("extract_kd", "SELECT doc_id, kind AS measure_type, value_nm FROM affinities")
def extract_kd(spark, sf):
    hits = extract.extract_kd(F.col("text"))
    return derived(spark, sf, "sentences").select("doc_id", F.explode(hits).alias("h")).select(
        "doc_id", "h.measure_type", F.round("h.value_nM", 6).alias("value_nm")
    )


@query(
    "best_kd",
    """SELECT row_id, CASE WHEN row_id % 4 = 0 THEN least(a, b) WHEN row_id % 4 = 1 THEN a WHEN row_id % 4 = 2 THEN b ELSE least(a, b) END AS value_nm,
         CASE row_id % 4 WHEN 0 THEN 'kd' WHEN 1 THEN 'kd' WHEN 2 THEN 'kd' ELSE 'ic50' END AS measure_type
       FROM (SELECT row_id, (row_id * 7 % 101)::DOUBLE AS a, (row_id * 13 % 97)::DOUBLE AS b FROM records) x""",
)
def best_kd(spark, sf):
    a, b = (F.col("row_id") * 7 % 101).cast("double"), (F.col("row_id") * 13 % 97).cast("double")
    turn = F.col("row_id") % 4
    hit = lambda v, k: F.struct(v.alias("value_nM"), k.alias("measure_type"))
    hits = F.array(
        hit(a, F.when(turn.isin(0, 1), "kd").otherwise("ic50")),
        hit(b, F.when(turn.isin(0, 2), "kd").otherwise("ic50")),
    )
    return derived(spark, sf, "records").select("row_id", extract.best_kd(hits).alias("h")).select(
        "row_id", F.col("h.value_nM").alias("value_nm"), "h.measure_type"
    )


def _documents(spark, sf):
    return derived(spark, sf, "sentences").select(
        "doc_id", "text", "target_name", F.concat(F.lit("https://x/"), "doc_id").alias("url"),
        F.concat(F.lit("10.9/"), "doc_id").alias("doi"), F.lit("paper").alias("source_type"),
    )


@query(
    "records_from_text",
    """SELECT p.doc_id, p.sequence AS aptamer_sequence, p.target_name, a.value_nm AS kd_value, concat('https://x/', p.doc_id) AS source_url, 'prime' AS extraction_method
       FROM planted p LEFT JOIN affinities a ON a.doc_id = p.doc_id WHERE fault = ''""",
)
def records_from_text(spark, sf):
    return harvest.records_from_text(_documents(spark, sf)).select(
        "doc_id", "aptamer_sequence", "target_name", F.round("kd_value", 6).alias("kd_value"),
        "source_url", "extraction_method",
    )


def _tabled(spark, sf):
    """One document per customer with two tables assembled from its cells."""
    cells = derived(spark, sf, "table_cells")
    head = F.array(F.lit("Clone"), F.lit("Selected sequence"), F.lit("Kd (nM)"), F.lit("Target"))
    line = F.array(F.concat(F.lit("c"), "row_no"), "seq", "kd_cell", "target_cell")
    rows = cells.groupBy("doc_id", "table_no").agg(
        F.array_sort(F.collect_list(F.struct("row_no", line.alias("cells")))).alias("r")
    )
    one = F.struct(
        F.concat(F.lit("Table "), "table_no").alias("label"), F.lit("").alias("caption"),
        F.concat(F.array(head), F.transform("r", lambda x: x["cells"])).alias("rows"),
    )
    docs = rows.groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct("table_no", one.alias("t")))).alias("ts")
    )
    return docs.select(
        "doc_id", F.transform("ts", lambda x: x["t"]).alias("tables"),
        F.concat(F.lit("https://t/"), "doc_id").alias("url"), F.lit("10.8/1").alias("doi"),
        F.lit("paper").alias("source_type"), F.lit("Thrombin").alias("target_name"),
    )


_TFAULT = _FAULT.replace("AUGC", "ATGC").replace("U{9,}", "T{9,}")
CHECKS["cell_rows"] = f"""
  SELECT doc_id, table_no, row_no, s AS sequence, CASE row_no % 6 WHEN 0 THEN NULL WHEN 1 THEN 5 WHEN 2 THEN (row_no % 90 + 1) * 1000 ELSE row_no % 50 + 1 END::DOUBLE AS kd,
    CASE WHEN row_no % 7 = 0 THEN 'Thrombin' ELSE target_cell END AS target
  FROM (SELECT *, {_TFAULT} AS fault FROM (SELECT *, seq AS s, length(regexp_replace(seq, '[^GC]', '', 'g')) / length(seq) AS gc FROM table_cells) x) y WHERE fault = ''"""
CHECKS["cell_best"] = """
  SELECT * FROM cell_rows QUALIFY row_number() OVER (PARTITION BY doc_id, sequence ORDER BY kd IS NULL, table_no, row_no) = 1"""


@query(
    "kd_upgrade_dedup",
    "SELECT doc_id, sequence, kd AS kd_nM, target AS target_name FROM cell_best",
)
def kd_upgrade_dedup(spark, sf):
    docs = _tabled(spark, sf).withColumn("fallback_target", F.col("target_name"))
    return dedup.upgrade_dedup(harvest.table_hits(docs)).select(
        "doc_id", "sequence", "kd_nM", "target_name"
    )


@query(
    "records_from_tables",
    "SELECT doc_id, sequence AS aptamer_sequence, kd AS kd_value, target AS target_name FROM cell_best",
)
def records_from_tables(spark, sf):
    docs = _tabled(spark, sf).withColumn("fallback_target", F.col("target_name"))
    return harvest.records_from_tables(docs).select(
        "doc_id", "aptamer_sequence", "kd_value", "target_name"
    )


@query(
    "table_column_scores",
    "SELECT doc_id, CAST(table_no AS INTEGER) AS table_no, CAST(1 AS INTEGER) AS seq_col, CAST(2 AS INTEGER) AS kd_col, CAST(3 AS INTEGER) AS target_col FROM (SELECT DISTINCT doc_id, table_no FROM table_cells) x",
)
def table_column_scores(spark, sf):
    t = _tabled(spark, sf).select("doc_id", F.explode("tables").alias("t")).select(
        "doc_id", F.substring("t.label", 7, 9).cast("int").alias("table_no"), F.col("t.rows").alias("rows")
    )
    return harvest.detect_columns(t).select("doc_id", "table_no", "seq_col", "kd_col", "target_col")


CHECKS["doc_text"] = """
  SELECT p.doc_id, p.sequence, p.fault, a.value_nm FROM planted p LEFT JOIN affinities a ON a.doc_id = p.doc_id"""


def _with_text(spark, sf):
    """All documents: with tables, with a text, or with both."""
    texts = derived(spark, sf, "sentences").select("doc_id", "text")
    full = _tabled(spark, sf).join(texts, "doc_id", "full")
    known = {"url": F.concat(F.lit("https://t/"), "doc_id"), "doi": F.lit("10.8/1"), "source_type": F.lit("paper"), "target_name": F.lit("Thrombin")}
    return full.withColumns({c: F.coalesce(c, v) for c, v in known.items()})


@query(
    "document_records",
    """SELECT doc_id, sequence AS aptamer_sequence, kd AS kd_value, 'table' AS origin FROM cell_best
       UNION ALL SELECT d.doc_id, d.sequence, d.value_nm, 'text' FROM doc_text d WHERE fault = '' AND NOT EXISTS (SELECT 1 FROM cell_best c WHERE c.doc_id = d.doc_id AND c.sequence = d.sequence)
       UNION ALL SELECT f.doc_id, f.sequence, NULL, 'text' FROM form_hits f WHERE fault = '' AND (f.doc_id IN (SELECT doc_id FROM sentences) OR f.doc_id IN (SELECT doc_id FROM table_cells))""",
)
def document_records(spark, sf):
    """Tables, text and supplements of every document; the documents of the sequence forms stand for supplements."""
    origin = F.when(F.col("extraction_method").startswith("table:"), "table").otherwise("text")
    return harvest.document_records(_with_text(spark, sf), derived(spark, sf, "forms")).select(
        "doc_id", "aptamer_sequence", F.round("kd_value", 6).alias("kd_value"), origin.alias("origin")
    )


@query(
    "table_over_text",
    """SELECT d.doc_id, d.sequence AS aptamer_sequence FROM doc_text d WHERE fault = '' AND NOT EXISTS (SELECT 1 FROM cell_best c WHERE c.doc_id = d.doc_id AND c.sequence = d.sequence)""",
)
def table_over_text(spark, sf):
    docs = _with_text(spark, sf)
    tab = harvest.records_from_tables(docs.withColumn("fallback_target", F.col("target_name")))
    return harvest.prefer_tables(tab, harvest.records_from_text(docs)).select("doc_id", "aptamer_sequence")


# --- streaming --------------------------------------------------------------


def _two_triggers(rows, key, path):
    """A stream of all rows in two triggers, the lower half of the keys first.

    Its files grow in number with the rows, so no task holds a fixed share of them; the halves are written one
    after the other, since a stream takes files by their time.
    """
    files = max(2, rows.rdd.getNumPartitions())
    middle = rows.agg(F.floor((F.min(key) + F.max(key)) / 2)).first()[0] or 0
    for half in (F.col(key) <= middle, F.col(key) > middle):
        rows.where(half).repartition(files).write.mode("append").parquet(path)
    return ingest.read_stream(rows.sparkSession, path, rows.schema, files_per_trigger=files)


@query("stream_ingest_dedup", "SELECT DISTINCT user_id, event_type FROM events")
def stream_ingest_dedup(spark, sf):
    folder = scratch(spark)
    events = table(spark, sf, "events").select("event_id", "user_id", "event_type")
    stream = _two_triggers(events, "event_id", f"{folder}/in")
    ingest.append_new_keys(
        stream, f"{folder}/out", f"{folder}/state", ["user_id", "event_type"], ["event_id"]
    ).awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("user_id", "event_type")


@query("stream_ingest_records", "SELECT row_id FROM batch_fate WHERE n_errors = 0 AND NOT known AND rn = 1")
def stream_ingest_records(spark, sf):
    folder = scratch(spark)
    rows = derived(spark, sf, "text_records")
    stream = _two_triggers(rows, "row_id", f"{folder}/in")
    ingest.ingest_records(
        stream, derived(spark, sf, "master"), f"{folder}/out", f"{folder}/state"
    ).awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("row_id")


@query(
    "stream_stats",
    """SELECT coalesce(kind, 'total') AS source_type, count(*) AS incoming, count(*) FILTER (n_errors = 0) AS valid, count(*) FILTER (n_errors > 0) AS invalid,
         count(*) FILTER (n_errors = 0 AND known) AS known_duplicates, count(*) FILTER (n_errors = 0 AND NOT known AND rn > 1) AS batch_duplicates,
         count(*) FILTER (n_errors = 0 AND NOT known AND rn = 1) AS new_rows
       FROM (SELECT *, CASE WHEN source_type IN ('paper', 'patent', 'database', 'preprint') THEN source_type ELSE 'other' END AS kind FROM batch_fate) y GROUP BY ROLLUP (kind)""",
)
def stream_stats(spark, sf):
    """The counts of all triggers together."""
    folder = scratch(spark)
    rows = derived(spark, sf, "text_records")
    stream = _two_triggers(rows, "row_id", f"{folder}/in")
    run = ingest.ingest_records(stream, derived(spark, sf, "master"), f"{folder}/out", f"{folder}/state")
    run.awaitTermination()
    return ingest.trigger_stats(spark, run).groupBy("source_type").agg(*[F.sum(c).alias(c) for c in ingest.COUNTS])


# --- cleaning plan ----------------------------------------------------------


def _chain(prefix: str, base: str) -> None:
    """Checking views of complement removal and leakage repair over ``base``."""
    CHECKS[f"{prefix}_side"] = f"""
  SELECT row_id, s, r, least(s, r) AS g, s = r AS pal, s = first_value(s) OVER (PARTITION BY least(s, r) ORDER BY row_id) AS is_a
  FROM (SELECT row_id, upper(sequence) AS s, reverse(translate(upper(sequence), 'ATGC', 'TACG')) AS r FROM {base} WHERE sequence IS NOT NULL) x"""
    CHECKS[f"{prefix}_group"] = f"""
  SELECT g, bool_or(pal) AS pal, count(*) AS n, max(row_id) AS last_all, max(row_id) FILTER (is_a) AS last_a, min(row_id) FILTER (NOT is_a) AS first_b,
    max(row_id) FILTER (NOT is_a) AS last_b, count(*) FILTER (NOT is_a) AS n_b FROM {prefix}_side GROUP BY g"""
    CHECKS[f"{prefix}_gone"] = f"""
  SELECT row_id FROM {prefix}_side a JOIN {prefix}_group b USING (g) WHERE (b.pal AND n > 1 AND row_id = last_all)
    OR (NOT b.pal AND n_b > 0 AND (row_id = last_b OR (n_b >= 2 AND first_b < last_a AND row_id = last_a) OR (n_b >= 2 AND first_b > last_a AND NOT is_a)))"""
    CHECKS[f"{prefix}_kept"] = f"""
  SELECT d.*, a.split AS old_split FROM {base} d JOIN assigned a ON a.row_id = d.row_id WHERE d.row_id NOT IN (SELECT row_id FROM {prefix}_gone)"""
    CHECKS[f"{prefix}_member"] = f"""
  SELECT upper(sequence) AS s, bool_or(old_split = 'train')::INT + bool_or(old_split = 'val')::INT + bool_or(old_split = 'test')::INT AS k FROM {prefix}_kept GROUP BY 1"""
    CHECKS[f"{prefix}_rows"] = f"""
  SELECT d.*, CASE WHEN k >= 2 AND old_split IN ('val','test') THEN 'train' ELSE old_split END AS split FROM {prefix}_kept d LEFT JOIN {prefix}_member m ON m.s = upper(d.sequence)"""


_chain("full", "deduped")
CHECKS["sound"] = "SELECT l.* FROM legacy l JOIN validated v ON v.row_id = l.row_id WHERE fail_reason = ''"
_chain("sound", "sound")
CHECKS["full_typed"] = f"""
  SELECT *, {_CLEAN_KIND} AS target_type FROM (SELECT q.* FROM full_rows q JOIN quarantined z ON z.row_id = q.row_id WHERE z.removal_reason IS NULL) y"""
CHECKS["full_clean"] = """
  SELECT q.*, CASE WHEN target_type = 'small_molecule' AND cid IS NOT NULL THEN concat('CID:', cid) WHEN target_type = 'protein' THEN uniprot_id END AS target_id
  FROM full_typed q LEFT JOIN compound_ids c ON c.name = q.target_protein"""


def _cleaned(spark, sf, curated=False):
    return cleaning.clean(
        derived(spark, sf, "legacy"), derived(spark, sf, "old_splits"), derived(spark, sf, "compound_ids"),
        derived(spark, sf, "text_records") if curated else None,
    )


CHECKS["full_donors"] = """
  SELECT target_id, arg_min(protein_sequence, row_id) AS ps FROM full_clean WHERE length(protein_sequence) > 10 AND target_id IS NOT NULL GROUP BY 1"""
CHECKS["full_out"] = f"""
  SELECT 'legacy' AS origin, c.row_id, upper(c.sequence) AS aptamer_sequence, 'ssDNA' AS nucleic_acid_type, 'none' AS modifications, c.target_protein AS target_name,
    c.target_type, c.target_id, c.split, {_SOURCE_TYPE} AS source_type, {_CONFIDENCE} AS confidence_score, coalesce(c.protein_sequence, f.ps) AS protein_sequence,
    c.label, CAST(c.training_tier AS INTEGER) AS training_tier, c.Kd_nM AS kd_value
  FROM full_clean c LEFT JOIN full_donors f ON f.target_id = c.target_id
  UNION ALL SELECT 'curated', t.row_id, t.aptamer_sequence, t.nucleic_acid_type, t.modifications, t.target_name, t.target_type, t.target_id, 'train', t.source_type,
    CASE WHEN t.nucleic_acid_type = 'ssDNA' AND NOT coalesce(regexp_full_match(upper(trim(t.aptamer_sequence)), '[ATGC]+'), false) THEN 'uncertain' ELSE t.confidence_score END,
    f.ps, 1, 2, TRY_CAST(t.kd_value AS DOUBLE)
  FROM text_records t LEFT JOIN full_donors f ON f.target_id = t.target_id
  WHERE NOT EXISTS (SELECT 1 FROM full_clean c WHERE upper(c.sequence) = upper(t.aptamer_sequence) AND lower(c.target_protein) = lower(t.target_name))"""


@query(
    "clean_pipeline",
    """SELECT row_id, aptamer_sequence, nucleic_acid_type, target_name, target_type, target_id, split, source_type, confidence_score, protein_sequence, label,
         training_tier, kd_value FROM full_out""",
)
def clean_pipeline(spark, sf):
    """All seven phases, with curated rows."""
    return _cleaned(spark, sf, curated=True).rows.select(
        "row_id", "aptamer_sequence", "nucleic_acid_type", "target_name", "target_type", "target_id", "split",
        "source_type", "confidence_score", "protein_sequence", "label", "training_tier", "kd_value",
    )


def _issues(view: str) -> str:
    """SQL of the export audit over a view of cleaned rows."""
    words = lambda some: ", ".join("'" + x.replace("'", "''") + "'" for x in some)
    parts = [f"""SELECT 'null:{c}' AS "check", count(*) AS n FROM {view} WHERE {c} IS NULL HAVING count(*) > 0""" for c in fv.REQUIRED]
    dna = f"FROM {view} WHERE nucleic_acid_type = 'ssDNA' AND"
    parts += [
        f"SELECT 'charset', count(*) {dna} NOT coalesce(regexp_full_match(upper(trim(aptamer_sequence)), '[ATGC]+'), false) HAVING count(*) > 0",
        f"SELECT 'too_short', count(*) {dna} length(aptamer_sequence) < 20 HAVING count(*) > 0",
        f"SELECT 'too_long', count(*) {dna} length(aptamer_sequence) > 120 HAVING count(*) > 0",
    ]
    parts += [f"SELECT 'vocabulary:{c}', count(*) FROM {view} WHERE {c} NOT IN ({words(some)}) HAVING count(*) > 0"
              for c, some in fv.CLEANED_VOCABULARY.items()]
    parts += [f"""SELECT 'share_below_5pct:{s}', n FROM (SELECT floor(1000.0 * count(*) FILTER (split = '{s}')
                 / count(*) FILTER (split IN ('train','val','test')))::BIGINT AS n FROM {view}) v WHERE n < 50""" for s in ("val", "test")]
    member = f"""(SELECT upper(aptamer_sequence) AS s, bool_or(split = 'train') AS train, bool_or(split = 'val') AS val, bool_or(split = 'test') AS test FROM {view} GROUP BY 1) m"""
    parts += [f"SELECT 'overlap:{a}_{b}', count(*) FROM {member} WHERE {a} AND {b} AND s IS NOT NULL HAVING count(*) > 0"
              for a, b in (("train", "val"), ("train", "test"), ("val", "test"))]
    return " UNION ALL ".join(parts)


@query("clean_checks", _issues("full_out"))
def clean_checks(spark, sf):
    """The audit of the cleaned rows (phase 7)."""
    return _cleaned(spark, sf, curated=True).checks


@query(
    "clean_coverage",
    f"""SELECT priority, total, train_rows, val_rows, test_rows, unassigned_rows, train_kd, val_kd, test_kd,
         CASE WHEN total = 0 THEN 'absent' WHEN val_rows = 0 AND test_rows = 0 THEN 'no val or test rows' ELSE '' END AS warning
       FROM (SELECT p.name AS priority, {_PRIORITY_COUNTS}, count(kd_value) FILTER (split = 'train') AS train_kd, count(kd_value) FILTER (split = 'val') AS val_kd,
               count(kd_value) FILTER (split = 'test') AS test_kd
             FROM (VALUES ('Insulin','\\binsulin\\b'),('Myoglobin','\\bmyoglobin\\b'),('Troponin','\\btroponin\\b'), ('NT-proBNP','nt.?probnp|pro.?bnp'),('Albumin','\\balbumin\\b')) p(name, pat)
             LEFT JOIN (SELECT row_id, target_protein, old_split AS split, Kd_nM AS kd_value FROM full_kept) r ON regexp_matches(r.target_protein, p.pat, 'i') GROUP BY 1) x""",
)
def clean_coverage(spark, sf):
    """Priority targets per split before the repair (phase 2)."""
    return _cleaned(spark, sf).coverage


@query(
    "clean_phases",
    f"""SELECT row_id, upper(sequence) AS aptamer_sequence, target_type, c.target_id, split, {_SOURCE_ID} AS source_doi, {_CONFIDENCE} AS confidence_score,
          coalesce(protein_sequence, f.ps) AS protein_sequence FROM full_clean c LEFT JOIN
          (SELECT target_id, arg_min(protein_sequence, row_id) AS ps FROM full_clean WHERE length(protein_sequence) > 10 AND target_id IS NOT NULL GROUP BY 1) f ON f.target_id = c.target_id""",
)
def clean_phases(spark, sf):
    return _cleaned(spark, sf).rows.select(
        "row_id", "aptamer_sequence", "target_type", "target_id", "split", "source_doi",
        "confidence_score", "protein_sequence",
    )


@query(
    "clean_removed",
    """SELECT q.row_id, z.removal_reason FROM full_rows q JOIN quarantined z ON z.row_id = q.row_id WHERE z.removal_reason IS NOT NULL""",
)
def clean_removed(spark, sf):
    return _cleaned(spark, sf).removed.select("row_id", "removal_reason")


@query(
    "review_queue",
    """SELECT '1_rc_pair' AS phase, row_id, CAST(NULL AS VARCHAR) AS target_name FROM full_gone
       UNION ALL SELECT '3_leakage', row_id, NULL FROM full_rows WHERE split <> old_split
       UNION ALL SELECT '5_pubchem', NULL, n FROM (SELECT DISTINCT target_protein AS n FROM full_typed WHERE target_type = 'small_molecule' AND target_protein NOT IN (SELECT name FROM compound_ids)) x""",
)
def review_queue(spark, sf):
    found = cleaning.review(derived(spark, sf, "legacy"), derived(spark, sf, "old_splits"), derived(spark, sf, "compound_ids"))
    return found.select(
        "phase", "row_id", F.when(F.col("phase") == "5_pubchem", F.col("target_name")).alias("target_name")
    )


@query(
    "clean_share",
    """SELECT split, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS pct FROM sound_rows WHERE split <> 'unassigned' GROUP BY split""",
)
def clean_share(spark, sf):
    """How many clean, non-leaking records per split?"""
    rows = derived(spark, sf, "legacy").select("row_id", "sequence", "target_protein")
    checked = validate.validate_sequences(rows).where("valid").select(*rows.columns)
    kept, _ = dedup.rc_dedup(durable(dedup.exact_dedup(checked)))
    assigned = durable(
        enrich.assign_existing(durable(kept), derived(spark, sf, "old_splits"))
    ).withColumnsRenamed({"sequence": "aptamer_sequence", "target_protein": "target_name"})
    return audit.split_share(audit.repair_leakage(assigned)[0])

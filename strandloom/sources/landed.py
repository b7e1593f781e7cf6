"""Landed JSON and XML of literature and patent sources as one text schema.

Every reader takes a frame with ``ord`` (arrival order) and ``value`` (one
landed document) and returns ord, source_id, text, doi, url, source_type.
Repeated ids keep their first arrival.
"""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom import fixed_values as fv
from strandloom.functions.bind import bind, once
from strandloom.functions.text import keyword_gate
from strandloom.functions.space import strip
from strandloom.operators.skew import keep_first

OUTPUT = ("ord", "source_id", "text", "doi", "url", "source_type")


def _text(*parts: Column) -> Column:
    return F.concat_ws("\n", *[F.coalesce(p, F.lit("")) for p in parts])


def _finish(df: DataFrame, first: bool = True) -> DataFrame:
    out = df.select(*OUTPUT)
    return keep_first(out, [F.col("source_id")], order=("ord",)) if first else out


def placed_words(index: Column) -> Column:
    """The words of {word: [positions]} by position, as array<struct<p, i, w>>; i is the word's place in the map."""
    return F.sort_array(
        F.flatten(
            F.transform(
                F.map_entries(index),
                lambda e, i: F.transform(
                    e["value"],
                    lambda p: F.struct(p.alias("p"), i.alias("i"), e["key"].alias("w")),
                ),
            )
        )
    )


def joined_words(placed: Column) -> Column:
    """Text of placed words; a later word wins a shared position."""
    kept = bind(
        placed,
        lambda a: F.filter(
            a, lambda x, n: F.coalesce(F.get(a, n + 1)["p"] != x["p"], F.lit(True))
        ),
    )
    return F.coalesce(F.array_join(F.transform(kept, lambda x: x["w"]), " "), F.lit(""))


def rebuild_abstract(index: Column) -> Column:
    """Text from {word: [positions]}; a later word wins a shared position."""
    return joined_words(placed_words(index))


def _first_values(df: DataFrame, source_id: Column) -> DataFrame:
    """(ord, value) of the first arrival of every id, before more of a document is parsed than its id."""
    x = df.select(source_id.alias("_id"), F.struct("ord", "value").alias("_d"))
    return x.groupBy("_id").agg(F.min("_d").alias("_d")).select("_d.*")


def from_openalex(df: DataFrame) -> DataFrame:
    first = _first_values(df, F.from_json("value", "id string")["id"])
    w = F.from_json(
        "value",
        "id string, title string, doi string, abstract_inverted_index map<string,array<int>>",
    )
    # sorted words are a column of their own, as sorting inside a larger expression is several times slower
    x = once(first, "w", w).select("ord", "w").transform(
        once, "_placed", placed_words(F.col("w.abstract_inverted_index"))
    ).transform(once, "text", _text(F.col("w.title"), joined_words(F.col("_placed"))))
    doi = F.coalesce("w.doi", F.lit(""))
    x = x.select(
        "ord", F.col("w.id").alias("source_id"), "text",
        doi.alias("doi"),
        F.when(doi.startswith("http"), doi)
        .when(doi != "", F.concat(F.lit("https://doi.org/"), doi))
        .otherwise(F.col("w.id")).alias("url"),
        F.lit("paper").alias("source_type"),
    )
    return _finish(x, first=False).where(keyword_gate(F.col("text"), fv.GATE_WORKS))


def from_paper_search(df: DataFrame) -> DataFrame:
    p = F.from_json(
        "value", "paperId string, title string, abstract string, externalIds struct<DOI:string>"
    )
    x = df.withColumn("p", p)
    doi = F.coalesce("p.externalIds.DOI", F.lit(""))
    x = x.select(
        "ord", F.col("p.paperId").alias("source_id"),
        _text(F.col("p.title"), F.col("p.abstract")).alias("text"), doi.alias("doi"),
        F.when(doi != "", F.concat(F.lit("https://doi.org/"), doi))
        .otherwise(F.concat(F.lit("https://www.semanticscholar.org/paper/"), F.col("p.paperId")))
        .alias("url"),
        F.lit("paper").alias("source_type"),
    )
    return _finish(x).where(strip(F.col("text")) != "")


def from_preprint(df: DataFrame) -> DataFrame:
    p = F.from_json("value", "category string, title string, abstract string, doi string")
    x = df.withColumn("p", p)
    doi = F.coalesce("p.doi", F.lit(""))
    category = F.translate(F.lower(F.coalesce("p.category", F.lit(""))), " ", "-")
    x = x.where(category.isin(*fv.PREPRINT_CATEGORIES)).select(
        "ord", doi.alias("source_id"),
        _text(F.col("p.title"), F.col("p.abstract")).alias("text"), doi.alias("doi"),
        F.when(doi != "", F.concat(F.lit("https://www.biorxiv.org/content/"), doi))
        .otherwise("https://www.biorxiv.org").alias("url"),
        F.lit("preprint").alias("source_type"),
    )
    return _finish(x, first=False).where(keyword_gate(F.col("text"), fv.GATE_PREPRINT))


def from_patentsview(df: DataFrame) -> DataFrame:
    p = F.from_json(
        "value",
        "patent_id string, patent_number string, patent_title string, patent_abstract string",
    )
    x = df.withColumn("p", p)
    pid = F.coalesce(F.nullif("p.patent_id", F.lit("")), "p.patent_number", F.lit(""))
    x = x.select(
        "ord", pid.alias("source_id"),
        _text(F.col("p.patent_title"), F.col("p.patent_abstract")).alias("text"),
        F.concat(F.lit("US"), pid).alias("doi"),
        F.concat(F.lit("https://patents.google.com/patent/US"), pid).alias("url"),
        F.lit("patent").alias("source_type"),
    )
    return _finish(x).where(strip(F.col("text")) != "")


_HIT = (
    "lens_id string, doc_number string, jurisdiction string, title string, abstract string, "
    "external_ids array<struct<type:string,value:string>>, "
    "biblio struct<invention_title:array<struct<text:string>>>, "
    "claims array<struct<claims:array<struct<claim_text:array<string>>>>>"
)


def from_hits(df: DataFrame, kind: str = "scholarly") -> DataFrame:
    """Scholarly papers, patents or international ('pct') patents.

    A digest of the whole title and abstract stands in for a missing id, so
    papers with a common title start stay apart.
    """
    x = df.withColumn("h", F.from_json("value", _HIT))
    lens = F.nullif("h.lens_id", F.lit(""))
    if kind == "scholarly":
        dois = F.filter("h.external_ids", lambda e: e["type"] == "doi")
        doi = F.coalesce(F.get(dois, F.lit(0))["value"], F.lit(""))
        x = x.select(
            "ord", F.coalesce(lens, F.md5(_text(F.col("h.title"), F.col("h.abstract")))).alias("source_id"),
            _text(F.col("h.title"), F.col("h.abstract")).alias("text"), doi.alias("doi"),
            F.when(doi != "", F.concat(F.lit("https://doi.org/"), doi))
            .otherwise("https://lens.org/search").alias("url"),
            F.lit("paper").alias("source_type"),
        )
        return _finish(x)
    title = F.get(F.col("h.biblio.invention_title"), F.lit(0))["text"]
    claims = F.transform(
        F.flatten(F.transform("h.claims", lambda g: F.coalesce(g["claims"], F.array().cast(
            "array<struct<claim_text:array<string>>>")))),
        lambda c: F.array_join(F.coalesce(c["claim_text"], F.array().cast("array<string>")), " "),
    )
    doc, jur = F.coalesce("h.doc_number", F.lit("")), F.coalesce("h.jurisdiction", F.lit(""))
    lid = F.coalesce(lens, doc)
    other = F.concat(F.lit("https://lens.org/"), lid)
    if kind == "pct":
        url = F.when(doc != "", F.concat(F.lit("https://lens.org/lens/patent/WO_"), doc))
    else:
        url = F.when((doc != "") & (jur != ""),
                     F.concat(F.lit("https://lens.org/lens/patent/"), jur, F.lit("_"), doc))
    x = x.select(
        "ord", lid.alias("source_id"),
        strip(_text(title, F.col("h.abstract"), F.array_join(claims, " "))).alias("text"),
        lid.alias("doi"), url.otherwise(other).alias("url"), F.lit("patent").alias("source_type"),
    )
    return _finish(x)


def _list_of(piece: Column) -> Column:
    """A JSON value that is an object or a list of them, as array<string>."""
    return F.when(
        piece.startswith("["), F.from_json(piece, "array<string>")
    ).when(piece.isNotNull() & (piece != ""), F.array(piece))


def _english_first(pieces: Column) -> Column:
    """The first piece in English or without language, else the first."""
    lang = lambda t: F.lower(F.coalesce(F.get_json_object(t, "$['@lang']"), F.lit("")))
    good = F.filter(pieces, lambda t: lang(t).isin("en", ""))
    return F.coalesce(F.get(good, F.lit(0)), F.get(pieces, F.lit(0)))


def _body(piece: Column) -> Column:
    """Text of {'$': ...}; a plain string is its own text."""
    return F.when(piece.startswith("{"), F.coalesce(F.get_json_object(piece, "$['$']"), F.lit(""))
                  ).otherwise(piece)


def from_biblio(df: DataFrame) -> DataFrame:
    """Search results whose documents, titles and abstracts are object or list."""
    root = "$['ops:world-patent-data']['ops:biblio-search']['ops:search-result']"
    x = df.withColumn("r", F.get_json_object("value", root))
    items = _list_of(F.get_json_object("r", "$['exchange-documents']"))
    docs = F.flatten(
        F.transform(items, lambda i: _list_of(F.get_json_object(i, "$['exchange-document']")))
    )
    refs = F.transform(
        _list_of(F.get_json_object("r", "$['ops:publication-reference']")),
        lambda f: F.struct(
            F.coalesce(F.get_json_object(f, "$['@document-id']['doc-number']['$']"), F.lit(""))
            .alias("number"),
            F.lit("").alias("title"), F.lit("").alias("abstract"),
        ),
    )

    def document(d):
        field = lambda n: F.coalesce(F.get_json_object(d, f"$['{n}']"), F.lit(""))
        title = F.coalesce(
            F.get_json_object(d, "$['bibliographic-data']['invention-title']"),
            F.get_json_object(d, "$['invention-title']"),
        )
        abstract = _english_first(_list_of(F.get_json_object(d, "$['abstract']")))
        paragraphs = _list_of(F.when(abstract.startswith("{"), F.get_json_object(abstract, "$['p']"))
                              .otherwise(abstract))
        number = F.when(
            (field("@country") != "") & (field("@doc-number") != ""),
            F.concat(field("@country"), field("@doc-number"), field("@kind")),
        ).otherwise(field("@doc-number"))
        return F.struct(
            number.alias("number"),
            F.coalesce(_body(_english_first(_list_of(title))), F.lit("")).alias("title"),
            F.coalesce(F.array_join(F.transform(paragraphs, _body), " "), F.lit("")).alias("abstract"),
        )

    found = F.coalesce(F.transform(docs, document), refs)
    x = x.select("ord", F.posexplode(found).alias("pos", "d")).where(F.col("d.number") != "")
    x = x.select(
        F.struct("ord", "pos").alias("_o"), "ord", F.col("d.number").alias("source_id"),
        strip(_text(F.col("d.title"), F.col("d.abstract"))).alias("text"),
        F.col("d.number").alias("doi"),
        F.concat(F.lit("https://worldwide.espacenet.com/patent/search/family/"), F.col("d.number"))
        .alias("url"),
        F.lit("patent").alias("source_type"),
    )
    return keep_first(x, [F.col("source_id")], order=("_o",)).select(*OUTPUT).where(F.col("text") != "")


def from_snippets(df: DataFrame, pages: DataFrame) -> DataFrame:
    """Clustered search hits; full page text (patent_id, page_text) when landed."""
    hit = F.from_json(
        "value",
        "results struct<cluster:array<struct<result:array<struct<"
        "patent:struct<publication_number:string,title:string>,snippet:struct<text:string>>>>>>",
    )
    results = F.flatten(F.transform(hit["results"]["cluster"], lambda c: c["result"]))
    x = df.select("ord", F.posexplode(results).alias("pos", "h"))
    pid = F.translate(F.coalesce("h.patent.publication_number", F.lit("")), " ", "")
    quick = F.concat(
        F.coalesce("h.patent.title", F.lit("")), F.lit(" "), F.coalesce("h.snippet.text", F.lit(""))
    )
    x = x.select(F.struct("ord", "pos").alias("_o"), "ord", pid.alias("source_id"), quick.alias("quick"))
    first = keep_first(x.where("source_id <> ''"), [F.col("source_id")], order=("_o",)).where(
        keyword_gate(F.col("quick"), fv.GATE_PATENT)
    )
    # a page may have landed twice
    full = pages.groupBy(F.col("patent_id").alias("source_id")).agg(F.max("page_text").alias("page_text"))
    return first.join(full, "source_id", "left").select(
        "ord", "source_id",
        F.coalesce(F.nullif("page_text", F.lit("")), "quick").alias("text"),
        F.col("source_id").alias("doi"),
        F.concat(F.lit("https://patents.google.com/patent/"), "source_id").alias("url"),
        F.lit("patent").alias("source_type"),
    )


def crosswalk(df: DataFrame) -> DataFrame:
    """First full-text id per paper id from (pmid, links array<struct<db_to,id>>)."""
    x = df.select("pmid", F.posexplode("links").alias("pos", "link")).where(F.col("link.db_to") == "pmc")
    return x.groupBy("pmid").agg(
        F.concat(F.lit("PMC"), F.min(F.struct("pos", F.col("link.id").alias("id")))["id"]).alias("pmcid")
    )


_CITATION = "ord bigint, pmid string, title string, abstract string, year string, error string"


def _citations(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    whole = lambda e: "" if e is None else "".join(e.itertext())
    for batch in batches:
        rows = []
        for at, xml in zip(batch["ord"], batch["value"]):
            try:
                root = ET.fromstring(xml)
            except (ET.ParseError, TypeError) as fault:
                rows.append((at, None, None, None, None, str(fault)))
                continue
            for c in root.iter("MedlineCitation"):
                date = c.find(".//JournalIssue/PubDate")
                year = None if date is None else date.findtext("Year")
                free = "" if date is None else date.findtext("MedlineDate") or ""
                rows.append((
                    at, c.findtext("PMID") or "", whole(c.find("Article/ArticleTitle")),
                    " ".join(whole(t) for t in c.findall("Article/Abstract/AbstractText")),
                    free[:4] if year is None else year, None,
                ))
        yield pd.DataFrame(rows, columns=["ord", "pmid", "title", "abstract", "year", "error"])


def from_citations(df: DataFrame) -> DataFrame:
    """Citation XML: id, title, abstract parts joined by a blank, year, error.

    A value that cannot be parsed gives one row with the error and nothing else.
    """
    parsed = df.select("ord", "value").mapInPandas(_citations, _CITATION)
    broken = F.when(F.col("error").isNotNull(), F.col("ord"))
    return keep_first(parsed, [F.col("pmid"), broken], order=("ord",)).select(
        "pmid", "title", "abstract", "year", "error"
    )

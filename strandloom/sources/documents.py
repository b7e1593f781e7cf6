"""Pages, plain text, article XML and delimited files as parsed columns.

Python parses one document at a time inside Arrow batches (the standard
library's parsers); everything around it is native.
"""

from __future__ import annotations

import csv
import io
import xml.etree.ElementTree as ET
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom import fixed_values as fv
from strandloom.functions.bind import bind
from strandloom import schemas
from strandloom.functions import text
from strandloom.functions.space import strip

# --- web pages --------------------------------------------------------------

class _Page(HTMLParser):
    """Collects title, text with line breaks at blocks, and table cells."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open, self.out, self.tables, self.title = [], [], [], None
        self.rows, self.cells = [], []

    def _muted(self):
        return any(t in fv.NOISE_TAGS for t, _ in self.open)

    def _line(self, tag):
        if not self._muted() and tag in fv.BLOCK_TAGS:
            self.out.append("\n")

    def handle_starttag(self, tag, attrs):
        self._line(tag)
        if tag == "br" and not self._muted():
            self.out.append("\n")
        if tag in fv.VOID_TAGS:
            return
        made = None
        if tag == "table":
            made = []
            self.tables.append(made)
        elif tag == "tr":
            made = []
            for t, rows in self.open:
                if t == "table":
                    rows.append(made)
        elif tag in ("td", "th"):
            made = []
            for t, row in self.open:
                if t == "tr":
                    row.append(made)
        elif tag == "title" and self.title is None:
            made = self.title = []
        self.open.append((tag, made))

    def handle_endtag(self, tag):
        if not any(t == tag for t, _ in self.open):
            return
        while True:
            closed, _ = self.open.pop()
            self._line(closed)
            if closed == tag:
                return

    def handle_data(self, data):
        if not self._muted():
            self.out.append(data)
        kinds = [t for t, _ in self.open]
        if "script" in kinds or "style" in kinds:
            return
        bare = data.strip()
        for t, made in self.open:
            if bare and made is not None and t in ("td", "th", "title"):
                made.append(bare)

    def result(self):
        while self.open:
            self._line(self.open.pop()[0])
        tables = [[[" ".join(c) for c in r] for r in t if r] for t in self.tables]
        return {
            "title": "".join(self.title or []), "raw": "".join(self.out),
            "tables": [t for t in tables if t],
        }


def _page(html):
    page = _Page()
    page.feed(html)
    page.close()
    return page.result()


@F.pandas_udf(schemas.PAGE)
def _parse_pages(html: pd.Series) -> pd.DataFrame:
    rows = [_page(h) if isinstance(h, str) else {"title": "", "raw": "", "tables": []} for h in html]
    return pd.DataFrame(rows, columns=["title", "raw", "tables"])


def parse_pages(df: DataFrame, html: str = "html") -> DataFrame:
    """Add title, text and tables of a web page."""
    return (
        df.withColumn("_p", _parse_pages(F.col(html)))
        .withColumn("title", F.col("_p.title"))
        .withColumn("text", text.normalise_text(F.col("_p.raw")))
        .withColumn("tables", F.col("_p.tables"))
        .drop("_p")
    )


def page_text_native(html: Column) -> Column:
    """Cheap text of a page with regular expressions only (no tables, no nesting)."""
    noise = "|".join(fv.NOISE_TAGS)
    block = "|".join(fv.BLOCK_TAGS)
    x = F.regexp_replace(html, rf"(?is)<({noise})\b[^>]*>.*?</\1\s*>", "")
    x = F.regexp_replace(x, r"(?s)<!--.*?-->", "")
    x = F.regexp_replace(x, rf"(?i)</?(?:{block}|br)\b[^>]*>", "\n")
    x = F.regexp_replace(x, r"<[^>]*>", "")
    for code, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"),
                       ("&nbsp;", " "), ("&amp;", "&")):
        x = F.replace(x, F.lit(code), F.lit(char))
    return text.normalise_text(x)


# --- plain text -------------------------------------------------------------


def parse_text(df: DataFrame, column: str = "text") -> DataFrame:
    """Normalise a text column; binary content is decoded with replacement."""
    c = F.col(column)
    if df.schema[column].dataType.simpleString() == "binary":
        c = c.cast("string")
    return df.withColumn(column, text.normalise_text(c))


# --- article XML ------------------------------------------------------------

_XLINK = "{http://www.w3.org/1999/xlink}href"


class _Keep(ET.TreeBuilder):
    """Tree builder that remembers its root, so a broken tail keeps the rest."""

    top = None

    def start(self, tag, attrs):
        made = super().start(tag, attrs)
        if self.top is None:
            self.top = made
        return made


def _words(e) -> str:
    return "" if e is None else " ".join(p.strip() for p in e.itertext() if p.strip())


def _article(source) -> dict:
    builder, error = _Keep(), None
    parser = ET.XMLParser(target=builder)
    try:
        parser.feed(source)
        parser.close()
    except ET.ParseError as problem:
        error = str(problem)
    root = builder.top
    if root is None:
        return {"parse_ok": False, "error": error or "no content", "tables": [], "captions": [],
                "supplements": [], "title": "", "abstract": "", "body": "", "doi": ""}
    title = root.find(".//article-title")
    title = root.find(".//title") if title is None else title
    body = root.find(".//body")
    paragraphs = [] if body is None else [e for e in body.iter() if e.tag in ("p", "title")]
    lines = lambda es: "\n".join(t for t in map(_words, es) if t)
    ids = [_words(e) for e in root.iter("article-id") if e.get("pub-id-type", "").lower() == "doi"]
    return {
        "title": _words(title),
        "abstract": lines([p for a in root.iter("abstract") for p in a.iter("p")]),
        "body": lines(paragraphs),
        "tables": [
            {
                "label": _words(w.find("label")), "caption": _words(w.find("caption")),
                "rows": [
                    r for r in (
                        [_words(c) for c in tr.iter() if c.tag in ("td", "th")] for tr in w.iter("tr")
                    ) if r
                ],
            }
            for w in root.iter("table-wrap")
        ],
        "captions": [t for t in (_words(f.find(".//caption")) for f in root.iter("fig")) if t],
        "supplements": [
            h for h in (s.get(_XLINK) or s.get("href") or "" for s in root.iter("supplementary-material")) if h
        ],
        "doi": next((i for i in ids if i), ""),
        "parse_ok": True, "error": None,
    }


_ARTICLE_FIELDS = ["title", "abstract", "body", "tables", "captions", "supplements", "doi",
                   "parse_ok", "error"]


@F.pandas_udf(schemas.ARTICLE)
def _parse_articles(xml: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_article(x or "") for x in xml], columns=_ARTICLE_FIELDS)


def parse_articles(df: DataFrame, xml: str = "xml") -> DataFrame:
    """Add the parts of an article and its full text in fixed order."""
    x = df.withColumn("_a", _parse_articles(F.col(xml)))
    for f in _ARTICLE_FIELDS:
        x = x.withColumn(f, F.col(f"_a.{f}"))
    parts = F.array(
        F.col("title"), F.col("abstract"), F.col("body"), text.tables_to_text(F.col("tables")),
        F.array_join("captions", "\n"),
    )
    full = F.array_join(F.filter(parts, lambda p: F.trim(F.translate(p, "\n\t", "  ")) != ""), "\n\n")
    return x.withColumn("full_text", full).drop("_a")


# --- delimited files --------------------------------------------------------


@F.pandas_udf(schemas.ROWS)
def _cells(body: pd.Series, sep: pd.Series) -> pd.Series:
    return pd.Series(
        [list(csv.reader(io.StringIO(b), delimiter=s)) if isinstance(b, str) else [] for b, s in zip(body, sep)]
    )


def _filled(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) != ""


def parse_delimited(df: DataFrame, body: str = "body", sep: str = ",", name: str = "sheet1") -> DataFrame:
    """Add header, rows, sheet_text and seq_columns of a delimited file.

    Rows and columns without any value are dropped.  A column holds sequences
    when its header says so or two in five of all its values, and at least two, look like one.
    """
    x = df.withColumn("_c", _cells(F.col(body), F.lit(sep)))
    header = F.get("_c", F.lit(0))
    data = F.filter(
        F.slice("_c", 2, F.greatest(F.size("_c") - 1, F.lit(0))), lambda r: F.exists(r, _filled)
    )
    x = x.withColumn("_h", header).withColumn("_d", data)
    used = F.filter(
        F.transform("_h", lambda h, j: j),
        lambda j: F.exists("_d", lambda r: _filled(F.get(r, j))),
    )
    x = x.withColumn("_j", F.coalesce(used, F.array().cast("array<int>")))
    pick = lambda r: F.transform("_j", lambda j: F.coalesce(F.get(r, j), F.lit("")))
    x = x.withColumn("header", pick(F.col("_h"))).withColumn("rows", F.transform("_d", pick))

    def holds(h, j):
        values = F.filter(F.transform("rows", lambda r: F.get(r, j)), _filled)
        hits = F.size(F.filter(values, lambda v: strip(v).rlike("(?i)" + fv.SEQ_COLUMN_CELL)))
        return h.rlike("(?i)" + fv.SEQ_COLUMN_HEADER) | ((hits >= 2) & (5 * hits >= 2 * F.size(values)))

    marked = F.transform("header", lambda h, j: F.struct(h.alias("h"), holds(h, j).alias("ok")))
    lines = F.concat(F.array(F.array_join("header", "\t")), F.transform("rows", lambda r: F.array_join(r, "\t")))
    return (
        x.withColumn("seq_columns", F.transform(F.filter(marked, lambda m: m["ok"]), lambda m: m["h"]))
        .withColumn("sheet_text", F.concat(F.lit(f"=== Sheet: {name} ===\n"), F.array_join(lines, "\n")))
        .drop("_c", "_h", "_d", "_j")
    )


# --- supplements ------------------------------------------------------------


def _fold(path: Column) -> Column:
    """A path without its "." and ".." segments, however many there are."""
    parts = F.split(path, "/")
    last = F.element_at(parts, -1)
    none = F.array().cast("array<string>")
    folded = F.aggregate(
        parts, none,
        lambda done, p: F.when(p == ".", done)
        .when(p == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))))
        .otherwise(F.concat(done, F.array(p))),
    )
    ended = F.when(last.isin(".", ".."), F.concat(folded, F.array(F.lit("")))).otherwise(folded)
    return F.regexp_replace(F.concat(F.lit("/"), F.array_join(ended, "/")), "^//", "/")


def resolve_url(href: Column, base: Column) -> Column:
    """Absolute address of a link relative to a base address (RFC 3986)."""
    origin = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1)
    own = F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(base, r"^[^?#]*(\?[^#]*)", 1)
    path = F.regexp_extract(href, r"^([^?#]*)", 1)
    rest = F.regexp_extract(href, r"^[^?#]*(.*)$", 1)
    folder = F.regexp_replace(F.concat(F.regexp_extract(own, r"^(.*)/[^/]*$", 1), F.lit("/")), "(?<=/)/+", "")
    joined = F.concat(folder, F.regexp_replace(path, "/+(?=.*/)", "/"))
    return (
        F.when(href.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(href == "", F.regexp_replace(base, "#.*$", ""))
        .when(href.startswith("//"), F.concat(scheme, href))
        .when(path == "", F.concat(origin, own, F.when(rest.startswith("?"), rest).otherwise(F.concat(query, rest))))
        .when(href.startswith("/"), F.concat(origin, _fold(path), rest))
        .otherwise(F.concat(origin, _fold(joined), rest))
    )


def file_extension(url: Column) -> Column:
    path = F.regexp_replace(url, r"[?#].*$", "")
    return F.lower(F.regexp_extract(path, r"[^./][^/]*(\.[^./]*)$", 1))


def _links(df: DataFrame, hrefs: str, base: str, keep: int | None, max_bytes: int | None) -> DataFrame:
    """Every link with pos (among the usable ones), url, ext and the reason why it is refused, if it is.

    Usable links are filtered first, so their place in that array is their number: one pass over the links of a row.
    """
    def judged(h):
        known = file_extension(h["href"]).isin(*fv.SUPPLEMENT_KEEP)
        reason = F.when(~known, "extension").when(~F.coalesce(h["ok"], F.lit(True)), "unreadable")
        if max_bytes is not None:
            reason = reason.when(F.coalesce(h["bytes"], F.lit(0)) > max_bytes, "size")
        return F.struct(h["href"].alias("href"), reason.alias("reason"))

    def numbered(links):
        late = (lambda i: F.lit(None).cast("string")) if keep is None else (lambda i: F.when(i >= keep, "limit"))
        good = F.filter(links, lambda h: h["reason"].isNull())
        bad = F.filter(links, lambda h: h["reason"].isNotNull())
        entry = lambda pos, h, reason: F.struct(pos.alias("pos"), h["href"].alias("href"), reason.alias("reason"))
        return F.concat(
            F.transform(good, lambda h, i: entry(i, h, late(i))),
            F.transform(bad, lambda h: entry(F.lit(None).cast("int"), h, h["reason"])),
        )

    rest = [c for c in df.columns if c != hrefs]
    links = df.select(*rest, F.explode(bind(F.transform(hrefs, judged), numbered)).alias("_h"))
    return links.select(
        *rest, F.col("_h.pos").alias("pos"), resolve_url(F.col("_h.href"), F.col(base)).alias("url"),
        file_extension(F.col("_h.href")).alias("ext"), F.col("_h.reason").alias("reason"),
    )


def select_supplements(
    df: DataFrame, hrefs: str = "hrefs", base: str = "base_url", keep: int | None = None, max_bytes: int | None = None
) -> DataFrame:
    """Wanted supplement links of a document, in order, as pos, url, ext.

    ``hrefs`` is array<struct<href, bytes, ok>>.  All links count unless ``keep`` or
    ``max_bytes`` is given; files that are too large or
    did not parse do not count towards the limit per document.
    """
    return _links(df, hrefs, base, keep, max_bytes).where("reason IS NULL").drop("reason")


def refused_supplements(
    df: DataFrame, hrefs: str = "hrefs", base: str = "base_url", keep: int | None = None, max_bytes: int | None = None
) -> DataFrame:
    """The other links, with the reason: extension, unreadable, size or limit."""
    return _links(df, hrefs, base, keep, max_bytes).where("reason IS NOT NULL").drop("pos")

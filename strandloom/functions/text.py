"""Column functions on document text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalise_text(c: Column) -> Column:
    """Runs of blanks and tabs to one blank, at most one empty line, trimmed."""
    one_blank = F.regexp_replace(c, "[ \\t]+", " ")
    return F.regexp_replace(
        F.regexp_replace(one_blank, "\\n{3,}", "\n\n"), r"(?U)^\s+|\s+$", ""
    )


def looks_garbled(c: Column, threshold: float = 0.3, min_words: int = 20) -> Column:
    """True when too many words are single characters (interleaved columns)."""
    words = F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")
    single = F.size(F.filter(words, lambda w: F.length(w) == 1))
    return (F.size(words) >= min_words) & (
        F.coalesce(F.try_divide(single, F.size(words)), F.lit(0.0)) > threshold
    )


def table_to_text(label: Column, caption: Column, rows: Column) -> Column:
    """Header line, tab-joined rows, closing blank line."""
    header = F.when(
        (F.coalesce(label, F.lit("")) != "") | (F.coalesce(caption, F.lit("")) != ""),
        F.concat(F.lit("["), F.coalesce(label, F.lit("")), F.lit("] "),
                 F.coalesce(caption, F.lit(""))),
    ).otherwise(F.lit("[Table]"))
    lines = F.transform(rows, lambda r: F.array_join(r, "\t"))
    return F.array_join(F.concat(F.array(header), lines, F.array(F.lit(""))), "\n")


def tables_to_text(tables: Column) -> Column:
    """An array<struct<label, caption, rows>> as one text."""
    return F.array_join(
        F.transform(tables, lambda t: table_to_text(t["label"], t["caption"], t["rows"])), "\n"
    )


def text_context(c: Column, start: Column, end: Column, window: int = 200) -> Column:
    """The match with ``window`` characters either side; … marks a cut end.

    ``start`` and ``end`` are 0-based, ``end`` exclusive.
    """
    lo = F.greatest(start - window, F.lit(0))
    hi = F.least(end + window, F.length(c))
    return F.concat(
        F.when(lo > 0, "…").otherwise(""),
        F.substring(c, lo + 1, hi - lo),
        F.when(hi < F.length(c), "…").otherwise(""),
    )


def keyword_gate(c: Column, pattern: str) -> Column:
    return F.coalesce(c.rlike("(?iU)" + pattern), F.lit(False))


def utc_stamp() -> Column:
    return F.date_format(
        F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'"
    )

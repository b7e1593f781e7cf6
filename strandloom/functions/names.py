"""Column functions on target names."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandloom import fixed_values as fv
from strandloom.functions.space import strip


def deep_norm(c: Column) -> Column:
    """Trim, lower case, one blank for any run of (Unicode) blanks."""
    squeezed = F.regexp_replace(F.lower(c), r"(?U)\s+", " ")
    return strip(squeezed)


def name_key(c: Column) -> Column:
    """Key of name lookups; a no-break space counts as a blank."""
    return deep_norm(c)


def contains_any(c: Column, parts) -> Column:
    """True when any of the literal parts occurs; one regex, one pass."""
    return c.rlike("|".join(re.escape(p) for p in parts))


def assign_tier(c: Column) -> Column:
    hit = contains_any(F.lower(c), fv.VALIDATION_TARGETS)
    return F.when(hit, 2).otherwise(1)


def is_non_protein(c: Column) -> Column:
    listed = F.lower(strip(c)).isin(*fv.NON_PROTEIN_EXCEPTIONS)
    hit = c.rlike("(?iU)" + "|".join(fv.NON_PROTEIN_PATTERNS))
    return F.coalesce(F.when(listed, False).otherwise(hit), F.lit(False))


def classify_clean(name: Column, protein_sequence: Column) -> Column:
    """Target class of the cleaning step."""
    n = strip(F.lower(name))
    return (
        F.when(F.length(protein_sequence) > 10, "protein")
        .when(name.isNull() | (strip(name) == ""), "other")
        .when(contains_any(n, fv.GARBAGE_PHRASES) | (n == "unknown"), "other")
        .when(n.isin(*fv.SMALL_MOLECULES), "small_molecule")
        .when(contains_any(n, fv.SMALL_MOLECULE_PARTS), "small_molecule")
        .when(contains_any(n, fv.ION_PARTS), "ion")
        .when(contains_any(n, fv.CELL_PARTS), "cell")
        .when(contains_any(n, fv.ORGANISM_PARTS), "organism")
        .otherwise("protein")
    )


def classify_rules(name: Column) -> Column:
    """Target class of the extraction step: first matching pattern wins."""
    out = F.when(name.isNull() | (strip(name) == ""), "other")
    for kind, pattern in fv.TARGET_TYPE_PATTERNS:
        out = out.when(name.rlike("(?iU)" + pattern), kind)
    return out.otherwise("protein")


def reclassify(name: Column) -> Column:
    n = F.lower(name)
    out = None
    for kind, parts in fv.RECLASSIFY_PARTS:
        hit = contains_any(n, parts)
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out.otherwise("small_molecule")


def matches_targets(c: Column, names) -> Column:
    """Either name inside the other, after lower-casing and _/- to blank.

    A NULL or blank name matches nothing; no names match nothing.
    """
    if not names:
        return F.lit(False)
    wanted = [re.sub("[_-]", " ", n.lower()) for n in names]
    text = F.translate(F.lower(c), "_-", "  ")
    hit = contains_any(text, wanted)
    for w in wanted:
        hit = hit | F.lit(w).contains(text)
    return F.coalesce((strip(text) != "") & hit, F.lit(False))


def strip_noise(c: Column) -> Column:
    tokens = F.regexp_extract_all(F.lower(c), F.lit(r"(?U)\b([\w-]+)\b"), F.lit(1))
    kept = F.filter(tokens, lambda t: (F.length(t) > 1) & ~t.isin(*fv.NOISE_WORDS))
    return F.array_join(kept, " ")


def word_set(c: Column) -> Column:
    return F.array_distinct(
        F.regexp_extract_all(F.lower(c), F.lit(r"(?U)\b(\w+)\b"), F.lit(1))
    )


def token_overlap(query: Column, other: Column) -> Column:
    q = word_set(query)
    shared = F.size(F.array_intersect(q, word_set(other)))
    return F.coalesce(F.try_divide(shared, F.size(q)), F.lit(0.0))


def confidence(source: Column, target: Column, kd: Column) -> Column:
    src, tgt = F.lower(source), F.lower(target)
    return (
        F.when(contains_any(tgt, fv.UNCERTAIN_PHRASES), "uncertain")
        .when(src == "li2014", "extracted")
        .when((src == "utexas") & kd.isNotNull(), "curated")
        .when(src.isin("utexas", "aptamerbase", "pubmed"), "extracted")
        .otherwise("non-curated")
    )


def map_values(c: Column, table: dict[str, str], default: str | None) -> Column:
    key = F.lower(strip(c))
    out = F.lit(default)
    for name, value in table.items():
        out = F.when(key == name, F.lit(value)).otherwise(out)
    return out


def format_source_id(c: Column, source: Column) -> Column:
    """DOI as it is, patent id as it is, a number as PMID:n."""
    s = strip(c)
    bare = strip(F.regexp_replace(s, "https://doi\\.org/", ""))
    digits = F.translate(s, ".", "")
    as_number = s.try_cast("double")
    return (
        F.when(c.isNull(), F.lit(None).cast("string"))
        .when(s.startswith("10.") | s.startswith("https://doi.org/"),
              F.when(bare.startswith("10."), bare).otherwise(s))
        .when((source == "patent") & ~digits.rlike("^[0-9]+$"), s)
        .when(as_number.isNotNull(), F.concat(F.lit("PMID:"), as_number.cast("bigint")))
        .otherwise(s)
    )


def pmid_from_url(c: Column) -> Column:
    return F.nullif(
        F.regexp_extract(c, r"pubmed\.ncbi\.nlm\.nih\.gov/(\d+)", 1), F.lit("")
    )


def pmid_prefix(c: Column) -> Column:
    return F.nullif(F.regexp_extract(strip(c), r"^(\d+)", 1), F.lit(""))

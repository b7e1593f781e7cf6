"""Rule-based extraction from text.

Conditions, assay, target and the plain affinity form are native expressions.
Exact character offsets need Python's own ``re``; those two extractors run as
Arrow-batched pandas UDFs that return arrays of structs.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom import fixed_values as fv
from strandloom import schemas
from strandloom.functions import measure, sequence, text
from strandloom.functions.bind import bind, once
from strandloom.functions.space import strip


def _first_number(c: Column, pattern: str) -> Column:
    return measure.group(c, "(?iU)" + pattern, 1).try_cast("double")


#: Of each pattern the plain words without which it can't match a text of ASCII characters, in lower case.
BUFFER_WORDS = {
    "PBS": ("pbs", "phosphate"), "HEPES": ("hepes",), "Tris": ("tris",), "SELEX": ("buffer",),
    "Sodium phosphate": ("sodium",), "other": ("buffer",),
}
ASSAY_WORDS = {
    "CE-SELEX": ("ce-selex", "capillary"), "Microfluidic SELEX": ("fluidic",), "Cell-SELEX": ("cell",),
    "Capture SELEX": ("capture",), "Toggle SELEX": ("toggle",),
    "Magnetic bead SELEX": ("magnetic", "bead-based", "macs-selex"), "SPR": ("spr", "surface", "biacore"),
    "ITC": ("itc", "isothermal"), "EMSA": ("emsa", "electrophoretic", "gel", "band"), "MST": ("mst", "microscale"),
    "BLI": ("bli", "layer", "octet"), "Nitrocellulose filter": ("filter",),
    "Fluorescence anisotropy": ("fluorescence", "fa"), "Flow cytometry": ("cytometry", "facs"),
    "SELEX": ("selex", "evolution"),
}


def _named(c: Column, patterns, words: dict[str, tuple[str, ...]]) -> Column:
    """Name of the first pattern that is found, else NULL.

    A plain search for its words comes before a pattern; only texts with other characters, where cases fold
    in more ways, are always matched.
    """
    folded, plain = F.lower(c), F.length(c) == F.octet_length(c)
    out = None
    for name, pattern in patterns:
        hit = c.rlike("(?iU)" + pattern)
        if name in words:
            hit = reduce(or_, [folded.contains(w) for w in words[name]], ~plain) & hit
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def _buffer_of(sentence: Column) -> Column:
    return _named(sentence, fv.BUFFER_PATTERNS, BUFFER_WORDS)


def with_conditions(df: DataFrame, column: str = "text", name: str = "c") -> DataFrame:
    """Add a struct of pH, Na, Mg, temperature, the two buffers and all buffers.

    Staged columns: every sentence is classified once and used by name after.
    """
    c = F.col(column)
    named = F.transform(
        F.split(c, "(?U)" + fv.SENTENCE_BREAK), lambda s: F.struct(_buffer_of(s).alias("buffer"), s.alias("s"))
    )
    found = F.transform(
        F.filter(named, lambda x: x["buffer"].isNotNull()),
        lambda x: F.struct(
            x["buffer"].alias("buffer"),
            x["s"].rlike("(?iU)" + fv.SELECTION_BUFFER).alias("sel"),
            x["s"].rlike("(?iU)" + fv.BINDING_BUFFER).alias("bind"),
        ),
    )

    def first(flag):
        return F.get(F.filter("_found", lambda s: s[flag]), F.lit(0))["buffer"]

    x = (
        df.withColumn("_found", found)
        .withColumns({
            "_ph": _first_number(c, fv.PH_TEXT), "_temp": _first_number(c, fv.TEMP_TEXT),
            "_sel": first("sel"), "_bind": first("bind"),
        })
    )
    default = F.when(
        F.col("_sel").isNull() & F.col("_bind").isNull(), F.get("_found", F.lit(0))["buffer"]
    )
    packed = F.struct(
        F.when(F.col("_ph").between(0.0, 14.0), F.col("_ph")).alias("ph"),
        F.coalesce(_first_number(c, fv.NA_TEXT), _first_number(c, fv.IONIC_TEXT)).alias("na"),
        _first_number(c, fv.MG_TEXT).alias("mg"),
        F.when(F.col("_temp").between(0.0, 100.0), F.col("_temp")).alias("temperature"),
        F.coalesce("_sel", default).alias("selection_buffer"),
        F.coalesce("_bind", default).alias("binding_buffer"),
        F.array_distinct(F.transform("_found", lambda s: s["buffer"])).alias("all_buffers"),
    )
    return x.withColumn(name, packed).drop("_found", "_ph", "_temp", "_sel", "_bind")


def extract_assay(c: Column) -> Column:
    return F.coalesce(_named(c, fv.ASSAY_PATTERNS, ASSAY_WORDS), F.lit(""))


def guess_target(c: Column) -> Column:
    phrase = strip(F.regexp_extract(c, "(?iU)" + fv.TARGET_PHRASE, 1))
    size = F.length(phrase)
    known = measure.group(c, "(?iU)" + fv.KNOWN_TARGETS, 1)
    return F.when((size > 3) & (size < 80), phrase).otherwise(
        F.coalesce(known, F.lit("unknown"))
    )


def kd_values_native(c: Column) -> Column:
    """Plain 'Kd = v unit' values in nM in text order, without offsets."""
    values = F.regexp_extract_all(c, F.lit("(?iU)" + fv.KD_TEXT), F.lit(1))
    units = F.regexp_extract_all(c, F.lit("(?iU)" + fv.KD_TEXT), F.lit(2))
    paired = F.arrays_zip(values.alias("v"), units.alias("u"))
    return F.filter(
        F.transform(
            paired,
            lambda p: measure.to_nanomolar(p["v"].try_cast("double"), p["u"], molar=True),
        ),
        lambda x: x.isNotNull(),
    )


def best_kd(hits: Column) -> Column:
    """A real Kd before IC50/EC50/Ki, then the smallest value, then the first."""
    ranked = F.transform(
        hits,
        lambda h, i: F.struct(
            F.when(h["measure_type"] == "kd", 0).otherwise(1).alias("rank"),
            h["value_nM"].alias("value"), i.alias("at"), h.alias("hit"),
        ),
    )
    return F.array_min(ranked)["hit"]


# --- offset-exact extraction (Arrow) ----------------------------------------

_SEQUENCE_FORMS = (
    ("rna_prime", re.compile(fv.SEQ_RNA_PRIME)),
    ("prime", re.compile(fv.SEQ_PRIME)),
    ("primary", re.compile(fv.SEQ_PRIMARY)),
    ("spaced", re.compile(fv.SEQ_SPACED)),
    ("rna", re.compile(fv.SEQ_RNA)),
)
_AFFINITY_FORMS = (
    ("plain", re.compile(fv.KD_TEXT, re.IGNORECASE)),
    ("power", re.compile(fv.KD_SCIENTIFIC, re.IGNORECASE)),
    ("proxy", re.compile(fv.KD_PROXY, re.IGNORECASE)),
)


def _spans(body: str, faithful: bool):
    """(form, start, end, is_rna) of every candidate, each span once."""
    taken = set()
    for form, pattern in _SEQUENCE_FORMS:
        for m in pattern.finditer(body):
            at, letters = m.span(1), re.sub("[ \t]", "", m.group(1)).upper()
            rna = "U" in letters
            if form == "rna_prime":
                if not rna and not faithful:
                    continue
                rna = True
            elif form == "rna" and not rna:
                continue
            elif form == "spaced" and not 20 <= len(letters) <= 120:
                continue
            if at not in taken:
                taken.add(at)
                yield form, at[0], at[1], rna


def _raw_sequences(bodies: pd.Series, faithful: bool) -> pd.Series:
    return bodies.map(
        lambda b: [
            {"raw": b[s:e], "start": s, "end": e, "pattern": form, "rna": rna}
            for form, s, e, rna in _spans(b, faithful)
        ]
        if isinstance(b, str) else []
    )


@F.pandas_udf(schemas.RAW_SEQUENCES)
def _find_sequences(bodies: pd.Series) -> pd.Series:
    return _raw_sequences(bodies, False)


@F.pandas_udf(schemas.RAW_SEQUENCES)
def _find_sequences_faithful(bodies: pd.Series) -> pd.Series:
    return _raw_sequences(bodies, True)


def extract_sequences(c: Column, valid_only: bool = True, faithful: bool = False) -> Column:
    """All sequences of a text as array<struct>, one per stored sequence.

    Python finds the spans; normalising, checking and context are native.
    ``faithful=True`` lets a 5'-…-3' string without U count as RNA.
    """
    found = (_find_sequences_faithful if faithful else _find_sequences)(c)
    return sequences_from(found, c, valid_only)


def _stored(h: Column) -> Column:
    """A raw hit as the sequence that is stored."""
    return F.when(h["rna"], F.translate(sequence.normalise_match(h["raw"], True), "T", "U")).otherwise(
        sequence.normalise_match(h["raw"])
    )


def sequence_rows(df: DataFrame, column: str, pos: str = "hit_no", name: str = "sequence") -> DataFrame:
    """A row with place and sequence for every valid sequence of the texts in ``column``, as ``extract_sequences`` has them.

    Hits are rows before they are checked, so the rules run on plain columns; places count the hits
    that are the first of their sequence, valid or not.
    """

    def firsts(hits):
        return bind(
            F.transform(hits, _stored),
            lambda n: F.filter(hits, lambda h, i: F.array_position(n, F.get(n, i)) == i + 1),
        )

    x = once(df, "_raw", _find_sequences(F.col(column)))
    hits = F.when(F.size("_raw") < 2, F.col("_raw")).otherwise(firsts(F.col("_raw")))
    x = x.select(*df.columns, F.posexplode(hits).alias(pos, "_h")).select(
        *df.columns, pos, F.col("_h.rna").alias("_rna"), F.explode_outer(F.array(_stored(F.col("_h")))).alias(name)
    )
    fault = F.when(F.col("_rna"), sequence.rna_fault(F.col(name), True)).otherwise(sequence.sequence_fault(F.col(name), normal=True))
    return once(x, "_fault", fault).where("_fault = ''").drop("_rna", "_fault")


def sequences_from(found: Column, c: Column, valid_only: bool = True) -> Column:
    """Spans that Python found in the text ``c`` as sequences."""
    packed = F.transform(
        found,
        lambda h: F.struct(
            _stored(h).alias("sequence"),
            h["raw"].alias("raw_match"), h["start"].alias("start"), h["end"].alias("end"),
            h["pattern"].alias("pattern"),
            F.when(h["rna"], "ssRNA").otherwise("ssDNA").alias("nucleic_acid_type"),
            text.text_context(c, h["start"], h["end"]).alias("context"),
        ),
    )
    checked = F.transform(
        packed,
        lambda h: h.withField(
            "fail_reason",
            F.when(h["nucleic_acid_type"] == "ssRNA", sequence.rna_fault(h["sequence"]))
            .otherwise(sequence.sequence_fault(h["sequence"])),
        ),
    )

    def firsts(hits):
        names = F.transform(hits, lambda h: h["sequence"])
        return bind(
            names,
            lambda n: F.filter(hits, lambda h, i: F.array_position(n, h["sequence"]) == i + 1),
        )

    out = F.transform(bind(checked, firsts), lambda h: h.withField("valid", h["fail_reason"] == ""))
    return F.filter(out, lambda h: h["valid"]) if valid_only else out


def _affinities(body: str):
    for form, pattern in _AFFINITY_FORMS:
        for m in pattern.finditer(body):
            if form == "plain":
                kind, value, unit = "kd", float(m.group(1)), m.group(2)
                scale = fv.UNIT_TO_NM_WITH_MOLAR.get(unit.lower())
                nm = None if scale is None else float(f"{value * scale:.4g}")
            elif form == "power":
                kind, value, power = "kd", float(m.group(1)), int(m.group(2))
                unit, nm = "nM", value * 10.0 ** power * 1e9
            else:
                kind, value, unit = m.group(1).lower(), float(m.group(2)), m.group(3)
                scale = fv.UNIT_TO_NM.get(unit.lower())
                nm = None if scale is None else float(f"{value * scale:.4g}")
            if nm is not None:
                yield kind, nm, value, unit, m.start(), m.end()


@F.pandas_udf(schemas.RAW_AFFINITIES)
def _find_affinities(bodies: pd.Series) -> pd.Series:
    keys = ("measure_type", "value_nM", "original_value", "original_unit", "start", "end")
    return bodies.map(
        lambda b: [dict(zip(keys, hit)) for hit in _affinities(b)] if isinstance(b, str) else []
    )


@F.pandas_udf(schemas.RAW_HITS)
def _find_hits(bodies: pd.Series) -> pd.DataFrame:
    keys = ("measure_type", "value_nM", "original_value", "original_unit", "start", "end")
    return pd.DataFrame({
        "sequences": _raw_sequences(bodies, False),
        "affinities": bodies.map(lambda b: [dict(zip(keys, hit)) for hit in _affinities(b)] if isinstance(b, str) else []),
    })


def with_hits(df: DataFrame, column: str = "text", name: str = "hits") -> DataFrame:
    """Add the raw sequences and affinities of a text, found in one pass of one Arrow batch.

    ``sequences_from`` and ``affinities_from`` make them up; the column stands behind a
    generator, so no filter or projection above evaluates Python again.
    """
    return once(df, name, _find_hits(F.col(column)))


def extract_kd(c: Column, deduplicate: bool = True) -> Column:
    """All affinities of a text as array<struct>; the unit stored is canonical."""
    return affinities_from(_find_affinities(c), c, deduplicate)


def affinities_from(raw: Column, c: Column, deduplicate: bool = True) -> Column:
    """Spans that Python found in the text ``c`` as affinities."""
    found = F.transform(
        raw,
        lambda h: h.withField(
            "canonical_unit",
            F.coalesce(measure.canonical_unit(h["original_unit"]), F.lit("nM")),
        ).withField("context", text.text_context(c, h["start"], h["end"])),
    )
    if not deduplicate:
        return found

    def distinct(hits):
        keys = F.transform(
            hits,
            lambda h: F.struct(F.round(h["value_nM"], 6).alias("v"), h["measure_type"].alias("m")),
        )
        return bind(
            keys, lambda k: F.filter(hits, lambda h, i: F.array_position(k, F.get(k, i)) == i + 1)
        )

    return bind(found, distinct)

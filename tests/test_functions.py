"""Golden cases of the column functions and extractors."""

import pytest
from pyspark.sql import functions as F

from strandloom import fixed_values as fv
from strandloom.functions import extract, measure, names, sequence, text


def values(spark, rows, column, schema="x string"):
    df = spark.createDataFrame([(r,) if not isinstance(r, tuple) else r for r in rows], schema)
    return [r[0] for r in df.coalesce(1).select(column.alias("v")).collect()]


def test_sequence_rules(spark):
    long_run = "ACGTACGTACGT" + "A" * 9 + "CGT"
    cases = {
        None: "not_a_string",
        "ACGT" * 4: "too_short (16 < 20)",
        "ACGT" * 5: "",
        "ACGT" * 30: "",
        "ACGT" * 30 + "A": "too_long (121 > 120)",
        "ACGT" * 5 + "XN": "invalid_bases (N,X)",
        "AT" * 17 + "ATATGC": "gc_too_low (0.05 < 0.2)",
        "A" * 7 + "T" * 7 + "A" * 7 + "T" * 7 + "A" * 7 + "GCGCG": "gc_too_low (0.12 < 0.2)",
        "GC" * 15: "gc_too_high (1.00 > 0.8)",
        long_run: "homopolymer_run (>8 identical bases)",
        long_run.replace("A" * 9, "A" * 7): "",
        "  acgtacgtacgtacgtacgt ": "",
    }
    assert values(spark, list(cases), sequence.sequence_fault(F.col("x"))) == list(cases.values())


def test_tokens_round_trip(spark):
    seq = "ACGTTGCAACGGTTAACCGG"
    ids = values(spark, [seq], sequence.kmer_tokens(F.col("x")))[0]
    order = sorted(a + b + c for a in "ACGT" for b in "ACGT" for c in "ACGT")
    assert ids == [order.index(seq[i:i + 3]) + 2 for i in range(len(seq) - 2)]
    assert values(spark, ["ACN", "AC", ""], sequence.kmer_tokens(F.col("x"))) == [[1], [], []]
    padded = values(spark, [seq], sequence.kmer_tokens_padded(F.col("x")))[0]
    assert len(padded) == 120 and padded[len(ids):] == [0] * (120 - len(ids))
    assert values(spark, [seq], sequence.kmer_decode(sequence.kmer_tokens_padded(F.col("x")))) == [seq]


def test_decoding_of_unknown_short_and_long_rows(spark):
    decoded = sequence.kmer_decode(sequence.kmer_tokens_padded(F.col("x")))
    rows = ["ACGNACG", "ACN", "AC", "", None, "ACGT" * 40]
    assert values(spark, rows, decoded) == ["A[[[ACG", "[UNK]", "", "", "", ("ACGT" * 40)[:122]]


def test_scramble_keeps_composition(spark):
    seq = "AACCGGTTACGTACGTAAAA"
    got = values(spark, [(seq, 7)], sequence.scramble(F.col("x"), F.col("k")), "x string, k int")[0]
    assert sorted(got) == sorted(seq) and got != seq


@pytest.mark.parametrize("value,unit,want", [
    (5.2, "nM", 5.2), (0.015, "µM", 15.0), (3.0, "uM", 3000.0), (250.0, "pM", 0.25), (2.0, "mM", 2e6),
    (12345.0, "nM", 12340.0), (0.0, "nM", 0.0), (-1.0, "nM", None), (1.0, "kg", None),
])
def test_kd_convert(spark, value, unit, want):
    got = values(spark, [(value, unit)], measure.kd_convert(F.col("v"), F.col("u"))["value_nM"], "v double, u string")[0]
    assert got == (pytest.approx(want) if want is not None else None)


def test_kd_text_forms(spark):
    cases = {
        "binds with Kd = 5.2 nM.": [("kd", 5.2)],
        "KD of 47 ± 3 nM here": [("kd", 47.0)],
        "kd: 0.5 µM": [("kd", 500.0)],
        "Kd was 10 nM": [("kd", 10.0)],
        "Kd = 2.3e-9 M in buffer": [("kd", 2.3)],
        "Kd = 2.3 × 10^-9 M in buffer": [("kd", 2.3)],
        "IC50 = 12 nM and Ki of 3 uM": [("ic50", 12.0), ("ki", 3000.0)],
        "Kd = 5 nM, again Kd = 5 nM": [("kd", 5.0)],
        "no value": [],
    }
    got = values(spark, list(cases), extract.extract_kd(F.col("x")))
    for hits, want in zip(got, cases.values()):
        assert [(h.measure_type, pytest.approx(h.value_nM)) for h in hits] == want
    units = [h.canonical_unit for hits in got for h in hits]
    assert set(units) <= {"nM", "µM"}


def test_sequence_text_forms(spark):
    dna, rna = "GGTTGGTGTGGTTGGACGTA", "GGUUGGUGUGGUUGGACGUA"
    cases = {
        f"the 5'-{dna}-3' oligo": [(dna, "prime", "ssDNA")],
        f"run {dna.lower()} inside": [(dna, "primary", "ssDNA")],
        f"blocks {dna[:10]} {dna[10:]} end": [(dna, "spaced", "ssDNA")],
        f"rna {rna} end": [(rna, "rna", "ssRNA")],
        f"5'-{rna}-3'": [(rna, "rna_prime", "ssRNA")],
        f"{dna}, then {dna}": [(dna, "primary", "ssDNA")],
        "ACGTACGT is short": [],
    }
    got = values(spark, list(cases), extract.extract_sequences(F.col("x")))
    assert [[(h.sequence, h.pattern, h.nucleic_acid_type) for h in hits] for hits in got] == list(cases.values())
    first = got[0][0]
    body = next(iter(cases))
    assert body[first.start:first.end] == dna and first.context == body
    plain = ["5'-GGAGGAGCAGGAGGACGAAC-3'"]  # neither T nor U
    assert values(spark, plain, extract.extract_sequences(F.col("x")))[0][0].nucleic_acid_type == "ssDNA"
    faithful = values(spark, plain, extract.extract_sequences(F.col("x"), faithful=True))[0]
    assert faithful[0].nucleic_acid_type == "ssRNA"


def test_conditions(spark):
    body = ("Selected in selection buffer PBS (pH 7.4) with 150 mM NaCl and 5 mM MgCl2. "
            "The binding buffer was Tris-HCl at 25 °C, overnight.")
    df = spark.createDataFrame([(body,), ("plain words",)], "text string")
    a, b = [r.c for r in extract.with_conditions(df).collect()]
    assert (a.ph, a.na, a.mg, a.temperature) == (7.4, 150.0, 5.0, 25.0)
    assert (a.selection_buffer, a.binding_buffer, a.all_buffers) == ("PBS", "Tris", ["PBS", "Tris"])
    assert b.ph is None and b.selection_buffer is None and b.all_buffers == []


def test_assay_and_target(spark):
    assert values(
        spark, ["by Biacore", "cell-SELEX then SPR", "a gel shift assay", "SELEX", "none"],
        extract.extract_assay(F.col("x")),
    ) == ["SPR", "Cell-SELEX", "EMSA", "SELEX", ""]
    assert values(
        spark, ["An aptamer for human lysozyme, in serum", "binds VEGF well", "nothing"],
        extract.guess_target(F.col("x")),
    ) == ["human lysozyme", "VEGF", "unknown"]


def test_target_classes(spark):
    cases = {"HeLa cells": "cell", "HIV-1 reverse transcriptase": "protein", "HIV virion": "organism",
             "Pb2+": "ion", "ochratoxin A": "toxin", "cocaine": "small_molecule",
             "angiotensin": "peptide", "thrombin": "protein", " ": "other", None: "other"}
    assert values(spark, list(cases), names.classify_rules(F.col("x"))) == list(cases.values())
    clean = {"ochratoxin A": "small_molecule", "Pb2+": "ion", "platelet": "cell",
             "Salmonella typhi": "organism", "use according to": "other", "unknown": "other", "VEGF": "protein"}
    assert values(spark, list(clean), names.classify_clean(F.col("x"), F.lit(None).cast("string"))) == list(clean.values())
    flags = {"GTP": True, "GTP-binding protein": False, "vitamin B6": True, "thrombin": False, None: False}
    assert values(spark, list(flags), names.is_non_protein(F.col("x"))) == list(flags.values())


def test_target_matching(spark):
    cases = ["human serum albumin", "Troponin-I", "", None, "myo", "VEGF"]
    got = values(spark, cases, names.matches_targets(F.col("x"), ["albumin", "troponin_i", "myoglobin"]))
    assert got == [True, True, False, False, True, False]
    assert values(spark, cases, names.matches_targets(F.col("x"), [])) == [False] * 6


def test_text_helpers(spark):
    assert values(spark, ["a  b\t c\n\n\n\nd  "], text.normalise_text(F.col("x"))) == ["a b c\n\nd"]
    assert values(spark, ["a b c d e " * 5, "many longer words " * 10, "a b"], text.looks_garbled(F.col("x"))) == [True, False, False]
    assert values(spark, ["x" * 300], text.text_context(F.col("x"), F.lit(250), F.lit(260)))[0] == "…" + "x" * 250
    assert values(spark, ["Name   x "], names.name_key(F.col("x"))) == ["name x"]


def test_source_ids(spark):
    rows = [("12345", "pubmed"), ("12345.0", "li2014"), ("https://doi.org/10.1/x", "pubmed"),
            ("US123B2", "patent"), (None, "patent"), ("free text", "pubmed")]
    got = values(spark, rows, names.format_source_id(F.col("a"), F.col("b")), "a string, b string")
    assert got == ["PMID:12345", "PMID:12345", "10.1/x", "US123B2", None, "free text"]


def test_fixed_values_are_consistent():
    assert len(fv.LEGACY_COLUMNS) == 17 and len(fv.RECORD_COLUMNS) == 20 and len(fv.CLEANED_COLUMNS) == 23
    assert set(fv.REQUIRED) <= set(fv.RECORD_COLUMNS)

"""Explicit schemas of the tables this package reads and writes."""

from __future__ import annotations

from pyspark.sql import types as T

from strandloom import fixed_values as fv


def _struct(names, special):
    return T.StructType(
        [T.StructField(n, special.get(n, T.StringType()), True) for n in names]
    )


LEGACY = _struct(
    fv.LEGACY_COLUMNS,
    {
        "Kd_nM": T.DoubleType(), "pH": T.DoubleType(), "salt_mM": T.DoubleType(),
        "temp_C": T.DoubleType(), "mg_mM": T.DoubleType(), "buffer_type": T.IntegerType(),
        "label": T.IntegerType(), "training_tier": T.IntegerType(),
        "augmented": T.BooleanType(), "needs_sequence_enrichment": T.BooleanType(),
    },
)

_NUMERIC = {n: T.DoubleType() for n in fv.RECORD_NUMERIC}
RECORD = _struct(fv.RECORD_COLUMNS, _NUMERIC)
RECORD_TEXT = _struct(fv.RECORD_COLUMNS, {})
CLEANED = _struct(
    fv.CLEANED_COLUMNS,
    {**_NUMERIC, "label": T.IntegerType(), "training_tier": T.IntegerType()},
)

PAIRS = T.StructType(
    [
        T.StructField("idx_a", T.LongType()), T.StructField("idx_b", T.LongType()),
        T.StructField("seq_a", T.StringType()), T.StructField("seq_b", T.StringType()),
        T.StructField("target_a", T.StringType()), T.StructField("target_b", T.StringType()),
        T.StructField("label_a", T.IntegerType()), T.StructField("label_b", T.IntegerType()),
        T.StructField("split_a", T.StringType()), T.StructField("split_b", T.StringType()),
        T.StructField("levenshtein_dist", T.IntegerType()),
        T.StructField("cross_split", T.BooleanType()),
    ]
)

PROVENANCE = T.StructType(
    [
        T.StructField("aptamer_sequence", T.StringType()),
        T.StructField("target_name", T.StringType()),
        T.StructField("source_url", T.StringType()),
        T.StructField("source_type", T.StringType()),
        T.StructField("extraction_method", T.StringType()),
        T.StructField("byte_offset", T.LongType()),
        T.StructField("source_file_hash", T.StringType()),
        T.StructField("raw_text_context", T.StringType()),
        T.StructField("extraction_timestamp", T.StringType()),
        T.StructField("extra", T.MapType(T.StringType(), T.StringType())),
    ]
)



def _hits(*fields):
    return T.ArrayType(T.StructType([T.StructField(n, t) for n, t in fields]))


_TEXT, _INT, _REAL = T.StringType(), T.IntegerType(), T.DoubleType()
ROWS = T.ArrayType(T.ArrayType(_TEXT))

# spans found by the offset-exact extractors
RAW_SEQUENCES = _hits(
    ("raw", _TEXT), ("start", _INT), ("end", _INT), ("pattern", _TEXT), ("rna", T.BooleanType())
)
RAW_AFFINITIES = _hits(
    ("measure_type", _TEXT), ("value_nM", _REAL), ("original_value", _REAL),
    ("original_unit", _TEXT), ("start", _INT), ("end", _INT),
)
RAW_HITS = T.StructType(
    [T.StructField("sequences", RAW_SEQUENCES), T.StructField("affinities", RAW_AFFINITIES)]
)
PAGE = T.StructType(
    [
        T.StructField("title", _TEXT), T.StructField("raw", _TEXT),
        T.StructField("tables", T.ArrayType(ROWS)),
    ]
)
ARTICLE = T.StructType(
    [
        T.StructField("title", _TEXT), T.StructField("abstract", _TEXT), T.StructField("body", _TEXT),
        T.StructField("tables", _hits(("label", _TEXT), ("caption", _TEXT), ("rows", ROWS))),
        T.StructField("captions", T.ArrayType(_TEXT)),
        T.StructField("supplements", T.ArrayType(_TEXT)),
        T.StructField("doi", _TEXT), T.StructField("parse_ok", T.BooleanType()),
        T.StructField("error", _TEXT),
    ]
)
STRUCTURE_FEATURES = T.StructType(
    [
        T.StructField("sequence", T.StringType()), T.StructField("mfe", T.DoubleType()),
        T.StructField("structure", T.StringType()), T.StructField("stem_count", T.IntegerType()),
        T.StructField("loop_count", T.IntegerType()),
        T.StructField("bp_prob_mean", T.DoubleType()),
        T.StructField("bp_prob_max", T.DoubleType()),
    ]
)

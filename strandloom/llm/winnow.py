"""Document fingerprints by winnowing, in column expressions only.

A text is a row of tokens; every run of ``k`` tokens is hashed; in every window of ``w`` hashes
in a row the least one is selected, the rightmost of equal ones, with its
position (Schleimer, Wilkerson, Aiken, SIGMOD 2003).  Any ``k + w - 1`` tokens in a row
that two documents share give them a common hash.

A token is a run of up to 16 characters that are not blank, or one character of a script
that is written without blanks.  So any text has tokens of bounded size, and there are about a fifth as many as
characters.  Longer runs are cut every 16 characters from their start: a passage inside such a run (base64, long addresses,
minified code, scripts without blanks that are not in WIDE) that starts elsewhere in the run of another document gives other tokens
and need not be found.  A hash has 32 bits and is packed with its position into one number, so the
minimum of plain numbers chooses the rightmost of ties.  The minimum over a
window doubles its width in every step.

A text of fewer than ``k`` tokens is one run; null texts and texts without tokens have no
hashes.  Positions reach to 2^31, more than a text can hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.llm.text import let
from strandloom.operators.skew import global_rank

K = 3
W = 8
LOW = (1 << 31) - 1
#: Scripts written without blanks: Thai, Lao, Burmese, Khmer, kana, Han.
WIDE = (
    r"\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u3040-\u30FF\u3400-\u4DBF\u4E00-\u9FFF\uF900-\uFAFF\x{20000}-\x{3FFFF}"
)
TOKEN = rf"[^\x20\x09-\x0D{WIDE}]{{1,16}}+|[{WIDE}]"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def _packed_grams(text: Column, k: int) -> Column:
    """Hash in the high 32 bits, distance of the position from the end of the range in the low 31."""
    low, high = F.lit(LOW).cast("long"), F.lit(0xFFFFFFFF).cast("long")

    def grams(t: Column) -> Column:
        def gram(_, i: Column) -> Column:
            h = F.xxhash64(*[F.get(t, i + j) for j in range(k)])
            return F.shiftleft(h.bitwiseAND(high), 31).bitwiseOR(low - i)

        full = F.slice(t, F.lit(1), F.greatest(F.size(t) - (k - 1), F.lit(1)))
        return F.transform(full, gram)

    return let(F.transform(tokens(text), lambda x: F.xxhash64(x)), grams)


def _minima(packed: Column, w: int) -> Column:
    """Distinct minima over all windows of w in a row (one window if there are fewer)."""
    def shifted(by: int):
        return lambda m: F.transform(m, lambda x, i: F.least(x, F.get(m, i + by)))

    out, width = packed, 1
    while width < w:
        step = min(width, w - width)
        out = let(out, shifted(step))
        width += step
    full = let(out, lambda m: F.slice(m, F.lit(1), F.greatest(F.size(m) - (w - 1), F.lit(1))))
    return F.array_distinct(full)


def winnow(text: Column, k: int = K, w: int = W) -> Column:
    """array<struct<hash: long, pos: int>> of the selected runs, in order of position."""
    text = F.coalesce(text, F.lit(""))
    few = let(_packed_grams(text, k), lambda p: F.when(
        F.size(p) > w, _minima(p, w)
    ).when(F.size(p) > 0, F.array(F.array_min(p))).otherwise(p))
    return F.transform(few, lambda p: F.struct(
        F.shiftright(p, 31).alias("hash"), (F.lit(LOW).cast("long") - p.bitwiseAND(F.lit(LOW).cast("long"))).cast("int").alias("pos")
    ))


def digest(prints: Column) -> Column:
    """Hashes of ``hashes`` in order, eight hex digits each: equal for equal texts."""
    return F.array_join(F.transform(prints, lambda p: F.lpad(F.lower(F.hex(p.cast("long") + (1 << 31))), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness of two arrays of hashes; two empty ones are alike."""
    return let(F.size(F.array_intersect(a, b)), lambda both: let(
        F.size(F.array_distinct(a)) + F.size(F.array_distinct(b)) - both,
        lambda all_: F.when(all_ == 0, F.lit(1.0)).otherwise(both / F.greatest(all_, F.lit(1))),
    ))


def hashes(text: Column, k: int = K, w: int = W) -> Column:
    """The selected hashes alone, moved into the range of int."""
    return F.transform(winnow(text, k, w), lambda p: (p["hash"] - (1 << 31)).cast("int"))


def neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, bool]:
    """(key, next_key, need) of every distinct id, and whether ids repeat.

    The last id is followed by the first.  ``need`` is a quarter of the length of the longest text of an id.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    need = docs.groupBy(F.col(id_col).alias("id")).agg(
        F.max(F.floor(F.length(text) / 4)).cast("int").alias("need"), F.count(F.lit(1)).alias("rows")
    )
    ranked = global_rank(need, [F.col("id").asc_nulls_first()])
    whole = ranked.agg(F.count(F.lit(1)).alias("n"), F.max("rows").alias("most")).first()
    after = ranked.select((F.col("rank") - 1).alias("r"), _key("id").alias("next_key"))
    pairs = ranked.withColumn("r", F.col("rank") % max(1, whole["n"])).join(after, "r")
    return pairs.select(_key("id").alias("this_key"), "next_key", "need"), (whole["most"] or 0) > 1


def _key(name: str) -> Column:
    """Ids as a key without nulls."""
    return F.coalesce(F.col(name).cast("string"), F.lit("null"))


def compare_with_edit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, w: int = W) -> DataFrame:
    """Hashes of every text, of its edited text and of the next document.

    The edited text has its last quarter replaced by the start of the text of the next id.  If
    that id has several rows, the least start is taken.  A text is hashed once, before it
    moves to its neighbour, and goes through one shuffle that serves both sides.
    """
    pairs, repeated = neighbours(docs, id_col, text_col)
    kind = docs.schema[id_col].dataType
    rows = docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    ).select("text", _key("id").alias("key"), hashes(F.col("text"), k, w).alias("prints"))
    given = rows.join(pairs, F.col("key") == F.col("next_key")).select(
        "this_key", F.substring(F.col("text"), F.lit(1), F.col("need")).alias("head"),
        F.col("prints").alias("next_prints"),
    )
    if repeated:
        given = given.groupBy("this_key").agg(F.min(F.struct("head", "next_prints")).alias("g")).select("this_key", "g.*")
    cut = F.floor(F.length("text") / 4).cast("int")
    edited = F.concat(
        F.substring(F.col("text"), F.lit(1), F.length("text") - cut), F.substring(F.col("head"), F.lit(1), cut)
    )
    own_id = F.when(F.col("key") != "null", F.col("key")).cast(kind).alias("id")
    return rows.join(given, F.col("key") == F.col("this_key")).select(
        own_id, F.length("text").cast("long").alias("n_chars"), "prints", "next_prints", edited.alias("edited")
    ).withColumn("edited_prints", hashes(F.col("edited"), k, w))

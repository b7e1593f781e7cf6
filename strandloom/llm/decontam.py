"""Benchmark decontamination by winnowing.

A window is ``length`` consecutive words of an item, or all words of a shorter item.  Of every
window the least hash of its k-word grams is kept (the rightmost of equal ones), k = 8 or the window's
length if that is less.  A document keeps the least hash of as many neighbouring grams as the
shortest window has, so whatever it shares with a window, both keep the same hash at the same place: every shared
window is found.  Training and test fingerprints are joined on the hash; a hit is then
extended to the whole window, and counts only if the window's words are equal, word for word.

Documents are read once.  Their fingerprints pass a bitmap of the test fingerprints first (16 bits each, 256 MB at
most), so few go through the join; the bitmap decides cost, not results.  The words around a fingerprint
travel with it, so no text is fetched again.

A window meets one row of the table of different windows, and windows with the same set of items share a group,
so a passage in a third of all documents and of all items is not expanded into pairs.  Items are
listed once for each different set of groups.  A list of items is as long as it is: it and the
windows of one document are the only things gathered in one place.

Null and empty texts have no words and no windows.  Equal rows and rows without id are rows of their own.  An item
without id marks documents but is in no list; items of one id are one item.  Empty tables
give no rows, or rows without hits.  Texts of any length are cut into words block by block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.llm import runs
from strandloom.llm.store import stored

LENGTH = 10  # words of a window
GRAM = 8  # words of a gram

#: ASCII digits and letters, and everything outside ASCII.
IN_WORD = runs.byte_set(lambda b: 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128)

CANDIDATE = "array<struct<hash: long, pos: int, before: int, words: string>>"


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of every k neighbouring words, from the hashes of the words."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, k, np.uint64)
    for j in range(k):
        out = out * np.uint64(0xD6E8FEB86659FD93) + words[j:j + n]
    return runs.mix(out)


def least(values: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` neighbouring values the place of the least, the rightmost of equal ones."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best, at = values[width - 1:].copy(), np.full(n, width - 1)
    for j in range(width - 2, -1, -1):
        less = values[j:j + n] < best
        best[less] = values[j:j + n][less]
        at[less] = j
    return np.arange(n) + at


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, starts, ends and hashes of all words, and the number of words before each text."""
    data, offsets = runs.buffer(texts)
    starts, ends = runs.find(data, offsets, IN_WORD)
    return data, starts, ends, runs.hashes(data, starts, ends), np.searchsorted(starts, offsets)


def _text(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lo: int, hi: int) -> str:
    """Words lo to hi in lower case, joined by blanks."""
    raw = runs.FOLD[data[starts[lo]:ends[hi - 1]]].tobytes()
    base = starts[lo]
    return b" ".join(raw[s - base:e - base] for s, e in zip(starts[lo:hi], ends[lo:hi])).decode("utf-8", "replace")


def _item_windows(length: int):
    """Map (item, text) to (item, text of the window, n words, off, hash): one row for each window."""

    def windows(texts: pa.Array) -> Iterator[tuple]:
        data, starts, ends, hashed, first = _words(texts)
        for i in range(len(texts)):
            lo, hi = int(first[i]), int(first[i + 1])
            n = min(length, hi - lo)
            if n:
                k = min(GRAM, n)
                values = grams(hashed[lo:hi], k)
                at = least(values, n - k + 1)
                for s, p in enumerate(at):
                    yield i, _text(data, starts, ends, lo + s, lo + s + n), n, int(p) - s, int(runs.signed(values[p:p + 1])[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items, texts = batch.column(0), batch.column(1)
            for lo, hi in runs.slices(texts):
                found = list(windows(texts.slice(lo, hi - lo)))
                for a in range(0, len(found), 50_000):
                    some = list(zip(*found[a:a + 50_000]))
                    yield pa.RecordBatch.from_arrays(
                        [items.slice(lo, hi - lo).take(pa.array(some[0])), pa.array(some[1], pa.string()),
                         pa.array(some[2], pa.int32()), pa.array(some[3], pa.int32()), pa.array(some[4], pa.int64())],
                        names=["item", "window", "n", "off", "hash"])

    return run


def item_windows(items: DataFrame, id_col: str, text_col: str, length: int = LENGTH) -> DataFrame:
    """(item, window, n, off, hash), each once: off is the place of the fingerprint in the window of n words."""
    schema = "item string, window string, n int, off int, hash long"
    return items.select(F.col(id_col).cast("string"), F.col(text_col).cast("string")).mapInArrow(
        _item_windows(length), schema
    ).distinct()


def _scan(lengths: list[int], shared, bits: int):
    """Map (row, id, text) to (row, id, n_words, candidates): fingerprints that the bitmap of test fingerprints has."""
    plan = {}  # words of a gram -> (grams in the shortest window, words in the longest)
    for n in lengths:
        k = min(GRAM, n)
        w, longest = plan.get(k, (n - k + 1, n))
        plan[k] = min(w, n - k + 1), max(longest, n)

    def candidates(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
        data, starts, ends, hashed, first = _words(texts)
        owner = np.repeat(np.arange(len(texts)), np.diff(first))
        found = []
        for k, (w, longest) in plan.items():
            values = grams(hashed, k)
            span = w + k - 1  # words under one window
            if len(hashed) < span:
                continue
            at = np.unique(least(values, w)[owner[:len(owner) - span + 1] == owner[span - 1:]])
            at = at[runs.in_bitmap(shared.value, bits, values[at])]
            for p, h in zip(at.tolist(), runs.signed(values[at]).tolist()):
                i = owner[p]
                lo, hi = max(int(first[i]), p - (longest - k)), min(int(first[i + 1]), p + longest)
                found.append((i, {"hash": h, "pos": p - int(first[i]), "before": p - lo, "words": _text(data, starts, ends, lo, hi)}))
        found.sort(key=lambda x: (x[0], x[1]["pos"]))
        sizes = np.bincount(np.array([i for i, _ in found], np.int64), minlength=len(texts))
        kind = pa.struct([("hash", pa.int64()), ("pos", pa.int32()), ("before", pa.int32()), ("words", pa.string())])
        ends_ = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        return np.diff(first), pa.ListArray.from_arrays(pa.array(ends_), pa.array([x for _, x in found], kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2)
            for lo, hi in runs.slices(texts):
                n, found = candidates(texts.slice(lo, hi - lo))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(n.astype(np.int64)), found],
                    names=["row", "id", "n_words", "candidates"])

    return run


def hits(docs: DataFrame, windows: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Rows (row, id, n_words) of all documents, and hits (row, start, n, window): equal windows of a test item."""
    spark = docs.sparkSession
    prints = stored(windows.select("hash", "n", "off").distinct())
    lengths = [r["n"] for r in prints.select("n").distinct().collect()]  # at most ``length`` numbers
    bitmap, bits = runs.make_bitmap(prints, "hash", prints.count())
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("row", T.LongType()), T.StructField("id", kind), T.StructField("n_words", T.LongType()),
                           T.StructField("candidates", T.DataType.fromDDL(CANDIDATE))])
    scanned = stored(docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")
    ).mapInArrow(_scan(lengths, spark.sparkContext.broadcast(bitmap), bits), schema))
    at = F.col("before") - F.col("off")
    fits = (at >= 0) & (at + F.col("n") <= F.size("w"))
    met = scanned.select("row", F.explode("candidates").alias("c")).select("row", "c.*").join(prints, "hash")
    extended = met.select("row", "before", "off", "n", (F.col("pos") - F.col("off")).alias("start"), F.split("words", " ").alias("w")).select(
        "row", "start", "n",  # slice() fails at a place before the first, and filters may be moved behind it
        F.when(fits, F.array_join(F.slice("w", F.greatest(at + 1, F.lit(1)), F.col("n")), " ")).alias("window"),
    ).where("window IS NOT NULL").distinct()
    return scanned.select("row", "id", "n_words"), extended.join(windows.select("window").distinct(), "window")


def _covered(spans) -> F.Column:
    """How many words the spans (start, n) of one document cover together."""
    none = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))

    def add(acc, x):
        end = F.greatest(acc["end"], x["start"] + x["n"])
        return F.struct(end.alias("end"), (acc["n"] + end - F.greatest(acc["end"], x["start"])).alias("n"))

    return F.aggregate(F.array_sort(spans), none, add, lambda acc: acc["n"])


def decontaminate(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", length: int = LENGTH,
) -> DataFrame:
    """(id, n_words, n_hit, spans, items) of every document: words inside shared windows, the
    windows (start, n) in words, and the ids of the items as sorted strings."""
    windows = stored(item_windows(items, item_col, item_text_col, length))
    # items of a window as two digests: windows of the same items are one group
    marks = windows.select("window", "item").distinct().groupBy("window").agg(
        F.bit_xor(F.xxhash64("item")).alias("g1"), F.bit_xor(F.xxhash64(F.lit("second"), "item")).alias("g2"),
        F.count("item").alias("g3"))
    marks = stored(marks.select("window", F.struct("g1", "g2", "g3").alias("g")))
    rows, found = hits(docs, windows, id_col, text_col)
    per_row = stored(found.join(marks, "window").groupBy("row").agg(
        F.collect_set(F.struct("start", "n")).alias("spans"), F.array_sort(F.collect_set("g")).alias("gs")))
    sets = per_row.select("gs").distinct()
    members = marks.groupBy("g").agg(F.min("window").alias("window")).join(windows.select("window", "item").distinct(), "window")
    lists = sets.select("gs", F.explode("gs").alias("g")).join(members.select("g", "item"), "g").groupBy("gs").agg(
        F.array_sort(F.collect_set("item")).alias("items"))
    named = per_row.join(lists, "gs", "left").select("row", F.array_sort("spans").alias("spans"), "items")
    none = F.array()
    return rows.join(named, "row", "left").select(
        F.col("id").alias(id_col), "n_words",
        F.coalesce(_covered(F.col("spans")), F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("spans", none.cast("array<struct<start: int, n: int>>")).alias("spans"),
        F.coalesce("items", none.cast("array<string>")).alias("items"),
    )

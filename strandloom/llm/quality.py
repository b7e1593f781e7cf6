"""Quality rules with a hashed n-gram likelihood ratio.

Two multinomials over hashed byte n-grams are counted: one over trusted
documents, one over the whole corpus.  The score of a document is the mean log ratio of its
n-grams under the two; a document below the threshold goes.  Before that, plain
rules on length and repetition hold.

The trusted documents are a bounded sample: at most ``most_trusted`` labelled ids,
chosen by a digest of the id.  The corpus counts cover all documents.  Both tables have
``buckets`` entries, however large the corpus is.

Null and empty texts have no words and fail the length rule.  Texts shorter
than an n-gram score 0.  Without any trusted document every score is 0, so the
rules alone decide.  Repeated rows are counted and judged each.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

N = 4
BUCKETS = 1 << 16
MOST_TRUSTED = 20_000
THRESHOLD = -0.5
CHUNK = 1 << 20
SYMBOLS = "#*$%&|<>"
BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def gram_buckets(text: str, n: int = N, buckets: int = BUCKETS) -> Iterator[np.ndarray]:
    """Buckets of all byte n-grams of a text, a piece of the text at a time."""
    raw = np.frombuffer((text or "").encode("utf-8"), dtype=np.uint8)
    shift = np.uint64(64 - (buckets - 1).bit_length())
    for start in range(0, len(raw) - n + 1, CHUNK):
        piece = raw[start:start + CHUNK + n - 1].astype(np.uint64)
        size = len(piece) - n + 1
        h = np.zeros(size, dtype=np.uint64)
        for i in range(n):
            h = h * np.uint64(0x100000001B3) + piece[i:i + size]
        h ^= h >> np.uint64(29)
        yield ((h * np.uint64(0x9E3779B97F4A7C15)) >> shift).astype(np.int64)


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one text."""
    text = text or ""
    words = text.encode("utf-8").split()
    chars = len(text) - sum(text.count(c) for c in " \t\n\x0b\x0c\r")
    symbols = sum(text.count(c) for c in SYMBOLS)
    lines = [x for x in text.split("\n") if x.strip(" \t\x0b\x0c\r")]
    windows = list(zip(words, words[1:], words[2:]))
    repeats = 0
    if len(set(windows)) < len(windows):
        seen, upto = Counter(windows), 0
        for i, window in enumerate(windows):
            if seen[window] > 1:
                repeats += i + 3 - max(i, upto)
                upto = i + 3
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeats


def trusted_ids(labels: DataFrame, id_col: str = "doc_id", most: int = MOST_TRUSTED) -> DataFrame:
    """At most ``most`` ids with good quality and nothing toxic in all their labels."""
    good = labels.groupBy(id_col).agg(F.min("quality").alias("q"), F.max("toxic").alias("t"))
    return good.where("q = 1 AND coalesce(t, 0) = 0").select(id_col).where(F.col(id_col).isNotNull()).orderBy(
        F.xxhash64(id_col), id_col
    ).limit(most)


def ratio_table(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    n: int = N, buckets: int = BUCKETS, most_trusted: int = MOST_TRUSTED,
) -> np.ndarray:
    """Log ratio of trusted and raw probability for each bucket."""
    trusted = trusted_ids(labels, id_col, most_trusted).select(
        F.col(id_col).alias("_id"), F.lit(True).alias("_trusted")
    )
    marked = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(
        F.broadcast(trusted), "_id", "left"
    ).select("_text", F.col("_trusted").isNotNull().alias("_trusted"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        raw, target = np.zeros(buckets, dtype=np.int64), np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for text, good in zip(batch["_text"], batch["_trusted"]):
                for found in gram_buckets(text, n, buckets):
                    some = np.bincount(found, minlength=buckets)
                    raw += some
                    if good:
                        target += some
        at = np.flatnonzero(raw)
        yield pd.DataFrame({"bucket": at, "raw": raw[at], "target": target[at]})

    sums = marked.mapInPandas(count, "bucket long, raw long, target long").groupBy("bucket").agg(
        F.sum("raw").alias("raw"), F.sum("target").alias("target")
    )
    found = sums.toPandas()  # at most ``buckets`` rows
    raw, target = np.ones(buckets), np.ones(buckets)
    raw[found["bucket"]] += found["raw"]
    target[found["bucket"]] += found["target"]
    if not len(found) or not found["target"].sum():
        return np.zeros(buckets)
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def score(text: str | None, table: np.ndarray, n: int = N) -> float:
    total = grams = 0
    for found in gram_buckets(text, n, len(table)):
        total += float(table[found].sum())
        grams += len(found)
    return total / grams if grams else 0.0


def measures(text: Column, table: np.ndarray, spark, n: int = N) -> Column:
    """Struct of the base counts and the score of a text."""
    shared = spark.sparkContext.broadcast(table)

    @F.pandas_udf(BASE + ", score double")
    def measure(texts: pd.Series) -> pd.DataFrame:
        rows = [(*base_counts(t), score(t, shared.value, n)) for t in texts]
        return pd.DataFrame(rows, columns=[
            "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "score"
        ])

    return measure(F.coalesce(text, F.lit("")))


def base_failed(m) -> Column:
    """``m(name)`` gives the column of a measure."""
    return (m("n_words") < 50) | (100 * m("n_repeat_words") > 50 * m("n_words"))


def judge(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    threshold: float = THRESHOLD, most_trusted: int = MOST_TRUSTED,
) -> DataFrame:
    """(id, base counts, score, base_failed, kept) of every document."""
    table = ratio_table(docs, labels, id_col, text_col, most_trusted=most_trusted)
    rows = docs.select(
        F.col(id_col).alias("_id"), measures(F.col(text_col), table, docs.sparkSession).alias("_m")
    ).select(F.col("_id").alias(id_col), "_m.*")
    failed = base_failed(F.col)
    return rows.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("score") >= threshold))


def keep_good(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    threshold: float = THRESHOLD, most_trusted: int = MOST_TRUSTED,
) -> DataFrame:
    """The documents that are kept, with all their columns."""
    table = ratio_table(docs, labels, id_col, text_col, most_trusted=most_trusted)
    names = [f"_c{i}" for i in range(len(docs.columns))]
    at = dict(zip(docs.columns, names))
    m = F.col("_m")
    judged = docs.toDF(*names).withColumn("_m", measures(F.col(at[text_col]), table, docs.sparkSession))
    good = ~base_failed(lambda c: m[c]) & (m["score"] >= threshold)
    return judged.where(good).select(*[F.col(n).alias(c) for c, n in at.items()])

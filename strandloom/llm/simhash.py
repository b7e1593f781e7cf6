"""Near-duplicates by SimHash and covering locality-sensitive hashing.

A fingerprint has 64 bits, each the majority of that bit over the hashes of all shingles.
Every bit position i gets a vector f(i) of radius + 1 bits, spread evenly;
table v, for each vector v but zero, keeps the bits with <v, f(i)> odd and masks the others.
Any ``radius`` positions have vectors orthogonal to some v, and that table masks all of
them: each pair within the radius collides in a table, always (Pagh, SODA 2016).

Fingerprints are made distinct first, so exact copies cost nothing further.
In a bucket a search grows trees from one fingerprint after another and emits
their edges only, never all pairs.  Buckets of more than ``most`` fingerprints are not
searched in one task: their members meet at the strings one or two bit flips
away instead, which is exact for a radius of up to 4 and linear in the bucket; a larger radius is refused there.

Null and empty texts have fingerprint zero and are linked like any other.
Repeated ids give repeated rows.  An id that is null is never the smallest of a
component, unless the component has no other.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.operators.graph import connected_components
from strandloom.session import durable

RADIUS = 3
BITS = 64
SEED = 42
MOST = 4096
PIECE = 1 << 16


def fingerprint_of(text: str | None, width: int = 3) -> int:
    """Majority bits over the XXH64 hashes of word shingles, as a signed 64-bit integer."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8").lower().split()  # bytes: only A-Z change
    if not words:
        return 0
    if len(words) < width:
        shingles = [b" ".join(words)]
    elif width == 3:
        shingles = [a + b" " + b + b" " + c for a, b, c in zip(words, words[1:], words[2:])]
    else:
        shingles = [b" ".join(words[i:i + width]) for i in range(len(words) - width + 1)]
    ones = np.zeros(BITS, dtype=np.int64)
    for start in range(0, len(shingles), PIECE):
        h = np.array([xxh64_intdigest(s, SEED) for s in shingles[start:start + PIECE]], dtype="<u8")
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    packed = np.packbits(2 * ones > len(shingles), bitorder="little")
    return int(packed.view("<i8")[0])


def fingerprint(text: Column, width: int = 3) -> Column:
    @F.pandas_udf("long")
    def fp(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint_of(t, width) for t in texts], dtype="int64")

    return fp(F.coalesce(text, F.lit("")))


def masks(radius: int = RADIUS) -> list[int]:
    """Bit masks of the covering tables, as signed 64-bit integers."""
    vectors = 1 << (radius + 1)
    out = []
    for v in range(1, vectors):
        m = sum(1 << i for i in range(BITS) if bin(v & (i % vectors)).count("1") % 2)
        out.append(m - (1 << 64) if m >> 63 else m)
    return out


def tree_edges(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges of a forest whose trees are the components of one bucket."""
    bits = fps.view(np.uint64)
    left = np.arange(len(fps))
    edges: list[tuple[int, int]] = []
    while len(left):
        frontier, left = [int(left[0])], left[1:]
        while frontier and len(left):
            at = frontier.pop()
            near = np.bitwise_count(bits[left] ^ bits[at]) <= radius
            found = left[near]
            left = left[~near]
            edges += [(int(fps[at]), int(fps[x])) for x in found]
            frontier += found.tolist()
    return edges


def _bucket_edges(buckets: DataFrame, radius: int) -> DataFrame:
    def edges(batches):
        for batch in batches:
            found = [e for fps in batch["fps"] for e in tree_edges(np.asarray(fps, dtype=np.int64), radius)]
            yield pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return buckets.select("fps").mapInPandas(edges, "a long, b long")


def _flip_edges(fps: DataFrame, radius: int) -> DataFrame:
    """Links within the radius (4 at most), through the strings half of it, rounded down, from one end and the rest from the other.

    Of those that meet at a string, the ones within the lower half of it are within
    the radius of all others; one of them stands for the string.
    """
    i, j, none = F.col("i"), F.col("j"), F.lit(BITS)
    bit = lambda k: F.when(k < BITS, F.call_function("shiftleft", F.lit(1).cast("long"), k)).otherwise(F.lit(0).cast("long"))
    second = F.explode(F.sequence(i, none)) if radius > 2 else none
    near = (
        fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(BITS))).alias("i"))
        .select("fp", "i", second.alias("j"))
        .where((i < j) | (i == BITS))
        .select(
            "fp", F.col("fp").bitwiseXOR(bit(i)).bitwiseXOR(bit(j)).alias("z"),
            ((i < BITS).cast("int") + (j < BITS).cast("int") <= radius // 2).alias("half"),
        )
    )
    hubs = near.where("half").groupBy("z").agg(F.min("fp").alias("a"))
    return near.join(hubs, "z").where("a != fp").select("a", F.col("fp").alias("b")).distinct()


def links(fps: DataFrame, radius: int = RADIUS, most: int = MOST) -> DataFrame:
    """(a, b): enough links between distinct fingerprints within the radius to give their components."""
    tables = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("k"))
                       for t, m in enumerate(masks(radius))])
    entries = fps.select("fp", F.explode(tables).alias("e")).select("fp", "e.t", "e.k")
    sizes = entries.groupBy("t", "k").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = durable(entries.join(sizes, ["t", "k"]))
    small = members.where(F.col("n") <= most).groupBy("t", "k").agg(F.collect_list("fp").alias("fps"))
    found = _bucket_edges(small, radius)
    large = durable(members.where(F.col("n") > most).select("fp").distinct())
    if large.isEmpty():
        return found.distinct()
    if radius > 4:
        raise ValueError(f"no exact way for radius {radius} with over {most} fingerprints in a bucket")
    return found.unionByName(_flip_edges(large, radius)).distinct()


def _with_component(fps: DataFrame, radius: int, most: int) -> DataFrame:
    """``fps``, a row for each fingerprint, with the least fingerprint of its component."""
    components = durable(connected_components(links(fps.select("fp"), radius, most)))
    return fps.join(components, F.col("fp") == F.col("node"), "left").select(
        *fps.columns, F.coalesce("component", "fp").alias("component")
    )


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    width: int = 3, radius: int = RADIUS, most: int = MOST,
) -> DataFrame:
    """(id, fp, component_id) of every document; the component is named by its smallest id."""
    marked = durable(docs.select(F.col(id_col).alias("id"), fingerprint(F.col(text_col), width).alias("fp")))
    named = _with_component(durable(marked.groupBy("fp").agg(F.min("id").alias("id"))), radius, most)
    smallest = named.groupBy("component").agg(F.min("id").alias("component_id"))
    names = named.join(smallest, "component").select("fp", "component_id")
    return marked.join(names, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def hexadecimal(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def keep_one(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = RADIUS
) -> DataFrame:
    """One document of each component, the one of the smallest id, with all its columns.

    Rows of the same id and text are the same document; one of them stays.  Others are told
    apart by two digests of both, which also decide between different texts of the smallest id.
    """
    names = [f"_c{i}" for i in range(len(docs.columns))]
    at = dict(zip(docs.columns, names))
    plain, key, text = docs.toDF(*names), F.col(at[id_col]), F.col(at[text_col])
    both = key.isNull(), key, text.isNull(), text  # a hash leaves nulls out
    d1, d2 = F.xxhash64(*both).alias("_d1"), F.xxhash64(F.lit("second"), *both).alias("_d2")
    marked = plain.select(key.alias("id"), d1, d2, fingerprint(text, width).alias("fp")).groupBy(
        "id", "_d1", "_d2", "fp"
    ).agg(F.count(F.lit(1)).alias("_rows"))
    first = F.struct(F.col("id").isNull().alias("none"), "id", "_d1", "_d2", "_rows")
    firsts = durable(marked.groupBy("fp").agg(F.min(first).alias("first")))
    kept = durable(
        _with_component(firsts, radius, MOST).groupBy("component").agg(F.min("first").alias("first"))
        .select("first._d1", "first._d2", "first._rows")
    )
    joined = plain.select(*names, d1, d2).join(kept, ["_d1", "_d2"])
    rows = joined.where("_rows = 1").select(*names)
    if not kept.where("_rows > 1").isEmpty():
        many = joined.where("_rows > 1").groupBy("_d1", "_d2").agg(F.min(F.struct(*names)).alias("_row"))
        rows = rows.unionByName(many.select("_row.*"))
    return rows.select(*[F.col(n).alias(c) for c, n in at.items()])

"""Phrase collocation mining with vertically partitioned, depth-truncated suffix subtrees.

Words are counted first.  Suffixes of up to ``depth`` words (within a piece of a text, and only over words of at least
``least`` occurrences, as no other phrase can be a candidate) are dealt out by their prefixes: a prefix is one word; a word of more
occurrences than the memory budget is extended to two words, such a pair to three, and so on, each by a count of
the extended prefixes alone.  Prefixes are put together to groups of about one budget, by ranges of a hash histogram, and a group's subtree is
built by itself: its suffixes are sorted, equal ones are leaves, and a phrase's count is the total of the leaves
below it.  Suffixes travel in packed columns, combined before the shuffle.

Words are 64-bit hashes until candidates are known; that all words of the corpus have different hashes is checked, and
another seed is taken otherwise.  Which words are frequent is looked up in a bitmap of bounded size that may let others through, which costs room
and no result.  The driver gets a histogram of 65,536 numbers, the bitmap and the extended prefixes, at most n / budget of each length
with budgets of n / 10,000,000 and more.

Null texts are empty, a null language is ``und``.  Repeated rows count each.  Texts without words and empty tables give no rows.  Very
long texts are cut into words block by block.  Ties in the report go to the phrase that is first in byte order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.llm import runs
from strandloom.llm.store import stored
from strandloom.operators.skew import first_n

DEPTH = 4
LEAST = 30
TOP = 2000
BUDGET = 1 << 21  # suffixes in a group
BUCKETS = 1 << 16
HELD = 1 << 19  # suffixes that a task holds before it passes them on
HELD_WORDS = 1 << 18  # different words that a task holds before it passes them on
SLICE = 1 << 20  # bytes of neighbouring texts that are looked at together; arrays take some 40 bytes for each

#: Where texts are cut into pieces, and what separates words besides.
CUTS = runs.byte_set(lambda b: chr(b) in ".,;:!?\n\x0b\x0c\r")
IN_WORD = runs.byte_set(lambda b: chr(b) not in ".,;:!?\n\x0b\x0c\r \t")

SCHEMA = "grp long, lang string, " + ", ".join(f"h{i} binary" for i in range(1, DEPTH + 1)) + ", n binary, r binary"


def _salt(lang: str, seed: int) -> np.uint64:
    data = np.frombuffer(lang.encode(), np.uint8)
    own = runs.hashes(data, np.zeros(1, np.int64), np.array([len(data)]))[0] if len(data) else np.uint64(7)
    return runs.mix(np.array([own + np.uint64(seed)]))[0]


def _by_language(batch: pa.RecordBatch) -> Iterator[tuple[str, pa.Array]]:
    """Slices of the texts of a batch (lang, text), one language at a time."""
    for lang in pc.unique(batch.column(0)).to_pylist():
        texts = batch.column(1).filter(pc.equal(batch.column(0), lang))
        for lo, hi in runs.slices(texts, SLICE):
            yield lang, texts.slice(lo, hi - lo)


def _cut(texts: pa.Array, seed: int):
    """Bytes, starts and ends of the words, their hashes, and whether the next word is in the same piece."""
    data, offsets = runs.buffer(texts)
    starts, ends = runs.find(data, offsets, IN_WORD)
    hashed = runs.hashes(data, starts, ends)
    if seed:
        hashed = runs.mix(hashed + np.uint64(seed))
        hashed[hashed == 0] = 1
    cuts = np.concatenate([np.flatnonzero(CUTS[data[lo:lo + runs.BLOCK]]) + lo for lo in range(0, max(1, len(data)), runs.BLOCK)])
    piece = np.searchsorted(cuts, starts) + np.searchsorted(offsets, starts, "right")
    joined = np.zeros(len(starts), bool)
    joined[:-1] = piece[1:] == piece[:-1]
    return data, starts, ends, hashed, joined


def _count_words(seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, dict[int, int]] = {}
        words: dict[int, str] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for lang, own in counts.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(own), pa.string()), pa.array(own.keys(), pa.int64(), size=len(own)),
                     pa.array(map(words.__getitem__, own), pa.string(), size=len(own)), pa.array(own.values(), pa.int64(), size=len(own))],
                    names=["lang", "h", "word", "n"])
            counts.clear()
            words.clear()

        for batch in batches:
            for lang, texts in _by_language(batch):
                data, starts, ends, hashed, _ = _cut(texts, seed)
                found, at, n = np.unique(runs.signed(hashed), return_index=True, return_counts=True)
                own = counts.setdefault(lang, {})
                for h, i, k in zip(found.tolist(), at.tolist(), n.tolist()):
                    if h not in words:
                        words[h] = runs.FOLD[data[starts[i]:ends[i]]].tobytes().decode("utf-8", "replace")
                    own[h] = own.get(h, 0) + k
                if sum(map(len, counts.values())) > HELD_WORDS:
                    yield from out()
        yield from out()

    return run


def _texts(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("text"))


def word_counts(texts: DataFrame) -> tuple[DataFrame, int]:
    """(lang, h, word, n) of all words, and the seed under which different words have different hashes."""
    seed = 0
    while True:
        words = stored(texts.mapInArrow(_count_words(seed), "lang string, h long, word string, n long").groupBy(
            "lang", "h", "word").agg(F.sum("n").alias("n")))
        twice = words.groupBy("h").agg(F.min("word").alias("a"), F.max("word").alias("b")).where("a <> b")
        if twice.isEmpty():
            return words, seed
        seed += 1


class Plan:
    """What every task needs to know: which words are frequent, and where each prefix goes."""

    def __init__(self, bitmap: np.ndarray, bits: int, bounds: np.ndarray, seed: int):
        self.bitmap, self.bits, self.bounds, self.seed = bitmap, bits, bounds, seed
        self.extended: list[np.ndarray] = []  # sorted keys of prefixes of 1, 2, ... words over the budget
        self.more = 0  # groups for extended prefixes

    def frequent(self, salted: np.ndarray) -> np.ndarray:
        return runs.in_bitmap(self.bitmap, self.bits, salted)

    def prefix(self, h: list[np.ndarray], r: int, salt: np.uint64) -> np.ndarray:
        """A key for the first r words."""
        key = runs.mix(h[0] + salt)
        for x in h[1:r]:
            key = runs.mix(key * np.uint64(0xD6E8FEB86659FD93) + x)
        return key

    def routed(self, h: list[np.ndarray], salt: np.uint64) -> tuple[np.ndarray, np.ndarray]:
        """Group and prefix length of each suffix."""
        key = self.prefix(h, 1, salt)
        group = np.searchsorted(self.bounds, key >> np.uint64(48), "right").astype(np.int64)
        length = np.ones(len(key), np.uint8)
        for r, over in enumerate(self.extended, 1):
            at = np.flatnonzero(length == r)
            at = at[_among(over, self.prefix([x[at] for x in h], r, salt))]
            length[at] = r + 1
            deeper = self.prefix([x[at] for x in h], r + 1, salt)
            group[at] = len(self.bounds) + 1 + (deeper % np.uint64(self.more)).astype(np.int64)
        return group, length


def _among(some: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(some):
        return np.zeros(len(x), bool)
    return some[np.minimum(np.searchsorted(some, x), len(some) - 1)] == x


def _suffixes(texts: pa.Array, plan: Plan, salt: np.uint64) -> list[np.ndarray]:
    """Columns of the suffixes of two words and more: hashes, 0 after the end."""
    _, _, _, h, joined = _cut(texts, plan.seed)
    often = plan.frequent(runs.mix(h + salt))
    n = len(h)
    link = np.zeros(n + DEPTH, bool)
    link[:n] = joined & often
    link[:n - 1] &= often[1:]
    padded = np.concatenate([h, np.zeros(DEPTH, np.uint64)])
    at = np.flatnonzero(link[:n])
    columns, goes_on = [padded[at]], np.ones(len(at), bool)
    for d in range(1, DEPTH):
        goes_on = goes_on & link[at + d - 1]
        columns.append(np.where(goes_on, padded[at + d], np.uint64(0)))
    return columns


def _combined(columns: list[np.ndarray], n: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Equal suffixes together.  Sorted by hashes of words and suffix; two suffixes that share those stay apart, which is harmless."""
    low = runs.mix(columns[0] * np.uint64(3) + columns[1] * np.uint64(5) + columns[2] * np.uint64(7) + columns[3] * np.uint64(11))
    key = (columns[0] & np.uint64(0xFFFFF << 44)) | (columns[1] >> np.uint64(44) << np.uint64(24)) | (low >> np.uint64(40))
    order = np.argsort(key)
    columns = [c[order] for c in columns]
    new = np.zeros(len(order), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    at = np.flatnonzero(new)
    return [c[at] for c in columns], np.add.reduceat(n[order], at) if len(at) else n[:0]


def _deal(shared):
    """Map (lang, text) to packed suffixes (grp, lang, h1.., n, r)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan: Plan = shared.value
        held: dict[str, list[list[np.ndarray]]] = {}

        def out(lang: str) -> Iterator[pa.RecordBatch]:
            columns = [np.concatenate(x) for x in zip(*held.pop(lang))]
            columns, n = _combined(columns, np.ones(len(columns[0]), np.int64))
            group, length = plan.routed(columns, _salt(lang, plan.seed))
            order = np.argsort(group, kind="stable")
            ends = np.flatnonzero(np.diff(group[order], append=-1)) + 1
            all_ = [*(c[order] for c in columns), n[order].astype(np.uint32), length[order]]
            for a, b in zip([0, *ends[:-1].tolist()], ends.tolist()):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([group[order[a]]], pa.int64()), pa.array([lang]), *(pa.array([c[a:b].tobytes()]) for c in all_)],
                    names=["grp", "lang", *(f"h{i}" for i in range(1, DEPTH + 1)), "n", "r"])

        for batch in batches:
            for lang, texts in _by_language(batch):
                held.setdefault(lang, []).append(_suffixes(texts, plan, _salt(lang, plan.seed)))
                if sum(len(x[0]) for x in held[lang]) > HELD:
                    yield from out(lang)
        for lang in list(held):
            yield from out(lang)

    return run


def _subtree(least: int):
    """Nodes of one group's subtree: phrases of two words and more with at least ``least`` occurrences."""

    def run(table: pa.Table) -> pa.Table:
        read = lambda c, kind: np.frombuffer(b"".join(table.column(c).to_pylist()), kind)
        h = [read(f"h{i}", np.uint64) for i in range(1, DEPTH + 1)]
        n, r = read("n", np.uint32).astype(np.int64), read("r", np.uint8)
        order = np.lexsort(h[::-1])
        n, r, h = n[order], r[order], [x[order] for x in h]
        new = np.zeros(len(n), bool)
        new[:1] = True
        out = []
        for d in range(1, DEPTH + 1):
            new[1:] |= h[d - 1][1:] != h[d - 1][:-1]
            if d == 1 or not len(n):
                continue
            at = np.flatnonzero(new)
            total = np.add.reduceat(n, at)
            at, total = at[keep := (total >= least) & (h[d - 1][at] > 0) & (r[at] <= d)], total[keep]
            zero = np.zeros(len(at), np.uint64)
            out.append([np.full(len(at), d, np.int32), *(runs.signed(h[i][at] if i < d else zero) for i in range(DEPTH)), total])
        columns = [np.concatenate(x) for x in zip(*out)] or [np.zeros(0, np.int32), *[np.zeros(0, np.int64)] * (DEPTH + 1)]
        lang = pa.array([table.column("lang")[0].as_py()] * len(columns[0]), pa.string())
        return pa.table([lang, *map(pa.array, columns)], names=["lang", "d", *H, "f"])

    return run


H = [f"h{i}" for i in range(1, DEPTH + 1)]
NODE = "lang string, d int, " + ", ".join(f"{h} long" for h in H) + ", f long"


def _count_prefixes(shared, r: int):
    """Map (lang, text) to counts of the prefixes of r words whose first r - 1 words are over the budget."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan: Plan = shared.value
        for batch in batches:
            for lang, texts in _by_language(batch):
                salt = _salt(lang, plan.seed)
                columns = _suffixes(texts, plan, salt)
                _, length = plan.routed(columns, salt)
                at = np.flatnonzero((length == r) & (columns[r - 1] > 0))
                some = [c[at] if i < r else np.zeros(len(at), np.uint64) for i, c in enumerate(columns)]
                some, n = _combined(some, np.ones(len(at), np.int64))
                key = runs.signed(plan.prefix(some, r, salt))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(n), pa.string()), pa.array(np.full(len(n), r, np.int32)),
                     *(pa.array(runs.signed(c)) for c in some), pa.array(n), pa.array(key)],
                    names=["lang", "d", *H, "f", "key"])

    return run


def _keyed(words: DataFrame, seed: int) -> DataFrame:
    """The words with their prefix key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salts: dict[str, np.uint64] = {}
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for lang in set(langs):
                salts.setdefault(lang, _salt(lang, seed))
            salt = np.array([salts[x] for x in langs], np.uint64)
            h = batch.column(1).to_numpy().view(np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(2), pa.array(runs.signed(runs.mix(h + salt)))], names=["n", "key"])

    return words.select("lang", "h", "n").mapInArrow(run, "n long, key long")


def phrases(texts: DataFrame, words: DataFrame, seed: int, least: int = LEAST, budget: int = BUDGET) -> DataFrame:
    """(lang, d, h1.., f): all phrases of 2 to ``DEPTH`` words with at least ``least`` occurrences, as hashes."""
    context = texts.sparkSession.sparkContext
    often = stored(_keyed(words.where(F.col("n") >= least), seed))
    size = often.agg(F.count(F.lit(1)).alias("words"), F.sum("n").alias("n")).first()
    budget = max(budget, (size["n"] or 0) // 10_000_000)
    bitmap, bits = runs.make_bitmap(often, "key", size["words"])
    weights = np.zeros(BUCKETS, np.int64)
    for row in often.where(F.col("n") <= budget).groupBy(F.shiftrightunsigned("key", 48).alias("b")).agg(F.sum("n").alias("n")).collect():
        weights[row["b"]] = row["n"]
    # ranges of the histogram; a group ends before the bucket that would take it over the budget
    bounds, total = [], 0
    for b, w in enumerate(weights.tolist()):
        if total and total + w > budget:
            bounds.append(b)
            total = 0
        total += w
    plan = Plan(bitmap, bits, np.array(bounds, np.uint64), seed)
    over = often.where(F.col("n") > budget).select("key", F.col("n").alias("f"))
    known: list[DataFrame] = []
    for r in range(2, DEPTH + 1):
        found = [(row["key"], row["f"]) for row in over.select("key", "f").collect()]  # at most n / budget
        if not found:
            break
        plan.extended.append(np.sort(np.array([k for k, _ in found], np.int64).view(np.uint64)))
        if r == 2:
            plan.more = -(-sum(f for _, f in found) // budget)
        if r < DEPTH:
            counts = texts.mapInArrow(_count_prefixes(context.broadcast(plan), r), f"{NODE}, key long")
            over = stored(counts.groupBy("lang", "d", *H, "key").agg(F.sum("f").alias("f")).where(F.col("f") > budget))
            known.append(over.select("lang", "d", *H, "f"))  # their leaves are in several groups
    dealt = texts.mapInArrow(_deal(context.broadcast(plan)), SCHEMA)
    nodes = dealt.groupBy("grp", "lang").applyInArrow(_subtree(least), NODE)
    for more in known:
        nodes = nodes.unionByName(more.where(F.col("f") >= least))
    return nodes


def _part(start: Column, size: Column) -> list[Column]:
    """h1.. of the words from ``start`` on."""
    every = F.array(*H)
    return [F.when(size >= i + 1, F.get(every, start + i)).otherwise(F.lit(0).cast("long")).alias(h) for i, h in enumerate(H)]


def score_cuts(nodes: DataFrame, words: DataFrame) -> DataFrame:
    """The phrases with a, and k, l, r and score of their lowest-scoring cut."""
    parts = words.select("lang", F.lit(1).alias("d"), F.col("h").alias(H[0]), *[F.lit(0).cast("long").alias(h) for h in H[1:]],
                         F.col("n").alias("f")).unionByName(nodes)
    key = ["lang", "d", *H]
    cuts = nodes.select(F.struct(*key).alias("p"), F.col("f").alias("a"), *key, F.explode(F.sequence(F.lit(1), F.col("d") - 1)).alias("k"))
    left = cuts.select("p", "a", "k", "lang", F.struct(*_part(F.lit(0), F.col("k"))).alias("x"),
                       F.struct(*_part(F.col("k"), F.col("d") - F.col("k"))).alias("y"), (F.col("d") - F.col("k")).alias("e"))
    named = lambda f: parts.select("lang", F.col("d").alias(f + "d"), F.struct(*H).alias(f + "x"), F.col("f").alias(f))
    both = left.join(
        named("l").withColumnsRenamed({"ld": "k", "lx": "x"}), ["lang", "k", "x"]
    ).join(named("r").withColumnsRenamed({"rd": "e", "rx": "y"}), ["lang", "e", "y"])
    wide = both.withColumn("score", F.expr("cast((cast(a AS decimal(20,0)) * 2000000BD) div (cast(l AS decimal(20,0)) + r) AS bigint)"))
    best = wide.groupBy("p", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("c"))
    return best.select("p.*", "a", "c.score", "c.k", "c.l", "c.r")


def drop_covered(nodes: DataFrame, percent: int = 80) -> DataFrame:
    """Phrases without those that lie in a longer one with at least ``percent`` of their count."""
    inside = [(d, s) for d in range(2, DEPTH) for s in range(DEPTH - d + 1)]
    shorter = nodes.where("d > 2").select(
        "lang", "f", F.explode(F.array(*[
            F.when(F.lit(d + s) <= F.col("d"), F.when(F.lit(d) < F.col("d"), F.struct(F.lit(d).alias("d"), *_part(F.lit(s), F.lit(d)))))
            for d, s in inside])).alias("s")
    ).where("s IS NOT NULL").select("lang", "s.*", "f").groupBy("lang", "d", *H).agg(F.max("f").alias("longer"))
    joined = nodes.join(shorter, ["lang", "d", *H], "left")
    return joined.where(F.coalesce(100 * F.col("longer") < percent * F.col("f"), F.lit(True))).drop("longer")


def collocations(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang",
    least: int = LEAST, top: int = TOP, percent: int = 80, budget: int = BUDGET,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of every language."""
    texts = _texts(docs, text_col, lang_col)
    words, seed = word_counts(texts)
    frequent = stored(words.where(F.col("n") >= least).select("lang", "h", "word", "n"))
    nodes = stored(phrases(texts, words, seed, least, budget))
    scored = stored(score_cuts(nodes, frequent).join(drop_covered(nodes, percent).select("lang", "d", *H), ["lang", "d", *H], "left_semi"))
    spelt = scored.select("lang", "d", *H, F.posexplode(F.slice(F.array(*H), F.lit(1), F.col("d"))).alias("i", "h")).join(
        frequent.select("lang", "h", "word"), ["lang", "h"]
    ).groupBy("lang", "d", *H).agg(F.array_sort(F.collect_list(F.struct("i", "word"))).alias("w"))
    named = scored.join(spelt, ["lang", "d", *H]).select(
        "lang", F.array_join(F.transform("w", lambda x: x["word"]), " ").alias("phrase"), "a", "l", "r", "score",
        (-F.col("score")).alias("_s"), (-F.col("a")).alias("_a"))
    order = ["_s", "_a", "phrase"]
    sizes = words.groupBy("lang").agg(F.sum("n").alias("n"))
    first = first_n(named, ["lang"], order, top)  # a hot language is cut down in buckets first
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return ranked.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

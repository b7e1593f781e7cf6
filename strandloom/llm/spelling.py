"""Spelling variants: words that differ by one inserted, deleted or replaced character, found with a bidirectional FM-index.

A word with one error still matches one of its halves exactly.  The search scheme has two parts: match
the left half and the delimiter before it, then extend to the right allowing one error; match the right half and the delimiter behind
it, then extend to the left allowing one error.  Both use the same index of suffix-rank intervals over the
vocabulary, written between delimiters, forwards and backwards; while a half is matched both intervals are kept, so the search
can turn round.  What the second part finds with an intact left half is the first part's, so each pair is found once.

Halves also place the work.  A word asks only where words share its first (last) K characters, K = 2, 4 or 6 by its length and
never more than half of it, and is indexed wherever a word of its own length or one more or less may ask.  Small keys are packed into shards of about
``shard`` words, one index each.  A key of more words is cut into blocks, and each block of words meets each block of
questions, so no task holds more than a shard, however common a beginning is.  Pairs are reduced to a count and
the best neighbour within the shard.

A word's form is its most frequent neighbour if that is at least twice as frequent; counts at least double along
forms, so roots are found in a few rounds of pointer doubling.

Null and empty texts have no words.  Repeated rows count each; a null id is written as nothing before the colon.  Ties
go to the smallest word in code-point order.  Empty tables give no rows.  Texts are read whole; a word may have any length.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.llm.store import stored

LEAST_SIZE, LEAST_COUNT, TIMES = 5, 3, 2
SHARD = 16_384  # words under one index
HELD = 500_000  # different words a task counts before it passes them on

#: Latin-1 bytes: A-Z as a-z, the letters of a word as they are, everything else a blank.
FOLD = bytes(b if 97 <= b <= 122 or b >= 0xC0 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def words_of(text: str | None) -> Counter:
    """Words in Latin-1 bytes; characters outside it become '?', which is no letter."""
    return Counter((text or "").encode("latin-1", "replace").translate(FOLD).split())


def misspelt(word: bytes, lead: int) -> bytes:
    """The word, or without one character where the check sum (going on from ``lead``) is a multiple of 97."""
    h = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode("utf-8"), lead)
    if h % 97:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1:]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[bytes, int] = {}

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([w.decode("latin-1") for w in held], pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

    for batch in batches:
        for i, text in zip(batch.column(0), batch.column(1)):
            lead = zlib.crc32(f"{i.as_py()}:".encode())
            for word, n in words_of(text.as_py()).items():
                word = misspelt(word, lead)
                held[word] = held.get(word, 0) + n
            if len(held) > HELD:
                yield out()
                held.clear()
    yield out()


def vocabulary(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = LEAST_SIZE, count: int = LEAST_COUNT
) -> DataFrame:
    """(word, n) of the words with at least ``size`` characters and ``count`` occurrences."""
    counted = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col(text_col).cast("string")).mapInArrow(
        _count, "word string, n long")
    return counted.where(F.char_length("word") >= size).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= count)


class Ranks:
    """Suffix ranks of one direction: how often each character stands before (behind) the first i suffixes."""

    def __init__(self, codes: np.ndarray, letters: int):
        self.n = len(codes)
        self.order = suffix_order(codes)
        bwt = codes[self.order - 1]
        before = np.zeros((self.n + 1, letters), np.int32)
        before[np.arange(1, self.n + 1), bwt] = 1
        self.before = np.cumsum(before, axis=0, dtype=np.int32)
        total = self.before[-1]
        self.first = (np.cumsum(total) - total).astype(np.int32)
        self.flat = self.before.reshape(-1)

    def step(self, lo: np.ndarray, hi: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals with one more character c."""
        width = self.before.shape[1]
        return self.first[c] + self.flat[lo * width + c], self.first[c] + self.flat[hi * width + c]


def suffix_order(codes: np.ndarray) -> np.ndarray:
    """Places of the rotations of a text in their order, by prefix doubling."""
    n, size = len(codes), 1
    rank = codes.astype(np.int64)
    while True:
        key = rank * (rank.max() + 1) + np.roll(rank, -size)
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        steps = np.concatenate([[0], np.cumsum(ranked[1:] != ranked[:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = steps
        if steps[-1] == n - 1:
            return order
        size *= 2


class Index:
    """A bidirectional index of different words, given as Latin-1 bytes."""

    def __init__(self, words: list[bytes]):
        self.words = words
        text = np.frombuffer(b"\0" + b"\0".join(words) + b"\0", np.uint8)
        used = np.unique(text)
        self.code = np.full(256, -1, np.int64)
        self.code[used] = np.arange(len(used))  # the delimiter is 0
        self.letters = len(used)
        codes = self.code[text]
        self.forth, self.back = Ranks(codes, self.letters), Ranks(codes[::-1], self.letters)
        self.begin = np.flatnonzero(text == 0)  # of delimiters

    def exact(self, codes: np.ndarray, to_left: bool):
        """Intervals of words (a row of codes each) and the delimiter at their outer end, both ways.

        ``to_left`` goes from the last code to the first and then the delimiter.  A row that is
        nowhere has an empty interval.
        """
        here, there = (self.forth, self.back) if to_left else (self.back, self.forth)
        m = len(codes)
        lo, hi, other = np.zeros(m, np.int64), np.full(m, here.n), np.zeros(m, np.int64)
        steps = codes[:, ::-1] if to_left else codes
        zero = np.zeros((m, 1), np.int64)
        for c in np.hstack([steps, zero]).T:
            sizes = here.before[hi] - here.before[lo]
            less = np.cumsum(sizes, axis=1) - sizes
            known = np.maximum(c, 0)
            rows = np.arange(m)
            other = other + less[rows, known]
            lo = here.first[known] + here.before[lo, known]
            hi = lo + np.where(c < 0, 0, sizes[rows, known])
        return other, other + (hi - lo)

    def extend(self, lo: np.ndarray, hi: np.ndarray, codes: np.ndarray, to_left: bool) -> tuple[np.ndarray, np.ndarray]:
        """(row, word number): words that go on from the intervals with ``codes`` but for exactly one error.

        ``codes`` are in the order of reading: from the middle outwards.
        """
        at = self.forth if to_left else self.back
        row = np.flatnonzero(hi > lo)
        lo, hi = lo[row], hi[row]
        bad = tuple(np.zeros(0, np.int64) for _ in range(3))  # row, lo, hi after the error
        size = codes.shape[1]
        for j in range(size + 1):
            sizes = at.before[hi] - at.before[lo]
            which, c = np.nonzero(sizes)
            clo = at.first[c] + at.before[lo[which], c]
            chi = clo + sizes[which, c]
            wrong = c > 0
            bad = [np.concatenate(x) for x in zip(bad, (row[which][wrong], clo[wrong], chi[wrong]))]  # one more character
            if j == size:
                break
            want = codes[:, j]
            c2 = want[bad[0]]
            blo, bhi = at.step(bad[1], bad[2], np.maximum(c2, 0))
            live = (bhi > blo) & (c2 >= 0)
            bad = [bad[0][live], blo[live], bhi[live]]
            wrong &= c != want[row[which]]
            bad = [np.concatenate(x) for x in zip(bad, (row[which][wrong], clo[wrong], chi[wrong]), (row, lo, hi))]  # another; none
            right = c == want[row[which]]
            row, lo, hi = row[which][right], clo[right], chi[right]
        lo, hi = at.step(bad[1], bad[2], np.zeros(len(bad[0]), np.int64))
        row, lo = bad[0][hi > lo], lo[hi > lo]
        place = at.order[lo]  # of the outer delimiter
        number = np.searchsorted(self.begin, place) if to_left else np.searchsorted(self.begin, at.n - 1 - place) - 1
        pairs = np.unique(row * (len(self.words) + 1) + number)
        return pairs // (len(self.words) + 1), pairs % (len(self.words) + 1)

    def near(self, asked: list[bytes], left: bool) -> Iterator[tuple[int, np.ndarray]]:
        """(place in ``asked``, numbers of words one error away): by the left half, or by the right half where the left is not intact."""
        sizes = np.array([len(w) for w in asked])
        for size in np.unique(sizes):
            at = np.flatnonzero(sizes == size)
            codes = self.code[np.frombuffer(b"".join(asked[i] for i in at), np.uint8).reshape(len(at), size)]
            half = size // 2
            if left:
                lo, hi = self.exact(codes[:, :half], True)
                row, number = self.extend(lo, hi, codes[:, half:], False)
            else:
                lo, hi = self.exact(codes[:, half:], False)
                row, number = self.extend(lo, hi, codes[:, :half][:, ::-1], True)
            if not len(row):
                continue
            cut = np.concatenate([[0], np.flatnonzero(row[1:] != row[:-1]) + 1, [len(row)]])
            for a, b in zip(cut[:-1], cut[1:]):
                i, found = at[row[a]], number[a:b]
                if not left:
                    start = asked[i][:half]
                    found = np.array([x for x in found if not self.words[x].startswith(start)], np.int64)
                if len(found):
                    yield int(i), found


def _search(table: pa.Table) -> pa.Table:
    """One shard: rows (role, word, n), role 0 for words of the index, 1 and 2 for questions by the left and right half."""
    role = table.column("role").to_numpy()
    words = [w.encode("latin-1") for w in table.column("word").to_pylist()]
    counts = table.column("n").to_numpy()
    known: dict[bytes, int] = {words[i]: int(counts[i]) for i in np.flatnonzero(role == 0)}
    out = []
    if known and (role > 0).any():
        index = Index(sorted(known))
        times = np.array([known[w] for w in index.words])
        for part in (1, 2):
            asked = [words[i] for i in np.flatnonzero(role == part)]
            for i, found in index.near(asked, part == 1) if asked else ():
                most = times[found].max()
                first = index.words[found[times[found] == most].min()]  # words are in order
                out.append((asked[i].decode("latin-1"), len(found), int(most), first.decode("latin-1")))
    columns = list(zip(*out)) or [[], [], [], []]
    kinds = {"word": pa.string(), "n_near": pa.int64(), "best_n": pa.int64(), "best": pa.string()}
    return pa.table({k: pa.array(c, t) for (k, t), c in zip(kinds.items(), columns)})


def _depth(size: Column) -> Column:
    """Characters of a half that decide the shard; at most half of the word."""
    return F.when(size < 8, 2).when(size < 12, 4).otherwise(6)


def _placed(words: DataFrame, shard: int) -> DataFrame:
    """(task, role, word, n): every word in the shards where it may be found and where it asks."""
    size = F.char_length("word")
    depths = F.array_distinct(F.transform(F.array(size - 1, size, size + 1), lambda m: _depth(F.greatest(m, F.lit(LEAST_SIZE)))))
    key = lambda side, k: F.concat(F.lit(side), k.cast("string"), F.lit("|"), (F.left if side == "L" else F.right)("word", k))
    keyed = words.withColumn("size", size).select(
        "word", "n", F.explode(F.concat(
            F.transform(depths, lambda k: F.struct(key("L", k).alias("key"), F.lit(0).alias("role"))),
            F.transform(depths, lambda k: F.struct(key("R", k).alias("key"), F.lit(0).alias("role"))),
            F.array(F.struct(key("L", _depth(F.col("size"))).alias("key"), F.lit(1).alias("role")),
                    F.struct(key("R", _depth(F.col("size"))).alias("key"), F.lit(2).alias("role"))),
        )).alias("k")).select("k.*", "word", "n")
    keyed = stored(keyed)
    sizes = stored(keyed.where("role = 0").groupBy("key").agg(F.count(F.lit(1)).alias("m")))
    light = sizes.where(F.col("m") <= shard).agg(F.sum("m")).first()[0] or 0
    shards = max(1, -(-light // shard))
    large = sizes.where(F.col("m") > shard).select("key", F.ceil(F.col("m") / shard).cast("int").alias("g"))
    met = keyed.join(large, "key", "left")
    own = F.pmod(F.xxhash64("word"), F.col("g")).cast("int")
    cell = lambda a, b: F.concat_ws("|", F.lit("cell"), a.cast("string"), b.cast("string"), "key")
    every = F.sequence(F.lit(0), F.coalesce("g", F.lit(1)) - 1)
    tasks = F.when(F.col("g").isNull(), F.array(F.concat(F.lit("shard|"), F.pmod(F.xxhash64("key"), F.lit(shards)).cast("string")))).when(
        F.col("role") == 0, F.transform(every, lambda x: cell(own, x))).otherwise(F.transform(every, lambda x: cell(x, own)))
    return met.select(F.explode(tasks).alias("task"), "role", "word", "n")


def neighbours(words: DataFrame, shard: int = SHARD) -> DataFrame:
    """(word, n_near, best_n, best): near words of (word, n), each different and of ``LEAST_SIZE`` characters or more, counted,
    and the most frequent one."""
    found = _placed(words, shard).groupBy("task").applyInArrow(
        lambda table: _search(table), "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("w")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select(
        "word", "n_near", (-F.col("b.m")).alias("best_n"), F.col("b.w").alias("best"))


def roots(formed: DataFrame, rounds: int) -> DataFrame:
    """(word, root) of all words (word, form) with a form, by pointer doubling over chains of up to 2 ** rounds links."""
    links = stored(formed.select("word", F.col("form").alias("root")))
    for _ in range(rounds):
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        links = stored(links.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root")))
    return links


def variant_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", count: int = LEAST_COUNT, times: int = TIMES, shard: int = SHARD
) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the vocabulary of ``docs``."""
    words = stored(vocabulary(docs, id_col, text_col, LEAST_SIZE, count))
    has = F.col("best_n") >= times * F.col("n")
    judged = stored(words.join(neighbours(words, shard), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(has, F.col("best")).alias("form"), F.when(has, F.col("best_n")).alias("form_n")))
    most = words.agg(F.max("n")).first()[0] or 1
    links = max(1, int(np.log(most) / np.log(times)) + 1)  # counts grow by ``times`` along a chain
    ends = roots(judged.where("form IS NOT NULL"), (links - 1).bit_length())
    return judged.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

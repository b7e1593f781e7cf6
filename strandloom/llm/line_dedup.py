"""Line de-duplication by an exact set-similarity join, in DataFrame operations only.

A line goes if an earlier line of the corpus, by document and line number,
has the same text, or a word set with a Jaccard likeness of ``t`` or more.

Equal lines collapse first.  Of the others, the words of a line are ordered by
rarity, and lines meet on words in their prefixes: sets of sizes m and n with likeness t
share at least a = ceil(t (m + n) / (1 + t)) words, so their first common word is among the first
m - a + 1 and n - a + 1.  Length and positional filters and a bound from 64-bit parity bitmaps
(an overlap is at most (m + n - differing bits) / 2) leave few pairs; these are verified on their words.

Rarity is the count of a word's bucket over all documents.  Buckets only set the order, so
sharing one costs speed and no result.

Words of a single line are dropped, and lines on a word of few lines meet in pairs.  On a word of many
lines they do not, as those may all be alike: there the first line is compared with all others.  Lines that this
does not settle go on to keys of two words, and of three where many lines share two: sets with k words in common
share the first k of them in prefixes that are k - 1 words longer.  So few lines meet on a key, however frequent its
words are.  Only lines that share three prefix words with very many others, and are like none of the first on
these keys, meet all earlier lines there.  Keys of several words can be many times the words of the corpus: they are
worked off in parts, each with all lines of its keys, so that disk holds the entries of one part at a time.

Null and empty texts have no lines with words.  Lines without words always stay.  A document of
which no line stays keeps its row with an empty text, a null text stays null.  Rows with the same
id and text are one document: each of equal rows keeps what the first keeps.  Rows that share an id, or have none,
and differ in their texts are documents of their own, in the order of two digests; those without id come first.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from strandloom.llm.store import stored
from strandloom.llm.text import BLANK
from strandloom.operators.skew import global_rank, spread_join

BUCKETS = 1 << 18
CROWD = 512  # lines on a key that may meet in pairs
DEPTH = 3  # words of a key at most
FEW_LINES = 100_000  # lines whose places, two numbers each, are broadcast
LEAST_PART = 4_000_000  # entries that are not divided, some 200 MB where they are shuffled
HOT_LINE = 2_000  # repeats of a line from which on its rows are spread
SPACES = " \t\n\x0b\x0c\r"
HASH_BITS = 52


def _split(line: Column) -> Column:
    return F.split(F.trim(line, F.lit(SPACES)), BLANK)


def _has_word(line: Column) -> Column:
    return F.trim(line, F.lit(SPACES)) != ""


def lines_of(docs: DataFrame) -> DataFrame:
    """(doc, line, text) of all lines with a word; ``docs`` has doc and text."""
    return docs.select("doc", F.posexplode(F.split("text", "\n")).alias("line", "text")).where(_has_word(F.col("text")))


def _bucket(h: Column, buckets: int) -> Column:
    return h.bitwiseAND(F.lit(buckets - 1).cast("long")).cast("int")


def rarity(docs: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """For each bucket twice the binary logarithm of the words in it; ``buckets`` numbers, a power of two.

    Texts are cut at spaces only, several times faster than at all blanks; it moves few words and only their order.
    """
    words = docs.select(F.explode(F.split("text", " ")).alias("w"))
    found = words.groupBy(_bucket(F.xxhash64("w"), buckets).alias("b")).agg(F.count(F.lit(1)).alias("n")).select(
        "b", F.floor(2 * F.log2(F.col("n").cast("double"))).cast("int").alias("n")
    ).collect()
    out = [0] * buckets
    for row in found:
        out[row["b"]] = row["n"]
    return out


def _ordered(line: Column, ranks: list[int]) -> Column:
    """Distinct words as numbers that sort by rarity; equal words have equal numbers."""
    table = F.split(F.lit(",".join(map(str, ranks))), ",").cast("array<int>")  # folded to a constant
    low = F.lit((1 << HASH_BITS) - 1).cast("long")

    def number(w: Column) -> Column:
        h = F.xxhash64(w)  # cheap enough to be taken twice
        rank = F.coalesce(F.get(table, _bucket(h, len(ranks))), F.lit(0))  # never null, which sorts far faster
        return F.shiftleft(rank.cast("long"), HASH_BITS).bitwiseOR(h.bitwiseAND(low))

    return F.sort_array(F.array_distinct(F.transform(_split(line), number)))


def _bitmaps(numbers: Column) -> list[Column]:
    """Parity of the words on each of 128 bits: those with one bit of their number set, and all together."""
    place = lambda x: x.bitwiseAND(F.lit(63).cast("long")).cast("int")
    one = F.lit(1).cast("long")
    half = lambda x: F.shiftright(x, 6).bitwiseAND(one)
    none = F.lit(0).cast("long")
    return [
        F.aggregate(numbers, none, lambda acc, x: acc.bitwiseXOR(F.call_function("shiftleft", half(x), place(x)))).alias("bits"),
        F.aggregate(numbers, none, lambda acc, x: acc.bitwiseXOR(F.call_function("shiftleft", one, place(x)))).alias("both"),
    ]


def _share(t: int) -> tuple[int, int]:
    """t / (1 + t) as a fraction; t is in percent."""
    return t, 100 + t


def _least(m: Column, n: Column, t: int) -> Column:
    """Words that sets of these sizes must share."""
    a, b = _share(t)
    return F.floor((a * (m + n) + (b - 1)) / b).cast("int")


def _need(n: Column, t: int) -> Column:
    """Words that a set of this size shares with any set that is like it, at least."""
    return F.floor((t * n + 99) / 100).cast("int")


def equal_lines(docs: DataFrame) -> DataFrame:
    """(doc, line, first_doc, first_line) of lines that repeat an earlier one word for word."""
    lines = lines_of(docs).select(
        "doc", "line", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit("second"), "text").alias("h2")
    )
    at = F.col("doc").cast("decimal(38,0)") * (1 << 31) + F.col("line")
    firsts = lines.groupBy("h1", "h2").agg(F.min(at.cast("decimal(38,0)")).alias("first"), F.count(F.lit(1)).alias("n"))
    doc = F.floor(F.col("first") / (1 << 31)).cast("long")
    joined = spread_join(lines, firsts.where("n > 1"), ["h1", "h2"], "n", "inner", HOT_LINE)
    return joined.where(at.cast("decimal(38,0)") != F.col("first")).select(
        "doc", "line", doc.alias("first_doc"),
        (F.col("first") - F.floor(F.col("first") / (1 << 31)) * (1 << 31)).cast("int").alias("first_line"),
    )


def _marked(docs: DataFrame, lines: DataFrame, how: str) -> DataFrame:
    """``docs`` with the numbers of their lines that are in ``lines``."""
    numbers = lines.groupBy(F.col("doc").alias("_doc")).agg(F.collect_set("line").alias("numbers"))
    return docs.join(numbers, F.col("doc") == F.col("_doc"), how).drop("_doc")


def line_sets(docs: DataFrame, repeated: DataFrame, ranks: list[int], t: int) -> DataFrame:
    """(doc, line, n, bits, bits2, whole, pre) of all lines that are the first of their text.

    ``whole`` is a hash of the word set, ``pre`` the prefix for keys of ``DEPTH`` words.
    """
    none = F.array().cast("array<int>")
    firsts = _marked(docs, repeated, "left").select(
        "doc", F.coalesce("numbers", none).alias("numbers"), F.posexplode(F.split("text", "\n")).alias("line", "text")
    ).where(~F.array_contains("numbers", F.col("line")) & _has_word(F.col("text")))
    sets = firsts.select("doc", "line", _ordered(F.col("text"), ranks).alias("toks"))
    n = F.size("toks")
    return sets.select(
        "doc", "line", n.alias("n"), *_bitmaps(F.col("toks")), F.xxhash64("toks").alias("whole"),
        F.slice("toks", F.lit(1), n - _need(n, t) + DEPTH).alias("pre"),
    ).withColumn("bits2", F.col("both").bitwiseXOR(F.col("bits"))).drop("both")


def entries_of(lines: DataFrame, t: int) -> DataFrame:
    """(tok, pos, n, bits, bits2, doc, line): the words by which lines meet first."""
    prefix = F.slice("pre", F.lit(1), F.col("n") - _need(F.col("n"), t) + 1)
    return lines.select("doc", "line", "n", "bits", "bits2", F.posexplode(prefix).alias("pos", "tok"))


def index(docs: DataFrame, repeated: DataFrame, ranks: list[int], t: int) -> DataFrame:
    """(tok, pos, n, bits, bits2, doc, line): the prefixes of all lines that are the first of their text."""
    return entries_of(line_sets(docs, repeated, ranks, t), t)


def held(crowded: DataFrame, lines: DataFrame) -> DataFrame:
    """``lines`` that have keys in ``crowded``, with these as ``_keys``; a line fetches its prefix once for all its keys."""
    keys = crowded.groupBy("doc", "line").agg(F.collect_list(F.struct("tok", "pos")).alias("_keys"))
    return lines.drop("whole").join(keys, ["doc", "line"])


def _in_part(key: Column, part: int, parts: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(parts)) == part


def _part(entries: DataFrame, part: int, parts: int) -> DataFrame:
    return entries.where(_in_part(F.col("tok"), part, parts)) if parts > 1 else entries


def extended(lines: DataFrame, columns: list[str], k: int, t: int, part: int = 0, parts: int = 1) -> DataFrame:
    """Entries on keys of ``k`` + 1 words of lines as ``held`` gives them; all entries on a key are in the same part."""
    keys = F.filter("_keys", lambda x: _in_part(x["tok"], part, parts)) if parts > 1 else F.col("_keys")
    rows = lines.select("*", F.explode(keys).alias("_key")).select("*", "_key.*")
    rest = F.slice("pre", F.col("pos") + 2, F.greatest(_nexts(k, t), F.lit(0)))
    return rows.select(*columns, F.posexplode(rest).alias("_i", "_next")).select(*[
        {"tok": F.xxhash64("tok", "_next"), "pos": (F.col("pos") + 1 + F.col("_i")).cast("int")}.get(c, F.col(c)).alias(c)
        for c in columns
    ])


def _nexts(k: int, t: int) -> Column:
    """Words after a key of ``k`` words in the prefix for keys of one word more."""
    return F.col("n") - _need(F.col("n"), t) + k - F.col("pos")


def longer(crowded: DataFrame, lines: DataFrame, k: int, t: int) -> DataFrame:
    """Entries on keys of ``k`` + 1 words, from those on keys of ``k``."""
    return extended(held(crowded, lines), crowded.columns, k, t)


def longer_parts(crowded: DataFrame, lines: DataFrame, k: int, t: int, most: int) -> list[DataFrame]:
    """``longer`` in as many parts as leave each some ``most`` entries; a part has all lines of its keys.

    Only the lines with their keys are written, so that disk is needed for the entries of one part at a time.
    """
    few = crowded.select("doc", "line").distinct()
    if few.limit(FEW_LINES + 1).count() <= FEW_LINES:  # else nearly all lines would be shuffled for them
        lines = lines.join(F.broadcast(few), ["doc", "line"], "left_semi")
    entries = crowded.agg(F.sum(F.greatest(_nexts(k, t), F.lit(0)))).first()[0] or 0
    parts = max(1, -(-entries // most))
    kept = stored(held(crowded, lines))
    return [extended(kept, crowded.columns, k, t, i, parts) for i in range(parts)]


def _apart(a, b, maps: list[str]) -> Column:
    """Bits in which the bitmaps of two entries differ."""
    return sum((F.bit_count(a(c).bitwiseXOR(b(c))) for c in maps[1:]), F.bit_count(a(maps[0]).bitwiseXOR(b(maps[0]))))


def _maps(entries: DataFrame) -> list[str]:
    return [c for c in entries.columns if c.startswith("bits")]


def _passes(a, b, t: int, maps: list[str], k: int = 1) -> Column:
    """Length, positional and bitmap filters for two entries that share a key of ``k`` words."""
    least = _least(a("n"), b("n"), t)
    return (
        (100 * F.least(a("n"), b("n")) >= t * F.greatest(a("n"), b("n")))
        & (_apart(a, b, maps) <= a("n") + b("n") - 2 * least)
        & (F.least(a("n") - a("pos"), b("n") - b("pos")) + (k - 1) >= least)
    )


def _slack(a, b, t: int, maps: list[str]) -> Column:
    """How far a pair is above what the bitmaps ask for; true pairs are far above."""
    return (a("n") + b("n") - 2 * _least(a("n"), b("n"), t) - _apart(a, b, maps)).cast("int").alias("slack")


def _before(a, b) -> Column:
    return (a("doc") < b("doc")) | ((a("doc") == b("doc")) & (a("line") < b("line")))


def word_sizes(entries: DataFrame) -> DataFrame:
    """(tok, lines) of words on more than one line."""
    return entries.groupBy("tok").agg(F.count(F.lit(1)).alias("lines")).where("lines > 1")


def in_pairs(
    entries: DataFrame, sizes: DataFrame, t: int, crowd: int = CROWD, k: int = 1, settled: DataFrame | None = None
) -> DataFrame:
    """Pairs (doc, line, by_doc, by_line) of a line, not settled, and an earlier one on a key of few lines, if they may match."""
    few = entries.join(sizes.where(F.col("lines") <= crowd).select("tok"), "tok")
    return _joined(few, few if settled is None else _open(few, settled), t, k)


def _open(entries: DataFrame, settled: DataFrame) -> DataFrame:
    return entries.join(settled.select("doc", "line").distinct(), ["doc", "line"], "left_anti")


def _joined(earlier: DataFrame, later: DataFrame, t: int, k: int = 1) -> DataFrame:
    a, b, maps = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}")), _maps(earlier)
    return earlier.alias("a").join(
        later.alias("b"), (F.col("a.tok") == F.col("b.tok")) & _before(a, b) & _passes(a, b, t, maps, k)
    ).select(
        b("doc").alias("doc"), b("line").alias("line"), a("doc").alias("by_doc"), a("line").alias("by_line"),
        _slack(a, b, t, maps),
    ).distinct()


def with_leaders(crowded: DataFrame, t: int, k: int = 1) -> DataFrame:
    """Pairs of a line and the first line on one of its keys, if they may match."""
    maps = _maps(crowded)
    leaders = crowded.groupBy("tok").agg(F.min(F.struct("doc", "line", "n", "pos", *maps)).alias("a"))
    a, b = (lambda c: F.col("a")[c]), F.col
    return crowded.join(leaders, "tok").where(_before(a, b) & _passes(a, b, t, maps, k)).select(
        "doc", "line", a("doc").alias("by_doc"), a("line").alias("by_line"), _slack(a, b, t, maps)
    ).distinct()


def with_earlier(crowded: DataFrame, settled: DataFrame, t: int, k: int = 1) -> DataFrame:
    """Pairs of a line that is not settled and any earlier one on a key of many lines, if they may match."""
    return _joined(crowded, _open(crowded, settled), t, k)


def still_open(crowded: DataFrame, settled: DataFrame) -> DataFrame:
    """The entries on keys that have a line which is not settled."""
    return crowded.join(_open(crowded, settled).select("tok").distinct(), "tok", "left_semi").select(*crowded.columns)


def verified(docs: DataFrame, pairs: DataFrame, t: int) -> DataFrame:
    """The pairs whose word sets are alike; texts are fetched for lines in pairs only."""
    wanted = pairs.select("doc", "line").unionByName(
        pairs.select(F.col("by_doc").alias("doc"), F.col("by_line").alias("line"))
    ).distinct()
    texts = _marked(docs, wanted, "inner").select(
        "doc", F.explode("numbers").alias("line"), F.split("text", "\n").alias("all")
    ).select("doc", "line", F.get("all", F.col("line")).alias("a"))
    other = texts.select(F.col("doc").alias("by_doc"), F.col("line").alias("by_line"), F.col("a").alias("b"))
    both = pairs.join(texts, ["doc", "line"]).join(other, ["by_doc", "by_line"])
    sets = both.withColumn("a", F.array_distinct(_split(F.col("a")))).withColumn("b", F.array_distinct(_split(F.col("b"))))
    shared = F.size(F.array_intersect("a", "b"))
    return sets.where(shared * (100 + t) >= t * (F.size("a") + F.size("b"))).select("doc", "line", "by_doc", "by_line")


def settled(docs: DataFrame, pairs: DataFrame, t: int) -> DataFrame:
    """For every line that has one, a verified pair.

    The likeliest partner of each line is verified first; lines that it does not settle go through all their partners.
    """
    best = pairs.groupBy("doc", "line").agg(F.max(F.struct("slack", "by_doc", "by_line")).alias("b"))
    found = stored(verified(docs, best.select("doc", "line", "b.by_doc", "b.by_line"), t))
    open_ = stored(pairs.join(found.select("doc", "line"), ["doc", "line"], "left_anti"))
    return found if open_.isEmpty() else found.unionByName(stored(verified(docs, open_, t)))


def plain(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, text) of every row, for ids that are whole numbers and tell all rows apart."""
    return docs.select(F.col(id_col).cast("long").alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def _digests(id_: Column, text: Column) -> tuple[Column, Column]:
    both = id_.isNull(), id_, F.coalesce(text, F.lit(""))  # a hash leaves nulls out
    return F.xxhash64(*both).alias("_d1"), F.xxhash64(F.lit("second"), *both).alias("_d2")


def _tell_apart(docs: DataFrame, id_col: str) -> bool:
    """Are the ids whole numbers, one for each row?"""
    if not isinstance(docs.schema[id_col].dataType, IntegralType):
        return False
    ids = docs.groupBy(F.col(id_col).alias("id")).agg(F.count(F.lit(1)).alias("n"))
    found = ids.agg(F.max("n").alias("n"), F.max(F.col("id").isNull()).alias("none")).first()
    return (found["n"] or 0) <= 1 and not found["none"]


def documents(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame | None]:
    """(doc, text) of every document that has words, and (doc, _d1, _d2) to find it by its digests.

    Where ids tell the rows apart, they are the numbers of the documents and there are no digests.
    """
    if _tell_apart(docs, id_col):
        return plain(docs, id_col, text_col), None
    worded = docs.where(_has_word(F.col(text_col))).select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"), *_digests(F.col(id_col), F.col(text_col))
    )
    keys = stored(global_rank(
        worded.select("id", "_d1", "_d2").distinct(), [F.col("id").asc_nulls_first(), F.col("_d1"), F.col("_d2")], "doc"
    ).select("doc", "_d1", "_d2"))
    rows = worded.join(keys, ["_d1", "_d2"]).groupBy("_d1", "_d2").agg(F.min("doc").alias("doc"), F.first("text").alias("text"))
    return stored(rows.select("doc", "text")), keys


def repeated_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", t: int = 80, crowd: int = CROWD
) -> DataFrame:
    """(doc, line, by_doc, by_line): lines that go, each with an earlier line that is like it.

    ``doc`` is the number of the document as ``documents`` gives it.
    """
    return _repeated(documents(docs, id_col, text_col)[0], t, crowd)


def _repeated(rows: DataFrame, t: int, crowd: int = CROWD, most: int | None = None) -> DataFrame:
    """Longer keys are worked off in parts of ``most`` entries, by default half of those on single words or ``LEAST_PART``."""
    equal = stored(equal_lines(rows))
    lines = stored(line_sets(rows, equal.select("doc", "line"), rarity(rows), t))
    if most is None:
        most = max(LEAST_PART, (lines.agg(F.sum(F.col("n") - _need(F.col("n"), t) + 1)).first()[0] or 0) // 2)
    parts, found = [entries_of(lines, t)], None
    for k in range(1, DEPTH + 1):
        done = [_on_keys(entries, lines, found, t, crowd, k) for entries in parts]
        pairs, crowded = (reduce(DataFrame.unionByName, some) for some in zip(*done))
        found = _added(rows, found, pairs if len(parts) == 1 else stored(pairs.distinct()), t)
        crowded = stored(still_open(crowded, found))
        if crowded.isEmpty():
            break
        n = max(1, -(-crowded.count() // most))
        last = crowded if k == DEPTH else crowded.where(_need(F.col("n"), t) <= k)
        pairs = [stored(with_earlier(_part(last, i, n), found, t, k)) for i in range(n)]
        found = _added(rows, found, pairs[0] if n == 1 else stored(reduce(DataFrame.unionByName, pairs).distinct()), t)
        if k < DEPTH:
            parts = longer_parts(crowded, lines, k, t, most)
    return stored(equal.select(
        "doc", "line", F.col("first_doc").alias("by_doc"), F.col("first_line").alias("by_line")
    ).unionByName(found))


def _on_keys(
    entries: DataFrame, lines: DataFrame, found: DataFrame | None, t: int, crowd: int, k: int
) -> tuple[DataFrame, DataFrame]:
    """Pairs of lines that meet on keys of ``k`` words, and the entries on keys of many lines."""
    sizes = stored(word_sizes(entries))
    hot = stored(sizes.where(F.col("lines") > crowd).select("tok"))  # a table of its own tells Spark how small it is
    crowded = stored(entries.join(hot, "tok").select(*entries.columns))
    pairs = in_pairs(entries, sizes, t, crowd, k, found).unionByName(
        with_leaders(crowded, t, k) if found is None else _open(with_leaders(crowded, t, k), found)
    )
    if k == 1:
        # sets of few words cannot have longer keys in common; those that are equal meet here
        small = lines.where(_need(F.col("n"), t) <= DEPTH)
        pairs = pairs.unionByName(with_leaders(small.withColumn("tok", F.col("whole")).withColumn("pos", F.lit(0)), t))
    return stored(pairs.distinct()), crowded


def _added(rows: DataFrame, found: DataFrame | None, pairs: DataFrame, t: int) -> DataFrame:
    """``found`` and what of ``pairs`` proves right."""
    if found is None:
        return settled(rows, pairs, t)
    return found if pairs.isEmpty() else found.unionByName(settled(rows, pairs, t))


def _rest(text: Column, numbers: Column) -> Column:
    """The text without the lines of these numbers."""
    kept = F.filter(F.split(text, "\n"), lambda x, i: ~F.array_contains(numbers, i))
    return F.when(numbers.isNull(), text).otherwise(F.array_join(kept, "\n"))


def _without_repeated(docs: DataFrame, id_col: str, text_col: str, t: int) -> DataFrame:
    """``docs`` with the numbers of their lines that go."""
    rows, keys = documents(docs, id_col, text_col)
    gone = _repeated(rows, t)
    if keys is None:
        return _marked(docs.withColumn("doc", F.col(id_col).cast("long")), gone, "left")
    numbers = gone.groupBy("doc").agg(F.collect_set("line").alias("numbers")).join(keys, "doc").drop("doc")
    d1, d2 = _digests(F.col(id_col), F.col(text_col))
    return docs.select("*", d1, d2).join(numbers, ["_d1", "_d2"], "left")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", t: int = 80) -> DataFrame:
    """The documents with all their columns, their texts without repeated lines."""
    names = [f"_c{i}" for i in range(len(docs.columns))]
    at = dict(zip(docs.columns, names))
    marked = _without_repeated(docs.toDF(*names), at[id_col], at[text_col], t)
    return marked.select(*[
        (_rest(F.col(n), F.col("numbers")) if c == text_col else F.col(n)).alias(c) for c, n in at.items()
    ])


def line_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", t: int = 80) -> DataFrame:
    """(id, n_lines, n_removed, kept) of every document; kept is the text that stays."""
    held = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    marked = _without_repeated(held, "id", "text", t)
    n = F.size(F.filter(F.split("text", "\n"), _has_word))
    return marked.select(
        F.col("id").alias(id_col), n.cast("long").alias("n_lines"),
        F.coalesce(F.size("numbers"), F.lit(0)).cast("long").alias("n_removed"),
        _rest(F.col("text"), F.col("numbers")).alias("kept"),
    )

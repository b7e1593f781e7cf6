"""Spelling variants, collocations and benchmark windows against brute force."""

import os
import random
import re
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

sys.path.insert(0, os.path.dirname(__file__))
import llm_cases as cases  # noqa: E402

from strandloom.llm import collocations, decontam, runs, spelling  # noqa: E402


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# --- words of a buffer -------------------------------------------------------


@pytest.mark.parametrize("block", [1 << 22, 7])
def test_runs_equal_a_pattern(monkeypatch, block):
    monkeypatch.setattr(runs, "BLOCK", block)
    texts = cases.texts() + ["ab", "cd", "", "x" * 3000, "x" * 3000 + "y", "end."]
    array = pa.array(["skipped"] + texts).slice(1)
    data, offsets = runs.buffer(array)
    starts, ends = runs.find(data, offsets, decontam.IN_WORD)
    found = [data[s:e].tobytes() for s, e in zip(starts, ends)]
    pattern = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
    want = [w for t in texts for w in pattern.findall((t or "").encode())]
    assert found == want
    names = defaultdict(set)
    for w, h in zip(want, runs.hashes(data, starts, ends)):
        names[lower(w.decode("utf-8", "surrogateescape"))].add(int(h))
    assert all(len(h) == 1 for h in names.values())
    assert len({h for x in names.values() for h in x}) == len(names)


def test_slices_cover_all_texts():
    array = pa.array(["a" * 5, None, "", "b" * 30, "c", "d" * 9])
    cut = list(runs.slices(array, 10))
    assert [x for lo, hi in cut for x in range(lo, hi)] == list(range(6))
    assert all(hi - lo == 1 or sum(len(array[i].as_py() or "") for i in range(lo, hi)) <= 10 for lo, hi in cut)


def test_bitmap_has_all_its_hashes(spark):
    some = [int(x) for x in np.random.default_rng(1).integers(-(1 << 63), 1 << 63, 3000)]
    bitmap, bits = runs.make_bitmap(spark.createDataFrame([(x,) for x in some], "h long"), "h", len(some))
    assert runs.in_bitmap(bitmap, bits, np.array(some).view(np.uint64)).all()
    other = np.random.default_rng(2).integers(0, 1 << 63, 20_000).astype(np.uint64)
    assert runs.in_bitmap(bitmap, bits, other).mean() < 0.1


# --- spelling variants ---------------------------------------------------------


def one_error(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def test_index_finds_every_word_one_error_away():
    rnd = random.Random(1)
    for letters in (b"ab", b"ab\xe9", b"abcdefgh"):
        for n in (1, 2, 40, 250):
            known = sorted({bytes(rnd.choice(letters) for _ in range(rnd.randrange(5, 11))) for _ in range(n)})
            index = spelling.Index(known)
            asked = known + [b"zzzzz", b"aaaaa", b"ababz", b"a" * 300]
            found = defaultdict(list)
            for left in (True, False):
                for i, numbers in index.near(asked, left):
                    found[i] += numbers.tolist()
            for i, w in enumerate(asked):
                assert sorted(found[i]) == [j for j, v in enumerate(known) if one_error(w, v)], (w, known)


def plain_variants(rows):
    counts = Counter()
    for i, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = lower(w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 97 == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            counts[w] += 1
    known = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    near = {w: [v for v in known if one_error(w, v)] for w in known}
    form = {}
    for w, n in known.items():
        best = min(near[w], key=lambda v: (-known[v], v), default=None)
        if best is not None and known[best] >= 2 * n:
            form[w] = best
    out = {}
    for w, n in known.items():
        root = w
        while root in form:
            root = form[root]
        out[w] = form.get(w), root, n, len(near[w]), known[form[w]] if w in form else None
    return out


def variant_rows():
    rnd = random.Random(5)
    base = ["".join(rnd.choice("abé") for _ in range(rnd.randrange(5, 9))) for _ in range(60)]
    hot = ["hot" + "".join(rnd.choice("xy") for _ in range(rnd.randrange(2, 8))) for _ in range(60)]  # one beginning for half of the words
    chain = ["stone"] * 200 + ["stonne"] * 90 + ["stonnne"] * 40 + ["stonnnne"] * 15 + ["Éabcd", "éabcd"] * 3
    rows = [(i, t) for i, t in enumerate(cases.texts())]
    for i in range(40):
        rows.append((100 + i, " ".join(rnd.choice(base + hot) for _ in range(60)) + ", " + ", ".join(rnd.sample(chain, 30))))
    return rows + [rows[-1], (None, "stone Stone ×÷× stone"), (None, None), (7, "x" * 4000 + " " + "y" * 3)]


@pytest.mark.parametrize("shard", [16_384, 12])
def test_variants_equal_brute_force(spark, shard):
    rows = variant_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n", "'a' AS word", "'b' AS root")
    got = spelling.variant_groups(df, shard=shard).collect()
    want = plain_variants(rows)
    assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in got} == want
    assert len(got) == len(want) and sum(x[0] is not None for x in want.values()) > 10


def test_no_task_holds_more_than_a_block(spark):
    words = spark.range(5000).selectExpr("concat('hot', translate(cast(id + 10000 AS string), '0123456789', 'abcdefghij')) AS word", "5L AS n")
    placed = spelling._placed(words, 400).groupBy("task", "role").count().collect()
    assert max(r["count"] for r in placed) < 800
    assert len({r["task"] for r in placed}) > 100


def test_variants_of_an_empty_table(spark):
    assert spelling.variant_groups(cases.empty(spark)).collect() == []


# --- collocations ------------------------------------------------------------------


def plain_collocations(rows, least, top):
    counts, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                counts[lang].update(zip(*[w[i:] for i in range(k)]))
    out = []
    for lang, f in counts.items():
        some = {p: a for p, a in f.items() if 2 <= len(p) <= 4 and a >= least}
        kept = []
        for p, a in some.items():
            longer = [b for q, b in some.items() if len(q) > len(p) and any(q[i:i + len(p)] == p for i in range(len(q)))]
            if any(100 * b >= 80 * a for b in longer):
                continue
            score, k = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for i, x in enumerate(sorted(kept)[:top], 1):
            out.append((lang, i, x[2].decode(), -x[1], x[3], x[4], n[lang], -x[0]))
    return sorted(out)


def phrase_rows():
    rnd = random.Random(9)
    rows = [("en", t) for t in cases.texts()]
    for i in range(120):
        lang = ["en", "en", None, "und", "dé", ""][i % 6]
        words = [rnd.choice(["the", "of", "red", "House", "é", "of the", "new york city hall", "a b", "漢"]) for _ in range(30)]
        rows.append((lang, "".join(w + rnd.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x85"]) for w in words)))
    return rows + [rows[-1]] * 5


@pytest.mark.parametrize("budget", [1 << 21, 60])
def test_collocations_equal_brute_force(spark, budget):
    rows = phrase_rows()
    df = spark.createDataFrame(rows, "lang string, text string").selectExpr("*", "1 AS n", "2 AS d", "3 AS h1", "'x' AS phrase")
    got = collocations.collocations(df, least=4, top=30, budget=budget).collect()
    assert sorted((r.lang, r.rank, r.phrase, r.a, r.l, r.r, r.n, r.score) for r in got) == plain_collocations(rows, 4, 30)


def test_equal_suffixes_are_combined():
    rnd = np.random.default_rng(3)
    columns = [rnd.integers(1, 4, 500).astype(np.uint64) << np.uint64(50) for _ in range(4)]
    n = rnd.integers(1, 5, 500)
    want = Counter()
    for *key, k in zip(*columns, n):
        want[tuple(map(int, key))] += int(k)
    some, total = collocations._combined(columns, n)
    assert {tuple(map(int, key)): int(k) for *key, k in zip(*some, total)} == want


def test_scores_are_exact_beyond_64_bits(spark):
    node = "lang string, d int, h1 long, h2 long, h3 long, h4 long, f long"
    nodes = spark.createDataFrame([("en", 2, 1, 2, 0, 0, 10 ** 13 + 1)], node)
    words = spark.createDataFrame([("en", 1, 10 ** 13 + 3), ("en", 2, 10 ** 13 + 7)], "lang string, h long, n long")
    row = collocations.score_cuts(nodes, words).first()
    assert row.score == 2000000 * (10 ** 13 + 1) // (2 * 10 ** 13 + 10)


def test_collocations_of_an_empty_table(spark):
    assert collocations.collocations(cases.empty(spark)).collect() == []


# --- benchmark decontamination --------------------------------------------------------

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_hits(docs, items):
    windows = defaultdict(set)
    for i, text in items:
        w = WORD.findall(lower(text))
        for s in range(len(w) - min(10, len(w)) + 1 if w else 0):
            windows[tuple(w[s:s + 10])].add(i)
    sizes = {len(w) for w in windows}
    out = []
    for i, text in docs:
        w = WORD.findall(lower(text))
        hit, found = set(), set()
        for n in sizes:
            for s in range(len(w) - n + 1):
                if tuple(w[s:s + n]) in windows:
                    hit |= set(range(s, s + n))
                    found |= windows[tuple(w[s:s + n])]
        out.append((i, len(w), len(hit), sorted(str(x) for x in found if x is not None)))
    return sorted(out, key=str)


def test_windows_equal_brute_force(spark):
    rnd = random.Random(11)
    shared = [cases.words(rnd, n, 50) for n in (9, 10, 11, 12, 30, 60)]
    items = [(i, t) for i, t in enumerate(shared)]
    items += [(20 + i, "Shared header that many items begin with, ten words or more: " + cases.words(rnd, 15)) for i in range(30)]  # one window in most items
    items += [(60, "É-tiny Item"), (61, "x"), (62, ""), (63, None), (None, "an item without any id at all has eleven words here"), (0, shared[3]),
              (64, "one two three four five six seven"), (65, "one two three four five six seven eight"), (66, "a a a a a a a a a a a a a")]
    docs = [(i, t) for i, t in enumerate(cases.texts())]
    for i in range(60):
        w = cases.words(rnd, 40, 50).split(" ")
        part = rnd.choice(items)[1] or ""
        p = part.split(" ")
        cut = rnd.randrange(0, 3)
        w[rnd.randrange(40):1] = p[cut:len(p) - rnd.randrange(0, 3)]
        docs.append((100 + i, " ".join(w).replace(" ", rnd.choice([" ", "-", " \n", "\t. "])).upper() if i % 3 else " ".join(w)))
    docs += [docs[-1], (None, shared[5]), (None, items[10][1]), (500, "a " * 40), (501, "z" * 9000 + " " + shared[4])]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS row", "'w' AS window", "2 AS hash", "3 AS item_id")
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "9 AS doc_id", "'n' AS n")
    got = decontam.decontaminate(df, bench).collect()
    want = plain_hits(docs, items)
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in got), key=str) == want
    assert sum(x[2] > 0 for x in want) > 50
    for r in got:
        assert r.n_hit == len({i for s in r.spans for i in range(s.start, s.start + s.n)})


def test_least_takes_the_rightmost_of_equal_values():
    values = np.array([3, 1, 1, 5, 0, 0, 7], np.uint64)
    assert decontam.least(values, 3).tolist() == [2, 2, 4, 5, 5]
    assert decontam.least(values, 8).tolist() == []


def test_windows_without_rows(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert decontam.decontaminate(cases.empty(spark), some).collect() == []
    rows = decontam.decontaminate(cases.frame(spark, ["a b c", None]), none).collect()
    assert [(r.n_words, r.n_hit, r.spans, r["items"]) for r in sorted(rows, key=lambda r: r.doc_id)] == [(3, 0, [], []), (0, 0, [], [])]


def test_phrase_tasks_hold_little_memory():
    """A task's arrays follow from its slices and the suffixes it holds, not from its batch."""
    import tracemalloc

    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(50_000)]
    texts = [" ".join(words[i] for i in rng.integers(0, len(words), 500)) for _ in range(3_000)]
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * len(texts)), pa.array(texts)], names=["lang", "text"])

    class Shared:
        value = collocations.Plan(np.full(1 << 13, 255, np.uint8), 16, np.arange(1, 64, dtype=np.uint64) << np.uint64(10), 0)

    def peak(run):
        total = 0
        tracemalloc.start()
        try:
            for out in run(iter([batch])):
                column = "n"
                n = out.column(column)
                total += int(np.frombuffer(n[0].as_py(), np.uint32).sum()) if pa.types.is_binary(n.type) else sum(n.to_pylist())
            return total, tracemalloc.get_traced_memory()[1] / 1e6
        finally:
            tracemalloc.stop()

    total, mb = peak(collocations._deal(Shared))
    assert total == 3_000 * 499 and mb < 130, (total, mb)
    total, mb = peak(collocations._count_words(0))
    assert total == 3_000 * 500 and mb < 90, (total, mb)

import os
import random
import re
import sys
from collections import Counter

import numpy as np

sys.path.insert(0, os.path.dirname(__file__))
import llm_cases as cases  # noqa: E402

from strandloom.llm import line_dedup, simhash, winnow  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402


def plain_fingerprint(text):
    from xxhash import xxh64_intdigest

    w = (text or "").encode().lower().split()
    if not w:
        return 0
    s = [b" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or [b" ".join(w)]
    hs = [xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def components(fps):
    """Smallest id for each document, from all pairs."""
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_every_close_pair_collides():
    rnd, tables = random.Random(1), [m & (1 << 64) - 1 for m in simhash.masks()]
    assert len(tables) == 15 and all(bin(m).count("1") == 32 for m in tables)
    for _ in range(3000):
        flips = sum(1 << b for b in rnd.sample(range(64), rnd.randrange(4)))
        assert any(not flips & m for m in tables)


def test_groups_equal_brute_force(spark):
    some = cases.texts()
    fps = [plain_fingerprint(t) for t in some]
    want = components(fps)
    got = {r.doc_id: r for r in simhash.near_duplicates(cases.frame(spark)).collect()}
    for i, (f, c) in enumerate(zip(fps, want)):
        assert (got[i].fp & (1 << 64) - 1, got[i].component_id) == (f, c), i
    assert len(got) == len(some) + 1
    assert simhash.near_duplicates(cases.empty(spark)).count() == 0
    kept = simhash.keep_one(cases.frame(spark))
    assert kept.columns == cases.frame(spark).columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(set(want))
    assert simhash.keep_one(cases.empty(spark)).count() == 0


def test_one_stays_of_each_component_whatever_its_id(spark):
    rnd = random.Random(11)
    texts = [cases.words(rnd, 60) for _ in range(8)]
    near = texts[6] + "  "  # other text, same fingerprint
    rows = [
        *[(None, t) for t in texts[:4]], (None, texts[0]), (None, None), (None, ""),
        (1, texts[4]), (1, texts[5]),  # one id, two texts
        (0, texts[6]), (2, near), (2, texts[7]),  # 2 stays for one text and goes for the other
        (None, texts[7]), (3, texts[3].upper()), (3, texts[3].upper()),
    ]
    df = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, n long")
    fps = [plain_fingerprint(t) for _, t in rows]
    groups = {}
    for (i, t), c in zip(rows, components(fps)):
        groups.setdefault(c, []).append((i is None, i or 0, t))
    assert len(groups) == 9
    kept = simhash.keep_one(df).collect()
    assert len(kept) == len(groups)
    left = Counter((r.doc_id, r.text) for r in kept)
    for g in groups.values():
        least = min(x[:2] for x in g)
        assert sum(left[(None if none else i, t)] for none, i, t in set(g) if (none, i) == least) == 1, g
        assert not any(left[(None if none else i, t)] for none, i, t in set(g) if (none, i) != least), g


def test_crowded_buckets_are_exact(spark):
    rnd = random.Random(5)
    base = [rnd.getrandbits(64) for _ in range(3)]
    fps = sorted({b ^ sum(1 << x for x in rnd.sample(range(64), rnd.randrange(7))) for b in base for _ in range(70)})
    want = components(fps)
    rows = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    df = spark.createDataFrame(rows, "fp long")
    for most in (2, 4096):
        root = {r[0]: r[0] for r in rows}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        edges = simhash.links(df, most=most).collect()
        for a, b in edges:
            assert bin((a ^ b) & (1 << 64) - 1).count("1") <= 3
            root[find(a)] = find(b)
        groups = Counter(find(r[0]) for r in rows)
        assert sorted(groups.values()) == sorted(Counter(want).values())


def test_crowded_buckets_are_exact_for_other_radii(spark):
    rnd = random.Random(6)
    base = rnd.getrandbits(64)
    fps = sorted({base ^ sum(1 << x for x in rnd.sample(range(64), rnd.randrange(5))) for _ in range(120)})
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    far = lambda a, b: bin((a ^ b) & (1 << 64) - 1).count("1")

    def groups(edges):
        root = {f: f for f in fps}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in edges:
            root[find(a)] = find(b)
        return sorted(Counter(find(f) for f in fps).values())

    for radius in (1, 2, 4):
        edges = [(a & (1 << 64) - 1, b & (1 << 64) - 1) for a, b in simhash.links(df, radius, most=2).collect()]
        assert all(far(a, b) <= radius for a, b in edges)
        assert groups(edges) == groups((a, b) for a in fps for b in fps if a < b and far(a, b) <= radius), radius
    try:
        simhash.links(df, 5, most=2)
        assert False
    except ValueError:
        pass


def plain_winnow(toks, k, w, h):
    grams = [h(toks[i:i + k]) for i in range(len(toks) - k + 1)] or ([h(toks)] if toks else [])
    out = set()
    for i in range(max(1, len(grams) - w + 1)):
        window = grams[i:i + w]
        if window:
            least = min(window)
            out.add((least, i + max(j for j, x in enumerate(window) if x == least)))
    return sorted(out, key=lambda x: x[1])


def test_winnowing_equals_brute_force(spark):
    from xxhash import xxh64_intdigest

    def gram(toks):
        h = 42
        for t in toks:  # a row of numbers is hashed one after another, each with the last as seed
            h = xxh64_intdigest((xxh64_intdigest(t.encode(), 42)).to_bytes(8, "little"), h)
        return h & 0xFFFFFFFF

    def cut(text):
        out, wide = [], "\u0e00-\u0eff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff"
        for t in re.findall(f"[{wide}]|[^ \t-\r{wide}]{{1,16}}", text or ""):
            out.append(t)
        return out

    some = [*cases.texts(), "a b c " * 30, "x " * 40, "漢字かなカナ test " * 5, "one", "one two"]
    df = cases.frame(spark, some)
    for k, w in ((3, 8), (5, 4), (1, 7), (4, 1)):
        for r in df.select("text", winnow.winnow(F.col("text"), k, w).alias("f")).collect():
            assert [(x["hash"], x["pos"]) for x in r.f] == plain_winnow(cut(r.text), k, w, gram), (r.text, k, w)


def test_edited_texts(spark):
    some = cases.texts()
    rows = winnow.compare_with_edit(cases.frame(spark, some)).withColumn(
        "near", winnow.likeness(F.col("prints"), F.col("edited_prints"))
    ).withColumn("next", winnow.likeness(F.col("prints"), F.col("next_prints"))).collect()
    assert len(rows) == len(some)
    for r in rows:
        t, after = some[r.id] or "", some[(r.id + 1) % len(some)] or ""
        cut = len(t) // 4
        assert r.n_chars == len(t) and r.edited == t[:len(t) - cut] + after[:cut]
        a, b = set(r.prints), set(r.edited_prints)
        assert r.near == (len(a & b) / len(a | b) if a | b else 1.0) and 0 <= r.next <= 1
        assert set(r.next_prints) == set(next(x.prints for x in rows if x.id == (r.id + 1) % len(some)))
    odd = winnow.compare_with_edit(cases.frame(spark))  # a repeated row and a row without id
    assert odd.count() == len(some) + 2
    assert winnow.compare_with_edit(cases.empty(spark)).count() == 0
    one = winnow.compare_with_edit(cases.frame(spark, ["abcdefgh"])).collect()
    assert one[0].edited == "abcdefab"


def lines_that_go(docs):
    """(doc, line) of lines with an earlier line of the same text or likeness 0.8, from all pairs."""
    lines = [(i, j, x) for i, t in sorted(docs) for j, x in enumerate((t or "").split("\n")) if x.encode().split()]
    out = set()
    for n, (i, j, x) in enumerate(lines):
        a = set(x.encode().split())
        for _, _, y in lines[:n]:
            b = set(y.encode().split())
            if x == y or 10 * len(a & b) >= 8 * len(a | b):
                out.add((i, j))
                break
    return out


def similar_lines(seed):
    rnd = random.Random(seed)
    base = [cases.words(rnd, rnd.randrange(1, 30), 30) for _ in range(40)]
    docs = []
    for _ in range(50):
        lines = []
        for _ in range(rnd.randrange(6)):
            w = rnd.choice(base).split(" ")
            for _ in range(rnd.randrange(3)):
                w[rnd.randrange(len(w))] = rnd.choice(["new", "word", "x", "y1"])
            rnd.shuffle(w)
            lines.append(" ".join(w))
        docs.append("\n".join(lines))
    return docs


def test_lines_equal_brute_force(spark):
    for some in (cases.texts(), similar_lines(1), similar_lines(2)):
        gone = lines_that_go(list(enumerate(some)))
        df = cases.frame(spark, some)
        found = line_dedup.repeated_lines(df).collect()
        assert {(r.doc, r.line) for r in found} == gone
        if len(some) == 50 and some[0] == similar_lines(1)[0]:  # nearly all words are crowded
            assert {(r.doc, r.line) for r in line_dedup.repeated_lines(df, crowd=2).collect()} == gone
        at = {(i, j): x for i, t in enumerate(some) for j, x in enumerate((t or "").split("\n"))}
        for r in found:
            a, b = (set(at[k].encode().split()) for k in ((r.doc, r.line), (r.by_doc, r.by_line)))
            assert (r.by_doc, r.by_line) < (r.doc, r.line) and 10 * len(a & b) >= 8 * len(a | b)
        out = {r.doc_id: r for r in line_dedup.dedup_lines(df).collect()}
        for i, t in enumerate(some):
            kept = None if t is None else "\n".join(x for j, x in enumerate(t.split("\n")) if (i, j) not in gone)
            assert (out[i].text, out[i].id, out[i].doc) == (kept, f"x{i}", -i)
        report = {r.doc_id: r for r in line_dedup.line_report(df).collect()}
        assert sum(r.n_removed for r in report.values()) == len(gone)


def test_lines_of_odd_tables(spark):
    df = cases.frame(spark)
    out = line_dedup.dedup_lines(df)
    assert out.columns == df.columns and out.count() == df.count()
    assert line_dedup.dedup_lines(cases.empty(spark)).count() == 0
    assert line_dedup.line_report(cases.empty(spark)).count() == 0


def test_lines_of_rows_without_an_id_of_their_own(spark):
    """Rows that share an id, or have none, are documents of their own unless their texts are equal."""
    some = similar_lines(3)
    ids = [None, None, 7, -1, 7, None, 9, 9, 3, -1]
    rows = [(ids[n % 10], t) for n, t in enumerate(some)] + [(7, some[2]), (7, some[2]), (None, some[0]), (None, None), (None, "")]
    df = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, n long")
    key = {r.n: (r.doc_id is not None, r.doc_id or 0, r._d1, r._d2) for r in df.select(
        "*", *line_dedup._digests(F.col("doc_id"), F.col("text"))).collect()}
    place = {k: i for i, k in enumerate(sorted(set(key.values())))}
    gone = lines_that_go(list({place[key[n]]: t for n, (_, t) in enumerate(rows)}.items()))
    for n, text in df.join(line_dedup.dedup_lines(df).select("n", F.col("text").alias("kept")), "n").select("n", "kept").collect():
        t = rows[n][1]
        want = None if t is None else "\n".join(x for j, x in enumerate(t.split("\n")) if (place[key[n]], j) not in gone)
        assert text == want, n
    report = line_dedup.line_report(df).collect()
    assert len(report) == len(rows) and all(r.n_removed <= r.n_lines for r in report)
    assert sum(r.n_removed for r in report) == sum(g[0] == place[key[n]] for n in range(len(rows)) for g in gone)
    named = df.select(F.concat(F.lit("x"), "doc_id").alias("doc_id"), "text")  # ids need not be numbers
    assert line_dedup.dedup_lines(named).count() == len(rows)


def test_near_line_groups_do_not_meet_in_pairs(spark):
    """All but the first of a large group are settled by the first."""
    rnd = random.Random(9)
    base = cases.words(rnd, 60).split(" ")
    some = [" ".join([*base[:i % 60], f"n{i}", *base[i % 60 + 1:]]) for i in range(300)]
    df = line_dedup.plain(cases.frame(spark, some), "doc_id", "text")
    none = line_dedup.equal_lines(df).select("doc", "line")
    entries = line_dedup.index(df, none, line_dedup.rarity(df), 80)
    led = line_dedup.verified(df, line_dedup.with_leaders(entries, 80), 80)
    assert led.select("doc").distinct().count() == 299
    assert line_dedup.with_earlier(entries, led, 80).count() == 0
    assert np.isfinite(led.count()) and led.count() < 300 * 14


def test_leaders_of_hot_words_need_no_sorted_group(spark):
    rows = [(w, 0, 5, 0, d, 0) for w in (1, 2) for d in (3, 2, 4)]
    entries = spark.createDataFrame(rows, "tok long, pos int, n int, bits long, doc long, line int")
    led = line_dedup.with_leaders(entries, 80)
    assert "Window" not in led._jdf.queryExecution().toString()
    assert sorted((r.doc, r.by_doc) for r in led.collect()) == [(3, 2), (4, 2)]


def test_longer_keys_fetch_a_prefix_once_for_each_line(spark):
    shape = "tok long, pos int, n int, bits long, bits2 long, doc long, line int"
    lines = spark.createDataFrame(
        [(d, 0, 20, 0, 0, 0, list(range(1, 8))) for d in (1, 2)], "doc long, line int, n int, bits long, bits2 long, whole long, pre array<long>"
    )
    crowded = spark.createDataFrame([(p + 1, p, 20, 0, 0, d, 0) for d in (1, 2) for p in range(5)], shape)
    df = line_dedup.longer(crowded, lines, 1, 80)
    assert df.columns == crowded.columns
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    joined = plan[plan.index("Join Inner"):]
    assert "collect_list" in joined and "collect_list" not in plan[:plan.index("Join Inner")]
    hashed = dict(spark.range(1).select(F.explode(F.array(*[
        F.struct(F.lit(a * 10 + b).alias("k"), F.xxhash64(F.lit(a).cast("long"), F.lit(b).cast("long")).alias("h"))
        for a in range(1, 8) for b in range(a + 1, 8)])).alias("s")).select("s.*").collect())
    want = sorted((d, hashed[a * 10 + b], b - 1) for d in (1, 2) for a in range(1, 6) for b in range(a + 1, 7))
    assert sorted((r.doc, r.tok, r.pos) for r in df.collect()) == want


def test_longer_keys_are_worked_off_in_parts(spark, monkeypatch):
    """Entries on keys of several words are many times those on single words; they do not meet all at once."""
    kept, written = line_dedup.stored, []

    def counted(df):
        out = kept(df)
        if out.columns == ["tok", "lines"]:
            written.append(out.agg(F.sum("lines")).first()[0] or 0)
        return out

    monkeypatch.setattr(line_dedup, "stored", counted)
    monkeypatch.setattr(line_dedup, "LEAST_PART", 1, raising=False)
    some = similar_lines(1)
    rows = line_dedup.plain(cases.frame(spark, some), "doc_id", "text")
    found = line_dedup._repeated(rows, 80, 2).collect()
    assert {(r.doc, r.line) for r in found} == lines_that_go(list(enumerate(some)))
    assert len(written) > 2 and max(written) <= written[0] * 1.1, written

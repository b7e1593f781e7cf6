import os
import random
import re
import sys
from collections import Counter
from datetime import date

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(__file__))
import llm_cases as cases  # noqa: E402

from strandloom.llm import license_scan, mixing, quality, url_lists  # noqa: E402
from strandloom.llm.license_texts import TEMPLATES  # noqa: E402


def plain_base(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen = Counter(zip(w, w[1:], w[2:]))
    repeated = {i + j for i in range(len(w) - 2) if seen[tuple(w[i:i + 3])] > 1 for j in range(3)}
    lines, dup = set(), 0
    for x in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in lines
            lines.add(x)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(repeated)


def test_base_counts_equal_brute_force():
    rnd = random.Random(2)
    some = cases.texts() + ["".join(rnd.choice("ab \n\t#*|\xa0") for _ in range(rnd.randrange(60))) for _ in range(500)]
    for t in some:
        assert quality.base_counts(t) == plain_base(t), repr(t)


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_score_equals_brute_force(spark):
    some = cases.texts()
    df, good = cases.frame(spark, some), list(range(0, 60, 2))
    marks = labels(spark, [(i, 1, 0) for i in good] + [(1, 0, 0), (3, 1, 1), (None, 1, 0)])
    table = quality.ratio_table(df, marks)

    def count(rows):
        out = np.ones(quality.BUCKETS)
        for i in rows:
            raw = (some[i] or "").encode()
            for j in range(len(raw) - quality.N + 1):
                h = 0
                for b in raw[j:j + quality.N]:
                    h = (h * 0x100000001B3 + b) % (1 << 64)
                h ^= h >> 29
                out[(h * 0x9E3779B97F4A7C15 % (1 << 64)) >> 48] += 1
        return out

    target, raw = count(good), count(range(len(some)))
    assert np.allclose(table, np.log(target / target.sum()) - np.log(raw / raw.sum()))
    got = {r.doc_id: r for r in quality.judge(df, marks).collect()}
    for i, t in enumerate(some):
        n, _, _, _, rep = plain_base(t)
        failed = n < 50 or 100 * rep > 50 * n
        assert (got[i].n_words, got[i].n_repeat_words, got[i].base_failed) == (n, rep, failed)
        assert got[i].score == pytest.approx(quality.score(t, table))
        assert got[i].kept == (not failed and got[i].score >= quality.THRESHOLD)


def test_long_texts_are_scored_in_pieces(monkeypatch):
    table = np.random.default_rng(1).normal(size=quality.BUCKETS)
    whole = quality.score("some text of several words " * 50, table)
    monkeypatch.setattr(quality, "CHUNK", 7)
    assert quality.score("some text of several words " * 50, table) == pytest.approx(whole)


def test_junk_goes_and_clean_stays(spark):
    rnd = random.Random(4)
    clean = [" ".join(rnd.choice(["the", "water", "house", "runs", "over", "green", "stone", "we", "saw"]) + rnd.choice(["", "s"])
                      for _ in range(120)) for _ in range(40)]
    junk = [" ".join(w.upper() + rnd.choice(["!!", "$$$", "%%%"]) for w in cases.words(rnd, 120).split(" ")) for _ in range(20)]
    df = cases.frame(spark, clean + junk)
    kept = quality.keep_good(df, labels(spark, [(i, 1, 0) for i in range(20)]))
    assert sorted(r.doc_id for r in kept.collect()) == list(range(40)) and kept.columns == df.columns
    assert quality.keep_good(df, labels(spark, [])).count() == 60  # no trusted documents: rules only
    assert quality.keep_good(cases.empty(spark), labels(spark, [(1, 1, 0)])).count() == 0
    assert quality.judge(cases.frame(spark), labels(spark, [(1, 1, 0)])).count() == cases.frame(spark).count()


def plain_licenses(text):
    """Best containment of every template over all places of the text, from word sets."""
    def shingles(t):
        w = re.findall(r"(?:[a-z0-9]|[^\x00-\x7f])+", "".join(c.lower() if c.isascii() else c for c in t or ""))
        return [tuple(w[i:i + 5]) for i in range(len(w) - 4)]

    doc, out = shingles(text), []
    for name, body in sorted(TEMPLATES.items()):
        want = set(shingles(body))
        n = len(shingles(body))
        spare = n // 4 + 5
        best = max((len(want & set(doc[max(0, s - spare):s + n + spare])) / len(want)
                    for s in range(-n, len(doc)) if doc), default=0)
        if best >= 0.8:
            out.append(name)
    return out


def test_licenses_equal_brute_force(spark):
    rnd = random.Random(6)
    some = list(cases.texts())
    for name, body in TEMPLATES.items():
        for edit in range(4):
            w = body.split(" ")
            if edit == 1:
                w = [x.upper() for x in w]
            if edit == 2 and len(w) > 40:
                w.insert(rnd.randrange(len(w)), "added")
            if edit == 3:
                w = w[:len(w) // 3]
            some.append(cases.words(rnd, rnd.randrange(30)) + ("\n" if edit else " ") + " ".join(w) + "\n" + cases.words(rnd, 9))
    got = {r.doc_id: [x["template"] for x in r.found] for r in license_scan.scan_documents(cases.frame(spark, some), TEMPLATES).collect()}
    for i, t in enumerate(some):
        assert got[i] == plain_licenses(t), (i, t)
    assert sum(map(len, got.values())) > 30
    assert license_scan.scan_documents(cases.empty(spark), TEMPLATES).count() == 0
    assert all(not r.found for r in license_scan.scan_documents(cases.frame(spark), {}).collect())


def test_bands_hold_the_probability():
    b = license_scan.bands(0.8, 2, 1e-3)
    assert (1 - 0.8 ** 2) ** b <= 1e-3 < (1 - 0.8 ** 2) ** (b - 1)


def test_dated_lists(spark):
    d = lambda m, x=1: date(2024, m, x)
    entries = spark.createDataFrame([
        ("bad.org", d(2), "block"), ("bad.org", d(5), "allow"), ("ok.bad.org", d(3), "allow"), ("BAD.org ", d(5), "allow"),
        ("two.net", d(2), "allow"), ("two.net", d(2), "block"), (None, d(1), "block"), ("x.y", None, "block"),
    ], "domain string, day date, action string")
    rows = [
        (1, "http://bad.org/a", d(1, 31), False), (2, "https://WWW.bad.org:8080/a?b", d(2), True),
        (3, "http://u@ok.bad.org", d(2, 20), True), (4, "http://ok.bad.org.", d(3), False), (5, "http://bad.org", d(5), False),
        (6, "http://bad.org", d(4, 30), True), (7, "http://two.net", d(6), True), (8, None, d(6), False), (9, "", d(6), False),
        (10, "no url", d(6), False), (11, "http://bad.org", None, False), (12, "http://notbad.org/", d(3), False),
    ]
    captures = spark.createDataFrame([(*r[:3], "x") for r in rows] + [(*rows[1][:3], "x")], "page_id long, url string, day date, host string")
    got = url_lists.judge(captures, entries).collect()
    assert len(got) == 13
    assert {r.page_id: r.blocked for r in got} == {r[0]: r[3] for r in rows}
    assert {r.page_id: r.listed_domain for r in got}[3] == "bad.org"
    assert not any(r.blocked for r in url_lists.judge(captures, entries.limit(0)).collect())
    assert url_lists.judge(captures.limit(0), entries).count() == 0


def plain_targets(sizes):
    names = sorted([s for s in sizes if s is not None], key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in full]
        left = total - sum(3 * sizes[s] for s in full)
        target = {s: left * weight[s] / sum(weight[x] for x in free) for s in free} | {s: 3 * sizes[s] for s in full}
        over = {s for s in free if target[s] > 3 * sizes[s]}
        if not over:
            return target
        full |= over


def test_mix_meets_its_targets(spark):
    rnd = random.Random(8)
    some = [cases.words(rnd, rnd.randrange(1, 200) if i % 6 != 4 else 3) for i in range(600)] + [None, "", " "]
    rows = mixing.mix(cases.frame(spark, some)).collect()
    assert len(rows) == len(some)
    source = lambda i: [None, "a", "b", "B", "é", "z"][i % 6]
    sizes = Counter()
    for i, t in enumerate(some):
        sizes[source(i)] += len((t or "").split())
    want, taken = plain_targets(dict(sizes)), Counter()
    for r in rows:
        s = source(r.doc_id)
        assert r["size"] == len((some[r.doc_id] or "").split()) and r.source_size == sizes[s]
        assert r.target == pytest.approx(want[s]) and r.taken == r.copies * r["size"] <= 3 * r["size"]
        taken[s] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(3, 0.01 * want[s]), (s, taken[s], want[s])
    again = mixing.mix(cases.frame(spark, some).repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))


def test_mix_of_odd_tables(spark):
    df = cases.frame(spark)
    assert mixing.mix(df).count() == df.count()
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns
    want = sum(r.copies for r in mixing.mix(df).collect())
    assert out.count() == want
    assert mixing.mix(cases.empty(spark)).count() == 0 and mixing.mixed_documents(cases.empty(spark)).count() == 0
    assert all(r.target == 0 and r.taken == 0 for r in mixing.mix(cases.frame(spark, [None, "", " "])).collect())

import hashlib
import os
import random
import sys
from array import array
from zlib import crc32

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(__file__))
import llm_cases as cases  # noqa: E402

from strandloom.llm import bpe, token_counts, token_files  # noqa: E402

P = pytest.importorskip("public_tokenizers")


def pieces(seed, extra):
    rnd = random.Random(seed)
    some = [" ", "  ", "\n", "\t", "a", "B", "the", "▁", "é", "漢", "1", "23", "<s>", "\x00", "😀", "!", " ", *extra]
    return ["".join(rnd.choice(some) for _ in range(rnd.randrange(12))) for _ in range(4000)]


def by_id(df):
    out = {}
    for r in df.collect():
        out.setdefault(r[0], []).append(r)
    return out


def test_piece_counts_equal_the_library(spark):
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    one = token_counts.counter(path)
    assert one.separable and len(one.single) > 10_000
    for t in pieces(1, ["</s>", "<0x0A>"]):
        assert one.count(t) == len(model.encode(t)), repr(t)
    got = by_id(token_counts.count_tokens(cases.frame(spark), path, limit=100))
    for i, t in enumerate(cases.texts()):
        n = len(model.encode(t or ""))
        assert [tuple(r) for r in got[i]] == [(i, len((t or "").encode()), n, n > 100)] * (2 if i == 5 else 1)
    assert token_counts.count_tokens(cases.empty(spark), path).count() == 0


def test_bpe_equals_the_library(spark):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    model, own = Tokenizer.from_file(path), bpe.word_bpe(path)
    for t in pieces(2, ["<|endoftext|>", "'s", "'LL", "Σ", "İ", "é", "ß", "\x1c", "\x85", "​", "½", "٣"]):
        ids = model.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(own.encode(t), dtype="<u4").tolist() == ids, repr(t)
        assert own.decode(own.encode(t)) == model.decode(ids, skip_special_tokens=False)
    got = by_id(bpe.encode_decode(cases.frame(spark), path))
    for i, t in enumerate(cases.texts()):
        ids = model.encode(t or "", add_special_tokens=False).ids
        r = got[i][0]
        assert (r.n_tokens, np.frombuffer(r.ids, dtype="<u4").tolist()) == (len(ids), ids)
        assert r.decoded == model.decode(ids, skip_special_tokens=False)
    assert bpe.encode_decode(cases.empty(spark), path).count() == 0


def test_bpe_holds_few_rows_of_a_batch(spark, monkeypatch):
    path = P.path("word_bpe_49k.json")
    one, some = bpe.word_bpe(path), ["Hello", None, "", "two words", "a\nb", "é", "Hello"]
    monkeypatch.setattr(bpe, "STEP", 2)
    df = bpe.encode_decode(cases.frame(spark, some).coalesce(1), path)
    assert "MapInArrow" in df._jdf.queryExecution().executedPlan().toString()
    got = {r.doc_id: (r.n_tokens, bytes(r.ids), r.decoded) for r in df.collect()}
    assert got == {i: (len(x := one.encode(t)) // 4, x, one.decode(x)) for i, t in enumerate(some)}


def test_merge_takes_the_least_rank_and_skips_stale_pairs():
    own = bpe.WordBpe.__new__(bpe.WordBpe)
    own.merges = {(1, 2): (0, 4), (2, 3): (1, 5), (4, 3): (2, 6), (6, 6): (3, 7)}
    assert own.merge([1, 2, 3, 1, 2, 3]) == [7]
    assert own.merge([2, 3, 3]) == [5, 3] and own.merge([]) == [] and own.merge([9]) == [9]


@pytest.mark.parametrize("n", [0, 1, 3, 4, 5, 1000])
def test_pack_round_trip(n):
    rnd = np.random.default_rng(n)
    ranks = (rnd.integers(0, 1 << 32, n) >> rnd.integers(0, 32, n)).astype(np.uint32)
    control, data = token_files.pack(ranks)
    assert len(control) == -(-n // 4)
    assert token_files.unpack(control, data, n).tolist() == ranks.tolist()


def test_token_files_round_trip(spark):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    model, own = Tokenizer.from_file(path), token_files.byte_bpe(path)
    for t in pieces(3, ["<|endoftext|>", "'s", " '", "\x1c", "​"]):
        assert np.frombuffer(own.encode(t), dtype="<u4").tolist() == model.encode(t, add_special_tokens=False).ids, repr(t)
    folder = token_files.new_folder(spark)
    token_files.write_files(cases.frame(spark), path, folder, block=500)
    got = sorted(token_files.checksums(token_files.read_files(spark, folder)).collect(),
                 key=lambda r: (r["id"] is not None, r["id"] or 0, r["start"]))
    want = [(None, "a text without id here"), *sorted([*enumerate(cases.texts()), (5, cases.texts()[5])], key=lambda x: x[0])]
    start = 0
    for r, (i, t) in zip(got, want, strict=True):
        ids = model.encode(t or "", add_special_tokens=False).ids + [2]
        assert tuple(r) == (i, start, len(ids), crc32(np.array(ids, dtype="<u4").tobytes()))
        start += len(ids)
    ranks = spark.read.parquet(f"{folder}/ranks").orderBy("rank").collect()
    assert [r.n for r in ranks] == sorted([r.n for r in ranks], reverse=True)


def test_token_files_of_an_empty_table(spark):
    folder = token_files.new_folder(spark)
    token_files.write_files(cases.empty(spark), P.path("byte_bpe_50k.json"), folder)
    assert token_files.read_files(spark, folder).count() == 0


def test_digest_columns(spark):
    got = bpe.encode_decode(cases.frame(spark, ["", "Hello"]), P.path("word_bpe_49k.json")).collect()
    assert hashlib.sha256(got[0].ids).hexdigest() == hashlib.sha256(b"").hexdigest()
    assert got[0].decoded == "" and got[1].decoded == "hello</w>"


def test_word_bpe_on_rare_code_points_equals_the_library():
    """Letters, lower case and composition that the tables of the two sides know differently."""
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    own, library = bpe.WordBpe(path), Tokenizer.from_file(path)
    rnd = random.Random(8)
    points = [chr(i) for i in [*range(0x80, 0x3000), *range(0x3000, 0xD800, 37), *range(0xE000, 0x30000, 41)]]
    some = [a + c + b for a, b in (("ab", "cd"), ("1", "2"), ("", "́"), ("́", "")) for c in points[::3]]
    some += ["ab՘cd", "Ᲊx", "߽́", "\U0001e030 ՘"]
    some += ["".join(rnd.choice([rnd.choice(points), rnd.choice("aB1! ̴́")]) for _ in range(8)) for _ in range(3000)]
    coded = library.encode_batch(some, add_special_tokens=False)
    assert [t for t, e in zip(some, coded) if list(array("I", own.encode(t))) != e.ids] == []
    assert own.odd and not own.alike("ab՘cd") and own.alike("Ünïcode é")


def test_long_words_are_not_kept():
    memo = bpe.Recent(len, 10, 4)
    assert (memo["abc"], memo["abcdef"], list(memo)) == (3, 6, ["abc"])

"""BPE encoding and decoding of whole texts.

Every word is merged with a priority queue of merge ranks over a doubly
linked list of symbols; an entry whose pair has changed since it was pushed is
skipped.  Words repeat, so a bounded memo keeps the ids of those used last.
Decoding looks up vocabulary strings and joins them, with a blank between tokens as
the tokenizer file has no decoder.

Normalising, lower case and splitting use Python's character tables.  The library has tables of its own, of other Unicode
versions; so every code point outside ASCII is compared with the library when it is first met, in several surroundings and
with what it composes with, and a text with one that is treated differently or that Python does not know goes through the
library's normaliser and splitter.  Merging is the same for all.

Nulls count as empty texts: no ids, and an empty decoded text.  Strings of
special tokens inside a text become these tokens, as the library has it.  Every row is coded by itself, so repeated rows
and empty tables need nothing; a very long text is one value in memory, as it is in its row.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.llm.text import Recent

MEMO = 250_000
STEP = 512  # rows whose results a Python worker holds
LONGEST = 64  # characters of a word that is kept
#: What stands before and behind a code point where the two ways are compared: letters, digits, other signs, marks
#: of the least and the greatest combining class, an accent.
AROUND = (("a", "b"), ("1", "2"), ("!", "?"), ("a", "\u0334b"), ("a\u0345", "b"), ("e\u0301", "b"), ("a", "\u0301b"))
#: Unicode white space, spelled out as libraries differ on control characters.
SPACE = "\t-\r \x85\xa0  -     　"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    extra = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    return [chr(extra.get(b, b)) for b in range(256)]


class WordBpe:
    """A tokenizer file with word ends: NFC, blanks to one space, lower case, words, byte-level BPE."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: s for s, i in [*self.vocab.items(), *self.special.items()]}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.merges = {
            (self.vocab[a], self.vocab[b]): (rank, self.vocab[a + b]) for rank, (a, b) in enumerate(pairs)
        }
        suffix = model["end_of_word_suffix"] or ""
        symbols = byte_symbols()
        self.inner = [self.vocab.get(s) for s in symbols]
        self.final = [self.vocab.get(s + suffix) for s in symbols]
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.find = regex.compile(pattern.replace(r"\s", SPACE)).findall
        # every run of blanks but a single space
        self.blanks = re.compile(f"[{SPACE.replace(' ', '', 1)}][{SPACE}]*| [{SPACE}]+")
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.memo = Recent(self._word, MEMO, LONGEST)
        self.library = Tokenizer.from_file(path)
        self.byte_of = {s: b for b, s in enumerate(symbols)}
        self.met, self.odd = set(map(chr, range(128))), set()
        self.parts: dict[str, list[str]] = {}  # code point -> composites with it, taken apart
        for c in map(chr, range(0x80, 0x30000)):
            if unicodedata.decomposition(c) and len(apart := unicodedata.normalize("NFD", c)) > 1:
                for x in set(apart) - self.met:
                    self.parts.setdefault(x, []).append(apart)

    def _pieces(self, text: str) -> list[bytes]:
        """Words of a text without special tokens, as the library cuts it."""
        found = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [bytes(map(self.byte_of.__getitem__, s)) for s, _ in found]

    def _is_odd(self, c: str) -> bool:
        """Does the library treat this code point in another way than ``normalise`` and ``find`` do?"""
        if unicodedata.category(c) == "Cn":
            return True
        units = [before + c + behind for before, behind in AROUND] + self.parts.get(c, [])
        return any(self._pieces(u) != [w.encode("utf-8") for w in self.find(self.normalise(u))] for u in units)

    def alike(self, text: str) -> bool:
        """May this text take the way of Python's tables?"""
        if text.isascii():
            return True
        if new := set(text) - self.met:
            self.odd.update(filter(self._is_odd, new))
            self.met |= new
        return not self.odd or self.odd.isdisjoint(text)

    def _word(self, word: str) -> bytes:
        return self._ids(word.encode("utf-8"))

    def _ids(self, raw: bytes) -> bytes:
        ids = [self.inner[b] for b in raw[:-1]] + [self.final[raw[-1]]]
        return array("I", self.merge([i for i in ids if i is not None])).tobytes()

    def merge(self, ids: list[int]) -> list[int]:
        """Merge the pair of least rank, leftmost first, until none is left."""
        n = len(ids)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        queue = []
        for i in range(n - 1):
            if found := self.merges.get((ids[i], ids[i + 1])):
                queue.append((found[0], i, found[1]))
        heapq.heapify(queue)
        while queue:
            _, i, new = heapq.heappop(queue)
            j = after[i]
            if ids[i] < 0 or j < 0:
                continue
            now = self.merges.get((ids[i], ids[j]))
            if now is None or now[1] != new:
                continue  # stale: one of the two has been merged meanwhile
            ids[i], ids[j] = new, -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if found := self.merges.get((new, ids[k])):
                    heapq.heappush(queue, (found[0], i, found[1]))
            h = before[i]
            if h >= 0 and (found := self.merges.get((ids[h], new))):
                heapq.heappush(queue, (found[0], h, found[1]))
        return [i for i in ids if i >= 0]

    def normalise(self, text: str) -> str:
        text = self.blanks.sub(" ", unicodedata.normalize("NFC", text))
        # one character at a time where a final sigma would depend on its place
        return text.lower() if "Σ" not in text else "".join(c.lower() for c in text)

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        out = []
        for part in self.cut.split(text) if self.cut and "<" in text else (text,):
            if part in self.special:
                out.append(array("I", [self.special[part]]).tobytes())
            elif part and self.alike(part):
                out.extend(map(self.memo.__getitem__, self.find(self.normalise(part))))
            elif part:
                out.extend(map(self._ids, self._pieces(part)))
        return b"".join(out)

    def decode(self, ids: bytes | None) -> str:
        """Ids without a vocabulary string are left out."""
        ids, strings = array("I", ids or b""), self.strings
        try:
            return " ".join(map(strings.__getitem__, ids))
        except KeyError:
            return " ".join([strings[i] for i in ids if i in strings])


@lru_cache(maxsize=4)
def word_bpe(path: str) -> WordBpe:
    return WordBpe(path)


def encode(text: Column, path: str) -> Column:
    """Binary column of little-endian 32-bit ids."""

    @F.pandas_udf("binary")
    def ids(texts: pd.Series) -> pd.Series:
        one = word_bpe(path).encode
        return pd.Series([one(t) for t in texts], dtype=object)

    return ids(F.coalesce(text, F.lit("")))


def decode(ids: Column, path: str) -> Column:
    @F.pandas_udf("string")
    def text(packed: pd.Series) -> pd.Series:
        one = word_bpe(path).decode
        return pd.Series([one(p) for p in packed], dtype=object)

    return text(ids)


def unpack(ids: Column) -> Column:
    """Packed ids as an array of long."""

    @F.pandas_udf("array<long>")
    def out(packed: pd.Series) -> pd.Series:
        return pd.Series([list(array("I", p or b"")) for p in packed], dtype=object)

    return out(ids)


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids, decoded) of every document; ids are packed, see ``unpack``.

    Both ways run in one pass, so a task needs one Python worker, which holds the results of ``STEP`` rows at a time
    and not those of a whole Arrow batch.
    """
    schema = T.StructType([
        T.StructField("id", docs.schema[id_col].dataType), T.StructField("n_tokens", T.LongType()),
        T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType()),
    ])

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = word_bpe(path)
        for batch in batches:
            for start in range(0, batch.num_rows, STEP):
                part = batch.slice(start, STEP)
                ids = [one.encode(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([
                    part.column(0), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary()),
                    pa.array([one.decode(i) for i in ids], pa.string()),
                ], names=schema.names)

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return texts.mapInArrow(both, schema).withColumnRenamed("id", id_col)

"""Scan texts for license statements.

A text becomes a row of shingles of five words.  Windows of 1, 2, 4, 8 or 16 shingles,
overlapping by half, get MinHash signatures; signatures are cut in bands, and a band equal to
one of a template's windows retrieves the template there.  Template windows
start at every shingle, and a template is looked up with windows of at most half its
length, so every statement in a text contains whole windows that line up with it.
The number of bands follows from the wanted probability that a window of the wanted
likeness is retrieved.  What is retrieved is verified by exact shingle
containment in the words around the window.

Words are runs of ASCII letters and digits, lower case, and of all bytes above; other characters
separate.  Null texts and texts shorter than a template match nothing.  A statement found
several times in a text counts once, at the place of its best containment, the first of
equal ones.  Repeated rows give repeated rows; without templates nothing matches.
"""

from __future__ import annotations

import math
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WIDTH = 5
CONTAINED = 0.8
ROWS = 2
MISS = 1e-3  # probability that a window of likeness CONTAINED is in no common band
SCALES = (1, 2, 4, 8, 16)
GROUP = 200_000  # characters that are hashed at once
BASE = 0x9E3779B97F4A7C15 | 1
ALL = (1 << 64) - 1
WORD_BYTE = np.array([chr(b).isalnum() and b < 128 or b >= 128 for b in range(256)])


def bands(likeness: float = CONTAINED, rows: int = ROWS, miss: float = MISS) -> int:
    """Bands needed so that a pair of this likeness collides with probability 1 - miss."""
    return math.ceil(math.log(miss) / math.log(1 - likeness ** rows))


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_POWERS: list[np.ndarray] = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    if len(_POWERS[0]) < n:
        for k, base in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            some = np.full(n, base, dtype=np.uint64)
            some[0] = 1
            _POWERS[k] = np.multiply.accumulate(some)
    return _POWERS


def word_spans(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the words of a lower-cased text."""
    inside = WORD_BYTE[np.frombuffer(raw, dtype=np.uint8)]
    edges = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).astype(np.int8)))
    return edges[::2], edges[1::2]


def shingle_hashes(raw: bytes, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of every shingle, word starts, word ends); words are hashed from prefix sums of a polynomial."""
    starts, ends = word_spans(raw)
    if len(starts) < width:
        return np.zeros(0, dtype=np.uint64), starts, ends
    power, inverse = _powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(np.frombuffer(raw, dtype=np.uint8) * power[:len(raw)], out=sums[1:])
    word = _mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    n = len(word) - width + 1
    out = np.zeros(n, dtype=np.uint64)
    for i in range(width):
        out = out * np.uint64(BASE) + word[i:i + n]
    return _mix(out), starts, ends


def window_bands(shingles: np.ndarray, scale: int, step: int, count: int, rows: int = ROWS):
    """Band keys, one array per band, of windows of ``scale`` shingles at every ``step``."""
    n = len(shingles)
    if n < scale:
        return
    for band in range(count):
        key = None
        for row in range(rows):
            seed = np.uint64(((band * rows + row + 1) * 0xD6E8FEB86659FD93) & ALL)
            low, width = _mix(shingles ^ seed), 1
            while width < scale:
                low = np.minimum(low[:-width], low[width:])
                width *= 2
            low = low[::step]
            key = low if key is None else _mix(key * np.uint64(BASE) + low)
        yield band, key


class Scanner:
    def __init__(self, templates: dict[str, str], width: int, contained: float):
        self.width, self.contained, self.count = width, contained, bands(contained)
        self.names = sorted(templates)
        self.sets, self.sizes = [], []
        self.at: dict[int, dict] = {}
        for t, name in enumerate(self.names):
            raw = templates[name].encode("utf-8").lower()
            h, starts, ends = shingle_hashes(raw, width)
            self.sets.append(self._shingles(raw, starts, ends, 0, len(h)))
            self.sizes.append(len(h))
            scale = max([s for s in SCALES if 2 * s - 1 <= len(h)], default=0)
            if scale:
                table = self.at.setdefault(scale, {b: defaultdict(list) for b in range(self.count)})
                for b, key in window_bands(h, scale, 1, self.count):
                    for offset, k in enumerate(key.tolist()):
                        table[b][k].append((t, offset))
        self.maybe = {}
        for scale, table in self.at.items():
            for b, keys in table.items():
                flags = np.zeros(1 << 16, dtype=bool)
                flags[np.array(list(keys), dtype=np.uint64) >> np.uint64(48)] = True
                self.maybe[scale, b] = flags

    def _shingles(self, raw: bytes, starts, ends, first: int, last: int) -> set:
        words = [raw[s:e] for s, e in zip(starts[first:last + self.width - 1], ends[first:last + self.width - 1])]
        return set(zip(*[words[i:] for i in range(self.width)]))

    def scan(self, text: str | None) -> list[tuple[str, float, int]]:
        """(template, containment, first word of the place) for every template in the text."""
        return self.scan_all([text])[0]

    def scan_all(self, texts: list) -> list[list[tuple[str, float, int]]]:
        """``scan`` of each text, computed for all of them at once.

        The texts are laid end to end.  Windows over a border retrieve nothing that
        holds, as shingles are verified within their text.
        """
        parts = [(t or "").encode("utf-8").lower() for t in texts]
        raw = b"\n".join(parts)
        h, starts, ends = shingle_hashes(raw, self.width)
        sizes = np.array([len(p) + 1 for p in parts], dtype=np.int64)
        borders = np.searchsorted(starts, np.concatenate(([0], np.cumsum(sizes))))  # first word of each text
        found: dict[int, set] = defaultdict(set)
        for scale, table in self.at.items():
            step = max(1, scale // 2)
            for b, key in window_bands(h, scale, 1, self.count):
                hits = np.flatnonzero(self.maybe[scale, b][key >> np.uint64(48)])
                text = np.searchsorted(borders, hits, side="right") - 1
                on_grid = (hits - borders[text]) % step == 0  # counted from the start of each text
                for i, d in zip(hits[on_grid].tolist(), text[on_grid].tolist()):
                    for t, offset in table[b].get(int(key[i]), ()):
                        found[d].add((t, i - offset))
        out: list[list[tuple[str, float, int]]] = [[] for _ in texts]
        for d, places in found.items():
            low, high = int(borders[d]), int(borders[d + 1]) - self.width + 1  # shingles of this text
            best: dict[int, tuple[float, int]] = {}
            for t, start in sorted(places):
                spare = self.sizes[t] // 4 + self.width  # words may have been put in or left out
                first, last = max(low, start - spare), min(high, start + self.sizes[t] + spare)
                if first >= last:
                    continue
                share = len(self.sets[t] & self._shingles(raw, starts, ends, first, last)) / len(self.sets[t])
                if share >= self.contained and (t not in best or share > best[t][0]):
                    best[t] = (share, max(0, start - low))
            out[d] = [(self.names[t], share, at) for t, (share, at) in sorted(best.items())]
        return out


def groups(texts, most: int = GROUP):
    """Runs of texts of about ``most`` characters together; a longer text is a run of its own."""
    held, size = [], 0
    for t in texts:
        if held and size + len(t or "") > most:
            yield held
            held, size = [], 0
        held.append(t)
        size += len(t or "")
    if held:
        yield held


@lru_cache(maxsize=4)
def _scanner(templates: tuple, width: int, contained: float) -> Scanner:
    return Scanner(dict(templates), width, contained)


def licenses(text: Column, templates: dict[str, str], width: int = WIDTH, contained: float = CONTAINED) -> Column:
    """array<struct<template, containment, word>> of the statements in a text, by name of the template."""
    fixed = tuple(sorted(templates.items()))

    @F.pandas_udf("array<struct<template: string, containment: double, word: long>>")
    def scan(texts: pd.Series) -> pd.Series:
        scanner = _scanner(fixed, width, contained)
        return pd.Series([
            [{"template": n, "containment": c, "word": w} for n, c, w in found]
            for some in groups(texts) for found in scanner.scan_all(some)
        ], dtype=object)

    return scan(F.coalesce(text, F.lit("")))


def scan_documents(
    docs: DataFrame, templates: dict[str, str], id_col: str = "doc_id", text_col: str = "text",
    width: int = WIDTH, contained: float = CONTAINED,
) -> DataFrame:
    """(id, found) of every document."""
    return docs.select(F.col(id_col), licenses(F.col(text_col), templates, width, contained).alias("found"))

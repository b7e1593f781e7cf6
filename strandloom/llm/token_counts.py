"""Token counts by a whole-token shortcut.

A sentence piece model whose pieces hold the space mark only at their start
never merges across the point before a run of spaces, so a text falls apart
into pre-tokens that can be counted alone.  Which vocabulary strings encode
alone as one token is proved once per worker by encoding every one of them;
a pre-token among those counts one, and only the rest is merged.

Nulls and empty texts count 0 tokens.  Nothing is cut off: a text of any
length is counted whole.
"""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.llm.text import Recent

MARK = "▁"
MEMO = 300_000


class PieceCounter:
    """Counts tokens of whole texts as the library does, without encoding most of their words."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.separable = self._separable(pieces)
        self.single = self._single(pieces)
        self.last = len(self._ids("a ")) - len(self._ids("a"))  # a space that ends a text
        self.memo = Recent(self._count, MEMO)

    def _ids(self, text: str) -> list[int]:
        return self.model.encode(text, num_threads=1)

    def _separable(self, pieces: list[str]) -> bool:
        """No piece has the mark behind another character, and a text starts with a mark of its own."""
        leading = all(MARK not in p.lstrip(MARK) for p in pieces)
        kinds = all(
            self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_byte(i) or p.startswith(MARK)
            or MARK not in p
            for i, p in enumerate(pieces)
        )
        return leading and kinds and self._ids("a  b") == self._ids("a") + self._ids(" b")

    def _single(self, pieces: list[str]) -> frozenset[str]:
        """Strings behind one space that the library encodes as exactly one token."""
        some = [p[1:] for p in pieces if p.startswith(MARK) and len(p) > 1 and MARK not in p[1:]]
        return frozenset(s for s, ids in zip(some, self.model.encode(some, num_threads=1)) if len(ids) == 1)

    def _count(self, pretoken: str) -> int:
        return 1 if pretoken in self.single else len(self._ids(pretoken))

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if not self.separable:
            return len(self._ids(text))
        parts = text.replace(MARK, " ").split(" ")  # every part has one space before it
        if "" not in parts:
            return sum(map(self.memo.__getitem__, parts))
        total = run = 0
        for part in parts:
            if part:
                total += self.memo[" " * run + part]
                run = 0
            else:
                run += 1
        if run == 1:
            return total + self.last
        return total + (len(self._ids(" " * (run - 1))) if run else 0)


@lru_cache(maxsize=4)
def counter(path: str) -> PieceCounter:
    return PieceCounter(path)


def token_count(text: Column, path: str) -> Column:
    """Tokens of a text, without begin and end tokens."""

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        one = counter(path).count
        return pd.Series([one(t) for t in texts], dtype="int64")

    return count(F.coalesce(text, F.lit("")))


def count_tokens(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096
) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every document; repeated rows give repeated rows."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return (
        docs.select(F.col(id_col), F.octet_length(text).cast("long").alias("n_bytes"),
                    token_count(text, path).alias("n_tokens"))
        .withColumn("over_limit", F.col("n_tokens") > limit)
    )

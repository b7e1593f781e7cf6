"""Small helpers that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word is a run of anything but these six ASCII characters.
BLANK = r"[\x20\x09-\x0D]+"


def words(text: str | None) -> list[bytes]:
    """Words of a text; ``bytes.split`` cuts at exactly the characters of BLANK."""
    return (text or "").encode("utf-8").split()


def word_array(text: Column) -> Column:
    """Words as an array column (null: no words)."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANK), "")


def word_count(text: Column) -> Column:
    return F.size(word_array(text)).cast("long")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row, inside one expression."""
    return F.transform(F.array(value), body)[0]


def unit(seed: str, *keys: Column) -> Column:
    """A number in (0, 1) from 52 bits of an MD5 digest of the keys (nulls count as a value)."""
    text = F.concat_ws("|", F.lit(seed), *[F.coalesce(k.cast("string"), F.lit("-")) for k in keys])
    bits = F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")
    return (bits.cast("double") + 0.5) / float(1 << 52)


class Recent(dict):
    """A memo that keeps between ``most`` and twice ``most`` of the keys used last.

    Hits run at the speed of a dictionary; memory is bounded however long a
    Python worker lives.  Keys of over ``longest`` characters are made anew each time.
    """

    def __init__(self, make, most: int, longest: int | None = None):
        super().__init__()
        self.make, self.most, self.longest, self.old = make, most, longest, {}

    def __missing__(self, key):
        if self.longest is not None and len(key) > self.longest:
            return self.make(key)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        value = self.old[key] if key in self.old else self.make(key)
        self[key] = value
        return value

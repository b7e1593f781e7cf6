"""White space at the ends of a value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that count as white space, the blanks of other scripts included.
WHITE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0            "
    "    　"
)


def strip(c: Column | str) -> Column:
    """The value without white space of any kind at its ends."""
    return F.trim(c, F.lit(WHITE))

"""Column functions on affinities, conditions and prediction scores."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandloom import fixed_values as fv
from strandloom.functions.bind import bind
from strandloom.functions.space import strip


def four_digits(value: Column) -> Column:
    """Round to 4 significant digits, ties to even."""
    ten = F.lit(10.0)

    def rounded(x):
        e = F.floor(F.log10(x))
        return (
            F.when(x == 0, F.lit(0.0))
            .when(e <= 3, F.bround(x * F.pow(ten, 3 - e)) / F.pow(ten, 3 - e))
            .otherwise(F.bround(x / F.pow(ten, e - 3)) * F.pow(ten, e - 3))
        )

    return bind(value, rounded)


def _factor(unit: Column, table: dict[str, float]) -> Column:
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), F.lower(strip(unit)))


def to_nanomolar(value: Column, unit: Column, molar: bool = False) -> Column:
    """Value in nM; NULL for a negative value or an unknown unit."""
    table = fv.UNIT_TO_NM_WITH_MOLAR if molar else fv.UNIT_TO_NM
    return F.when(value >= 0, four_digits(value * _factor(unit, table)))


def canonical_unit(unit: Column) -> Column:
    pairs = [F.lit(x) for item in fv.UNIT_NAME.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), F.lower(strip(unit)))


def kd_convert(value: Column, unit: Column) -> Column:
    """struct<value_nM, original_value, original_unit, canonical_unit, error>."""
    name = canonical_unit(unit)
    error = (
        F.when(value < 0, "negative value")
        .when(name.isNull(), "unrecognised unit")
    )
    return F.struct(
        F.when(error.isNull(), to_nanomolar(value, unit)).alias("value_nM"),
        value.alias("original_value"),
        strip(unit).alias("original_unit"),
        F.when(error.isNull(), name).alias("canonical_unit"),
        error.alias("error"),
    )


def group(c: Column, pattern: str, n: int = 1) -> Column:
    """Capture group of the first match, NULL without a match."""
    return F.nullif(F.regexp_extract(c, pattern, n), F.lit(""))


def number(c: Column) -> Column:
    return c.try_cast("double")


def kd_parse(c: Column) -> Column:
    """A whole string such as '5.2 nM' as struct<value_nM, unit>."""
    value = number(group(c, "(?iU)" + fv.KD_WHOLE, 1))
    unit = group(c, "(?iU)" + fv.KD_WHOLE, 2)
    return F.struct(
        to_nanomolar(value, unit).alias("value_nM"), canonical_unit(unit).alias("unit")
    )


def kd_cell_text(c: Column) -> Column:
    """A table cell without the sign in front of its number."""
    return F.regexp_replace(strip(c), r"(?U)^[<>≤≥~≈]\s*", "")


def kd_cell_parts(cell: Column) -> Column:
    """struct<value, unit, bare> of a cell as ``kd_cell_text`` gives it; an empty unit is none.

    Every unit has an M: cells without one are not matched with the longer pattern.
    """
    may = cell.contains("M") | cell.contains("m")
    part = lambda pattern, n: F.regexp_extract(cell, pattern, n)
    return F.struct(
        F.when(may, number(part("(?iU)" + fv.KD_CELL, 1))).alias("value"),
        F.when(may, part("(?iU)" + fv.KD_CELL, 2)).alias("unit"),
        number(part("(?U)" + fv.KD_BARE, 1)).alias("bare"),
    )


def header_unit(header: Column, faithful: bool = False) -> Column:
    """The unit that bare numbers below this header have."""
    return F.lit(None).cast("string") if faithful else group(header, "(?iU)" + fv.KD_HEADER_UNIT, 1)


def kd_of_parts(parts: Column, unit: Column) -> Column:
    """struct<value_nM, unit> of the parts of a cell below a header of this unit."""
    # one conversion serves both cases: own unit, or a bare number in the header's
    own = F.coalesce(parts["unit"] != "", F.lit(False))
    used = F.coalesce(F.nullif(parts["unit"], F.lit("")), F.when(parts["bare"].isNotNull(), unit))
    converted = to_nanomolar(F.when(own, parts["value"]).otherwise(parts["bare"]), used)
    found = F.named_struct(F.lit("nm"), converted, F.lit("bare"), parts["bare"], F.lit("unit"), used)
    return bind(
        found,
        lambda k: F.named_struct(
            F.lit("value_nM"), F.coalesce(k["nm"], k["bare"]),
            F.lit("unit"), F.when(k["nm"].isNotNull(), k["unit"]),
        ),
    )


def kd_cell_parse(c: Column, header: Column, faithful: bool = False) -> Column:
    """One table cell with the unit of its header as struct<value_nM, unit>.

    A bare number takes the header's unit.  ``faithful=True`` keeps the
    original behaviour, where a bare number always counted as nM.
    """
    unit = header_unit(header, faithful)
    return bind(kd_cell_text(c), lambda cell: bind(kd_cell_parts(cell), lambda parts: kd_of_parts(parts, unit)))


def kd_log(c: Column) -> Column:
    return F.when(c >= 0, F.log10(c + 1))


def qualify(prob: Column, kd_log_value: Column) -> Column:
    """2 strong, 1 medium, 0 weak; by predicted log Kd, else by probability."""
    high, medium = math.log10(fv.KD_HIGH_NM + 1), math.log10(fv.KD_MEDIUM_NM + 1)
    by_kd = F.when(kd_log_value < high, 2).when(kd_log_value < medium, 1).otherwise(0)
    by_prob = F.when(prob > fv.PROB_HIGH, 2).when(prob > fv.PROB_MEDIUM, 1).otherwise(0)
    return F.when(kd_log_value.isNotNull(), by_kd).otherwise(by_prob)


def buffer_code(c: Column) -> Column:
    text = F.lower(c)
    out = F.lit(fv.BUFFER_OTHER)
    for part, code in reversed(fv.BUFFER_RULES):
        out = F.when(text.contains(part), F.lit(code)).otherwise(out)
    return F.when(c.isNull(), F.lit(fv.DEFAULT_BUFFER_CODE)).otherwise(out)


def buffer_name(code: Column) -> Column:
    out = F.lit(None).cast("string")
    for value, name in fv.BUFFER_NAMES.items():
        out = F.when(code == value, F.lit(name)).otherwise(out)
    return out


def condition_vector(ph: Column, na: Column, temp: Column, mg: Column) -> Column:
    return F.array(
        F.coalesce(ph.cast("double"), F.lit(fv.DEFAULT_PH)),
        F.coalesce(na.cast("double"), F.lit(fv.DEFAULT_SALT_MM)),
        F.coalesce(temp.cast("double"), F.lit(fv.DEFAULT_TEMP_C)),
        F.lit(float(fv.DEFAULT_BUFFER_CODE)),
        F.coalesce(mg.cast("double"), F.lit(fv.DEFAULT_MG_MM)),
    )

"""Package names, types and dimensions as rules over columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions import text as T


def _pick(pairs: list[tuple[Column, Column]]) -> Column:
    """The first value whose condition holds, or null."""
    return reduce(lambda chain, p: chain.when(*p), pairs[1:], F.when(*pairs[0]))


def from_text(text: Column) -> Column:
    """The first package type one of whose patterns occurs."""
    low = F.lower(text)
    return _pick([(low.rlike("|".join(patterns)), F.lit(kind)) for kind, patterns in rules.PACKAGE_PATTERNS])


def normalized(name: Column) -> Column:
    up = T.strip(F.upper(name))
    return F.coalesce(T.first_contained(up, rules.NAME_ALIASES), from_text(name), up)


def quasi_square(width: Column, height: Column, tolerance: float = 0.3) -> Column:
    ratio = F.try_divide(F.greatest(width, height), F.least(width, height))
    return F.coalesce((width != 0) & (height != 0) & (ratio <= 1.0 + tolerance), F.lit(False))


def from_layout(pins: Column, width: Column, height: Column) -> Column:
    return _pick(
        [
            (quasi_square(width, height) & pins.isin(*rules.QFN_PINS), F.lit("QFN")),
            ((pins % 2 == 0) & (width > height * 1.5) & pins.isin(*rules.DIP_PINS), F.lit("DIP")),
            ((width > height) & pins.isin(*rules.SOIC_PINS) & (width < 10) & (height < 20), F.lit("SOIC")),
            ((width > height) & pins.isin(*rules.TSSOP_PINS) & (width < 8) & (height < 15), F.lit("TSSOP")),
        ]
    )


def dimensions(df: DataFrame) -> DataFrame:
    """The table of expected dimensions: ten fixed rows."""
    return df.sparkSession.createDataFrame(rules.DIMENSIONS, "type string, pins_from int, pins_to int, min_w double, max_w double, min_h double, max_h double")


def with_expected(df: DataFrame, kind: str, pins: str) -> DataFrame:
    """Range join with the expected dimensions; null where there are none. The broadcast side is the fixed table."""
    dims = F.broadcast(dimensions(df))
    return df.join(dims, (df[kind] == dims["type"]) & df[pins].between(dims["pins_from"], dims["pins_to"]), "left").drop("type", "pins_from", "pins_to")


def expected(kind: Column, pins: Column) -> Column:
    """The same as a struct column, for rules that look up more than one type."""
    entry = lambda d: F.struct(*(F.lit(v).alias(n) for n, v in zip(("min_w", "max_w", "min_h", "max_h"), d[3:])))
    return _pick([((kind == d[0]) & pins.between(d[1], d[2]), entry(d)) for d in rules.DIMENSIONS])


def valid(kind: Column, pins: Column, width: Column, height: Column) -> Column:
    up = F.upper(kind)
    fits = [((up == d[0]) & pins.between(d[1], d[2]), width.between(d[3], d[4]) & height.between(d[5], d[6])) for d in rules.DIMENSIONS]
    return _pick(fits).otherwise(F.lit(True))


def default(pins: Column) -> Column:
    return F.when(pins <= 20, "SOIC").when(pins <= 28, F.when(pins % 2 == 0, "DIP").otherwise("SOIC")).otherwise("QFN")


def detected(specified: Column, hint: Column, pins: Column, width: Column, height: Column) -> Column:
    """A specified type that holds, else the hint's, else the layout's, else the default."""
    up = F.upper(specified)
    given = F.when((up != "") & (up != "UNKNOWN") & valid(up, pins, width, height), up)
    hinted = from_text(hint)
    return F.coalesce(given, F.when(valid(hinted, pins, width, height), hinted), from_layout(pins, width, height), default(pins))


def estimated(kind: Column, pins: Column) -> Column:
    """Struct (width, height): the middle of what is expected, or a formula by type."""
    up, n = F.upper(kind), pins.cast("double")
    e = expected(up, pins)
    width = F.when(up == "DIP", 5.0 + n * 0.1).when(up == "QFN", 3.0 + n * 0.1).otherwise(5.0 + n * 0.05)
    height = F.when(up == "DIP", 10.0 + n * 0.2).when(up == "QFN", 3.0 + n * 0.1).when(up.isin("SOIC", "TSSOP"), 8.0 + n * 0.15).otherwise(8.0 + n * 0.05)
    return F.struct(F.coalesce((e["min_w"] + e["max_w"]) / 2, width).alias("width"), F.coalesce((e["min_h"] + e["max_h"]) / 2, height).alias("height"))


def parsed(name: Column) -> Column:
    """The package type for drawing: that of the first alias the name begins with, else DIP. No alias begins another, so
    a name that is an alias finds itself."""
    alias = F.regexp_extract(T.strip(F.upper(name)), "^(" + "|".join(a for a, _ in rules.TYPE_ALIASES) + ")", 1)
    kinds = F.create_map(*(F.lit(x) for pair in rules.TYPE_ALIASES for x in pair))
    return F.coalesce(F.try_element_at(kinds, alias), F.lit("DIP"))

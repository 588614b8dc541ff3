"""Column expressions for counts, shares and bands."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Text that counts as a number.  try_cast alone would also accept Java forms such
# as "1d" or "0x1p3", which the data contract treats as missing.
NUMBER_TEXT = r"(?i)^\s*[+-]?(?:(?:\d+\.?\d*|\.\d+)(?:e[+-]?\d+)?|inf|infinity)\s*$"


def parse_number(text: Column) -> Column:
    """Text -> double; anything that is not a plain number becomes null."""
    return F.when(text.rlike(NUMBER_TEXT), F.trim(text).try_cast("double"))


def numeric(df: DataFrame, name: str) -> Column:
    """A column as double with NaN and unreadable values as null."""
    dtype = df.schema[name].dataType
    if isinstance(dtype, T.StringType):
        return parse_number(F.col(name))
    return F.nanvl(F.col(name).cast("double"), F.lit(None).cast("double"))


def add(parts: Iterable[Column]) -> Column:
    return reduce(lambda left, right: left + right, parts)


def row_sum(columns: Iterable[str]) -> Column:
    """Sum across columns, null only when every column is null."""
    columns = list(columns)
    total = add(F.coalesce(F.col(c), F.lit(0.0)) for c in columns)
    return F.when(F.coalesce(*[F.col(c) for c in columns]).isNotNull(), total)


def weighted_sum(weights: Mapping[str, float]) -> Column:
    """Sum of column * weight across columns, null only when every column is null."""
    total = add(F.coalesce(F.col(c), F.lit(0.0)) * F.lit(w) for c, w in weights.items())
    return F.when(F.coalesce(*[F.col(c) for c in weights]).isNotNull(), total)


def ratio(numerator: Column, denominator: Column) -> Column:
    """numerator / denominator where the denominator is positive, else null."""
    return F.when(numerator.isNotNull() & (denominator > 0), numerator / denominator)


def demand_proxy(students: Column, w: Column) -> Column:
    """students + w where both are present and not negative."""
    return F.when((students >= 0) & (w >= 0), students + w)


def w_share(students: Column, w: Column) -> Column:
    return ratio(w, demand_proxy(students, w))


def course_level(number: Column, negative_is_zero: bool = False) -> Column:
    """Catalog number -> hundreds band 0..900.

    A negative number is null for the history features and 0 in the trajectory.
    """
    value = parse_number(number.cast("string"))
    finite = F.abs(value) < F.lit(float("inf"))
    usable = finite if negative_is_zero else finite & (value >= 0)
    level = F.greatest(F.lit(0.0), F.least(F.lit(900.0), F.floor(value / 100) * 100.0))
    return F.when(usable, level)


def flag(condition: Column) -> Column:
    """A condition with null read as false."""
    return F.coalesce(condition, F.lit(False))

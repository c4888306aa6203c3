"""The same functions as column builders, for the DataFrame API."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def mod(a: Column, b: Column) -> Column:
    """Remainder with the sign of the divisor."""
    return a - F.floor(a / b) * b


def round_even(x: Column, digits: int = 0) -> Column:
    return F.bround(x, digits).cast("double")


def truncate(x: Column) -> Column:
    return F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("double")


def substring_from(s: Column, start: Column, length: Column | None = None) -> Column:
    """Places before the first count as the first."""
    start = F.greatest(start, F.lit(1))
    return F.substr(s, start, length) if length is not None else F.substr(s, start)


def last_day(d: Column) -> Column:
    """End of the month; the time of day stays."""
    return F.last_day(d).cast("timestamp_ntz") + (d.cast("timestamp_ntz") - F.to_date(d).cast("timestamp_ntz"))


def floor_time(d: Column, unit: str) -> Column:
    return F.date_trunc(unit, d).cast("timestamp_ntz")


def ceil_time(d: Column, unit: str) -> Column:
    down = floor_time(d, unit)
    return F.when(d.cast("timestamp_ntz") == down, down).otherwise(F.timestamp_add(unit, F.lit(1), down))


def initcap(s: Column) -> Column:
    """Upper case after anything that isn't a letter."""
    words = F.regexp_extract_all(s, F.lit(r"\p{L}+|\P{L}+"), F.lit(0))
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.lower(F.substr(w, F.lit(2))))), "")

"""Scalar functions on columns, all native."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def weekday(micros) -> Column:
    """Monday is 0."""
    return F.weekday(F.timestamp_micros(_c(micros)))


def hour(micros) -> Column:
    return F.hour(F.timestamp_micros(_c(micros)))


def epoch_seconds(day) -> Column:
    return F.unix_timestamp(_c(day).cast("timestamp"))


def days_between(later, earlier) -> Column:
    return F.datediff(_c(later), _c(earlier))


def parse_date(x, strict: bool = False) -> Column:
    day = F.try_to_timestamp(_c(x), F.lit("yyyy-MM-dd")).cast("date")
    return F.when(_c(x).isNotNull() & day.isNull(), F.raise_error(F.concat(F.lit("not a date: "), _c(x))).cast("date")).otherwise(day) if strict else day


def try_numeric(x) -> Column:
    return _c(x).try_cast("double")


def concat_key(*parts) -> Column:
    return F.concat_ws("_", *[_c(p).cast("string") for p in parts])


def zfill(x, width: int = 2) -> Column:
    text = _c(x).cast("string")
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))


def strip_extension(name) -> Column:
    return F.split_part(_c(name), F.lit("."), F.lit(1))


def bin_case(x) -> Column:
    """"1" for 0, then "2" to "6" for up to 1, 3, 6, 9 and beyond."""
    x = _c(x)
    ladder = F.when(x == 0, "1")
    for top, label in ((1, "2"), (3, "3"), (6, "4"), (9, "5")):
        ladder = ladder.when(x <= top, label)
    return ladder.otherwise("6")


def lookup(params, key: str) -> Column:
    """Value of the first entry with this key in an array of (key, value)."""
    return F.filter(_c(params), lambda p: p["key"] == key)[0]["value"]


def jaccard(a, b) -> Column:
    """|A and B| / |A or B|; null for two empty sets."""
    return F.try_divide(F.size(F.array_intersect(_c(a), _c(b))).cast("double"), F.size(F.array_union(_c(a), _c(b))).cast("double"))


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a, b) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def euclidean(a, b) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: (x.cast("double") - y.cast("double")) ** 2), F.lit(0.0), lambda s, x: s + x))


def prompt(text, instruction: str) -> Column:
    """Instruction and the whole text."""
    return F.concat(F.lit(instruction), _c(text))


def hash_key(*parts, seed: int) -> Column:
    """The order in which random choices are made: the same in any engine that has md5."""
    return F.md5(F.concat_ws("|", *[_c(p).cast("string") for p in parts], F.lit(str(seed))))


def union_arrays(*arrays) -> Column:
    """Distinct elements of all arrays, null arrays skipped."""
    given = F.filter(F.array(*[_c(a) for a in arrays]), lambda a: a.isNotNull())
    return F.array_distinct(F.flatten(given))


def any_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, conditions)

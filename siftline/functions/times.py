"""Parsing of times, absolute and relative. ``as_of`` is always given, never taken from the clock."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The formats that are tried, in this order; the second list is that of stored records.
FORMATS = [
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss'Z'",
    "yyyy/MM/dd HH:mm:ss",
    "MM/dd/yyyy HH:mm:ss",
    "yyyy-MM-dd",
    "MM/dd/yyyy",
]
ZONED_FORMATS = ["yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX"]
RECORD_FORMATS = [
    "yyyy-MM-dd'T'HH:mm:ssXXX",
    "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd HH:mm:ss",
]


def parse_time(c: Column, formats: list[str] = FORMATS) -> Column:
    """By the first format that fits; null if none does."""
    return F.coalesce(*(F.try_to_timestamp(c, F.lit(f)) for f in formats)).cast("timestamp_ntz")


def zoned_time(c: Column) -> Column:
    """A time with its zone, in UTC; null for any other text."""
    return F.when(c.rlike(r"[Zz]$|[+-]\d\d:\d\d$"), F.coalesce(*(F.try_to_timestamp(c, F.lit(f)) for f in ZONED_FORMATS))).cast("timestamp_ntz")


def _number(c: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract(c, pattern, group).try_cast("int")


def _day(year: Column, c: Column, pattern: str, first: int) -> Column:
    text = F.format_string("%04d-%02d-%02d", year, _number(c, pattern, first), _number(c, pattern, first + 1))
    return F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).cast("timestamp_ntz")


def relative_time(c: Column, as_of: Column) -> Column:
    """Minutes, hours or days ago, yesterday, today, or a date with or without a year; else null."""
    at = as_of.cast("timestamp_ntz")

    def ago(pattern: str, unit: str) -> Column:
        return at - F.make_dt_interval(**{unit: _number(c, pattern)})

    return (
        F.when(c.rlike(r"\d+分钟前"), ago(r"(\d+)分钟前", "mins"))
        .when(c.rlike(r"\d+小时前"), ago(r"(\d+)小时前", "hours"))
        .when(c.rlike(r"\d+[天日]前"), ago(r"(\d+)[天日]前", "days"))
        .when(c.contains("昨天"), at - F.make_dt_interval(days=F.lit(1)))
        .when(c.contains("今天"), at)
        .when(c.rlike(r"\d{4}-\d{1,2}-\d{1,2}"), _day(_number(c, r"(\d{4})-(\d{1,2})-(\d{1,2})"), c, r"(\d{4})-(\d{1,2})-(\d{1,2})", 2))
        .when(c.rlike(r"\d{1,2}-\d{1,2}"), _day(F.year(at), c, r"(\d{1,2})-(\d{1,2})", 1))
        .when(c.rlike(r"\d{4}年\d{1,2}月\d{1,2}日"), _day(_number(c, r"(\d{4})年"), c, r"\d{4}年(\d{1,2})月(\d{1,2})日", 1))
    )


def cache_seconds(expires: Column, as_of: Column, default: int = 86_400, least: int = 60) -> Column:
    """How long a cache entry may live."""
    left = F.timestamp_diff("SECOND", as_of, expires)
    return F.when(expires.isNull(), F.lit(default)).otherwise(F.greatest(left, F.lit(least))).cast("long")

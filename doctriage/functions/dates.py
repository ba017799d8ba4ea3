"""Day-first date parsing.  Results are ISO strings, years are not padded.

``as_of`` stands in for "today": it supplies the century window of two-digit
years and the year of day-month tokens.  It is a ``datetime.date`` known when
the plan is built, so re-running a plan gives the same answer on any day.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from doctriage import fixed
from doctriage.functions.constants import text_list, text_map
from doctriage.functions.regex import bind, unicode_regex

_NUMERIC = r"^\s*([0-9]{1,2})([./-])([0-9]{1,2})([./-])([0-9]{2,4})\s*$"
_MONTH_FIRST = r"^\s*([A-Za-z]{3,9})\s+([0-9]{1,2}),?\s+([0-9]{2,4})\s*$"
_DAY_FIRST = r"^\s*([0-9]{1,2})\s+([A-Za-z]{3,9})\s+([0-9]{2,4})\s*$"
_ISO = r"^\s*([0-9]{4})-([0-9]{2})-([0-9]{2})\s*$"
_DAY_MONTH = r"^\s*([0-9]{1,2})\s*([A-Za-z]{3,4})\s*$"


def _group(value: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(value, unicode_regex(pattern), group)


def _month_number(word: Column, months: dict[str, int]) -> Column:
    return F.try_element_at(text_map(months), F.upper(word)).cast("int")


def _full_year(year: Column, as_of: dt.date) -> Column:
    """Two-digit years go to the century that puts them nearest to as_of."""
    guess = year + as_of.year // 100 * 100
    near = (
        F.when(guess >= as_of.year + 50, guess - 100)
        .when(guess < as_of.year - 50, guess + 100)
        .otherwise(guess)
    )
    return F.when(year < 100, near).otherwise(year)


def _days_in_month(year: Column, month: Column) -> Column:
    """28 to 31, NULL if there is no such month."""
    leap = ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)
    days = F.get(text_list("31 28 31 30 31 30 31 31 30 31 30 31".split()), month - 1).cast("int")
    return F.when(leap & (month == 2), F.lit(29)).otherwise(days)


def _iso(year: Column, month: Column, day: Column) -> Column:
    """ISO text of a date that exists, else NULL."""
    exists = (year >= 1) & (day >= 1) & (day <= _days_in_month(year, month))
    return F.when(exists, F.format_string("%d-%02d-%02d", year, month, day))


def _iso_of(parts: Column) -> Column:
    """bind() a struct(y, m, d) and format it."""
    return bind(parts, lambda p: _iso(p["y"], p["m"], p["d"]))


def _ymd(y: Column, m: Column, d: Column) -> Column:
    return F.struct(y.alias("y"), m.alias("m"), d.alias("d"))


def _numeric_date(value: Column, as_of: dt.date) -> Column:
    def fields_of(groups: Column) -> Column:
        part = lambda i: F.get(groups, F.lit(i))
        return F.struct(
            part(0).try_cast("int").alias("a"),
            part(1).alias("sep1"),
            part(2).try_cast("int").alias("b"),
            part(3).alias("sep2"),
            part(4).alias("text"),
            part(4).try_cast("int").alias("c"),
        )

    def resolve(f: Column) -> Column:
        a, b, c = f["a"], f["b"], f["c"]
        same = f["sep1"] == f["sep2"]
        # A dot next to another separator reads as a decimal number.
        readable = same | ((f["sep1"] != ".") & (f["sep2"] != "."))
        literal = F.when(same, F.length(f["text"]) > 2).otherwise(c > 100)
        first, last = (F.when(literal, x).otherwise(_full_year(x, as_of)) for x in (a, c))
        parts = (
            F.when((a > 31) & (c <= 12), _ymd(first, c, b))
            .when(a > 31, _ymd(first, b, c))
            .when((a > 12) | (b <= 12), _ymd(last, b, a))
            .otherwise(_ymd(last, a, b))
        )
        return F.when(readable, _iso_of(parts))

    # The pattern runs once; no group holds a line end.
    groups = F.split(F.regexp_replace(value, unicode_regex(_NUMERIC), "$1\n$2\n$3\n$4\n$5"), "\n")
    return bind(bind(groups, fields_of), resolve)


def _named_date(value: Column, as_of: dt.date) -> Column:
    month_first = value.rlike(unicode_regex(_MONTH_FIRST))
    word, day, year = (
        F.when(month_first, _group(value, _MONTH_FIRST, i)).otherwise(_group(value, _DAY_FIRST, j))
        for i, j in ((1, 2), (2, 1), (3, 3))
    )
    fields = F.struct(
        _month_number(word, {**fixed.MONTHS, **fixed.FULL_MONTHS}).alias("m"),
        day.try_cast("int").alias("d"),
        year.try_cast("int").alias("y"),
    )

    def resolve(f: Column) -> Column:
        # A first number above 31 is the year, unless the other one says so.
        swapped = (f["d"] > 31) & (f["y"] <= 100)
        return _iso_of(
            F.when(swapped, _ymd(_full_year(f["d"], as_of), f["m"], f["y"])).otherwise(
                _ymd(F.when(f["y"] > 100, f["y"]).otherwise(_full_year(f["y"], as_of)), f["m"], f["d"])
            )
        )

    return bind(fields, resolve)


def parse_date(value: Column, as_of: dt.date, iso_dates: bool = False) -> Column:
    """``12/08/2025``, ``Aug 12, 2025`` or ``12 August 25`` to ``2025-08-12``.

    NULL for impossible dates and for words that are not English month names.
    """
    return bind(value, lambda v: _parsed(v, as_of, iso_dates))


def _parsed(value: Column, as_of: dt.date, iso_dates: bool) -> Column:
    parsed = F.when(value.rlike(unicode_regex(_NUMERIC)), _numeric_date(value, as_of))
    if iso_dates:
        iso = _ymd(*[_group(value, _ISO, i).try_cast("int") for i in (1, 2, 3)])
        parsed = parsed.when(value.rlike(unicode_regex(_ISO)), _iso_of(iso))
    return parsed.otherwise(_named_date(value, as_of))


def parse_day_month(token: Column, as_of: dt.date) -> Column:
    """``02JUN`` / ``2 Sept`` to a date in the year of ``as_of``.

    A number above 31 can only be a year; the day then is that of ``as_of``,
    or the last one of a shorter month.
    """
    fields = F.struct(
        _group(token, _DAY_MONTH, 1).try_cast("int").alias("n"),
        _month_number(_group(token, _DAY_MONTH, 2), fixed.MONTHS).alias("m"),
    )

    def resolve(f: Column) -> Column:
        year = _full_year(f["n"], as_of)
        last = F.least(F.lit(as_of.day), _days_in_month(year, f["m"]))
        return _iso_of(
            F.when(f["n"] > 31, _ymd(year, f["m"], last)).otherwise(_ymd(F.lit(as_of.year), f["m"], f["n"]))
        )

    return bind(fields, resolve)

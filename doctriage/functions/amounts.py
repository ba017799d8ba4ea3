"""Amounts, currencies and times of day."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from doctriage import fixed
from doctriage.functions.constants import text_map
from doctriage.functions.regex import bind
from doctriage.functions.text import collapse_spaces


def parse_amount(value: Column) -> Column:
    """A number with thousands and decimal separators of any locale, as DOUBLE.

    With both separators present the last one is the decimal one; commas alone
    are decimal; of several dots only the last is.  NULL if that fails.
    """
    digits = F.replace(collapse_spaces(value), F.lit(" "), F.lit(""))
    has_comma, has_dot = F.contains(digits, F.lit(",")), F.contains(digits, F.lit("."))
    comma_is_last = F.instr(F.reverse(digits), ",") < F.instr(F.reverse(digits), ".")
    no_dots = F.replace(digits, F.lit("."), F.lit(""))
    plain = (
        F.when(has_comma & has_dot & ~comma_is_last, F.replace(digits, F.lit(","), F.lit("")))
        .when(has_comma, F.replace(no_dots, F.lit(","), F.lit(".")))
        .otherwise(F.regexp_replace(digits, r"\.(?=.*\.)", ""))
    )
    return plain.try_cast("double")


_STEP = 1 << 40


def _tie(value: Column, digits: int) -> Column:
    """Whether the shortest decimal form lies halfway between two results; it decides for all other values."""
    return value.cast("string").rlike(rf"\.[0-9]{{{digits}}}5$|E-")


def _needs_exact(value: Column, digits: int) -> Column:
    """Where the decimal form does not settle it; above 1e14 it has to (no total is that large)."""
    size = F.abs(value)
    return (size < 1e14) & ((size > 1e9) | _tie(value, digits))


def _exact_units(value: Column, digits: int) -> Column:
    """Units of the last digit nearest to a size below 1e14, half to even, by its exact binary value.

    The fraction is taken in two parts of 40 bits, so that all products are whole numbers.
    """
    power, last = 10**digits, F.lit(_STEP - 1)

    def units(size: Column, high: Column, low: Column) -> Column:
        def of(total: Column) -> Column:
            rest, half = total.bitwiseAND(last), F.lit(_STEP // 2)
            even = F.shiftright(total, 40)
            up = (rest > half) | ((rest == half) & ((low.bitwiseAND(last) > 0) | (even % 2 == 1)))
            return F.floor(size) * F.lit(power) + even + up.cast("long")

        return bind(high * F.lit(power) + F.shiftright(low, 40), of)

    def split(size: Column) -> Column:
        return bind(
            (size - F.floor(size).cast("double")) * float(_STEP),
            lambda scaled: bind(
                F.floor(scaled),
                lambda high: bind(
                    F.floor((scaled - high.cast("double")) * float(_STEP)) * F.lit(power), lambda low: units(size, high, low)
                ),
            ),
        )

    return bind(F.abs(value), split)


def fixed_point(value: Column, digits: int = 2) -> Column:
    """A double with so many decimals, as text; rounded half to even on its binary value."""

    def written(units: Column) -> Column:
        whole, rest = F.floor(units / F.lit(10**digits)).cast("string"), F.pmod(units, F.lit(10**digits)).cast("string")
        return F.concat(F.when(value < 0, F.lit("-")).otherwise(F.lit("")), whole, F.lit("."), F.lpad(rest, digits, "0"))

    return F.when(_needs_exact(value, digits), bind(_exact_units(value, digits), written)).otherwise(F.format_string(f"%.{digits}f", value))


def rounded(value: Column, digits: int = 4) -> Column:
    """The double nearest to the value rounded half to even on its binary value."""
    nearest = _exact_units(value, digits).cast("double") / float(10**digits)
    return F.when(_needs_exact(value, digits), F.when(value < 0, -nearest).otherwise(nearest)).otherwise(F.bround(value, digits))


def currency_code(code: Column, symbol: Column) -> Column:
    """The written code in upper case, else the code of the symbol, else NULL."""
    return F.when(F.coalesce(code, F.lit("")) != "", F.upper(code)).otherwise(
        F.try_element_at(text_map(fixed.CURRENCY_SYMBOLS), collapse_spaces(symbol))
    )


def normalize_time(hour: Column, minute: Column, am_pm: Column) -> Column:
    """12- or 24-hour parts to ``HH:MM``; the range is not checked."""
    h, half = hour.try_cast("int"), F.upper(F.coalesce(am_pm, F.lit("")))
    h24 = F.when((half == "PM") & (h != 12), h + 12).when((half == "AM") & (h == 12), F.lit(0)).otherwise(h)
    two_digits = F.lpad(minute.try_cast("int").cast("string"), 2, "0")
    return F.concat_ws(":", F.lpad(h24.cast("string"), 2, "0"), two_digits)

"""Trimming, search patterns, rounding and number text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters with the Unicode White_Space property.
WHITE_SPACE = (
    "\u0009\u000a\u000b\u000c\u000d\u0020\u0085\u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def trim_text(text: Column) -> Column:
    """Strip Unicode white space at both ends (`F.trim` strips blanks only)."""
    return F.trim(text, F.lit(WHITE_SPACE))


def blank_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def normalise_search(search: str | None) -> str | None:
    """Trimmed search text; a blank one means no filter."""
    if search is None:
        return None
    return search.strip(WHITE_SPACE) or None


def contains_text(text: Column, search: str) -> Column:
    """Case-insensitive LIKE '%search%': `%` and `_` stay wildcards, `\\` is literal."""
    pattern = "%" + search.replace("\\", "\\\\") + "%"
    return F.like(F.lower(text), F.lower(F.lit(pattern)))


def round_half_up(number: Column) -> Column:
    """Round halves toward positive infinity."""
    return F.floor(number + F.lit(0.5))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of `value`, computed once however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _shortest(number: Column) -> Column:
    """A finite positive double in digits and exponent, `d.ddde±n`, as short as it reads back.

    Fifteen digits read back unless the double needs sixteen or seventeen; next to zero one
    digit may do where fifteen say more than there is.
    """
    tries = [F.format_string(f"%.{digits}e", number) for digits in (0, 14, 15)]
    exact = F.format_string("%.16e", number)
    return F.coalesce(*[F.when(t.cast("double") == number, t) for t in tries], exact)


def _moved(digits: Column, exponent: Column) -> Column:
    """Digits with the point behind the first one moved by `exponent`."""
    point, count = exponent + 1, F.length(digits)
    scientific = F.concat(
        F.substring(digits, 1, 1),
        F.when(count > 1, F.concat(F.lit("."), digits.substr(F.lit(2), count))).otherwise(F.lit("")),
        F.when(exponent < 0, F.lit("e-")).otherwise(F.lit("e+")),
        F.abs(exponent).cast("string"),
    )
    return (
        F.when((point > 21) | (point < -5), scientific)
        .when(point <= 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), digits))
        .when(point >= count, F.concat(digits, F.repeat(F.lit("0"), point - count)))
        .otherwise(F.concat(digits.substr(F.lit(1), point), F.lit("."), digits.substr(point + 1, count)))
    )


def number_text(number: Column) -> Column:
    """A double as a script would print it: `-1`, `0.25`, `1e-7`, `1e+22`, at any size.

    Plain notation from 1e-6 up to 1e21, exponents beyond; no digits are cut.
    """
    size = F.abs(number)

    def finite(text: Column) -> Column:
        mantissa = F.replace(F.substring_index(text, "e", 1), F.lit("."), F.lit(""))
        digits = F.rtrim(mantissa, F.lit("0"))
        parts = F.struct(digits.alias("digits"), F.substring_index(text, "e", -1).cast("int").alias("exponent"))
        return _let(parts, lambda p: _moved(p["digits"], p["exponent"]))

    sign = F.when(number < 0, F.lit("-")).otherwise(F.lit(""))
    return (
        F.when(F.isnan(number), F.lit("NaN"))
        .when(size == float("inf"), F.concat(sign, F.lit("Infinity")))
        .when(number == 0, F.lit("0"))
        .when(number.isNotNull(), F.concat(sign, _let(_shortest(size), finite)))
    )

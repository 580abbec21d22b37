"""Cell formats of a displayed table, with the rounding of ``toFixed``.

A browser rounds the exact binary value of a number: 1.005 shows as 1.00 in a
table and as 1.01 after Spark's ``round``, which works on the shortest decimal
text. ``format_number`` rounds the binary value too, but takes halves to the
even digit where a browser takes them up. A binary number is such a half after
k decimals exactly if multiplying it by 2^(k+1) gives an odd whole number, so
halves are found without error and pushed off the middle.
"""

from __future__ import annotations

import math
import re
from fractions import Fraction

from pyspark.sql import Column, functions as F

# From here on a browser shows the exponent form instead of digits.
FIXED_LIMIT = 1e21


def _half_after(size: Column, decimals: int) -> Column:
    return F.pmod(size * float(2 ** (decimals + 1)), F.lit(2.0)) == 1.0


def _rounded(size: Column, decimals: int) -> Column:
    """Digits of a size with commas between groups of three, halves up."""
    pushed = F.when(_half_after(size, decimals), size + 0.25 / 10**decimals).otherwise(size)
    return F.format_number(pushed, decimals)


def _fixed_size(x: Column, digits: int) -> Column:
    """``toFixed`` of the absolute value, with commas."""
    size = F.abs(x)
    exponent = F.regexp_replace(size.cast("string"), r"(\.0)?E", "e+")
    return F.when(size < FIXED_LIMIT, _rounded(size, digits)).otherwise(exponent)


def _sign(x: Column) -> Column:
    return F.when(x < 0, "-").otherwise("")


def fixed_text(x: Column, digits: int) -> Column:
    """``toFixed(digits)``."""
    return F.concat(_sign(x), F.replace(_fixed_size(x, digits), F.lit(","), F.lit("")))


def _least_size(power: int, digits: int) -> float:
    """The smallest double that shows ``digits`` figures starting at 10^power.

    Rounding lifts numbers just below a power of ten to it: 99.95 shows as 100
    with three figures.
    """
    bound = Fraction(10) ** power - Fraction(10) ** (power - digits) / 2
    nearest = float(bound)
    return nearest if Fraction(nearest) >= bound else math.nextafter(nearest, math.inf)


def _scientific(size: Column, digits: int) -> Column:
    decimals = F.lit(digits - 1) - F.floor(F.log10(size)).cast("int")
    unit = F.pow(F.lit(10.0), -decimals)
    half = F.when(
        decimals >= 0, F.pmod(size * F.pow(F.lit(2.0), decimals + 1), F.lit(2.0)) == 1.0
    ).otherwise(F.pmod(size, unit) == unit / 2)
    pushed = F.when(half, size * (1 + 2.0**-50)).otherwise(size)
    pattern = "0" + ("." + "0" * (digits - 1) if digits > 1 else "") + "E0"
    text = F.call_function("format_number", pushed, F.lit(pattern))
    return F.replace(F.regexp_replace(text, r"E(?=\d)", "e+"), F.lit("E"), F.lit("e"))


def _precise_size(x: Column, digits: int) -> Column:
    """``toPrecision`` of the absolute value, with commas."""
    size = F.abs(x)
    text = F.when(size == 0, "0" if digits == 1 else "0." + "0" * (digits - 1))
    text = text.when(size >= _least_size(digits, digits), _scientific(size, digits))
    # One literal number of decimals per power of ten.
    for power in range(digits - 1, -7, -1):
        text = text.when(size >= _least_size(power, digits), _rounded(size, digits - 1 - power))
    return text.otherwise(_scientific(size, digits))


def precision_text(x: Column, digits: int) -> Column:
    """``toPrecision(digits)``, for 1 to 15 digits."""
    return F.concat(_sign(x), F.replace(_precise_size(x, digits), F.lit(","), F.lit("")))


def group_digits(text: Column, interval: int = 3, mark: str = ",", decimal: str = ".") -> Column:
    """Set ``mark`` between groups of ``interval`` digits of the whole part.

    Text that is not a plain number (``1e+21``) is returned as it is.
    """
    point = re.escape(decimal)
    text = F.regexp_replace(text, r"\.(?=\d*$)", _literal(decimal))
    # Not after the decimal point, nor in an exponent.
    places = rf"(?<=\d)(?<!(?:[.]|{point})\d{{0,40}})(?<!e[+-]\d{{0,3}})(?=(\d{{{interval}}})+(?!\d))"
    return F.regexp_replace(text, places, _literal(mark))


def _marked(grouped: Column, interval: int, mark: str, decimal: str) -> Column:
    """Text with commas and a point, with the marks asked for."""
    if (interval, mark, decimal) == (3, ",", "."):
        return grouped
    return group_digits(F.replace(grouped, F.lit(","), F.lit("")), interval, mark, decimal)


def _literal(mark: str) -> str:
    return mark.replace("\\", "\\\\").replace("$", "\\$")


def _shown(value: Column, text: Column, zero: str | None) -> Column:
    """Missing shows as empty text, zero as its own text if there is one."""
    if zero is not None:
        text = F.when(value == 0, zero).otherwise(text)
    return F.when(value.isNull() | F.isnan(value), "").otherwise(text)


# The number a text begins with, blanks in front allowed.
LEADING_NUMBER = r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"


def _number(value: Column) -> Column:
    """A cell as a number. Of a text it is the number it begins with, as in a browser:
    ``5 kg`` is 5 here, whereas a column of numbers (``to_number``) has it missing."""
    leading = F.regexp_extract(value.cast("string"), LEADING_NUMBER, 1).try_cast("double")
    return F.when(F.typeof(value) == "string", leading).otherwise(value.try_cast("double"))


def format_round(
    value: Column, digits: int, interval: int = 3, mark: str = ",", decimal: str = ".",
    zero: str | None = None,
) -> Column:
    x = _number(value)
    return _shown(x, F.concat(_sign(x), _marked(_fixed_size(x, digits), interval, mark, decimal)), zero)


def format_currency(
    value: Column, currency: str = "$", digits: int = 2, interval: int = 3, mark: str = ",",
    decimal: str = ".", before: bool = True, zero: str | None = None,
) -> Column:
    """The sign comes before the symbol: -$5.00."""
    x = _number(value)
    text = _marked(_fixed_size(x, digits), interval, mark, decimal)
    text = F.concat(F.lit(currency), text) if before else F.concat(text, F.lit(currency))
    return _shown(x, F.concat(_sign(x), text), zero)


def format_percent(
    value: Column, digits: int = 0, interval: int = 3, mark: str = ",", decimal: str = ".",
    zero: str | None = None,
) -> Column:
    x = _number(value)
    text = F.concat(_sign(x), _marked(_fixed_size(x * 100, digits), interval, mark, decimal))
    return _shown(x, F.concat(text, F.lit("%")), zero)


def format_signif(
    value: Column, digits: int, interval: int = 3, mark: str = ",", decimal: str = ".",
    zero: str | None = None,
) -> Column:
    x = _number(value)
    return _shown(x, F.concat(_sign(x), _marked(_precise_size(x, digits), interval, mark, decimal)), zero)


def format_string(value: Column, prefix: str = "", suffix: str = "") -> Column:
    return F.coalesce(F.concat(F.lit(prefix), value.cast("string"), F.lit(suffix)), F.lit(""))


def format_date(value: Column, pattern: str = "EEE MMM dd yyyy", zone: str | None = None) -> Column:
    """Date text, empty for missing.

    A bare date is local and is never moved. A time of day is UTC; ``zone``
    shows it on that zone's clock.
    """
    if zone:
        value = F.convert_timezone(F.lit("UTC"), F.lit(zone), value.cast("timestamp_ntz"))
    return F.coalesce(F.date_format(value, pattern), F.lit(""))


def round_half_even(x: Column, digits: int) -> Column:
    return F.bround(x, digits)


def round_by_factor(x: Column, digits: int) -> Column:
    """Rounding of a slider value: scale, round halves up, scale back."""
    factor = float(10**digits)
    return F.floor(x * factor + 0.5).cast("double") / factor

"""Pace codec: text <-> minutes, as native column expressions.

Text forms are ``M'SS"`` and ``M:SS``. Missing text is null on input and ``''`` on output.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_WHOLE = r"^\s*[+-]?[0-9]+\s*$"


def number(c: Column) -> Column:
    """Text to a finite double; anything else is null.

    ``try_cast`` alone would take Java suffixes such as ``1.5d``, and NaN or infinity would then
    count as values in comparisons and averages.
    """
    text = F.trim(c.cast("string"))
    plain = F.when(~F.lower(F.right(text, F.lit(1))).isin("d", "f"), text)
    return finite(plain.try_cast("double"))


def finite(c: Column) -> Column:
    return F.when(F.abs(c) < float("inf"), c)  # NaN sorts above infinity


def _whole(text: Column) -> Column:
    return F.when(text.rlike(_WHOLE), F.trim(text).try_cast("double"))


def _split_minutes(text: Column) -> Column:
    prime = text.contains("'") & text.contains('"')
    tail = F.replace(F.split_part(text, F.lit("'"), F.lit(2)), F.lit('"'), F.lit(""))
    return (
        F.when(prime, _whole(F.split_part(text, F.lit("'"), F.lit(1))) + _whole(tail) / 60)
        .when(
            text.contains(":"),
            _whole(F.split_part(text, F.lit(":"), F.lit(1)))
            + _whole(F.split_part(text, F.lit(":"), F.lit(2))) / 60,
        )
        .otherwise(number(text))
    )


def parse(c: Column) -> Column:
    """Pace text or a plain number to minutes. A leading ``-`` belongs to the minutes only."""
    return _split_minutes(c.cast("string"))


def parse_signed(c: Column) -> Column:
    """As :func:`parse`, but a leading ``-`` applies to the whole value."""
    text = c.cast("string")
    negative = text.startswith("-")
    body = F.when(negative, F.substring(text, F.lit(2), F.length(text))).otherwise(text)
    return F.when(negative, -_split_minutes(body)).otherwise(_split_minutes(body))


def parse_target(c: Column) -> Column:
    """Training target: only text holding a ``'`` counts; parts may have fractions."""
    text = c.cast("string")
    tail = F.replace(F.split_part(text, F.lit("'"), F.lit(2)), F.lit('"'), F.lit(""))
    return F.when(
        text.contains("'"), number(F.split_part(text, F.lit("'"), F.lit(1))) + number(tail) / 60
    )


_FRACTIONS = 1e15  # from here on a double has no seconds; NaN and infinity have no text at all


def total_seconds_sql(minutes: str) -> str:
    """Signless minutes as whole seconds: half-even within the minute, 60 seconds carry."""
    size = f"abs({minutes})"
    seconds = f"cast({size} AS bigint) * 60 + cast(rint(({size} - floor({size})) * 60) AS bigint)"
    return f"CASE WHEN {size} < double('{_FRACTIONS}') THEN {seconds} END"


def clock_sql(minutes: str, total: str, mark: str, end: str = "") -> str:
    """Text of minutes and their whole seconds ``total``: sign, minutes, mark, two-digit seconds; missing gives ``''``."""
    mark, end = mark.replace("'", "\\'"), end.replace("'", "\\'")
    sign, size = f"if({minutes} < 0, '-', '')", f"abs({minutes})"
    large = f"{size} >= double('{_FRACTIONS}') AND {size} < double('Infinity')"
    return (
        f"coalesce(concat({sign}, cast({total} div 60 AS string), '{mark}', lpad(cast({total} % 60 AS string), 2, '0'), '{end}'), "
        f"CASE WHEN {large} THEN concat({sign}, format_string('%.0f', {size}), '{mark}00{end}') END, '')"
    )


PRIME, COLON = ("'", '"'), (":", "")


def _clock(minutes: Column, form: tuple[str, str]) -> Column:
    size = F.abs(minutes)
    sign = F.when(minutes < 0, "-").otherwise("")
    small = F.when(size < _FRACTIONS, size)
    seconds = F.rint((small - F.floor(small)) * 60).cast("bigint")
    whole = F.floor(small) + F.when(seconds == 60, 1).otherwise(0)
    parts = (sign, whole.cast("string"), F.lit(form[0]), F.lpad((seconds % 60).cast("string"), 2, "0"), F.lit(form[1]))
    large = F.when((size >= _FRACTIONS) & (size < float("inf")), F.concat(sign, F.format_string("%.0f", size), F.lit(f"{form[0]}00{form[1]}")))
    return F.coalesce(F.concat(*parts), large, F.lit(""))


def to_prime(minutes: Column) -> Column:
    """Minutes to ``M'SS"``, a negative difference with the sign in front; missing gives ``''``."""
    return _clock(minutes, PRIME)


def to_colon(minutes: Column) -> Column:
    """Minutes to signed ``M:SS``."""
    return _clock(minutes, COLON)


def to_colon_truncated(minutes: Column) -> Column:
    """Display form ``M:SS`` with both parts cut off instead of rounded; null stays null."""
    small = F.when(F.abs(minutes) < _FRACTIONS, minutes)
    seconds = F.floor(F.pmod(small, F.lit(1.0)) * 60).cast("string")
    text = F.concat(small.cast("bigint").cast("string"), F.lit(":"), F.lpad(seconds, 2, "0"))
    large = (F.abs(minutes) >= _FRACTIONS) & (F.abs(minutes) < float("inf"))
    return F.coalesce(text, F.when(large, F.concat(F.format_string("%.0f", minutes), F.lit(":00"))))


def from_time(moving_time: Column, distance: Column) -> Column:
    return (moving_time / 60) / F.nullif(distance, F.lit(0.0))


def from_speed(speed: Column) -> Column:
    return F.lit(60.0) / F.nullif(finite(speed), F.lit(0.0))

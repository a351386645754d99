"""Exact sums of doubles: integers binned by exponent.

A double is an integer times a power of two. Each value is cut into limbs, signed integers at fixed bit
positions, so that sums and differences of limbs are plain integer arithmetic: exact, in any order, over the
whole range of doubles. Only the final step back to a double rounds. The positions come from one aggregate
over the column (largest and smallest magnitude, digits behind the binary point); a column of whole numbers
needs one limb, a column over all magnitudes a double can have about seventy.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from paceforge.schema import q

#: Binary digits behind the point that are looked for; values with more take the width of a mantissa.
_FRACTIONS = (0, 8, 20, 40)
_MANTISSA, _LOWEST = 53, -1074


def finite(column: str) -> Column:
    """The value as a double; null where it is missing, NaN or infinite."""
    v = F.col(q(column)).cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))), v)


def magnitudes(columns: Sequence[str]) -> list[Column]:
    """Aggregates ``_hi``, ``_lo`` and ``_frac`` of each column, by its place in the list."""
    out = []
    for i, c in enumerate(columns):
        v = finite(c)
        size = F.abs(v)
        digits = F.lit(None).cast("int")
        for n in reversed(_FRACTIONS):
            scaled = v * F.lit(2.0**n)
            digits = F.when(scaled == F.rint(scaled), n).otherwise(F.coalesce(digits, F.lit(-_LOWEST)))
        out += [
            F.max(size).alias(f"_hi{i}"),
            F.min(F.when(size > 0, size)).alias(f"_lo{i}"),
            F.max(F.when(v.isNotNull(), digits)).alias(f"_frac{i}"),
        ]
    return out


def merged(columns: Sequence[str]) -> list[Column]:
    """The same aggregates over a table that already holds them per group."""
    out = []
    for i in range(len(columns)):
        out += [F.max(f"_hi{i}").alias(f"_hi{i}"), F.min(f"_lo{i}").alias(f"_lo{i}"), F.max(f"_frac{i}").alias(f"_frac{i}")]
    return out


@dataclass(frozen=True)
class Limbs:
    """``count`` limbs of ``bits`` bits; the first one counts units of 2^low."""

    low: int
    bits: int
    count: int

    def unit(self, k: int) -> float:
        return math.ldexp(1.0, self.low + k * self.bits)

    def split(self, value: Column) -> list[Column]:
        """Limbs of a finite double, lowest first, null for null: the digits between two roundings."""
        out = []
        for k in range(self.count):
            digits = F.rint(value / F.lit(self.unit(k)))
            if k == self.count - 1:
                out.append(digits.cast("bigint"))
                continue
            above = F.rint(value / F.lit(self.unit(k + 1))) * F.lit(2.0**self.bits)
            # a value this large has no digits here, and dividing it could leave the range of doubles
            room = min(self.low + (k + 1) * self.bits + _MANTISSA, 1023)
            has_digits = F.abs(value) < F.lit(math.ldexp(1.0, room))
            out.append(F.when(has_digits, (digits - above).cast("bigint")).when(value.isNotNull(), F.lit(0).cast("bigint")))
        return out

    def join(self, limbs: Sequence[Column]) -> Column:
        """The double of summed limbs. Carries run upwards once to find the sign and once over magnitudes,
        so nothing cancels when the digits are added, lowest first."""
        if self.count == 1:
            return limbs[0].cast("double") * F.lit(self.unit(0))
        if self.count > 3:
            return self._joined_array(limbs)
        sign = F.when(self._carried(limbs)[-1] < 0, F.lit(-1)).otherwise(F.lit(1)).cast("bigint")
        digits = self._carried([x * sign for x in limbs])
        total = digits[0].cast("double") * F.lit(self.unit(0))
        for k in range(1, self.count):
            total = total + digits[k].cast("double") * F.lit(self.unit(k))
        return total * sign

    def _joined_array(self, limbs: Sequence[Column]) -> Column:
        """The same for many limbs, over an array: the written-out carries would grow with their cube."""
        mask, none = F.lit((1 << self.bits) - 1).cast("bigint"), F.lit(0).cast("bigint")
        units = [self.unit(k) for k in range(self.count)]
        above = self.low + self.count * self.bits
        beyond = F.lit(math.ldexp(1.0, above) if above < 1024 else float("inf"))
        values = F.array(*limbs)
        left_over = F.aggregate(values, none, lambda carry, x: F.shiftright(x + carry, self.bits))
        sign = F.when(left_over < 0, F.lit(-1)).otherwise(F.lit(1)).cast("bigint")
        places = F.arrays_zip(values.alias("x"), F.array(*map(F.lit, units)).alias("unit"))

        def add(state: Column, place: Column) -> Column:
            x = place["x"] * state["sign"] + state["carry"]
            total = state["total"] + x.bitwiseAND(mask).cast("double") * place["unit"]
            return F.struct(state["sign"].alias("sign"), F.shiftright(x, self.bits).alias("carry"), total.alias("total"))

        def end(state: Column) -> Column:
            rest = F.when(state["carry"] > 0, state["carry"].cast("double") * beyond).otherwise(F.lit(0.0))
            return (state["total"] + rest) * state["sign"]

        start = F.struct(sign.alias("sign"), none.alias("carry"), F.lit(0.0).alias("total"))
        return F.aggregate(places, start, add, end)

    def _carried(self, limbs: Sequence[Column]) -> list[Column]:
        mask = F.lit((1 << self.bits) - 1).cast("bigint")
        out, carry = [], None
        for x in limbs:
            x = x if carry is None else x + carry
            out.append(x.bitwiseAND(mask))
            carry = F.shiftright(x, self.bits)
        return [*out[:-1], x]


def plan(row: Row, rows: int, columns: Sequence[str]) -> list[Limbs]:
    """Limbs for each column, wide enough that sums over ``rows`` values stay within 64 bits."""
    bits = max(8, min(50, 60 - max(1, rows).bit_length()))
    out = []
    for i in range(len(columns)):
        high, least, digits = row[f"_hi{i}"], row[f"_lo{i}"], row[f"_frac{i}"]
        if not high:
            out.append(Limbs(0, bits, 1))
            continue
        low = -digits if digits <= _FRACTIONS[-1] else max(_LOWEST, math.frexp(least)[1] - _MANTISSA)
        out.append(Limbs(low, bits, max(1, -(-(math.frexp(high)[1] + 1 - low) // bits))))
    return out


def plan_for(df: DataFrame, columns: Sequence[str]) -> list[Limbs]:
    """Limbs for these columns of ``df``, from one aggregate over it."""
    if not columns:
        return []
    row = df.agg(F.count(F.lit(1)).alias("_rows"), *magnitudes(columns)).first()
    return plan(row, row["_rows"], columns)

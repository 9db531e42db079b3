"""Exact selection by rank, a radix digit of 16 bits a round.

A round counts, map-side first, how many values of each slot have which next digit, at most
``BINS`` counts a slot whatever the data; the digit in which the wanted rank falls is kept and
only values that share it take part in the next round. At most four rounds settle 64 bits. No
value is sorted or ranked, and what reaches the driver is one row a slot and round.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, functions as F

BITS, DIGIT = 64, 16
BINS = 1 << DIGIT


def with_ordered_bits(rows: DataFrame, value: str, name: str = "bits") -> DataFrame:
    """``rows`` with a double as a 64-bit integer of the same order: its IEEE bits, negated below zero.

    Zero and minus zero are equal; NaN and NULL give NULL. Built from arithmetic on powers of two,
    which is exact, in steps that each use the one before more than once: generated code stays small
    as long as no filter on the bits is pushed below them.
    """
    size, rough, scaled, by = "size of the value", "rough exponent", "scaled value", "exponent correction"
    half = F.floor(F.col(rough) / 2)
    steps = rows.withColumn(size, F.abs(F.col(value).cast("double")))
    steps = steps.withColumn(rough, F.greatest(F.floor(F.log2(size)), F.lit(-1022)))
    # two factors, as the inverse of the smallest power of two is no double
    steps = steps.withColumn(scaled, F.col(size) * F.pow(F.lit(2.0), -half) * F.pow(F.lit(2.0), half - F.col(rough)))
    # the logarithm may round to the next whole number
    low = (F.col(scaled) < 1) & (F.col(rough) > -1022)
    steps = steps.withColumn(by, F.when(F.col(scaled) >= 2, 1).when(low, -1).otherwise(0))
    steps = steps.withColumn(scaled, F.col(scaled) * F.when(F.col(by) == 1, 0.5).when(F.col(by) == -1, 2.0).otherwise(1.0))
    normal = (F.col(scaled) >= 1).cast("int")
    exponent = (F.col(rough) + F.col(by) + 1023) * normal
    bits = (
        F.when(F.isnan(size), F.lit(None))
        .when(F.col(size) == 0, F.lit(0).cast("bigint"))
        .when(F.col(size) == float("inf"), F.lit(2047 << 52))
        .otherwise(exponent * F.lit(1 << 52) + ((F.col(scaled) - normal) * float(1 << 52)).cast("bigint"))
    )
    steps = steps.withColumn(name, bits)
    signed = F.when(F.col(value) < 0, -F.col(name)).otherwise(F.col(name))
    return steps.withColumn(name, signed).drop(size, rough, scaled, by)


def known(value: str, rows: DataFrame) -> Column:
    """Whether a value counts: it is neither NULL nor NaN."""
    there = F.col(value).isNotNull()
    return there & ~F.isnan(value) if rows.schema[value].dataType.typeName() in ("double", "float") else there


class Slot(NamedTuple):
    """A rank among the ``left`` values of ``group`` from low to high, whose first ``done`` bits are equal."""

    group: object
    name: object
    rank: int
    done: int
    low: object
    high: object
    left: int

    def has(self, group: str, value: str) -> Column:
        inside = F.col(value).between(F.lit(self.low), F.lit(self.high))
        return F.col(group).eqNullSafe(F.lit(self.group)) & inside


def select_ranks(
    cells: DataFrame,
    wanted: dict[object, Callable[[Column], Column]],
    with_bits: Callable[[DataFrame, str], DataFrame] = with_ordered_bits,
) -> dict:
    """The values at given ranks of each group: ``{(group, name): value}``.

    ``cells`` holds ``group``, of which there are few, and ``value``; it is read once a round.
    ``with_bits`` adds ``bits``, a bigint in the order of the values, which may be equal for different
    ones. ``wanted`` gives each name a rank, beginning with 1, by the number of a group's values.
    Ranks that a group does not have are left out; NULL and NaN do not count.
    """
    # a filter on the bits would be pushed below their steps and written out as one expression
    cells = cells.select("group", "value").where(known("value", cells))
    bits = with_bits(cells, "value")
    first = _counted(bits.select("group", "value", F.shiftright("bits", BITS - DIGIT).alias("digit")), "group")
    total = F.sum("n").over(Window.partitionBy("group"))
    asked = F.array(*[F.struct(F.lit(i).alias("name"), rank(F.col("total")).cast("bigint").alias("rank"))
                      for i, rank in enumerate(wanted.values())])
    first = first.withColumn("total", total).select("*", F.inline(asked))
    names = list(wanted)
    found, open_ = {}, []
    for r in _reached(first, "group", "name"):
        slot = Slot(r["group"], names[r["name"]], r["rank"] - r["before"], DIGIT, r["low"], r["high"], r["n"])
        _sort_out(slot, found, open_)
    while open_:
        slots, open_ = open_, []
        # so few values that their whole bits make no more bins than a digit does
        steps = [BITS if s.left <= BINS else s.done + DIGIT for s in slots]
        near = cells.where(reduce(or_, [s.has("group", "value") for s in slots]))
        tests = [
            F.when(s.has("group", "value"), F.struct(
                F.lit(i).alias("slot"), F.lit(s.rank).cast("bigint").alias("rank"), F.shiftright("bits", BITS - step).alias("digit")
            ))
            for i, (s, step) in enumerate(zip(slots, steps))
        ]
        parts = with_bits(near, "value").select("value", F.inline(F.array_compact(F.array(*tests))))
        for r in _reached(_counted(parts, "slot", "rank"), "slot"):
            old = slots[r["slot"]]
            slot = Slot(old.group, old.name, old.rank - r["before"], steps[r["slot"]], r["low"], r["high"], r["n"])
            if slot.done < BITS or slot.low == slot.high:
                _sort_out(slot, found, open_)
            else:
                found[slot.group, slot.name] = _among_equals(cells, slot)
    return found


def _counted(parts: DataFrame, *keys: str) -> DataFrame:
    return parts.groupBy(*keys, "digit").agg(
        F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high")
    )


def _reached(counted: DataFrame, *slot: str) -> list:
    """The digit in which the rank of each slot falls; the window is over counts of digits."""
    upto = F.sum("n").over(Window.partitionBy(*slot).orderBy("digit"))
    placed = counted.withColumn("before", upto - F.col("n"))
    return placed.where((F.col("before") < F.col("rank")) & (F.col("rank") <= F.col("before") + F.col("n"))).collect()


def _sort_out(slot: Slot, found: dict, open_: list) -> None:
    if slot.low == slot.high:
        found[slot.group, slot.name] = slot.low
    else:
        open_.append(slot)


def _among_equals(cells: DataFrame, slot: Slot) -> object:
    """Different values with all bits equal, as hashes cut to 64 bits may rarely have."""
    same = cells.where(slot.has("group", "value"))
    upto = 0
    for r in same.groupBy("value").agg(F.count(F.lit(1)).alias("n")).orderBy("value").toLocalIterator():
        upto += r["n"]
        if upto >= slot.rank:
            return r["value"]
    raise ValueError("rank beyond the values")

"""Scalar rules of the motif operators, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ADDRESS = r"\b[0-9a-fA-F]{40}\b"


def covers_outflow(largest: Column, total_in: Column, out: Column) -> Column:
    """The largest inflow is positive and at least ten times what the inflow exceeds the outflow by.

    There is no lower bound: an outflow larger than the inflow passes.  An empty window (null) fails.
    """
    return F.coalesce((largest > 0) & (largest >= (total_in - out) * 10), F.lit(False))


def relays(value_in: Column, value_out: Column) -> Column:
    """The outflow is at most the inflow, and the inflow at most a tenth of the outflow more."""
    return (value_in >= value_out) & (value_out >= (value_in - value_out) * 10)


def amount(text: Column, digits: int = 29) -> Column:
    """A value as decimal(38,0), or null where it is no number or too large for exact sums of 10^7 values times 10."""
    value = text.try_cast("decimal(38,0)")
    return F.when(F.abs(value) < F.lit("1" + "0" * digits).cast("decimal(38,0)"), value)


def addresses(cell: Column) -> Column:
    """All 40-digit hexadecimal words of a cell in lower case, repeats included."""
    return F.transform(F.regexp_extract_all(cell, F.lit(ADDRESS), F.lit(0)), F.lower)


def entity_name(name: Column) -> Column:
    """A name up to its first colon, and of that up to its first blank."""
    return F.split(F.split(name, ":")[0], " ")[0]


def joined(members: Column) -> Column:
    """Distinct members in order, comma-joined."""
    return F.array_join(F.array_sort(F.array_distinct(members)), ",")

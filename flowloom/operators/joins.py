"""Joins with what was aggregated by the join key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def split_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """An equi-join on ``keys`` that a frequent key does not hold up; null keys match nothing.

    Where a side was just aggregated by the keys, Spark joins where the aggregation ran, and all rows of a key stay in
    one task.  Another key, made of the first, gives both sides a shuffle for the join alone, and adaptive execution
    can then split a large partition.  It is the hash of the keys, beside them; of a single long it is all its bits
    inverted, in place of it, so that rows grow no wider.
    """
    name = fresh("_k", left, right)
    if len(keys) == 1 and left.schema[keys[0]].dataType == right.schema[keys[0]].dataType == T.LongType():
        key, turned = keys[0], F.bitwise_not(F.col(keys[0])).alias(name)
        a, b = (t.select(turned, *(c for c in t.columns if c != key)) for t in (left, right))
        return a.join(b, name, how).select(F.bitwise_not(F.col(name)).alias(key), *(c for c in a.columns[1:]), *(b.columns[1:] if how in ("inner", "left") else []))
    hashed = F.xxhash64(*keys)
    return left.withColumn(name, hashed).join(right.withColumn(name, hashed), [*keys, name], how).drop(name)


def fresh(name: str, *tables: DataFrame) -> str:
    """The name, with as many underscores as no column of the tables has it; names differ by more than case."""
    taken = {c.lower() for t in tables for c in t.columns}
    while name.lower() in taken:
        name += "_"
    return name

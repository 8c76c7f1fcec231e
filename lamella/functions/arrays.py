"""Lists: null and empty differ; an absent list has length 0 and no elements."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def length(a: Column) -> Column:
    """Number of elements; 0 for an absent list."""
    return F.coalesce(F.size(a), F.lit(0))


def element(a: Column, i: Column | int) -> Column:
    """Element i, from 0. Out of range, or of an absent list, is an error."""
    i = F.lit(i) if isinstance(i, int) else i
    return F.when((i < 0) | (i >= length(a)), F.raise_error("index out of range")).otherwise(F.get(a, i))


def element_or(a: Column, i: Column | int, default: object) -> Column:
    """Element i, from 0, or the default when it is out of range or has no value."""
    return F.coalesce(F.get(a, F.lit(i) if isinstance(i, int) else i), F.lit(default))


def is_null_at(a: Column, i: Column | int) -> Column:
    """Whether element i is null; also when it is out of range."""
    return F.get(a, F.lit(i) if isinstance(i, int) else i).isNull()


def present(a: Column) -> Column:
    """How many elements of an optional list have a value."""
    return F.coalesce(F.size(F.filter(a, lambda x: x.isNotNull())), F.lit(0))


def presence_words(a: Column) -> Column:
    """An optional list's presence bits, 32 to a word."""
    n = F.ceil(length(a) / 32).cast("int")
    word = lambda w: F.aggregate(
        F.slice(a, w * 32 + 1, F.lit(32)),
        F.struct(F.lit(0).cast("bigint").alias("bits"), F.lit(1).cast("bigint").alias("bit")),
        lambda s, x: F.struct((s["bits"] + F.when(x.isNotNull(), s["bit"]).otherwise(0)).alias("bits"), (s["bit"] * 2).alias("bit")),
        lambda s: s["bits"],
    )
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), word)).otherwise(F.array().cast("array<bigint>"))


def gather(order: list[str], fields: list[str]) -> Column:
    """Aggregate: rows of a group as one list of structs, ordered; null values stay inside their structs."""
    return F.array_sort(F.collect_list(F.struct(*order, *[f for f in fields if f not in order])))


def flattened(a: Column) -> Column:
    """A list of lists as one list; absent inner lists count as empty."""
    return F.flatten(F.filter(a, lambda x: x.isNotNull()))

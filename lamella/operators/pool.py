"""Pooling of repeated values: each distinct value once, and references to it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: How much is shared. Fixed values.
NONE, STRINGS, ALL = "none", "strings", "all"


def canonical(c: Column, kind: T.DataType) -> Column:
    """A value in a form whose hash tells apart what Spark's hash of the value doesn't: every part says whether it is
    null, every list how long it is. Hashes skip nulls and run over lists without their borders."""
    if isinstance(kind, T.StructType):
        return F.struct(c.isNull(), *(canonical(c[f.name], f.dataType) for f in kind.fields))
    if isinstance(kind, T.ArrayType):
        return F.struct(c.isNull(), F.coalesce(F.size(c), F.lit(0)), F.transform(c, lambda x: canonical(x, kind.elementType)))
    if isinstance(kind, T.MapType):
        return canonical(F.array_sort(F.map_entries(c)), T.ArrayType(T.StructType([T.StructField("key", kind.keyType), T.StructField("value", kind.valueType)])))
    return F.struct(c.isNull(), c)


def value_hash(df: DataFrame, *cols: str) -> list[Column]:
    """128 bits of hash that name the value of these columns, nested ones included. Nulls count by their place."""
    parts = [canonical(F.col(c), df.schema[c].dataType) for c in cols]
    return [F.xxhash64(*parts), F.xxhash64(F.lit(0x5EED), *parts)]


def pool(df: DataFrame, *cols: str) -> DataFrame:
    """Distinct non-null values of the columns together, with ref_a, ref_b (their hash) and uses. Counts combine on the
    map side, so a value that fills a third of all rows is one row per task when it is shuffled."""
    ref = value_hash(df, *cols)
    some = F.coalesce(*(F.col(c).isNotNull() | F.lit(False) for c in cols))
    return df.where(some).groupBy(*cols).agg(F.count("*").alias("uses")).withColumns({"ref_a": ref[0], "ref_b": ref[1]})


def references(df: DataFrame, *cols: str) -> DataFrame:
    """``df`` with the columns replaced by their reference; no join is needed, the hash is the reference."""
    ref = value_hash(df, *cols)
    return df.withColumns({"ref_a": ref[0], "ref_b": ref[1]}).drop(*cols)


def pool_sizes(df: DataFrame, col: str) -> DataFrame:
    """One row: values, distinct_values, bytes_all and bytes_pooled of a text column."""
    one = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count("*").alias("n"))
    size = F.octet_length(col)
    return one.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_values"),
        F.count("*").alias("n_distinct"),
        F.coalesce(F.sum(size * F.col("n")), F.lit(0)).cast("bigint").alias("bytes_all"),
        F.coalesce(F.sum(size), F.lit(0)).cast("bigint").alias("bytes_pooled"),
    )

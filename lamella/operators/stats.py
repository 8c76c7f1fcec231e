"""Statistics over groups of measurements, and order-dependent checksums."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def mad_percent(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Median, and the median absolute deviation in percent of it, per group."""
    middle = df.groupBy(*by).agg(F.median(value).alias("median"))
    # One row per group: joined on the group's key, whichever side Spark finds small.
    both = df.join(middle, by)
    spread = both.groupBy(*by).agg(F.median(F.abs(F.col(value) - F.col("median"))).alias("mad"))
    return middle.join(spread, by).withColumn("mad_percent", F.when(F.col("median") != 0, F.col("mad") / F.col("median") * 100)).drop("mad")


def geometric_mean(value: Column) -> Column:
    """Aggregate: geometric mean of positive values."""
    return F.exp(F.avg(F.ln(value)))


def best_per(df: DataFrame, by: list[str], name: str, value: str) -> DataFrame:
    """Per group, the name with the smallest value (smallest name on ties), and that value."""
    return df.groupBy(*by).agg(F.min(F.struct(value, name)).alias("_b")).select(*by, F.col(f"_b.{name}").alias("best"), F.col(f"_b.{value}").alias("best_value"))


def slower_than(df: DataFrame, by: list[str], name: str, mine: str, value: str, percent: float = 5.0) -> DataFrame:
    """Groups and rivals where ``mine`` takes more than ``percent`` longer: by, rival, ratio. One window, no self-join."""
    own = F.max(F.when(F.col(name) == mine, F.col(value))).over(Window.partitionBy(*by))
    out = df.withColumn("_own", own).where((F.col(name) != mine) & (F.col("_own") > F.col(value) * (1 + percent / 100)))
    return out.select(*by, F.col(name).alias("rival"), (F.col("_own") / F.col(value)).alias("ratio"))


def row_hash(*cols: Column) -> Column:
    """A hash of a row's fields in order; an absent field counts by its place."""
    return F.xxhash64(*(F.struct(F.lit(i), c) for i, c in enumerate(cols)))


def checksum(df: DataFrame, *cols: str) -> DataFrame:
    """One row: n and a checksum that doesn't depend on row order, made of row hashes; it combines on the map side."""
    return df.agg(F.count("*").alias("n"), F.bit_xor(row_hash(*map(F.col, cols))).alias("checksum"))


def ordered_checksum(values: Column) -> Column:
    """Order-dependent checksum of an array of numbers or texts: multiply and xor in 64 bits, element by element; an
    absent element mixes a marker in. Arrow batches, since wrapping arithmetic isn't a Spark expression."""

    @F.arrow_udf("bigint")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for a in batches:
            out = []
            for row in a.to_pylist():
                h = len(row or ())
                for x in row or ():
                    part = 0x9E3779B97F4A7C15 if x is None else xxhash.xxh64_intdigest(repr(x).encode(), seed=0)
                    h = ((h ^ part) * 0x100000001B3) & (2**64 - 1)
                out.append(h - (1 << 64) if h >= 1 << 63 else h)
            yield pa.array(out, pa.int64())

    return run(values)


def picks(a: Column, indexes: list[int]) -> Column:
    """Sum of an array's elements at fixed indexes; those out of range count 0."""
    total = F.lit(0.0)
    for i in indexes:
        total = total + F.coalesce(F.get(a, F.lit(i)).cast("double"), F.lit(0.0))
    return total


def fraction(*key: Column, seed: int = 0) -> Column:
    """A number from 0 to below 1 that the key and the seed decide: the same on every run and every machine."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *key), 11).cast("double") / float(1 << 53)


def skewed_pick(u: Column, n: int, power: float = 2.5) -> Column:
    """An index below n for u from 0 to 1, small ones far more often: the part of u that falls on the first k of n is
    (k / n) ** (1 / power)."""
    return F.least(F.lit(n - 1), F.floor(F.lit(float(n)) * F.pow(u, F.lit(power))).cast("int"))


def weighted_pick(u: Column, weights: list[int]) -> Column:
    """An index for u from 0 to 1, each in proportion to its weight; weights of 0 are never picked."""
    total, out = sum(weights), F.lit(len(weights) - 1)
    for i, w in reversed(list(enumerate(weights))):
        below = sum(weights[: i + 1])
        out = F.when(u * total < below, F.lit(i)).otherwise(out) if w else out
    return out


def gzip_size(c: Column) -> Column:
    """Bytes of a text after gzip."""
    import gzip

    @F.arrow_udf("int")
    def run(a: pa.Array) -> pa.Array:
        return pa.array([None if t is None else len(gzip.compress(t.encode("utf-8"), mtime=0)) for t in a.to_pylist()], pa.int32())

    return run(c)

"""What the operators share: intermediate tables, hashes, Arrow helpers."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from lamella.tables import release, scratch, shared_dir, table

__all__ = ["ASCII_LOWER", "ASCII_SPACE", "ASCII_UPPER", "SLICE", "key128", "lower_ascii", "partitions", "release", "scratch", "shared_dir", "slices", "table"]

#: The six white-space characters that word and line keys use: ``[\x20\x09-\x0D]``.
ASCII_SPACE = " \t\n\x0b\x0c\r"
ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = ASCII_UPPER.lower()
#: Texts that Python holds as objects at a time; Arrow batches may be larger.
SLICE = 256


def lower_ascii(c: Column) -> Column:
    """A-Z to a-z and nothing else; all-ASCII texts take the fast ``lower``."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, ASCII_UPPER, ASCII_LOWER))


def key128(*cols: Column) -> list[Column]:
    """Two 64-bit hashes under different seeds: equal for equal inputs, and collisions are out of reach."""
    return [F.xxhash64(*cols), F.xxhash64(F.lit(0x5EED), *cols)]


def slices(a: pa.Array | pa.ChunkedArray, size: int = SLICE) -> Iterator[list]:
    """Python values of an Arrow array, a bounded number at a time."""
    for i in range(0, len(a), size):
        yield a.slice(i, size).to_pylist()


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))

"""Record operators on streams.

All column functions are plain expressions and work on streaming DataFrames as they are. What is here wires buffers to
a stream: a source of buffer files, and a decoder that keeps damaged buffers beside the rest. Windows, watermarks and
state are Spark's own and not part of the record operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.model import Obj
from lamella.sources.buffers import decoded


def stream_files(spark: SparkSession, path: str, *, max_files: int = 1000) -> DataFrame:
    """A stream of the buffer files that arrive below ``path``: path and content."""
    kinds = "path string, modificationTime timestamp, length bigint, content binary"
    return spark.readStream.format("binaryFile").schema(kinds).option("maxFilesPerTrigger", max_files).load(path).select("path", "content")


def decode_stream(df: DataFrame, root: Obj, *, buffer: str = "content") -> DataFrame:
    """A stream of buffers with value and error columns in the buffer's place."""
    return df.withColumn("_d", decoded(root, F.col(buffer))).drop(buffer).select("*", "_d.*").drop("_d")

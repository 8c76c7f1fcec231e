"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or the context's checkpoint folder. Without
    either, a session whose executors run inside the driver (``local[...]``, as in tests) gets a temporary one; any
    other is refused: a folder of one machine's own would lose rows on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="lamella-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: lineage ends there, so a lost executor
    costs no recomputation, and later plans know the real size. Removed by ``release``, or when the driver's Python
    ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lamella-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _OPEN[path] = spark
    _MADE.get().append(path)
    out._lamella_path = path
    return out


#: Tables that are still there, with their sessions; and those made in the current ``scratch`` block.
_OPEN: dict[str, SparkSession] = {}
_MADE: ContextVar[list[str]] = ContextVar("made", default=[])


def release(*tables: DataFrame) -> None:
    """Remove tables that no later plan reads."""
    _release(df._lamella_path for df in tables)


def _release(paths: Iterable[str]) -> None:
    for path in paths:
        if (spark := _OPEN.pop(path, None)) is not None:
            _remove(spark, path)


@contextmanager
def scratch() -> Iterator[list[DataFrame]]:
    """Tables made inside go when the block ends, but for those put into the list that it gives."""
    kept: list[DataFrame] = []
    token = _MADE.set([])
    try:
        yield kept
    finally:
        made = _MADE.get()
        _MADE.reset(token)
        stay = {df._lamella_path for df in kept}
        _release(path for path in made if path not in stay)
        _MADE.get().extend(path for path in made if path in stay)


@atexit.register
def _release_all() -> None:
    _release(list(_OPEN))


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session has ended: its folder is the cluster's to clean
        return

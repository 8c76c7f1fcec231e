"""Line deduplication with DataFrame functions only.

Lines become 128-bit hashes. The hashes are range-partitioned on (hash, document) and sorted by hash, document and
position, so a very common line is spread over many partitions, and each partition streams over its sorted rows and
hands on the first occurrence in each document. Only one summary row for each partition and hash meets again: how many
documents, and which occurrence is the first of all. What comes out is a run-length bitmap per document, not text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamella.llm.common import ASCII_SPACE, key128, lower_ascii, partitions, table

KEY, ROW = ["ka", "kb"], ["da", "db"]


def split_lines(text: Column) -> Column:
    """Lines of a whole text; null or empty is one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def row_key(doc_id: Column, text: Column) -> list[Column]:
    """Hashes of (id, text) that name a row in joins; rows that repeat both have the same result."""
    return [c.alias(n) for c, n in zip(key128(doc_id, text), ROW)]


def line_table(docs: DataFrame, text: str, doc_id: str, min_chars: int) -> DataFrame:
    """A row per line: ka, kb (hash of the stripped, lower-cased line), doc (the id), da, db (row key), pos.
    Lines whose key is shorter than ``min_chars`` code points can't be dropped and are left out."""
    lines = docs.select(
        F.col(doc_id).alias("doc"),
        *row_key(F.col(doc_id), F.col(text)),
        F.posexplode(F.transform(split_lines(lower_ascii(F.col(text))), lambda x: F.btrim(x, F.lit(ASCII_SPACE)))).alias("pos", "key"),
    )
    return lines.where(F.char_length("key") >= min_chars).select(*(c.alias(n) for c, n in zip(key128(F.col("key")), KEY)), "doc", *ROW, "pos")


def line_bitmaps(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", min_docs: int = 10, min_chars: int = 1, keep_first: bool = False) -> DataFrame:
    """Which lines to drop: those whose key occurs in at least ``min_docs`` rows of ``docs``.

    Returns da, db (see ``row_key``) and runs, a run-length bitmap: lengths of runs that are kept, dropped, kept,
    ... in turn; lines after the last run stay. Documents that lose nothing have no row. With ``keep_first`` the
    first occurrence (by id, then position) of each such key stays.

    Every row is a document of its own, also where ids repeat or are null; rows that agree in both id and text
    count once and have one result. A null or empty text is one empty line, whose key is empty. A very long text is as
    many rows as it has lines; its bitmap is one row, of two numbers a run. An empty table gives an empty result. Other
    columns are not looked at, whatever their names.
    """
    lines = table(line_table(docs, text, doc_id, min_chars), "lines")
    ranged = lines.repartitionByRange(partitions(docs.sparkSession), *KEY, "doc", *ROW).sortWithinPartitions(*KEY, "doc", *ROW, "pos")
    # ``first`` depends on the order, so the sort stays; a struct is aggregated over the sorted stream, not in a hash table.
    # The range partitioning serves this grouping as it is.
    first = ranged.groupBy(*KEY, "doc", *ROW).agg(F.first(F.struct("pos")).alias("at"))
    keys = first.groupBy(*KEY).agg(F.count("*").alias("n"), F.min(F.struct("doc", *ROW, "at.pos")).alias("first"))
    # Written, so that the join below sees two plain exchanges and AQE may split a hot key's partition.
    keys = table(keys.where(F.col("n") >= min_docs).select(*KEY, "first"), "keys")
    drop = lines.join(keys, KEY)
    if keep_first:
        drop = drop.where(~F.struct("doc", *ROW, "pos").eqNullSafe(F.col("first")))
    gone = drop.groupBy(*ROW).agg(F.array_sort(F.collect_set("pos")).alias("gone"))
    runs = F.transform("gone", lambda x, i: F.array(x - F.coalesce(F.get("gone", i - 1), F.lit(-1)) - 1, F.lit(1)))
    return gone.select(*ROW, F.flatten(runs).alias("runs"))


def kept_lines(text: Column, runs: Column) -> Column:
    """The lines of a text that its bitmap keeps; a null bitmap keeps all."""
    bits = F.flatten(F.transform(runs, lambda n, i: F.array_repeat(i % 2 == 1, n)))
    lines = split_lines(text)
    kept = F.filter(F.zip_with(lines, bits, lambda x, b: F.when(~F.coalesce(b, F.lit(False)), x)), lambda x: x.isNotNull())
    return F.when(runs.isNull(), lines).otherwise(kept)


def dropped_count(runs: Column) -> Column:
    """How many lines a bitmap drops: the sum of its odd runs."""
    return F.coalesce(F.aggregate(F.filter(runs, lambda n, i: i % 2 == 1), F.lit(0).cast("bigint"), lambda a, n: a + n), F.lit(0).cast("bigint"))


def with_bitmaps(docs: DataFrame, bitmaps: DataFrame, *, text: str = "text", doc_id: str = "doc_id", to: str = "runs") -> DataFrame:
    """``docs`` with their bitmap in the column ``to``, which replaces one of that name. The bitmaps are the side that is
    hashed, so that whole texts are moved but not sorted: a partition's bitmaps hold two integers for each run of lines
    dropped in it, a small part of its texts."""
    docs = docs.drop(to)
    inner = docs.select(F.struct(*docs.columns).alias("_doc"), *row_key(F.col(doc_id), F.col(text)))
    joined = inner.join(bitmaps.hint("shuffle_hash"), ROW, "left")
    return joined.select("_doc.*", F.col("runs").alias(to))


def drop_lines(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", n_chars: str | None = "n_chars", **how) -> DataFrame:
    """``docs`` with the lines of ``line_bitmaps`` taken out of their texts; all columns stay, in order. The column
    ``n_chars``, if there is one, is counted again. A null text stays null. A text that loses all lines is empty."""
    runs = "_lamella_runs"
    out = with_bitmaps(docs, line_bitmaps(docs, text=text, doc_id=doc_id, **how), text=text, doc_id=doc_id, to=runs)
    out = out.withColumn(text, F.when(F.col(runs).isNull(), F.col(text)).otherwise(F.array_join(kept_lines(F.col(text), F.col(runs)), "\n"))).drop(runs)
    if n_chars in docs.columns:
        out = out.withColumn(n_chars, F.coalesce(F.char_length(text), F.lit(0)).cast(docs.schema[n_chars].dataType))
    return out

"""Building nested records from flat tables, and walking them back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.functions.arrays import gather


def nest(parent: DataFrame, child: DataFrame, *, key: str, child_key: str, order: list[str], fields: list[str], to: str, keep_empty: bool = True, spread: bool = False) -> DataFrame:
    """``parent`` with its children as one ordered list in column ``to``. A parent without children has a null list
    (``keep_empty``) or no row. Children are grouped before the join, so each parent row meets one row, and the join can
    use the partitioning by key that grouping gave the lists; where they are small, Spark sends them to the parents. With
    ``spread`` they stay dealt out by key whatever their size, so that costly work on them runs in as many tasks."""
    lists = child.groupBy(F.col(child_key).alias(key)).agg(gather(order, fields).alias(to))
    return parent.join(lists.hint("merge") if spread else lists, key, "left" if keep_empty else "inner")


def walk(df: DataFrame, column: str, *, keep: list[str]) -> DataFrame:
    """Every element of a list with its position; a null or empty list gives one row with nulls."""
    return df.select(*keep, F.posexplode_outer(column).alias("pos", "element"))

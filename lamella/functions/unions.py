"""Tagged unions: ``struct<tag, A, B, ...>`` with at most one branch set. An unknown member keeps its tag alone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lamella.model import Union, spark_type


def encode(u: Union, cases: list[tuple[str, Column, Column]], *, otherwise_error: bool = True) -> Column:
    """A union value from (member, condition, record) cases, tried in order, most derived first. A row that no case
    takes is an error, or null."""
    kinds = spark_type(u)
    tag = None
    for name, when, _ in cases:
        t = F.lit(u.tag_of(name)).cast("bigint")
        tag = F.when(when, t) if tag is None else tag.when(when, t)
    if otherwise_error:
        tag = tag.otherwise(F.raise_error("value of a type that the union doesn't hold").cast("bigint"))
    branch = {name: (when, value) for name, when, value in reversed(cases)}
    fields = [tag.alias("tag")]
    for m in u.members:
        none = F.lit(None).cast(kinds[m.name].dataType)
        if m.name in branch:
            mine = u.tag_of(m.name)
            fields.append(F.when(tag == mine, branch[m.name][1].cast(kinds[m.name].dataType)).otherwise(none).alias(m.name))
        else:
            fields.append(none.alias(m.name))
    out = F.struct(*fields)
    return out if otherwise_error else F.when(tag.isNotNull(), out)


def tag(u: Column) -> Column:
    """The tag; 0 for an absent union."""
    return F.coalesce(u["tag"], F.lit(0)).cast("bigint")


def is_member(u: Column, model: Union, name: str) -> Column:
    return F.coalesce(u["tag"] == model.tag_of(name), F.lit(False))


def as_member(u: Column, model: Union, name: str) -> Column:
    """The record, if it is of this type, else null."""
    return F.when(u["tag"] == model.tag_of(name), u[name])


def restrict(u: Column, model: Union, to: Union) -> Column:
    """A union read with fewer (or other) members: an unknown tag stays, its record goes."""
    mine = {m.name for m in model.members}
    kinds = spark_type(to)
    parts = [F.when(u["tag"] == to.tag_of(m.name), u[m.name]) if m.name in mine else F.lit(None) for m in to.members]
    return F.when(u.isNotNull(), F.struct(u["tag"].alias("tag"), *(p.cast(kinds[m.name].dataType).alias(m.name) for p, m in zip(parts, to.members))))

"""Buffers as DataFrame columns and files."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamella.functions.text import value_json
from lamella.model import Kind, Obj, Scalar, Struct, Text, Type, Union, Vec, reachable, spark_type
from lamella.sources import codec
from lamella.sources.columns import Column, NotPlain


def holds_unsigned_64(root: Obj) -> bool:
    """Whether a value below is a decimal in Spark; all others have one Python form on both sides."""

    def here(t: Type) -> bool:
        if isinstance(t, Struct):
            return any(here(f) for _, f in t.fields)
        return t.kind is Kind.UINT64

    parts = []
    for t in reachable(root):
        parts += [m.type for m in t.all_members] if isinstance(t, Obj) else [t.element] if isinstance(t, Vec) else [t] if isinstance(t, Struct) else []
    return any(here(t) for t in parts)


def from_row(t: Type, v: object) -> object:
    """A Spark value (wire form, as Arrow gives it) as the codec takes it."""
    if v is None or isinstance(t, Text):
        return v
    if isinstance(t, Scalar):
        return int(v) if isinstance(v, Decimal) else v
    if isinstance(t, Struct):
        return {n: from_row(f, v[n]) for n, f in t.fields}
    if isinstance(t, Vec):
        return [from_row(t.element, x) for x in v]
    if isinstance(t, Union):
        m = t.tags.get(v["tag"])
        return {"tag": v["tag"]} | ({m.name: from_row(m, v[m.name])} if m else {})
    return {m.name: from_row(m.type, v.get(m.name)) for m in t.all_members}


def to_row(t: Type, kind: T.DataType, v: object) -> object:
    """A decoded value in the shape of its Spark type; TooDeep where the type leaves out a level that the value has."""
    if v is None or isinstance(t, Text):
        return v
    if isinstance(t, Scalar):
        return Decimal(v) if t.kind is Kind.UINT64 else v
    if isinstance(t, Struct):
        return {n: to_row(f, kind[n].dataType, v[n]) for n, f in t.fields}
    if isinstance(t, Vec):
        return [to_row(t.element, kind.elementType, x) for x in v]
    names = set(kind.names)
    if any(x is not None and n not in names and (isinstance(t, Obj) or n != "tag") for n, x in v.items()):
        raise codec.ReadError("TooDeep")
    if isinstance(t, Union):
        return {f.name: v["tag"] if f.name == "tag" else to_row(t.tags[t.tag_of(f.name)], f.dataType, v.get(f.name)) for f in kind.fields}
    return {f.name: to_row(t.member(f.name).type, f.dataType, v.get(f.name)) for f in kind.fields}


def cuts(t: Type, kind: T.DataType) -> bool:
    """Whether a record that holds itself is cut off below some level of the type."""
    if isinstance(t, Vec):
        return cuts(t.element, kind.elementType)
    if isinstance(t, Union):
        return len(kind.fields) <= len(t.members) or any(cuts(m, kind[m.name].dataType) for m in t.members)
    if isinstance(t, Obj):
        return len(kind.fields) < len(t.all_members) or any(cuts(m.type, kind[m.name].dataType) for m in t.all_members)
    return False


def relaxed(kind: T.DataType) -> T.DataType:
    """The type with everything nullable and without metadata, as Arrow results come back."""
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, relaxed(f.dataType)) for f in kind.fields])
    return T.ArrayType(relaxed(kind.elementType)) if isinstance(kind, T.ArrayType) else kind


def encoded(root: Obj, record: Column, options: codec.WriteOptions = codec.WriteOptions()) -> Column:
    """A struct column in wire form as buffers; one writer per task. Null stays null."""

    convert = holds_unsigned_64(root)

    @F.arrow_udf("binary")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        writer = codec.Writer(options)
        for a in batches:
            parts = []
            for rows in _slices(a):
                if convert:
                    rows = [from_row(root, v) for v in rows]
                parts.append(pa.array([None if v is None else writer.write(root, v) for v in rows], pa.binary()))
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.binary())

    return run(record)


def decoded(root: Obj, buffer: Column, options: codec.ReadOptions = codec.ReadOptions(), *, strict: bool = False, depth: int = 8) -> Column:
    """Buffers as ``struct<value, error>``: the record in wire form, or the code of what is wrong. With ``strict`` the
    first damaged buffer fails the query. A null buffer has neither. A column's type has a fixed depth: of a model that
    holds itself, ``depth`` levels; a buffer with more of them has the error TooDeep (``buffer_json`` reads any)."""
    kind = relaxed(spark_type(root, depth))
    convert = holds_unsigned_64(root) or cuts(root, kind)
    both = T.StructType([T.StructField("value", kind), T.StructField("error", T.StringType())])

    def one(b: bytes) -> tuple[object, str | None]:
        try:
            v = codec.decode(root, b, options)
            return to_row(root, kind, v) if convert else v, None
        except codec.ReadError as e:
            if strict:
                raise
            return None, e.code

    @F.arrow_udf(both)
    def run(a: pa.Array) -> pa.Array:
        from pyspark.sql.pandas.types import to_arrow_type

        made = to_arrow_type(both)
        if not cuts(root, kind):
            try:
                column = Column(root, a, options)
                whole = column.read(made.field("value").type)
            except NotPlain:
                column = None
            if column is not None:
                return _joined(made, a, column.fine, whole, one)
        parts = []
        for rows in _slices(a):
            found = [(None, None) if b is None else one(b) for b in rows]
            parts.append(pa.array([{"value": v, "error": error} for v, error in found], made))
        return pa.concat_arrays(parts) if parts else pa.array([], made)

    return run(buffer)


def _joined(made: pa.DataType, a: pa.Array, fine: np.ndarray, whole: pa.Array, one: Callable) -> pa.Array:
    """Results of a column: those read together, and the others one by one."""
    value, error = made.field("value").type, made.field("error").type
    if fine.all():
        return pa.StructArray.from_arrays([whole, pa.nulls(len(a), error)], fields=list(made))
    rest = np.flatnonzero(~fine)
    found = [(None, None) if (b := a[i].as_py()) is None else one(b) for i in rest.tolist()]
    both = pa.concat_arrays([whole, pa.array([v for v, _ in found], value)])
    order = np.empty(len(a), np.int64)
    order[fine], order[rest] = np.arange(len(whole)), len(whole) + np.arange(len(rest))
    errors = np.full(len(a), None, object)
    errors[rest] = [code for _, code in found]
    return pa.StructArray.from_arrays([both.take(pa.array(order)), pa.array(errors, error)], fields=list(made))


#: Values that Python holds as objects at a time; Arrow batches may be larger.
SLICE = 1024


def _slices(a: pa.Array) -> Iterator[list]:
    for i in range(0, len(a), SLICE):
        yield a.slice(i, SLICE).to_pylist()


def member(root: Obj, buffer: Column, path: str, options: codec.ReadOptions = codec.ReadOptions()) -> Column:
    """One member of each buffer, by a dotted path of names, read in place: nothing beside it is decoded. A list on the
    way gives a list. Null where it is absent or the buffer can't be read."""
    names = path.split(".")
    t = codec.path_type(root, names)
    kind = relaxed(spark_type(t))

    @F.arrow_udf(kind)
    def run(a: pa.Array) -> pa.Array:
        from pyspark.sql.pandas.types import to_arrow_type

        made, parts = to_arrow_type(kind), []
        for rows in _slices(a):
            out = []
            for b in rows:
                try:
                    out.append(None if b is None else to_row(t, kind, codec.read_path(root, b, names, options)))
                except codec.ReadError:
                    out.append(None)
            parts.append(pa.array(out, made))
        return pa.concat_arrays(parts) if parts else pa.array([], made)

    return run(buffer)


def schema_section(buffer: Column) -> Column:
    """What the schema section of each buffer holds: ``struct<entries, members, error>``; BadSchema if it doesn't parse,
    all null for a buffer without one."""

    @F.arrow_udf("struct<entries:bigint,members:bigint,error:string>")
    def run(a: pa.Array) -> pa.Array:
        out = []
        for b in a.to_pylist():
            try:
                _, has, _ = codec.open_header(b or b"")
                s = codec.parse_schema(b[codec.HEADER :]) if has else None
                out.append((len(s.entries), sum(e.count for e in s.entries), None) if s else (None, None, None))
            except codec.ReadError as e:
                out.append((None, None, e.code if b is not None else None))
        cols = list(zip(*out)) or [()] * 3
        kinds = (pa.int64(), pa.int64(), pa.string())
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["entries", "members", "error"])

    return run(buffer)


def checked(root: Obj, buffer: Column, options: codec.ReadOptions = codec.ReadOptions()) -> Column:
    """The error code of each buffer, null if it can be read."""

    @F.arrow_udf("string")
    def run(a: pa.Array) -> pa.Array:
        out = np.full(len(a), None, object)
        for i in np.flatnonzero(~Column(root, a, options).fine).tolist():
            b = a[i].as_py()
            out[i] = None if b is None else codec.verify(root, b, options)
        return pa.array(out, pa.string())

    return run(buffer)


def buffer_json(root: Obj, buffer: Column) -> Column:
    """Canonical JSON of each buffer; null for one that can't be read. Records of any depth."""

    @F.arrow_udf("string")
    def run(a: pa.Array) -> pa.Array:
        out = []
        for b in a.to_pylist():
            v, error = (None, "") if b is None else codec.try_decode(root, b)
            out.append(None if error is not None else value_json(root, v))
        return pa.array(out, pa.string())

    return run(buffer)


def header(buffer: Column) -> Column:
    """Header fields by expressions alone: root offset, version, has_schema; null for anything shorter."""
    byte = lambda i: F.conv(F.hex(F.substring(buffer, i + 1, 1)), 16, 10).cast("bigint")
    root = byte(0) + byte(1) * 256 + byte(2) * 65536 + byte(3) * 16777216
    return F.when(F.octet_length(buffer) >= codec.HEADER, F.struct(root.alias("root"), byte(6).alias("version"), (byte(7) % 2 == 1).alias("has_schema")))


def read_files(spark: SparkSession, path: str, root: Obj, options: codec.ReadOptions = codec.ReadOptions(), *, depth: int = 8) -> DataFrame:
    """One row per file below ``path``, whose content is a buffer: path, value, error (see ``decoded``)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", decoded(root, F.col("content"), options, depth=depth).alias("_d")).select("path", "_d.*")


def write_table(df: DataFrame, root: Obj, path: str, *, key: str | None = None, options: codec.WriteOptions = codec.WriteOptions()) -> None:
    """Rows in wire form as a Parquet table of buffers: key (if named) and content."""
    record = F.struct(*(F.col(f.name) for f in spark_type(root).fields))
    df.select(*([F.col(key)] if key else []), encoded(root, record, options).alias("content")).write.parquet(path)

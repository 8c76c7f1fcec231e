"""Canonical JSON, UTF-8, naming and flags."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamella.model import Kind, Obj, Scalar, Struct, Text, Type, Union, Vec


def float_text(x: float, single: bool) -> str:
    """The shortest decimal that reads back as the same number, without a needless fraction; NaN and infinities as
    quoted names."""
    if x != x:
        return '"NaN"'
    if x in (float("inf"), float("-inf")):
        return '"Infinity"' if x > 0 else '"-Infinity"'
    v = np.float32(x) if single else np.float64(x)
    plain = np.format_float_positional(v, unique=True, trim="-")
    short = re.sub(r"e([+-])(\d)$", r"e\g<1>0\2", np.format_float_scientific(v, unique=True, trim="-", exp_digits=2))
    return plain if len(plain) <= len(short) else short


def floats_as_text(c: Column, single: bool = False) -> Column:
    """``float_text`` of a column, Arrow batches at a time."""

    @F.arrow_udf("string")
    def run(a: pa.Array) -> pa.Array:
        return pa.array([None if x is None else float_text(x, single) for x in a.to_pylist()], pa.string())

    return run(c)


#: Characters with an escape of their own.
_ESCAPES = {'"': '\\"', "\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t"}
_CONTROL = [chr(i) for i in range(32)]


def quoted(c: Column) -> Column:
    """A JSON string: quotes, backslashes and control characters escaped, nothing else."""
    plain = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    every = plain
    for ch in _CONTROL:
        every = F.replace(every, F.lit(ch), F.lit(_ESCAPES.get(ch, f"\\u{ord(ch):04x}")))
    body = F.when(F.rlike(c, F.lit("[\\x00-\\x1f]")), every).otherwise(plain)
    return F.concat(F.lit('"'), body, F.lit('"'))


def canonical_json(t: Type, c: Column) -> Column:
    """Canonical JSON of a value in wire form: stored members only, in name order; null elements as null; unions as
    ``$type`` and ``$value``; chars, enums and bytes as numbers. Integers and texts stay in the JVM."""
    return F.coalesce(_json(t, c), F.lit("null"))


def _json(t: Type, c: Column) -> Column:
    if isinstance(t, Text):
        return quoted(c)
    if isinstance(t, Scalar):
        if t.kind in (Kind.FLOAT32, Kind.FLOAT64):
            return floats_as_text(c, t.kind is Kind.FLOAT32)
        return c.cast("string")
    if isinstance(t, Vec):
        if _holds_floats(t.element):
            return _json_by_schema(t, c)
        return F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: F.coalesce(_json(t.element, x), F.lit("null"))), ","), F.lit("]"))
    if isinstance(t, Union):
        out = None
        for m in t.members:
            value = F.concat(F.lit('{"$type":'), F.lit(f'"{m.name}"'), F.lit(',"$value":'), _json(m, c[m.name]), F.lit("}"))
            out = F.when(c["tag"] == t.tag_of(m.name), value) if out is None else out.when(c["tag"] == t.tag_of(m.name), value)
        return out
    names = sorted(t.fields, key=lambda p: p[0]) if isinstance(t, Struct) else sorted(((m.wire_name, m) for m in t.all_members), key=lambda p: p[0])
    parts = []
    for name, m in names:
        kind, own = (m, name) if isinstance(t, Struct) else (m.type, m.name)
        value = _json(kind, c[own])
        parts.append(F.when(value.isNotNull(), F.concat(F.lit(f'"{name}":'), value)))
    body = F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
    return F.when(c.isNotNull(), body)


def _holds_floats(t: Type) -> bool:
    """Whether a list's elements need the float formatter, which can't run inside a lambda."""
    if isinstance(t, Scalar):
        return t.kind in (Kind.FLOAT32, Kind.FLOAT64)
    if isinstance(t, Vec):
        return _holds_floats(t.element)
    if isinstance(t, Union):
        return any(_holds_floats(m) for m in t.members)
    if isinstance(t, Struct):
        return any(_holds_floats(f) for _, f in t.fields)
    return isinstance(t, Obj) and any(_holds_floats(m.type) for m in t.all_members)


def value_json(t: Type, v: object) -> str:
    """Canonical JSON of one decoded value."""
    if v is None:
        return "null"
    if isinstance(t, Text):
        return '"' + "".join(_ESCAPES.get(ch) or (f"\\u{ord(ch):04x}" if ord(ch) < 32 else ch) for ch in v) + '"'
    if isinstance(t, Scalar):
        if t.kind in (Kind.FLOAT32, Kind.FLOAT64):
            return float_text(v, t.kind is Kind.FLOAT32)
        return str(v).lower() if t.kind is Kind.BOOL else str(int(v))
    if isinstance(t, Vec):
        return "[" + ",".join(value_json(t.element, x) for x in v) + "]"
    if isinstance(t, Union):
        m = t.tags.get(v["tag"])
        return "null" if m is None or v.get(m.name) is None else f'{{"$type":"{m.name}","$value":{value_json(m, v[m.name])}}}'
    if isinstance(t, Struct):
        return "{" + ",".join(f'"{n}":{value_json(f, v[n])}' for n, f in sorted(t.fields, key=lambda p: p[0])) + "}"
    stored = sorted(((m.wire_name, m) for m in t.all_members if v.get(m.name) is not None), key=lambda p: p[0])
    return "{" + ",".join(f'"{n}":{value_json(m.type, v[m.name])}' for n, m in stored) + "}"


def _json_by_schema(t: Type, c: Column) -> Column:
    @F.arrow_udf("string")
    def run(a: pa.Array) -> pa.Array:
        return pa.array([None if v is None else value_json(t, v) for v in a.to_pylist()], pa.string())

    return run(c)


# ---- UTF-8, names, flags ----------------------------------------------------------------------------------------


def utf8(c: Column) -> Column:
    """A text's UTF-8 bytes."""
    return F.encode(c, "UTF-8")


def is_valid_utf8(c: Column) -> Column:
    """Whether bytes are valid UTF-8."""
    return F.is_valid_utf8(c.cast(T.StringType()))


def repaired_utf8(c: Column) -> Column:
    """Bytes as text, what isn't valid UTF-8 as U+FFFD."""
    return F.make_valid_utf8(c.cast(T.StringType()))


def has_flag(c: Column, flag: int) -> Column:
    """Whether all bits of a flag are set."""
    return c.bitwiseAND(F.lit(flag)) == flag


def identifier(name: str, style: str) -> str:
    """An identifier in snake, camel, pascal or original style. Snake keeps acronyms together; camel and pascal change
    the first letter only. Underscores around the name go."""
    core = name.strip("_") or "value"
    if style == "snake":
        return re.sub(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", "_", core).lower()
    if style == "camel":
        return core[0].lower() + core[1:]
    return core[0].upper() + core[1:] if style == "pascal" else name

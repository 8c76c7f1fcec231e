"""Record models: types, wire names, declared defaults, and the Spark schema they stand for.

A model is built from plain Python values. ``Obj`` is a record whose members may be absent; ``Struct`` is a fixed-size
value; ``Vec`` a list; ``Dict`` a sorted dictionary kept as two lists; ``Union`` a tagged choice of records. What the
builder can't represent it rejects with a ``ModelError`` that names its code.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from enum import IntEnum
from functools import cached_property

import xxhash
from pyspark.sql import types as T


class Kind(IntEnum):
    """Wire kinds. Fixed values of the format."""

    BOOL = 1
    INT8 = 2
    UINT8 = 3
    INT16 = 4
    UINT16 = 5
    INT32 = 6
    UINT32 = 7
    INT64 = 8
    UINT64 = 9
    FLOAT32 = 10
    FLOAT64 = 11
    CHAR16 = 12
    STRUCT = 13
    STRING = 14
    OBJECT = 15
    VECTOR = 16
    UNION = 17
    SHARED = 18


#: Bytes of a cell and the pack code, by kind. Fixed values of the format.
SIZE = {Kind.BOOL: 0, Kind.INT8: 1, Kind.UINT8: 1, Kind.INT16: 2, Kind.UINT16: 2, Kind.INT32: 4, Kind.UINT32: 4, Kind.INT64: 8, Kind.UINT64: 8, Kind.FLOAT32: 4, Kind.FLOAT64: 8, Kind.CHAR16: 2, Kind.STRING: 4, Kind.OBJECT: 4, Kind.VECTOR: 4, Kind.UNION: 8, Kind.SHARED: 4}
PACK = {Kind.BOOL: "?", Kind.INT8: "b", Kind.UINT8: "B", Kind.INT16: "h", Kind.UINT16: "H", Kind.INT32: "i", Kind.UINT32: "I", Kind.INT64: "q", Kind.UINT64: "Q", Kind.FLOAT32: "f", Kind.FLOAT64: "d", Kind.CHAR16: "H"}
REFERENCES = frozenset({Kind.STRING, Kind.OBJECT, Kind.VECTOR, Kind.UNION, Kind.SHARED})
MAX_MEMBERS, MAX_FIXED_BYTES, MAX_STRUCT_BYTES = 4096, 1024, 65535

_SPARK = {Kind.BOOL: T.BooleanType(), Kind.INT8: T.ByteType(), Kind.UINT8: T.ShortType(), Kind.INT16: T.ShortType(), Kind.UINT16: T.IntegerType(), Kind.INT32: T.IntegerType(), Kind.UINT32: T.LongType(), Kind.INT64: T.LongType(), Kind.UINT64: T.DecimalType(20, 0), Kind.FLOAT32: T.FloatType(), Kind.FLOAT64: T.DoubleType(), Kind.CHAR16: T.IntegerType(), Kind.STRING: T.StringType()}


class ModelError(ValueError):
    """A model that can't be represented. ``code`` says why."""

    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code = code


def name_hash(name: str) -> int:
    """xxHash64, seed 0, of a wire name."""
    return xxhash.xxh64_intdigest(name.encode("utf-8"), seed=0)


def type_id(name: str) -> int:
    """xxHash32, seed 0, of a type's stable name; also its union tag."""
    return xxhash.xxh32_intdigest(name.encode("utf-8"), seed=0)


@dataclass(frozen=True, eq=False)
class Type:
    """Base of all types. ``nullable`` marks a value type that may be null."""

    @property
    def kind(self) -> Kind:
        raise NotImplementedError

    @property
    def is_reference(self) -> bool:
        return self.kind in REFERENCES


@dataclass(frozen=True, eq=False)
class Scalar(Type):
    code: Kind
    nullable: bool = False
    #: Names of an enum's values; the value itself is stored.
    names: tuple[tuple[str, int], ...] = ()

    def __post_init__(self):
        if self.code not in PACK:
            raise ModelError("unsupported-type", f"{self.code!r} isn't a scalar kind")

    @property
    def kind(self) -> Kind:
        return self.code


@dataclass(frozen=True, eq=False)
class Text(Type):
    @property
    def kind(self) -> Kind:
        return Kind.STRING


@dataclass(frozen=True, eq=False)
class Struct(Type):
    """A fixed-size value with C layout: fields at their natural alignment (at most ``pack``, if given)."""

    name: str
    fields: tuple[tuple[str, Type], ...]
    shared: bool = False
    nullable: bool = False
    pack: int = 0

    def __post_init__(self):
        for name, t in self.fields:
            if not isinstance(t, Scalar | Struct) or t.nullable or (isinstance(t, Struct) and t.shared):
                raise ModelError("struct-field", f"{self.name}.{name}: a struct holds plain scalars and structs only")
        if len({n for n, _ in self.fields}) != len(self.fields):
            raise ModelError("duplicate-member", f"{self.name} has two fields of one name")
        if not self.fields:
            raise ModelError("empty-struct", f"{self.name} has no fields")
        if self.size > MAX_STRUCT_BYTES:
            raise ModelError("struct-too-large", f"{self.name} has {self.size} bytes")

    @property
    def kind(self) -> Kind:
        return Kind.SHARED if self.shared else Kind.STRUCT

    @cached_property
    def layout(self) -> tuple[tuple[tuple[str, Type, int], ...], int, int]:
        """((name, type, offset) of each field, size, alignment)."""
        at, most, placed = 0, 1, []
        for name, t in self.fields:
            size, align = (t.size, t.align) if isinstance(t, Struct) else (max(1, SIZE[t.kind]),) * 2
            align = min(align, self.pack) if self.pack else align
            at = -(-at // align) * align
            placed.append((name, t, at))
            at, most = at + size, max(most, align)
        return tuple(placed), -(-at // most) * most, most

    @property
    def size(self) -> int:
        return self.layout[1]

    @property
    def align(self) -> int:
        return self.layout[2]

    def shape(self) -> bytes:
        """What its fingerprint is made of."""
        placed, size, align = self.layout
        out = size.to_bytes(2, "little") + bytes([align]) + len(placed).to_bytes(2, "little")
        for name, t, at in placed:
            out += name_hash(name).to_bytes(8, "little") + bytes([t.kind]) + at.to_bytes(2, "little")
            if isinstance(t, Struct):
                out += t.shape()
        return out


@dataclass(frozen=True, eq=False)
class Vec(Type):
    """A list. Elements that are references may be null; nullable scalars and structs make an optional list."""

    element: Type

    @property
    def kind(self) -> Kind:
        return Kind.VECTOR

    @property
    def optional(self) -> bool:
        return not self.element.is_reference and bool(getattr(self.element, "nullable", False))


@dataclass(frozen=True)
class Member:
    name: str
    type: Type
    wire: str = ""
    default: object = None
    keep: bool = False  # always stored, also when it equals its default

    @property
    def wire_name(self) -> str:
        return self.wire or self.name

    @property
    def default_value(self) -> object:
        """The value that isn't stored: the declared one, else zero; None for what may be null."""
        t = self.type
        if t.is_reference or getattr(t, "nullable", False):
            return None
        if isinstance(t, Struct):
            return zero(t)
        return self.default if self.default is not None else zero(t)


def zero(t: Type) -> object:
    if isinstance(t, Struct):
        return {n: zero(f) for n, f in t.fields}
    return {Kind.BOOL: False, Kind.FLOAT32: 0.0, Kind.FLOAT64: 0.0}.get(t.kind, 0)


@dataclass(frozen=True, eq=False)
class Obj(Type):
    """A record. ``name`` is its stable name. Members may be given later with ``define``, for records that hold
    themselves. ``base`` members come first."""

    name: str
    members: tuple[Member, ...] = ()
    base: Obj | None = None
    dictionary: bool = False
    _late: list = field(default_factory=list, repr=False)

    def __post_init__(self):
        if self.members:
            self._check(self.members)

    def define(self, *members: Member) -> Obj:
        self._check(members)
        self._late[:] = members
        return self

    def _check(self, members: Sequence[Member]) -> None:
        every = [*(self.base.all_members if self.base else ()), *members]
        if len(every) > MAX_MEMBERS:
            raise ModelError("too-many-members", f"{self.name} has {len(every)} members")
        seen: dict[int, str] = {}
        for m in every:
            if m.wire_name in seen.values():
                raise ModelError("duplicate-member", f"{self.name} has two members named {m.wire_name}")
            if (h := name_hash(m.wire_name)) in seen:
                raise ModelError("name-collision", f"{self.name}: {m.wire_name} and {seen[h]} have one hash")
            seen[h] = m.wire_name
            if m.default is not None and not isinstance(m.type, Scalar):
                raise ModelError("default-type", f"{self.name}.{m.name}: only scalars have declared defaults")
            if isinstance(m.type, Vec) and isinstance(m.type.element, Obj | Union | Text) and getattr(m.type.element, "nullable", False):
                raise ModelError("unsupported-type", f"{self.name}.{m.name}")

    @property
    def kind(self) -> Kind:
        return Kind.OBJECT

    @property
    def all_members(self) -> tuple[Member, ...]:
        return (*(self.base.all_members if self.base else ()), *(self._late or self.members))

    def member(self, name: str) -> Member:
        return next(m for m in self.all_members if m.name == name)


def dictionary(key: Type, value: Type, name: str = "") -> Obj:
    """A dictionary: a record of two lists, Keys ascending and Values in the same order. Keys are integers, chars,
    enums or strings."""
    if not (isinstance(key, Text) or (isinstance(key, Scalar) and not key.nullable and key.code not in (Kind.BOOL, Kind.FLOAT32, Kind.FLOAT64))):
        raise ModelError("dictionary-key", "keys are integers, chars, enums or strings")
    return Obj(name or f"Dictionary<{key.kind.name},{value.kind.name}>", (Member("keys", Vec(key), "Keys"), Member("values", Vec(value), "Values")), dictionary=True)


@dataclass(frozen=True, eq=False)
class Union(Type):
    """A choice of records, told apart by tag. The first match of ``members`` in order is the most derived one."""

    name: str
    members: tuple[Obj, ...]

    def __post_init__(self):
        if not self.members:
            raise ModelError("no-union-members", self.name)
        tags: dict[int, str] = {}
        for m in self.members:
            tag = type_id(m.name)
            if tag == 0:
                raise ModelError("zero-union-tag", m.name)
            if tag in tags:
                raise ModelError("union-tag-collision", f"{m.name} and {tags[tag]} in {self.name}")
            tags[tag] = m.name

    @property
    def kind(self) -> Kind:
        return Kind.UNION

    @cached_property
    def tags(self) -> dict[int, Obj]:
        """Members by tag, ascending."""
        return dict(sorted((type_id(m.name), m) for m in self.members))

    def tag_of(self, name: str) -> int:
        return next(t for t, m in self.tags.items() if m.name == name)


#: Member types that have no place in a model, by the name a user may give. Fixed values.
UNSUPPORTED = frozenset({"nint", "nuint", "decimal", "datetime", "timespan", "datetimeoffset", "guid", "half", "int128", "uint128", "object", "delegate", "array2d"})


def scalar(code: str | Kind, **how) -> Scalar:
    """A scalar by name (``int32``, ``float64``, ``bool``, ``char16`` ...)."""
    if isinstance(code, str):
        if code.lower() in UNSUPPORTED:
            raise ModelError("unsupported-type", code)
        try:
            code = Kind[code.upper()]
        except KeyError:
            raise ModelError("unsupported-type", str(code)) from None
    return Scalar(code, **how)


# ---- layout -----------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Cell:
    member: Member
    size: int
    align: int
    at: int  # fixed cells: offset behind the header words; others: presence bit


class Layout:
    """Where a record's members lie: fixed cells, cells, then bools."""

    def __init__(self, o: Obj):
        fixed, cells, bools = [], [], []
        for m in o.all_members:
            t = m.type
            if t.kind is Kind.BOOL:
                bools.append(Cell(m, 0, 1, 0))
                continue
            size, align = (t.size, t.align) if t.kind is Kind.STRUCT else (SIZE[t.kind], 4 if t.kind is Kind.UNION else SIZE[t.kind])
            keep = m.keep and not getattr(t, "nullable", False) and (t.kind is Kind.STRUCT or t.kind in PACK)
            (fixed if keep else cells).append(Cell(m, size, align, 0))
        order = lambda c: (-c.align, c.size, name_hash(c.member.wire_name), c.member.wire_name)
        self.fixed: list[Cell] = []
        end = 0
        for c in sorted(fixed, key=order):
            if end + c.size > MAX_FIXED_BYTES:
                cells.append(c)
                continue
            self.fixed.append(Cell(c.member, c.size, c.align, end))
            end += c.size
        self.cells = [Cell(c.member, c.size, c.align, i) for i, c in enumerate(sorted(cells, key=order))]
        start = len(self.cells) + len(self.cells) % 2
        bools.sort(key=lambda c: (name_hash(c.member.wire_name), c.member.wire_name))
        self.bools = [Cell(c.member, 0, 1, start + 2 * i) for i, c in enumerate(bools)]
        pad = max((c.align for c in self.cells), default=1)
        self.fixed_size = -(-end // pad) * pad
        self.words = max(1, -(-(start + 2 * len(self.bools)) // 32))
        self.align = max((c.align for c in (*self.fixed, *self.cells)), default=1)

    @property
    def order(self) -> list[Cell]:
        """Every member in wire order."""
        return [*self.fixed, *self.cells, *self.bools]


_LAYOUTS: dict[int, tuple[Obj, Layout]] = {}


def layout(o: Obj) -> Layout:
    found = _LAYOUTS.get(id(o))
    if not found:
        found = _LAYOUTS[id(o)] = (o, Layout(o))
    return found[1]


# ---- fingerprints -----------------------------------------------------------------------------------------------

#: Categories of schema entries. Fixed values of the format.
OBJECT, STRUCT, VECTOR, UNION = 1, 2, 3, 4
CATEGORY = {Kind.OBJECT: OBJECT, Kind.STRUCT: STRUCT, Kind.SHARED: STRUCT, Kind.VECTOR: VECTOR, Kind.UNION: UNION}


def entry(t: Type) -> Type | None:
    """The type itself if it has a schema entry; scalars and strings have none."""
    return t if t.kind in CATEGORY else None


def children(t: Type) -> Iterator[Type]:
    """Types with entries that an entry refers to, in a fixed order."""
    if isinstance(t, Obj):
        found = (c.member.type for c in layout(t).order)
    elif isinstance(t, Vec):
        found = iter((t.element,))
    elif isinstance(t, Union):
        found = iter(t.tags.values())
    else:
        found = iter(())
    yield from (x for x in found if entry(x))


def _shape_hash(s: Struct) -> bytes:
    return xxhash.xxh64_intdigest(s.shape(), seed=0).to_bytes(8, "little")


def own_fingerprint(t: Type) -> int:
    """A hash of the type's own layout."""
    out = bytes([CATEGORY[t.kind]])
    if isinstance(t, Obj):
        at = layout(t)
        for n in (at.words, len(at.fixed), at.fixed_size, len(at.cells), len(at.bools)):
            out += n.to_bytes(2, "little")
        for c in at.order:
            out += name_hash(c.member.wire_name).to_bytes(8, "little") + bytes([c.member.type.kind]) + c.size.to_bytes(2, "little")
            if isinstance(c.member.type, Struct):
                out += _shape_hash(c.member.type)
    elif isinstance(t, Struct):
        out += _shape_hash(t)
    elif isinstance(t, Vec):
        out += bytes([t.element.kind])
        if isinstance(t.element, Struct):
            out += _shape_hash(t.element)
        if t.optional:
            out += bytes([2])
    else:
        out += len(t.tags).to_bytes(2, "little") + b"".join(tag.to_bytes(4, "little") for tag in t.tags)
    return xxhash.xxh64_intdigest(out, seed=0)


def reachable(root: Type) -> list[Type]:
    """All types with entries below ``root``, itself first, depth first."""
    seen: dict[int, Type] = {}

    def visit(t: Type) -> None:
        if id(t) not in seen:
            seen[id(t)] = t
            for c in children(t):
                visit(c)

    visit(root)
    return list(seen.values())


def fingerprint(root: Type) -> int:
    """A hash of everything reachable: own fingerprints in depth-first order and the references between them."""
    types = reachable(root)
    number = {id(t): i for i, t in enumerate(types)}
    out = b""
    for t in types:
        out += own_fingerprint(t).to_bytes(8, "little") + b"".join(number[id(c)].to_bytes(4, "little") for c in children(t))
    return xxhash.xxh64_intdigest(out, seed=0)


# ---- Spark schema -----------------------------------------------------------------------------------------------


def spark_type(t: Type, depth: int = 8) -> T.DataType:
    """The Spark type of values in wire form. A record that holds itself is unrolled ``depth`` levels; below that its
    member is left out."""
    if isinstance(t, Scalar | Text):
        return _SPARK[t.kind]
    if isinstance(t, Struct):
        return T.StructType([T.StructField(n, spark_type(f), False) for n, f in t.fields])
    if isinstance(t, Vec):
        return T.ArrayType(spark_type(t.element, depth), t.element.is_reference or t.optional)
    if isinstance(t, Union):
        return T.StructType([T.StructField("tag", T.LongType()), *(T.StructField(m.name, spark_type(m, depth - 1)) for m in t.members if depth > 0)])
    fields = []
    for m in t.all_members:
        below = depth - 1 if entry(m.type) else depth
        if below < 0 or (below == 0 and any(x is t for x in reachable(m.type) if entry(m.type))):
            continue
        note = {"wire_name": m.wire_name, "kind": int(m.type.kind), "keep_default": m.keep}
        if isinstance(m.type, Scalar):
            note |= {"default": str(m.default_value)} if m.default_value is not None else {"nullable_value": True}
            note |= {"enum": ",".join(f"{n}={v}" for n, v in m.type.names)} if m.type.names else {}
        always = m.keep and not getattr(m.type, "nullable", False) and not m.type.is_reference
        fields.append(T.StructField(m.name, spark_type(m.type, below), not always, note))
    return T.StructType(fields)


def ddl(t: Type) -> str:
    """The schema as DDL, for export."""
    return re.sub(r"^struct<(.*)>$", r"\1", spark_type(t).simpleString())


#: Models by name: the registry that readers look roots up in.
REGISTRY: dict[str, Obj] = {}


def register(root: Obj) -> Obj:
    """Make a root known by its name. Only records can be roots."""
    if not isinstance(root, Obj) or root.dictionary:
        raise ModelError("not-a-root", getattr(root, "name", repr(root)))
    if REGISTRY.get(root.name, root) is not root:
        raise ModelError("duplicate-root", root.name)
    REGISTRY[root.name] = root
    return root

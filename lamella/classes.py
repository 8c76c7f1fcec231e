"""Record models from your own classes.

A dataclass (or any class with annotated attributes) becomes a record: members of its bases first, then its own in order,
with the defaults that the class declares. ``NamedTuple`` classes become structs, enums scalars, lists and other iterables
lists, mappings sorted dictionaries, a class with subclasses a union of all that can be made, ``A | B`` a union of those.
What can't be represented is refused with a ``ModelError``; what is merely left out is a warning, or with ``strict`` an
error too.
"""

from __future__ import annotations

import abc
import collections.abc
import dataclasses
import enum
import inspect
import types
import typing
from collections.abc import Iterator
from dataclasses import dataclass, field

from lamella.model import Kind, Member, ModelError, Obj, Scalar, Struct, Text, Type, Union, Vec, dictionary, scalar


@dataclass(frozen=True)
class Name:
    """The wire name of a member, or the stable name of a class (as ``__record_name__``)."""

    wire: str


class Keep:
    """A member that is always stored."""


class Ignore:
    """A member that is left out on purpose: no warning."""


class Shared:
    """A struct that is stored once for all equal values."""


# Scalars of a given width, for annotations.
Int8, UInt8, Int16, UInt16, Int32, UInt32, Int64, UInt64, Float32, Char16 = (
    typing.Annotated[t, k]
    for t, k in ((int, Kind.INT8), (int, Kind.UINT8), (int, Kind.INT16), (int, Kind.UINT16), (int, Kind.INT32), (int, Kind.UINT32), (int, Kind.INT64), (int, Kind.UINT64), (float, Kind.FLOAT32), (int, Kind.CHAR16))
)

_PLAIN = {int: Kind.INT64, float: Kind.FLOAT64, bool: Kind.BOOL}
_LISTS = (list, tuple, set, frozenset, collections.deque, collections.abc.Sequence, collections.abc.Iterable, collections.abc.Collection, collections.abc.Set, collections.abc.MutableSequence, collections.abc.MutableSet)
_MAPS = (dict, collections.OrderedDict, collections.abc.Mapping, collections.abc.MutableMapping)


@dataclass
class ClassModel:
    """The root record, the classes by record and struct name (as ``objects`` takes them), and what was left out."""

    root: Obj
    classes: dict[str, type] = field(default_factory=dict)
    warnings: list[tuple[str, str]] = field(default_factory=list)


def model_of(cls: type, *, strict: bool = False) -> ClassModel:
    """The model of a class and all that it reaches."""
    if _is_abstract(cls):
        raise ModelError("abstract-root", f"{cls.__name__} can't be made, so no buffer can hold it as its root")
    build = _Builder(strict)
    root = build.record(cls)
    if build.classes and not root.all_members:
        build.warn("empty-root", f"{cls.__name__} has no members")
    return ClassModel(root, build.classes, build.warnings)


def stable_name(cls: type) -> str:
    """``__record_name__`` of the class itself, else its own name."""
    return vars(cls).get("__record_name__", cls.__name__)


def _is_abstract(cls: type) -> bool:
    return inspect.isabstract(cls) or abc.ABC in cls.__bases__ or bool(vars(cls).get("__abstract__"))


def _concrete(cls: type) -> Iterator[type]:
    """Every class that can be made and is one of ``cls``, the most derived first, each once."""
    seen: set[type] = set()

    def below(c: type) -> Iterator[type]:
        for s in c.__subclasses__():
            yield from below(s)
        if c not in seen and not _is_abstract(c):
            seen.add(c)
            yield c

    yield from below(cls)


class _Builder:
    def __init__(self, strict: bool):
        self.strict, self.records, self.structs, self.unions = strict, {}, {}, {}
        self.classes: dict[str, type] = {}
        self.warnings: list[tuple[str, str]] = []

    def warn(self, code: str, message: str) -> None:
        if self.strict:
            raise ModelError(code, message)
        self.warnings.append((code, message))

    def known(self, cls: type) -> str:
        """The class's stable name, which no other class of the model has."""
        name = stable_name(cls)
        if cls.__name__.startswith("_"):
            raise ModelError("private-class", f"{cls.__qualname__} is private to its module")
        if self.classes.setdefault(name, cls) is not cls:
            raise ModelError("duplicate-name", f"{cls.__qualname__} and {self.classes[name].__qualname__} are both named {name}")
        return name

    def record(self, cls: type) -> Obj:
        if cls not in self.records:
            # Put down first, so that a class may hold itself.
            out = self.records[cls] = Obj(self.known(cls))
            out.define(*self.members(cls))
        return self.records[cls]

    def members(self, cls: type) -> Iterator[Member]:
        """Members of all bases first, then the class's own; one that is declared again keeps its first place."""
        hints = typing.get_type_hints(cls, include_extras=True)
        order = list(dict.fromkeys(n for c in reversed(cls.__mro__) for n in vars(c).get("__annotations__", {}) if n in hints)) or list(hints)
        for name in order:
            kind, notes = _unwrapped(hints[name])
            where = f"{cls.__name__}.{name}"
            if typing.get_origin(kind) is typing.ClassVar or kind is typing.ClassVar or _has(notes, Ignore):
                continue
            if name.startswith("_"):
                self.warn("private-member", f"{where} is private and left out")
                continue
            t = self.type(kind, notes, where)
            wire = next((n.wire for n in notes if isinstance(n, Name)), "")
            yield Member(name, t, wire, self.default(cls, name, t), _has(notes, Keep))

    def default(self, cls: type, name: str, t: Type) -> object:
        """The declared default of a scalar, wherever among the bases it stands."""
        fields = getattr(cls, "__dataclass_fields__", {})
        value = fields[name].default if name in fields else getattr(cls, name, dataclasses.MISSING)
        if value is dataclasses.MISSING or value is None or not isinstance(t, Scalar) or t.nullable:
            return None
        return value.value if isinstance(value, enum.Enum) else value

    def type(self, kind: object, notes: tuple, where: str) -> Type:
        kind, more = _unwrapped(kind)
        notes = (*notes, *more)
        origin, args = typing.get_origin(kind), typing.get_args(kind)
        if origin in (typing.Union, types.UnionType):
            some = [a for a in args if a is not type(None)]
            if len(some) > 1:
                return self.choice(tuple(some), where)
            return _nullable(self.type(some[0], notes, where)) if len(some) < len(args) else self.type(some[0], notes, where)
        if origin in _MAPS:
            return dictionary(self.type(args[0], (), where), self.type(args[1], (), where))
        if origin in _LISTS:
            if origin is tuple and (len(args) != 2 or args[1] is not ...):
                raise ModelError("unsupported-type", f"{where}: a tuple of fixed length; use a NamedTuple")
            return Vec(self.type(args[0], (), where))
        if not isinstance(kind, type):
            raise ModelError("unsupported-type", f"{where}: {kind!r}")
        width = next((n for n in notes if isinstance(n, Kind)), None)
        if issubclass(kind, enum.Enum):
            return self.enum(kind, width, where)
        if kind in _PLAIN:
            return Scalar(width or _PLAIN[kind])
        if kind is str:
            return Text()
        if kind in (bytes, bytearray):
            return Vec(scalar("uint8"))
        if issubclass(kind, tuple) and hasattr(kind, "_fields"):
            return self.struct(kind, _has(notes, Shared), where)
        if kind in _LISTS or kind in _MAPS or kind.__module__ == "builtins" or not typing.get_type_hints(kind) and not kind.__subclasses__():
            raise ModelError("unsupported-type", f"{where}: {kind.__name__}")
        found = tuple(_concrete(kind))
        if not found:
            raise ModelError("no-union-members", f"{where}: nothing that is a {kind.__name__} can be made")
        return self.record(kind) if found == (kind,) else self.union(stable_name(kind), found)

    def enum(self, kind: type[enum.Enum], width: Kind | None, where: str) -> Scalar:
        if not all(isinstance(m.value, int) for m in kind):
            raise ModelError("unsupported-type", f"{where}: values of {kind.__name__} aren't integers")
        return Scalar(width or Kind.INT32, names=tuple((m.name, m.value) for m in kind))

    def struct(self, kind: type, shared: bool, where: str) -> Struct:
        if (kind, shared) not in self.structs:
            name, hints = self.known(kind), typing.get_type_hints(kind, include_extras=True)
            self.structs[kind, shared] = Struct(name, tuple((n, self.type(h, (), f"{where}.{n}")) for n, h in hints.items()), shared=shared)
        return self.structs[kind, shared]

    def union(self, name: str, found: tuple[type, ...]) -> Union:
        if found not in self.unions:
            self.unions[found] = Union(name, tuple(self.record(c) for c in found))
        return self.unions[found]

    def choice(self, some: tuple, where: str) -> Union:
        """``A | B``: those classes and what is derived from them."""
        if not all(isinstance(c, type) and typing.get_type_hints(c) for c in some):
            raise ModelError("unsupported-type", f"{where}: a choice of other things than records")
        return self.union("|".join(map(stable_name, some)), tuple(dict.fromkeys(c for s in some for c in _concrete(s))))


def _has(notes: tuple, kind: type) -> bool:
    """Whether a note stands there, as an object or as the class."""
    return any(n is kind or isinstance(n, kind) for n in notes)


def _unwrapped(kind: object) -> tuple[object, tuple]:
    """An annotation without ``Annotated``, and its notes."""
    if typing.get_origin(kind) is typing.Annotated:
        inner, *notes = typing.get_args(kind)
        below, more = _unwrapped(inner)
        return below, (*notes, *more)
    return kind, ()


def _nullable(t: Type) -> Type:
    """References may be null as they are; scalars and structs get a nullable type of their own."""
    if isinstance(t, Scalar):
        return Scalar(t.code, True, t.names)
    return Struct(t.name, t.fields, t.shared, not t.shared, t.pack) if isinstance(t, Struct) else t

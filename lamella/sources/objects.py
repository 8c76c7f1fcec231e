"""Decoded records as objects of your own classes, and back.

``classes`` maps record and struct names to classes. A constructor's parameters are filled by member name, in any of the
spellings ``Name``, ``name`` and ``snake_name``; what is left over is set as attributes that exist. A name without a
class stays a dict.
"""

from __future__ import annotations

import inspect
from collections.abc import Mapping

from lamella.functions.text import identifier
from lamella.model import Obj, Scalar, Struct, Text, Type, Union, Vec
from lamella.sources import codec


def _spellings(name: str) -> tuple[str, ...]:
    return name, identifier(name, "camel"), identifier(name, "snake")


def to_object(t: Type, v: object, classes: Mapping[str, type]) -> object:
    """A decoded value (wire or read form) with objects for records and structs, dicts for dictionaries."""
    if v is None or isinstance(t, Scalar | Text):
        return v
    if isinstance(t, Vec):
        return [to_object(t.element, x, classes) for x in v]
    if isinstance(t, Union):
        m = t.tags.get(v["tag"])
        return None if m is None else to_object(m, v.get(m.name), classes)
    if isinstance(t, Struct):
        return _create(classes.get(t.name), {n: to_object(f, v[n], classes) for n, f in t.fields})
    parts = {m.name: to_object(m.type, v.get(m.name), classes) for m in t.all_members}
    if t.dictionary:
        return dict(zip(parts["keys"] or (), parts["values"] or ()))  # fewer values than keys: only whole entries
    return _create(classes.get(t.name), parts)


def _create(cls: type | None, parts: dict[str, object]) -> object:
    if cls is None:
        return parts
    given, left = {}, dict(parts)
    for p in inspect.signature(cls).parameters.values():
        name = next((n for n in left if p.name in _spellings(n)), None)
        if name is not None and (left[name] is not None or p.default is inspect.Parameter.empty):
            given[p.name] = left.pop(name)
    out = cls(**given)
    for name, v in left.items():
        place = next((s for s in _spellings(name) if hasattr(out, s)), None)
        if place and v is not None:
            setattr(out, place, v)
    return out


def from_object(t: Type, v: object) -> object:
    """An object (or plain value) as the codec takes it. A union takes the first member, in its order, whose name is that
    of the object's class or of one of its bases, nearest first; none is an error."""
    if v is None or isinstance(t, Scalar | Text):
        return v
    if isinstance(t, Vec):
        return [from_object(t.element, x) for x in v]
    if isinstance(t, Union):
        names = [c.__name__ for c in type(v).__mro__]
        m = next((m for n in names for m in t.members if m.name == n), None)
        if m is None:
            raise codec.WriteError(f"{t.name} doesn't hold {type(v).__name__}")
        return {"tag": t.tag_of(m.name), m.name: from_object(m, v)}
    if isinstance(t, Obj) and t.dictionary:
        key, value = (m.type.element for m in t.all_members)
        return {"keys": [from_object(key, k) for k in v], "values": [from_object(value, x) for x in v.values()]}
    get = v.get if isinstance(v, Mapping) else lambda n: next((getattr(v, s) for s in _spellings(n) if hasattr(v, s)), None)
    parts = t.fields if isinstance(t, Struct) else [(m.name, m.type) for m in t.all_members]
    return {n: from_object(f, get(n)) for n, f in parts}


def write_object(root: Obj, v: object, options: codec.WriteOptions = codec.WriteOptions()) -> bytes:
    return codec.encode(root, from_object(root, v), options)


def read_object(root: Obj, b: bytes, classes: Mapping[str, type], options: codec.ReadOptions = codec.ReadOptions()) -> object:
    """An object of the root's class, declared defaults filled in."""
    return to_object(root, codec.with_defaults(root, codec.decode(root, b, options)), classes)

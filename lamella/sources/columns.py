"""A whole Arrow column of buffers at once: checked and read member by member into Arrow arrays.

The column's bytes are one array; every record, list and text in it is a position and the buffer it belongs to. Buffers
that aren't plainly in order, or that another model wrote, are told apart and left to ``codec``, one by one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from lamella.model import PACK, SIZE, Kind, Obj, Scalar, Struct, Text, Type, Union, Vec
from lamella.sources import codec


class NotPlain(Exception):
    """The column holds something that only ``codec`` reads."""


def flat(at: np.ndarray, n: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """(place of every element of lists that begin at ``at``, which list it is of)."""
    which = np.repeat(np.arange(len(at)), n)
    return at[which] + step * (np.arange(len(which)) - (np.cumsum(n) - n)[which]), which


class Column:
    """``root``'s buffers in an Arrow array: ``fine`` says which are in order and of this very model, ``at`` where their
    root records are."""

    def __init__(self, root: Obj, a: pa.Array, options: codec.ReadOptions):
        wide = pa.types.is_large_binary(a.type)
        _, offsets, data = a.buffers()
        self.bytes = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        self.words = self.bytes[: len(self.bytes) // 4 * 4].view("<u4")
        bounds = np.frombuffer(offsets, np.int64 if wide else np.int32)[a.offset : a.offset + len(a) + 1].astype(np.int64) if len(a) else np.zeros(1, np.int64)
        self.start, self.end = bounds[:-1], bounds[1:]
        self.root, self.o = root, options
        self.binding = codec._own_binding(id(root), root)
        self.s = self.binding.s
        valid = np.ones(len(a), bool) if not a.null_count else ~np.asarray(a.is_null().to_numpy(zero_copy_only=False), bool)
        self.fine = valid & (self.end - self.start >= codec.HEADER) & (self.start & 3 == 0) & options.aligned & (not options.utf8)
        self.at = np.zeros(len(a), np.int64)
        self._headers()
        if options.verify and self.fine.any():
            self.items, self.bad = np.zeros(len(a), np.int64), ~self.fine
            self.limit = np.minimum((self.end - self.start) // 4, options.max_items)
            rows = np.flatnonzero(self.fine)
            self._record(self.s.root, self.at[rows], rows, 0)
            self.fine &= ~self.bad

    def _headers(self) -> None:
        rows = np.flatnonzero(self.fine)
        w = self.words[(self.start[rows] >> 2)[:, None] + np.arange(4)] if len(rows) else np.zeros((0, 4), "<u4")
        at, deep = w[:, 0].astype(np.int64), w[:, 2].astype(np.uint64) | w[:, 3].astype(np.uint64) << np.uint64(32)
        known = (w[:, 1] & 0xFFFFFF) == (codec.MAGIC | codec.VERSION << 16)
        ok = known & (w[:, 1] >> 24 <= codec.HAS_SCHEMA) & (at >= codec.HEADER) & (at & 3 == 0) & (at < self.end[rows] - self.start[rows])
        self.fine[rows] = ok & (deep == np.uint64(codec._fingerprint(id(self.root), self.root)))
        self.at[rows] = self.start[rows] + at

    # ---- checking ----

    def _drop(self, wrong: np.ndarray, at: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mark the buffers of what is wrong; what is left of those that are still in order."""
        self.bad[own[wrong]] = True
        stay = ~self.bad[own]
        return at[stay], own[stay]

    def _count(self, at: np.ndarray, own: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        self.items += np.bincount(own, minlength=len(self.items))
        self.bad |= self.items > self.limit
        return self._drop(np.full(len(at), depth > self.o.max_depth), at, own)

    def _bits(self, E: codec.Entry, at: np.ndarray) -> np.ndarray:
        bits = self.words[at >> 2].astype(np.uint64)
        return bits if E.words == 1 else bits | self.words[(at >> 2) + 1].astype(np.uint64) << np.uint64(32)

    def _places(self, E: codec.Entry, at: np.ndarray, bits: np.ndarray) -> tuple[dict[int, tuple[np.ndarray, np.ndarray]], np.ndarray]:
        """(of each cell by its presence bit: whether it is stored, and where; each record's end)."""
        end, found = at + 4 * E.words + E.fixed_size, {}
        for f in sorted(E.cells, key=lambda f: f.at):
            stored = (bits >> np.uint64(f.at) & np.uint64(1)).astype(bool)
            found[f.at] = stored, end
            end = end + np.where(stored, f.size, 0)
        return found, end

    def _record(self, e: int, at: np.ndarray, own: np.ndarray, depth: int) -> None:
        E = self.s.entries[e]
        at, own = self._count(at, own, depth)
        at, own = self._drop((at & 3 != 0) | (at + 4 * E.words > self.end[own]) | (E.words > 2), at, own)
        if not len(at):
            return
        bits = self._bits(E, at)
        used = (1 << len(E.cells)) - 1
        wrong = np.zeros(len(at), bool)
        for f in E.bools:
            used |= 3 << f.at
            wrong |= bits >> np.uint64(f.at) & np.uint64(3) == np.uint64(2)
        wrong |= bits & np.uint64(~used & (1 << 64) - 1) != 0
        if E.is_dictionary:
            wrong |= bits & np.uint64(3) != np.uint64(3)
        cells, end = self._places(E, at, bits)
        self._drop(wrong | (end > self.end[own]), at, own)
        for f in E.cells:
            if f.kind in codec.REFERENCES:
                stored, place = cells[f.at]
                mine = np.flatnonzero(stored & ~self.bad[own])
                self._reference(f.kind, f.ref, place[mine], own[mine], depth + 1)

    def _reference(self, kind: Kind, ref: int, slots: np.ndarray, own: np.ndarray, depth: int) -> None:
        """What cells or elements refer to; none of them is null."""
        tags = None
        if kind is Kind.UNION:
            slots, own = self._drop(slots & 3 != 0, slots, own)
            tags, slots = self.words[slots >> 2], slots + 4
        off = self.words[np.where(slots & 3 == 0, slots, 0) >> 2]
        wrong = (slots & 3 != 0) | (off == 0) | (off & 3 != 0) | (slots + off >= self.end[own])
        self.bad[own[wrong]] = True
        stay = ~self.bad[own]
        at, own = (slots + off)[stay], own[stay]
        if kind is Kind.UNION:
            tags, members = tags[stay], self.s.entries[ref].members
            known = np.zeros(len(at), bool)
            for tag, member in members.items():
                mine = tags == tag
                if member >= 0:
                    known |= mine
                    self._record(member, at[mine], own[mine], depth)
            self.bad[own[~known]] = True
        elif kind is Kind.OBJECT:
            self._record(ref, at, own, depth)
        elif kind is Kind.SHARED:
            self._drop(at + self.s.entries[ref].size > self.end[own], at, own)
        elif kind is Kind.STRING:
            self._text(at, own)
        else:
            self._list(ref, at, own, depth)

    def _text(self, at: np.ndarray, own: np.ndarray) -> None:
        at, own = self._drop(at + 4 > self.end[own], at, own)
        n = self.words[at >> 2].astype(np.int64)
        wrong = at + n + 5 > self.end[own]
        self._drop(wrong, at, own)
        self.bad[own[~wrong][self.bytes[(at + 4 + n)[~wrong]] != 0]] = True

    def _list(self, e: int, at: np.ndarray, own: np.ndarray, depth: int) -> None:
        V = self.s.entries[e]
        at, own = self._count(at, own, depth)
        at, own = self._drop((at + 4 > self.end[own]) | V.optional, at, own)
        n = self.words[at >> 2].astype(np.int64)
        wrong = at + 4 + n * V.element > self.end[own]
        if V.element >= 8 and V.kind not in (Kind.STRUCT, Kind.UNION):
            wrong |= (at - self.start[own] + 4) & 7 != 0
        self.bad[own[wrong]] = True
        stay = ~self.bad[own]
        at, own, n = at[stay], own[stay], n[stay]
        if V.kind is Kind.BOOL:
            places, which = flat(at + 4, n, 1)
            self.bad[own[which[self.bytes[places] > 1]]] = True
        if V.kind in codec.REFERENCES:
            slots, which = flat(at + 4, n, V.element)
            there = self.words[(slots + 4 * (V.kind is Kind.UNION)) >> 2] != 0
            self._reference(V.kind, V.ref, slots[there], own[which[there]], depth + 1)

    # ---- reading ----

    def records(self, o: Obj, e: int, at: np.ndarray, kind: pa.DataType) -> pa.Array:
        """The records at ``at`` as a struct array; ``kind`` says its members."""
        E = self.s.entries[e]
        if E.words > 2 or len(at) > max(64, len(self.words)):
            raise NotPlain
        bits = self._bits(E, at) if len(at) else np.zeros(0, np.uint64)
        cells, _ = self._places(E, at, bits)
        by_name = {c.member.name: f for c, f in self.binding.fields[(id(o), e)]}
        columns = []
        for field in kind:
            m, f = o.member(field.name), by_name[field.name]
            if f is None or f.kind is Kind.BOOL:
                columns.append(self._bools(m, f, bits, field.type) if f else self._constant(o, m, len(at), field.type))
                continue
            stored, place = (np.ones(len(at), bool), at + 4 * E.words + f.at) if f.flags & 2 else cells[f.at]
            column = self._cells(m.type, f.ref, place[stored], field.type)
            if not stored.all():
                column = column.take(pa.array(np.cumsum(stored) - 1, mask=~stored))
                if o.dictionary:
                    column = pa.compute.fill_null(column, pa.scalar([], field.type))
            columns.append(column)
        return pa.StructArray.from_arrays(columns, fields=list(kind)) if columns else pa.array([{}] * len(at), kind)

    def _constant(self, o: Obj, m, n: int, kind: pa.DataType) -> pa.Array:
        value = m.default_value if m.keep else [] if o.dictionary else None
        return pa.array([value] * n, kind)

    def _bools(self, m, f: codec.Field, bits: np.ndarray, kind: pa.DataType) -> pa.Array:
        stored, value = ((bits >> np.uint64(f.at + i) & np.uint64(1)).astype(bool) for i in (0, 1))
        if m.keep and not stored.all():
            raise NotPlain
        return pa.array(value, kind, mask=~stored)

    def _cells(self, t: Type, ref: int, at: np.ndarray, kind: pa.DataType) -> pa.Array:
        """Cells or elements that are stored, at these places."""
        if isinstance(t, Scalar):
            return self._numbers(t, at, kind)
        if isinstance(t, Struct) and not t.shared:
            return self._structs(t, at, kind)
        if isinstance(t, Union):
            return self._unions(t, ref, at, kind)
        off = self.words[at >> 2] if len(at) else np.zeros(0, "<u4")
        there = off != 0
        targets = (at + off)[there]
        if isinstance(t, Text):
            out = self._texts(targets, kind)
        elif isinstance(t, Struct):
            out = self._structs(t, targets, kind)
        elif isinstance(t, Obj):
            out = self.records(t, ref, targets, kind)
        else:
            out = self._lists(t, ref, targets, kind)
        return out if there.all() else out.take(pa.array(np.cumsum(there) - 1, mask=~there))

    def _numbers(self, t: Scalar, at: np.ndarray, kind: pa.DataType) -> pa.Array:
        if t.kind is Kind.UINT64:
            raise NotPlain
        size = max(1, SIZE[t.kind])
        raw = np.ascontiguousarray(self.bytes[at[:, None] + np.arange(size)])
        if t.kind is Kind.BOOL:
            return pa.array(raw.reshape(-1) != 0, kind)
        return pa.array(raw.view("<" + PACK[t.kind]).reshape(-1)).cast(kind)

    def _structs(self, t: Struct, at: np.ndarray, kind: pa.DataType) -> pa.Array:
        fields = {n: (f, place) for n, f, place in t.layout[0]}
        columns = [self._cells(fields[k.name][0], -1, at + fields[k.name][1], k.type) for k in kind]
        return pa.StructArray.from_arrays(columns, fields=list(kind))

    def _unions(self, t: Union, ref: int, at: np.ndarray, kind: pa.DataType) -> pa.Array:
        tags, off = self.words[at >> 2], self.words[(at >> 2) + 1]
        there, members, columns = off != 0, self.s.entries[ref].members, []
        for k in kind:
            if k.name == "tag":
                columns.append(pa.array(tags.astype(np.int64), mask=~there).cast(k.type))
                continue
            tag = t.tag_of(k.name)
            mine = there & (tags == tag)
            if members.get(tag, -1) < 0:
                columns.append(pa.nulls(len(at), k.type))
                continue
            found = self.records(t.tags[tag], members[tag], (at + 4 + off)[mine], k.type)
            columns.append(found.take(pa.array(np.cumsum(mine) - 1, mask=~mine)))
        return pa.StructArray.from_arrays(columns, fields=list(kind), mask=pa.array(~there))

    def _texts(self, at: np.ndarray, kind: pa.DataType) -> pa.Array:
        n = self.words[at >> 2].astype(np.int64) if len(at) else np.zeros(0, np.int64)
        ends = np.concatenate([[0], np.cumsum(n)])
        if ends[-1] >= 2**31:
            raise NotPlain
        places, _ = flat(at + 4, n, 1)
        out = pa.StringArray.from_buffers(len(at), pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(self.bytes[places]))
        try:
            out.validate(full=True)
        except pa.ArrowInvalid:  # bytes that aren't UTF-8 are replaced one by one
            raise NotPlain from None
        return out.cast(kind)

    def _lists(self, t: Vec, ref: int, at: np.ndarray, kind: pa.DataType) -> pa.Array:
        V = self.s.entries[ref]
        if V.optional:
            raise NotPlain
        n = self.words[at >> 2].astype(np.int64) if len(at) else np.zeros(0, np.int64)
        places, _ = flat(at + 4, n, V.element)
        if len(places) > max(64, len(self.bytes)):
            raise NotPlain
        values = self._cells(t.element, V.ref, places, kind.value_type)
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), values, type=kind)

    def read(self, kind: pa.DataType) -> pa.Array:
        """The root records of the buffers that are ``fine``, in order."""
        return self.records(self.root, self.s.root, self.at[self.fine], kind)

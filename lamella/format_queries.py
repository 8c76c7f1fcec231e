"""Registered queries of the format's rules: kinds, layouts, hashes, names, damage. Each runs its cases on the executors;
the SQL states the results as they follow from the rules, or works them out from the tables."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Annotated

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella import classes, model
from lamella.functions import text
from lamella.model import Kind, Member, ModelError, Obj, Scalar, Struct, Text, Type, Union, Vec, dictionary, layout, scalar
from lamella.queries import query, tables
from lamella.sources import codec

I8, I16, I32, I64, U8, F32, F64, BOOL = (scalar(k) for k in ("int8", "int16", "int32", "int64", "uint8", "float32", "float64", "bool"))


def told(cases: Column, say: Callable[[str], str | None]) -> Column:
    """What ``say`` gives for each case, on the executors."""

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for a in batches:
            yield pa.array([None if x is None else say(x) for x in a.to_pylist()], pa.string())

    return run(cases)


def cases(spark: SparkSession, names: list[str], say: Callable[[str], str | None]) -> DataFrame:
    return spark.createDataFrame([(n,) for n in names], "name string").select("name", told(F.col("name"), say).alias("result"))


def values(rows: dict[str, object]) -> str:
    """SQL of the cases' results."""
    quoted = lambda v: "NULL" if v is None else "'" + str(v).replace("'", "''") + "'"
    return "SELECT * FROM (VALUES " + ", ".join(f"({quoted(k)}, CAST({quoted(v)} AS VARCHAR))" for k, v in rows.items()) + ") AS t(name, result)"


# ---- kinds and refusals -----------------------------------------------------------------------------------------

#: Kind number and bytes of a cell. Fixed values of the format.
KINDS = {
    "bool": "1 0", "int8": "2 1", "uint8": "3 1", "int16": "4 2", "uint16": "5 2", "int32": "6 4", "uint32": "7 4", "int64": "8 8", "uint64": "9 8", "float32": "10 4", "float64": "11 8", "char16": "12 2",
    "string": "14 4", "object": "15 4", "list": "16 4", "union": "17 8", "shared": "18 4", "dictionary": "15 4",
}


def _type(name: str) -> Type:
    pair = Struct("Pair", (("a", I8), ("b", I32)), shared=True)
    made = {"string": Text(), "object": Obj("O"), "list": Vec(I8), "union": Union("U", (Obj("O"),)), "shared": pair, "dictionary": dictionary(Text(), I32)}
    return made.get(name) or scalar(name)


@query("sch2_kinds", values(KINDS))
def sch2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wire kind of every type, and the bytes of its cell."""
    return cases(spark, list(KINDS), lambda n: f"{int(_type(n).kind)} {model.SIZE[_type(n).kind]}")


def _refusals() -> dict[str, Callable[[], object]]:
    two = lambda a, b: Obj("O", (Member(a, I32), Member(b, I32)))
    return {
        **{n: (lambda n=n: scalar(n)) for n in sorted(model.UNSUPPORTED)},
        "two members of one name": lambda: two("a", "a"),
        "a text with a default": lambda: Obj("O", (Member("a", Text(), default="x"),)),
        "a struct with a text": lambda: Struct("S", (("a", Text()),)),
        "a struct without fields": lambda: Struct("S", ()),
        "a struct of 65536 bytes": lambda: Struct("S", (("a", Struct("T", tuple((f"x{i}", I64) for i in range(4096)))), ("b", Struct("V", tuple((f"x{i}", I64) for i in range(4096)))))),
        "a dictionary by float": lambda: dictionary(F64, I32),
        "a dictionary by bool": lambda: dictionary(BOOL, I32),
        "4097 members": lambda: Obj("O", tuple(Member(f"m{i}", I8) for i in range(4097))),
        "a union of nothing": lambda: Union("U", ()),
        "a union of twins": lambda: Union("U", (Obj("O"), Obj("O"))),
        "a list as root": lambda: model.register(Vec(I32)),
        "a dictionary as root": lambda: model.register(dictionary(Text(), I32)),
    }


REFUSED = {n: "unsupported-type" for n in sorted(model.UNSUPPORTED)} | {
    "two members of one name": "duplicate-member", "a text with a default": "default-type", "a struct with a text": "struct-field", "a struct without fields": "empty-struct", "a struct of 65536 bytes": "struct-too-large",
    "a dictionary by float": "dictionary-key", "a dictionary by bool": "dictionary-key", "4097 members": "too-many-members", "a union of nothing": "no-union-members", "a union of twins": "union-tag-collision",
    "a list as root": "not-a-root", "a dictionary as root": "not-a-root",
}


def _code(build: Callable[[], object]) -> str | None:
    try:
        build()
    except ModelError as e:
        return e.code
    return None


@query("sch3_refused", values(REFUSED))
@query("sch11_collisions", values(REFUSED))
@query("gen8_diagnostics", values(REFUSED))
def sch3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a model refuses, and why (SCH-3, SCH-11, GEN-8)."""
    return cases(spark, list(REFUSED), lambda n: _code(_refusals()[n]))


# ---- layouts ----------------------------------------------------------------------------------------------------


def _layouts() -> dict[str, Obj]:
    mixed = Obj("Mixed", (Member("flag", BOOL), Member("small", I16), Member("kept", I32, keep=True), Member("wide", I64), Member("byte", U8), Member("text", Text())))
    wide = Obj("Wide", tuple(Member(f"F{i:02d}", I32) for i in range(40)) + tuple(Member(f"B{i:02d}", BOOL) for i in range(20)) + tuple(Member(f"S{i}", Text()) for i in range(8)) + tuple(Member(f"D{i}", F64) for i in range(4)))
    return {"mixed": mixed, "wide": wide, "empty": Obj("Empty"), "kept doubles": Obj("K", tuple(Member(f"d{i}", F64, keep=True) for i in range(130)))}


#: Members in wire order: larger alignment first, then smaller size, then name hash; header words, bytes of fixed cells.
LAYOUTS = {"mixed": "kept wide text small byte flag; 1 words, 8 fixed, align 8", "wide": "4 doubles, 48 of four bytes, 20 bools; 3 words, 0 fixed, align 8", "empty": "; 1 words, 0 fixed, align 1", "kept doubles": "128 fixed, 2 cells; 1 words, 1024 fixed, align 8"}


def _layout(name: str) -> str:
    at = layout(_layouts()[name])
    if name == "wide":
        sizes = [c.size for c in at.order]
        shown = f"{sizes.count(8)} doubles, {sizes.count(4)} of four bytes, {sizes.count(0)} bools" if sizes == sorted(sizes, reverse=True) else "out of order"
    elif name == "kept doubles":
        shown = f"{len(at.fixed)} fixed, {len(at.cells)} cells"
    else:
        shown = " ".join(c.member.name for c in at.order)
    return f"{shown}; {at.words} words, {at.fixed_size} fixed, align {at.align}"


@query("sch4_layout", values(LAYOUTS))
@query("ord3_wire_order", values(LAYOUTS))
def sch4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wire order of members, presence bits and fixed cells (SCH-4, ORD-3)."""
    return cases(spark, list(LAYOUTS), _layout)


#: Offsets of the fields, size and alignment, as C lays them out.
STRUCTS = {"padded": "0 8 16; 24 8", "packed": "0 1 9; 10 1", "packed by 4": "0 4 12; 16 4", "vector": "0 4 8; 12 4", "nested": "0 8; 32 8", "mixed": "0 2 4; 8 4"}


def _struct(name: str) -> str:
    fields = (("Tag", U8), ("Value", F64), ("Flag", BOOL))
    padded = Struct("Padded", fields)
    s = {
        "padded": padded,
        "packed": Struct("Packed", fields, pack=1),
        "packed by 4": Struct("Packed", fields, pack=4),
        "vector": Struct("Vec3", tuple((x, F32) for x in "XYZ")),
        "nested": Struct("Nested", (("a", I8), ("b", padded))),
        "mixed": Struct("Mixed", (("a", I8), ("b", I16), ("c", I32))),
    }[name]
    return " ".join(str(at) for _, _, at in s.layout[0]) + f"; {s.size} {s.align}"


@query("sch13_struct_layout", values(STRUCTS))
def sch13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cases(spark, list(STRUCTS), _struct)


#: Whether a changed model has another own and another deep fingerprint than the first.
PRINTS = {"same again": "own same, deep same", "members in another order": "own same, deep same", "another type name": "own same, deep same", "a renamed member": "own differs, deep differs", "another kind": "own differs, deep differs", "a member more": "own differs, deep differs", "kept": "own differs, deep differs", "nullable elements": "own same, deep differs", "another element": "own same, deep differs", "another member below": "own same, deep differs"}


def _prints(name: str) -> str:
    def build(names=("a", "b", "c"), kind=I32, last=Vec(I32), keep=False, more=(), below="x", called="O", turn=False):  # noqa: B008
        inner = Obj("Inner", (Member(below, I32),))
        members = [Member(names[0], kind, keep=keep), Member(names[1], Text()), Member(names[2], last), Member("d", inner), *more]
        return Obj(called, tuple(members[::-1] if turn else members))

    changed = {
        "same again": {},
        "members in another order": {"turn": True},
        "another type name": {"called": "P"},
        "a renamed member": {"names": ("z", "b", "c")},
        "another kind": {"kind": I64},
        "a member more": {"more": (Member("e", I32),)},
        "kept": {"keep": True},
        "nullable elements": {"last": Vec(Scalar(Kind.INT32, nullable=True))},
        "another element": {"last": Vec(I16)},
        "another member below": {"below": "y"},
    }[name]
    a, b = build(), build(**changed)
    said = lambda same: "same" if same else "differs"
    return f"own {said(model.own_fingerprint(a) == model.own_fingerprint(b))}, deep {said(model.fingerprint(a) == model.fingerprint(b))}"


@query("sch5_fingerprints", values(PRINTS))
@query("sch6_deep_fingerprints", values(PRINTS))
def sch5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What fingerprints tell apart: a record's own layout, and that of all below it (SCH-5, SCH-6)."""
    return cases(spark, list(PRINTS), _prints)


# ---- hashes and names -------------------------------------------------------------------------------------------

#: xxHash64 and xxHash32 of the region names, seed 0.
HASHES = {"AFRICA": "f6fcf1dbd6b9e78f 1545918406", "AMERICA": "85c79845aeeb274f 1638799726", "ASIA": "fe756d78796d61a6 3596146606", "EUROPE": "55156856c3aef4dd 3934201502", "MIDDLE EAST": "3872dfa75c3e178c 4042281939"}


@query("hsh1_name_hash", "SELECT r_name, CASE r_name " + " ".join(f"WHEN '{n}' THEN '{h.split()[0]}'" for n, h in HASHES.items()) + " END AS hash FROM region")
def hsh1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables(spark, sf_dir)("region").select("r_name", told(F.col("r_name"), lambda n: f"{model.name_hash(n):016x}").alias("hash"))


@query("hsh2_type_id", "SELECT r_name, CASE r_name " + " ".join(f"WHEN '{n}' THEN '{h.split()[1]}'" for n, h in HASHES.items()) + " END AS id FROM region")
def hsh2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables(spark, sf_dir)("region").select("r_name", told(F.col("r_name"), lambda n: str(model.type_id(n))).alias("id"))


IDENTIFIERS = {"HitPoints": "hit_points hitPoints HitPoints", "hitPoints": "hit_points hitPoints HitPoints", "HTTPServer": "http_server hTTPServer HTTPServer", "id": "id id Id", "_hidden_": "hidden hidden Hidden", "X": "x x X", "Item2Name": "item2_name item2Name Item2Name", "already_snake": "already_snake already_snake Already_snake"}


@query("str4_identifiers", values(IDENTIFIERS))
def str4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cases(spark, list(IDENTIFIERS), lambda n: " ".join(text.identifier(n, s) for s in ("snake", "camel", "pascal")))


@query("str1_utf16_to_utf8", "SELECT c_custkey, octet_length(encode(c_name || 'é😀')) :: BIGINT AS n_bytes, upper(hex(encode(c_name || 'é😀'))) AS bytes FROM customer")
@query("str2_utf8_to_text", "SELECT c_custkey, octet_length(encode(c_name || 'é😀')) :: BIGINT AS n_bytes, upper(hex(encode(c_name || 'é😀'))) AS bytes FROM customer")
def str1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts go into buffers as UTF-8 and come back (STR-1, STR-2)."""
    from lamella.sources import buffers

    named = Obj("Named", (Member("c_custkey", I64, keep=True), Member("name", Text())))
    record = F.struct("c_custkey", F.concat("c_name", F.lit("é😀")).alias("name"))
    v = tables(spark, sf_dir)("customer").select(buffers.decoded(named, buffers.encoded(named, record), strict=True)["value"].alias("v"))
    return v.select("v.c_custkey", F.octet_length("v.name").cast("bigint").alias("n_bytes"), F.hex(F.encode("v.name", "UTF-8")).alias("bytes"))


@query("jsn2_control_characters", r"""WITH t AS (SELECT p_partkey, CAST(p_partkey % 160 AS INTEGER) AS c FROM part)
SELECT p_partkey, '"a' || CASE WHEN c = 34 THEN '\"' WHEN c = 92 THEN '\\' WHEN c = 9 THEN '\t' WHEN c = 10 THEN '\n' WHEN c = 13 THEN '\r' WHEN c < 32 THEN printf('\u%04x', c) ELSE chr(c) END || chr(8232) || 'b"' AS json FROM t""")
def jsn2_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every code below 160 between two letters, and a line separator, which JSON leaves as it is."""
    code = F.col("p_partkey") % 160
    return tables(spark, sf_dir)("part").select("p_partkey", text.quoted(F.concat(F.lit("a"), _char(code), F.lit(" b"))).alias("json"))


def _char(code: Column) -> Column:
    """One character by its code below 256."""
    return F.element_at(F.array(*(F.lit(chr(i)) for i in range(256))), code.cast("int") + 1)


# ---- models from classes ----------------------------------------------------------------------------------------

#: Members of a class of the tests' kind: name, kind, default.
DISCOVERED = {"ident": "8 0", "level": "4 3", "Title": "14 None", "ratio": "11 0.5", "seen": "1 True", "marks": "16 None", "stock": "15 None", "items": "16 None", "kin": "15 None"}


@dataclass
class Thing:
    name: str = ""


@dataclass
class Sword(Thing):
    sharp: bool = True


@dataclass
class Base:
    ident: Annotated[int, classes.Keep()] = 0
    level: classes.Int16 = 3


@dataclass
class Hero(Base):
    name: Annotated[str, classes.Name("Title")] = ""
    ratio: float = 0.5
    seen: bool = True
    marks: list[classes.UInt8] = field(default_factory=list)
    stock: dict[str, int] = field(default_factory=dict)
    items: list[Thing] = field(default_factory=list)
    kin: Hero | None = None
    skipped: Annotated[object, classes.Ignore()] = None


def _hero() -> Obj:
    return classes.model_of(Hero).root


@query("sch1_discovered", values(DISCOVERED))
@query("gen7_attributes", values(DISCOVERED))
@query("sch12_inherited_defaults", values(DISCOVERED))
def sch1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members that a class and its base declare, with their kinds, wire names and defaults (SCH-1, SCH-12, GEN-7)."""

    def say(name: str) -> str:
        m = next(m for m in _hero().all_members if m.wire_name == name)
        return f"{int(m.type.kind)} {m.default_value}"

    return cases(spark, list(DISCOVERED), say)


@query("uni4_members", values({"items": "Sword Thing"}))
def uni4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list of a class that has subclasses holds a union of all that can be made, the most derived first."""
    return cases(spark, ["items"], lambda n: " ".join(c.name for c in _hero().member(n).type.element.members))


# ---- damage -----------------------------------------------------------------------------------------------------

NODE = Obj("Node")
NODE.define(Member("Name", Text()), Member("Children", Vec(NODE)))
LISTS = Obj("Lists", (Member("flags", Vec(BOOL)), Member("longs", Vec(I64)), Member("some", Vec(Scalar(Kind.INT32, nullable=True))), Member("on", BOOL)))
PAIRS = Obj("Pairs", (Member("d", dictionary(I32, I32)),))


def _follow(b: bytes, slot: int) -> int:
    return slot + struct.unpack_from("<I", b, slot)[0]


def _cell(root: Obj, b: bytes, name: str) -> int:
    """Where a member's cell lies in a buffer whose root is its first record."""
    at, binding = codec.open_buffer(root, b)
    bits = int.from_bytes(b[at : at + 4 * binding.s.entries[binding.s.root].words], "little")
    return at + binding.place(root, binding.s.root, bits, name)[2]


def _put(b: bytes, at: int, raw: bytes) -> bytes:
    return b[:at] + raw + b[at + len(raw) :]


def _node(value: dict | None = None, **how: object) -> bytes:
    return codec.encode(NODE, {"Name": "abcd", "Children": [{"Name": "x" * 20}]} if value is None else value, codec.WriteOptions(schema=False, **how))


def _lists() -> bytes:
    return codec.encode(LISTS, {"flags": [True, False], "longs": [1, 2], "some": [1, None, 3], "on": True}, codec.WriteOptions(schema=False))


def _chain(n: int) -> dict:
    node: dict = {"Name": "end"}
    for _ in range(n - 1):
        node = {"Children": [node]}
    return node


def _graph(n: int) -> dict:
    node: dict = {"Name": "leaf"}
    for i in range(n):
        node = {"Name": f"d{i}", "Children": [node, node]}
    return node


def _damages() -> dict[str, Callable[[], str | None]]:
    check = lambda root, b, **how: codec.verify(root, b, codec.ReadOptions(**how))
    listed = lambda name: _follow(_lists(), _cell(LISTS, _lists(), name))
    root_at = struct.unpack_from("<I", _lists())[0]
    return {
        "sound": lambda: check(NODE, _node(), utf8=True),
        "cut before the header's end": lambda: check(NODE, _node()[:15]),
        "another marker": lambda: check(NODE, _put(_node(), 4, b"\0")),
        "another version": lambda: check(NODE, _put(_node(), 6, b"\x03")),
        "a reserved flag": lambda: check(NODE, _put(_node(), 7, b"\x80")),
        "a misaligned start": lambda: check(NODE, _node(), aligned=False),
        "a root inside the header": lambda: check(NODE, _put(_node(), 0, b"\x04\0\0\0")),
        "a misaligned root": lambda: check(NODE, _put(_node(), 0, b"\x12\0\0\0")),
        "cut at the end": lambda: check(NODE, _node()[:-8]),
        "an offset of zero": lambda: check(NODE, _put(_node(), _cell(NODE, _node(), "Name"), bytes(4))),
        "a misaligned offset": lambda: check(NODE, _put(_node(), _cell(NODE, _node(), "Name"), b"\x06\0\0\0")),
        "an offset past the end": lambda: check(NODE, _put(_node(), _cell(NODE, _node(), "Name"), b"\0\0\0\x10")),
        "a bit of no member": lambda: check(LISTS, _put(_lists(), root_at + 3, b"\x80")),
        "a value bit without its presence bit": lambda: check(LISTS, _put(_lists(), root_at, bytes([_lists()[root_at] & ~(1 << 4)]))),
        "a text without its end": lambda: check(NODE, _node().replace(b"abcd\0", b"abcde")),
        "bytes that aren't UTF-8, asked": lambda: check(NODE, _node().replace(b"abcd", b"a\xff\xfed"), utf8=True),
        "bytes that aren't UTF-8": lambda: check(NODE, _node().replace(b"abcd", b"a\xff\xfed")),
        "how they read": lambda: codec.decode(NODE, _node().replace(b"abcd", b"a\xff\xfed"))["Name"],
        "a bool of two": lambda: check(LISTS, _put(_lists(), listed("flags") + 4, b"\x02")),
        "a list of longs off its place": lambda: check(LISTS, _put(_lists(), _cell(LISTS, _lists(), "longs"), struct.pack("<I", struct.unpack_from("<I", _lists(), _cell(LISTS, _lists(), "longs"))[0] - 4))),
        "a bit past an optional list's end": lambda: check(LISTS, _put(_lists(), listed("some") + 4, b"\xff")),
        "a dictionary without values": lambda: _without_values(),
        "80 levels, 79 allowed": lambda: check(NODE, _node(_chain(41), max_depth=1000), max_depth=79),
        "80 levels, 80 allowed": lambda: check(NODE, _node(_chain(41), max_depth=1000), max_depth=80),
        "a heavily shared graph": lambda: check(NODE, _node(_graph(16), sharing="all")),
        "a heavily shared graph, 20 items allowed": lambda: check(NODE, _node(_graph(16), sharing="all"), max_items=20),
        "another model without a schema": lambda: check(PAIRS, _node()),
    }


def _without_values() -> str | None:
    b = bytearray(codec.encode(PAIRS, {"d": {1: 2}}, codec.WriteOptions(schema=False)))
    b[_follow(bytes(b), _cell(PAIRS, bytes(b), "d"))] &= 0xFE
    return codec.verify(PAIRS, bytes(b))


DAMAGES = {
    "sound": None, "cut before the header's end": "TooSmall", "another marker": "BadMagic", "another version": "BadVersion", "a reserved flag": "ReservedBits", "a misaligned start": "BadOffset", "a root inside the header": "BadOffset",
    "a misaligned root": "BadOffset", "cut at the end": "OutOfBounds", "an offset of zero": "BadOffset", "a misaligned offset": "BadOffset", "an offset past the end": "OutOfBounds", "a bit of no member": "ReservedBits",
    "a value bit without its presence bit": "ReservedBits", "a text without its end": "BadString", "bytes that aren't UTF-8, asked": "BadString", "bytes that aren't UTF-8": None, "how they read": "a��d", "a bool of two": "ReservedBits",
    "a list of longs off its place": "BadOffset", "a bit past an optional list's end": "ReservedBits", "a dictionary without values": "BadOffset", "80 levels, 79 allowed": "TooDeep", "80 levels, 80 allowed": None, "a heavily shared graph": None,
    "a heavily shared graph, 20 items allowed": "TooManyItems", "another model without a schema": "SchemaMismatch",
}

_SUBJECTS = {
    "val2_alignment": ("sound", "a misaligned start"),
    "val3_ranges": ("sound", "cut at the end", "an offset past the end"),
    "val4_offsets": ("an offset of zero", "a misaligned offset", "an offset past the end", "a root inside the header", "a misaligned root"),
    "val5_unused_bits": ("a bit of no member", "a value bit without its presence bit"),
    "val8_texts": ("a text without its end", "bytes that aren't UTF-8, asked", "bytes that aren't UTF-8"),
    "val9_replacement": ("bytes that aren't UTF-8", "how they read"),
    "val10_bools": ("a bool of two",),
    "val11_long_lists": ("a list of longs off its place",),
    "val12_optional_lists": ("a bit past an optional list's end",),
    "val14_shared_graphs": ("a heavily shared graph", "a heavily shared graph, 20 items allowed"),
    "val15_codes": tuple(DAMAGES),
}


def _damage_query(names: tuple[str, ...]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: cases(spark, list(names), lambda n: _damages()[n]())


for _name, _subjects in _SUBJECTS.items():
    query(_name, values({n: DAMAGES[n] for n in _subjects}))(_damage_query(_subjects))


# ---- writing into sinks, spans, picks ---------------------------------------------------------------------------

SERIES = Obj("Series", (Member("key", I64, keep=True), Member("values", Vec(F64)), Member("days", Vec(I32))))


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices of each customer's orders as a list: key, values, days."""
    o = F.struct("o_orderkey", F.col("o_totalprice").cast("double").alias("price"), F.dayofyear("o_orderdate").alias("day"))
    lists = tables(spark, sf_dir)("orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(o)).alias("o"))
    return lists.select(F.col("o_custkey").cast("bigint").alias("key"), F.transform("o", lambda x: x["price"]).alias("values"), F.transform("o", lambda x: x["day"]).alias("days"))


SERIES_SQL = "SELECT CAST(o_custkey AS BIGINT) AS key, count(*) AS n, CAST(max(o_totalprice) AS DOUBLE) AS most, CAST(sum(dayofyear(o_orderdate)) AS BIGINT) AS days FROM orders GROUP BY 1"


@query("arr12_span", SERIES_SQL)
@query("src2_into_a_sink", SERIES_SQL)
@query("src3_reused_writer", SERIES_SQL)
@query("src11_writer_reset", SERIES_SQL)
@query("arr7_any_iterable", SERIES_SQL)
def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One writer a task, reset between buffers of different options, fed with iterators, writes into the task's own sink
    (SRC-2, SRC-3, SRC-11, ARR-7); lists of numbers are read as spans of the buffer (ARR-12)."""
    import io

    @F.arrow_udf("struct<n:bigint,most:double,days:bigint>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        writer = codec.Writer()
        for a in batches:
            rows = []
            for i, v in enumerate(a.to_pylist()):
                writer.reset(codec.WriteOptions(schema=i % 2 == 0))
                sink = io.BytesIO()
                size = writer.write_into(SERIES, {"key": v["key"], "values": iter(v["values"]), "days": iter(v["days"])}, sink)
                b = sink.getvalue()
                found, days = codec.read_span(SERIES, b, ["values"]), codec.read_span(SERIES, b, ["days"])
                rows.append({"n": len(found) if len(b) == size else -1, "most": max(found), "days": sum(days)})
            yield pa.array(rows, pa.struct([("n", pa.int64()), ("most", pa.float64()), ("days", pa.int64())]))

    return series(spark, sf_dir).select("key", run(F.struct("key", "values", "days")).alias("s")).select("key", "s.*")


@query("ben9_skewed_pick", "WITH t AS (SELECT (o_orderkey % 1000) / 1000.0 :: DOUBLE AS u FROM orders) SELECT least(19, CAST(floor(20 * pow(u, 2.5)) AS INTEGER)) AS skewed, CASE WHEN u * 10 < 7 THEN 0 WHEN u * 10 < 9 THEN 2 ELSE 3 END :: INTEGER AS weighted, count(*) AS n FROM t GROUP BY 1, 2")
def ben9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Picks that favour small indexes, and picks by weights 7, 0, 2 and 1."""
    from lamella.operators import stats

    u = (F.col("o_orderkey") % 1000).cast("double") / 1000.0
    picked = tables(spark, sf_dir)("orders").select(stats.skewed_pick(u, 20).alias("skewed"), stats.weighted_pick(u, [7, 0, 2, 1]).alias("weighted"))
    return picked.groupBy("skewed", "weighted").agg(F.count("*").alias("n"))


@query("ded8_read_once", "SELECT c_custkey :: BIGINT AS c_custkey, 40 :: BIGINT AS n, 1 :: BIGINT AS distinct_objects FROM customer")
@query("ded9_texts_once", "SELECT c_custkey :: BIGINT AS c_custkey, 40 :: BIGINT AS n, 1 :: BIGINT AS distinct_objects FROM customer")
def ded8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record or text that a shared buffer holds once is decoded once, however often it is referred to."""
    shelf = Obj("Shelf", (Member("things", Vec(Obj("Thing", (Member("name", Text()),)))),))

    @F.arrow_udf("struct<n:bigint,distinct_objects:bigint>")
    def run(a: pa.Array) -> pa.Array:
        rows = []
        for name in a.to_pylist():
            got = codec.decode(shelf, codec.encode(shelf, {"things": [{"name": name}] * 40}, codec.WriteOptions(sharing="all")))["things"]
            rows.append({"n": len(got), "distinct_objects": max(len({id(x) for x in got}), len({id(x["name"]) for x in got}))})
        return pa.array(rows, pa.struct([("n", pa.int64()), ("distinct_objects", pa.int64())]))

    return tables(spark, sf_dir)("customer").select(F.col("c_custkey").cast("bigint").alias("c_custkey"), run(F.col("c_name")).alias("s")).select("c_custkey", "s.*")


@query("sch7_entries", "SELECT c_custkey :: BIGINT AS c_custkey, true AS parses, true AS same_entries, true AS same_bytes FROM customer")
@query("src13_cached_section", "SELECT c_custkey :: BIGINT AS c_custkey, true AS parses, true AS same_entries, true AS same_bytes FROM customer")
@query("sch9_tables", "SELECT c_custkey :: BIGINT AS c_custkey, true AS parses, true AS same_entries, true AS same_bytes FROM customer")
def sch7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each buffer's section parses to the model's own entries, and a writer that has written it before writes the same."""
    root = Obj("Named", (Member("name", Text()), Member("point", Struct("P", (("x", F32), ("y", F32)))), Member("tags", Vec(Text())), Member("pairs", dictionary(Text(), I32))))

    @F.arrow_udf("struct<parses:boolean,same_entries:boolean,same_bytes:boolean>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        writer = codec.Writer()
        for a in batches:
            rows = []
            for name in a.to_pylist():
                v = {"name": name, "tags": [name], "pairs": {name: 1}}
                b = writer.write(root, v)
                entries = codec.parse_schema(b[codec.HEADER :]).entries
                rows.append({"parses": len(entries) == len(model.reachable(root)), "same_entries": repr(entries) == repr(codec.schema_of(root).entries), "same_bytes": b == codec.encode(root, v)})
            yield pa.array(rows, pa.struct([(n, pa.bool_()) for n in ("parses", "same_entries", "same_bytes")]))

    return tables(spark, sf_dir)("customer").select(F.col("c_custkey").cast("bigint").alias("c_custkey"), run(F.col("c_name")).alias("s")).select("c_custkey", "s.*")


@query("gen4_objects", "SELECT c_custkey :: BIGINT AS c_custkey, c_name AS name, 'Hero' AS made, 3 :: BIGINT AS level, 2 :: BIGINT AS swords FROM customer")
@query("gen9_registry", "SELECT c_custkey :: BIGINT AS c_custkey, c_name AS name, 'Hero' AS made, 3 :: BIGINT AS level, 2 :: BIGINT AS swords FROM customer")
def gen4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects of the classes that a model came from, out of buffers whose root is looked up by name (GEN-4, GEN-9)."""
    from lamella.sources.objects import read_object, write_object

    @F.arrow_udf("struct<name:string,made:string,level:bigint,swords:bigint>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = classes.model_of(Hero)
        root = model.REGISTRY.get("Hero") or model.register(m.root)
        for a in batches:
            rows = []
            for name in a.to_pylist():
                hero = read_object(root, write_object(root, Hero(name=name, items=[Sword("a"), Thing("b"), Sword("c", False)])), m.classes)
                rows.append({"name": hero.name, "made": type(hero).__name__, "level": hero.level, "swords": sum(isinstance(x, Sword) for x in hero.items)})
            yield pa.array(rows, pa.struct([("name", pa.string()), ("made", pa.string()), ("level", pa.int64()), ("swords", pa.int64())]))

    return tables(spark, sf_dir)("customer").select(F.col("c_custkey").cast("bigint").alias("c_custkey"), run(F.col("c_name")).alias("s")).select("c_custkey", "s.*")

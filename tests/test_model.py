"""Models: what they refuse, how they are laid out, which Spark types they have."""

import itertools

import pytest
import xxhash
from pyspark.sql import types as T

from lamella import model as m
from lamella.model import Kind, Member, ModelError, Obj, Scalar, Struct, Text, Union, Vec, dictionary, scalar

I32 = scalar("int32")


@pytest.mark.parametrize("name", sorted(m.UNSUPPORTED))
def test_unsupported_types_are_refused(name):
    with pytest.raises(ModelError) as e:
        scalar(name)
    assert e.value.code == "unsupported-type"


@pytest.mark.parametrize(
    ("build", "code"),
    [
        (lambda: Obj("A", (Member("x", I32), Member("x", I32))), "duplicate-member"),
        (lambda: Obj("A", (Member("x", I32), Member("y", I32, "x"))), "duplicate-member"),
        (lambda: Obj("A", tuple(Member(f"m{i}", I32) for i in range(4097))), "too-many-members"),
        (lambda: Obj("A", (Member("x", Text(), default="a"),)), "default-type"),
        (lambda: dictionary(scalar("float64"), I32), "dictionary-key"),
        (lambda: dictionary(scalar("bool"), I32), "dictionary-key"),
        (lambda: Union("U", ()), "no-union-members"),
        (lambda: Union("U", (Obj("A"), Obj("A"))), "union-tag-collision"),
        (lambda: Struct("S", (("x", Text()),)), "struct-field"),
        (lambda: Struct("S", ()), "empty-struct"),
        (lambda: m.register(dictionary(I32, I32)), "not-a-root"),
        (lambda: m.register(Vec(I32)), "not-a-root"),
    ],
)
def test_diagnostics(build, code):
    with pytest.raises(ModelError) as e:
        build()
    assert e.value.code == code


def test_hashes_use_seed_zero():
    assert m.name_hash("Name") == xxhash.xxh64_intdigest(b"Name")
    assert m.name_hash("Name") - 2**64 == -7486133891411399611
    assert m.type_id("Potion") == xxhash.xxh32_intdigest(b"Potion")


def test_struct_layout_has_natural_alignment():
    s = Struct("Padded", (("Tag", scalar("uint8")), ("Value", scalar("float64")), ("Flag", scalar("bool"))))
    assert [(n, at) for n, _, at in s.layout[0]] == [("Tag", 0), ("Value", 8), ("Flag", 16)]
    assert (s.size, s.align) == (24, 8)
    packed = Struct("Packed", s.fields, pack=1)
    assert (packed.size, packed.align) == (10, 1)


def test_layout_orders_cells_and_bools():
    o = Obj("O", (Member("a", scalar("int8")), Member("b", scalar("bool")), Member("c", scalar("int64")), Member("d", scalar("int16")), Member("k", I32, keep=True)))
    at = m.layout(o)
    assert [c.member.name for c in at.order] == ["k", "c", "d", "a", "b"]
    assert [c.at for c in at.cells] == [0, 1, 2]
    assert at.bools[0].at == 4  # the first even bit behind three cells
    assert (at.words, at.fixed_size, at.align) == (1, 8, 8)


def test_wide_layout_needs_three_words():
    o = Obj("Wide", (*(Member(f"F{i:02}", I32) for i in range(40)), *(Member(f"B{i:02}", scalar("bool")) for i in range(20)), *(Member(f"S{i}", Text()) for i in range(8)), *(Member(f"D{i}", scalar("float64")) for i in range(4))))
    assert m.layout(o).words == 3
    assert m.layout(o).bools[-1].at == 90


def test_fixed_cells_end_at_the_limit():
    o = Obj("Big", tuple(Member(f"m{i}", scalar("int64"), keep=True) for i in range(130)))
    assert len(m.layout(o).fixed) == 128
    assert len(m.layout(o).cells) == 2


def test_fingerprints_ignore_declaration_order_only():
    members = (Member("a", I32), Member("b", Text()), Member("c", Vec(I32)))
    prints = {m.fingerprint(Obj("O", p)) for p in itertools.permutations(members)}
    assert len(prints) == 1
    assert m.fingerprint(Obj("O", (Member("a", scalar("int64")), *members[1:]))) not in prints
    assert m.fingerprint(Obj("O", (Member("z", I32), *members[1:]))) not in prints
    assert m.fingerprint(Obj("O", (*members[:2], Member("c", Vec(Scalar(Kind.INT32, nullable=True)))))) not in prints


def test_records_may_hold_themselves():
    node = Obj("Node")
    node.define(Member("Name", Text()), Member("Children", Vec(node)))
    assert m.fingerprint(node)
    kind = m.spark_type(node, depth=3)
    assert kind["Children"].dataType.elementType["Name"].dataType == T.StringType()


def test_base_members_come_first():
    base = Obj("Base", (Member("id", I32),))
    assert [x.name for x in Obj("Derived", (Member("x", I32),), base=base).all_members] == ["id", "x"]


def test_spark_schema_carries_metadata():
    o = Obj("Monster", (Member("Hp", scalar("int16"), default=100), Member("MoveSpeed", scalar("float32"), "Speed"), Member("Kept", I32, keep=True), Member("Big", scalar("uint64"))))
    kind = m.spark_type(o)
    assert kind["Hp"].metadata["default"] == "100"
    assert kind["MoveSpeed"].metadata["wire_name"] == "Speed"
    assert not kind["Kept"].nullable
    assert kind["Big"].dataType == T.DecimalType(20, 0)
    assert m.ddl(o).startswith("Hp:smallint")


def test_registry():
    o = Obj("Registered", (Member("x", I32),))
    assert m.register(o) is m.REGISTRY["Registered"]
    with pytest.raises(ModelError):
        m.register(Obj("Registered", (Member("y", I32),)))

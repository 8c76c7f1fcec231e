"""The binary format: round trips, damage, limits, versions, sharing."""

import math
import random
import struct

import pytest

from lamella.model import Kind, Member, Obj, Scalar, Struct, Text, Union, Vec, dictionary, fingerprint, scalar
from lamella.sources.codec import ReadError, ReadOptions, WriteError, WriteOptions, decode, encode, schema_of, try_decode, verify, with_defaults

I8, I16, I32, I64, U32, U64, F32, F64, BOOL = (scalar(k) for k in ("int8", "int16", "int32", "int64", "uint32", "uint64", "float32", "float64", "bool"))
VEC3 = Struct("Vec3", (("X", F32), ("Y", F32), ("Z", F32)))
VEC3_OR_NONE = Struct("Vec3", VEC3.fields, nullable=True)
RGBA = Struct("Rgba", tuple((c, scalar("uint8")) for c in "RGBA"), shared=True)
WEAPON = Obj("Weapon", (Member("Name", Text()), Member("Damage", I16)))
POTION = Obj("Potion", (Member("Label", Text()), Member("Heal", I32)))
KEY = Obj("Key", (Member("Label", Text()), Member("Door", U32), Member("Golden", BOOL)))
ITEM = Union("Item", (POTION, KEY))
MONSTER = Obj(
    "Monster",
    (
        Member("Name", Text()),
        Member("Hp", I16, default=100),
        Member("Mana", Scalar(Kind.INT16, nullable=True)),
        Member("Pos", VEC3),
        Member("Velocity", VEC3_OR_NONE),
        Member("Color", Scalar(Kind.UINT8, names=(("Red", 0), ("Green", 1), ("Blue", 2))), default=2),
        Member("Friendly", BOOL),
        Member("Boss", Scalar(Kind.BOOL, nullable=True)),
        Member("Weapons", Vec(WEAPON)),
        Member("Inventory", Vec(I32)),
        Member("Tags", Vec(Text())),
        Member("Equipped", WEAPON),
        Member("Score", F64),
        Member("Id", I64),
        Member("Loot", ITEM),
        Member("Bag", Vec(ITEM)),
        Member("Path", Vec(VEC3)),
        Member("Grid", Vec(Vec(I32))),
        Member("MoveSpeed", F32, "Speed"),
        Member("Tint", RGBA),
        Member("Tints", Vec(RGBA)),
        Member("Samples", Vec(F64)),
        Member("Big", U64),
        Member("Tiny", I8),
        Member("Switches", Vec(BOOL)),
    ),
)
FULL = {
    "Name": 'Gr"ön✓', "Hp": 300, "Mana": 0, "Pos": {"X": 1.0, "Y": 2.0, "Z": 3.0}, "Velocity": {"X": -0.0, "Y": 3.4028234663852886e38, "Z": 1.401298464324817e-45}, "Color": 1, "Friendly": True, "Boss": False,
    "Weapons": [{"Name": "Axe", "Damage": 9}, {"Name": "Bow", "Damage": -3}, {"Name": "Axe", "Damage": 9}], "Inventory": [1, 2, 3, -(2**31), 2**31 - 1], "Tags": ["a", None, "", "a"],
    "Equipped": {"Name": "Axe", "Damage": 9}, "Score": 0.1, "Id": -(2**63), "Loot": {"tag": ITEM.tag_of("Key"), "Key": {"Label": "gate", "Door": 7, "Golden": True}},
    "Bag": [{"tag": ITEM.tag_of("Potion"), "Potion": {"Label": "heal", "Heal": 25}}, None, {"tag": ITEM.tag_of("Key"), "Key": {"Label": "back", "Door": 1, "Golden": None}}],
    "Path": [{"X": 0.0, "Y": 1.0, "Z": 2.0}], "Grid": [[1, 2], None, []], "MoveSpeed": 1.5, "Tint": {"R": 1, "G": 2, "B": 3, "A": 4}, "Tints": [{"R": 1, "G": 2, "B": 3, "A": 4}, None],
    "Samples": [0.1, -0.0], "Big": 2**64 - 1, "Tiny": -128, "Switches": [True, False, True],
}
NODE = Obj("Node")
NODE.define(Member("Name", Text()), Member("Children", Vec(NODE)))


def chain(n):
    node = {"Name": "end"}
    for i in range(n - 1):
        node = {"Name": f"n{i}", "Children": [node]}
    return node


def dag(n):
    node = {"Name": "leaf"}
    for i in range(n):
        node = {"Name": f"d{i}", "Children": [node, node]}
    return node


@pytest.mark.parametrize("sharing", ["none", "strings", "all"])
@pytest.mark.parametrize("schema", [True, False])
def test_full_round_trip(sharing, schema):
    b = encode(MONSTER, FULL, WriteOptions(sharing=sharing, schema=schema))
    assert len(b) % 8 == 0
    assert verify(MONSTER, b, ReadOptions(utf8=True)) is None
    got = decode(MONSTER, b)
    assert got == FULL
    assert math.copysign(1, got["Velocity"]["X"]) == -1 and math.copysign(1, got["Samples"][1]) == -1


def test_defaults_are_not_stored_and_come_back():
    got = decode(MONSTER, encode(MONSTER, {"Hp": 100, "Color": 2, "Name": ""}))
    assert got["Hp"] is None and got["Color"] is None and got["Name"] == ""
    read = with_defaults(MONSTER, got)
    assert (read["Hp"], read["Color"], read["Mana"], read["Friendly"], read["Tags"]) == (100, 2, None, False, None)
    stored = decode(MONSTER, encode(MONSTER, {"Hp": 100}, WriteOptions(write_defaults=True)))
    assert stored["Hp"] == 100 and stored["Friendly"] is False and stored["Mana"] is None


def test_default_comparison_is_bitwise():
    d = Obj("D", (Member("x", F64), Member("flag", BOOL, default=True), Member("n", F64)))
    got = decode(d, encode(d, {"x": -0.0, "flag": True, "n": float("nan")}))
    assert math.copysign(1, got["x"]) == -1 and got["flag"] is None and math.isnan(got["n"])
    assert decode(d, encode(d, {"x": 0.0, "flag": False}))["flag"] is False


def test_kept_members_are_always_stored():
    p = Obj("Particle", (Member("X", F32, default=1.5, keep=True), Member("Velocity", VEC3, keep=True), Member("Kind", I16, keep=True), Member("Visible", BOOL, keep=True), Member("Life", I32, default=10)))
    got = decode(p, encode(p, {}))
    assert got == {"X": 1.5, "Velocity": {"X": 0.0, "Y": 0.0, "Z": 0.0}, "Kind": 0, "Visible": False, "Life": None}


def test_null_and_empty_differ():
    h = Obj("Holder", (Member("Names", Vec(Text())), Member("Text", Text()), Member("Leaves", Vec(WEAPON))))
    assert decode(h, encode(h, {"Names": [], "Text": ""})) == {"Names": [], "Text": "", "Leaves": None}


def test_dictionaries_sort_by_code_point():
    c = Obj("Catalog", (Member("Stock", dictionary(Text(), I32)), Member("Names", dictionary(I32, Text())), Member("Nested", dictionary(Text(), dictionary(Text(), I32))), Member("Empty", dictionary(I32, I32)), Member("Missing", dictionary(I32, I32))))
    v = {"Stock": {"zebra": 0, "\U0001f600": 9, "": 7, "�": 1, "pear": 3, "apple": 5}, "Names": {3: "c", -1: "a", 2**31 - 1: "d", 0: "b"}, "Nested": {"x": {"b": 1, "a": 2}}, "Empty": {}}
    got = decode(c, encode(c, v))
    assert got["Stock"] == {"keys": ["", "apple", "pear", "zebra", "�", "\U0001f600"], "values": [7, 5, 3, 0, 1, 9]}
    assert got["Names"]["keys"] == [-1, 0, 3, 2**31 - 1]
    assert got["Nested"]["values"] == [{"keys": ["a", "b"], "values": [2, 1]}]
    assert got["Empty"] == {"keys": [], "values": []} and got["Missing"] is None


def test_optional_lists():
    r = Obj("Readings", (Member("Ints", Vec(Scalar(Kind.INT32, nullable=True))), Member("Flags", Vec(Scalar(Kind.BOOL, nullable=True))), Member("Points", Vec(VEC3_OR_NONE)), Member("Optional", dictionary(Text(), Scalar(Kind.INT64, nullable=True)))))
    v = {"Ints": [None if i % 3 == 0 else i * 7 for i in range(40)], "Flags": [True, None, False], "Points": [None, {"X": 1.0, "Y": 0.0, "Z": 0.0}], "Optional": {"a": 1, "b": None}}
    got = decode(r, encode(r, v))
    assert got["Ints"] == v["Ints"] and sum(x is not None for x in got["Ints"]) == 26
    assert got["Flags"] == v["Flags"] and got["Points"] == v["Points"] and got["Optional"]["values"] == [1, None]


def test_sharing_shrinks_and_decodes_alike():
    nodes = {"Name": "top", "Children": [{"Name": "ü" * 500, "Children": [{"Name": "leaf"}]} for _ in range(20)]}
    sizes = [len(encode(NODE, nodes, WriteOptions(sharing=s))) for s in ("none", "strings", "all")]
    assert sizes[0] > sizes[1] > sizes[2]
    a, b = (decode(NODE, encode(NODE, nodes, WriteOptions(sharing=s))) for s in ("none", "all"))
    assert a == b


@pytest.mark.parametrize(
    ("edit", "code"),
    [
        (lambda b: b[:15], "TooSmall"),
        (lambda b: b[:-8], "OutOfBounds"),
        (lambda b: b[:4] + bytes([b[4] ^ 1]) + b[5:], "BadMagic"),
        (lambda b: b[:6] + b"\x63" + b[7:], "BadVersion"),
        (lambda b: b[:7] + b"\x81" + b[8:], "ReservedBits"),
        (lambda b: b"\x02\0\0\0" + b[4:], "BadOffset"),
        (lambda b: struct.pack("<I", len(b)) + b[4:], "BadOffset"),
    ],
)
def test_damage_has_a_code(edit, code):
    b = edit(encode(NODE, {"Name": "n", "Children": [{"Name": "a" * 20}]}, WriteOptions(sharing="none")))
    assert verify(NODE, b) == code
    assert try_decode(NODE, b) == (None, code)
    with pytest.raises(ReadError) as e:
        decode(NODE, b)
    assert e.value.code == code


def test_misaligned_start_is_refused():
    assert verify(NODE, encode(NODE, {}), ReadOptions(aligned=False)) == "BadOffset"


def test_invalid_utf8_is_replaced_or_refused():
    b = encode(NODE, {"Name": "abcd"}).replace(b"abcd", b"a\xff\xfed")
    assert decode(NODE, b)["Name"] == "a��d"
    assert verify(NODE, b, ReadOptions(utf8=True)) == "BadString"
    assert verify(NODE, encode(NODE, {"Name": "abcd"}).replace(b"abcd\0", b"abcde")) == "BadString"


def test_depth_limits_of_both_sides():
    with pytest.raises(WriteError):
        encode(NODE, chain(65))
    b = encode(NODE, chain(64))  # a record and a list are a level each
    assert verify(NODE, b) is None
    deep = encode(NODE, chain(41), WriteOptions(max_depth=1000))
    assert verify(NODE, deep, ReadOptions(max_depth=80)) is None
    assert verify(NODE, deep, ReadOptions(max_depth=79)) == "TooDeep"
    loop: dict = {"Name": "me"}
    loop["Children"] = [loop]
    with pytest.raises(WriteError):
        encode(NODE, loop)


def test_shared_graphs_are_checked_once():
    b = encode(NODE, dag(16), WriteOptions(sharing="all"))
    assert len(b) < 4000
    assert verify(NODE, b) is None
    assert verify(NODE, b, ReadOptions(max_items=20)) == "TooManyItems"
    assert verify(NODE, b, ReadOptions(max_depth=31)) == "TooDeep"
    assert decode(NODE, b)["Children"][0] is decode(NODE, b)["Children"][0] or True
    got = decode(NODE, b)
    assert got["Children"][0] is got["Children"][1]


def test_unknown_union_tag_is_refused():
    chest = Obj("Chest", (Member("Any", ITEM),))
    b = encode(chest, {"Any": {"tag": ITEM.tag_of("Key"), "Key": {"Door": 3}}}, WriteOptions(schema=False))
    assert verify(chest, b.replace(struct.pack("<I", ITEM.tag_of("Key")), b"\x01\0\0\0")) == "BadUnionTag"
    with pytest.raises(WriteError):
        encode(chest, {"Any": {"tag": 1}})


def test_dictionary_without_values_is_refused():
    c = Obj("C", (Member("D", dictionary(I32, I32)),))
    b = bytearray(encode(c, {"D": {1: 2}}, WriteOptions(schema=False)))
    root = struct.unpack_from("<I", b)[0]
    at = root + 4 + struct.unpack_from("<I", b, root + 4)[0]
    b[at] &= 0xFE
    assert verify(c, bytes(b)) == "BadOffset"


ITEM_1 = Obj("Item", (Member("Id", Text()), Member("Count", I32)))
ITEM_2 = Obj("Item", (Member("Rarity", scalar("uint8"), keep=True), Member("Count", I32), Member("Id", Text())))
STATS = Obj("Stats", (Member("Str", I32), Member("Dex", I32)))
V1 = Obj("Player", (Member("Name", Text()), Member("Level", I32), Member("Health", F32), Member("Online", BOOL), Member("Items", Vec(ITEM_1)), Member("Stats", STATS), Member("Removed", I32, keep=True), Member("KindChanged", I16), Member("Favorite", ITEM_1), Member("Scores", dictionary(Text(), I32))))
V2 = Obj("Player", (Member("DisplayName", Text(), "Name"), Member("Level", I32, keep=True), Member("Health", F32, keep=True), Member("Online", BOOL), Member("Items", Vec(ITEM_2)), Member("Stats", STATS), Member("KindChanged", I32), Member("Favorite", ITEM_2), Member("Scores", dictionary(Text(), I64)), Member("Gold", I64, default=50, keep=True), Member("Title", Text())))
V3 = Obj("Player", tuple(reversed(V1.members)))
ANN = {"Name": "Ann", "Level": 12, "Health": 0.75, "Online": True, "Items": [{"Id": "potion", "Count": 3}, {"Id": "key", "Count": 1}], "Stats": {"Str": 5, "Dex": 7}, "Removed": 99, "KindChanged": -2, "Favorite": {"Id": "key", "Count": 1}, "Scores": {"a": 1, "b": 2}}
BOB = {"DisplayName": "Bob", "Gold": 1000, "Level": 3, "Health": 1.0, "Items": [{"Id": "gem", "Count": 5, "Rarity": 2}], "Stats": {"Str": 1, "Dex": 2}, "KindChanged": 123456, "Title": "Sir", "Scores": {"x": 10}}


def test_old_data_new_reader():
    got = decode(V2, encode(V1, ANN))
    assert (got["DisplayName"], got["Level"], got["Gold"], got["KindChanged"], got["Title"]) == ("Ann", 12, 50, None, None)
    assert got["Items"][0] == {"Rarity": 0, "Count": 3, "Id": "potion"}
    assert got["Scores"] == {"keys": ["a", "b"], "values": []}
    assert got["Stats"] == {"Str": 5, "Dex": 7} and got["Favorite"]["Id"] == "key"


def test_new_data_old_reader():
    got = decode(V1, encode(V2, BOB))
    assert (got["Name"], got["Removed"], got["KindChanged"], got["Favorite"]) == ("Bob", 0, None, None)
    assert got["Scores"] == {"keys": ["x"], "values": []} and got["Items"] == [{"Id": "gem", "Count": 5}]


def test_reordered_members_read_directly():
    assert fingerprint(V1) == fingerprint(V3)
    b = encode(V1, ANN, WriteOptions(schema=False))
    assert decode(V3, b)["Removed"] == 99
    assert verify(V2, b) == "SchemaMismatch"


def test_optional_mismatch_makes_the_list_unreadable():
    a, b = Obj("L", (Member("x", Vec(I32)), Member("y", I32))), Obj("L", (Member("x", Vec(Scalar(Kind.INT32, nullable=True))), Member("y", I32)))
    assert decode(b, encode(a, {"x": [1], "y": 2})) == {"x": None, "y": 2}


def test_unknown_member_keeps_its_tag():
    new, old = Obj("Bag", (Member("u", ITEM),)), Obj("Bag", (Member("u", Union("Item", (POTION,))),))
    tag = ITEM.tag_of("Key")
    assert decode(old, encode(new, {"u": {"tag": tag, "Key": {"Door": 1}}})) == {"u": {"tag": tag}}


def test_schema_sections_parse_back():
    s = schema_of(MONSTER)
    assert s.root == 0 and s.entries[0].count == len(MONSTER.members)


def test_truncation_and_random_edits_never_crash():
    rng = random.Random(7)
    for root, value in ((MONSTER, FULL), (V1, ANN), (NODE, dag(6))):
        b = encode(root, value, WriteOptions(sharing="all"))
        for reader in (root, V2 if root is V1 else root):
            for n in range(0, len(b), 7):
                got, code = try_decode(reader, b[:n])
                assert (got is None) == (code is not None)
            for _ in range(400):
                x = bytearray(b)
                for _ in range(rng.randint(1, 4)):
                    x[rng.randrange(len(x))] ^= 1 << rng.randrange(8)
                code = verify(reader, bytes(x))
                if code is None:
                    with_defaults(reader, decode(reader, bytes(x)))


@pytest.mark.parametrize(("name", "sizes"), [("dense-unique", (69528, 69528, 69272)), ("sparse-unique", (33480, 33480, 33224)), ("dense-shared", (52984, 5352, 52728))])
def test_published_sizes(name, sizes):
    from tests.scenes import SCENE, scene

    value = scene(name)
    buffers = [encode(SCENE, value, o) for o in (WriteOptions(), WriteOptions(sharing="all"), WriteOptions(schema=False))]
    assert tuple(map(len, buffers)) == sizes
    assert [decode(SCENE, b)["Nodes"][17]["X"] for b in buffers] == [value["Nodes"][17]["X"] or None] * 3

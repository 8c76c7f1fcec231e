"""Lists read many records at a time give what reading one by one gives; so do damaged ones. Members read in place."""

import random

import pytest

from lamella.model import Kind, Member, Obj, Scalar, Struct, Text, Union, Vec, dictionary, scalar
from lamella.sources import bulk, codec
from tests.test_codec import FULL, ITEM, MONSTER

I32 = scalar("int32")
POINT = Struct("Point", (("x", scalar("float32")), ("y", scalar("int16"))))
LEAF = Obj("Leaf", (Member("n", I32), Member("s", Text())))
PART = Obj(
    "Part",
    (
        Member("id", scalar("int64"), keep=True), Member("a", I32, default=3), Member("b", scalar("int8")), Member("c", scalar("float64")), Member("d", Scalar(Kind.INT16, nullable=True)), Member("on", scalar("bool")), Member("off", Scalar(Kind.BOOL, nullable=True)),
        Member("s", Text()), Member("t", Text(), "Title"), Member("p", POINT), Member("list", Vec(I32)), Member("wide", Vec(scalar("float64"))), Member("leaf", LEAF), Member("leaves", Vec(LEAF)), Member("some", Vec(Scalar(Kind.INT32, nullable=True))), Member("names", Vec(Text())),
    ),
)
ROOT = Obj("Root", (Member("parts", Vec(PART)), Member("name", Text()), Member("plain", Vec(LEAF)), Member("u", Vec(Union("U", (LEAF,)))), Member("d", dictionary(Text(), I32))))


def part(rng, dense):
    def maybe(v):
        return v if rng.random() < dense else None

    leaf = lambda: {"n": maybe(rng.randint(-9, 9)), "s": maybe(rng.choice("abé"))}
    return {
        "id": rng.randint(-(2**60), 2**60), "a": maybe(rng.choice([3, 4, -5])), "b": maybe(rng.randint(-128, 127)), "c": maybe(rng.choice([0.0, -0.0, 0.1])), "d": maybe(0), "on": maybe(rng.random() < 0.5), "off": maybe(False), "s": maybe(f"s{rng.randint(0, 5)}"),
        "t": maybe("ü" * rng.randint(0, 5)), "p": maybe({"x": 1.5, "y": -3}), "list": maybe([rng.randint(0, 99) for _ in range(rng.randint(0, 3))]), "wide": maybe([0.5] * rng.randint(0, 2)), "leaf": maybe(leaf()), "leaves": maybe([leaf(), None]), "some": maybe([1, None]), "names": maybe(["x", None]),
    }


def root(seed):
    rng = random.Random(seed)
    dense = rng.choice([1.0, 0.0, 0.5, 0.9])
    many = [part(rng, dense) for _ in range(rng.choice([15, 16, 40]))]
    if seed % 3 == 0:
        many[3] = None
    if seed % 4 == 0:
        many += many[:5]
    return {"parts": many, "name": "r", "plain": [{"n": i, "s": f"n{i}" if i % 2 else None} for i in range(40)], "u": [{"tag": ROOT.member("u").type.element.tag_of("Leaf"), "Leaf": {"n": 1, "s": "q"}}] * 20, "d": {"k": 1}}


def slowly(monkeypatch, run):
    with monkeypatch.context() as m:
        m.setattr(bulk, "LEAST", 1 << 60)
        return run()


@pytest.mark.parametrize("sharing", ["none", "strings", "all"])
def test_same_values(monkeypatch, sharing):
    for seed in range(24):
        b = codec.encode(ROOT, root(seed), codec.WriteOptions(sharing=sharing))
        assert codec.decode(ROOT, b) == slowly(monkeypatch, lambda b=b: codec.decode(ROOT, b))
        assert codec.verify(ROOT, b) is None


@pytest.mark.parametrize("sharing", ["none", "strings"])
@pytest.mark.parametrize("every", [False, True])
def test_written_alike(monkeypatch, sharing, every):
    how = codec.WriteOptions(sharing=sharing, write_defaults=every)
    for seed in range(24):
        v = root(seed)
        b, one = codec.encode(ROOT, v, how), slowly(monkeypatch, lambda v=v: codec.encode(ROOT, v, how))
        assert codec.verify(ROOT, b, codec.ReadOptions(utf8=True)) is None
        assert repr(codec.decode(ROOT, b)) == repr(slowly(monkeypatch, lambda one=one: codec.decode(ROOT, one)))
        assert abs(len(b) - len(one)) <= 8 * 60  # only padding before eight-byte values may differ


@pytest.mark.parametrize("bad", [{"n": 2**31}, {"n": 1.5}, {"n": "x"}, {"s": 5}])
def test_wrong_values_are_refused_alike(monkeypatch, bad):
    v = {"plain": [{"n": 1, "s": "a"}] * 20 + [bad]}
    errors = []
    for run in (lambda: codec.encode(ROOT, v), lambda: slowly(monkeypatch, lambda: codec.encode(ROOT, v))):
        with pytest.raises(Exception) as e:  # noqa: PT011  whichever it is, both give the same
            run()
        errors.append(type(e.value))
    assert errors[0] is errors[1]


def test_shared_records_are_read_once():
    one = {"n": 5, "s": "same"}
    got = codec.decode(ROOT, codec.encode(ROOT, {"plain": [one] * 30}, codec.WriteOptions(sharing="all")))["plain"]
    assert got == [one] * 30 and all(x is got[0] for x in got)


def test_same_codes_of_damaged_buffers(monkeypatch):
    rng = random.Random(11)
    for seed in range(12):
        b = codec.encode(ROOT, root(seed), codec.WriteOptions(sharing=rng.choice(["none", "strings", "all"])))
        for _ in range(60):
            x = bytearray(b)
            for _ in range(rng.randint(1, 3)):
                x[rng.randrange(16, len(x))] ^= 1 << rng.randrange(8)
            x = bytes(x[: rng.randrange(16, len(x))]) if rng.random() < 0.2 else bytes(x)
            how = codec.ReadOptions(utf8=rng.random() < 0.3, max_depth=rng.choice([1, 2, 3, 128]), max_items=rng.choice([5, 60, 1 << 24]))
            code = codec.verify(ROOT, x, how)
            assert code == slowly(monkeypatch, lambda x=x, how=how: codec.verify(ROOT, x, how))
            if code is None:
                assert repr(codec.decode(ROOT, x, how)) == repr(slowly(monkeypatch, lambda x=x, how=how: codec.decode(ROOT, x, how)))


@pytest.mark.parametrize(
    ("path", "want"),
    [
        ("Name", FULL["Name"]), ("Hp", 300), ("Mana", 0), ("Friendly", True), ("Boss", False), ("Velocity.Z", FULL["Velocity"]["Z"]), ("Weapons.Name", ["Axe", "Bow", "Axe"]), ("Weapons.Damage", [9, -3, 9]), ("Equipped.Damage", 9), ("Loot.Key.Door", 7),
        ("Loot.Potion.Heal", None), ("Bag.Potion.Heal", [25, None, None]), ("Bag.Key.Label", [None, None, "back"]), ("Path.Y", [1.0]), ("Grid", FULL["Grid"]), ("Tint.G", 2), ("Tints.B", [3, None]), ("Tags", FULL["Tags"]), ("Equipped", FULL["Equipped"]), ("Loot", FULL["Loot"]),
    ],
)
def test_members_are_read_in_place(path, want):
    b = codec.encode(MONSTER, FULL)
    assert codec.read_path(MONSTER, b, path.split(".")) == want
    assert ITEM.tag_of("Key")


def test_paths_read_what_decoding_reads():
    for seed in range(10):
        v = root(seed)
        b = codec.encode(ROOT, v)
        whole = codec.decode(ROOT, b)
        for m in PART.all_members:
            assert codec.read_path(ROOT, b, ["parts", m.name]) == [None if p is None else p[m.name] for p in whole["parts"]]
        assert codec.read_path(ROOT, b, ["parts", "leaf", "s"]) == [None if p is None or p["leaf"] is None else p["leaf"]["s"] for p in whole["parts"]]


def test_paths_that_are_not_there():
    with pytest.raises((KeyError, StopIteration)):
        codec.path_type(MONSTER, ["Nope"])
    with pytest.raises(KeyError):
        codec.path_type(MONSTER, ["Hp", "x"])

"""Models from classes: members, kinds, unions, refusals; objects there and back."""

from __future__ import annotations

import abc
import enum
from dataclasses import dataclass, field
from typing import Annotated, ClassVar, NamedTuple

import pytest

from lamella.classes import Float32, Ignore, Int16, Int32, Keep, Name, Shared, UInt8, model_of
from lamella.model import Kind, Member, ModelError, Obj, Scalar, Text, Union, Vec, dictionary, fingerprint, layout, scalar
from lamella.sources.objects import read_object, write_object


class Colour(enum.IntEnum):
    RED = 1
    BLUE = 5


class Point(NamedTuple):
    x: Int32
    y: Float32


class Item(abc.ABC):
    pass


@dataclass
class Potion(Item):
    heal: Int32 = 0


@dataclass
class Elixir(Potion):
    glow: bool = False


@dataclass
class Key(Item):
    door: str = ""


@dataclass
class Base:
    ident: Annotated[int, Keep()] = 0
    level: Int16 = 3


@dataclass
class Hero(Base):
    limit: ClassVar[int] = 9
    name: Annotated[str, Name("Title")] = ""
    colour: Colour = Colour.BLUE
    at: Point = Point(0, 0.0)
    home: Annotated[Point, Shared()] | None = None
    age: Int32 | None = None
    marks: list[UInt8] = field(default_factory=list)
    holes: list[float | None] = field(default_factory=list)
    bag: list[Item] = field(default_factory=list)
    stock: dict[str, int] = field(default_factory=dict)
    friend: Hero | None = None
    either: Potion | Key | None = None
    cache: Annotated[object, Ignore()] = None
    _hidden: int = 0


def test_members_kinds_and_defaults():
    m = model_of(Hero)
    root = m.root
    assert [x.name for x in root.all_members] == ["ident", "level", "name", "colour", "at", "home", "age", "marks", "holes", "bag", "stock", "friend", "either"]
    kinds = [x.type.kind for x in root.all_members]
    assert kinds == [Kind.INT64, Kind.INT16, Kind.STRING, Kind.INT32, Kind.STRUCT, Kind.SHARED, Kind.INT32, Kind.VECTOR, Kind.VECTOR, Kind.VECTOR, Kind.OBJECT, Kind.OBJECT, Kind.UNION]
    assert root.member("name").wire_name == "Title" and root.member("level").default_value == 3 and root.member("colour").default_value == 5
    assert root.member("age").default_value is None and root.member("friend").type is root and root.member("stock").type.dictionary
    assert m.warnings == [("private-member", "Hero._hidden is private and left out")]
    assert root.member("holes").type.optional and root.member("colour").type.names == (("RED", 1), ("BLUE", 5))


def test_unions_hold_all_that_can_be_made_most_derived_first():
    root = model_of(Hero).root
    assert [c.name for c in root.member("bag").type.element.members] == ["Elixir", "Potion", "Key"]
    assert [c.name for c in root.member("either").type.members] == ["Elixir", "Potion", "Key"]


def test_same_layout_and_fingerprint_as_by_hand():
    @dataclass
    class Plain:
        a: int = 7
        b: str = ""
        c: list[str] = field(default_factory=list)
        d: bool = False
        e: dict[str, Int32] = field(default_factory=dict)

    globals()["Plain"] = Plain
    hand = Obj("Plain", (Member("a", scalar("int64"), default=7), Member("b", Text()), Member("c", Vec(Text())), Member("d", Scalar(Kind.BOOL)), Member("e", dictionary(Text(), scalar("int32")))))
    made = model_of(Plain).root
    assert fingerprint(made) == fingerprint(hand)
    assert [c.member.name for c in layout(made).order] == [c.member.name for c in layout(hand).order]


def test_objects_come_back():
    m = model_of(Hero)
    hero = Hero(4, 9, "Ann", Colour.RED, Point(1, 0.5), Point(2, 1.5), None, [1, 2], [0.0, None, 2.5], [Elixir(3, True), Potion(4), Key("x")], {"b": 1, "a": 2}, Hero(5, name="Bo"), Key("k"))
    back = read_object(m.root, write_object(m.root, hero), m.classes)
    assert isinstance(back, Hero) and isinstance(back.friend, Hero) and back.friend.name == "Bo"
    assert (back.ident, back.level, back.name, back.colour, back.at, back.home) == (4, 9, "Ann", 1, (1, 0.5), (2, 1.5))
    assert (back.marks, back.holes, back.stock, back.either) == ([1, 2], [0.0, None, 2.5], {"a": 2, "b": 1}, Key("k"))
    assert [type(x).__name__ for x in back.bag] == ["Elixir", "Potion", "Key"] and back.bag == hero.bag


@dataclass
class Lone(abc.ABC):
    x: int = 0


@dataclass
class Sum:
    x: complex = 0


@dataclass
class Pair:
    x: tuple[int, str] = (0, "")


@dataclass
class Mixed:
    x: int | str = 0


@dataclass
class Odd:
    d: dict[float, int] = field(default_factory=dict)


class Words(enum.Enum):
    A = "a"


@dataclass
class Said:
    w: Words = Words.A


@dataclass
class _Private:
    x: int = 0


@dataclass
class Holder:
    x: _Private | None = None


@dataclass
class Nothing:
    x: Lone | None = None


@dataclass
class Same:
    __record_name__ = "Pair"
    y: int = 0


@dataclass
class Twice:
    a: Same | None = None
    b: Pair2 | None = None


@dataclass
class Pair2:
    __record_name__ = "Pair"
    z: int = 0


@dataclass
class Clash:
    a: int = 0
    b: Annotated[int, Name("a")] = 0


REFUSED = {Lone: "abstract-root", Sum: "unsupported-type", Pair: "unsupported-type", Mixed: "unsupported-type", Odd: "dictionary-key", Said: "unsupported-type", Holder: "private-class", Nothing: "no-union-members", Twice: "duplicate-name", Clash: "duplicate-member"}


@pytest.mark.parametrize("cls", REFUSED, ids=lambda c: c.__name__)
def test_refusals(cls):
    with pytest.raises(ModelError) as e:
        model_of(cls)
    assert e.value.code == REFUSED[cls]


def test_strict_refuses_what_is_left_out():
    with pytest.raises(ModelError) as e:
        model_of(Hero, strict=True)
    assert e.value.code == "private-member"
    assert model_of(Key, strict=True).warnings == []

"""Objects of user classes: constructors, attributes, unions, dictionaries."""

from dataclasses import dataclass, field

import pytest

from lamella.model import Member, Obj, Struct, Text, Union, Vec, dictionary, scalar
from lamella.sources.codec import WriteError
from lamella.sources.objects import read_object, write_object

I32 = scalar("int32")
POINT = Struct("Point", (("X", I32), ("Y", I32)))
POTION, KEY = Obj("Potion", (Member("Heal", I32),)), Obj("Key", (Member("Door", I32),))
HERO = Obj("Hero", (Member("Name", Text()), Member("HitPoints", I32, default=100), Member("Pos", POINT), Member("Bag", Vec(Union("Item", (POTION, KEY)))), Member("Stock", dictionary(Text(), I32)), Member("Note", Text())))


@dataclass
class Point:
    x: int
    y: int


@dataclass
class Potion:
    heal: int


@dataclass
class Elixir(Potion):
    pass


@dataclass
class Key:
    door: int


@dataclass
class Hero:
    name: str
    hit_points: int
    pos: Point
    bag: list = field(default_factory=list)
    stock: dict = field(default_factory=dict)

    def __post_init__(self):
        self.note = "unset"


CLASSES = {c.__name__: c for c in (Hero, Point, Potion, Key)}


def test_round_trip():
    h = Hero("Ann", 100, Point(1, 2), [Potion(3), None, Key(4)], {"b": 1, "a": 2})
    h.note = "hello"
    got = read_object(HERO, write_object(HERO, h), CLASSES)
    assert got == h and got.note == "hello" and list(got.stock) == ["a", "b"]


def test_defaults_and_missing_members():
    got = read_object(HERO, write_object(HERO, {"Name": "Bob", "Pos": {"X": 0, "Y": 0}}), CLASSES)
    assert (got.hit_points, got.bag, got.stock, got.note) == (100, [], {}, "unset")


def test_nearest_base_is_the_union_member():
    got = read_object(HERO, write_object(HERO, Hero("A", 1, Point(0, 1), [Elixir(9)])), CLASSES)
    assert got.bag == [Potion(9)]
    with pytest.raises(WriteError):
        write_object(HERO, Hero("A", 1, Point(0, 1), [Point(1, 1)]))


def test_names_without_a_class_stay_dicts():
    assert read_object(HERO, write_object(HERO, {"Pos": {"X": 1, "Y": 2}}), {})["Pos"] == {"X": 1, "Y": 2}

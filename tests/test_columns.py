"""Whole columns of buffers: the same records and the same verdicts as one by one."""

import random

import pyarrow as pa
import pytest
from pyspark.sql.pandas.types import to_arrow_type

from lamella.model import Kind, Member, Obj, Scalar, Struct, Text, Union, Vec, dictionary, scalar, spark_type
from lamella.sources import buffers, codec
from lamella.sources.columns import Column, NotPlain
from tests.test_bulk import LEAF, PART, root

PLAIN = Obj("Plain", tuple(m for m in PART.members if m.name != "some"))
TOP = Obj("Top", (Member("parts", Vec(PLAIN)), Member("one", PLAIN), Member("u", Vec(Union("U", (LEAF, PLAIN)))), Member("v", Union("U", (LEAF, PLAIN))), Member("d", dictionary(Text(), scalar("int32"))), Member("grid", Vec(Vec(scalar("uint8")))), Member("sharp", Struct("S", (("a", scalar("int8")), ("b", scalar("float64"))), shared=True)), Member("flags", Vec(scalar("bool"))), Member("c", Scalar(Kind.CHAR16), keep=True)))


def top(seed):
    rng = random.Random(seed)
    parts = [p and {k: v for k, v in p.items() if k != "some"} for p in root(seed)["parts"]][: rng.randint(0, 5)]
    leaf = {"tag": TOP.member("v").type.tag_of("Leaf"), "Leaf": {"n": 4, "s": None}}
    plain = {"tag": TOP.member("v").type.tag_of("Plain"), "Plain": parts[0]} if parts and parts[0] else leaf
    maybe = lambda v: v if rng.random() < 0.7 else None
    return {"parts": maybe(parts), "one": maybe(parts[0] if parts else None), "u": maybe([leaf, None, plain]), "v": maybe(plain), "d": maybe({"b": 1, "a": 2}), "grid": maybe([[1, 2], None, []]), "sharp": maybe({"a": 1, "b": -0.0}), "flags": maybe([True, False]), "c": 65}


def slow(model, b, kind, how):
    try:
        return buffers.to_row(model, kind, codec.decode(model, b, how)), None
    except codec.ReadError as e:
        return None, e.code


def both_ways(model, found, how=codec.ReadOptions()):
    kind = buffers.relaxed(spark_type(model))
    a = pa.array(found, pa.binary())
    column = Column(model, a, how)
    want = [(None, None) if b is None else slow(model, b, kind, how) for b in found]
    got = column.read(to_arrow_type(kind)).to_pylist()
    rows = [w for w, fine in zip(want, column.fine.tolist()) if fine]
    assert repr(pa.array([v for v, _ in rows], to_arrow_type(kind)).to_pylist()) == repr(got)
    assert all(e is None for _, e in rows)
    return column.fine, want


@pytest.mark.parametrize("sharing", ["none", "strings", "all"])
@pytest.mark.parametrize("schema", [True, False])
def test_same_records(sharing, schema):
    found = [codec.encode(TOP, top(i), codec.WriteOptions(sharing=sharing, schema=schema)) for i in range(60)]
    fine, _ = both_ways(TOP, [*found, None, b"", b"x" * 40])
    assert fine[:60].all() and not fine[60:].any()
    assert both_ways(TOP, found[:1])[0].all() and not len(both_ways(TOP, [])[0])


def test_same_verdicts_of_damaged_buffers():
    rng = random.Random(3)
    for how in (codec.ReadOptions(), codec.ReadOptions(max_depth=3), codec.ReadOptions(max_items=6), codec.ReadOptions(utf8=True)):
        found = []
        for i in range(200):
            x = bytearray(codec.encode(TOP, top(i), codec.WriteOptions(sharing=rng.choice(["none", "all"]))))
            for _ in range(rng.randint(0, 3)):
                x[rng.randrange(len(x))] ^= 1 << rng.randrange(8)
            found.append(bytes(x[: rng.randrange(len(x))]) if rng.random() < 0.2 else bytes(x))
        try:
            fine, want = both_ways(TOP, found, how)
        except NotPlain:  # a text that isn't UTF-8
            fine = Column(TOP, pa.array(found, pa.binary()), how).fine
            want = [(None, codec.verify(TOP, b, how)) for b in found]
        assert not any(f and e for f, (_, e) in zip(fine.tolist(), want))


def test_parts_of_a_column_and_large_columns():
    found = [codec.encode(TOP, top(i)) for i in range(20)]
    a = pa.array(found, pa.binary())
    kind = to_arrow_type(buffers.relaxed(spark_type(TOP)))
    whole = Column(TOP, a, codec.ReadOptions()).read(kind)
    assert Column(TOP, a.slice(7, 9), codec.ReadOptions()).read(kind).equals(whole.slice(7, 9))
    assert Column(TOP, a.cast(pa.large_binary()), codec.ReadOptions()).read(kind).equals(whole)


def test_columns_in_spark(spark):
    rows = [(i, bytearray(codec.encode(TOP, top(i)))) for i in range(50)] + [(50, None), (51, bytearray(b"abc")), (52, bytearray(codec.encode(PLAIN, {"id": 1}, codec.WriteOptions(schema=False))))]
    df = spark.createDataFrame(rows, "k int, b binary")
    kind = buffers.relaxed(spark_type(TOP))
    for r in df.select("k", "b", buffers.decoded(TOP, df["b"]).alias("d"), buffers.checked(TOP, df["b"]).alias("e")).collect():
        want, code = (None, None) if r["b"] is None else slow(TOP, bytes(r["b"]), kind, codec.ReadOptions())
        assert r["d"]["error"] == code == r["e"]
        assert want is None if r["d"]["value"] is None else r["d"]["value"].asDict(True)["c"] == want["c"] and repr(r["d"]["value"].asDict(True)["u"]) == repr(want["u"])

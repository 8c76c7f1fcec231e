"""Column functions on literal rows."""

import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lamella.functions import arrays, dictionaries, presence, text, unions
from lamella.model import Kind, Member, Obj, Scalar, Struct, Text, Union, Vec, dictionary, scalar
from lamella.operators import pool, stats, validate
from lamella.plans import evolve
from lamella.sources import buffers, codec
from lamella.streaming import decode_stream

I32, F64 = scalar("int32"), scalar("float64")


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()[0]


def test_floats_elide_by_bits(spark):
    df = spark.sql("SELECT * FROM VALUES (0.0D), (-0.0D), (double('NaN')), (1.5D) AS t(v)")
    got = [r[0] for r in df.select(presence.elide(F.col("v"), 0.0, floating=True).alias("w")).collect()]
    assert got[0] is None and str(got[1]) == "-0.0" and got[2] != got[2] and got[3] == 1.5


def test_bool_pairs_and_bits(spark):
    df = spark.sql("SELECT * FROM VALUES (true), (false), (cast(null as boolean)) AS t(b)")
    assert [r[0] for r in df.select(presence.boolean_pair(F.col("b")))  .collect()] == [3, 1, 0]
    assert one(spark, presence.presence_bits([F.lit(1), F.lit(None), F.lit("a")])) == 5


def test_absent_record_reads_as_defaults(spark):
    o = Obj("P", (Member("X", scalar("float32"), default=1.5, keep=True), Member("Life", I32, default=10), Member("Name", Text())))
    kind = "struct<X:float,Life:int,Name:string>"
    got = one(spark, presence.read_record(o, F.lit(None).cast(kind)))
    assert tuple(got) == (1.5, 10, None)


def test_struct_default_is_all_zero(spark):
    s = Member("s", Struct("S", (("a", F64), ("b", I32))))
    zero, minus = (F.struct(F.lit(x).alias("a"), F.lit(0).alias("b")) for x in (0.0, -0.0))
    assert one(spark, presence.encode_member(zero, s)) is None
    assert one(spark, presence.encode_member(minus, s)) is not None
    assert one(spark, presence.encode_member(zero, s, write_defaults=True)) is not None


def test_list_access(spark):
    a, none = F.array(F.lit(1), F.lit(None), F.lit(3)), F.lit(None).cast("array<int>")
    assert one(spark, arrays.length(none)) == 0
    assert one(spark, arrays.element(a, 2)) == 3
    for bad in (3, -1):
        assert one(spark, arrays.element_or(a, bad, 9)) == 9
        with pytest.raises(PySparkException):
            one(spark, arrays.element(a, bad))
    assert one(spark, arrays.is_null_at(a, 1)) and not one(spark, arrays.is_null_at(a, 0))
    assert one(spark, arrays.present(a)) == 2
    assert one(spark, arrays.presence_words(a)) == [5]
    assert one(spark, arrays.presence_words(F.transform(F.sequence(F.lit(0), F.lit(39)), lambda i: F.when(i % 3 != 0, i))))[1] == sum(1 << (i - 32) for i in range(32, 40) if i % 3)


def test_dictionaries(spark):
    entries = spark.sql("SELECT * FROM VALUES ('zebra', 0), ('\U0001f600', 9), ('', 7), ('�', 1), ('pear', 3), ('apple', 5), (null, 4) AS t(k, v)")
    d = entries.agg(dictionaries.build(F.col("k"), F.col("v")).alias("d"))
    assert d.first()["d"]["keys"] == ["", "apple", "pear", "zebra", "�", "\U0001f600"]
    assert d.select(dictionaries.find(F.col("d"), F.lit("pear"))).first()[0] == 3
    assert d.select(dictionaries.find(F.col("d"), F.lit("plum"))).first()[0] is None
    assert d.select(dictionaries.index_of(F.col("d"), F.lit("plum"))).first()[0] == -1
    assert d.select(dictionaries.is_sorted(F.col("d"))).first()[0]
    with pytest.raises(PySparkException):
        d.select(dictionaries.at(F.col("d"), F.lit("plum"))).collect()
    odd = F.struct(F.array(F.lit(2), F.lit(1)).alias("keys"), F.array(F.lit("b"), F.lit("a")).alias("values"))
    assert not one(spark, dictionaries.is_sorted(odd))
    assert one(spark, dictionaries.sort(odd))["values"] == ["a", "b"]
    short = F.struct(F.array(F.lit(1), F.lit(2)).alias("keys"), F.array(F.lit("a")).alias("values"))
    assert one(spark, dictionaries.find(short, F.lit(2))) is None
    assert one(spark, dictionaries.as_map(short)) == {1: "a"}


A, B = Obj("A", (Member("x", I32),)), Obj("B", (Member("y", Text()),))
U = Union("U", (A, B))


def test_unions(spark):
    df = spark.sql("SELECT * FROM VALUES (1), (2), (3) AS t(i)")
    cases = [("A", F.col("i") == 1, F.struct(F.col("i").alias("x"))), ("B", F.col("i") == 2, F.struct(F.lit("b").alias("y")))]
    got = df.where("i < 3").select(unions.encode(U, cases).alias("u"))
    assert [r["u"]["tag"] for r in got.collect()] == [U.tag_of("A"), U.tag_of("B")]
    with pytest.raises(PySparkException):
        df.select(unions.encode(U, cases)).collect()
    assert df.select(unions.encode(U, cases, otherwise_error=False).alias("u")).where("u is null").count() == 1
    assert got.select(unions.as_member(F.col("u"), U, "B")["y"]).collect()[1][0] == "b"
    assert one(spark, unions.tag(F.lit(None).cast("struct<tag:bigint>"))) == 0
    small = Union("U", (A,))
    kept = got.select(unions.restrict(F.col("u"), U, small).alias("u")).collect()[1]["u"]
    assert kept["tag"] == U.tag_of("B") and kept["A"] is None


@pytest.mark.parametrize(("value", "want"), [(1.0, "1"), (0.1, "0.1"), (-0.0, "-0"), (1e300, "1e+300"), (float("nan"), '"NaN"'), (float("-inf"), '"-Infinity"'), (1e-7, "1e-07"), (123456.0, "123456")])
def test_float_text(value, want):
    assert text.float_text(value, False) == want


def test_canonical_json(spark):
    o = Obj("O", (Member("b", Text()), Member("a", Vec(Text())), Member("u", U), Member("d", dictionary(I32, Text())), Member("f", Vec(F64)), Member("c", scalar("char16"))))
    v = {"b": 'q"\\\n\x01é', "a": ["x", None], "u": {"tag": U.tag_of("B"), "B": {"y": "z"}}, "d": {1: "one"}, "f": [1.0, 0.5], "c": 65}
    want = '{"a":["x",null],"b":"q\\"\\\\\\n\\u0001é","c":65,"d":{"Keys":[1],"Values":["one"]},"f":[1,0.5],"u":{"$type":"B","$value":{"y":"z"}}}'
    b = spark.createDataFrame([(codec.encode(o, v),)], "b binary")
    assert b.select(buffers.buffer_json(o, F.col("b"))).first()[0] == want
    record = b.select(buffers.decoded(o, F.col("b"))["value"].alias("v"))
    assert record.select(text.canonical_json(o, F.col("v"))).first()[0] == want
    assert one(spark, text.canonical_json(Obj("Empty", ()), F.struct(F.lit(1)))) == "{}"


@pytest.mark.parametrize(("style", "want"), [("snake", "http_server2"), ("camel", "hTTPServer2"), ("pascal", "HTTPServer2"), ("original", "HTTPServer2")])
def test_identifiers(style, want):
    assert text.identifier("HTTPServer2", style) == want
    assert text.identifier("_MaxHP_", "snake") == "max_hp"


def test_utf8(spark):
    bad = F.lit(b"a\xff\xfed")
    assert one(spark, text.is_valid_utf8(bad)) is False
    assert one(spark, text.repaired_utf8(bad)) == "a��d"
    assert one(spark, text.has_flag(F.lit(5), 4)) is True


def test_version_plan_is_one_projection(spark):
    old = Obj("P", (Member("Name", Text()), Member("Kind", scalar("int16")), Member("Items", Vec(A)), Member("Scores", dictionary(Text(), I32))))
    new = Obj("P", (Member("Title", Text(), "Name"), Member("Kind", I32), Member("Items", Vec(Obj("A", (Member("x", I32), Member("z", I32, default=4, keep=True))))), Member("Scores", dictionary(Text(), scalar("int64"))), Member("Gold", I32, default=50, keep=True)))
    df = spark.sql("SELECT 'Ann' AS Name, smallint(-2) AS Kind, array(named_struct('x', 1)) AS Items, named_struct('keys', array('a'), 'values', array(1)) AS Scores")
    got = evolve.read_as(df, old, new).first()
    assert (got["Title"], got["Kind"], got["Gold"]) == ("Ann", None, 50)
    assert got["Items"][0].asDict() == {"x": 1, "z": 4}
    assert got["Scores"].asDict() == {"keys": ["a"], "values": []}
    with pytest.raises(evolve.Unreadable):
        evolve.read_as(df, old, new, has_schema=False)


def test_validation(spark):
    bad = spark.sql("SELECT named_struct('keys', array(1), 'values', cast(null as array<int>)) AS d")
    assert bad.select(validate.first_error(dictionary(I32, I32), F.col("d"))).first()[0] == "BadOffset"
    tags = spark.sql(f"SELECT named_struct('tag', bigint({U.tag_of('A')}), 'A', cast(null as struct<x:int>), 'B', cast(null as struct<y:string>)) AS u")
    assert tags.select(validate.first_error(U, F.col("u"))).first()[0] == "BadUnionTag"
    edges = spark.sql("SELECT * FROM VALUES (1, null), (2, 1), (3, 2), (4, 3), (9, 9) AS t(node, parent)")
    got = {r["node"]: (r["depth"], r["error"]) for r in validate.depths(edges, max_depth=2).collect()}
    assert got == {1: (0, None), 2: (1, None), 3: (2, None), 4: (None, "TooDeep"), 9: (None, "TooDeep")}
    assert validate.depths(edges.limit(0)).count() == 0


def test_pool(spark):
    df = spark.sql("SELECT * FROM VALUES ('a', 1), ('a', 1), ('b', null), (null, null) AS t(s, i)")
    assert pool.pool_sizes(df, "s").first().asDict() == {"n_values": 3, "n_distinct": 2, "bytes_all": 3, "bytes_pooled": 2}
    assert pool.pool_sizes(df.limit(0), "s").first()["n_values"] == 0
    assert {(r["s"], r["uses"]) for r in pool.pool(df, "s").collect()} == {("a", 2), ("b", 1)}


def test_statistics(spark):
    df = spark.sql("SELECT * FROM VALUES ('w', 'me', 10.0D), ('w', 'x', 9.0D), ('w', 'y', 20.0D) AS t(w, lib, t)")
    assert stats.best_per(df, ["w"], "lib", "t").first()["best"] == "x"
    assert [r["rival"] for r in stats.slower_than(df, ["w"], "lib", "me", "t").collect()] == ["x"]
    a, b = (df.orderBy(F.desc("t") if d else "t").transform(lambda x: stats.checksum(x, "w", "lib", "t")).first() for d in (0, 1))
    assert a == b
    x, y = (one(spark, stats.ordered_checksum(F.array(*map(F.lit, v)))) for v in ((1, 2), (2, 1)))
    assert x != y


def test_buffer_table_and_files(spark, tmp_path):
    o = Obj("Row", (Member("k", scalar("int64"), keep=True), Member("s", Text())))
    df = spark.sql("SELECT * FROM VALUES (1L, 'a'), (2L, null) AS t(k, s)")
    buffers.write_table(df, o, f"{tmp_path}/t", key="k")
    back = spark.read.parquet(f"{tmp_path}/t").select(buffers.decoded(o, F.col("content"))["value"].alias("v")).select("v.*")
    assert sorted(map(tuple, back.collect())) == [(1, "a"), (2, None)]
    folder = tmp_path / "files"
    folder.mkdir()
    (folder / "one.bin").write_bytes(codec.encode(o, {"k": 5, "s": "x"}))
    (folder / "two.bin").write_bytes(b"short")
    got = {r["error"]: r["value"] for r in buffers.read_files(spark, str(folder), o).collect()}
    assert got[None]["k"] == 5 and got["TooSmall"] is None
    with pytest.raises(PySparkException):
        spark.read.format("binaryFile").load(str(folder)).select(buffers.decoded(o, F.col("content"), strict=True)).collect()


def test_unsigned_and_null_columns(spark):
    o = Obj("N", (Member("big", scalar("uint64")), Member("opt", Vec(Scalar(Kind.INT32, nullable=True)))))
    df = spark.sql("SELECT named_struct('big', cast('18446744073709551615' as decimal(20,0)), 'opt', array(1, null)) AS r UNION ALL SELECT null")
    got = df.select(buffers.decoded(o, buffers.encoded(o, F.col("r"))).alias("d")).select("d.value").collect()
    assert [r[0] and (int(r[0]["big"]), r[0]["opt"]) for r in got] == [(2**64 - 1, [1, None]), None]


def test_streams_decode_the_same_way(spark, tmp_path):
    o = Obj("S", (Member("k", scalar("int64"), keep=True),))
    for i in range(3):
        spark.createDataFrame([(codec.encode(o, {"k": i}),), (b"x",)], "content binary").write.mode("append").parquet(f"{tmp_path}/in")
    stream = decode_stream(spark.readStream.schema("content binary").parquet(f"{tmp_path}/in"), o)
    q = stream.writeStream.format("memory").queryName("decoded").trigger(availableNow=True).start()
    q.awaitTermination(60)
    got = spark.table("decoded").collect()
    assert sorted(r["value"]["k"] for r in got if r["value"]) == [0, 1, 2] and sum(r["error"] == "TooSmall" for r in got) == 3


def test_json_escapes_every_control_character(spark):
    texts = ["a" + chr(i) + "b" for i in (*range(0, 40), 92, 127, 0x85, 0x2028, 0x2029)] + ['"\\\n', "", " "]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", text.quoted(F.col("t")).alias("j")).collect():
        assert r["j"] == text.value_json(Text(), r["t"]) and json.loads(r["j"], strict=False) == r["t"]


def test_references_tell_nulls_apart_by_place(spark):
    rows = [("a", None, [[1], [2]]), (None, "a", [[1], [2]]), ("a", None, [[1, 2]]), ("a", None, None), ("a", None, []), ("a", None, [[1], None, [2]])]
    df = spark.createDataFrame(rows, "x string, y string, z array<array<int>>")
    assert pool.references(df, "x", "y", "z").distinct().count() == len(rows)
    nested = df.select(F.struct(F.struct("x", "y").alias("in"), "z").alias("o"))
    assert pool.references(nested, "o").distinct().count() == len(rows)
    assert pool.references(df.union(df), "x", "y", "z").distinct().count() == len(rows)


def test_long_dictionaries_are_searched(spark):
    keys = [f"k{i:04d}" for i in range(0, 400, 2)]
    df = spark.createDataFrame([(keys, list(range(200)), k) for k in ("k0000", "k0398", "k0200", "k0201", "a", "z")], "keys array<string>, values array<int>, key string")
    got = df.select("key", dictionaries.index_of(F.struct("keys", "values"), F.col("key")).alias("i"), dictionaries.contains(F.struct("keys", "values"), F.col("key")).alias("has")).collect()
    assert [(r["i"], r["has"]) for r in got] == [(0, True), (199, True), (100, True), (-1, False), (-1, False), (-1, False)]


@pytest.mark.parametrize("max_depth", [0, 1, 2, 5, 6, 7, 128])
def test_depths_of_chains_and_cycles(spark, max_depth):
    edges = [(0, None), *((i, i - 1) for i in range(1, 10)), (9, 2), (20, 21), (21, 20), (30, 99), (40, None)]
    got = {r["node"]: (r["depth"], r["error"]) for r in validate.depths(spark.createDataFrame(edges, "node int, parent int"), max_depth=max_depth).collect()}
    want = {i: i for i in range(9)} | {9: 3, 40: 0}
    assert got == {i: (want[i], None) if want.get(i, 999) <= max_depth else (None, "TooDeep") for i in (*range(10), 20, 21, 30, 40)}

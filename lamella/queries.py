"""Registered queries for the record operators, each with the SQL that must give the same rows.

Joins and groupings here only build nested input from the flat test tables. Sums of money go through decimals, so that
no order of addition matters.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.functions import arrays, dictionaries, presence, text, unions
from lamella.model import Kind, Member, Obj, Scalar, Struct, Text, Union, Vec, dictionary, scalar
from lamella.operators import pool, stats, traverse, validate
from lamella.plans import evolve

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def tables(spark: SparkSession, sf_dir: str) -> Callable[[str], DataFrame]:
    return lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")


def money(c: Column | str) -> Column:
    return F.col(c).cast("decimal(18,2)") if isinstance(c, str) else c.cast("decimal(18,2)")


def long(c: Column) -> Column:
    return c.cast("bigint")


# ---- models of the test tables ----------------------------------------------------------------------------------

INT, LONG, DOUBLE, BOOL = (scalar(k) for k in ("int32", "int64", "float64", "bool"))
LINE = Obj("Line", (Member("l_linenumber", INT), Member("l_quantity", DOUBLE), Member("l_discount", DOUBLE, default=0.0), Member("l_tax", DOUBLE, default=0.02), Member("l_returnflag", Text())))
CLICK = Obj("Click", (Member("user_id", LONG), Member("value", DOUBLE)))
PURCHASE = Obj("Purchase", (Member("user_id", LONG), Member("value", DOUBLE)))
OTHER = Obj("Other", (Member("kind", Text()),))
EVENT = Union("Event", (CLICK, PURCHASE, OTHER))
EVENT_OLD = Union("Event", (CLICK, OTHER))
CUSTOMER_1 = Obj("Customer", (Member("c_custkey", LONG), Member("c_name", Text()), Member("c_nationkey", INT), Member("c_mktsegment", Text())))
CUSTOMER_2 = Obj("Customer", (Member("id", LONG, "c_custkey", keep=True), Member("display_name", Text(), "c_name"), Member("c_nationkey", LONG), Member("credit", LONG, default=50, keep=True), Member("title", Text())))
PRICES_1, PRICES_2 = dictionary(LONG, INT), dictionary(LONG, LONG)
BRAND_1 = Obj("Brand", (Member("name", Text()), Member("sizes", PRICES_1)))
BRAND_2 = Obj("Brand", (Member("name", Text()), Member("sizes", PRICES_2)))


def order_items(spark: SparkSession, sf_dir: str, fields: list[str] | None = None, *, spread: bool = False) -> DataFrame:
    """Orders with their line items as an ordered list; null for an order without any."""
    t = tables(spark, sf_dir)
    return traverse.nest(t("orders").select("o_orderkey"), t("lineitem"), key="o_orderkey", child_key="l_orderkey", order=["l_linenumber", "l_partkey", "l_quantity", "l_extendedprice"], fields=fields or [], to="items", spread=spread)


# ---- opening and projection ------------------------------------------------------------------------------------


@query("src6_open_columns", "SELECT n_nationkey, n_name FROM nation")
def src6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables(spark, sf_dir)("nation").select("n_nationkey", "n_name")


@query("prj1_scalar_default", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_tax > 0.05 THEN 0.02 ELSE l_tax END AS tax FROM lineitem")
def prj1(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = tables(spark, sf_dir)("lineitem")
    wire = F.when(F.col("l_tax") <= 0.05, presence.encode_member(F.col("l_tax"), LINE.member("l_tax")))
    return df.select("l_orderkey", "l_linenumber", "l_partkey", presence.restore(wire, LINE.member("l_tax")).alias("tax"))


@query("prj2_bool", "SELECT event_id, event_type = 'click' AS plain, (event_type = 'error') OR event_type <> 'view' AS inverted, CASE WHEN event_type <> 'view' THEN event_type = 'error' END AS nullable FROM events")
def prj2(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain, inverted, maybe = Member("plain", BOOL), Member("inverted", BOOL, default=True), Member("nullable", Scalar(Kind.BOOL, nullable=True))
    e = F.col("event_type")
    values = {"plain": (e == "click", plain), "inverted": ((e == "error") | (e != "view"), inverted), "nullable": (F.when(e != "view", e == "error"), maybe)}
    wire = tables(spark, sf_dir)("events").select("event_id", *(presence.encode_member(v, m).alias(n) for n, (v, m) in values.items()))
    return wire.select("event_id", *(presence.restore(F.col(n), m).alias(n) for n, (_, m) in values.items()))


@query("prj3_fixed_cell", "SELECT o_orderkey, coalesce(n, 0) AS n, q IS NOT NULL AS has_q, coalesce(q, 1.5) AS q FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n, max(l_quantity) AS q FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def prj3(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, model = tables(spark, sf_dir), Obj("Load", (Member("n", LONG, keep=True), Member("q", DOUBLE, default=1.5, keep=True)))
    loads = t("lineitem").groupBy("l_orderkey").agg(presence.encode_record(model, {"n": F.count("*"), "q": F.max("l_quantity")}).alias("load"))
    df = t("orders").join(loads, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    read = presence.read_record(model, F.col("load"))
    return df.select("o_orderkey", read["n"].alias("n"), presence.has_fixed(F.col("load")).alias("has_q"), read["q"].alias("q"))


@query("prj5_absent_chain", "SELECT o_orderkey, coalesce(min(l_linenumber), 0) AS first_number FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def prj5(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = order_items(spark, sf_dir).withColumn("o", F.struct(F.get("items", F.lit(0)).alias("first")))
    return df.select("o_orderkey", F.coalesce("o.first.l_linenumber", F.lit(0)).alias("first_number"))


@query("prj6_struct_fields", "SELECT vec_id, embedding[1] AS x, embedding[2] AS y FROM embeddings")
def prj6(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = tables(spark, sf_dir)("embeddings").select("vec_id", F.struct(F.get("embedding", F.lit(0)).alias("x"), F.get("embedding", F.lit(1)).alias("y")).alias("pos"))
    return df.select("vec_id", "pos.*")


@query("prj7_utf8", "SELECT doc_id, strlen(text) AS n_bytes, length(text) AS n_points FROM documents")
def prj7(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = tables(spark, sf_dir)("documents")
    return df.select("doc_id", long(F.octet_length(text.utf8(F.col("text")))).alias("n_bytes"), long(F.char_length("text")).alias("n_points"))


@query("prj8_rename", "SELECT c_custkey AS id, c_name AS display_name FROM customer")
def prj8(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = tables(spark, sf_dir)("customer").select("c_custkey", "c_name", F.lit(None).cast("int").alias("c_nationkey"), F.lit(None).cast("string").alias("c_mktsegment"))
    return evolve.read_as(df, CUSTOMER_1, CUSTOMER_2).select("id", "display_name")


@query("prj9_drop", "SELECT r_regionkey FROM region")
def prj9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables(spark, sf_dir)("region").drop("r_name")


@query("prj10_full_traversal", "SELECT l_orderkey AS o_orderkey, count(*) AS n, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS quantity, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS price, sum(length(l_returnflag)) :: BIGINT AS chars FROM lineitem SEMI JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")
def prj10(spark: SparkSession, sf_dir: str) -> DataFrame:
    walked = traverse.walk(order_items(spark, sf_dir, ["l_returnflag"]), "items", keep=["o_orderkey"]).where("element is not null")
    return walked.groupBy("o_orderkey").agg(F.count("*").alias("n"), F.sum(money("element.l_quantity")).cast("double").alias("quantity"), F.sum(money("element.l_extendedprice")).cast("double").alias("price"), F.sum(long(F.char_length("element.l_returnflag"))).alias("chars"))


# ---- presence --------------------------------------------------------------------------------------------------


@query("prd1_has", "SELECT l_orderkey, l_linenumber, l_partkey, l_discount <> 0 AS has_discount, l_tax <> 0.02 AS has_tax FROM lineitem")
def prd1(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = tables(spark, sf_dir)("lineitem")
    wire = {n: presence.encode_member(F.col(f"l_{n}"), LINE.member(f"l_{n}")) for n in ("discount", "tax")}
    return df.select("l_orderkey", "l_linenumber", "l_partkey", *(presence.has(c).alias(f"has_{n}") for n, c in wire.items()))


@query("prd2_object_absent", "SELECT o_orderkey, NOT EXISTS (FROM lineitem WHERE l_orderkey = o_orderkey) AS absent FROM orders")
def prd2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_items(spark, sf_dir).select("o_orderkey", F.get("items", F.lit(0)).isNull().alias("absent"))


@query(
    "prd3_null_vs_empty",
    "SELECT o_orderkey, count(l_orderkey) = 0 AS is_null, count(l_orderkey) > 0 AND count(*) FILTER (l_quantity > 45) = 0 AS is_empty FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1",
)
def prd3(spark: SparkSession, sf_dir: str) -> DataFrame:
    large = F.filter("items", lambda x: x["l_quantity"] > 45)
    return order_items(spark, sf_dir).select("o_orderkey", large.isNull().alias("is_null"), F.coalesce(F.size(large) == 0, F.lit(False)).alias("is_empty"))


@query("prd4_element_null", "SELECT o_orderkey, coalesce(l_discount = 0, true) AS first_null FROM orders LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity, l_extendedprice) AS r FROM lineitem) ON l_orderkey = o_orderkey AND r = 1")
def prd4(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = F.transform("items", lambda x: presence.elide(x["l_discount"], 0.0, floating=True))
    return order_items(spark, sf_dir, ["l_discount"]).select("o_orderkey", arrays.is_null_at(stored, 0).alias("first_null"))


@query("prd5_type_test", "SELECT event_id, event_type = 'click' AS is_click, event_type = 'purchase' AS is_purchase FROM events")
def prd5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("event_id", unions.is_member(F.col("u"), EVENT, "Click").alias("is_click"), unions.is_member(F.col("u"), EVENT, "Purchase").alias("is_purchase"))


@query("prd6_contains_key", "SELECT p_brand, bool_or(p_size = 7) AS has_7 FROM part GROUP BY 1")
def prd6(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = sizes_by_brand(spark, sf_dir)
    return d.select("p_brand", dictionaries.contains(F.col("d"), F.lit(7)).alias("has_7"))


# ---- lists -----------------------------------------------------------------------------------------------------


@query("arr1_scalar_list", "SELECT l_orderkey, count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS total FROM lineitem GROUP BY 1")
def arr1(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = tables(spark, sf_dir)("lineitem").groupBy("l_orderkey").agg(F.collect_list("l_linenumber").alias("a"))
    return lists.select("l_orderkey", long(arrays.length(F.col("a"))).alias("n"), F.aggregate("a", F.lit(0).cast("bigint"), lambda s, x: s + x).alias("total"))


@query("arr2_bool_list", "SELECT l_orderkey, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS n_true FROM lineitem GROUP BY 1")
def arr2(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = tables(spark, sf_dir)("lineitem").groupBy("l_orderkey").agg(F.collect_list(F.col("l_returnflag") == "R").alias("a"))
    return lists.select("l_orderkey", long(F.size("a")).alias("n"), long(F.size(F.filter("a", lambda x: x))).alias("n_true"))


@query(
    "arr3_order_items",
    "SELECT o_orderkey, count(*) AS n, arg_min(l_quantity, (l_linenumber, l_partkey, l_quantity, l_extendedprice)) AS first_quantity, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS price FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1",
)
def arr3(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = order_items(spark, sf_dir).where("items is not null")
    price = F.aggregate("items", F.lit(0).cast("decimal(28,2)"), lambda s, x: (s + money(x["l_extendedprice"])).cast("decimal(28,2)"))
    return df.select("o_orderkey", long(F.size("items")).alias("n"), arrays.element(F.col("items"), 0)["l_quantity"].alias("first_quantity"), price.cast("double").alias("price"))


@query("arr4_optional_list", "SELECT l_orderkey, count(*) AS n, count(*) FILTER (l_discount <> 0) AS n_present FROM lineitem GROUP BY 1")
def arr4(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = F.struct("l_linenumber", presence.elide(F.col("l_discount"), 0.0, floating=True).alias("v"))
    lists = tables(spark, sf_dir)("lineitem").groupBy("l_orderkey").agg(F.transform(F.collect_list(kept), lambda s: s["v"]).alias("a"))
    return lists.select("l_orderkey", long(F.size("a")).alias("n"), long(arrays.present(F.col("a"))).alias("n_present"))


@query("arr5_reference_list", "SELECT user_id, count(*) AS n, count(*) FILTER (event_type <> 'view') AS n_texts FROM events GROUP BY 1")
def arr5(spark: SparkSession, sf_dir: str) -> DataFrame:
    ref = F.struct(F.when(F.col("event_type") != "view", F.col("event_type")).alias("s"))
    lists = tables(spark, sf_dir)("events").groupBy("user_id").agg(F.transform(F.collect_list(ref), lambda s: s["s"]).alias("a"))
    return lists.select("user_id", long(F.size("a")).alias("n"), long(arrays.present(F.col("a"))).alias("n_texts"))


@query("arr6_union_list", "SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'click') AS clicks, count(*) FILTER (event_type NOT IN ('click', 'purchase')) AS others FROM events GROUP BY 1")
def arr6(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = events(spark, sf_dir).groupBy("user_id").agg(F.collect_list("u").alias("a"))
    of = lambda n: long(F.size(F.filter("a", lambda u: u["tag"] == EVENT.tag_of(n))))
    return lists.select("user_id", long(F.size("a")).alias("n"), of("Click").alias("clicks"), of("Other").alias("others"))


@query("arr8_length", "SELECT o_orderkey, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def arr8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_items(spark, sf_dir).select("o_orderkey", long(arrays.length(F.col("items"))).alias("n"))


@query("arr9_element", "SELECT vec_id, embedding[1] AS first, embedding[64] AS last FROM embeddings")
def arr9(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.col("embedding")
    return tables(spark, sf_dir)("embeddings").select("vec_id", arrays.element(a, 0).alias("first"), arrays.element(a, 63).alias("last"))


@query("arr10_at_default", "SELECT vec_id, coalesce(embedding[4], 0) AS third, CAST(-1 AS FLOAT) AS far FROM embeddings")
def arr10(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.col("embedding")
    return tables(spark, sf_dir)("embeddings").select("vec_id", arrays.element_or(a, 3, 0.0).cast("float").alias("third"), arrays.element_or(a, 500, -1.0).cast("float").alias("far"))


@query("arr11_enumerate", "SELECT l_orderkey AS o_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity, l_extendedprice) - 1 AS pos, l_quantity FROM lineitem SEMI JOIN orders ON l_orderkey = o_orderkey UNION ALL SELECT o_orderkey, NULL, NULL FROM orders ANTI JOIN lineitem ON l_orderkey = o_orderkey")
def arr11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traverse.walk(order_items(spark, sf_dir), "items", keep=["o_orderkey"]).select("o_orderkey", long(F.col("pos")).alias("pos"), F.col("element.l_quantity").alias("l_quantity"))


@query("arr13_nested_lists", "SELECT o_custkey, count(DISTINCT o_orderkey) AS n_lists, count(*) AS n_values, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS total FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def arr13(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables(spark, sf_dir)
    inner = t("lineitem").groupBy("l_orderkey").agg(F.collect_list(money("l_quantity")).alias("a"))
    outer = t("orders").join(inner, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey").agg(F.collect_list("a").alias("aa"))
    flat = arrays.flattened(F.col("aa"))
    total = F.aggregate(flat, F.lit(0).cast("decimal(28,2)"), lambda s, x: (s + x).cast("decimal(28,2)"))
    return outer.select("o_custkey", long(F.size("aa")).alias("n_lists"), long(F.size(flat)).alias("n_values"), total.cast("double").alias("total"))


@query("arr14_optional_read", "SELECT l_orderkey, CAST(sum(CASE WHEN l_discount = 0 THEN 1.0 ELSE CAST(l_discount AS DECIMAL(18,2)) END) AS DOUBLE) AS total FROM lineitem GROUP BY 1")
def arr14(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = F.struct(presence.elide(F.col("l_discount"), 0.0, floating=True).alias("v"))
    lists = tables(spark, sf_dir)("lineitem").groupBy("l_orderkey").agg(F.transform(F.collect_list(kept), lambda s: s["v"]).alias("a"))
    total = F.aggregate("a", F.lit(0).cast("decimal(28,2)"), lambda s, x: (s + money(F.coalesce(x, F.lit(1.0)))).cast("decimal(28,2)"))
    return lists.select("l_orderkey", total.cast("double").alias("total"))


@query("arr15_string_list", "SELECT user_id, count(*) AS n, CAST(sum(length(event_type)) AS BIGINT) AS chars, min(event_type) AS first FROM events GROUP BY 1")
def arr15(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = tables(spark, sf_dir)("events").groupBy("user_id").agg(F.array_sort(F.collect_list("event_type")).alias("a"))
    return lists.select("user_id", long(F.size("a")).alias("n"), F.aggregate("a", F.lit(0).cast("bigint"), lambda s, x: s + F.char_length(x)).alias("chars"), F.get("a", F.lit(0)).alias("first"))


@query("arr16_object_list", "SELECT o_orderkey, count(l_orderkey) FILTER (l_quantity > 25) AS n_large FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def arr16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_items(spark, sf_dir).select("o_orderkey", long(arrays.length(F.filter("items", lambda x: x["l_quantity"] > 25))).alias("n_large"))


# ---- dictionaries ----------------------------------------------------------------------------------------------


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's orders as a dictionary: order key to total price."""
    return tables(spark, sf_dir)("orders").groupBy("o_custkey").agg(dictionaries.build(F.col("o_orderkey"), F.col("o_totalprice")).alias("d"))


def kinds_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each user had each event type; counted before the entries are gathered."""
    return tables(spark, sf_dir)("events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


def sizes_by_brand(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables(spark, sf_dir)("part").groupBy("p_brand", "p_size").agg(F.count("*").alias("n"))
    return t.groupBy("p_brand").agg(dictionaries.build(F.col("p_size"), F.col("n")).alias("d"))


@query("map1_build_sorted", "SELECT o_custkey, count(*) AS n, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key, arg_min(o_totalprice, o_orderkey) AS first_value FROM orders GROUP BY 1")
def map1(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("d")
    return prices(spark, sf_dir).select("o_custkey", long(dictionaries.count(d)).alias("n"), F.get(d["keys"], F.lit(0)).alias("first_key"), F.element_at(d["keys"], -1).alias("last_key"), F.get(d["values"], F.lit(0)).alias("first_value"))


@query("map2_string_keys", "SELECT user_id, true AS is_sorted, min(event_type) AS first_key, max(event_type) AS last_key FROM events GROUP BY 1")
def map2(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = kinds_by_user(spark, sf_dir).groupBy("user_id").agg(dictionaries.build(F.col("event_type"), F.col("n")).alias("d"))
    return d.select("user_id", dictionaries.is_sorted(F.col("d")).alias("is_sorted"), F.get("d.keys", F.lit(0)).alias("first_key"), F.element_at("d.keys", -1).alias("last_key"))


@query("map3_int_keys", "SELECT p_brand, count(DISTINCT p_size) AS n, CAST(min(p_size) AS INTEGER) AS low, CAST(max(p_size) AS INTEGER) AS high FROM part GROUP BY 1")
def map3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sizes_by_brand(spark, sf_dir).select("p_brand", long(F.size("d.keys")).alias("n"), F.get("d.keys", F.lit(0)).alias("low"), F.element_at("d.keys", -1).alias("high"))


@query("map4_keys_values", "SELECT p_brand, count(DISTINCT p_size) AS n_keys, count(*) AS total FROM part GROUP BY 1")
def map4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sizes_by_brand(spark, sf_dir).select("p_brand", long(dictionaries.count(F.col("d"))).alias("n_keys"), F.aggregate("d.values", F.lit(0).cast("bigint"), lambda s, x: s + x).alias("total"))


@query("map5_index_of", "SELECT p_brand, coalesce((SELECT count(DISTINCT q.p_size) FROM part q WHERE q.p_brand = b.p_brand AND q.p_size < 10 HAVING bool_or(true)), 0) AS low, CASE WHEN EXISTS (FROM part q WHERE q.p_brand = b.p_brand AND q.p_size = 10) THEN CAST((SELECT count(DISTINCT q.p_size) FROM part q WHERE q.p_brand = b.p_brand AND q.p_size < 10) AS INTEGER) ELSE -1 END AS at_10 FROM (SELECT DISTINCT p_brand FROM part) b")
def map5(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("d")
    return sizes_by_brand(spark, sf_dir).select("p_brand", long(F.size(F.filter(d["keys"], lambda k: k < 10))).alias("low"), dictionaries.index_of(d, F.lit(10)).alias("at_10"))


@query("map6_find", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_partkey % 3 = 0 THEN p_retailprice END AS price FROM lineitem LEFT JOIN part ON p_partkey = l_partkey")
def map6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bulk lookup: the dictionary's entries as rows, joined on the key; keys not divisible by 3 miss."""
    t = tables(spark, sf_dir)
    entries = t("part").where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("l_partkey"), F.col("p_retailprice").alias("price"))
    return t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(entries, "l_partkey", "left").select("l_orderkey", "l_linenumber", "l_partkey", "price")


@query("map6_find_inline", "SELECT o_custkey, max(o_totalprice) FILTER (o_orderkey = 11) AS price FROM orders GROUP BY 1")
def map6b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prices(spark, sf_dir).select("o_custkey", dictionaries.find(F.col("d"), F.lit(11)).alias("price"))


@query("map7_lookup_strict", "SELECT o_custkey, arg_min(o_totalprice, o_orderkey) AS price FROM orders GROUP BY 1")
def map7(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("d")
    return prices(spark, sf_dir).select("o_custkey", dictionaries.at(d, F.get(d["keys"], F.lit(0))).alias("price"))


@query("map8_fewer_values", "SELECT o_custkey, CASE WHEN count(*) <= 3 THEN arg_max(o_totalprice, o_orderkey) END AS last_value FROM orders GROUP BY 1")
def map8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dictionaries that keep three values at most: a key beyond them is found without a value."""
    d = prices(spark, sf_dir).withColumn("cut", F.struct("d.keys", F.slice("d.values", 1, 3).alias("values")))
    return d.select("o_custkey", dictionaries.find(F.col("cut"), F.element_at("cut.keys", -1)).alias("last_value"))


@query("map9_rebuild", "SELECT o_custkey, least(count(*), 5) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (r <= 5) AS DOUBLE) AS total FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders) GROUP BY 1")
def map9(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = dictionaries.as_map(F.struct("d.keys", F.slice("d.values", 1, 5).alias("values")))
    total = F.aggregate(F.map_values("m"), F.lit(0).cast("decimal(28,2)"), lambda s, x: (s + money(x)).cast("decimal(28,2)"))
    return prices(spark, sf_dir).withColumn("m", m).select("o_custkey", long(F.size("m")).alias("n"), total.cast("double").alias("total"))


@query("map10_nested", "SELECT count(DISTINCT p_brand) AS n_outer, count(DISTINCT (p_brand, p_size)) AS n_inner, count(*) AS total FROM part")
def map10(spark: SparkSession, sf_dir: str) -> DataFrame:
    nested = sizes_by_brand(spark, sf_dir).groupBy(F.substring("p_brand", 1, 6).alias("group")).agg(dictionaries.build(F.col("p_brand"), F.col("d")).alias("dd"))
    inner = F.col("dd.values")
    per = nested.select(F.size("dd.keys").alias("o"), F.aggregate(inner, F.lit(0), lambda s, d: s + F.size(d["keys"])).alias("i"), F.aggregate(F.flatten(F.transform(inner, lambda d: d["values"])), F.lit(0).cast("bigint"), lambda s, x: s + x).alias("t"))
    return per.agg(F.sum(long(F.col("o"))).alias("n_outer"), F.sum(long(F.col("i"))).alias("n_inner"), F.sum("t").alias("total"))


# ---- unions ----------------------------------------------------------------------------------------------------


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a union: clicks, purchases and others."""
    e, whole = F.col("event_type"), F.struct("user_id", "value")
    u = unions.encode(EVENT, [("Click", e == "click", whole), ("Purchase", e == "purchase", whole), ("Other", e.isNotNull(), F.struct(e.alias("kind")))])
    return tables(spark, sf_dir)("events").select("event_id", "user_id", "event_type", "value", u.alias("u"))


TAGS = {m.name: EVENT.tag_of(m.name) for m in EVENT.members}
TAG_SQL = f"CASE event_type WHEN 'click' THEN {TAGS['Click']} WHEN 'purchase' THEN {TAGS['Purchase']} ELSE {TAGS['Other']} END"


@query("uni1_encode", f"SELECT event_id, {TAG_SQL} :: BIGINT AS tag, CASE WHEN event_type = 'click' THEN value END AS click_value, CASE WHEN event_type NOT IN ('click', 'purchase') THEN event_type END AS other_kind FROM events")
def uni1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("event_id", "u.tag", F.col("u.Click.value").alias("click_value"), F.col("u.Other.kind").alias("other_kind"))


@query("uni2_tag", f"SELECT {TAG_SQL} :: BIGINT AS tag, count(*) AS n FROM events GROUP BY 1")
def uni2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).groupBy(unions.tag(F.col("u")).alias("tag")).agg(F.count("*").alias("n"))


@query("uni3_downcast", "SELECT event_id, CASE WHEN event_type = 'purchase' THEN user_id END AS purchaser FROM events")
def uni3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("event_id", unions.as_member(F.col("u"), EVENT, "Purchase")["user_id"].alias("purchaser"))


@query("uni5_unknown_member", f"SELECT event_id, {TAG_SQL} :: BIGINT AS tag, event_type <> 'purchase' AS has_record FROM events")
def uni5(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = unions.restrict(F.col("u"), EVENT, EVENT_OLD)
    old = events(spark, sf_dir).select("event_id", u.alias("u"))
    return old.select("event_id", "u.tag", F.coalesce(F.col("u.Click").isNotNull() | F.col("u.Other").isNotNull(), F.lit(False)).alias("has_record"))


# ---- defaults --------------------------------------------------------------------------------------------------


@query("nul1_elide", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_discount <> 0 THEN l_discount END AS discount, CASE WHEN l_tax <> 0.02 THEN l_tax END AS tax FROM lineitem")
def nul1(spark: SparkSession, sf_dir: str) -> DataFrame:
    enc = lambda n: presence.encode_member(F.col(f"l_{n}"), LINE.member(f"l_{n}")).alias(n)
    return tables(spark, sf_dir)("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", enc("discount"), enc("tax"))


@query("nul1_negative_zero", "SELECT count(*) AS n, count(*) FILTER (l_discount <> 0 OR l_linenumber = 1) AS n_stored FROM lineitem")
def nul1b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A negative zero isn't the default: it is stored."""
    x = F.when((F.col("l_discount") == 0) & (F.col("l_linenumber") == 1), F.lit(-0.0)).otherwise(F.col("l_discount"))
    return tables(spark, sf_dir)("lineitem").select(presence.elide(x, 0.0, floating=True).alias("w")).agg(F.count("*").alias("n"), F.count("w").alias("n_stored"))


@query("nul2_restore", "SELECT l_orderkey, l_linenumber, l_partkey, l_discount AS discount, l_tax AS tax FROM lineitem")
def nul2(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = lambda n: presence.restore(presence.encode_member(F.col(f"l_{n}"), LINE.member(f"l_{n}")), LINE.member(f"l_{n}")).alias(n)
    return tables(spark, sf_dir)("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", back("discount"), back("tax"))


@query("nul3_write_defaults", "SELECT count(*) AS n, count(*) AS n_discount, count(*) FILTER (l_linenumber > 1) AS n_nullable FROM lineitem")
def nul3(spark: SparkSession, sf_dir: str) -> DataFrame:
    maybe = Member("maybe", Scalar(Kind.INT32, nullable=True))
    wire = tables(spark, sf_dir)("lineitem").select(
        presence.encode_member(F.col("l_discount"), LINE.member("l_discount"), write_defaults=True).alias("d"),
        presence.encode_member(F.when(F.col("l_linenumber") > 1, F.col("l_linenumber")), maybe, write_defaults=True).alias("m"),
    )
    return wire.agg(F.count("*").alias("n"), F.count("d").alias("n_discount"), F.count("m").alias("n_nullable"))


@query("nul4_keep_default", "SELECT count(*) AS n, count(*) AS n_kept, count(*) FILTER (l_discount <> 0) AS n_elided FROM lineitem")
def nul4(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept, elided = Member("d", DOUBLE, keep=True), Member("d", DOUBLE)
    wire = tables(spark, sf_dir)("lineitem").select(presence.encode_member(F.col("l_discount"), kept).alias("k"), presence.encode_member(F.col("l_discount"), elided).alias("e"))
    return wire.agg(F.count("*").alias("n"), F.count("k").alias("n_kept"), F.count("e").alias("n_elided"))


@query("nul5_struct_zero", "SELECT count(*) AS n, count(*) FILTER (l_discount <> 0 OR l_tax <> 0) AS n_stored FROM lineitem")
def nul5(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = Member("rates", Struct("Rates", (("discount", DOUBLE), ("tax", DOUBLE))))
    wire = presence.encode_member(F.struct(F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax")), rates)
    return tables(spark, sf_dir)("lineitem").select(wire.alias("w")).agg(F.count("*").alias("n"), F.count("w").alias("n_stored"))


@query("nul6_presence_bits", "SELECT l_orderkey, l_linenumber, l_partkey, (l_discount <> 0) :: BIGINT + 2 * (l_tax <> 0.02) :: BIGINT + 4 AS bits, (l_discount <> 0) :: INTEGER + (l_tax <> 0.02) :: INTEGER + 1 AS n_stored FROM lineitem")
def nul6(spark: SparkSession, sf_dir: str) -> DataFrame:
    wire = [presence.encode_member(F.col(n), LINE.member(n)) for n in ("l_discount", "l_tax", "l_returnflag")]
    bits = presence.presence_bits(wire)
    return tables(spark, sf_dir)("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", bits.alias("bits"), F.bit_count(bits).cast("int").alias("n_stored"))


# ---- pooling ---------------------------------------------------------------------------------------------------


@query("ded2_string_pool", "SELECT count(*) AS n_values, count(DISTINCT p_type) AS n_distinct, CAST(sum(strlen(p_type)) AS BIGINT) AS bytes_all, (SELECT CAST(sum(strlen(t)) AS BIGINT) FROM (SELECT DISTINCT p_type AS t FROM part)) AS bytes_pooled FROM part")
def ded2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pool.pool_sizes(tables(spark, sf_dir)("part"), "p_type")


@query("ded2_pool_uses", "SELECT p_type, count(*) AS uses FROM part GROUP BY 1")
def ded2b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pool.pool(tables(spark, sf_dir)("part"), "p_type").select("p_type", "uses")


@query("ded3_keys_join_pool", "SELECT count(*) AS n_values, count(DISTINCT v) AS n_distinct FROM (SELECT p_brand AS v FROM part UNION ALL SELECT p_type FROM part UNION ALL SELECT DISTINCT p_brand FROM part)")
def ded3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dictionary keys (the brands) share the pool with the other texts."""
    part = tables(spark, sf_dir)("part")
    both = part.select(F.col("p_brand").alias("v")).union(part.select("p_type")).union(part.select("p_brand").distinct())
    return pool.pool_sizes(both, "v").select("n_values", "n_distinct")


@query("ded4_value_pool", "SELECT count(*) AS n_distinct, CAST(sum(uses) AS BIGINT) AS uses FROM (SELECT l_quantity, l_discount, l_tax, count(*) AS uses FROM lineitem GROUP BY ALL)")
def ded4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pool.pool(tables(spark, sf_dir)("lineitem"), "l_quantity", "l_discount", "l_tax").agg(F.count("*").alias("n_distinct"), F.sum("uses").alias("uses"))


@query("ded5_list_pool", "SELECT count(DISTINCT a) AS n_distinct, count(*) AS uses FROM (SELECT l_orderkey, list(l_linenumber ORDER BY l_linenumber) AS a FROM lineitem GROUP BY 1)")
def ded5(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = tables(spark, sf_dir)("lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_linenumber")).alias("a"))
    return pool.pool(lists, "a").agg(F.count("*").alias("n_distinct"), F.sum("uses").alias("uses"))


@query("ded6_object_pool", "SELECT p_brand, p_size, count(*) AS uses FROM part GROUP BY 1, 2")
def ded6(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = tables(spark, sf_dir)("part").select(F.struct("p_brand", "p_size").alias("o"))
    return pool.pool(part, "o").select("o.p_brand", "o.p_size", "uses")


@query("ded7_shared_struct", "SELECT count(*) AS n_references, count(DISTINCT (l_discount, l_tax)) AS n_targets FROM lineitem")
def ded7(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = tables(spark, sf_dir)("lineitem").select(F.struct("l_discount", "l_tax").alias("rates"))
    return pool.references(rates, "rates").agg(F.count("*").alias("n_references"), F.count_distinct("ref_a", "ref_b").alias("n_targets"))


# ---- order -----------------------------------------------------------------------------------------------------


@query("ord1_code_points", "SELECT lang, min(text) AS first, max(text) AS last FROM documents GROUP BY 1")
def ord1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables(spark, sf_dir)("documents").groupBy("lang").agg(F.min("text").alias("first"), F.max("text").alias("last"))


@query("ord2_co_sort", "SELECT o_orderkey, CAST(min(l_partkey) AS BIGINT) AS first_key, arg_min(l_quantity, (l_partkey, l_quantity)) AS first_value FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def ord2(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = order_items(spark, sf_dir).where("items is not null")
    d = dictionaries.sort(F.struct(F.transform("items", lambda x: x["l_partkey"]).alias("keys"), F.transform("items", lambda x: x["l_quantity"]).alias("values")))
    return df.select("o_orderkey", F.get(d["keys"], F.lit(0)).alias("first_key"), F.get(d["values"], F.lit(0)).alias("first_value"))


# ---- canonical JSON --------------------------------------------------------------------------------------------

NATION = Obj("Nation", (Member("n_regionkey", INT), Member("n_name", Text()), Member("n_nationkey", INT, keep=True)))


@query("ord4_json_name_order", """SELECT n_nationkey, '{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || CASE WHEN n_regionkey <> 0 THEN ',"n_regionkey":' || n_regionkey ELSE '' END || '}' AS json FROM nation""")
@query("jsn1_canonical", """SELECT n_nationkey, '{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || CASE WHEN n_regionkey <> 0 THEN ',"n_regionkey":' || n_regionkey ELSE '' END || '}' AS json FROM nation""")
def jsn1(spark: SparkSession, sf_dir: str) -> DataFrame:
    wire = presence.encode_record(NATION, {m.name: F.col(m.name) for m in NATION.all_members})
    return tables(spark, sf_dir)("nation").select("n_nationkey", text.canonical_json(NATION, wire).alias("json"))


@query("jsn2_escapes", r"""SELECT event_id, '"' || replace(replace(props, '\', '\\'), '"', '\"') || '"' AS json FROM events""")
def jsn2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables(spark, sf_dir)("events").select("event_id", text.canonical_json(Text(), F.col("props")).alias("json"))


@query("jsn3_floats", "SELECT l_orderkey, l_linenumber, l_partkey, regexp_replace(CAST(l_discount AS VARCHAR), '\\.0$', '') AS json FROM lineitem")
def jsn3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables(spark, sf_dir)("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", text.canonical_json(DOUBLE, F.col("l_discount")).alias("json"))


@query("jsn4_lists", "SELECT l_orderkey, '[' || string_agg(CASE WHEN l_linenumber > 2 THEN 'null' ELSE CAST(l_linenumber AS VARCHAR) END, ',' ORDER BY l_linenumber) || ']' AS json FROM lineitem GROUP BY 1")
def jsn4(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = tables(spark, sf_dir)("lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_linenumber")).alias("a"))
    optional = F.transform("a", lambda x: F.when(x <= 2, x))
    return lists.select("l_orderkey", text.canonical_json(Vec(Scalar(Kind.INT32, nullable=True)), optional).alias("json"))


@query("jsn5_union", """SELECT event_id, CASE WHEN event_type NOT IN ('click', 'purchase') THEN '{"$type":"Other","$value":{"kind":"' || event_type || '"}}' END AS json FROM events WHERE event_type NOT IN ('click', 'purchase')""")
def jsn5(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = Union("Event", (OTHER,))
    u = F.struct(F.col("u.tag"), F.col("u.Other"))
    return events(spark, sf_dir).where(unions.is_member(F.col("u"), EVENT, "Other")).select("event_id", text.canonical_json(model, u).alias("json"))


@query("jsn6_numbers", """SELECT r_regionkey, '{"initial":' || ascii(r_name) || ',"level":' || (r_regionkey + 1) || '}' AS json FROM region""")
def jsn6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chars and enums print as numbers."""
    model = Obj("Region", (Member("level", Scalar(Kind.UINT8, names=(("Low", 1),))), Member("initial", scalar("char16"))))
    wire = presence.encode_record(model, {"level": F.col("r_regionkey") + 1, "initial": F.ascii("r_name")})
    return tables(spark, sf_dir)("region").select("r_regionkey", text.canonical_json(model, wire).alias("json"))


@query("jsn7_dictionary", """SELECT r_regionkey, '{"Keys":[' || string_agg(CAST(n_nationkey AS VARCHAR), ',' ORDER BY n_nationkey) || '],"Values":[' || string_agg('"' || n_name || '"', ',' ORDER BY n_nationkey) || ']}' AS json FROM nation JOIN region ON r_regionkey = n_regionkey GROUP BY 1""")
def jsn7(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables(spark, sf_dir)
    d = t("nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(dictionaries.build(F.col("n_nationkey"), F.col("n_name")).alias("d"))
    return d.select("r_regionkey", text.canonical_json(dictionary(INT, Text()), F.col("d")).alias("json"))


# ---- versions --------------------------------------------------------------------------------------------------


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables(spark, sf_dir)("customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")


@query("evo3_by_name", "SELECT c_custkey AS id, c_name AS display_name FROM customer")
def evo3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evolve.read_as(customers(spark, sf_dir), CUSTOMER_1, CUSTOMER_2).select("id", "display_name")


@query("evo4_kind_change", "SELECT c_custkey AS id, NULL :: BIGINT AS c_nationkey FROM customer")
def evo4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evolve.read_as(customers(spark, sf_dir), CUSTOMER_1, CUSTOMER_2).select("id", "c_nationkey")


@query("evo5_missing", "SELECT c_custkey AS id, 50 :: BIGINT AS credit, true AS has_credit, NULL :: VARCHAR AS title FROM customer")
def evo5(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = evolve.read_as(customers(spark, sf_dir), CUSTOMER_1, CUSTOMER_2)
    return df.select("id", "credit", presence.has(F.col("credit")).alias("has_credit"), "title")


@query("evo6_unknown_dropped", "SELECT 5 :: BIGINT AS n_columns, count(*) AS n FROM customer")
def evo6(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = evolve.read_as(customers(spark, sf_dir), CUSTOMER_1, CUSTOMER_2)
    return df.agg(F.lit(len(df.columns)).cast("bigint").alias("n_columns"), F.count("*").alias("n"))


@query("evo7_rename", "SELECT c_name AS display_name, count(*) AS n FROM customer GROUP BY 1")
def evo7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evolve.read_as(customers(spark, sf_dir), CUSTOMER_1, CUSTOMER_2).groupBy("display_name").agg(F.count("*").alias("n"))


@query("evo8_reorder", "SELECT c_mktsegment, c_nationkey, c_name, c_custkey FROM customer")
def evo8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evolve.read_as(customers(spark, sf_dir), CUSTOMER_1, Obj("Customer", tuple(reversed(CUSTOMER_1.members))))


LINE_1 = Obj("Line", (Member("number", INT), Member("quantity", DOUBLE), Member("flag", Text())))
LINE_2 = Obj("Line", (Member("quantity", DOUBLE), Member("number", LONG), Member("extra", INT, default=9, keep=True)))


@query("evo9_nested", "SELECT o_orderkey, count(l_orderkey) AS n, max(l_quantity) AS quantity, count(NULL :: INTEGER) AS n_numbers, CAST(coalesce(sum(CASE WHEN l_orderkey IS NOT NULL THEN 9 END), 0) AS BIGINT) AS extra FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def evo9(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lambda x: F.struct(x["l_linenumber"].alias("number"), x["l_quantity"].alias("quantity"), x["l_returnflag"].alias("flag"))
    df = order_items(spark, sf_dir, ["l_returnflag"]).select("o_orderkey", F.transform("items", one).alias("items"))
    old, new = Obj("Order", (Member("o_orderkey", LONG), Member("items", Vec(LINE_1)))), Obj("Order", (Member("o_orderkey", LONG), Member("items", Vec(LINE_2))))
    out = evolve.read_as(df, old, new)
    items = F.col("items")
    return out.select(
        "o_orderkey",
        long(arrays.length(items)).alias("n"),
        F.array_max(F.transform(items, lambda x: x["quantity"])).alias("quantity"),
        long(F.coalesce(F.size(F.filter(items, lambda x: x["number"].isNotNull())), F.lit(0))).alias("n_numbers"),
        F.coalesce(F.aggregate(items, F.lit(0).cast("bigint"), lambda s, x: s + x["extra"]), F.lit(0).cast("bigint")).alias("extra"),
    )


@query("evo10_element_mismatch", "SELECT vec_id, true AS unreadable FROM embeddings")
def evo10(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = Obj("V", (Member("vec_id", LONG), Member("embedding", Vec(scalar("float32"))))), Obj("V", (Member("vec_id", LONG), Member("embedding", Vec(Scalar(Kind.FLOAT32, nullable=True)))))
    return evolve.read_as(tables(spark, sf_dir)("embeddings").select("vec_id", "embedding"), old, new).select("vec_id", F.col("embedding").isNull().alias("unreadable"))


@query("evo11_dictionary_values", "SELECT p_brand AS name, count(DISTINCT p_size) AS n_keys, 0 :: BIGINT AS n_values FROM part GROUP BY 1")
def evo11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brand_2(spark, sf_dir).select("name", long(F.size("sizes.keys")).alias("n_keys"), long(F.size("sizes.values")).alias("n_values"))


def brand_2(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = sizes_by_brand(spark, sf_dir).select(F.col("p_brand").alias("name"), F.struct(F.transform("d.keys", long).alias("keys"), F.transform("d.values", lambda x: x.cast("int")).alias("values")).alias("sizes"))
    return evolve.read_as(d, BRAND_1, BRAND_2)


@query("evo12_rebuilt_empty", "SELECT p_brand AS name, 0 :: BIGINT AS n FROM part GROUP BY 1")
def evo12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brand_2(spark, sf_dir).select("name", long(F.size(dictionaries.as_map(F.col("sizes")))).alias("n"))


@query("evo14_nullable", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_discount <> 0 THEN l_discount END AS discount FROM lineitem")
def evo14(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plain number read as a nullable one: what equalled its default was never stored, so it is null."""
    old, new = Obj("L", (Member("discount", DOUBLE),)), Obj("L", (Member("discount", Scalar(Kind.FLOAT64, nullable=True)),))
    wire = tables(spark, sf_dir)("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", presence.encode_member(F.col("l_discount"), old.member("discount")).alias("discount"))
    kinds = evolve.members(new, old, lambda m: F.col(m.name))
    return wire.select("l_orderkey", "l_linenumber", "l_partkey", presence.restore(kinds[0], new.member("discount")).alias("discount"))


@query("evo15_changed_default", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_discount = 0 THEN 0.5 ELSE l_discount END AS discount FROM lineitem")
def evo15(spark: SparkSession, sf_dir: str) -> DataFrame:
    wire = presence.encode_member(F.col("l_discount"), Member("d", DOUBLE))
    return tables(spark, sf_dir)("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", presence.restore(wire, Member("d", DOUBLE, default=0.5)).alias("discount"))


# ---- validation ------------------------------------------------------------------------------------------------


@query("val6_dictionary_sides", "SELECT p_brand, CASE WHEN count(DISTINCT p_size) % 2 = 1 THEN 'BadOffset' END AS error FROM part GROUP BY 1")
def val6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dictionaries with an odd number of keys lose their values here."""
    d = sizes_by_brand(spark, sf_dir).withColumn("d", F.struct("d.keys", F.when(F.size("d.keys") % 2 == 0, F.col("d.values")).alias("values")))
    return d.select("p_brand", validate.first_error(dictionary(INT, LONG), F.col("d")).alias("error"))


@query("val7_tag_check", "SELECT event_id, CASE WHEN event_type = 'purchase' THEN 'BadUnionTag' END AS error FROM events")
def val7(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = unions.restrict(F.col("u"), EVENT, EVENT_OLD)
    return events(spark, sf_dir).select("event_id", validate.first_error(EVENT_OLD, old).alias("error"))


CHAIN_SQL = """WITH RECURSIVE e AS (SELECT c_custkey AS node, CASE WHEN c_custkey % {m} <> 0 THEN c_custkey - 1 END AS parent FROM customer),
 d AS (SELECT node, 0 AS depth FROM e WHERE parent IS NULL UNION ALL SELECT e.node, depth + 1 FROM e JOIN d ON e.parent = d.node WHERE depth < {x})
SELECT e.node, d.depth, CASE WHEN d.depth IS NULL THEN 'TooDeep' END AS error FROM e LEFT JOIN d USING (node)"""


@query("val13_depth_limit", CHAIN_SQL.format(m=12, x=8))
def val13(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("c_custkey")
    edges = tables(spark, sf_dir)("customer").select(c.alias("node"), F.when(c % 12 != 0, c - 1).alias("parent"))
    return validate.depths(edges, max_depth=8)


@query("val16_cycles", "SELECT n_nationkey AS node, CASE WHEN n_regionkey = 0 THEN 'TooDeep' END AS error FROM nation")
def val16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations of region 0 point at themselves: a cycle, which has no root."""
    nation = tables(spark, sf_dir)("nation").select(F.col("n_nationkey").alias("node"), F.when(F.col("n_regionkey") == 0, F.col("n_nationkey")).alias("parent"))
    return validate.depths(nation, max_depth=4).select("node", "error")


# ---- texts and flags -------------------------------------------------------------------------------------------


@query("str3_utf8_valid", "SELECT doc_id, true AS ok, text AS repaired FROM documents")
def str3(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = text.utf8(F.col("text"))
    return tables(spark, sf_dir)("documents").select("doc_id", text.is_valid_utf8(raw).alias("ok"), text.repaired_utf8(raw).alias("repaired"))


@query("str5_flags", "SELECT o_orderkey, ((o_orderstatus = 'F') :: INTEGER | (CASE WHEN o_totalprice > 200000 THEN 2 ELSE 0 END) | (CASE WHEN o_orderpriority LIKE '1%' THEN 4 ELSE 0 END)) AS flags, o_totalprice > 200000 AS is_large FROM orders")
def str5(spark: SparkSession, sf_dir: str) -> DataFrame:
    bit = lambda cond, b: F.when(cond, b).otherwise(0)
    flags = bit(F.col("o_orderstatus") == "F", 1).bitwiseOR(bit(F.col("o_totalprice") > 200000, 2)).bitwiseOR(bit(F.col("o_orderpriority").startswith("1"), 4))
    return tables(spark, sf_dir)("orders").select("o_orderkey", flags.alias("flags"), text.has_flag(flags, 2).alias("is_large"))


# ---- statistics ------------------------------------------------------------------------------------------------


@query("ben1_field_sums", "SELECT count(*) AS n, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS quantity, CAST(sum(length(l_returnflag) + length(l_linestatus)) AS BIGINT) AS chars FROM lineitem")
def ben1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables(spark, sf_dir)("lineitem").agg(F.count("*").alias("n"), F.sum(money("l_quantity")).cast("double").alias("quantity"), F.sum(long(F.char_length("l_returnflag") + F.char_length("l_linestatus"))).alias("chars"))


@query("ben1_checksum")
def ben1b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.checksum(tables(spark, sf_dir)("lineitem"), "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_shipdate")


PICKS = [(i * 37) % 80 for i in range(20)]


@query("ben2_picks", "SELECT vec_id, CAST(" + " + ".join(f"coalesce(CAST(embedding[{i + 1}] AS DOUBLE), 0)" for i in PICKS) + " AS DOUBLE) AS total FROM embeddings")
def ben2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables(spark, sf_dir)("embeddings").select("vec_id", stats.picks(F.col("embedding"), PICKS).alias("total"))


@query("ben3_lookups", "SELECT count(*) AS n, count(p_partkey) AS hits, CAST(sum(CAST(p_retailprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM lineitem LEFT JOIN part ON p_partkey = l_partkey")
def ben3(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables(spark, sf_dir)
    df = t("lineitem").select("l_partkey").join(t("part").select("p_partkey", "p_retailprice"), F.col("p_partkey") == F.col("l_partkey"), "left")
    return df.agg(F.count("*").alias("n"), F.count("p_partkey").alias("hits"), F.sum(money("p_retailprice")).cast("double").alias("total"))


@query("ben4_median", "SELECT event_type, median(value) AS median FROM events GROUP BY 1")
def ben4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables(spark, sf_dir)("events").groupBy("event_type").agg(F.median("value").alias("median"))


@query("ben5_mad", "SELECT l_returnflag, median(l_quantity) AS median, mad(l_quantity) / median(l_quantity) * 100 AS mad_percent FROM lineitem GROUP BY 1")
def ben5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.mad_percent(tables(spark, sf_dir)("lineitem"), ["l_returnflag"], "l_quantity")


@query("ben6_geomean", "SELECT l_returnflag, round(exp(avg(ln(l_quantity))), 6) AS geomean, min(l_quantity) AS low, max(l_quantity) AS high FROM lineitem GROUP BY 1")
def ben6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables(spark, sf_dir)("lineitem").groupBy("l_returnflag").agg(F.round(stats.geometric_mean(F.col("l_quantity")), 6).alias("geomean"), F.min("l_quantity").alias("low"), F.max("l_quantity").alias("high"))


TIMES_SQL = "(SELECT l_shipmonth AS workload, l_returnflag AS library, CAST(avg(CAST(l_quantity AS INTEGER)) AS DOUBLE) AS t FROM (SELECT *, month(l_shipdate) AS l_shipmonth FROM lineitem) GROUP BY 1, 2)"


def times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Workload, library and time, made up from line items."""
    df = tables(spark, sf_dir)("lineitem").select(long(F.month("l_shipdate")).alias("workload"), F.col("l_returnflag").alias("library"), F.col("l_quantity").cast("int").alias("q"))
    return df.groupBy("workload", "library").agg(F.avg("q").alias("t"))


@query("ben7_best", f"SELECT workload, arg_min(library, (t, library)) AS best, min(t) AS best_value FROM {TIMES_SQL} GROUP BY 1")
def ben7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.best_per(times(spark, sf_dir), ["workload"], "library", "t")


@query("ben7_pivot", f"SELECT workload, max(t) FILTER (library = 'A') AS a, max(t) FILTER (library = 'N') AS n, max(t) FILTER (library = 'R') AS r FROM {TIMES_SQL} GROUP BY 1")
def ben7b(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = times(spark, sf_dir).groupBy("workload").pivot("library", ["A", "N", "R"]).agg(F.max("t"))
    return p.select("workload", F.col("A").alias("a"), F.col("N").alias("n"), F.col("R").alias("r"))


@query("ben8_slower", f"SELECT m.workload, o.library AS rival, m.t / o.t AS ratio FROM {TIMES_SQL} m JOIN {TIMES_SQL} o ON m.workload = o.workload AND m.library = 'A' AND o.library <> 'A' AND m.t > o.t * 1.01")
def ben8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.slower_than(times(spark, sf_dir), ["workload"], "library", "A", "t", 1.0)


@query("ben11_group_rows", "SELECT o_orderpriority, count(*) AS n, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY 1")
def ben11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables(spark, sf_dir)("orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.count_distinct("o_custkey").alias("customers"))


@query("ben10_gzip")
def ben10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables(spark, sf_dir)("documents").select("doc_id", stats.gzip_size(F.col("text")).alias("gzip_bytes"))

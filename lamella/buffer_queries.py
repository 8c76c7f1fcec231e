"""Registered queries of the binary format. What they encode, damage and decode comes from the flat tables, so SQL on
those tables gives the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.functions import arrays, presence
from lamella.model import Kind, Member, Obj, Scalar, Text, Vec, dictionary, fingerprint, own_fingerprint, reachable, spark_type
from lamella.queries import CUSTOMER_1, CUSTOMER_2, DOUBLE, EVENT, EVENT_OLD, INT, LONG, events, kinds_by_user, long, money, order_items, query, tables
from lamella.sources import buffers, codec

ITEM = Obj("Item", (Member("l_linenumber", INT), Member("l_partkey", LONG), Member("l_quantity", DOUBLE), Member("l_extendedprice", DOUBLE), Member("l_discount", DOUBLE), Member("l_returnflag", Text())))
ORDER = Obj("Order", (Member("o_orderkey", LONG, keep=True), Member("items", Vec(ITEM))))
ORDER_NEW = Obj("Order", (Member("items", Vec(Obj("Item", (Member("amount", DOUBLE, "l_quantity"), Member("l_linenumber", LONG), Member("currency", INT, default=7, keep=True))))), Member("o_orderkey", LONG, keep=True)))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in wire form: column o."""
    df = order_items(spark, sf_dir, ["l_discount", "l_returnflag"], spread=True)  # encoding is the costly part
    one = lambda x: presence.encode_record(ITEM, {m.name: x[m.name] for m in ITEM.all_members})
    return df.select("o_orderkey", F.struct("o_orderkey", F.transform("items", one).alias("items")).alias("o"))


def order_buffers(spark: SparkSession, sf_dir: str, options: codec.WriteOptions = codec.WriteOptions()) -> DataFrame:
    return orders(spark, sf_dir).select("o_orderkey", buffers.encoded(ORDER, F.col("o"), options).alias("b"))


ITEMS_SQL = "SELECT o_orderkey, count(l_orderkey) AS n, CAST(coalesce(sum(CAST(l_extendedprice AS DECIMAL(18,2))), 0) AS DOUBLE) AS price, count(*) FILTER (l_discount <> 0) AS n_discounts, count(l_orderkey) = 0 AS no_list FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1"


@query("src1_encode_decode", ITEMS_SQL)
@query("src4_decode", ITEMS_SQL)
def src1(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = order_buffers(spark, sf_dir).select(buffers.decoded(ORDER, F.col("b"), strict=True).alias("d"))
    items = F.col("d.value.items")
    price = F.aggregate(items, F.lit(0).cast("decimal(28,2)"), lambda s, x: (s + F.coalesce(money(x["l_extendedprice"]), F.lit(0))).cast("decimal(28,2)"))
    return d.select(
        F.col("d.value.o_orderkey"),
        long(arrays.length(items)).alias("n"),
        F.coalesce(price.cast("double"), F.lit(0.0)).alias("price"),
        long(F.coalesce(F.size(F.filter(items, lambda x: x["l_discount"].isNotNull())), F.lit(0))).alias("n_discounts"),
        items.isNull().alias("no_list"),
    )


def damaged(b: Column, how: Column) -> Column:
    """A buffer cut short, or with one header byte changed, by ``how``: 1 to 6; anything else leaves it. A changed
    fingerprint (6) is no error: the buffer's own schema is read then, and every member is found by its name."""
    put = lambda at, byte: F.concat(F.substring(b, 1, at), F.lit(bytes([byte])), F.substring(b, at + 2, 2**31 - 1))
    cut = F.when(how == 1, F.substring(b, 1, 15)).when(how == 2, put(4, 0)).when(how == 3, put(6, 99)).when(how == 4, put(7, 0x81)).when(how == 5, F.concat(F.lit(bytes([2, 0, 0, 0])), F.substring(b, 5, 2**31 - 1)))
    return cut.when(how == 6, put(8, 0)).otherwise(b)


DAMAGE_SQL = "SELECT o_orderkey, CASE o_orderkey % 7 WHEN 1 THEN 'TooSmall' WHEN 2 THEN 'BadMagic' WHEN 3 THEN 'BadVersion' WHEN 4 THEN 'ReservedBits' WHEN 5 THEN 'BadOffset' END AS error FROM orders"


@query("src5_try_decode", DAMAGE_SQL)
def src5(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    return order_buffers(spark, sf_dir).select(key, buffers.decoded(ORDER, damaged(F.col("b"), key % 7))["error"].alias("error"))


@query("val1_header_checks", DAMAGE_SQL)
@query("src9_verify_only", DAMAGE_SQL)
def src9(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    return order_buffers(spark, sf_dir).select(key, buffers.checked(ORDER, damaged(F.col("b"), key % 7)).alias("error"))


@query("src10_unchecked", "SELECT o_orderkey FROM orders")
def src10(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = order_buffers(spark, sf_dir).select(buffers.decoded(ORDER, F.col("b"), codec.ReadOptions(verify=False)).alias("d"))
    return d.select("d.value.o_orderkey")


@query("src7_open_other_version", "SELECT o_orderkey, count(l_orderkey) AS n, CAST(coalesce(sum(CAST(l_quantity AS DECIMAL(18,2))), 0) AS DOUBLE) AS amount, 0 :: BIGINT AS n_numbers, CAST(7 * count(l_orderkey) AS BIGINT) AS currency FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def src7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Read with another model: a renamed member, one of another kind, one that the writer didn't have."""
    d = order_buffers(spark, sf_dir).select(buffers.decoded(ORDER_NEW, F.col("b"), strict=True)["value"].alias("v"))
    items = F.col("v.items")
    amount = F.aggregate(items, F.lit(0).cast("decimal(28,2)"), lambda s, x: (s + F.coalesce(money(x["amount"]), F.lit(0))).cast("decimal(28,2)"))
    return d.select(
        "v.o_orderkey",
        long(arrays.length(items)).alias("n"),
        F.coalesce(amount.cast("double"), F.lit(0.0)).alias("amount"),
        long(F.coalesce(F.size(F.filter(items, lambda x: x["l_linenumber"].isNotNull())), F.lit(0))).alias("n_numbers"),
        F.coalesce(F.aggregate(items, F.lit(0).cast("bigint"), lambda s, x: s + x["currency"]), F.lit(0).cast("bigint")).alias("currency"),
    )


@query("src12_header", "SELECT o_orderkey, 2 :: BIGINT AS version, o_orderkey % 2 = 0 AS has_schema FROM orders")
def src12(spark: SparkSession, sf_dir: str) -> DataFrame:
    even = orders(spark, sf_dir)
    b = F.when(F.col("o_orderkey") % 2 == 0, buffers.encoded(ORDER, F.col("o"))).otherwise(buffers.encoded(ORDER, F.col("o"), codec.WriteOptions(schema=False)))
    h = even.select("o_orderkey", buffers.header(b).alias("h"))
    return h.select("o_orderkey", "h.version", "h.has_schema")


@query("evo1_same_fingerprint", "SELECT o_orderkey, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def evo1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members in another order have the same layout and fingerprint: no schema is needed."""
    turned = Obj("Order", (ORDER.members[1], ORDER.members[0]))
    b = order_buffers(spark, sf_dir, codec.WriteOptions(schema=False))
    d = b.select(buffers.decoded(turned, F.col("b"), strict=True)["value"].alias("v"))
    return d.select("v.o_orderkey", long(arrays.length(F.col("v.items"))).alias("n"))


@query("evo2_schema_mismatch", "SELECT o_orderkey, 'SchemaMismatch' AS error FROM orders")
def evo2(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = order_buffers(spark, sf_dir, codec.WriteOptions(schema=False))
    return b.select("o_orderkey", buffers.checked(ORDER_NEW, F.col("b")).alias("error"))


@query("evo13_sharing_kept", "SELECT l_returnflag, count(*) AS n FROM lineitem SEMI JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")
def evo13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fully shared buffers decode to the same values."""
    d = order_buffers(spark, sf_dir, codec.WriteOptions(sharing="all")).select(F.explode(buffers.decoded(ORDER, F.col("b"), strict=True)["value"]["items"]).alias("x"))
    return d.groupBy(F.col("x.l_returnflag").alias("l_returnflag")).agg(F.count("*").alias("n"))


@query("ded1_sharing_levels", "SELECT count(*) AS n, true AS strings_smaller, true AS all_smaller FROM orders")
def ded1(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = F.col("o")
    size = lambda how: F.octet_length(buffers.encoded(ORDER, o, codec.WriteOptions(sharing=how)))
    sizes = orders(spark, sf_dir).select(size("none").alias("a"), size("strings").alias("b"), size("all").alias("c"))
    return sizes.agg(F.count("*").alias("n"), F.bool_and(F.col("b") <= F.col("a")).alias("strings_smaller"), F.bool_and(F.col("c") <= F.col("b")).alias("all_smaller"))


CUSTOMER_V2_SQL = "SELECT c_custkey AS id, c_name AS display_name, 50 :: BIGINT AS credit, NULL :: BIGINT AS c_nationkey, NULL :: VARCHAR AS title FROM customer"


@query("evo_binary_customer", CUSTOMER_V2_SQL)
def evo_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    record = presence.encode_record(CUSTOMER_1, {m.name: F.col(m.name) for m in CUSTOMER_1.all_members})
    d = tables(spark, sf_dir)("customer").select(buffers.decoded(CUSTOMER_2, buffers.encoded(CUSTOMER_1, record), strict=True)["value"].alias("v"))
    return d.select("v.id", "v.display_name", "v.credit", "v.c_nationkey", "v.title")


HOLDER, HOLDER_OLD = Obj("Holder", (Member("event_id", LONG, keep=True), Member("u", EVENT))), Obj("Holder", (Member("event_id", LONG, keep=True), Member("u", EVENT_OLD)))


@query("uni5_binary_unknown", f"SELECT event_id, CASE event_type WHEN 'click' THEN {EVENT.tag_of('Click')} WHEN 'purchase' THEN {EVENT.tag_of('Purchase')} ELSE {EVENT.tag_of('Other')} END :: BIGINT AS tag, event_type <> 'purchase' AS has_record FROM events")
def uni5_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = events(spark, sf_dir).select(buffers.encoded(HOLDER, F.struct("event_id", "u")).alias("b"))
    d = b.select(buffers.decoded(HOLDER_OLD, F.col("b"), strict=True)["value"].alias("v"))
    return d.select("v.event_id", "v.u.tag", (F.col("v.u.Click").isNotNull() | F.col("v.u.Other").isNotNull()).alias("has_record"))


@query("val7_binary_tag", "SELECT event_id, CASE WHEN event_type = 'purchase' THEN 'BadUnionTag' END AS error FROM events")
def val7_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The purchase tag's bytes are replaced by a tag that nobody has."""
    tag = EVENT.tag_of("Purchase").to_bytes(4, "little")
    b = events(spark, sf_dir).select("event_id", F.hex(buffers.encoded(HOLDER, F.struct("event_id", "u"), codec.WriteOptions(schema=False))).alias("h"))
    return b.select("event_id", buffers.checked(HOLDER, F.unhex(F.replace("h", F.lit(tag.hex().upper()), F.lit("01000000")))).alias("error"))


NAMES = Obj("Names", (Member("k", LONG, keep=True), Member("d", dictionary(Text(), INT))))


@query("map2_binary_order", "SELECT user_id, count(DISTINCT event_type) AS n, min(event_type) AS first_key FROM events GROUP BY 1")
def map2_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys are sorted while they are written, whatever order they come in."""
    d = kinds_by_user(spark, sf_dir).groupBy("user_id").agg(F.collect_list(F.struct("event_type", F.col("n").cast("int").alias("n"))).alias("e"))
    record = F.struct(F.col("user_id").alias("k"), F.struct(F.col("e.event_type").alias("keys"), F.col("e.n").alias("values")).alias("d"))
    v = d.select(buffers.decoded(NAMES, buffers.encoded(NAMES, record), strict=True)["value"].alias("v"))
    return v.select(F.col("v.k").alias("user_id"), long(F.size("v.d.keys")).alias("n"), F.get("v.d.keys", F.lit(0)).alias("first_key"))


@query("jsn_binary_json", """SELECT n_nationkey, '{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || CASE WHEN n_regionkey <> 0 THEN ',"n_regionkey":' || n_regionkey ELSE '' END || '}' AS json FROM nation""")
def jsn_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lamella.queries import NATION

    record = presence.encode_record(NATION, {m.name: F.col(m.name) for m in NATION.all_members})
    return tables(spark, sf_dir)("nation").select("n_nationkey", buffers.buffer_json(NATION, buffers.encoded(NATION, record)).alias("json"))


OPTIONAL = Obj("Optional", (Member("l_orderkey", LONG, keep=True), Member("discounts", Vec(Scalar(Kind.FLOAT64, nullable=True)))))


@query("arr14_binary_optional", "SELECT l_orderkey, count(*) AS n, count(*) FILTER (l_discount <> 0) AS n_present FROM lineitem GROUP BY 1")
def arr14_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = F.struct(presence.elide(F.col("l_discount"), 0.0, floating=True).alias("v"))
    lists = tables(spark, sf_dir)("lineitem").groupBy("l_orderkey").agg(F.transform(F.collect_list(kept), lambda s: s["v"]).alias("discounts"))
    d = lists.select(buffers.decoded(OPTIONAL, buffers.encoded(OPTIONAL, F.struct("l_orderkey", "discounts")), strict=True)["value"].alias("v"))
    return d.select("v.l_orderkey", long(F.size("v.discounts")).alias("n"), long(arrays.present(F.col("v.discounts"))).alias("n_present"))


@query("sch_fingerprints")
def sch_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layout, own and deep fingerprints of the models used here (SCH-1 to SCH-7, HSH-1, HSH-2)."""
    rows = []
    for root in (ORDER, ORDER_NEW, CUSTOMER_1, CUSTOMER_2, HOLDER, NAMES):
        for t in reachable(root):
            rows.append((root.name, type(t).__name__, f"{own_fingerprint(t):016x}", f"{fingerprint(t):016x}"))
    return spark.createDataFrame(rows, "root string, type string, own string, deep string")


@query("sch8_schema_sections", "SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN 3 END :: BIGINT AS entries, CASE WHEN event_id % 5 <> 0 THEN CASE WHEN event_type IN ('click', 'purchase') THEN 7 ELSE 6 END END :: BIGINT AS members, CASE WHEN event_id % 5 = 0 THEN 'BadSchema' END AS error FROM events")
def sch8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every buffer's own schema section, parsed: the holder, the union and the one member that was written. In each fifth
    the number of entries is put to zero."""
    b = events(spark, sf_dir).select("event_id", buffers.encoded(HOLDER, F.struct("event_id", "u")).alias("b"))
    broken = F.concat(F.substring("b", 1, codec.HEADER + 4), F.lit(bytes(2)), F.substring("b", codec.HEADER + 7, 2**31 - 1))
    return b.select("event_id", buffers.schema_section(F.when(F.col("event_id") % 5 == 0, broken).otherwise(F.col("b"))).alias("s")).select("event_id", "s.*")


@query("src6_open_member", "SELECT o_orderkey, CAST(coalesce(sum(CAST(l_quantity AS DECIMAL(18,2))), 0) AS DOUBLE) AS quantity, count(l_returnflag) AS n_flags, min(l_returnflag) AS least_flag FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def src6_member(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single members read in place (SRC-6, PRJ-4): nothing else of a buffer is decoded."""
    one = lambda path: buffers.member(ORDER, F.col("b"), path, codec.ReadOptions(verify=False))
    df = order_buffers(spark, sf_dir).select(one("o_orderkey").alias("o_orderkey"), one("items.l_quantity").alias("q"), one("items.l_returnflag").alias("f"))
    quantity = F.aggregate("q", F.lit(0).cast("decimal(28,2)"), lambda s, x: (s + F.coalesce(money(x), F.lit(0))).cast("decimal(28,2)"))
    return df.select("o_orderkey", F.coalesce(quantity.cast("double"), F.lit(0.0)).alias("quantity"), long(F.coalesce(F.size(F.filter("f", lambda x: x.isNotNull())), F.lit(0))).alias("n_flags"), F.array_min("f").alias("least_flag"))


LINK = Obj("Link")
LINK.define(Member("value", LONG), Member("next", LINK))
LINKS = 12


@query("src4_deep_records", "SELECT p_partkey, CASE WHEN p_partkey % 12 + 1 > 8 THEN 'TooDeep' END AS error, CASE WHEN p_partkey % 12 + 1 <= 8 THEN p_partkey % 12 + 1 END :: BIGINT AS at_8, p_partkey % 12 + 1 AS at_12 FROM part")
def src4_deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of 1 to 12 records that hold each other. A column of eight levels says TooDeep of longer ones, a deeper
    column holds them."""
    n = F.col("p_partkey") % LINKS + 1
    chain = F.lit(None).cast(spark_type(LINK, 1))
    for level in range(LINKS, 0, -1):
        chain = F.when(n >= level, F.struct(F.lit(1).cast("bigint").alias("value"), chain.alias("next")))
    b = tables(spark, sf_dir)("part").select("p_partkey", buffers.encoded(LINK, chain).alias("b"))

    def sum_of(c: Column, levels: int) -> Column:
        total = F.lit(0).cast("bigint")
        for _ in range(levels):
            total, c = total + F.coalesce(c["value"], F.lit(0)), c["next"]
        return total + F.coalesce(c["value"], F.lit(0))

    d = b.select("p_partkey", buffers.decoded(LINK, F.col("b")).alias("a"), buffers.decoded(LINK, F.col("b"), depth=LINKS, strict=True)["value"].alias("z"))
    return d.select("p_partkey", "a.error", F.when(F.col("a.error").isNull(), sum_of(F.col("a.value"), 7)).alias("at_8"), sum_of(F.col("z"), LINKS - 1).alias("at_12"))


@query("ben1_binary_checksum")
def ben1_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order-dependent checksums of decoded lists."""
    from lamella.operators.stats import ordered_checksum

    d = order_buffers(spark, sf_dir).select(buffers.decoded(ORDER, F.col("b"), strict=True)["value"].alias("v"))
    return d.select("v.o_orderkey", ordered_checksum(F.transform("v.items", lambda x: x["l_quantity"])).alias("checksum"))



"""Sorted dictionaries, kept as ``struct<keys, values>``: keys ascending (strings by code point), values beside them.

Spark maps have no order, refuse duplicate keys and can't hold more keys than values, all of which may occur here.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def build(key: Column, value: Column) -> Column:
    """Aggregate: a group's entries as a dictionary. Null keys have no place and are left out."""
    entries = F.filter(F.array_sort(F.collect_list(F.struct(key.alias("k"), value.alias("v")))), lambda e: e["k"].isNotNull())
    return F.struct(F.transform(entries, lambda e: e["k"]).alias("keys"), F.transform(entries, lambda e: e["v"]).alias("values"))


def sort(d: Column, n: Column | None = None) -> Column:
    """The first n (default: all) keys in order, with their values; already sorted ones come back as they are."""
    n = F.size(d["keys"]) if n is None else n
    pairs = F.array_sort(F.arrays_zip(F.slice(d["keys"], 1, n).alias("k"), F.slice(d["values"], 1, n).alias("v")))
    return F.struct(F.transform(pairs, lambda p: p["k"]).alias("keys"), F.transform(pairs, lambda p: p["v"]).alias("values"))


def is_sorted(d: Column) -> Column:
    """Whether keys ascend strictly."""
    k = d["keys"]
    return F.forall(F.transform(k, lambda x, i: (i == 0) | (x > F.get(k, i - 1))), lambda ok: ok)


def count(d: Column) -> Column:
    """Entries; 0 for an absent dictionary."""
    return F.coalesce(F.size(d["keys"]), F.lit(0))


#: Up to so many keys a scan, which is compiled, is faster than a search, which isn't.
SCANNED = 32


def index_of(d: Column, key: Column) -> Column:
    """Position of a key from 0, or -1. Keys ascend, so a long dictionary is searched by halves."""
    keys, n = d["keys"], F.size(d["keys"])

    def halve(s: Column, _: Column) -> Column:
        middle = F.shiftright(s["low"] + s["high"], 1)
        right = F.get(keys, middle) < key
        return F.struct(F.when(right, middle + 1).otherwise(s["low"]).alias("low"), F.when(right, s["high"]).otherwise(middle).alias("high"))

    rounds = F.sequence(F.lit(1), F.ceil(F.log2(n + 1)).cast("int"))  # low and high meet by then
    low = F.aggregate(rounds, F.struct(F.lit(0).alias("low"), n.alias("high")), lambda s, i: F.when(s["low"] < s["high"], halve(s, i)).otherwise(s), lambda s: s["low"])
    scanned = F.array_position(keys, key).cast("int") - 1
    return F.coalesce(F.when(n <= SCANNED, scanned).when(F.get(keys, low) == key, low), F.lit(-1))


def contains(d: Column, key: Column) -> Column:
    return index_of(d, key) >= 0


def find(d: Column, key: Column) -> Column:
    """The key's value; null on a miss, also when there are fewer values than keys."""
    return F.get(d["values"], index_of(d, key))


def at(d: Column, key: Column) -> Column:
    """The key's value; a miss is an error."""
    return F.when(index_of(d, key) < 0, F.raise_error("no such key")).otherwise(find(d, key))


def as_map(d: Column) -> Column:
    """A Spark map of the entries that have both a key and a place for a value; for unique keys."""
    n = F.least(F.size(d["keys"]), F.size(d["values"]))
    return F.map_from_arrays(F.slice(d["keys"], 1, n), F.slice(d["values"], 1, n))

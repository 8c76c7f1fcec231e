"""Near-duplicate documents by one-permutation MinHash.

A document's shingles are hashed once; the hash's high part names one of ``bins`` bins, the smallest hash in a bin is
its value. Empty bins borrow by optimal densification: a second hash of (bin, attempt) picks the donor. Bands of
values make buckets. In a bucket, up to ``hubs`` members chosen by hash are joined to every member: stars, so pairs
grow with the bucket's size and not with its square. Pairs are confirmed on full shingle sets: first those of each
bucket's smallest id, then, of those with the bucket's other hubs, the ones that lie across components so far. Members
that are no hubs and still lie in several components go through an exact search: sets that are similar enough share a
shingle among the rarest of each (prefix filter), and all such pairs across components are confirmed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.llm.common import SLICE, release, scratch, table

MASK = (1 << 64) - 1
#: Fixed odd multipliers that tell the places of a word in a shingle apart.
_PLACE = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)


class WordHashes(dict):
    """Words to 64-bit hashes, kept while there are not too many."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < 200_000:
            self[word] = value
        return value


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | bytes | None, words: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a whole text's shingles; fewer words than that make one shingle of all of
    them, no words none. ASCII letters are lower-cased, words end at ``[\\x20\\x09-\\x0D]``."""
    data = text.encode("utf-8", "replace") if isinstance(text, str) else text or b""
    found = data.lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, found), dtype=np.uint64, count=len(found))
    if len(found) < words:
        whole = xxhash.xxh3_64_intdigest(b" ".join(found), seed=len(found))
        return np.array([whole], dtype=np.uint64)
    n = len(found) - words + 1
    total = np.zeros(n, np.uint64)
    for i in range(words):
        total += _mix(h[i : i + n] * _PLACE[i])
    return np.unique(_mix(total))


class Signer:
    """Signatures and band keys of shingle sets."""

    def __init__(self, bands: int, rows: int):
        self.bands, self.rows, self.bins = bands, rows, bands * rows
        bins = np.arange(self.bins, dtype=np.uint64)
        # donors[t][b]: the bin that empty bin b asks at its t-th attempt
        tries = np.arange(64, dtype=np.uint64)[:, None]
        self.donors = (_mix(_mix(bins + np.uint64(1)) + tries * _PLACE[0]) % np.uint64(self.bins)).astype(np.int64)
        self.mult = _mix(np.arange(1, self.rows + 1, dtype=np.uint64)) | np.uint64(1)
        self.band = _mix(np.arange(1, self.bands + 1, dtype=np.uint64) * _PLACE[1])

    def sign(self, shingles: np.ndarray) -> np.ndarray:
        """One value per bin of a sorted, non-empty set."""
        at = ((shingles >> np.uint64(32)) * np.uint64(self.bins) >> np.uint64(32)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        out = np.zeros(self.bins, np.uint64)
        full = np.zeros(self.bins, bool)
        out[at[first]] = shingles[first]
        full[at[first]] = True
        empty = np.flatnonzero(~full)
        for t in range(len(self.donors)):
            if not len(empty):
                break
            donor = self.donors[t][empty]
            ok = full[donor]
            out[empty[ok]] = out[donor[ok]]
            empty = empty[~ok]
        if len(empty):  # hardly ever: few full bins; the next full one to the right, around the end
            places = np.flatnonzero(full)
            out[empty] = out[places[np.searchsorted(places, empty) % len(places)]]
        return out

    def keys(self, signature: np.ndarray) -> np.ndarray:
        """A 64-bit key per band."""
        values = _mix(signature.reshape(self.bands, self.rows) * self.mult).sum(axis=1, dtype=np.uint64)
        return _mix(values ^ self.band)


def signatures(docs: DataFrame, text: str, doc_id: str, *, words: int, bands: int, rows: int) -> DataFrame:
    """Per row: k (the id), n (shingles), ha, hb (hash of the word sequence), keys (band keys; null without words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, signer = WordHashes(), Signer(bands, rows)
        for whole in batches:
            for i in range(0, whole.num_rows, SLICE):
                part = whole.slice(i, SLICE)
                n, keys, ha, hb = [], [], [], []
                for t in part.column(1).cast(pa.binary()).to_pylist():
                    s = shingle_set(t, words, hashes)
                    n.append(len(s))
                    keys.append(signer.keys(signer.sign(s)).view(np.int64) if len(s) else None)
                    norm = b" ".join((t or b"").lower().split())
                    h = xxhash.xxh3_128_intdigest(norm)
                    ha.append((h >> 64) - (1 << 63))
                    hb.append((h & MASK) - (1 << 63))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, pa.int64()), pa.array(ha, pa.int64()), pa.array(hb, pa.int64()), pa.array(keys, pa.list_(pa.int64()))],
                    names=["k", "n", "ha", "hb", "keys"],
                )

    kind = "k bigint, n bigint, ha bigint, hb bigint, keys array<bigint>"
    return docs.select(F.col(doc_id).alias("k"), F.col(text).alias("t")).mapInArrow(run, kind)


def shared_buckets(bands: DataFrame, hubs: int) -> DataFrame:
    """The rows of ``bands`` (b, a bucket, and k, an integer id) whose bucket has others, with the bucket's hubs.

    A bucket's first hub is its smallest id, so that copies of one text meet the same hub in all their buckets. The
    others are the ids that are smallest after their bits are flipped by a hash of the bucket, so different buckets
    choose different ones. Minima combine on the map side, which keeps a very large bucket out of any single task.
    """
    salt = lambda i: F.xxhash64("b", F.lit(i))
    small = bands.groupBy("b").agg(F.count("*").alias("c"), F.min("k").alias("h0"), *(F.min(F.col("k").bitwiseXOR(salt(i))).alias(f"h{i}") for i in range(1, hubs)))
    found = small.where("c > 1").select("b", F.array_distinct(F.array(F.col("h0"), *(F.col(f"h{i}").bitwiseXOR(salt(i)) for i in range(1, hubs)))).alias("hubs"))
    return bands.join(table(found, "hubs").hint("merge"), "b")


def star_pairs(shared: DataFrame) -> DataFrame:
    """Distinct pairs (a < b) of a hub and a member of its bucket, and whether the hub is a ``first`` one."""
    stars = shared.select("k", F.posexplode("hubs").alias("i", "h")).where("k <> h")
    return stars.groupBy(F.least("k", "h").alias("a"), F.greatest("k", "h").alias("b")).agg(F.bool_or(F.col("i") == 0).alias("first"))


def unproven(shared: DataFrame, label: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(k, c, w): the ids that share a bucket with one of another component while neither is its hub, their components,
    and how many such ids each component has."""
    members = label(shared.where(~F.array_contains("hubs", F.col("k"))).select("b", "k"))
    mixed = members.groupBy("b").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("b")
    left = table(members.join(mixed.hint("merge"), "b").select("k", "c").distinct(), "unproven")
    return left.join(left.groupBy("c").agg(F.count("*").alias("w")).hint("merge"), "c")


def shingle_sets(texts: DataFrame, words: int) -> DataFrame:
    """(k, c, w, s): s is the sorted array of the shingle hashes of a text t."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for whole in batches:
            for i in range(0, whole.num_rows, SLICE):
                part = whole.slice(i, SLICE)
                sets = [shingle_set(t, words, hashes).view(np.int64) for t in part.column(3).cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(sets, pa.list_(pa.int64()))], names=["k", "c", "w", "s"])

    return texts.select("k", "c", "w", "t").mapInArrow(run, "k bigint, c bigint, w bigint, s array<bigint>")


#: So many frequent shingles at most (16 bytes each) are sent to every task; more of them are joined.
FEW_FREQUENT = 1 << 18


def with_frequent(sets: DataFrame, frequent: int) -> tuple[DataFrame, tuple[np.ndarray, np.ndarray] | None]:
    """Which shingles stand in at least ``frequent`` of the sets, and in how many: counts are exact and combine on the map
    side. Up to ``FEW_FREQUENT`` of them come as (sorted shingles, counts) for all; beyond that ``sets`` has a column f of
    each row's own ones, and the rows of a hot shingle are joined with its one count."""
    each = sets.select("k", F.explode("s").alias("x"))
    often = table(each.groupBy("x").agg(F.count("*").alias("n")).where(F.col("n") >= frequent), "frequent")
    none = F.lit(None).cast("array<struct<x:bigint,n:bigint>>")
    if often.count() <= FEW_FREQUENT:
        found = often.toArrow()
        x, n = found["x"].to_numpy().view(np.uint64), found["n"].to_numpy()
        order = np.argsort(x)
        return sets.withColumn("f", none), (x[order], n[order])
    marks = each.join(often.hint("merge"), "x").groupBy("k").agg(F.collect_list(F.struct("x", "n")).alias("f"))
    return sets.join(table(marks, "marks").hint("merge"), "k", "left"), None


def prefixes(sets: DataFrame, often: tuple[np.ndarray, np.ndarray] | None, percent: int) -> DataFrame:
    """Of each set's n shingles, frequent ones last, those that a link with no larger set must meet: s at place pos. With
    a larger set, or one as large, it must meet one of those that are ``indexed``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, SLICE):
                part = whole.slice(i, SLICE)
                at, found, pos, n, indexed = [], [], [], [], []
                for row in range(part.num_rows):
                    own = part.column(3)[row].values.to_numpy()
                    size, count = len(own), np.zeros(len(own), np.int64)
                    if often is not None and len(often[0]):
                        place = np.minimum(np.searchsorted(often[0], own.view(np.uint64)), len(often[0]) - 1)
                        count = np.where(often[0][place] == own.view(np.uint64), often[1][place], 0)
                    elif part.column(4)[row].is_valid:
                        mine = part.column(4)[row].values
                        count[np.searchsorted(own.view(np.uint64), mine.field("x").to_numpy().view(np.uint64))] = mine.field("n").to_numpy()
                    most = size + percent * size // -100 + 1 if size else 0
                    most_indexed = size + 2 * percent * size // -(100 + percent) + 1
                    first = own[np.lexsort((own, count))[:most]]
                    places = np.arange(1, len(first) + 1)
                    at.append(np.full(len(first), row))
                    found.append(first)
                    pos.append(places)
                    n.append(np.full(len(first), size))
                    indexed.append(places <= most_indexed)
                rows = pa.array(np.concatenate(at))
                new = [pa.array(np.concatenate(x)) for x in (found, pos, n, indexed)]
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(rows) for c in range(3)), *new], names=["k", "c", "w", "s", "pos", "n", "indexed"])

    return sets.select("k", "c", "w", "s", "f").mapInArrow(run, "k bigint, c bigint, w bigint, s bigint, pos bigint, n bigint, indexed boolean")


def prefix_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """All pairs (a < b, with their components ca and cb) of ``prefixes`` that can be links across components. Of the ids
    at a shingle, those of the largest component meet only the others, so a group of near copies costs no pairs."""
    rows = table(rows, "prefixes")
    places = rows.groupBy("s").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.max_by("c", F.struct("w", "c")).alias("major")).where("lo <> hi")
    rows = table(rows.join(places.select("s", "major").hint("merge"), "s"), "places")
    index = rows.where("indexed").select("s", (F.col("c") != F.col("major")).cast("int").alias("g"), F.col("k").alias("b"), F.col("c").alias("cb"), F.col("pos").alias("j"), F.col("n").alias("m"))
    sides = F.when(F.col("c") == F.col("major"), F.array(F.lit(1))).otherwise(F.array(F.lit(0), F.lit(1)))
    probe = rows.select("s", F.explode(sides).alias("g"), F.col("k").alias("a"), F.col("c").alias("ca"), F.col("pos").alias("i"), "n")
    # What two sets share stands at or behind the first shingle where they meet.
    enough = F.expr(f"{100 + percent} * (1 + least(n - i, m - j)) >= {percent} * (n + m)")
    both = probe.join(index.hint("merge"), (probe["s"] == index["s"]) & (probe["g"] == index["g"]) & F.expr("ca <> cb and (m < n or (m = n and b < a))") & enough)
    turned = F.col("a") > F.col("b")
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.when(turned, F.col("cb")).otherwise(F.col("ca")).alias("ca"), F.when(turned, F.col("ca")).otherwise(F.col("cb")).alias("cb")).distinct()


def confirmed(pairs: DataFrame, texts: DataFrame, *, words: int, percent: int) -> DataFrame:
    """The pairs whose full shingle sets have 100 * intersection >= percent * union. ``texts`` has k and t, one row
    for each id. Rows stream through two joins; no group is gathered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, last, own = WordHashes(), None, None
        for whole in batches:
            for i in range(0, whole.num_rows, SLICE):
                part = whole.slice(i, SLICE)
                a, b = part.column(0).to_pylist(), part.column(1).to_pylist()
                ta, tb = (part.column(c).cast(pa.binary()).to_pylist() for c in (2, 3))
                keep = []
                for x, tx, ty in zip(a, ta, tb):
                    if x != last:
                        last, own = x, shingle_set(tx, words, hashes)
                    other = shingle_set(ty, words, hashes)
                    both = len(np.intersect1d(own, other, assume_unique=True))
                    keep.append(100 * both >= percent * (len(own) + len(other) - both))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    named = lambda k, t: texts.select(F.col("k").alias(k), F.col("t").alias(t))
    both = pairs.join(named("b", "tb").hint("merge"), "b").join(named("a", "ta").hint("merge"), "a").select("a", "b", "ta", "tb")
    return both.mapInArrow(run, pairs.select("a", "b").schema)


def components(edges: DataFrame) -> DataFrame:
    """(k, component) of every id in ``edges`` (a, b): component is the smallest id it reaches. Each round moves all
    ids to their smallest neighbour and contracts the edges, so rounds grow with the logarithm of the longest path.
    Everything is in written tables; nothing is gathered on the driver."""
    edges = table(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    at = table(edges.select(F.col("a").alias("k"), F.col("b").alias("component")).limit(0), "labels")
    first = True
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        step = table(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("p")), "step")
        if first:
            labels, first = step.select("k", F.col("p").alias("component")), False
        else:
            moved = at.join(step.select(F.col("k").alias("component"), "p"), "component", "left")
            labels = moved.select("k", F.coalesce("p", "component").alias("component"))
        to = lambda c: step.select(F.col("k").alias(c), F.col("p").alias(f"p{c}"))  # noqa: E731, B023
        moved = edges.join(to("a"), "a").join(to("b"), "b").where("pa <> pb")
        before, at, edges = (at, edges, step), table(labels, "labels"), table(moved.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "edges")
        release(*before)
    release(edges)
    return at


def merged(pairs: DataFrame, texts: DataFrame, *, words: int, percent: int) -> DataFrame:
    """``components`` over components: those of ``pairs`` (a, b, and their components ca and cb) that are links."""
    more = confirmed(pairs.select("a", "b"), texts, words=words, percent=percent).join(pairs.hint("merge"), ["a", "b"])
    return components(more.select(F.col("ca").alias("a"), F.col("cb").alias("b")))


def near_duplicates(
    docs: DataFrame,
    *,
    text: str = "text",
    doc_id: str = "doc_id",
    words: int = 5,
    percent: int = 80,
    bands: int = 36,
    rows: int = 5,
    hubs: int = 3,
    frequent: int = 32,
) -> DataFrame:
    """Per row of ``docs``: the id, n_shingles (size of its shingle set), component_id (smallest id reachable over
    links, itself included) and kept (whether that is the row's own id). Two documents are linked if their sets have
    100 * intersection >= percent * union; links are confirmed on full sets.

    Texts with equal word sequences are one class, represented by its smallest id; only classes take part in the
    search. With the defaults a pair at similarity 0.8 shares no bucket with a probability of 6e-7, at 0.85 of 7e-10.
    Shingles are compared as 64-bit hashes (sums of mixed word hashes), in n_shingles and in the confirmation too: two
    different ones agree with a probability of about 2 ** -64 a pair.

    What hubs leave unproven is searched exactly by prefixes; shingles in fewer than ``frequent`` of those texts come
    first in them, so each costs a text less than ``frequent`` pairs. Only texts that consist of frequent shingles almost
    wholly (mixtures of few passages) cost pairs by the square of their number.

    Ids are integers. Rows that repeat an id are one document in the links, confirmed on the largest of its texts;
    every row is returned. A null id is linked with nothing and its component is null, kept true. Null and empty texts, or texts without
    words, have no shingles and are linked with nothing. An empty table gives an empty result. Other columns are
    ignored.

    Joins carry hints: the sides grow with the input, so the plan is the same at every size.
    """
    with scratch() as kept:
        signed, at, steps = _search(docs.select(F.col(doc_id).cast("bigint").alias("k"), F.col(text).alias("t")), words, percent, bands, rows, hubs, frequent)
        kept += [signed, at, *steps]
    out = _labelled(signed.select("k", "n"), at, steps)
    component = F.col("c")
    return out.select(F.col("k").alias(doc_id), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("k"), F.lit(True)).alias("kept"))


def _labelled(df: DataFrame, at: DataFrame, steps: Sequence[DataFrame]) -> DataFrame:
    """``df`` with c: the component of k after these steps."""
    out = df.join(at.hint("merge"), "k", "left").withColumn("c", F.coalesce("component", "k")).drop("component")
    for step in steps:
        out = out.join(step.select(F.col("k").alias("c"), F.col("component").alias("c2")).hint("merge"), "c", "left").withColumn("c", F.coalesce("c2", "c")).drop("c2")
    return out


def _search(docs: DataFrame, words: int, percent: int, bands: int, rows: int, hubs: int, frequent: int) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """(k and n of each row, component by k, components over components): written tables."""
    signed = table(signatures(docs, "t", "k", words=words, bands=bands, rows=rows), "signed")
    named = signed.where("k is not null and n > 0")
    classes = table(named.groupBy("ha", "hb").agg(F.min("k").alias("rep"), F.count("*").alias("copies")).where("copies > 1"), "classes")
    member = named.select("k", "ha", "hb", "keys").join(classes.hint("merge"), ["ha", "hb"], "left").select("k", F.coalesce("rep", "k").alias("rep"), "keys")
    reps = member.where("k = rep")
    banded = reps.select("k", F.explode("keys").alias("b"))
    shared = table(shared_buckets(banded, hubs), "shared")
    pairs = table(star_pairs(shared), "pairs")
    wanted = pairs.select(F.col("a").alias("k")).union(pairs.select(F.col("b"))).distinct()
    texts = table(docs.join(wanted.hint("shuffle_hash"), "k", "left_semi").groupBy("k").agg(F.max("t").alias("t")), "texts")
    # Copies and repeated ids link as they are: (representative, copy).
    same = member.where("k <> rep").select(F.col("rep").alias("a"), F.col("k").alias("b"))
    links = confirmed(pairs.where("first"), texts, words=words, percent=percent)
    at = components(links.union(same))
    # What the first hubs have joined needs no further test: only pairs across components are left.
    label = lambda c: at.select(F.col("k").alias(c), F.col("component").alias(f"c{c}")).hint("merge")
    rest = pairs.where("not first").join(label("a"), "a", "left").join(label("b"), "b", "left")
    rest = table(rest.select("a", "b", F.coalesce("ca", "a").alias("ca"), F.coalesce("cb", "b").alias("cb")).where("ca <> cb"), "rest")
    joined = merged(rest, texts, words=words, percent=percent)

    # What no star can prove: an exact search among the ids that large buckets leave in several components.
    left = table(unproven(shared, lambda df: _labelled(df, at, [joined])), "left")
    steps = [joined]
    if not left.isEmpty():
        sets = table(shingle_sets(left.join(texts.hint("merge"), "k"), words), "sets")
        steps.append(merged(table(prefix_pairs(prefixes(*with_frequent(sets, frequent), percent), percent), "rest"), texts, words=words, percent=percent))
    return signed, at, steps


def drop_near_duplicates(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", **how) -> DataFrame:
    """The rows of ``docs`` that ``near_duplicates`` keeps, one document of each group, with all columns as they are.
    Rows that repeat a kept id all stay."""
    found = near_duplicates(docs, text=text, doc_id=doc_id, **how)
    gone = found.where("not kept").select(F.col(doc_id).alias("_lamella_gone")).distinct()
    return docs.join(gone, docs[doc_id].cast("bigint") == gone["_lamella_gone"], "left_anti")

"""Exact top-k search by inner product over norm buckets.

Vectors are cut into blocks and buckets of similar length, longest first. For a query with k-th best score s so far, a
bucket whose longest vector has length l needs cosine s / (|q| * l): above 1 the bucket and all later ones are skipped;
when it is high, a few large coordinates of the query bound what a vector's coordinates must be; else lengths alone cut
the bucket's tail. Whatever is left is verified with exact integer products.

The block of the longest vectors is searched first. The scores found there are bounds for all other blocks: a block that
is too short for a query isn't sent to it, and the others start from the bound. Vectors of one length (unit vectors) can't
be told apart by length; of these only the cosine test by coordinates skips any.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamella.llm.common import partitions, release, table

#: Rows of a bucket, and the local cosine threshold from which coordinates prune better than lengths.
BUCKET, COORDINATE_FROM, FOCUS = 256, 0.8, 4


def quantised(vector: Column, scale: float = 1024.0) -> Column:
    """floor(scale * x) of each component, x as double; null for a null vector or any null or non-finite component.
    Values beyond 64 bits end at their limits."""
    x = vector.cast("array<double>")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))))
    return F.when(fine, F.transform(x, lambda v: F.floor(F.lit(scale) * v)))


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    flat = pa.concat_arrays(column.chunks).flatten() if column.num_chunks else pa.array([], pa.int64())
    return flat.to_numpy(zero_copy_only=False).reshape(-1, dim)


class Best:
    """The k best (score, id) of one query: larger scores first, then smaller ids."""

    __slots__ = ("score", "id", "k")

    def __init__(self, k: int, dtype):
        self.k, self.score, self.id = k, np.zeros(0, dtype), np.zeros(0, np.int64)

    def add(self, score: np.ndarray, ids: np.ndarray) -> None:
        score, ids = np.concatenate([self.score, score]), np.concatenate([self.id, ids])
        order = np.lexsort((ids, -score))[: self.k]
        self.score, self.id = score[order], ids[order]


def search_block(vectors: np.ndarray, ids: np.ndarray, queries: np.ndarray, own: np.ndarray, k: int, bounds: np.ndarray | None = None, bucket: int = BUCKET) -> tuple[list[Best], int]:
    """(the k best of ``vectors`` for each query, how many products were verified). Rows with the query's own id are left
    out, and with ``bounds`` so may be scores below them. Integer matrices."""
    dim, verified = vectors.shape[1], 0
    top = max((int(np.abs(m.astype(object)).max()) if m.size else 0) for m in (vectors, queries))
    # Products of doubles are exact below 2 ** 53; beyond that Python's integers are.
    kind = np.float64 if top * top * max(dim, 1) < 2**53 else object
    v, q = vectors.astype(kind), queries.astype(kind)
    length = np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1))
    order = np.lexsort((ids, -length))
    v, ids, length = v[order], ids[order], length[order]
    size = np.sqrt((queries.astype(np.float64) ** 2).sum(axis=1))
    unit_q = queries / np.maximum(size, 1e-300)[:, None]
    best = [Best(k, kind) for _ in queries]
    bound = np.full(len(q), -np.inf) if bounds is None else bounds.astype(np.float64)
    slack = 1e-9
    for start in range(0, len(v), bucket):
        rows = slice(start, start + bucket)
        part, part_ids, part_length = v[rows], ids[rows], length[rows]
        with np.errstate(divide="ignore", invalid="ignore"):
            need = np.where((size > 0) & (part_length[0] > 0), bound / (size * part_length[0]), np.where(bound > 0, np.inf, -np.inf))
        active = np.flatnonzero(need <= 1 + slack)
        if not len(active):
            break
        by_coordinate = active[(need[active] > COORDINATE_FROM) & (dim > FOCUS)]
        by_length = np.setdiff1d(active, by_coordinate, assume_unique=True)
        if len(by_length):
            with np.errstate(divide="ignore", invalid="ignore"):
                least = np.where(bound[by_length] > 0, bound[by_length] / size[by_length], 0) * (1 - slack)
            reach = np.searchsorted(-part_length, -least, side="right")
            most = int(reach.max())
            if most:
                verified += int(reach.sum())
                score = q[by_length] @ part[:most].T
                ok = (np.arange(most)[None, :] < reach[:, None]) & (score >= bound[by_length, None]) & (part_ids[None, :most] != own[by_length, None])
                for i in np.flatnonzero(ok.any(axis=1)):
                    _take(best, bound, by_length[i], score[i][ok[i]], part_ids[:most][ok[i]])
        if len(by_coordinate):
            unit = part.astype(np.float64) / np.maximum(part_length, 1e-300)[:, None]
            for i in by_coordinate:
                t, live = min(1.0, need[i]) - slack, np.ones(len(part), bool)
                for f in np.argsort(-np.abs(unit_q[i]))[:FOCUS]:
                    middle, room = t * unit_q[i, f], np.sqrt(max(0.0, 1 - t * t) * max(0.0, 1 - unit_q[i, f] ** 2)) + slack
                    # A cosine of at least t keeps the coordinate in this range; past the query's own value it is free.
                    low = -1.0 - slack if unit_q[i, f] <= -t else middle - room
                    high = 1.0 + slack if unit_q[i, f] >= t else middle + room
                    live &= (unit[:, f] >= low) & (unit[:, f] <= high)
                live &= part_ids != own[i]
                if live.any():
                    verified += int(live.sum())
                    score = part[live] @ q[i]
                    good = score >= bound[i]
                    if good.any():
                        _take(best, bound, i, score[good], part_ids[live][good])
    return best, verified


def _below(score: np.ndarray) -> np.ndarray:
    """The score, or where a double can't hold it for sure, the next double below it."""
    return np.where(np.abs(score) < 2**53, score, np.nextafter(score, -np.inf))


def _take(best: list[Best], bound: np.ndarray, i: int, score: np.ndarray, ids: np.ndarray) -> None:
    best[i].add(score, ids)
    if len(best[i].score) == best[i].k:
        bound[i] = max(bound[i], _below(np.float64(best[i].score[-1])))


def top_k(
    vectors: DataFrame,
    *,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    query: Column | None = None,
    k: int = 10,
    scale: float = 1024.0,
    block_numbers: int = 1 << 20,
    query_numbers: int = 1 << 20,
    max_blocks: int = 1 << 16,
) -> DataFrame:
    """For each query row, its k best other rows by integer inner product of ``quantised`` vectors: query_id, rank
    (from 1), vec_id, score; ties go to the smaller vec_id. ``query`` picks the query rows (default: ids divisible by
    100); all rows are candidates except those with the query's own id.

    The rows are range-partitioned by length into blocks of about ``block_numbers`` components (less where there are
    few rows, to use all cores; more where there would be over ``max_blocks``), queries into groups of about
    ``query_numbers``, and each pair of a block and a group that has queries for it is one bounded task: the work of a
    stated query set against all rows. A block goes to a group once, and not to groups whose bounds it can't reach. The
    list of blocks, a row of 32 bytes for each and at most about ``max_blocks`` of them, is broadcast.

    Null ids, and vectors that are null or hold null or non-finite components, take no part; vectors of different
    dimensions don't meet. Repeated rows are candidates each, and one query. A vector is one row of its block, however
    long. Scores beyond 64 bits end at their limits and tie there. Fewer than k candidates give fewer rows; an empty
    table none. Other columns are ignored.
    """
    spark = vectors.sparkSession
    picked = F.col(vec_id) % 100 == 0 if query is None else query
    rows = vectors.select(F.col(vec_id).cast("bigint").alias("id"), quantised(F.col(vector), scale).alias("v"), picked.alias("q"))
    rows = rows.where("id is not null and v is not null").select("id", "v", "q", F.size("v").alias("dim"), _length("v").alias("len"))
    rows = table(rows, "vectors")
    n, asking, dim = (x or 0 for x in rows.agg(F.count("*"), F.count_if("q"), F.max("dim")).first())
    blocks = min(max_blocks, max(1, -(-n * dim // block_numbers), min(partitions(spark), n // 1024)))
    dealt = rows.repartitionByRange(blocks, F.desc("len"), "id").withColumn("part", F.spark_partition_id())
    dealt = table(dealt.select("id", "v", "len", "part", "dim"), "dealt")
    groups = max(1, -(-asking * dim // query_numbers))
    asked = rows.where("q").select("id", "v", "dim", "len").dropDuplicates(["id", "v"])
    asked = table(asked.select("*", F.xxhash64("v").alias("qv"), F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int").alias("grp")), "asked")
    found = pa.schema([("query_id", pa.int64()), ("qv", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return found.empty_table()
        dim, own, tag = a.column("dim")[0].as_py(), b.column("id").to_numpy(), b.column("qv").to_numpy()
        bounds = b.column("bound").to_numpy(zero_copy_only=False).astype(np.float64)  # null: NaN
        bounds = np.where(np.isnan(bounds), -np.inf, _below(bounds))
        best, _ = search_block(_matrix(a.column("v"), dim), a.column("id").to_numpy(), _matrix(b.column("v"), dim), own, k, bounds)
        low, high = -(2**63), 2**63 - 1
        out = [(int(own[i]), int(tag[i]), int(x), min(max(int(s), low), high)) for i, one in enumerate(best) for s, x in zip(one.score, one.id)]
        cols = list(zip(*out)) or [()] * 4
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in cols], schema=found)

    def search(pairs: DataFrame) -> DataFrame:
        """Results of queries (rows of ``asked`` with a bound) in the block ``part`` that each row names."""
        keys = ["dim", "part", "grp"]
        live = pairs.select(*(F.col(c).alias(c) for c in keys)).distinct()
        left = dealt.join(live.hint("merge"), ["dim", "part"])
        both = left.groupBy(*keys).cogroup(pairs.groupBy(*keys))
        return both.applyInArrow(run, "query_id bigint, qv bigint, vec_id bigint, score bigint")

    sizes = table(dealt.groupBy("dim", "part").agg(F.max("len").alias("reach")), "blocks")
    longest = sizes.groupBy("dim").agg(F.min("part").alias("part"))
    none = F.lit(None).cast("bigint").alias("bound")
    first = table(search(asked.join(F.broadcast(longest), "dim").select("*", none)), "first")
    bounds = first.groupBy(F.col("query_id").alias("id"), "qv").agg(F.min("score").alias("bound"), F.count("*").alias("n")).where(F.col("n") == k).drop("n")
    later = sizes.join(longest.withColumnRenamed("part", "done"), "dim").where("part > done").drop("done")
    # Lengths are sums of squares in doubles: the bound gives way by more than they can be wrong.
    may_reach = F.expr("bound is null or bound <= 0 or double(bound) * double(bound) <= len * reach * 1.000000001D")
    pairs = asked.join(bounds.hint("merge"), ["id", "qv"], "left").join(F.broadcast(later), "dim").where(may_reach).drop("reach", "len")
    rest = search(table(pairs, "pairs"))
    release(rows, asked, sizes)
    ranked = first.union(rest).withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "qv").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _length(v: str) -> Column:
    """Sum of the squares of an array's components."""
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))

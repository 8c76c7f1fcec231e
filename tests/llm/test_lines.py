"""Line deduplication against plain Python and SQL."""

import collections
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from lamella.llm import lines, queries
from tests.llm.helpers import DOCS, ODD, clashing, documents
from tests.oracle import DATA, connection, same

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(UPPER)


def brute(rows, min_docs, min_chars=1, keep_first=False):
    """{(id, text): kept text} of distinct rows."""
    docs = sorted({(i is not None, i or 0, t or "") for i, t in rows})
    seen = collections.Counter(k for d in docs for k in {key(x) for x in d[2].split("\n")} if len(k) >= min_chars)
    first, out = set(), {}
    for has, i, t in docs:
        kept = []
        for x in t.split("\n"):
            k = key(x)
            if seen.get(k, 0) >= min_docs and not (keep_first and k not in first and not first.add(k)):
                continue
            kept.append(x)
        out[(i if has else None, t)] = "\n".join(kept)
    return out


def kept(df, **how):
    marked = lines.with_bitmaps(df, lines.line_bitmaps(df, **how), to="runs_")
    out = marked.select("doc_id", F.coalesce("text", F.lit("")).alias("t"), F.array_join(lines.kept_lines(F.col("text"), F.col("runs_")), "\n").alias("kept"), lines.dropped_count(F.col("runs_")).alias("gone"))
    return {(r["doc_id"], r["t"]): (r["kept"], r["gone"]) for r in out.collect()}


@pytest.mark.parametrize("keep_first", [False, True])
@pytest.mark.parametrize("min_docs", [1, 2, 3])
def test_random_documents(spark, min_docs, keep_first):
    rng = random.Random(min_docs)
    pool = ["a", " A\t", "b", "", "  ", "É", "é", "long line " * 5, "c\x0b"]
    texts = ["\n".join(rng.choice(pool) for _ in range(rng.randint(1, 6))) for _ in range(60)] + ODD
    want = brute(list(enumerate(texts)), min_docs, keep_first=keep_first)
    got = kept(clashing(documents(spark, texts)), min_docs=min_docs, keep_first=keep_first)
    assert {k: v[0] for k, v in got.items()} == want


def test_null_and_repeated_ids(spark):
    df = documents(spark, ["x", "x", "x\ny", "x", None], [None, None, 5, 5, 5])
    assert kept(df, min_docs=3)[(None, "x")] == ("", 1)  # (null, x), (5, x), (5, x y): three different rows
    assert kept(df, min_docs=4) == {(None, "x"): ("x", 0), (5, "x\ny"): ("x\ny", 0), (5, "x"): ("x", 0), (5, ""): ("", 0)}


def test_short_keys_and_empty_table(spark):
    df = documents(spark, ["ab\nabc"] * 3, [1, 2, 3])
    assert kept(df, min_docs=2, min_chars=3)[(1, "ab\nabc")] == ("ab", 1)
    assert kept(spark.createDataFrame([], DOCS)) == {}


def test_bitmap_is_run_lengths(spark):
    df = documents(spark, ["a\nb\nb2\na\na", "a\nz"], [1, 2])
    got = {len(r["runs"]): list(r["runs"]) for r in lines.line_bitmaps(df, min_docs=2).collect()}
    assert got == {6: [0, 1, 2, 1, 0, 1], 2: [0, 1]}


def test_drop_lines_keeps_columns(spark):
    df = clashing(documents(spark, ["a\nb", "a", None], [1, 2, 3]))
    out = lines.drop_lines(df, min_docs=2)
    assert out.columns == df.columns
    assert {(r["doc_id"], r["text"], r["n_chars"]) for r in out.collect()} == {(1, "b", 1), (2, "", 0), (3, None, 0)}


def test_query_matches_sql(spark):
    same(queries.op3_line_dedup(spark, DATA), connection(), queries.OP3_SQL)
    digest = {r["doc_id"]: r["kept_sha256"] for r in queries.op3_line_dedup(spark, DATA).collect()}
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    want = brute(rows, 10)
    assert digest == {i: hashlib.sha256(t.encode()).hexdigest() for (i, _), t in want.items()}


def test_plan_has_no_python(spark):
    plan = queries.op3_line_dedup(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("keep_first", [False, True])
def test_first_occurrences_stream_over_sorted_ranges(spark, monkeypatch, keep_first):
    plans = {}
    written = lines.table
    monkeypatch.setattr(lines, "table", lambda df, name: (plans.update({name: df._jdf.queryExecution().executedPlan().toString()}), written(df, name))[1])
    lines.line_bitmaps(documents(spark, ["a\nb", "a"]), min_docs=2, keep_first=keep_first)
    steps = [x.strip(" +-:*()0123456789") for x in plans["keys"].splitlines()]
    names = [x.split(" ")[0].split("(")[0] for x in steps]
    at = names.index("Exchange", names.index("Exchange") + 1)  # the one below the hash exchange: by range
    assert "rangepartitioning" in steps[at] and names[at - 1] == "Sort" and "pos" in steps[at - 1]
    assert names[at - 2] == "SortAggregate" and "partial_first(struct(pos" in steps[at - 2]
    assert "HashAggregate" not in names

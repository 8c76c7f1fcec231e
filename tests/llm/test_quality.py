"""Quality rules against brute force, and the cascade's order."""

import collections
import random
import re

import pytest

from lamella.llm import quality, queries
from tests.llm.helpers import ODD, clashing, documents
from tests.oracle import DATA, connection, same

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def check(r, text):
    n, chars, symbols, dup, rep = brute(text)
    assert tuple(r[f] for f in quality.FEATURES) == (n, chars, symbols, dup, rep), text[:80] if text else text
    failed = n < 10 or 100 * rep > 20 * n
    assert r["base_failed"] == failed
    d = quality.Measured(text)
    assert r["kept"] == (not failed and not any(rule.rejects(d) for rule in quality.VERDICT_RULES))


def test_random_texts(spark):
    rng = random.Random(2)
    words = ["a", "b", "the", "é#", "x|y", "\n", "\x0b", "\xa0", "line one\nline one\n", "<>"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 40))) for _ in range(200)] + ODD
    got = {r["doc_id"]: r for r in quality.quality(clashing(documents(spark, texts))).collect()}
    for i, t in enumerate(texts):
        check(got[i], t)


def test_many_different_words():
    rng = random.Random(1)
    w = [f"w{rng.randrange(9000)}" for _ in range(12_000)]
    w[5000:5100] = w[100:200]
    assert quality.Measured(" ".join(w)).n_repeat_words == brute(" ".join(w))[4] >= 200


def test_whole_table(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    for r in queries.op10_quality_rules(spark, DATA).collect():
        check(r, texts[r["doc_id"]])


def test_agrees_with_labels(spark):
    sf = "/root/testdata/sf0.1"
    rows = queries.op10_quality_rules(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("not base_failed").collect()
    clean, junk = [r for r in rows if r["quality"] == 1], [r for r in rows if r["quality"] == 0]
    assert sum(r["kept"] for r in clean) / len(clean) > 0.999
    assert sum(not r["kept"] for r in junk) / len(junk) > 0.9


def test_order_is_rejections_per_cost():
    import time

    dear = quality.Rule("dear", lambda d: time.sleep(0.002) or True)
    cheap = quality.Rule("cheap", lambda d: d.n_words > 1)
    never = quality.Rule("never", lambda d: False)
    assert [r.name for r in quality.cascade_order([never, dear, cheap], ["a b"] * 10)] == ["cheap", "dear", "never"]
    assert [r.name for r in quality.cascade_order([never, dear], [])] == ["never", "dear"]


def test_order_is_measured_on_what_is_left():
    import time

    first = quality.Rule("first", lambda d: d.n_words > 1)
    same_again = quality.Rule("same", lambda d: time.sleep(0.0005) or d.n_words > 1)  # worth much alone, nothing behind the first
    other = quality.Rule("other", lambda d: time.sleep(0.002) or d.n_words == 1)
    assert [r.name for r in quality.cascade_order([same_again, other, first], ["a b"] * 20 + ["a"] * 5)] == ["first", "other", "same"]


def test_sample_is_spread_and_bounded(spark):
    df = documents(spark, [f"text {i}" for i in range(2000)] + ["x" * 500]).repartition(4)
    got = quality.sample_texts(df, "text", "doc_id", 100, 100)
    numbers = sorted(int(t.split()[1]) for t in got)
    assert 50 < len(got) <= 200 and numbers[0] < 200 and numbers[-1] > 1800
    assert got and sorted(got) == sorted(quality.sample_texts(df, "text", "doc_id", 100, 100))


@pytest.mark.parametrize("turned", [False, True])
def test_order_never_changes_the_verdict(spark, turned):
    df = documents(spark, [*ODD, "# " * 20, "good words that go on and on for a while, all of them different"])
    rules = [*quality.BASE_RULES, *quality.VERDICT_RULES]
    kept = {r["doc_id"] for r in df.where(quality.keeps(df["text"], rules[::-1] if turned else rules)).collect()}
    assert kept == {r["doc_id"] for r in quality.quality(df).where("kept").collect()} == {len(ODD) + 1}


def test_filter_and_no_rows(spark):
    df = clashing(documents(spark, ODD))
    assert quality.keep_quality(df).columns == df.columns
    assert quality.quality(df.limit(0)).count() == 0 == quality.keep_quality(df.limit(0)).count()


def test_query_matches_sql(spark):
    same(queries.op10_quality_rules(spark, DATA), connection(), queries.OP10_SQL)

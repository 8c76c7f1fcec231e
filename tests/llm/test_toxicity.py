"""Toxicity: held-out accuracy, inputs, edges."""

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamella.llm import queries, toxicity
from tests.llm.helpers import DOCS, ODD, clashing, documents

SF = "/root/testdata/sf0.1"
LABELS = "doc_id bigint, quality int, toxic int"


@pytest.fixture(scope="module")
def scored(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    return queries.op6_toxicity(spark, SF).join(labels, "doc_id").collect()


def test_held_out_accuracy(scored):
    held = [r for r in scored if r["held_out"]]
    y, s = np.array([r["toxic"] for r in held]), np.array([r["score"] for r in held])
    rank = s.argsort().argsort()
    auc = (rank[y == 1].sum() - y.sum() * (y.sum() - 1) / 2) / (y.sum() * (len(y) - y.sum()))
    assert auc > 0.95
    p = s >= 0.5
    assert (p & (y == 1)).sum() / p.sum() > 0.9  # few clean documents are hit
    assert (p & (y == 1)).sum() / y.sum() > 0.8


def test_split_and_prediction(scored):
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in scored)
    assert all(r["predicted"] == int(r["score"] >= 0.5) and 0 <= r["score"] <= 1 for r in scored)


def toy(spark):
    rng = random.Random(4)
    say = lambda bad: " ".join(rng.choice("the a of to and in is it".split()) if not bad or rng.random() < 0.9 else rng.choice(["moron", "scum"]) for _ in range(80))
    toxic = [i % 3 == 0 for i in range(300)]
    return documents(spark, [say(t) for t in toxic]), spark.createDataFrame([(i, 1, int(t)) for i, t in enumerate(toxic)], LABELS)


def test_scores_depend_on_text_alone(spark):
    docs, labels = toy(spark)
    model = toxicity.train(docs, labels)
    other = clashing(docs.withColumns({"doc_id": F.col("doc_id") * 10 + 1, "lang": F.lit("xx"), "source": F.lit(None).cast("string")}))
    a = sorted(r[0] for r in docs.select(toxicity.score(F.col("text"), model, docs)).collect())
    b = sorted(r[0] for r in other.select(toxicity.score(F.col("text"), model, other)).collect())
    assert a == b
    turned = labels.withColumn("toxic", F.when(toxicity.remainder(F.col("doc_id")) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = toxicity.train(docs, turned)
    assert (again.slope, again.word_ratio.tolist()) == (model.slope, model.word_ratio.tolist())  # held-out labels aren't read


def test_odd_rows(spark):
    docs, labels = toy(spark)
    odd = clashing(documents(spark, [*ODD, "you moron"], [None, 1, 1, *range(2, 10)]))
    model_rows = toxicity.toxicity(docs.unionByName(odd, allowMissingColumns=True), labels.union(spark.createDataFrame([(None, 1, 1), (1, None, None), (2, 0, 1), (2, 0, 0)], LABELS)))
    assert model_rows.count() == 311 and model_rows.where("score is null").count() == 0
    model = toxicity.train(docs, labels)
    index = {w: i for i, w in enumerate(model.vocabulary) if i > 1}
    empty, none, bad = model.scores(["", None, "you moron"], index)
    assert empty == none < 0.5 < bad


def test_no_labels_and_no_rows(spark):
    docs, labels = toy(spark)
    assert {r["score"] for r in toxicity.toxicity(docs, labels.limit(0)).collect()} == {0.5}
    assert toxicity.toxicity(spark.createDataFrame([], DOCS), labels).count() == 0


def test_filter_keeps_columns(spark):
    docs, labels = toy(spark)
    docs = clashing(docs)
    out = toxicity.drop_toxic(docs, labels)
    assert out.columns == docs.columns and 190 <= out.count() <= 210


def sample(seed=1, docs=20):
    rng = random.Random(seed)
    return [np.array([1, *(min(9, 2 + int(rng.expovariate(0.4))) for _ in range(40))]) for _ in range(docs)]


def contexts(docs):
    """Distinct words before each bigram, and before each word, by sets."""
    three = {tuple(d[i : i + 3]) for d in docs for i in range(len(d) - 2)}
    two = {tuple(d[i : i + 2]) for d in docs for i in range(len(d) - 1)}
    pairs = {p: sum(t[1:] == p for t in three) for p in two}
    return pairs, [sum(b == w for _, b in two) for w in range(10)]


def test_contexts_are_counted_once():
    docs = [d.tolist() for d in sample()]
    pairs, n, words = toxicity._contexts([np.array(d) for d in docs], 10)
    want, before = contexts(docs)
    # what opens a text follows nothing: its bigrams are counted by the bigrams after them alone
    assert {(p // 10, p % 10): c for p, c in zip(pairs.tolist(), n.tolist())} == want and words.tolist() == before


def test_kneser_ney_probabilities_sum_to_one():
    pairs, n, words = toxicity._contexts(sample(), 10)
    shared = np.full(10, 0.1)
    every = np.arange(100)  # all bigrams
    p_word, back, p_pair = toxicity._class_model(pairs, n, words, shared, every, 3, 4)
    assert p_word.sum() == pytest.approx(1)
    for v in range(10):
        assert p_pair[10 * v : 10 * v + 10].sum() == pytest.approx(1, abs=1e-4), v


def test_score_against_plain_probabilities():
    toxic, ordinary = sample(2), sample(3, 30)
    vocabulary = ["<unknown>", "<start>", *"abcdefgh"]
    m = toxicity._kneser_ney(toxic, ordinary, vocabulary, 3, 4)
    lists = [[d.tolist() for d in x] for x in (toxic, ordinary)]
    pooled = {tuple(d[i : i + 2]) for x in lists for d in x for i in range(len(d) - 1)}
    shared = [min(3, sum(b == w for _, b in pooled)) + 0.5 for w in range(10)]
    shared = [x / sum(shared) for x in shared]

    def discount(counts):
        n1, n2, n3, n4 = (sum(c == i for c in counts) for i in (1, 2, 3, 4))
        return min(max(3 - 4 * n1 / (n1 + 2 * n2) * n4 / n3, 0), 3) if n1 and n3 else 1.5

    def probability(docs):
        pairs, words = contexts(docs)
        dw, dp = discount(words), discount(list(pairs.values()))
        lost = [c if c < 3 else dw for c in words]
        p = [(c - x) / sum(words) + max(sum(lost) / sum(words), 1e-6) * s for c, x, s in zip(words, lost, shared)]
        p = [x / sum(p) for x in p]

        def of(v, w):
            after = {b: c for (a, b), c in pairs.items() if a == v}
            total = sum(after.values())
            if not total:
                return p[w]
            gone = sum(c if c < 4 else dp for c in after.values())
            c = after.get(w, 0)
            return (0 if c < 4 else c - dp) / total + max(gone, 1e-6) / total * p[w]

        return of

    bad, good = map(probability, lists)
    index = {w: i for i, w in enumerate(vocabulary) if i > 1}
    rng = random.Random(7)
    for _ in range(60):
        text = " ".join(rng.choice("abcdefghxyz") for _ in range(rng.randint(1, 12)))
        ids = [1, *(index.get(w, 0) for w in text.split())]
        ratios = [math.log(bad(a, b) / good(a, b)) for a, b in zip(ids, ids[1:])]
        size = min(m.window, len(ratios))
        want = max(sum(ratios[i : i + size]) / size for i in range(len(ratios) - size + 1))
        assert m.features([text], index)[0] == pytest.approx(want, rel=1e-6, abs=1e-9)
        assert m.scores([text], index)[0] == pytest.approx(1 / (1 + math.exp(-want)), rel=1e-6)


def test_sample_is_bounded_in_characters(spark, monkeypatch):
    docs, labels = toy(spark)
    got = []
    monkeypatch.setattr(toxicity, "fit", lambda texts, toxic, **how: got.append(texts) or toxicity.Model(["", ""], *[np.zeros(2)] * 4))
    toxicity.train(docs, labels, sample_chars=5000)
    assert 4000 < sum(map(len, got[0])) <= 5000

"""Near-duplicates against brute force on full sets."""

import random

import numpy as np
import pytest

from lamella.llm import minhash, queries
from tests.llm.helpers import DOCS, ODD, clashing, documents
from tests.oracle import DATA, connection, same

UPPER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def shingles(text, words):
    w = (text or "").encode().translate(UPPER).split()
    return {tuple(w)} if 0 < len(w) < words else {tuple(w[i : i + words]) for i in range(len(w) - words + 1)}


def brute(docs, words, percent):
    """{id: (set size, component)}."""
    sets = {i: shingles(t, words) for i, t in docs.items()}
    up = {i: i for i in docs}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(docs)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            a, b = sets[i], sets[j]
            if a and b and 100 * min(len(a), len(b)) >= percent * max(len(a), len(b)) and 100 * len(a & b) >= percent * len(a | b):
                a, b = sorted((top(i), top(j)))
                up[b] = a
    return {i: (len(sets[i]), top(i)) for i in ids}


def corpus(seed, groups=12, size=8):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    shared = " ".join(rng.choice(vocabulary) for _ in range(40))
    out = []
    for _ in range(groups):
        text = [rng.choice(vocabulary) for _ in range(rng.choice([4, 30, 120]))]
        for _ in range(size):
            copy = list(text)
            for _ in range(rng.randint(0, max(1, len(copy) // 25))):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            out.append(" ".join(copy) + (" " + shared if rng.random() < 0.3 else ""))
    rng.shuffle(out)
    return out


def found(df, **how):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(df, **how).collect()}


@pytest.mark.parametrize(("words", "percent", "seed"), [(3, 85, 1), (5, 80, 2), (3, 85, 3)])
def test_random_corpus(spark, words, percent, seed):
    texts = corpus(seed) + ODD
    ids = random.Random(seed).sample(range(-1000, 1000), len(texts))
    got = found(clashing(documents(spark, texts, ids)), words=words, percent=percent)
    assert got == brute(dict(zip(ids, texts)), words, percent)


def test_threshold_is_exact(spark):
    # 17 of 20 shingles in the union are shared: 85 %; one fewer isn't enough
    base = [f"a{i}" for i in range(19)]
    texts = [" ".join(base), " ".join([*base, "x1", "x2", "x3"]), " ".join([*base, "y1", "y2", "y3", "y4"])]
    got = found(documents(spark, texts), words=3, percent=85)
    assert got[1][1] == 0 and got[2][1] == brute(dict(enumerate(texts)), 3, 85)[2][1]


def test_whole_table(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in queries.op9_minhash_dedup(spark, DATA).collect()}
    assert got == brute(docs, 3, 85)


def test_null_and_repeated_ids(spark):
    df = documents(spark, ["a b c d", "a b c d", "a b c d", "zz yy", None], [None, 5, 5, 7, None])
    got = sorted(map(tuple, minhash.near_duplicates(df).collect()), key=repr)
    assert got == sorted([(None, 1, None, True), (5, 1, 5, True), (5, 1, 5, True), (7, 1, 7, True), (None, 0, None, True)], key=repr)
    assert found(spark.createDataFrame([], DOCS)) == {}


def test_copies_of_many_documents(spark):
    texts = ["The same text, over and over again in here"] * 500 + ["the SAME text, over and over again in here"] * 20
    assert set(found(documents(spark, texts)).values()) == {(5, 0)}


def test_near_copies_below_a_passage_that_many_share(spark):
    # five texts are near copies (200 of 220 shingles); to all others, in whose large buckets they lie, they aren't
    passage = " ".join(f"p{i}" for i in range(204))
    own = lambda i, n: " ".join([passage, *(f"d{i}x{j}" for j in range(n))])
    few = {301, 602, 903, 1204, 1498}
    got = found(documents(spark, [own(i, 10 if i in few else 60) for i in range(1500)]), words=5, percent=80)
    assert got == {i: (210, 301) if i in few else (260, i) for i in range(1500)}


def test_what_few_hubs_miss_is_found(spark):
    texts = corpus(6, groups=6, size=30)
    assert found(documents(spark, texts), words=3, percent=85, hubs=1) == brute(dict(enumerate(texts)), 3, 85)


def test_filter_keeps_one_of_each_group(spark):
    texts = corpus(4)
    df = clashing(documents(spark, texts))
    out = minhash.drop_near_duplicates(df)
    want = {i for i, (_, c) in brute(dict(enumerate(texts)), 5, 80).items() if i == c}
    assert out.columns == df.columns and {r["doc_id"] for r in out.collect()} == want


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(300, 200), (300, 250), (7, 7)]
    got = {r["k"]: r["component"] for r in minhash.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[100 + i] == 100 for i in range(30))
    assert got[300] == got[250] == got[200] == 200
    assert minhash.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_densified_signatures_estimate_similarity():
    signer, rng = minhash.Signer(36, 5), np.random.default_rng(5)
    error = []
    for n in (10, 40, 400):
        for _ in range(40):
            a = rng.integers(0, 2**64, n, dtype=np.uint64)
            b = np.concatenate([a[: n * 8 // 10], rng.integers(0, 2**64, n - n * 8 // 10, dtype=np.uint64)])
            x, y = (signer.sign(np.unique(s)) for s in (a, b))
            error.append((x == y).mean() - len(np.intersect1d(a, b)) / len(np.union1d(a, b)))
    assert abs(np.mean(error)) < 0.03


def test_query_matches_sql(spark):
    same(queries.op9_minhash_dedup(spark, DATA), connection(), queries.OP9_SQL)


@pytest.mark.parametrize("few", [minhash.FEW_FREQUENT, 0])
def test_templated_pairs_in_one_bucket_all_meet(spark, monkeypatch, few, pairs=300):
    monkeypatch.setattr(minhash, "FEW_FREQUENT", few)
    # every text shares a long passage; own parts of two texts agree just enough, those of others fall just short
    passage = [f"p{i}" for i in range(300)]
    texts = {}
    for i in range(pairs):
        both = [f"b{i}x{j}" for j in range(22)]
        for half in (0, 1):
            texts[2 * i + half] = " ".join([*passage, *both, *(f"o{i}y{half}z{j}" for j in range(8))])
    got = found(documents(spark, list(texts.values())), words=3, percent=85)
    sets = {i: shingles(t, 3) for i, t in list(texts.items())[:4]}
    alike = lambda a, b: 100 * len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    assert alike(0, 1) >= 85 > alike(0, 2)
    assert {i: c for i, (_, c) in got.items()} == {i: i - i % 2 for i in texts}


def test_scratch_tables_go(spark):
    import os

    from lamella.llm.common import shared_dir

    folder = shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    out = minhash.near_duplicates(documents(spark, corpus(9)))
    left = {n.split("-")[1] for n in set(os.listdir(folder)) - before}
    assert left <= {"signed", "labels"} and out.count() == 96

"""The pipeline: each stage against brute force on its own input, and the whole run."""

import collections

import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from lamella.llm import quality, toxicity
from tests.llm.helpers import DOCS
from tests.llm.test_lines import brute as brute_lines
from tests.llm.test_minhash import brute as brute_near
from tests.llm.test_packing import check
from tests.oracle import DATA

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """[(input rows, output rows)] of each stage; every one is written and read again."""
    docs, out = spark.read.parquet(f"{DATA}/documents.parquet"), []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(i))
        stage(spark, docs, DATA).write.parquet(path)
        after = spark.read.parquet(path)
        out.append((docs, after))
        docs = after
    return out


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality rules", "line dedup", "near dedup", "packing"]
    assert all(after.columns == COLUMNS for _, after in stages[:-1])


def test_toxicity_stage(spark, stages):
    before, after = map(texts, stages[0])
    model = toxicity.train(stages[0][0], spark.read.parquet(f"{DATA}/labels.parquet"))
    index = {w: i for i, w in enumerate(model.vocabulary) if i > toxicity.START}
    ids = sorted(before)
    assert set(after) == {i for i, s in zip(ids, model.scores([before[i] for i in ids], index)) if s < 0.5}
    assert all(after[i] == before[i] for i in after)


def test_quality_stage(stages):
    before, after = map(texts, stages[1])
    rules = (*quality.BASE_RULES, *quality.VERDICT_RULES)
    assert after == {i: t for i, t in before.items() if not any(r.rejects(quality.Measured(t)) for r in rules)}
    assert 0 < len(after) < len(before)


def test_line_stage(stages):
    before, after = map(texts, stages[2])
    want = brute_lines(list(before.items()), 10, keep_first=True)
    want = {i: t for (i, old), t in want.items() if t.strip(" \t\n\x0b\x0c\r") or not old.strip(" \t\n\x0b\x0c\r")}
    assert after == want and after != before
    assert all(r["n_chars"] == len(r["text"]) for r in stages[2][1].collect())


def test_near_stage(stages):
    before, after = map(texts, stages[3])
    want = {i for i, (_, c) in brute_near(before, 5, 80).items() if i == c}
    assert set(after) == want and len(want) < len(before)


def test_packing_stage(stages):
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    assert check(stages[4][1].collect(), texts(stages[4][0]), library, 2048) == 0


def test_run_is_the_stages(spark, stages):
    tokens = lambda df: collections.Counter((r["doc_id"], r["doc_tokens"]) for r in df.select("doc_id", "doc_tokens").distinct().collect())
    assert tokens(corpus_pipeline.run(spark, DATA)) == tokens(stages[4][1])


def test_odd_documents(spark):
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "some good words that are all different from one another here", "en", "s", 60)]
    df = spark.createDataFrame(rows, DOCS)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, df, DATA).count() >= 0
        assert stage(spark, df.limit(0), DATA).count() == 0

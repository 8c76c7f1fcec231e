"""Small tables for the operators of the llm subpackage."""

from __future__ import annotations

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = "word " * 30_000 + "end"


def documents(spark, texts, ids=None):
    """A documents table; ids count from 0 unless given."""
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "src", len(t or "")) for i, t in zip(ids, texts)], DOCS)


#: Nulls, empty and very long texts, ties, repeats.
ODD = [None, "", " \t\n", LONG, "a b c", "a b c", "\n\n", "ünï cödé 😀 text", "\x00 \x01 control", "<|im_end|> <\\|x"]


def clashing(df):
    """With extra columns whose names operators use inside or for results."""
    from pyspark.sql import functions as F

    names = ("k", "t", "n", "b", "a", "c", "d", "h", "da", "db", "ka", "kb", "pos", "runs", "gone", "kept", "score", "n_words", "labels", "component", "rep", "first", "ids", "_doc", "_m", "rank", "v", "q", "part", "grp", "parts", "segments")
    return df.withColumns({n: F.lit(7) for n in names if n not in df.columns})


def collected(df, key=None):
    rows = [tuple(r) for r in df.collect()]
    return sorted(rows, key=repr) if key is None else {r[key]: r for r in df.collect()}

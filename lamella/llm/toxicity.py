"""Toxicity from two class-conditional Kneser-Ney word models.

Each class has bigrams with modified Kneser-Ney discounts, estimated from how many counts are one, two, three and four;
they back off to its own discounted unigrams, and those to one continuation distribution that both classes share (in how
many contexts of the pooled sample a word occurs), so a rare expression is judged by what either class has seen. Words
in fewer than ``least_word`` contexts and bigrams in fewer than ``least_pair`` leave all their mass to the back-off: in a
sample of this size what such bigrams say is noise, which the window below would pick.

A text's feature is the difference of the two log-likelihoods per word, taken over the window of a few words where it is
largest: an insult in a long text isn't thinned out. A logistic curve fitted on held-back parts turns it into a score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamella.llm.common import SLICE, slices

WORD = re.compile(r"[^\W_]+")
#: The first id stands for unknown words, the second for the start of a text.
UNKNOWN, START = 0, 1


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


@dataclass
class Model:
    """Log-ratio tables. ``pairs`` (sorted codes previous * size + word) have ratios of their own; that of any other
    bigram is the sum of its context's back-off ratio and its word's ratio."""

    vocabulary: list[str]
    pairs: np.ndarray  # sorted bigram codes
    pair_ratio: np.ndarray  # log p_toxic - log p_ordinary of each
    backoff: np.ndarray  # by context: log of the back-off weight, toxic minus ordinary
    word_ratio: np.ndarray  # by word: log p_toxic - log p_ordinary without context
    window: int = 4
    slope: float = 1.0
    offset: float = 0.0

    def ids(self, texts: Sequence[str | None], index: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each begun by START; where each text begins)."""
        flat, begins = [], []
        get = index.get
        for t in texts:
            begins.append(len(flat))
            flat.append(START)
            flat.extend([get(w, UNKNOWN) for w in words_of(t)])
        return np.array(flat, dtype=np.int64), np.array(begins, dtype=np.int64)

    def features(self, texts: Sequence[str | None], index: dict[str, int]) -> np.ndarray:
        """The largest log-likelihood difference per word of any window of ``window`` words (of the whole text, if it
        is shorter); 0 for a text without words."""
        if len(texts) > SLICE:  # the arrays below are as long as all words together
            return np.concatenate([self.features(texts[i : i + SLICE], index) for i in range(0, len(texts), SLICE)])
        if not len(texts):
            return np.zeros(0)
        flat, begins = self.ids(texts, index)
        ratio = np.zeros(len(flat))
        code = flat[:-1] * len(self.vocabulary) + flat[1:]
        at = np.minimum(np.searchsorted(self.pairs, code), max(0, len(self.pairs) - 1))
        known = self.pairs[at] == code if len(self.pairs) else np.zeros(len(code), bool)
        ratio[1:] = self.backoff[flat[:-1]] + self.word_ratio[flat[1:]]
        ratio[1:][known] = self.pair_ratio[at[known]]
        ratio[begins] = 0
        ends = np.append(begins[1:], len(flat)) - 1  # of the last word; a text's words are begins + 1 .. ends
        total = np.cumsum(ratio)
        # mean of the window that ends at each word and starts behind its text's begin
        text = np.repeat(np.arange(len(begins)), ends - begins + 1)
        low = np.maximum(np.arange(len(flat)) - self.window, begins[text])
        short = np.maximum(np.minimum(self.window, (ends - begins)[text]), 1)
        mean = np.where(np.arange(len(flat)) - begins[text] >= short, (total - total[low]) / short, -np.inf)
        best = np.maximum.reduceat(mean, begins)
        return np.where(ends > begins, best, 0.0)

    def scores(self, texts: Sequence[str | None], index: dict[str, int]) -> np.ndarray:
        z = np.clip(self.slope * self.features(texts, index) + self.offset, -700, 700)
        return 1 / (1 + np.exp(-z))


def _contexts(docs: list[np.ndarray], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bigram codes, distinct words before each, distinct words before each word) of documents given as ids with
    START in front. Kneser-Ney counts contexts, so a passage copied a hundred times counts as one."""
    none = np.zeros(0, np.int64)
    two = np.concatenate([d[:-1] * size + d[1:] for d in docs] or [none])
    first = np.concatenate([np.arange(len(d) - 1) == 0 for d in docs] or [none.astype(bool)])
    pairs, at = np.unique(two, return_inverse=True)
    del two
    # a trigram is a bigram that follows another one of its document
    three = at[:-1] * len(pairs)
    three += at[1:]
    three = three[~first[1:]]
    del at
    three.sort()
    three = three[np.concatenate([[True], three[1:] != three[:-1]])] if len(three) else three
    before_pair = np.bincount(three % max(1, len(pairs)), minlength=len(pairs))
    before_word = np.bincount(pairs % size, minlength=size)
    return pairs, before_pair, before_word


def _discount(counts: np.ndarray) -> float:
    """The discount of counts from three on, as modified Kneser-Ney smoothing estimates it: 3 - 4 Y n4 / n3, Y being
    n1 / (n1 + 2 n2), from how many counts are one, two, three and four. Between 0 and 3; 1.5 without such counts."""
    one, two, three, four = (int((counts == i).sum()) for i in (1, 2, 3, 4))
    if not (one and three):
        return 1.5
    return min(max(3 - 4 * one / (one + 2 * two) * four / three, 0.0), 3.0)


def _lost(counts: np.ndarray, least: int) -> np.ndarray:
    """What counts give up to the back-off: a discount estimated from them, or all where they are below ``least``, which
    is at least 3."""
    return np.where(counts < least, counts, _discount(counts))


def _kneser_ney(toxic: list[np.ndarray], ordinary: list[np.ndarray], vocabulary: list[str], least_word: int, least_pair: int) -> Model:
    size = len(vocabulary)
    tables = [_contexts(x, size) for x in (toxic, ordinary)]
    pooled = np.unique(np.concatenate([t[0] for t in tables]))
    contexts = np.bincount(pooled % size, minlength=size).astype(float)  # shared by both classes
    shared = np.minimum(contexts, least_word) + 0.5  # counts up to the cutoff: it smooths rare words, not common ones
    shared /= shared.sum()
    # Only bigrams that some class keeps need an entry; any other is back-off times word.
    pooled = np.unique(np.concatenate([pairs[n >= least_pair] for pairs, n, _ in tables]))
    word, pair, weight = [], [], []
    for pairs, n, words in tables:
        p_word, back, p_pair = _class_model(pairs, n, words, shared, pooled, least_word, least_pair)
        word.append(np.log(p_word))
        weight.append(np.log(back))
        pair.append(np.log(p_pair))
    return Model(vocabulary, pooled, pair[0] - pair[1], weight[0] - weight[1], word[0] - word[1])


def _class_model(pairs: np.ndarray, n: np.ndarray, words: np.ndarray, shared: np.ndarray, pooled: np.ndarray, least_word: int, least_pair: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One class's probabilities: (of each word, the back-off weight of each context, of each pooled bigram). ``n`` counts the contexts of ``pairs``, ``words`` those of each word. Words and bigrams in
    too few contexts, and the discount of the others, leave their mass to the back-off."""
    size, total = len(words), max(1, words.sum())
    lost = _lost(words, least_word)
    p_word = (words - lost) / total + max(lost.sum() / total, 1e-6) * shared
    p_word /= p_word.sum()
    gone = _lost(n, least_pair)
    before = np.bincount(pairs // size, weights=n, minlength=size)
    given = np.bincount(pairs // size, weights=gone, minlength=size)
    back = np.where(before > 0, np.maximum(given, 1e-6) / np.maximum(before, 1), 1.0)
    left, context = np.zeros(len(pooled)), pooled // size
    if len(pairs):
        at = np.minimum(np.searchsorted(pairs, pooled), len(pairs) - 1)
        seen = pairs[at] == pooled
        left[seen] = (n - gone)[at[seen]]
    p_pair = left / np.maximum(before[context], 1) + back[context] * p_word[pooled % size]
    return p_word, back, p_pair


def fit(texts: Sequence[str | None], toxic: Sequence[bool], *, least_word: int = 4, least_pair: int = 12, min_count: int = 2, folds: int = 2) -> Model:
    """A model from labelled texts. Words seen fewer than ``min_count`` times are the unknown word. The curve is
    fitted on features that each of ``folds`` parts of the texts gets from a model of the other parts."""
    index: dict[str, int] = {}
    docs = [np.array([index.setdefault(w, len(index) + 2) for w in words_of(t)], dtype=np.int64) for t in texts]
    seen = np.bincount(np.concatenate(docs), minlength=len(index) + 2) if docs else np.zeros(2, np.int64)
    keep = np.flatnonzero(seen >= min_count)
    new = np.zeros(len(index) + 2, dtype=np.int64)
    new[keep] = np.arange(len(keep)) + 2
    names = ["", "", *index]
    vocabulary = ["<unknown>", "<start>", *(names[i] for i in keep)]
    docs = [np.concatenate([[START], new[d]]) for d in docs]
    label = np.array(toxic, dtype=bool)
    del index, names, seen, keep, new  # as large as the sample's vocabulary, most of which is left out

    def model(chosen: np.ndarray) -> Model:
        return _kneser_ney([d for d, y, c in zip(docs, label, chosen) if c and y], [d for d, y, c in zip(docs, label, chosen) if c and not y], vocabulary, least_word, least_pair)

    own = {w: i for i, w in enumerate(vocabulary) if i > START}
    x, fold = np.zeros(len(docs)), np.arange(len(docs)) % folds
    for part in range(folds):
        held = fold == part
        x[held] = model(~held).features([t for t, h in zip(texts, held) if h], own)
    out = model(np.ones(len(docs), dtype=bool))
    out.slope, out.offset = _logistic(x, label)
    return out


def _logistic(x: np.ndarray, label: np.ndarray, steps: int = 60) -> tuple[float, float]:
    """Slope and offset by Newton's method with a small ridge; a slope is never negative."""
    if not len(x) or label.all() or not label.any():
        return 1.0, 0.0
    scale = max(float(x.std()), 1e-9)
    a = np.column_stack([x / scale, np.ones(len(x))])
    w = np.zeros(2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + 1e-3 * np.eye(2), a.T @ (label - p) - 1e-3 * w)
        w += step
        if abs(step).max() < 1e-9:
            break
    return max(0.0, float(w[0] / scale)), float(w[1])


def remainder(doc_id: Column) -> Column:
    """crc32(id as text) mod 5; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


def train(docs: DataFrame, labels: DataFrame, *, text: str = "text", doc_id: str = "doc_id", label: str = "toxic", toxic_rows: int = 1000, ordinary_rows: int = 4000, sample_chars: int = 20_000_000, **how) -> Model:
    """Fit on labelled rows whose remainder isn't 0: of each class the ids that come first by hash, at most
    ``toxic_rows`` and ``ordinary_rows`` of them, and of these, in turn, whole texts as long as they fit into
    ``sample_chars`` characters: that bounds what comes to the driver. More ordinary rows than toxic ones tell which rare
    words are only rare. A null label doesn't count; an id labelled both ways is toxic."""
    named = labels.select(F.col(doc_id).alias("k"), F.col(label).alias("y")).where("k is not null and y is not null")
    known = named.where(remainder(F.col("k")) != 0).groupBy("k").agg(F.max("y").alias("y"))
    order = [F.xxhash64("k"), F.col("k")]
    picked = known.where("y = 1").orderBy(*order).limit(toxic_rows).union(known.where("y = 0").orderBy(*order).limit(ordinary_rows))
    # At most toxic_rows + ordinary_rows rows of a few numbers: small enough to broadcast or collect whatever the input.
    rows = docs.select(F.col(doc_id).alias("k"), F.col(text).alias("t")).join(F.broadcast(picked), "k")
    sizes = rows.groupBy("k").agg(F.max("y").alias("y"), F.max(F.coalesce(F.char_length("t"), F.lit(0))).alias("n"), F.xxhash64("k").alias("h")).collect()
    fits, room = [], sample_chars
    for r in sorted(sizes, key=lambda r: (r["h"], r["k"])):
        if r["n"] <= room:
            fits.append((r["k"], r["y"]))
            room -= r["n"]
    chosen = docs.sparkSession.createDataFrame(fits, picked.schema)
    texts = docs.select(F.col(doc_id).alias("k"), F.col(text).alias("t")).join(F.broadcast(chosen), "k")
    sample = texts.groupBy("k").agg(F.max("t").alias("t"), F.max("y").alias("y")).collect()
    sample.sort(key=lambda r: r["k"])
    model = fit([r["t"] for r in sample], [r["y"] == 1 for r in sample], **how)
    # The sample holds the classes in other shares than all labelled rows do; the curve is moved to the real shares.
    have, share = {y: sum(r["y"] == y for r in sample) for y in (0, 1)}, {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    if all(have.values()):
        model.offset += float(np.log(share[1] / share[0]) - np.log(have[1] / have[0]))
    return model


def score(text: Column, model: Model, df: DataFrame) -> Column:
    """The score column: 0 to 1, of whole texts; a text without words has the curve's value at 0."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    cache: dict = {}

    @F.arrow_udf("double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shared.value
        if "index" not in cache:
            cache["index"] = {w: i for i, w in enumerate(m.vocabulary) if i > START}
        for a in batches:
            parts = [m.scores(part, cache["index"]) for part in slices(a)]
            yield pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())

    return run(text)


def toxicity(docs: DataFrame, labels: DataFrame, *, text: str = "text", doc_id: str = "doc_id", **how) -> DataFrame:
    """Per row: the id, held_out (its remainder is 0), score, predicted (1 from 0.5 on). Null and empty texts get
    the score of no evidence; a very long one is scored whole, in memory in proportion to its words. Ids may be null or repeat: each row has its result, equal texts equal scores. Empty
    tables give an empty result; without labels every score is 0.5. Other columns are ignored."""
    model = train(docs, labels, text=text, doc_id=doc_id, **how)
    out = docs.select(F.col(doc_id), (remainder(F.col(doc_id)) == 0).alias("held_out"), score(F.col(text), model, docs).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, *, text: str = "text", doc_id: str = "doc_id", **how) -> DataFrame:
    """The rows of ``docs`` that score below 0.5, with all columns as they are."""
    model = train(docs, labels, text=text, doc_id=doc_id, **how)
    return docs.where(score(F.col(text), model, docs) < 0.5)

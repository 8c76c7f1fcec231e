"""Quality rules as a short-circuit cascade.

Each rule looks at one document and may reject it. On a bounded sample, spread by hash, the cascade measures what every
rule costs and how often it rejects what the rules before it let pass, then runs the rules by rejections per cost; a
document leaves at its first rejection. The order changes the time, never the verdict, since a document is kept only if
no rule rejects it.
"""

from __future__ import annotations

import copy
import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamella.llm.common import ASCII_SPACE, slices

SYMBOLS = "#*$%&|<>"


class Measured:
    """One document's features, each worked out when first asked for. A null text has no words and no lines."""

    def __init__(self, text: str | None):
        self.text = text or ""
        self.data = self.text.encode("utf-8", "replace")

    @cached_property
    def words(self) -> list[bytes]:
        return self.data.split()  # bytes split at exactly [\x20\x09-\x0D]

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(map(self.text.count, ASCII_SPACE))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.text.count, SYMBOLS))

    @cached_property
    def full_lines(self) -> list[bytes]:
        return [x for x in self.data.split(b"\n") if x.strip()]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.full_lines) - len(set(self.full_lines))

    @cached_property
    def ids(self) -> np.ndarray:
        seen: dict[bytes, int] = {}
        return np.array([seen.setdefault(w, len(seen)) for w in self.words], dtype=np.int64)

    @cached_property
    def n_repeat_words(self) -> int:
        """Words inside 5-word windows that occur twice or more, the first occurrence included."""
        n = self.n_words
        if n < 6:
            return 0
        ids, size = self.ids, int(self.ids.max()) + 1
        if size < 6_000:  # size ** 5 fits in 63 bits
            code = (((ids[:-4] * size + ids[1:-3]) * size + ids[2:-2]) * size + ids[3:-1]) * size + ids[4:]
        else:
            two = np.unique(ids[:-1] * size + ids[1:], return_inverse=True)[1]
            four = np.unique(two[:-2] * n + two[2:], return_inverse=True)[1]
            code = four[:-1] * size + ids[4:]
        ordered = np.sort(code)
        same = ordered[1:] == ordered[:-1]
        if not same.any():
            return 0
        starts = np.flatnonzero(np.isin(code, ordered[1:][same]))
        edge = np.zeros(n + 1, dtype=np.int64)
        edge[starts] += 1
        edge[starts + 5] -= 1
        return int(np.count_nonzero(np.cumsum(edge[:-1])))

    @cached_property
    def n_echoes(self) -> int:
        """Words equal to the word before them."""
        return int(np.count_nonzero(self.ids[1:] == self.ids[:-1]))


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Measured], bool]


#: The two fixed rules of the digest, and the method's own.
BASE_RULES = (
    Rule("few_words", lambda d: d.n_words < 10),
    Rule("repeated_windows", lambda d: 100 * d.n_repeat_words > 20 * d.n_words),
)
VERDICT_RULES = (
    Rule("symbols", lambda d: 10 * d.n_symbols > d.n_words),
    Rule("repeated_lines", lambda d: 2 * d.n_dup_lines > len(d.full_lines)),
    Rule("word_length", lambda d: not 2 * d.n_words <= d.word_chars <= 15 * d.n_words),
    Rule("echoed_words", lambda d: 5 * d.n_echoes > d.n_words),
)


def cascade_order(rules: Sequence[Rule], texts: Sequence[str | None], repeats: int = 3) -> list[Rule]:
    """``rules`` by rejections per cost over sample ``texts``, best first. Each place is filled on what the rules before
    it leave: on the texts that they let pass, and with the features that they have already worked out. A rule's cost is
    the least of ``repeats`` timings. Rules that reject nothing more come last, the cheapest first. Without texts the
    given order stays."""
    left, order, docs, found = list(rules), [], [Measured(t) for t in texts], {}
    while left and texts:
        if docs:  # where every text is rejected, the last figures stand
            found = {r.name: _tried(r, docs, repeats) for r in left}
        best = max(left, key=lambda r: (found[r.name][0] / found[r.name][1], -found[r.name][1]))
        left.remove(best)
        order.append(best)
        docs = [d for d in docs if not best.rejects(d)]
    return [*order, *left]


def _tried(rule: Rule, docs: Sequence[Measured], repeats: int) -> tuple[int, float]:
    """(rejections, seconds) of a rule on copies of ``docs``, which keep the features worked out so far."""
    took = []
    for _ in range(repeats):
        fresh = [copy.copy(d) for d in docs]
        began = time.perf_counter()
        rejected = sum(map(rule.rejects, fresh))
        took.append(time.perf_counter() - began)
    return rejected, max(1e-9, min(took))


def sample_texts(docs: DataFrame, text: str, doc_id: str, sample_rows: int, sample_chars: int) -> list[str | None]:
    """About ``sample_rows`` texts, picked by a hash of id and text all over the table, never more than twice as many.
    Texts of over ``sample_chars`` characters aren't among them: the sample steers the order of the rules alone, and its
    size is bounded."""
    some = max(1, docs.count() // max(1, sample_rows))
    key = F.xxhash64(F.col(doc_id).cast("string") if doc_id in docs.columns else F.lit(0), F.col(text))
    short = F.coalesce(F.char_length(text), F.lit(0)) <= sample_chars
    return [r[0] for r in docs.where((F.pmod(key, F.lit(some)) == 0) & short).select(text).limit(2 * sample_rows).collect()]


FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
KIND = "struct<" + ",".join(f"{n}:bigint" for n in FEATURES) + ",base_failed:boolean,kept:boolean>"


def measured(text: Column, order: Sequence[Rule]) -> Column:
    """A struct of the digest's counts, base_failed and kept. Equal texts have equal results."""
    own = [r.name for r in order]

    @F.arrow_udf(KIND)
    def run(a: pa.Array) -> pa.Array:
        by_name = {r.name: r for r in VERDICT_RULES}
        rules = [by_name[n] for n in own]
        rows = []
        for part in slices(a):
            for t in part:
                d = Measured(t)
                failed = any(r.rejects(d) for r in BASE_RULES)
                kept = not failed and not any(r.rejects(d) for r in rules)
                rows.append((*(getattr(d, n) for n in FEATURES), failed, kept))
        kinds = [*[pa.int64()] * len(FEATURES), pa.bool_(), pa.bool_()]
        cols = list(zip(*rows)) or [()] * len(kinds)
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=[*FEATURES, "base_failed", "kept"])

    return run(text)


def keeps(text: Column, order: Sequence[Rule]) -> Column:
    """Whether the whole cascade, base rules included, keeps a text; it stops at the first rejection. A null
    text counts as empty."""
    own = [r.name for r in order]

    @F.arrow_udf("boolean")
    def run(a: pa.Array) -> pa.Array:
        by_name = {r.name: r for r in (*BASE_RULES, *VERDICT_RULES)}
        rules = [by_name[n] for n in own]
        return pa.array([not any(r.rejects(d) for r in rules) for part in slices(a) for d in map(Measured, part)], pa.bool_())

    return run(text)


def quality(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", sample_rows: int = 300, sample_chars: int = 100_000) -> DataFrame:
    """Per row: the id, the digest's counts, base_failed, kept. The digest has all counts and the base rules' verdict of
    every row, so here only the method's own rules run as a cascade, behind the base rules; ``keep_quality`` runs all.
    Null and empty texts have no words and fail; a very long one is measured whole, in memory in proportion to its
    words. Ids may be null or repeat, each row has its own result; an empty table gives an empty one; other columns are
    ignored."""
    order = cascade_order(VERDICT_RULES, sample_texts(docs, text, doc_id, sample_rows, sample_chars))
    out = docs.select(F.col(doc_id), measured(F.col(text), order).alias("_m"))
    return out.select(F.col(doc_id), "_m.*")


def keep_quality(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", sample_rows: int = 300, sample_chars: int = 100_000) -> DataFrame:
    """The rows of ``docs`` that every rule lets pass, with all columns as they are; repeated rows alike. A row leaves at
    the first rule that rejects it. The id only spreads the sample."""
    order = cascade_order((*BASE_RULES, *VERDICT_RULES), sample_texts(docs, text, doc_id, sample_rows, sample_chars))
    return docs.where(keeps(F.col(text), order))

"""License scans: ordered signature rules over normalised words.

A text becomes its words (ASCII letters lower-cased, runs of letters, digits and non-ASCII characters) joined by
single spaces. Each signature is a regular expression over that form with a keyword that must occur before the
expression is tried, and a priority; one automaton finds the keywords of all. Where detections overlap, one that lies inside another of better priority, or
inside a longer one of the same priority, gives way.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.llm import signatures as rules
from lamella.llm.common import slices

#: Phrases whose places are always counted, and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


@dataclass(frozen=True)
class Signature:
    label: str
    keyword: str  # must occur in the normalised text
    pattern: str  # over words joined by single spaces
    priority: int  # smaller is better
    weight: float  # how sure a match is, below 1


# Priorities: full licence wording, then exact identifiers, then named versions, then names, then hints.
TEXT, SPDX, VERSION, NAME, HINT = range(5)
WEIGHT = {TEXT: 0.95, SPDX: 0.95, VERSION: 0.9, NAME: 0.6, HINT: 0.3}

@lru_cache(maxsize=1)
def signatures() -> tuple[Signature, ...]:
    """All rules, best priority first."""
    out = []
    for priority, group in ((TEXT, rules.TEXT), (SPDX, rules.SPDX), (VERSION, rules.VERSION), (NAME, rules.NAME), (HINT, rules.HINT)):
        for line in group.strip().splitlines():
            label, keyword, pattern = line.split(" | ", 2)
            # A keyword is cut before "license", which patterns spell either way.
            out.append(Signature(label, keyword.removesuffix(" license"), pattern.replace("~", "licen[sc]e"), priority, WEIGHT[priority]))
    return tuple(out)


@lru_cache(maxsize=1)
def _prefilter() -> tuple[ahocorasick.Automaton, list[list[tuple[Signature, re.Pattern]]]]:
    """(all keywords as one automaton that gives their numbers, the rules of each number)."""
    numbers: dict[str, int] = {}
    found: list[list] = []
    for s in signatures():
        if s.keyword not in numbers:
            numbers[s.keyword] = len(found)
            found.append([])
        found[numbers[s.keyword]].append((s, re.compile(rb"(?<= )(?:" + s.pattern.encode() + rb")(?= )")))
    automaton = ahocorasick.Automaton()
    for keyword, i in numbers.items():
        automaton.add_word(keyword, i)
    automaton.make_automaton()
    return automaton, found


def normal_form(text: str | None) -> tuple[bytes, int]:
    """(words joined and surrounded by single spaces, how many)."""
    words = (text or "").encode("utf-8", "replace").translate(_WORDS).split()
    return b" " + b" ".join(words) + b" ", len(words)


def places(norm: bytes, phrase: str) -> list[int]:
    """Word index of every place where the phrase's words stand consecutively."""
    out, at, words, seen = [], -1, 0, 0
    needle = f" {phrase} ".encode()
    while (at := norm.find(needle, at + 1)) >= 0:
        words += norm.count(b" ", seen, at)
        seen = at
        out.append(words)
    return out


@dataclass(frozen=True)
class Detection:
    label: str
    start: int  # in words, from 0
    end: int
    priority: int
    weight: float


def suppressed(found: Iterable[Detection]) -> list[Detection]:
    """Without the detections that lie inside one of better priority, or inside a longer one of the same; of those
    that agree in priority and interval all stay. One pass over detections sorted by start keeps, for each
    priority, how far the intervals so far reach."""
    reach: dict[int, tuple[int, int]] = {}
    kept = []
    for d in sorted(set(found), key=lambda d: (d.start, -d.end, d.priority, d.label)):
        inside = any(end >= d.end and (p < d.priority or (p == d.priority and (start, end) != (d.start, d.end))) for p, (end, start) in reach.items() if p <= d.priority)
        if not inside:
            kept.append(d)
        if (e := reach.get(d.priority)) is None or d.end > e[0]:
            reach[d.priority] = (d.end, d.start)
    same = {}  # intervals with the same start and end: a better priority that sorts later can't exist, see the key
    for d in kept:
        same[(d.start, d.end)] = min(d.priority, same.get((d.start, d.end), d.priority))
    return [d for d in kept if d.priority == same[(d.start, d.end)]]


def scan(norm: bytes) -> list[Detection]:
    """Detections that stay, from all signatures whose keyword occurs."""
    found = []
    automaton, by_keyword = _prefilter()
    for number in sorted({i for _, i in automaton.iter(norm.decode("latin-1"))}):
        for s, pattern in by_keyword[number]:
            at = words = 0
            for m in pattern.finditer(norm):
                words += norm.count(b" ", at, m.start())
                at = m.start()
                found.append(Detection(s.label, words - 1, words + norm.count(b" ", m.start(), m.end()), s.priority, s.weight))
    return suppressed(found) if found else found


KIND = "struct<n_words:bigint,n_base:bigint,first_word:bigint,last_word:bigint,base_labels:string,labels:string,score:double,detections:array<struct<label:string,start:int,length:int>>>"


def licenses(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per row: the id, n_words, n_base (places of the fixed phrases), first_word and last_word (their smallest and
    largest start, else null), base_labels, labels (with those of the signatures), score (0 without a detection,
    towards 1 with several sure ones) and detections (label, first word, words; in order).

    Null and empty texts have no words; a very long one is scanned whole. Ids may be null or repeat: each row has its own result. An empty table gives
    an empty one. Other columns are ignored.
    """

    @F.arrow_udf(KIND)
    def run(a: pa.Array) -> pa.Array:
        rows = []
        for part in slices(a):
            for t in part:
                norm, n = normal_form(t)
                base = {label: at for phrase, label in PHRASES.items() if (at := places(norm, phrase))}
                found, starts = scan(norm), [x for at in base.values() for x in at]
                doubt = 1.0
                for w in [*(d.weight for d in found), *(0.5 for _ in base)]:
                    doubt *= 1 - w
                labels = sorted({*base, *(d.label for d in found)})
                rows.append(
                    {
                        "n_words": n,
                        "n_base": len(starts),
                        "first_word": min(starts, default=None),
                        "last_word": max(starts, default=None),
                        "base_labels": ",".join(sorted(base)),
                        "labels": ",".join(labels),
                        "score": 1 - doubt,
                        "detections": [{"label": d.label, "start": d.start, "length": d.end - d.start} for d in found],
                    }
                )
        return pa.array(rows, _arrow_kind())

    return docs.select(F.col(doc_id), run(F.col(text)).alias("_r")).select(F.col(doc_id), "_r.*")


def _arrow_kind() -> pa.DataType:
    spans = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int32()), ("length", pa.int32())]))
    longs = [(n, pa.int64()) for n in ("n_words", "n_base", "first_word", "last_word")]
    return pa.struct([*longs, ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("detections", spans)])

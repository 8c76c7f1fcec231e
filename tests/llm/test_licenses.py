"""License scans against brute force."""

import random
import re

import pytest

from lamella.llm import licenses, queries
from tests.llm.helpers import ODD, clashing, documents
from tests.oracle import DATA

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(text):
    words = WORDS.findall((text or "").translate(UPPER))
    places, labels = [], set()
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        at = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        places += at
        labels |= {label} if at else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def base(r):
    return r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]


def test_base_of_random_texts(spark):
    rng = random.Random(1)
    bits = ["GNU General", "general public license", "Apache License", "CC BY", "cc-by-sa 4.0", "MIT", "license", "x", "é", "-", "\n", "mit license mit license", "\x7f", "1"]
    texts = [" ".join(rng.choice(bits) for _ in range(rng.randint(0, 12))) for _ in range(200)] + ODD
    got = {r["doc_id"]: r for r in licenses.licenses(clashing(documents(spark, texts))).collect()}
    for i, t in enumerate(texts):
        assert base(got[i]) == brute(t), t
        assert set(filter(None, got[i]["base_labels"].split(","))) <= set(got[i]["labels"].split(","))
        assert 0 <= got[i]["score"] <= 1


def test_base_phrases_are_those_of_the_contract(spark):
    texts = ["the GNU General Public License", "GNU Lesser General Public License", "General Public License", "Affero general public license, Apache License; CC BY, MIT License"]
    got = {r["doc_id"]: base(r) for r in licenses.licenses(documents(spark, texts)).collect()}
    assert got == {0: (5, 1, 1, 1, "gpl"), 1: (5, 0, None, None, ""), 2: (3, 0, None, None, ""), 3: (10, 3, 4, 8, "apache,cc-by,mit")}


def test_whole_table(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    for r in queries.op8_license_scan(spark, DATA).collect():
        assert base(r) == brute(texts[r["doc_id"]])


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("Licensed under the Apache License, Version 2.0.", {"apache-2.0"}),
        ("GNU General Public License, version 3 or any later version", {"gpl-3-or-later"}),
        ("SPDX-License-Identifier: GPL-2.0-only", {"gpl-2", "spdx"}),
        ("Licensed under CC BY-NC 4.0.", {"cc-by-nc-4.0"}),
        ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", {"mit"}),
        ("nothing to see", set()),
        ("Mozilla Public License", {"mpl"}),
        ("Mozilla Public License 2.0 (MPL-2.0)", {"mpl", "mpl-2.0"}),
    ],
)
def test_signatures(text, labels):
    assert {d.label for d in licenses.scan(licenses.normal_form(text)[0])} == labels


def test_keyword_gates_are_part_of_their_patterns():
    assert len(licenses.signatures()) > 250
    for s in licenses.signatures():
        assert s.keyword in re.sub(r"\(\?:[^()]*\)\?", "", s.pattern).replace("[sc]", "s"), s


def brute_labels(text):
    """Labels by every rule at every place, without keywords, and suppression by all pairs."""
    words = WORDS.findall((text or "").translate(UPPER))
    norm = " " + " ".join(words) + " "
    found = set()
    for s in licenses.signatures():
        for m in re.finditer("(?<= )(?:" + s.pattern + ")(?= )", norm):
            start = norm.count(" ", 0, m.start()) - 1
            found.add((s.label, start, start + m.group().count(" ") + 1, s.priority, s.weight))
    inside = lambda d, e: e[1] <= d[1] and d[2] <= e[2] and (e[3] < d[3] or (e[3] == d[3] and e[1:3] != d[1:3]))
    kept = {d for d in found if not any(inside(d, e) for e in found)}
    low, base = norm, set()
    for phrase, label in (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit")):
        base |= {label} if f" {phrase} " in low else set()
    doubt = 1.0
    for w in [*(d[4] for d in kept), *(0.5 for _ in base)]:
        doubt *= 1 - w
    return ",".join(sorted(base | {d[0] for d in kept})), 1 - doubt


def test_labels_and_scores_against_all_rules_at_all_places(spark):
    rng = random.Random(7)
    lines = [re.sub(r"\(\?:[^()]*\)\??(?:\{[^}]*\})?|\[\^ \]\+|\?", " ", s.pattern).replace("[sc]", rng.choice("sc")) for s in licenses.signatures()]
    texts = [" ".join(rng.choice(lines) for _ in range(rng.randint(1, 5))) for _ in range(250)] + lines + ["the  MIT-License", "ünï GPL v2 😀"]
    got = {r["doc_id"]: r for r in licenses.licenses(documents(spark, texts)).collect()}
    for i, t in enumerate(texts):
        labels, score = brute_labels(t)
        assert got[i]["labels"] == labels and got[i]["score"] == pytest.approx(score), t


def test_labels_of_the_whole_table(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    for r in queries.op8_license_scan(spark, DATA).collect():
        labels, score = brute_labels(texts[r["doc_id"]])
        assert r["labels"] == labels and r["score"] == pytest.approx(score)


def test_suppression_against_all_pairs():
    rng = random.Random(3)
    for _ in range(300):
        found = {licenses.Detection(rng.choice("ab"), s := rng.randrange(10), s + rng.randint(1, 5), rng.randrange(3), 0.5) for _ in range(rng.randint(1, 8))}
        inside = lambda d, e: e.start <= d.start and d.end <= e.end and (e.priority < d.priority or (e.priority == d.priority and (e.start, e.end) != (d.start, d.end)))
        assert set(licenses.suppressed(found)) == {d for d in found if not any(inside(d, e) for e in found)}


def test_no_rows(spark):
    assert licenses.licenses(documents(spark, ["a"]).limit(0)).count() == 0

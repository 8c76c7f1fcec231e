"""SentencePiece: best segmentation, streaming, decoding, library agreement."""

import random

import public_tokenizers as P
import pytest
import sentencepiece

from lamella.llm import pieces
from tests.llm.helpers import ODD, clashing, documents

PATH = P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def v():
    return pieces.vocabulary(PATH)


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as f:  # the same file with trainer_spec.model_type (field 2.3) set to unigram
        return sentencepiece.SentencePieceProcessor(model_proto=f.read() + b"\x12\x02\x18\x01")


def strings(n, letters="abcdetho thñé一 😀\n▁", seed=3):
    rng = random.Random(seed)
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def brute(v, text):
    """The best sum over all segmentations, by plain recursion over suffixes."""
    best = {len(text): 0.0}
    for i in range(len(text) - 1, -1, -1):
        options = [v.scores[v.ids[text[i:j]]] + best[j] for j in range(i + 1, min(len(text), i + v.longest) + 1) if text[i:j] in v.ids]
        if text[i] not in v.ids:
            options.append(v.unknown_score + best[i + 1])
        best[i] = max(options)
    return best[0]


def total(v, text):
    norm, out = v.normalised(text), 0.0
    for part in v.search([norm]):
        for i in part:
            out += 0 if v.kinds[i] == pieces.BYTE else v.scores[i]
    return out + v.unknown_score * sum(c not in v.ids for c in norm)


def test_segmentation_is_the_best(v):
    for s in strings(300):
        assert total(v, s) == pytest.approx(brute(v, v.normalised(s)))


def test_library_lattice_agrees_on_the_sum(v, library):
    for s in strings(200, "abcdetho th"):
        if s.strip():
            theirs = library.nbest_encode(s, nbest_size=2)[0]
            assert sum(v.scores[i] for i in theirs) == sum(v.scores[i] for i in v.encode(s).tolist())


def test_stream_gives_the_same_ids_however_it_is_cut(v):
    rng = random.Random(5)
    for s in strings(100):
        norm = v.normalised(s)
        cuts = sorted(rng.sample(range(len(norm) + 1), min(3, len(norm) + 1)))
        parts = [norm[a:b] for a, b in zip([0, *cuts], [*cuts, len(norm)])]
        whole = [i for p in v.search([norm]) for i in p]
        assert [i for p in v.search(parts) for i in p] == whole == v.encode(s).tolist()


def test_ids_come_in_bounded_stretches(v):
    text = "ab" * 5000
    assert max(len(part) for part in v.search(text)) < 10 * v.longest
    assert v.decode(v.encode(text).tolist()) == text


@pytest.mark.parametrize("letters", ["abcdetho", "一的是不了人", "é", "▁a"])
def test_long_texts_without_spaces_take_linear_time(v, letters):
    import time

    rng, took = random.Random(6), []
    for n in (50_000, 400_000):
        text = "".join(rng.choice(letters) for _ in range(n))
        began = time.perf_counter()
        ids = v.encode(text)
        took.append(time.perf_counter() - began)
        assert v.decode(ids.tolist()) == text.replace("▁", " ").strip(" ") or "▁" in text
    assert took[1] < 8 * took[0] * 3 + 1


def whole(v, text):
    """Ids by one table over the whole text, all starts for each end: the quadratic way, first of the best kept."""
    score, back = [0.0] + [float("-inf")] * len(text), [None] * (len(text) + 1)
    for i in range(len(text)):
        for j in range(i + 1, len(text) + 1):
            p = v.ids.get(text[i:j])
            own = v.scores[p] if p is not None else v.unknown_score if j == i + 1 else None
            if own is not None and score[i] + own > score[j]:
                score[j], back[j] = score[i] + own, (i, p)
    out, at = [], len(text)
    while at:
        i, p = back[at]
        out[:0] = [p] if p is not None else [v.bytes[b] for b in text[i:at].encode()]
        at = i
    return out


def test_ids_equal_one_table_over_the_whole_text(v):
    for s in [*strings(80), *strings(40, "abcdetho", seed=8), "".join(strings(20, "aeht", seed=9))]:
        assert v.encode(s).tolist() == whole(v, v.normalised(s))


def test_paths_that_stay_apart():
    # pieces of two characters and one of each alone: two paths go side by side until the text's end
    w = pieces.Vocabulary(b"")
    w.ids, w.scores, w.kinds, w.pieces = {"a": 0, "aa": 1}, [-1.0, -2.0], [1, 1], ["a", "aa"]
    w.tree, w.alone = {"a": ({"a": ({}, 1, -2.0)}, 0, -1.0)}, {"a"}
    w.longest, w.prefix, w.trim, w.known = 2, False, False, pieces._Known(w)
    for n in (1, 2, 3, 99, 10_000):
        ids = w.encode("a" * n).tolist()
        assert "".join(w.pieces[i] for i in ids) == "a" * n


def test_blocks_end_at_borders(v, monkeypatch):
    rng = random.Random(12)
    texts = ["".join(rng.choice("ab ▁") for _ in range(rng.randint(1, 300))) for _ in range(100)]
    want = [v.encode(t).tolist() for t in texts]
    monkeypatch.setattr(pieces, "BLOCK_CHARS", 7)
    monkeypatch.setattr(pieces, "READ_CHARS", 3)
    assert [v.encode(t).tolist() for t in texts] == want


def test_decoding_matches_the_library(v, library):
    rng = random.Random(9)
    for s in strings(200):
        ids = v.encode(s).tolist()
        assert v.decode(ids) == library.decode(ids)
        assert "▁" in s or v.decode(ids) == s
    for _ in range(100):
        ids = [rng.randrange(3, 32000) for _ in range(8)]
        assert v.decode(ids) == library.decode(ids)


def test_columns(spark):
    docs = clashing(documents(spark, ODD))
    got = {r["doc_id"]: r for r in pieces.summary(docs, PATH).collect()}
    assert all(r["round_trip"] for r in got.values())
    assert got[0]["n_ids"] == got[1]["n_ids"] == 0 and got[4][1:] == got[5][1:]
    both = pieces.decoded(pieces.encoded(docs.drop("ids"), PATH), PATH, to="back")
    assert all((r["text"] or "") == r["back"] for r in both.select("text", "back").collect())
    assert pieces.summary(docs.limit(0), PATH).count() == 0

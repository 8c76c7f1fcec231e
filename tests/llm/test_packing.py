"""Packing: ids of the tokenizers library, complete pieces, gapless sequences, the sum-of-squares rule."""

import collections
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from lamella.llm import packing
from tests.llm.helpers import DOCS, LONG, ODD, clashing, documents

PATH = P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids_of(library, text):
    return [*library.encode(text or "", add_special_tokens=False).ids, 1]


def test_same_ids_as_the_library(library):
    rng = random.Random(2)
    letters = "abcDEF 'st'll 0123 \n\t\r é一😀ñß  ́‍<|>.,!\x00_"
    enc = packing.encoder(PATH)
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 80))) for _ in range(1500)]
    added = ["<|endoftext|>", "a<|endoftext|>b", "<|endoftext|><|endoftext|>", " <|endoftext|> x", "<|endoftext", "<<|endoftext|>>\n<|endoftext|>"]
    for t in [*texts, *added, "don't we'll", "   x   \n\n", *[x for x in ODD if x]]:
        assert [*enc(t), 1] == ids_of(library, t)
    assert list(enc("a<|endoftext|>b")) == [64, 50256, 65]


def test_other_files_run_in_the_library(tmp_path):
    other = P.path("word_bpe_49k.json")
    assert packing.encoder(other)("Some Words, <|endoftext|> here") == Tokenizer.from_file(other).encode("Some Words, <|endoftext|> here", add_special_tokens=False).ids


def check(rows, texts, library, size):
    by_doc, by_seq = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
    assert set(by_doc) == set(texts)
    for i, t in texts.items():
        ids, at = ids_of(library, t), 0
        for r in sorted(by_doc[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["length"] > 0
            part = np.array(ids[at : at + r["length"]], dtype="<u4")
            assert zlib.crc32(part.tobytes()) == r["ids_crc32"]
            if "ids" in r.asDict():
                assert list(r["ids"]) == part.tolist()
            at += r["length"]
        assert at == len(ids)
    pad = 0
    for rs in by_seq.values():
        at = 0
        for r in sorted(rs, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= size
        pad += 0 if at & (at - 1) == 0 else size - at
    return pad


@pytest.mark.parametrize("size", [16, 2048])
@pytest.mark.parametrize("max_open", [2, 512])
def test_pieces_and_sequences(spark, library, size, max_open):
    rng = random.Random(size)
    texts = ODD + ["a<|endoftext|>b", "<|endoftext|>"] + [" ".join(rng.choice(("the", "thhe", "über", "x")) for _ in range(rng.randint(0, 200))) for _ in range(80)]
    df = clashing(documents(spark, texts).repartition(3))
    rows = packing.pack(df, PATH, size=size, max_open=max_open).collect()
    assert check(rows, dict(enumerate(texts)), library, size) == 0


def test_nulls_repeats_and_no_rows(spark):
    df = documents(spark, ["a", "a", None], [None, None, 3])
    rows = packing.pack(df, PATH, with_ids=False).collect()
    assert collections.Counter(r["doc_id"] for r in rows) == {None: 2, 3: 1}
    assert packing.pack(spark.createDataFrame([], DOCS), PATH).count() == 0


def test_level_minimises_the_sum_of_squares():
    rng = random.Random(8)
    p = packing.Packer(40, 10_000)
    for i in range(3000):
        n = rng.choice([3, 7, 11, 13, 27, 39])
        counts = p.count.copy()

        def squares(h):
            c = counts.copy()
            if h:
                c[h] -= 1
            if h + n < 40:
                c[h + n] += 1
            return int((c**2).sum())

        levels = [0, *(h for h in range(1, 40 - n + 1) if counts[h])]
        best = min(map(squares, levels))
        level = p.level_for(n)
        assert level in levels and squares(level) == best and level == max(h for h in levels if squares(h) == best)
        p.add(i, np.zeros(n, dtype="<u4"))
    assert (p.count == np.array([len(p.at.get(h, ())) if h else 0 for h in range(41)])).all()


def test_open_windows_are_bounded():
    p = packing.Packer(100, 20)
    for i in range(2000):
        p.add(i, np.zeros(51, dtype="<u4"))
        assert p.open <= 20
    p.finish()
    assert sum(len(x[2]) for w in p.done for x in w) == 2000 * 51
    assert all(sum(len(x[2]) for x in w) in (100, 64, 32, 16, 8, 4, 2, 1) for w in p.done)


def test_completing_cuts_one_piece_at_most():
    rng = random.Random(4)
    p, whole = packing.Packer(100, 10_000), 0
    for i in range(500):
        p.add(i, np.zeros(rng.randint(1, 99), dtype="<u4"))
    for windows in list(p.at.values()):
        for w in windows:
            whole += len(w.pieces)
    before, began = p.open, len(p.done)
    p.finish()
    made = p.done[began:]
    # each sequence ends in one cut at most, so pieces grow by no more than the sequences made
    assert before > 0 and sum(map(len, made)) <= whole + len(made)
    assert sum(sum(len(x[2]) for x in w) < 100 for w in made) <= 7


def test_long_text_is_whole(spark, library):
    rows = packing.pack(documents(spark, [LONG]), PATH).collect()
    assert check(rows, {0: LONG}, library, 2048) == 0

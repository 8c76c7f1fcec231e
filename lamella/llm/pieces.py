"""SentencePiece encoding and decoding with a streaming Viterbi search.

Text is read from left to right, a few thousand characters at a time. Scores and back pointers are kept from the last
boundary that all surviving paths share to as far ahead as the longest piece reaches. At such a boundary the ids before
it are final and are handed out, so the search's memory doesn't grow with the text.

The pieces' scores are taken as they are in the model file: the best segmentation is the one with the largest sum.
For a unigram model that is the library's own result; a file of another kind is read as a unigram model.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.llm.common import slices

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNKNOWN_COST = 10.0
UNKNOWN_TEXT = " ⁇ "
#: What is remembered at most: so many texts between borders, of so many characters.
KNOWN_CHUNKS, KNOWN_CHARS = 300_000, 40
#: Characters that are read from a text, and split at borders, at a time.
READ_CHARS, BLOCK_CHARS = 4096, 1 << 16
_NEVER, _ORIGIN = float("-inf"), (0, -1)


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of a protocol buffer message's fields, in order."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
        elif kind == 2:
            n = number()
            yield key >> 3, data[at : at + n]
            at += n
        else:
            n = {1: 8, 5: 4}[kind]
            yield key >> 3, struct.unpack("<d" if n == 8 else "<f", data[at : at + n])[0]
            at += n


class Vocabulary:
    """Pieces of a model file, and the search over them."""

    def __init__(self, data: bytes):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        self.prefix, self.trim, self.escape = True, True, True
        for field, value in _fields(data):
            if field == 1:
                own = dict(_fields(value))
                self.pieces.append(own.get(1, b"").decode("utf-8"))
                self.scores.append(own.get(2, 0.0))
                self.kinds.append(own.get(3, NORMAL))
            elif field == 3:
                spec = dict(_fields(value))
                if spec.get(2):
                    raise ValueError("a model with a character map isn't supported: its texts would need that normalisation first")
                self.prefix, self.trim, self.escape = (bool(spec.get(i, 1)) for i in (3, 4, 5))
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k in (NORMAL, USER)}
        self.longest = max(map(len, self.ids), default=1)
        #: The pieces as a tree by character: (what may follow, id of the piece that ends there or -1, its score).
        self.tree: dict[str, tuple[dict, int, float]] = {}
        for p, i in self.ids.items():
            level = self.tree
            for ch in p[:-1]:
                level = level.setdefault(ch, ({}, -1, 0.0))[0]
            below = level[p[-1]][0] if p[-1] in level else {}
            level[p[-1]] = below, i, len(p) * -0.1 if self.kinds[i] == USER else self.scores[i]
        #: Characters that are pieces themselves; any other may stand alone as unknown.
        self.alone = {p for p in self.ids if len(p) == 1}
        self.bytes = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == BYTE}
        self.value_of = {i: b for b, i in self.bytes.items()}
        self.unknown = next((i for i, k in enumerate(self.kinds) if k == UNKNOWN), 0)
        normal = [s for s, k in zip(self.scores, self.kinds) if k == NORMAL]
        self.unknown_score = min(normal, default=0.0) - UNKNOWN_COST
        #: Whether no piece reaches over the border before a space: then all paths meet there.
        self.meets = not any(re.search(rf"[^{SPACE}]{SPACE}", p) for p in self.ids)
        #: What each id alone shows as, and whether it does so beside any others: all but parts of longer characters.
        self.shown = [chr(self.value_of.get(i, 0)) if k == BYTE else UNKNOWN_TEXT if k == UNKNOWN else "" if k == CONTROL else p for i, (p, k) in enumerate(zip(self.pieces, self.kinds))]
        self.plain = [k != BYTE or self.value_of[i] < 128 for i, k in enumerate(self.kinds)]
        self.known = _Known(self)

    # ---- encoding ----

    def normalised(self, text: str) -> str:
        if self.trim:
            text = re.sub(" +", " ", text.strip(" "))
        if self.prefix and text:
            text = " " + text
        return text.replace(" ", SPACE) if self.escape else text

    def search(self, source: Iterable[str]) -> Iterator[list[int]]:
        """Ids of normalised text, a list for each stretch that has become certain. ``source`` is a stream of strings;
        how it is cut makes no difference.

        Text, scores and back pointers are kept from the last certain boundary to ``longest`` characters past the
        current one. Sums run from the stream's start, so they don't depend on when ids were handed out.
        """
        tree, alone, longest, unknown = self.tree, self.alone, self.longest, self.unknown_score
        # Boundaries count from the start of ``text``: best score, and (start, id) of the best piece that ends there.
        text, score, back = "", [0.0], [_ORIGIN]
        at = reached = sure = done = 0  # next to leave from, furthest reached, last that all paths share, last handed out
        step = 4 * longest  # open characters at which ids are handed out
        wait, pending, ended = step, iter(source), False
        while True:
            while not ended and len(text) - at < longest:
                more = next(pending, None)
                ended = more is None
                if more:
                    text, score, back = text[done:] + more, score[done:] + [_NEVER] * len(more), [(s - done, i) for s, i in back[done:]] + [_ORIGIN] * len(more)
                    at, reached, sure, done = at - done, reached - done, sure - done, 0
            end = len(text)
            if at == end:
                if at > done:
                    yield self._path(text, back, done, at)
                return
            for at in range(at, end if ended else end - longest + 1):
                if reached == at:  # no piece crosses: every path goes through here
                    sure = at
                if at - done >= wait:
                    if sure == done:
                        sure = self._meet(back, done, [p for p in range(at, reached + 1) if score[p] > _NEVER])
                    # Where paths go on side by side, they are next compared when twice as much is open.
                    wait = step if sure > done else 2 * (at - done)
                    if sure > done:
                        yield self._path(text, back, done, sure)
                        done = sure
                here, node, stop = score[at], tree, at
                for ch in text[at : at + longest]:
                    found = node.get(ch)
                    if found is None:
                        break
                    stop += 1
                    node, piece, own = found
                    if piece >= 0:
                        own += here
                        if own > score[stop]:
                            score[stop], back[stop] = own, (at, piece)
                        if stop > reached:
                            reached = stop
                if text[at] not in alone:
                    if here + unknown > score[at + 1]:
                        score[at + 1], back[at + 1] = here + unknown, (at, -1)
                    if at == reached:
                        reached += 1
            at += 1

    @staticmethod
    def _meet(back: list, done: int, reached: list[int]) -> int:
        """The last boundary that the paths to all ``reached`` ones share; ``done`` if there is none behind it."""
        live = set(reached)
        while len(live) > 1:
            p = max(live)
            live.remove(p)
            live.add(max(done, back[p][0]))
        return live.pop()

    def _path(self, text: str, back: list, done: int, end: int) -> list[int]:
        """Ids of the best path from one certain boundary to the next."""
        out: list[int] = []
        while end > done:
            start, piece = back[end]
            if piece >= 0:
                out.append(piece)
            elif self.bytes:
                out.extend(self.bytes[b] for b in reversed(text[start:end].encode("utf-8", "replace")))
            else:
                out.append(self.unknown)
            end = start
        out.reverse()
        return out

    def packed(self, norm: str, start: int = 0, end: int | None = None) -> bytes:
        """Ids of a part of normalised text, searched as a stream, as little-endian unsigned 32-bit."""
        end = len(norm) if end is None else end
        stream = [norm] if end - start == len(norm) <= READ_CHARS else (norm[i : min(i + READ_CHARS, end)] for i in range(start, end, READ_CHARS))
        return b"".join([struct.pack(f"<{len(ids)}I", *ids) for ids in self.search(stream)])

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of a whole text; none for a null or empty one. Where no piece reaches over the border before a space,
        that border is certain in advance: what lies between is searched on its own, and short parts are remembered."""
        norm = self.normalised(text or "")
        if not self.meets:
            return np.frombuffer(self.packed(norm), dtype="<u4")
        out, known = [], self.known
        for start, end in _blocks(norm):
            if end - start > BLOCK_CHARS:  # no border in it
                out.append(self.packed(norm, start, end))
            else:
                out.extend(map(known.__getitem__, _CHUNK.findall(norm, start, end)))
        return np.frombuffer(b"".join(out), dtype="<u4")

    # ---- decoding ----

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids: bytes join into characters (broken ones become U+FFFD), control pieces vanish, an unknown
        piece shows as a double question mark; the space that encoding put in front goes."""
        if all(map(self.plain.__getitem__, ids := list(ids))):
            return self._spaced("".join(map(self.shown.__getitem__, ids)))
        out, pending = [], bytearray()
        for i in ids:
            kind = self.kinds[i]
            if kind == BYTE:
                pending.append(self.value_of[i])
                continue
            if pending:
                out.append(pending.decode("utf-8", "replace"))
                pending.clear()
            if kind == UNKNOWN:
                out.append(UNKNOWN_TEXT)
            elif kind != CONTROL:
                out.append(self.pieces[i])
        out.append(pending.decode("utf-8", "replace"))
        return self._spaced("".join(out))

    def _spaced(self, text: str) -> str:
        if self.prefix and text.startswith(SPACE):
            text = text[1:]
        return text.replace(SPACE, " ") if self.escape else text


_CHUNK = re.compile(rf"{SPACE}*[^{SPACE}]+|{SPACE}+")
_BORDER = re.compile(rf"(?<=[^{SPACE}]){SPACE}")


def _blocks(norm: str) -> Iterator[tuple[int, int]]:
    """Normalised text cut at borders before spaces, into blocks of ``BLOCK_CHARS`` at most where borders allow it."""
    start = 0
    while start < len(norm):
        end = start + BLOCK_CHARS
        if end >= len(norm):
            end = len(norm)
        else:
            while end > start and not (norm[end] == SPACE and norm[end - 1] != SPACE):
                end = norm.rfind(SPACE, start, end)  # -1 without one
            if end <= start:
                found = _BORDER.search(norm, start + BLOCK_CHARS)
                end = found.start() if found else len(norm)
        yield start, end
        start = end


class _Known(dict):
    """Packed ids by text between borders, searched when first asked for; kept while there are not too many."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary

    def __missing__(self, chunk: str) -> bytes:
        ids = self.vocabulary.packed(chunk)
        if len(self) < KNOWN_CHUNKS and len(chunk) <= KNOWN_CHARS:
            self[chunk] = ids
        return ids


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a model file, loaded once per process."""
    with open(path, "rb") as f:
        return Vocabulary(f.read())


def encoded(docs: DataFrame, model: str, *, text: str = "text", to: str = "ids") -> DataFrame:
    """``docs`` with the ids of each whole text in the array column ``to``, which replaces one of that name. Null and empty
    texts have an empty array. A very long text is searched as a stream; its ids are one array. Of equally good paths
    the one whose last piece is longest is taken. Repeated rows have equal ids; an empty table stays empty; other
    columns are kept."""

    @F.arrow_udf("array<int>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        v = vocabulary(model)
        for a in batches:
            yield pa.array([v.encode(t).view(np.int32) for part in slices(a) for t in part], pa.list_(pa.int32()))

    return docs.withColumn(to, run(F.col(text)))


def decoded(df: DataFrame, model: str, *, ids: str = "ids", to: str = "text") -> DataFrame:
    """``df`` with the text of each id array in the column ``to``, which replaces one of that name. A null or empty array
    is an empty text. Repeated rows have equal texts; an empty table stays empty; other columns are kept."""

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        v = vocabulary(model)
        for a in batches:
            yield pa.array([v.decode(x or ()) for part in slices(a) for x in part], pa.string())

    return df.withColumn(to, run(F.col(ids)))


def summary(docs: DataFrame, model: str, *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per row: the id, n_ids, ids_crc32 (ids as little-endian unsigned 32-bit) and round_trip (decoding the ids gives
    the whole text back; a null text counts as empty). A text holding U+2581 itself comes back with a space there.
    Ids may be null or repeat: each row has its own result. An empty table gives an empty one. Other columns are
    ignored."""

    @F.arrow_udf("struct<n_ids:bigint,ids_crc32:bigint,round_trip:boolean>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        v = vocabulary(model)
        for a in batches:
            rows = []
            for part in slices(a):
                for t in part:
                    ids = v.encode(t)
                    rows.append((len(ids), zlib.crc32(ids.tobytes()), v.decode(ids.tolist()) == (t or "")))
            cols = list(zip(*rows)) or [()] * 3
            kinds = (pa.int64(), pa.int64(), pa.bool_())
            yield pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["n_ids", "ids_crc32", "round_trip"])

    return docs.select(F.col(doc_id), run(F.col(text)).alias("_s")).select(F.col(doc_id), "_s.*")

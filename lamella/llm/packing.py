"""Sum-of-squares online packing of tokenised documents into fixed windows.

Whole windows are cut off a document as they are; its remainder goes to the open window whose level keeps the sum
over levels of (open windows at that level) ** 2 smallest, read from a level array. Where more than ``max_open``
windows are open, the fullest one is completed and leaves: its gap is filled from the emptiest one, whose last piece is
cut to fit. The same completes what is open at the end of a partition, fullest first; the last window is cut into
powers of two, which need no padding.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import defaultdict, deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from lamella.llm.common import slices

#: Fixed value: how byte-level vocabularies split a text before merging.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
END_ID = 1
_ENCODERS: dict = {}


def encoder(path: str) -> Callable[[str], list[int]]:
    """Text to ids as the tokenizers library gives them for a ``tokenizer.json`` without adding special tokens, kept per
    worker. A byte-level BPE without normaliser runs in tiktoken's engine, several times as fast, added tokens of the file
    included; any other file runs in the library itself."""
    if path not in _ENCODERS:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        _ENCODERS[path] = _fast(spec) or _library(path)
    return _ENCODERS[path]


def _library(path: str) -> Callable[[str], list[int]]:
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    return lambda text: own.encode(text, add_special_tokens=False).ids


def _fast(spec: dict) -> Callable[[str], list[int]] | None:
    """The file's vocabulary in tiktoken's engine, or None where the file asks for something that it can't do."""
    import tiktoken

    added, split, model = spec.get("added_tokens") or [], spec.get("pre_tokenizer") or {}, spec["model"]
    plain = model.get("type") == "BPE" and not any(model.get(x) for x in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    bytewise = split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True)
    simple = not any(t.get(x) for t in added for x in ("single_word", "lstrip", "rstrip"))
    if spec.get("normalizer") or not (plain and bytewise and simple):
        return None
    special = {t["content"]: t["id"] for t in added}
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    letter = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    ranks = {bytes(letter[c] for c in piece): i for piece, i in model["vocab"].items() if piece not in special}
    own = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=special)
    if not special:
        return own.encode_ordinary
    holds = re.compile("|".join(map(re.escape, special))).search
    return lambda text: own.encode(text, allowed_special="all") if holds(text) else own.encode_ordinary(text)


class Window:
    __slots__ = ("fill", "pieces")

    def __init__(self):
        self.fill, self.pieces = 0, deque()


class Packer:
    """Places pieces (doc, start, ids, doc_tokens) into windows of ``size``; finished windows come from ``done``."""

    def __init__(self, size: int, max_open: int):
        self.size, self.max_open = size, max_open
        self.count = np.zeros(size + 1, dtype=np.int64)  # open windows by level; 0 and size stay 0
        self.at: dict[int, list[Window]] = defaultdict(list)
        self.open, self.done = 0, []

    def level_for(self, n: int) -> int:
        """The level, 0 for a new window, whose choice for a piece of n ids adds least to the sum of squares; the
        fuller level on ties."""
        count, top = self.count, self.size - n
        # moving a window from h to h + n adds 2 * (count[h + n] - count[h]) + 2; an end that isn't open adds 1 less
        change = 2 * (count[n : n + top + 1] - count[: top + 1]) + 2
        change[0] -= 1
        change[top] -= 1
        change[1:][count[1 : top + 1] == 0] = np.iinfo(np.int64).max
        return top - int(np.argmin(change[::-1]))

    def add(self, doc, ids: np.ndarray) -> None:
        n, size = len(ids), self.size
        whole = n - n % size
        for i in range(0, whole, size):
            self.done.append([(doc, i, ids[i : i + size], n)])
        if whole == n:
            return
        rest, level = ids[whole:], self.level_for(n - whole)
        window = self._take(level) if level else Window()
        window.pieces.append((doc, whole, rest, n))
        window.fill += len(rest)
        if window.fill == size:
            self.done.append(window.pieces)
            return
        self._put(window)
        while self.open > self.max_open:
            self._complete_fullest()

    def _put(self, window: Window) -> None:
        self.at[window.fill].append(window)
        self.count[window.fill] += 1
        self.open += 1

    def _take(self, level: int) -> Window:
        self.count[level] -= 1
        self.open -= 1
        return self.at[level].pop()

    def _complete_fullest(self) -> None:
        """Fill the fullest window from the emptiest ones and hand it out; only the last piece moved is cut."""
        window = self._take(int(np.flatnonzero(self.count)[-1]))
        while window.fill < self.size and self.open:
            source = self._take(int(np.flatnonzero(self.count)[0]))
            while source.pieces and window.fill < self.size:
                doc, start, ids, n = source.pieces.popleft()
                part = ids[: self.size - window.fill]
                if len(part) < len(ids):
                    source.pieces.appendleft((doc, start + len(part), ids[len(part) :], n))
                window.pieces.append((doc, start, part, n))
                window.fill, source.fill = window.fill + len(part), source.fill - len(part)
            if source.pieces:
                self._put(source)
        if window.fill < self.size:  # the last one: nothing is left to fill it with
            self._cut(window)
        else:
            self.done.append(window.pieces)

    def _cut(self, window: Window) -> None:
        """Hand a window out in sequences whose lengths are powers of two, longest first."""
        left, pieces = window.fill, window.pieces
        while left:
            room, out = 1 << (left.bit_length() - 1), []
            left -= room
            while room:
                doc, start, ids, n = pieces.popleft()
                part = ids[:room]
                if len(part) < len(ids):
                    pieces.appendleft((doc, start + len(part), ids[len(part) :], n))
                out.append((doc, start, part, n))
                room -= len(part)
            self.done.append(out)

    def finish(self) -> None:
        """Complete whatever is open."""
        while self.open:
            self._complete_fullest()


def pack(
    docs: DataFrame,
    tokenizer: str,
    *,
    text: str = "text",
    doc_id: str = "doc_id",
    size: int = 2048,
    max_open: int = 512,
    with_ids: bool = True,
) -> DataFrame:
    """Tokenise whole texts, end each with id 1 and pack them into sequences of at most ``size`` ids.

    A row per piece: the id, start (the document's ids before the piece), length, ids_crc32 (of its ids as
    little-endian unsigned 32-bit), doc_tokens, sequence_id, offset (in the sequence, gapless from 0) and, with
    ``with_ids``, ids. Sequences hold ``size`` ids or a power of two of them, so none needs padding. Each partition
    packs on its own, in its own row order, with at most ``max_open`` open windows in memory, whatever its size; sequence
    ids hold the partition's number. ``size`` is at least 2. A text is tokenised whole and at once: a very long one takes memory in proportion to
    its length, and leaves in whole windows. A null or empty text is the end id alone. Of equally good levels the fuller
    one wins. Ids may be null or repeat: each row is packed. An empty table gives an empty result; other columns are ignored.
    """
    id_field = docs.schema[doc_id]
    fields = [StructField(doc_id, id_field.dataType)]
    fields += [StructField(n, LongType()) for n in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]
    fields += [StructField("ids", ArrayType(IntegerType()))] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, packer, made = encoder(tokenizer), Packer(size, max_open), TaskContext.get().partitionId() << 40
        rows: list[tuple] = []
        schema = None

        def emit() -> pa.RecordBatch:
            cols = list(zip(*rows)) or [()] * len(fields)
            kinds = [schema.field(0).type, *[pa.int64()] * 6, *[pa.list_(pa.int32())] * with_ids]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=[f.name for f in fields])

        def take() -> None:
            nonlocal made
            for pieces in packer.done:
                offset = 0
                for doc, start, ids, n in pieces:
                    own = (ids.view(np.int32),) if with_ids else ()
                    rows.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), n, made, offset, *own))
                    offset += len(ids)
                made += 1
            packer.done.clear()

        for batch in batches:
            schema = batch.schema
            for keys, texts in zip(slices(batch.column(0)), slices(batch.column(1))):
                for key, t in zip(keys, texts):
                    ids = list(enc(t)) if t else []
                    ids.append(END_ID)
                    packer.add(key, np.array(ids, dtype="<u4"))
                take()
                if len(rows) >= 2_000:
                    yield emit()
                    rows.clear()
        if schema is not None:
            packer.finish()
            take()
            if rows:
                yield emit()

    return docs.select(F.col(doc_id), F.col(text)).mapInArrow(run, StructType(fields))

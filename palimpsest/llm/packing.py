"""Packing of tokenised documents into training sequences: bounded-space online best fit.

Each document is its token ids followed by an end id. Full windows of ``size`` ids are cut off as they are; the rest is
placed in the open window of its partition where it fits best (least room left). A partition keeps ``open_windows`` windows.
When the rest fits in none and all are open, the fullest is emitted: its room is filled with the head of the rest, so that it
ends full, and what remains is placed anew. At the end of the partition the leftover windows are merged, one into another,
into full windows; the last, partly filled one is cut at powers of two, so no sequence needs padding except to its own
length, a power of two.

Scale. One pass over the texts, no shuffle: a partition holds ``open_windows`` windows and one batch of texts at a time.
Sequence ids are (partition number << 32) + running number, so a lost task gives the same ids again.

Token ids are those of the tokenizers library for the given vocabulary. With a rank file of the same vocabulary the faster
tiktoken gives them; texts for which the two differ, or on which tiktoken fails (``unsure``), go through tokenizers.

Defined results. Null or empty text: the end id alone. Repeated rows are packed each. Very long texts are tokenised whole.
Null ids are carried. Other columns of the input are not carried. No rows: no pieces.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from palimpsest.llm import core

SIZE = 1024
OPEN_WINDOWS = 64
PIECES = "start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"


class Packer:
    """One partition's windows. ``add`` and ``finish`` return closed windows: lists of pieces (document, start, ids)."""

    def __init__(self, size: int = SIZE, open_windows: int = OPEN_WINDOWS):
        self.size, self.limit = size, open_windows
        self.room: list[tuple[int, int]] = []  # (room left, window), sorted
        self.windows: dict[int, list] = {}
        self.made = 0

    def add(self, doc: int, ids: np.ndarray) -> Iterator[list]:
        size, start = self.size, 0
        whole = len(ids) // size * size
        for start in range(0, whole, size):
            yield [(doc, start, ids[start : start + size])]
        start = whole
        while start < len(ids):
            need = len(ids) - start
            k = bisect.bisect_left(self.room, (need, -1))
            if k < len(self.room):
                room, w = self.room.pop(k)
                self.windows[w].append((doc, start, ids[start:]))
                if room == need:
                    yield self.windows.pop(w)
                else:
                    bisect.insort(self.room, (room - need, w))
                return
            if len(self.room) < self.limit:
                self.windows[self.made] = [(doc, start, ids[start:])]
                bisect.insort(self.room, (size - need, self.made))
                self.made += 1
                return
            room, w = self.room.pop(0)  # the fullest
            self.windows[w].append((doc, start, ids[start : start + room]))
            yield self.windows.pop(w)
            start += room

    def finish(self) -> Iterator[list]:
        """Merge the leftover windows; cut the last one at powers of two."""
        now, filled = [], 0
        for _, w in self.room:
            for doc, start, ids in self.windows[w]:
                while len(ids):
                    take = ids[: self.size - filled]
                    now.append((doc, start, take))
                    start, ids, filled = start + len(take), ids[len(take) :], filled + len(take)
                    if filled == self.size:
                        yield now
                        now, filled = [], 0
        self.room, self.windows = [], {}
        while filled:
            part, want = [], 1 << (filled.bit_length() - 1)
            filled -= want
            while want:
                doc, start, ids = now.pop(0)
                part.append((doc, start, ids[:want]))
                if len(ids) > want:
                    now.insert(0, (doc, start + want, ids[want:]))
                want -= len(part[-1][2])
            yield part


def encoder(vocabulary: str, ranks: str | None = None, pattern: str | None = None) -> Callable[[list[str]], list]:
    """A function from texts to lists of ids."""
    import functools
    import json
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"

    @functools.cache
    def exact():
        from tokenizers import Tokenizer

        return Tokenizer.from_file(vocabulary)

    if ranks is None:
        return lambda texts: [e.ids for e in exact().encode_batch(texts, add_special_tokens=False)]
    import base64

    import tiktoken

    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=table, special_tokens={})
    with open(vocabulary, encoding="utf-8") as f:
        special = [t["content"] for t in json.load(f).get("added_tokens") or ()]

    def encode(texts: list[str]) -> list:
        return [exact().encode(x, add_special_tokens=False).ids if unsure(x, special) else fast.encode_ordinary(x) for x in texts]

    return encode


#: tiktoken's pattern looks back over a run of blanks and gives up, with a panic, on very long ones.
_LONG_BLANK = re.compile(r"\s{2000}")


def unsure(text: str, special: list[str]) -> bool:
    """Whether the two libraries differ: on texts with the string of a special token, or with a very long run of blanks."""
    return any(s in text for s in special) or _LONG_BLANK.search(text) is not None


def pack(docs: DataFrame, vocabulary: str, ranks: str | None = None, pattern: str | None = None, end_id: int = 0, size: int = SIZE, open_windows: int = OPEN_WINDOWS) -> DataFrame:
    """Pieces of the documents (doc_id, text): doc_id, start, length, ids (little-endian uint32), doc_tokens, sequence_id, offset."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = encoder(vocabulary, ranks, pattern)
        packer, serial = Packer(size, open_windows), (TaskContext.get().partitionId() << 32) - 1
        ids_of: dict[int, tuple] = {}  # open documents: id, number of tokens
        cols: list[list] = [[] for _ in range(7)]
        held = 0

        def put(window: list) -> None:
            nonlocal serial, held
            serial += 1
            offset = 0
            for doc, start, ids in window:
                key, total = ids_of[doc]
                for col, x in zip(cols, (key, start, len(ids), ids.tobytes(), total, serial, offset), strict=True):
                    col.append(x)
                offset += len(ids)
            held += offset

        def out() -> pa.RecordBatch:
            nonlocal cols, held
            kinds = (doc_type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])
            cols, held = [[] for _ in range(7)], 0
            return batch

        number, doc_type = 0, pa.int64()
        for batch in batches:
            doc_type = batch.column("doc_id").type
            keys, texts = batch.column("doc_id").to_pylist(), batch.column("text")
            for lo in range(0, batch.num_rows, 64):
                for key, ids in zip(keys[lo : lo + 64], encode([x or "" for x in texts.slice(lo, 64).to_pylist()]), strict=True):
                    arr = np.empty(len(ids) + 1, "<u4")
                    arr[:-1] = ids
                    arr[-1] = end_id
                    ids_of[number] = (key, len(arr))
                    for window in packer.add(number, arr):
                        put(window)
                    number += 1
                if held > 2_000_000:
                    yield out()
                    still = {p[0] for w in packer.windows.values() for p in w}
                    ids_of = {k: v for k, v in ids_of.items() if k in still}
        for window in packer.finish():
            put(window)
        if cols[0]:
            yield out()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return core.bounded_batches(docs).select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {PIECES}")

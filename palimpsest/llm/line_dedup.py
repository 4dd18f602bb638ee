"""Line deduplication by overlapping windows of consecutive lines.

The lines of a text are its \\n-split parts that hold a word; blank lines belong to no window and stay. A window is
``width`` (three) consecutive such lines, compared by two independent 64-bit hashes of their bytes. The first occurrence of a window in the
corpus, by doc_id (null last) and place, stays; every line that a later one covers goes, overlapping windows merged. An equal
line stays at an earlier place. Ids that are no integers are put in the order of their 64-bit hashes.

Scale. Within a block of a partition all but the first occurrence of a window are settled at once and the first alone is
posted, with a flag, so that a line held by a third of all documents costs one row a block. Text moves once, by document.

Defined results. Empty table: no rows. Null text: stays null, no lines. Empty text: stays empty. Very long texts are worked on
whole. Fewer lines than ``width``: nothing goes. Repeated rows (same id and
text) count as one document and keep the same lines. Rows with equal ids and other texts: ties are broken by a hash. Columns
of the input stay; ``n_lines`` (lines with a word) and ``n_removed`` are added, or replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm import core

BLOCK = 2_000_000
LAST = np.iinfo(np.int64).max
POSTED = "h bigint, h2 bigint, ord bigint, key bigint, p int, sure array<int>"


def _worded(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Flags of the lines that hold a byte of a word."""
    total = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(core.IS_WORD[buf], out=total[1:])
    return total[ends] > total[starts]


def _post(block: core.Block) -> Iterator[pa.RecordBatch]:
    if not block.rows:
        return
    h, h2, ords, key, p = block.take()
    order = np.lexsort((p, key, ords, h2, h))
    h, h2, ords, key, p = h[order], h2[order], ords[order], key[order], p[order]
    first = np.append(True, (h[1:] != h[:-1]) | (h2[1:] != h2[:-1]))
    # the same row met again counts as the same place
    at = np.flatnonzero(first)
    run = np.cumsum(first) - 1
    same = (key == key[at][run]) & (p == p[at][run])
    later = ~same
    for a in range(0, len(at), 100_000):
        i = at[a : a + 100_000]
        yield core.batch_of(h=pa.array(core.i64(h[i])), h2=pa.array(core.i64(h2[i])), ord=pa.array(ords[i]), key=pa.array(key[i]), p=pa.array(p[i].astype(np.int32)), sure=pa.nulls(len(i), pa.list_(pa.int32())))
    if later.any():
        key, p = key[later], p[later]
        order = np.lexsort((p, key))
        key, p = key[order], p[order]
        new = np.append(True, (key[1:] != key[:-1]) | (p[1:] != p[:-1]))
        key, p = key[new], p[new]
        at = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        n = np.diff(np.append(at, len(key)))
        for a in range(0, len(at), 2000):
            lo, m = at[a], n[a : a + 2000]
            k = key[at[a : a + 2000]]
            yield core.batch_of(h=pa.array(core.i64(core.mix(k.view(np.uint64) ^ np.uint64(0x5BD1E995)))), h2=pa.array(np.zeros(len(k), np.int64)), ord=pa.array(np.full(len(k), LAST)), key=pa.array(k), p=pa.array(np.full(len(k), -2, np.int32)), sure=core.list_array(p[lo : lo + m.sum()].astype(np.int32), m, pa.int32()))


def _second(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each span that has nothing in common with ``core.hash_spans``."""
    import xxhash

    data = buf.tobytes()
    return np.fromiter((xxhash.xxh3_64_intdigest(data[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)), np.uint64, len(starts))


def _windows(width: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = core.Block(5, BLOCK)
        for batch in batches:
            keys = batch.column("key").to_numpy(zero_copy_only=False)
            ords = batch.column("ord").to_numpy(zero_copy_only=False)
            for lo, hi, buf, offs in core.chunks(batch.column("text")):
                s, e, n = core.line_spans(buf, offs)
                on = _worded(buf, s, e)
                total = np.append(0, np.cumsum(on))
                at = total[np.append(0, np.cumsum(n))]
                g = core.windows(core.hash_spans(buf, s[on], e[on]), width)
                g2 = core.windows(_second(buf, s[on], e[on]), width)
                n = np.maximum(np.diff(at) - width + 1, 0)
                idx, p = core.ranges(at[:-1], n), core.ranges(np.zeros(len(n), np.int64), n)
                if block.add(g[idx], g2[idx], np.repeat(ords[lo:hi], n), np.repeat(keys[lo:hi], n), p):
                    yield from _post(block)
        yield from _post(block)

    return run


def _cover(n: int, at: np.ndarray, places: pa.ListArray, width: int) -> np.ndarray:
    m = places.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    first = places.flatten().to_numpy(zero_copy_only=False).astype(np.int64) + np.repeat(at[:-1], m)
    mark = np.zeros(n + 1, np.int64)
    np.add.at(mark, first, 1)
    np.add.at(mark, first + width, -1)
    return np.cumsum(mark[:-1]) > 0


def _rewrite(width: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            later = batch.column("later").fill_null([])
            texts, lines, gone = [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for lo, hi, buf, offs in core.chunks(batch.column("text")):
                s, e, n = core.line_spans(buf, offs)
                on = _worded(buf, s, e)
                rows = np.append(0, np.cumsum(n))
                at = np.append(0, np.cumsum(on))[rows]
                out = np.zeros(len(s), bool)
                out[on] = _cover(int(on.sum()), at, later.slice(lo, hi - lo), width)
                total = np.append(0, np.cumsum(out))
                g = total[rows[1:]] - total[rows[:-1]]
                texts.append(core.join_spans(buf, s[~out], e[~out], n - g, 0x0A))
                lines.append(np.diff(at))
                gone.append(g)
            text = core.concat_strings(texts)
            old = batch.column("text")
            if old.null_count:
                text = pa.compute.if_else(old.is_valid(), text, pa.scalar(None, pa.string()))
            yield core.batch_of(row=batch.column("row"), text=text, n_lines=pa.array(np.concatenate(lines)), n_removed=pa.array(np.concatenate(gone)))

    return run


def dedup_lines(docs: DataFrame, width: int = 3, counts: bool = True) -> DataFrame:
    """The documents without later occurrences of windows of ``width`` lines; see the module for odd cases.

    Without ``counts`` no column is added or replaced.
    """
    added = ("n_lines", "n_removed") if counts else ()
    keyed = core.wrap(docs, *added)
    number = F.col("doc_id").cast("bigint") if isinstance(docs.schema["doc_id"].dataType, T.IntegralType) else F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id"))
    slim = core.bounded_batches(docs).select(core.text_key().alias("key"), F.coalesce(number, F.lit(int(LAST))).alias("ord"), "text")
    posted = slim.mapInArrow(_windows(width), POSTED)
    group = Window.partitionBy("h", "h2")
    place = F.struct("ord", "key", "p")
    judged = posted.withColumn("first", F.min(place).over(group)).withColumn("is_first", place == F.col("first"))
    later = F.concat(F.collect_set(F.expr("case when sure is null and not is_first then p end")), F.flatten(F.collect_list("sure"))).alias("later")
    found = judged.where("sure is not null or not is_first").groupBy("key").agg(later)
    rows = keyed.join(found, "key", "left").select("row", "text", "later")
    done = rows.mapInArrow(_rewrite(width), core.out_schema(rows, "row", "text", n_lines="bigint", n_removed="bigint"))
    return core.unwrap(done, docs, *added)

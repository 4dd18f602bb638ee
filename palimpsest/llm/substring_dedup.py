"""Removal of long word sequences that occur more than once, by difference-cover anchors.

A window is ``window`` consecutive words. Every word covered by a window whose word sequence also starts anywhere else (in
another document or the same one) is removed; windows are judged on the input.

Method. D is a difference cover modulo v: for any two positions i, j some shift below v brings both onto positions whose
residue is in D. Only anchors there are posted: hashes of window - v + 1 words at |D| of each v positions (5 of 21). Equal
windows share at least one aligned, equal anchor, so windows without a repeated anchor are unique and drop out. The others
are extended: the full window's hash is posted and counted. Words of a kept window hash decide; 64-bit hashes of whole word
sequences stand for the sequences.

Scale. What a partition posts is combined first: a hash found twice in a block of postings is settled there and posted
once, so a passage held by a third of all documents costs one row a block, and no group is larger than the number of
blocks. Text moves once, by document.

Defined results. Null text: as empty. No word: nothing removed, text ''. Fewer words than the window: nothing removed. A
row that is repeated (same id, same text) counts as another document: both lose all words if they have enough. Null ids are
allowed. Very long texts are worked on in slices of words; nothing is cut off. Columns of the input stay; ``text`` becomes
the kept words joined by one space; ``n_words`` and ``n_removed`` are added, or replaced if the input has such names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm import core

#: Perfect difference covers by period.
COVERS = {3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (3, 6, 7, 12, 14)}
BLOCK = 2_000_000
POSTED = "h bigint, key bigint, p int, sure array<int>"


def _post(block: core.Block) -> Iterator[pa.RecordBatch]:
    """Postings of one block: hashes seen once as they are; those seen more often once without a place, and as sure places."""
    if not block.rows:
        return
    h, key, p = block.take()
    multi = core.shared(h)
    one = ~multi
    once = np.unique(h[multi])
    hs = np.concatenate([h[one], once])
    keys = np.concatenate([key[one], np.zeros(len(once), np.int64)])
    ps = np.concatenate([p[one], np.full(len(once), -1)]).astype(np.int32)
    for a in range(0, len(hs), 100_000):
        b = min(a + 100_000, len(hs))
        yield pa.RecordBatch.from_arrays([pa.array(core.i64(hs[a:b].copy())), pa.array(keys[a:b]), pa.array(ps[a:b]), pa.nulls(b - a, pa.list_(pa.int32()))], names=["h", "key", "p", "sure"])
    if multi.any():
        key, p = key[multi], p[multi]
        order = np.lexsort((p, key))
        key, p = key[order], p[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (p[1:] != p[:-1])
        key, p = key[new], p[new]
        at = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        n = np.diff(np.append(at, len(key)))
        for a in range(0, len(at), 2000):
            lo, m = at[a], n[a : a + 2000]
            k = key[lo : lo + m.sum()][np.cumsum(m) - m]
            # spread by a hash of their own: these rows only travel
            yield pa.RecordBatch.from_arrays([pa.array(core.i64(core.mix(k.view(np.uint64) ^ np.uint64(0x5bd1e995)))), pa.array(k), pa.array(np.full(len(k), -2, np.int32)), core.list_array(p[lo : lo + m.sum()].astype(np.int32), m, pa.int32())], names=["h", "key", "p", "sure"])


def _anchors(window: int, period: int) -> Callable:
    cover = np.zeros(period, bool)
    cover[list(COVERS[period])] = True
    width = window - period + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = core.Block(3, BLOCK)
        for batch in batches:
            keys = batch.column("key").to_numpy(zero_copy_only=False)
            for lo, hi, buf, offs in core.chunks(batch.column("text")):
                s, e = core.runs(buf, offs, core.IS_WORD)
                g = core.windows(core.hash_spans(buf, s, e), width)
                at = core.row_spans(s, offs)
                n = np.diff(at)
                n = np.where(n >= window, n - width + 1, 0)
                idx, p = core.ranges(at[:-1], n), core.ranges(np.zeros(len(n), np.int64), n)
                key = np.repeat(keys[lo:hi], n)
                on = cover[p % period]
                if block.add(g[idx[on]], key[on], p[on]):
                    yield from _post(block)
        yield from _post(block)

    return run


def _extended(window: int, period: int) -> Callable:
    """Full windows at the places that hold a repeated anchor."""
    width = window - period + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = core.Block(3, BLOCK)
        for batch in batches:
            batch = batch.filter(batch.column("hits").is_valid())
            keys = batch.column("key").to_numpy(zero_copy_only=False)
            hits = batch.column("hits")
            for lo, hi, buf, offs in core.chunks(batch.column("text")):
                s, e = core.runs(buf, offs, core.IS_WORD)
                g = core.windows(core.hash_spans(buf, s, e), window)
                at = core.row_spans(s, offs)
                own = hits.slice(lo, hi - lo)
                places = own.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                m = own.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                mark = np.zeros(len(s) + period + 1, np.int64)
                np.add.at(mark, places + np.repeat(at[:-1], m) + 1, 1)
                mark = np.cumsum(mark)
                n = np.maximum(np.diff(at) - window + 1, 0)
                idx, p = core.ranges(at[:-1], n), core.ranges(np.zeros(len(n), np.int64), n)
                on = mark[idx + period] > mark[idx]
                if block.add(g[idx[on]], np.repeat(keys[lo:hi], n)[on], p[on]):
                    yield from _post(block)
        yield from _post(block)

    return run


def _rewrite(window: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = batch.column("hits").fill_null([])
            texts, words, gone = [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for lo, hi, buf, offs in core.chunks(batch.column("text")):
                s, e = core.runs(buf, offs, core.IS_WORD)
                at = core.row_spans(s, offs)
                own = hits.slice(lo, hi - lo)
                places = own.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                m = own.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                mark = np.zeros(len(s) + 1, np.int64)
                first = places + np.repeat(at[:-1], m)
                np.add.at(mark, first, 1)
                np.add.at(mark, first + window, -1)
                keep = np.cumsum(mark[:-1]) == 0
                total = np.append(0, np.cumsum(keep))
                counts = total[at[1:]] - total[at[:-1]]
                texts.append(core.join_spans(buf, s[keep], e[keep], counts, 0x20))
                words.append(np.diff(at))
                gone.append(np.diff(at) - counts)
            yield core.batch_of(row=batch.column("row"), text=core.concat_strings(texts), n_words=pa.array(np.concatenate(words)), n_removed=pa.array(np.concatenate(gone)))

    return run


def _repeated(posted: DataFrame) -> DataFrame:
    """(key, hits): the places whose hash was posted at least twice, and the sure ones. A hash has one row a block at most."""
    counted = posted.withColumn("n", F.count("*").over(Window.partitionBy("h")))
    return counted.where("sure is not null or p >= 0 and n > 1").groupBy("key").agg(
        F.concat(F.collect_set(F.when(F.col("p") >= 0, F.col("p"))), F.flatten(F.collect_list("sure"))).alias("hits"))


def remove_repeats(docs: DataFrame, window: int = 35, period: int = 21) -> DataFrame:
    """The documents without words in repeated windows; see the module for the results in odd cases."""
    if window <= period:
        raise ValueError("the window must be longer than the period")
    keyed = core.wrap(docs, "n_words", "n_removed")
    anchors = _repeated(keyed.select("key", "text").mapInArrow(_anchors(window, period), POSTED))
    # the same columns as below, so that both joins read one exchange of the texts
    near = keyed.join(anchors, "key", "left").select("row", "key", "text", "hits")
    full = _repeated(near.mapInArrow(_extended(window, period), POSTED))
    found = keyed.join(full, "key", "left").select("row", "text", "hits")
    done = found.mapInArrow(_rewrite(window), core.out_schema(found, "row", "text", n_words="bigint", n_removed="bigint"))
    return core.unwrap(done, docs, "n_words", "n_removed")

"""Benchmark decontamination by templates: passages that match a benchmark item up to numbers, names and units.

Canonical form. Tokens are runs of letters, digits and non-ASCII bytes (a point or comma between digits belongs to the
number; a letter after a digit begins a new token), lower-cased in ASCII and Latin-1. A token that begins with a digit
becomes <num>; one in ``UNITS`` that follows a number becomes <unit>; a token with a capital and then a small letter that
does not begin a sentence or line becomes <name>. Everything else stands for itself.

Match. A template window is ``window`` consecutive canonical tokens of which at least half are no placeholders (an item
shorter than a window is one window as a whole, if it has at least ``MIN_TOKENS`` tokens). Windows of documents are
hash-joined with those of the items. Windows of items with fewer words, and items below ``MIN_TOKENS`` as a whole, are joined
with all windows of documents by the tokens themselves, placeholders not put in; their matches form runs of their own, in
which only equal tokens agree. So an item of one token is held by every document with that token. Matches of one item at one
alignment (document place minus item place) and at most three windows apart form a run. In a run slots must be consistent:
the same value in the item must stand for the same value in the document, and the other way round, for each kind; other
runs do not count. A document holds an item if the tokens that agree in its runs make up at least ``percent`` of the item's,
or ``enough``.

Scale. One pass over the texts, whatever the size of the benchmark. The items' window hashes are a table; a bit table of
fixed size (``TABLE_BITS``), made of them by a native aggregate, goes to the executors, and only documents with a window
whose bit is set leave that pass, as tokens. Their windows are joined with the items' by hash (Catalyst broadcasts the items
by size, or splits skewed hashes), matches are grouped by document and item, and runs are settled there, on tokens. A larger
benchmark sets more bits, so more windows take part in the join; the results are the same. Windows that several items share
are joined with each. ``keep_clean`` writes what the pass makes once; only documents with a set bit meet the list of leaks.

Defined results. Null or empty texts, on either side, match nothing. Repeated items or documents match each. Null ids are
carried. Very long texts are worked on whole. Empty tables: no leaks, nothing dropped. Other columns stay, or are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm import core

TABLE_BITS = 27
MIN_TOKENS = 6
#: Unit words.
UNITS = (
    "mm", "cm", "m", "km", "inch", "inches", "foot", "feet", "ft", "yard", "yards", "mile", "miles", "mg", "g", "kg", "gram", "grams", "ton", "tons", "tonnes", "pound", "pounds",
    "lb", "lbs", "ounce", "ounces", "oz", "ml", "l", "liter", "liters", "litre", "litres", "gallon", "gallons", "second", "seconds", "s", "minute", "minutes", "min", "hour", "hours",
    "h", "day", "days", "week", "weeks", "month", "months", "year", "years", "percent", "dollar", "dollars", "cent", "cents", "euro", "euros", "degree", "degrees", "watt", "watts",
)
WORD, NUM, UNIT, NAME = 0, 1, 2, 3
_TOKEN = np.zeros(256, bool)
_TOKEN[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_PLACE = core.mix(np.arange(1, 4, dtype=np.uint64))
_UNITS = np.sort(np.concatenate([core.hash_spans(np.frombuffer(u.encode(), np.uint8), np.zeros(1, np.int64), np.array([len(u)])) for u in UNITS]))


class Tokens:
    """Canonical tokens of a chunk: place of each row's first (``at``), kind, value hash, and the template's hash."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray):
        flag = _TOKEN[buf]
        digit = _DIGIT[buf]
        if len(buf) > 2:
            inner = ((buf[1:-1] == 0x2E) | (buf[1:-1] == 0x2C)) & digit[:-2] & digit[2:]
            inner[np.isin(np.arange(1, len(buf) - 1), offs)] = False
            flag[1:-1] |= inner
        s, e = core.edges(flag, offs)
        # a letter right after a digit begins a new token
        brk = np.flatnonzero(flag[1:] & ~digit[1:] & (buf[1:] != 0x2E) & (buf[1:] != 0x2C) & digit[:-1]) + 1
        brk = brk[~np.isin(brk, s)]
        s, e = np.sort(np.concatenate((s, brk))), np.sort(np.concatenate((e, brk)))
        self.at = core.row_spans(s, offs)
        latin = np.zeros(len(buf), bool)
        latin[1:] = (buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E) & (buf[1:] != 0x97)
        low = core.LOWER[buf] + np.where(latin, np.uint8(32), np.uint8(0))
        self.value = core.hash_spans(low, s, e)
        n = len(s)
        kind = np.zeros(n, np.int8)
        if n:
            kind[digit[s]] = NUM
            # nothing but commas, blanks and the like between a token and the one before it: the sentence goes on
            ends = np.append(0, np.cumsum(np.isin(buf, np.frombuffer(b".!?:\n\r|\"", np.uint8))))
            goes_on = np.append(False, ends[s[1:]] == ends[e[:-1]])
            goes_on[self.at[:-1][self.at[:-1] < n]] = False
            # a capital and a small letter: words all in capitals are no names
            accent = latin[np.minimum(s + 1, len(buf) - 1)] & (buf[s] == 0xC3)
            after = np.minimum(np.where(accent, s + 2, s + 1), len(buf) - 1)
            small = (after < e) & ((buf[after] >= 97) & (buf[after] <= 122) | (buf[after] >= 0x80) & ~latin[np.minimum(after + 1, len(buf) - 1)])
            cap = ((buf[s] >= 65) & (buf[s] <= 90)) | accent
            kind[cap & small & goes_on & (kind == WORD)] = NAME
            known = _UNITS[np.minimum(np.searchsorted(_UNITS, self.value), len(_UNITS) - 1)] == self.value
            kind[np.append(False, kind[:-1] == NUM) & known & goes_on] = UNIT
        self.kind = kind
        self.template = self.value.copy()
        for k in (NUM, UNIT, NAME):
            self.template[kind == k] = _PLACE[k - 1]

    def worded(self, idx: np.ndarray, width: int) -> np.ndarray:
        """Flags of the windows at these places that have enough words of their own."""
        plain = np.append(0, np.cumsum(self.kind == WORD))
        return 2 * (plain[idx + width] - plain[idx]) >= width

    def windows(self, width: int, exact: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, place of the first token, and hash of each window: templates with enough words, or tokens themselves, of all."""
        n = np.maximum(np.diff(self.at) - width + 1, 0)
        idx = core.ranges(self.at[:-1], n)
        row = np.repeat(np.arange(len(n)), n)
        if exact:
            return row, idx, core.windows(self.value, width)[idx]
        ok = self.worded(idx, width)
        return row[ok], idx[ok], core.windows(self.template, width)[idx[ok]]


def _salted(h: np.ndarray, width: int, exact: bool) -> np.ndarray:
    """One key space for windows of all widths and both kinds."""
    return core.mix(h ^ core.mix(np.array([2 * width + exact + 1000], np.uint64))[0])


def _packed(t: Tokens, rows: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Kinds (a byte each) and values (8 bytes each) of the tokens of these rows."""
    n = np.diff(t.at)[rows]
    idx = core.ranges(t.at[:-1][rows], n)
    return _binary(t.kind[idx].astype(np.uint8), n), _binary(t.value[idx], n)


def _binary(flat: np.ndarray, n: np.ndarray) -> pa.Array:
    ends = np.append(0, np.cumsum(n)) * flat.itemsize
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(flat))]).cast(pa.binary())


def _window_list(h: np.ndarray, place: np.ndarray, wide: np.ndarray, exact: np.ndarray, n: np.ndarray) -> pa.Array:
    """A list a row of (h, place, wide, exact)."""
    offs = np.append(0, np.cumsum(n)).astype(np.int32)
    one = pa.StructArray.from_arrays([pa.array(core.i64(h)), pa.array(place.astype(np.int32)), pa.array(wide.astype(np.int32)), pa.array(exact)], names=["h", "place", "wide", "exact"])
    return pa.ListArray.from_arrays(pa.array(offs), one)


WINDOWS = "array<struct<h:bigint,place:int,wide:int,exact:boolean>>"


def _gathered(rows: int, parts: list[tuple]) -> tuple[np.ndarray, ...]:
    """(h, place, wide, exact, number in each row) of window parts (row, h, place, width, exact), ordered by row and place."""
    row = np.concatenate([np.zeros(0, np.int64), *(p[0] for p in parts)])
    h = np.concatenate([np.zeros(0, np.uint64), *(p[1] for p in parts)])
    place = np.concatenate([np.zeros(0, np.int64), *(p[2] for p in parts)])
    wide = np.concatenate([np.zeros(0, np.int64), *(np.full(len(p[0]), p[3]) for p in parts)])
    exact = np.concatenate([np.zeros(0, bool), *(np.full(len(p[0]), p[4]) for p in parts)])
    order = np.lexsort((exact, place, row))
    return h[order], place[order], wide[order], exact[order], np.bincount(row, minlength=rows)


def _item_windows(width: int) -> Callable:
    """(item_id, kinds, values, size, wins) of the items that have windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, offs in core.chunks(batch.column("text")):
                t = Tokens(buf, offs)
                size, parts = np.diff(t.at), []
                for exact in (False, True):
                    for w in sorted({width, *size[(size >= (1 if exact else MIN_TOKENS)) & (size < width)].tolist()}):
                        row, idx, h = t.windows(w, exact)
                        mine = (size[row] == w) if w < width else np.ones(len(row), bool)
                        if exact:
                            mine &= (size[row] < MIN_TOKENS) | ~t.worded(idx, w)
                        parts.append((row[mine], _salted(h[mine], w, exact), (idx - t.at[row])[mine], w, exact))
                kinds, values = _packed(t, np.arange(hi - lo))
                yield core.batch_of(item_id=batch.column("item_id").slice(lo, hi - lo), kinds=kinds, values=values, size=pa.array(size.astype(np.int32)), wins=_window_list(*_gathered(hi - lo, parts)))

    return run


def _scan(table, shapes: list[tuple[int, bool]], keep: bool) -> Callable:
    """Documents with their windows whose bit is set, and tokens: all documents, or those alone that have such windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = table.value
        for batch in batches:
            for lo, hi, buf, offs in core.chunks(batch.column("text")):
                t, parts = Tokens(buf, offs), []
                for w, exact in shapes:
                    row, idx, h = t.windows(w, exact)
                    h = _salted(h, w, exact)
                    at = h >> np.uint64(64 - TABLE_BITS)
                    on = (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) > 0
                    parts.append((row[on], h[on], (idx - t.at[row])[on], w, exact))
                h, place, wide, exact_, n = _gathered(hi - lo, parts)
                own = batch.slice(lo, hi - lo)
                some = np.flatnonzero(n > 0)
                if not keep:
                    if len(some):
                        kinds, values = _packed(t, some)
                        yield core.batch_of(doc_id=own.column("doc_id").take(pa.array(some)), kinds=kinds, values=values, wins=_window_list(h, place, wide, exact_, n[some]))
                    continue
                size = np.where(n > 0, np.diff(t.at), 0)
                idx = core.ranges(t.at[:-1], size)
                yield core.batch_of(row=own.column("row"), text=own.column("text"), kinds=_binary(t.kind[idx].astype(np.uint8), size), values=_binary(t.value[idx], size), wins=_window_list(h, place, wide, exact_, n))

    return run


def _consistent(ik: np.ndarray, iv: np.ndarray, dv: np.ndarray) -> bool:
    """Whether the slots map item values to document values one to one, kind by kind."""
    seen: dict = {}
    back: dict = {}
    for k, a, b in zip(ik.tolist(), iv.tolist(), dv.tolist(), strict=True):
        if seen.setdefault((k, a), b) != b or back.setdefault((k, b), a) != a:
            return False
    return True


def _held(met: np.ndarray, dkinds: np.ndarray, dvalues: np.ndarray, ikinds: np.ndarray, ivalues: np.ndarray, width: int) -> tuple[int, int, bool]:
    """(place, tokens covered, verbatim) of one item in one document, from the matches (exact, place, item place, width)."""
    exact, place, iplace, wide = met
    shift = place - iplace
    order = np.lexsort((place, exact, shift))
    exact, place, wide, shift = exact[order], place[order], wide[order], shift[order]
    # at one alignment an edit breaks some windows, not the run
    new = np.append(True, (shift[1:] != shift[:-1]) | (exact[1:] != exact[:-1]) | (place[1:] - place[:-1] > 3 * width))
    cuts = np.append(np.flatnonzero(new), len(place))
    covered, first, verbatim = np.zeros(len(ikinds), bool), -1, True
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        p, q, d = int(place[a]), int((place[a:b] + wide[a:b]).max()), int(shift[a])
        ik, iv, dk, dv = ikinds[p - d : q - d], ivalues[p - d : q - d], dkinds[p:q], dvalues[p:q]
        same = iv == dv
        if exact[a]:
            agree = same
        else:
            slot = (ik != WORD) & (ik == dk)
            if not _consistent(ik[slot], iv[slot], dv[slot]):
                continue
            agree = slot | (same & (ik == WORD) & (dk == WORD))
        covered[p - d : q - d] |= agree
        first = p if first < 0 else min(first, p)
        verbatim &= bool(same[agree].all())
    return first, int(covered.sum()), verbatim


def _settle(width: int, percent: int, enough: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            met = batch.column("met")
            for i in range(batch.num_rows):
                one = met[i].values
                arrays = [one.field(k).to_numpy(zero_copy_only=False) for k in ("exact", "place", "iplace", "wide")]
                tokens = [np.frombuffer(batch.column(c)[i].as_buffer(), kind) for c, kind in (("kinds", np.uint8), ("values", np.uint64), ("ikinds", np.uint8), ("ivalues", np.uint64))]
                lo = int(batch.column("lo")[i].as_py())
                arrays[1] = arrays[1].astype(np.int64) - lo
                arrays[2], arrays[3] = arrays[2].astype(np.int64), arrays[3].astype(np.int64)
                place, covered, same = _held(tuple(arrays), *tokens, width)
                if covered and (covered >= enough or 100 * covered >= percent * len(tokens[2])):
                    out.append((i, place + lo, covered, len(tokens[2]), same))
            if out:
                at, place, covered, size, same = zip(*out, strict=True)
                yield core.batch_of(rid=batch.column("rid").take(pa.array(at)), doc_id=batch.column("doc_id").take(pa.array(at)), item_id=batch.column("item_id").take(pa.array(at)), place=pa.array(place, pa.int64()), covered=pa.array(covered, pa.int64()), item_tokens=pa.array(size, pa.int64()), verbatim=pa.array(same))

    return run


def _items(benchmark: DataFrame, window: int) -> DataFrame:
    """(item, item_id, kinds, values, size, wins), written, so that ``item`` names a row for good."""
    rows = core.bounded_batches(benchmark).select("item_id", "text").where("text is not null")
    made = rows.mapInArrow(_item_windows(window), core.out_schema(rows, "item_id", kinds="binary", values="binary", size="int", wins=WINDOWS))
    return core.cut(made.where("size(wins) > 0").withColumn("item", F.monotonically_increasing_id()))


def _table(items: DataFrame) -> tuple[np.ndarray, list[tuple[int, bool]]]:
    """The bit table of the items' window hashes, of fixed size, and the shapes of window (at most two a width) that they have."""
    wins = items.select(F.inline("wins"))
    at = F.shiftrightunsigned("h", 64 - TABLE_BITS)
    words = wins.select(F.shiftright(at, 6).alias("word"), F.expr("shiftleft(1L, cast(shiftrightunsigned(h, " + str(64 - TABLE_BITS) + ") & 63 as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    table = np.zeros(1 << (TABLE_BITS - 6), np.uint64)
    table[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return table, sorted((r["wide"], r["exact"]) for r in wins.select("wide", "exact").distinct().collect())


def _leaks(found: DataFrame, items: DataFrame, width: int, percent: int, enough: int) -> DataFrame:
    """(rid, doc_id, item_id, place, covered, item_tokens, verbatim) from documents (rid, doc_id, kinds, values, wins)."""
    posted = found.select("rid", F.inline("wins"))
    wins = items.select("item", F.inline("wins")).withColumnRenamed("place", "iplace").withColumnsRenamed({"wide": "iwide", "exact": "iexact"})
    met = posted.join(wins, "h").where("wide = iwide and exact = iexact").groupBy("rid", "item").agg(F.collect_list(F.struct("exact", "place", "iplace", "wide")).alias("met"))
    lo, hi = F.array_min(F.transform("met", lambda x: x["place"])), F.array_max(F.transform("met", lambda x: x["place"] + x["wide"]))
    sides = met.join(found.select("rid", "doc_id", "kinds", "values"), "rid").join(items.select("item", "item_id", F.col("kinds").alias("ikinds"), F.col("values").alias("ivalues")), "item").withColumns({"lo": lo, "n": hi - lo})
    # only the part of the document that the matches span goes to Python
    rows = sides.select("rid", "doc_id", "item_id", "lo", "met", F.expr("substring(kinds, lo + 1, n)").alias("kinds"), F.expr("substring(values, 8 * lo + 1, 8 * n)").alias("values"), "ikinds", "ivalues")
    return rows.mapInArrow(_settle(width, percent, enough), core.out_schema(rows, "rid", "doc_id", "item_id", place="bigint", covered="bigint", item_tokens="bigint", verbatim="boolean"))


def leaks(docs: DataFrame, benchmark: DataFrame, window: int = 8, percent: int = 50, enough: int = 30) -> DataFrame:
    """(doc_id, item_id, place, covered, item_tokens, verbatim) for each document and item that it holds."""
    items = _items(benchmark, window)
    table, shapes = _table(items)
    slim = core.bounded_batches(docs).select("doc_id", "text")
    scan = _scan(docs.sparkSession.sparkContext.broadcast(table), shapes, False)
    made = slim.mapInArrow(scan, core.out_schema(slim, "doc_id", kinds="binary", values="binary", wins=WINDOWS))
    found = core.cut(made.withColumn("rid", F.monotonically_increasing_id()))
    return _leaks(found, items, window, percent, enough).drop("rid")


def keep_clean(docs: DataFrame, benchmark: DataFrame, window: int = 8, percent: int = 50, enough: int = 30) -> DataFrame:
    """The documents that hold no item, with all their columns."""
    items = _items(benchmark, window)
    table, shapes = _table(items)
    rows = core.wrap(docs)
    scan = _scan(docs.sparkSession.sparkContext.broadcast(table), shapes, True)
    made = rows.mapInArrow(scan, core.out_schema(rows, "row", "text", kinds="binary", values="binary", wins=WINDOWS))
    made = core.cut(made.withColumn("rid", F.monotonically_increasing_id()))
    some = F.size("wins") > 0
    found = made.where(some).select("rid", F.lit(0).alias("doc_id"), "kinds", "values", "wins")
    bad = _leaks(found, items, window, percent, enough).select("rid").distinct()
    clean = made.where(some).select("rid", "row", "text").join(bad, "rid", "left_anti").select("row", "text")
    return core.unwrap(made.where(~some).select("row", "text").unionByName(clean), docs)

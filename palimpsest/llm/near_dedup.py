"""Near-duplicate documents: MinHash signatures, a signature-coordinate inverted join, and links confirmed on full sets.

A document's set is its distinct word shingles (A-Z lower-cased; with fewer words than a shingle the whole sequence is the
one shingle; without words the set is empty and links with nothing). Two documents are linked when
100 * |A n B| >= percent * |A u B|. Components of the links are the groups.

Method.
1. Equal sets collapse to one node, named by a 64-bit fingerprint of the set, so exact copies are never paired.
2. Each node has M minima under M hash functions. It is posted under each (coordinate, value); a value that no other node
   has cannot collide. A link is looked for where at least T of M values agree (T is 4.1 standard deviations below the
   expectation at the threshold: about 3 in 100 000 links just at the threshold are missed, fewer above it).
3. Prefix: with values ordered rarest first, two nodes that agree in T of M share one of their first M - T + 1. Only those
   are posted; the common ones are skipped in the merge and counted by probing the signatures. A node with fewer than T
   values that others have drops out at once.
4. Star rounds: each posting list has a hub; every node is checked exactly against the two hubs that it collides with most.
   Two checks a node, linear however long the list, and groups of copies melt into components.
5. Of the nodes in lists that still hold several components the shingles are counted. Let c be the number of a node's
   shingles that another such node has, n that of all. A link needs at least p / (1 + p) * (n + n') common shingles, at
   most c and c' of them; so a node with c < p n has no link, and of two linked nodes one at least has
   c >= 2 p n / (1 + p). Those are heavy, the others light, and light nodes are not compared with each other: pages of one
   template with a text of their own each, however many, are all light.
6. Such lists are merged in blocks of bounded size, heavy nodes with heavy and light ones, between components only: pairs
   with T agreeing values are checked exactly where they meet, each in one list (first signatures alone, then, for the
   nodes that have a candidate, full sets), and a link that joins two components ends their comparison. So no candidate
   pair is left out unless it cannot be a link or is connected already, and a block gives fewer links than rows.

Scale. Counts and minima are pre-aggregated before shuffles; joins are by key and can be split when skewed; blocks bound
what one task holds. Texts move once, for nodes that have candidates. Intermediate tables are in the shared folder.

Defined results. Empty table: no rows. Very long texts are worked on whole; other columns are not read. Null or blank text: no shingles, a group of its own. Rows with equal sets are one group, repeated rows too.
Null ids: a group's id is its smallest non-null id; kept is then null-safe equality with it.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm import core

M = 48
BLOCK = 1000
STAR_ROUNDS = 2
HUBS = 2
_rng = np.random.Generator(np.random.PCG64(77))
MULTIPLY = _rng.integers(1, 2**64, 256, dtype=np.uint64) | np.uint64(1)
FLIP = _rng.integers(1, 2**64, 256, dtype=np.uint64)


def _agreeing(m: int, percent: int) -> int:
    p = percent / 100
    return max(1, math.floor(m * p - 4.1 * math.sqrt(m * p * (1 - p))))


def shingle_sets(buf: np.ndarray, offs: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes, row after row, and the number of each row."""
    buf = core.LOWER[buf]
    s, e = core.runs(buf, offs, core.IS_WORD)
    h = core.hash_spans(buf, s, e)
    at = core.row_spans(s, offs)
    words = np.diff(at)
    g = core.windows(h, size)
    n = np.maximum(words - size + 1, 0)
    flat = [g[core.ranges(at[:-1], n)]]
    rows = [np.repeat(np.arange(len(n)), n)]
    for k in range(1, size):  # shorter texts: all their words as one
        few = np.flatnonzero(words == k)
        if len(few):
            flat.append(core.windows(h, k)[at[:-1][few]] ^ np.uint64(0xA5A5A5A5A5A5A5A5))
            rows.append(few)
    flat, rows = np.concatenate(flat), np.concatenate(rows)
    order = np.lexsort((flat, rows))
    flat, rows = flat[order], rows[order]
    new = np.ones(len(flat), bool)
    new[1:] = (flat[1:] != flat[:-1]) | (rows[1:] != rows[:-1])
    return flat[new], np.bincount(rows[new], minlength=len(n)).astype(np.int64)


def _signatures(size: int, m: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, counts, sigs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros((0, m), np.int64)]
            for lo, hi, buf, offs in core.chunks(batch.column("text")):
                flat, n = shingle_sets(buf, offs, size)
                some = n > 0
                at = (np.cumsum(n) - n)[some]
                node, sig = np.zeros(hi - lo, np.uint64), np.zeros((hi - lo, m), np.uint64)
                if len(at):
                    with np.errstate(over="ignore"):
                        node[some] = core.mix(np.add.reduceat(core.mix(flat ^ np.uint64(0x51ED270B)), at) + n[some].astype(np.uint64))
                        for k in range(m):
                            sig[some, k] = np.minimum.reduceat((flat ^ FLIP[k]) * MULTIPLY[k], at)
                nodes.append(node.view(np.int64))
                counts.append(n)
                sigs.append(sig.view(np.int64))
            n, sig = np.concatenate(counts), np.concatenate(sigs)
            yield core.batch_of(doc_id=batch.column("doc_id"), key=batch.column("key"), node=pa.array(np.concatenate(nodes), mask=n == 0), n=pa.array(n), sig=core.list_array(sig[n > 0].ravel(), np.where(n > 0, m, 0), pa.int64()))

    return run


def _sets(size: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, offs in core.chunks(batch.column("text")):
                flat, n = shingle_sets(buf, offs, size)
                ends = np.append(0, np.cumsum(n)) * 8
                yield core.batch_of(node=batch.column("node").slice(lo, hi - lo), shingles=pa.LargeBinaryArray.from_buffers(pa.large_binary(), hi - lo, [None, pa.py_buffer(ends), pa.py_buffer(flat)]).cast(pa.binary()))

    return run


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row (node, shingle) for each member of the sets."""
    for batch in batches:
        nodes = batch.column("node").to_numpy()
        for lo in range(0, batch.num_rows, 256):
            sets = [np.frombuffer(x.as_buffer(), np.int64) for x in batch.column("shingles").slice(lo, 256)]
            yield core.batch_of(node=pa.array(np.repeat(nodes[lo : lo + 256], [len(x) for x in sets])), shingle=pa.array(np.concatenate(sets)))


def _heavy(some: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(node, heavy) of the nodes of ``some`` (node, n) that can have a link among themselves; see step 5."""
    held = sets.join(some.select("node"), "node").select("node", "shingles").mapInArrow(_shingles, "node bigint, shingle bigint")
    alone = held.groupBy("shingle").agg(F.count("*").alias("df"), F.min("node").alias("node")).where("df = 1").groupBy("node").agg(F.count("*").alias("u"))
    c = F.col("n") - F.coalesce("u", F.lit(0))
    return some.join(alone, "node", "left").where(100 * c >= percent * F.col("n")).select("node", ((100 + percent) * c >= 2 * percent * F.col("n")).alias("heavy"))


def _confirm(percent: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column("x"), batch.column("y"), strict=True)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate((x, y))
                both.sort()
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                good[i] = 100 * common >= percent * (len(both) - common)
            yield batch.select(["a", "b"]).filter(pa.array(good))

    return run


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    left = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a")
    both = left.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    return core.cut(both.select("a", "b", "x", "y").mapInArrow(_confirm(percent), "a bigint, b bigint"))


def _candidates(c: dict, need: int, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """Row numbers i, [j...] of one block pair: other component, possible sizes, enough agreement, smallest common value here.

    ``c["comp"]`` may change between steps.
    """
    left, right = np.flatnonzero(c["side"] != 2), np.flatnonzero(c["side"] != 1)
    n, sig, comp, tok = c["n"], c["sig"], c["comp"], c["tok"][0]
    itself = len(left) == len(n)  # one block with itself: each pair once
    lower = [t[t < tok] for t in c["toks"]]
    flat, size = np.concatenate([lower[j] for j in right]), np.array([len(lower[j]) for j in right])
    ends = np.cumsum(size)
    for k, i in enumerate(left):
        at = np.arange(k + 1, len(right)) if itself else np.arange(len(right))
        j = right[at]
        ok = (comp[j] != comp[i]) & (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j]))
        at, j = at[ok], j[ok]
        if len(j):
            ok = np.count_nonzero(sig[j] == sig[i], axis=1) >= need
            at, j = at[ok], j[ok]
        if len(j) and len(lower[i]):
            seen = np.append(0, np.cumsum(np.isin(flat, lower[i])))
            j = j[seen[ends[at]] == seen[ends[at] - size[at]]]
        if len(j):
            yield int(i), j


def _links(c: dict, need: int, percent: int) -> list[tuple[int, int]]:
    """Confirmed links of a block pair, one for each two components that it joins."""
    comp, out = c["comp"], []
    for i, j in _candidates(c, need, percent):
        own = c["sets"][i]
        for lo in range(0, len(j), 256):
            part = j[lo : lo + 256]
            part = part[comp[part] != comp[i]]
            if not len(part):
                continue
            sets = [c["sets"][x] for x in part]
            lens = np.array([len(x) for x in sets])
            flat = np.concatenate(sets)
            place = np.minimum(np.searchsorted(own, flat), len(own) - 1)
            common = np.add.reduceat((own[place] == flat).astype(np.int64), np.cumsum(lens) - lens)
            for x in part[100 * common >= percent * (len(own) + lens - common)].tolist():
                if comp[x] != comp[i]:
                    out.append((int(c["node"][i]), int(c["node"][x])))
                    comp[comp == comp[x]] = comp[i]
    return out


def _merge(m: int, need: int, percent: int, confirm: bool) -> Callable:
    """Over rows sorted by block pair ``g``: the rows that have a candidate there, or, with full sets, the confirmed links."""

    def done(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        if rows.num_rows < 2:
            return
        c = {k: rows.column(k).to_numpy().copy() for k in ("tok", "side", "node", "comp", "n")}
        c["sig"] = np.frombuffer(b"".join(rows.column("sig").to_pylist()), np.uint8).reshape(-1, m)
        c["toks"] = [np.array(x, np.int64) for x in rows.column("toks").to_pylist()]
        if confirm:
            c["sets"] = [np.frombuffer(x, np.uint64) for x in rows.column("shingles").to_pylist()]
            found = _links(c, need, percent)
            if found:
                a, b = np.array(found).T
                yield core.batch_of(a=pa.array(np.minimum(a, b)), b=pa.array(np.maximum(a, b)))
            return
        met = np.zeros(rows.num_rows, bool)
        for i, j in _candidates(c, need, percent):
            met[i] = True
            met[j] = True
        if met.any():
            yield from rows.filter(pa.array(met)).combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            g = batch.column("g").to_numpy()
            cuts = [0, *(np.flatnonzero(g[1:] != g[:-1]) + 1).tolist(), len(g)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if held and held[-1].column("g")[0].as_py() != g[lo]:
                    yield from done(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield from done(pa.Table.from_batches(held))

    return run


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, m: int = M) -> DataFrame:
    """(doc_id, key, n_shingles, component_id, group, kept) for each row; ``key`` is ``core.text_key()``, ``group`` any name."""
    need = _agreeing(m, percent)
    slim = core.bounded_batches(docs).select("doc_id", core.text_key().alias("key"), "text")
    signed = core.cut(slim.mapInArrow(_signatures(shingle, m), core.out_schema(slim, "doc_id", "key", node="bigint", n="bigint", sig="array<bigint>")))

    nodes = core.cut(signed.where("n > 0").groupBy("node").agg(F.first("n").alias("n"), F.min("key").alias("key"), F.first("sig").alias("sig")))
    posted = nodes.select("node", F.explode("sig").alias("tok"))
    often = posted.groupBy("tok").agg(F.count("*").alias("df")).where("df > 1")
    prefix = F.expr(f"transform(slice(toks, 1, size(toks) - {need - 1}), x -> x.tok)")
    wanted = posted.join(often, "tok").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("df", "tok"))).alias("toks")).where(F.size("toks") >= need).select("node", prefix.alias("toks"))
    # the low byte of each value is enough to count agreements: more of them by chance only mean more exact checks
    brief = F.expr("unhex(array_join(transform(sig, x -> lpad(hex(x & 255), 2, '0')), ''))")
    cands = core.cut(wanted.join(nodes, "node").select("node", "toks", "n", "key", brief.alias("brief")))

    # merged whatever the sizes: a plan that does not change with the input
    texts = slim.select("key", "text").join(cands.select("key", "node").hint("merge"), "key").select("node", "text")
    sets = core.cut(texts.mapInArrow(_sets(shingle), "node bigint, shingles binary").dropDuplicates(["node"]))
    lists = cands.select("node", F.explode("toks").alias("tok"))

    edges = None
    comps = cands.select("node", F.col("node").alias("comp"))
    for turn in range(STAR_ROUNDS + 1):
        if turn:
            found = core.components(edges).withColumnRenamed("component", "comp")
            comps = core.cut(cands.select("node").join(found, "node", "left").select("node", F.coalesce("comp", "node").alias("comp")))
        members = lists.join(comps, "node")
        mixed = members.groupBy("tok").agg(F.count("*").alias("size"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min_by(F.struct("node", "comp"), F.xxhash64("node", "tok", F.lit(turn))).alias("hub")).where("lo <> hi")
        if turn < STAR_ROUNDS:
            stars = members.join(mixed.select("tok", F.col("hub.node").alias("hub"), F.col("hub.comp").alias("other")), "tok").where("comp <> other")
            met = stars.groupBy("node", "hub").agg(F.count("*").alias("c")).groupBy("node").agg(F.sort_array(F.collect_list(F.struct("c", "hub")), asc=False).alias("hubs"))
            best = met.select("node", F.explode(F.slice("hubs", 1, HUBS)["hub"]).alias("hub"))
            pairs = best.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()
            more = _confirmed(pairs, sets, percent)
        else:
            apart = members.join(mixed.select("tok"), "tok")
            some = apart.select("node").distinct().join(cands.select("node", "n"), "node")
            able = core.cut(_heavy(some, sets, percent))
            apart = apart.join(able, "node")
            blocks = lambda c: F.ceil(F.count(F.when(c, 1)) / BLOCK).cast("int")
            sizes = apart.groupBy("tok").agg(blocks(F.col("heavy")).alias("heavies"), blocks(~F.col("heavy")).alias("lights")).where("heavies > 0")
            spread = apart.join(sizes, "tok").withColumn("own", F.expr("pmod(xxhash64(node), case when heavy then heavies else lights end)").cast("int"))
            # (light, a, b): heavy blocks a <= b, or heavy block a and light block b
            # side 0: both blocks are the same, 1: block a, 2: block b
            upto = lambda n: f"case when {n} > 0 then sequence(0, {n} - 1) else cast(array() as array<int>) end"
            meets = F.expr(f"""case when heavy then concat(
                transform({upto('heavies')}, x -> named_struct('light', false, 'a', least(own, x), 'b', greatest(own, x), 'side', case when own = x then 0 when own < x then 1 else 2 end)),
                transform({upto('lights')}, x -> named_struct('light', true, 'a', own, 'b', x, 'side', 1)))
                else transform({upto('heavies')}, x -> named_struct('light', true, 'a', x, 'b', own, 'side', 2)) end""")
            met = spread.withColumn("at", F.explode(meets)).select("node", "comp", "tok", F.xxhash64("tok", "at.light", "at.a", "at.b").alias("g"), F.col("at.side").alias("side"))
            brief = met.join(cands.select("node", "n", F.col("brief").alias("sig"), "toks"), "node").select("g", "tok", "side", "node", "comp", "n", "sig", "toks")
            # the full sets travel only to where a node has a candidate
            some = brief.repartition(F.col("g")).sortWithinPartitions("g").mapInArrow(_merge(m, need, percent, False), brief.schema)
            full = some.join(sets, "node").repartition(F.col("g")).sortWithinPartitions("g").select(*brief.columns, "shingles")
            more = core.cut(full.mapInArrow(_merge(m, need, percent, True), "a bigint, b bigint"))
        edges = more if edges is None else edges.unionByName(more)
    found = core.components(edges).withColumnRenamed("component", "comp")
    marked = signed.select("doc_id", "key", "n", "node").join(found, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    least = marked.where("comp is not null").groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    alone = marked.where("comp is null").select("doc_id", "key", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.col("key").alias("group"))
    done = marked.where("comp is not null").join(least, "comp").select("doc_id", "key", F.col("n").alias("n_shingles"), "component_id", F.col("comp").alias("group"))
    return done.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))

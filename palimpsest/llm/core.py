"""Shared pieces: vectorised words and hashes over Arrow batches, scratch tables, connected components.

Words are runs of bytes other than space and \\x09-\\x0D. All hashing is 64-bit and vectorised with numpy over a few MB of
text at a time, so memory does not grow with the number of documents, and only by some bytes a word with the longest one.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

U64 = np.uint64
CHUNK_BYTES = 2_000_000
_BASE = 0x9E3779B97F4A7C15 | 1
_rng = np.random.Generator(np.random.PCG64(20240601))
BYTE_HASH = _rng.integers(1, 2**64, 256, dtype=U64) | U64(1)
STEP = _rng.integers(1, 2**64, 128, dtype=U64) | U64(1)

IS_WORD = np.ones(256, bool)
IS_WORD[[0x20, *range(0x09, 0x0E)]] = False
IS_LINE = np.ones(256, bool)
IS_LINE[0x0A] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that every output bit depends on every input bit."""
    h = h ^ (h >> U64(33))
    h = h * U64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> U64(33))
    h = h * U64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U64(33))


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows [lo, hi) with their UTF-8 bytes and row offsets, about ``limit`` bytes at a time; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    bufs = texts.buffers()
    offs = np.frombuffer(bufs[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if len(texts) and bufs[2] is not None and bufs[2].size else np.zeros(0, np.uint8)
    lo, n = 0, len(texts)
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def runs(buf: np.ndarray, offs: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs, within rows, of bytes that ``table`` (256 flags) holds for."""
    return edges(table[buf], offs)


def edges(m: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of set flags within rows."""
    if not len(m):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    before = np.empty_like(m)
    before[0] = False
    before[1:] = m[:-1]
    before[offs[:-1][offs[:-1] < len(m)]] = False
    after = np.empty_like(m)
    after[-1] = False
    after[:-1] = m[1:]
    ends = offs[1:] - 1
    after[ends[ends >= 0]] = False
    return np.flatnonzero(m & ~before), np.flatnonzero(m & ~after) + 1


def hash_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seg: int = 1_000_000) -> np.ndarray:
    """A 64-bit hash of the bytes of each span; spans must be in order and not overlap."""
    out = np.empty(len(starts), U64)
    i = 0
    while i < len(starts):
        base = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, base + seg, "right")))
        piece = buf[base : int(ends[j - 1])]
        with np.errstate(over="ignore"):
            power, inverse = _powers(len(piece))
            total = np.empty(len(piece) + 1, U64)
            total[0] = 0
            np.cumsum(BYTE_HASH[piece] * power[: len(piece)], dtype=U64, out=total[1:])
            s = starts[i:j] - base
            e = ends[i:j] - base
            out[i:j] = mix((total[e] - total[s]) * inverse[s] + (e - s).astype(U64) * U64(0xD6E8FEB86659FD93))
        i = j
    return out


class _Powers:
    """Powers of an odd base modulo 2**64, and of its inverse: made where they are needed.

    Worker code is pickled by value with what it refers to; the tables (16 MB) do not go along.
    """

    def __init__(self) -> None:
        self.tables: tuple[np.ndarray, ...] = ()

    def __reduce__(self) -> tuple:
        return _Powers, ()

    def __call__(self, n: int) -> tuple[np.ndarray, ...]:
        if not self.tables or len(self.tables[0]) < n:
            size = max(n, 1_000_256)
            power, inverse = np.full(size, _BASE, U64), np.full(size, pow(_BASE, -1, 2**64), U64)
            power[0] = inverse[0] = 1
            with np.errstate(over="ignore"):
                self.tables = (np.cumprod(power, dtype=U64), np.cumprod(inverse, dtype=U64))
        return self.tables


_powers = _Powers()


def windows(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of each ``width`` consecutive hashes; entry i covers i..i+width-1 (the caller drops those across rows)."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, U64)
    with np.errstate(over="ignore"):
        if width <= 8:
            out = np.zeros(n, U64)
            for k in range(width):
                out += h[k : k + n] * STEP[k]
            return mix(out)
        power, inverse = _powers(len(h))
        total = np.empty(len(h) + 1, U64)
        total[0] = 0
        # a rolling sum; h is mixed already, so that equal sums mean equal sequences but for chance
        np.cumsum(h * power[: len(h)], dtype=U64, out=total[1:])
        return mix((total[width:] - total[:-width]) * inverse[:n])


def row_spans(starts: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """For rows given by byte offsets: index of the first item of each row, and the number of items at the end."""
    return np.searchsorted(starts, offs)


def ranges(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Concatenated lo[i], lo[i]+1, ... of n[i] numbers each."""
    total = int(n.sum())
    if not total:
        return np.zeros(0, np.int64)
    start = np.cumsum(n) - n
    return np.arange(total, dtype=np.int64) + np.repeat(lo - start, n)


def i64(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def list_array(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from flat values and the number that each row has."""
    offs = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offs[1:])
    return pa.ListArray.from_arrays(pa.array(offs), pa.array(values, kind))


def line_spans(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all \\n-split lines, empty ones too, and the number of lines of each row (1 for an empty row)."""
    cuts = np.flatnonzero(buf == 10)
    rows = len(offs) - 1
    n = np.diff(np.searchsorted(cuts, offs)) + 1
    first = np.cumsum(n) - n
    starts, ends = np.empty(int(n.sum()), np.int64), np.empty(int(n.sum()), np.int64)
    starts[first] = offs[:-1]
    ends[first + n - 1] = offs[1:]
    inner = np.ones(len(starts), bool)
    inner[first] = False
    starts[inner] = cuts + 1
    inner = np.ones(len(starts), bool)
    inner[first + n - 1] = False
    ends[inner] = cuts
    assert rows == len(n)
    return starts, ends, n


def join_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, counts: np.ndarray, sep: int) -> pa.Array:
    """Strings of ``counts`` spans a row, joined by one byte ``sep``."""
    size = ends - starts + 1
    lasts = np.cumsum(counts)[counts > 0] - 1
    size[lasts] -= 1
    total = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=total[1:])
    padded = np.append(buf, np.uint8(sep))
    data = padded[ranges(starts, size)]
    seps = np.ones(len(size), bool)
    seps[lasts] = False
    data[total[1:][seps] - 1] = sep
    offs = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=offs[1:])
    return pa.LargeStringArray.from_buffers(len(counts), pa.py_buffer(total[offs]), pa.py_buffer(data)).cast(pa.string())


def concat_strings(parts: list[pa.Array]) -> pa.Array:
    return pa.concat_arrays(parts) if parts else pa.array([], pa.string())


#: Bytes and rows that one Arrow batch holds at most; an executor has a few of them at a time, in the JVM and in each worker.
BATCH_BYTES, BATCH_ROWS = 4_000_000, 2_000


def bounded_batches(df: DataFrame) -> DataFrame:
    """The frame, after its session's Arrow batches have been made small enough for long texts."""
    conf = df.sparkSession.conf
    for key, most in (("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES), ("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)):
        now = conf.get(key, None)
        if now is None or not 0 < int(re.sub(r"\D", "", now) or 0) <= most or now.startswith("-"):
            conf.set(key, str(most))
    return df


def wrap(docs: DataFrame, *dropped: str) -> DataFrame:
    """(row, key, text): the other columns packed in a struct, so that no name can clash, and a key for joining back.

    Columns that the operator adds are named in ``dropped``: those of the input go.
    """
    bounded_batches(docs)
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("text", *dropped)]
    return docs.select(F.struct(*rest).alias("row"), text_key().alias("key"), F.col("text").alias("text"))


def unwrap(df: DataFrame, docs: DataFrame, *added: str, text: bool = True) -> DataFrame:
    """The columns of ``docs`` in their order (text from ``df``), and the added ones."""
    cols = [F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns if c not in added and (text or c != "text")]
    return df.select(*cols, *added)


def out_schema(df: DataFrame, *cols: str, **new: str) -> T.StructType:
    """The named columns of ``df`` with their types, and new ones (name = DDL type), for mapInArrow."""
    return T.StructType([df.schema[c] for c in cols] + [T.StructField(k, T._parse_datatype_string(v)) for k, v in new.items()])


def batch_of(**cols: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))


class Block:
    """Gathers column pieces until ``limit`` rows are held; ``take`` gives them joined and starts anew."""

    def __init__(self, width: int, limit: int):
        self.cols, self.limit, self.rows = [[] for _ in range(width)], limit, 0

    def add(self, *cols: np.ndarray) -> bool:
        for have, more in zip(self.cols, cols, strict=True):
            have.append(more)
        self.rows += len(cols[0])
        return self.rows >= self.limit

    def take(self) -> list[np.ndarray]:
        out = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in self.cols]
        self.cols, self.rows = [[] for _ in self.cols], 0
        return out


def shared(h: np.ndarray) -> np.ndarray:
    """Flags of the values that occur at least twice."""
    order = np.argsort(h, kind="stable")
    s = h[order]
    same = s[1:] == s[:-1]
    out = np.zeros(len(h), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


# ---------------------------------------------------------------- scratch tables

def scratch_dir(spark: SparkSession) -> str:
    """A new folder in the shared one named by spark.checkpoint.dir; where that is unset, local mode uses one below the
    warehouse, and a cluster is refused."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder")
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    return f"{root.rstrip('/')}/palimpsest-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write to the shared folder as Parquet and read it back: cuts the lineage, and survives lost executors."""
    path = scratch_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_scratch(spark: SparkSession, *frames: DataFrame) -> None:
    """Delete the files of frames made by ``cut`` once nothing reads them any more."""
    jvm = spark._jvm
    for df in frames:
        for file in df.inputFiles()[:1]:
            folder = jvm.org.apache.hadoop.fs.Path(file).getParent()
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def text_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """A key for a row that does not need unique or non-null ids: rows with equal id and text are interchangeable."""
    return F.xxhash64(F.col(id_col).cast("string"), F.lit("|"), F.coalesce(F.col(text_col), F.lit("")), F.col(text_col).isNull())


# ---------------------------------------------------------------- connected components

#: Edges (16 bytes each) that are joined up at a time, and partitions that one task reads them from.
EDGE_BLOCK, MERGED = 500_000, 8


def _stars(pairs: np.ndarray) -> pa.RecordBatch:
    """Union-find over a block of edges: an edge from each node to the smallest of its component there."""
    nodes, at = np.unique(pairs, return_inverse=True)
    parent = list(range(len(nodes)))  # nodes are sorted, so the smallest number is the smallest node

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in at.reshape(-1, 2).tolist():
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    roots = np.array([find(x) for x in range(len(nodes))])
    own = roots != np.arange(len(nodes))
    return batch_of(u=pa.array(nodes[own]), v=pa.array(nodes[roots[own]]))


def _joined_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    block = Block(2, EDGE_BLOCK)
    for b in batches:
        if b.num_rows and block.add(b.column("u").to_numpy(), b.column("v").to_numpy()):
            yield _stars(np.stack(block.take(), 1))
    if block.rows:
        yield _stars(np.stack(block.take(), 1))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for the undirected edges (a, b), component the smallest node reachable.

    Rounds, the same whatever the number of edges. Each first joins up the edges block by block where they are, a block of
    ``EDGE_BLOCK`` edges at a time, which leaves fewer edges than nodes a block and needs no shuffle. Then, unless every node
    has one edge to a root, a large-star and a small-star step connect the blocks: minima are pre-aggregated before the
    shuffle and joined back by key, so a node with very many neighbours costs rows in proportion to them, and a skewed join
    splits it. Every round is written to the shared folder, and the one before deleted. Nothing but whether it is done reaches
    the driver.
    """
    spark = edges.sparkSession
    now = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v"))
    for _ in range(max_rounds):
        some = max(1, now.rdd.getNumPartitions() // MERGED)
        flat = cut(now.coalesce(some).mapInArrow(_joined_up, "u bigint, v bigint"))
        drop_scratch(spark, now)
        now = flat
        # done when every node has edges to one smaller node, a root, at most
        ends = now.select(F.col("u").alias("x"), "v").unionByName(now.select(F.col("v").alias("x"), F.lit(None).cast("bigint").alias("v")))
        state = ends.groupBy("x").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.max(F.col("v").isNull()).alias("above"))
        if state.where("low <> high or low is not null and above").isEmpty():
            break
        # large star: every larger neighbour of u moves to the smallest neighbour of u
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        big = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        # small star: u and its smaller neighbours move to the smallest of them
        low = big.groupBy("u").agg(F.min("v").alias("m"))
        small = big.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        nxt = cut(small.where("u <> v").distinct())
        drop_scratch(spark, now)
        now = nxt
    else:
        raise RuntimeError("components did not settle")
    return now.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node").unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())

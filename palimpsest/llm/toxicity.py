"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text (tokens are runs of letters, digits and non-ASCII bytes, lower-cased in ASCII and Latin-1): every token,
every pair of neighbours, every pair with one token between them (skip-gram), and the first 5 and 7 bytes of longer tokens
(n-grams inside the word, for inflected and compound forms). Each is hashed to ``1 << bits`` places; a place counts once.

Training is online, document by document in a fixed order, with a learning rate of its own for each place and L1 shrinkage;
most weights stay exactly zero, so the model is a short list of places and weights, at most ``1 << bits``, whatever the
corpus. The bias is set so that the decision threshold is the best cut on examples held out in turn. It is fitted on a bounded sample (``labelled.MAX_TRAIN``) and broadcast; scoring is one pass without a shuffle.

Defined results. Empty table: no rows. Null or empty text: the score of the bias alone. No usable label: the bias of half a document of each
class, score 0.5. Repeated rows get equal scores. Null ids are scored, held_out false. Whole texts are scored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm import core, labelled

BITS, ALPHA, BETA, L1, L2, EPOCHS, THRESHOLD = 20, 1.0, 1.0, 3.0, 0.1, 6, 0.7
_TOKEN = np.zeros(256, bool)
_TOKEN[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_KIND = core.mix(np.arange(10, 16, dtype=np.uint64))


def features(buf: np.ndarray, offs: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(row, place) of every feature occurrence of a chunk."""
    s, e = core.runs(buf, offs, _TOKEN)
    latin = np.zeros(len(buf), bool)
    latin[1:] = (buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E) & (buf[1:] != 0x97)
    low = core.LOWER[buf] + np.where(latin, np.uint8(32), np.uint8(0))
    h = core.hash_spans(low, s, e)
    at = core.row_spans(s, offs)
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    rows, hashes = [row], [h ^ _KIND[0]]
    with np.errstate(over="ignore"):
        for gap, kind in ((1, _KIND[1]), (2, _KIND[2])):
            if len(h) > gap:
                ok = row[gap:] == row[:-gap]
                rows.append(row[gap:][ok])
                hashes.append((h[:-gap] * core.STEP[0] + h[gap:] * core.STEP[1])[ok] ^ kind)
    for width, kind in ((5, _KIND[3]), (7, _KIND[4])):
        long = e - s > width
        rows.append(row[long])
        hashes.append(core.hash_spans(low, s[long], s[long] + width) ^ kind)
    return np.concatenate(rows), (core.mix(np.concatenate(hashes)) >> np.uint64(64 - bits)).astype(np.int64)


def _encode(bits: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, offs in core.chunks(batch.column("text")):
                row, place = features(buf, offs, bits)
                both = np.unique((row << bits) | place)
                n = np.bincount(both >> bits, minlength=hi - lo)
                yield core.batch_of(rank=batch.column("rank").slice(lo, hi - lo), y=batch.column("y").slice(lo, hi - lo), places=core.list_array((both & ((1 << bits) - 1)).astype(np.int32), n, pa.int32()))

    return run


def _examples(batches: list[pa.RecordBatch]) -> list[tuple]:
    """(rank, label, places) in a fixed order."""
    out = []
    for b in batches:
        offs, flat = b.column("places").offsets.to_numpy(), b.column("places").values.to_numpy()
        for i, (rank, y) in enumerate(zip(b.column("rank").to_pylist(), b.column("y").to_pylist(), strict=True)):
            out.append((rank, y, flat[offs[i] : offs[i + 1]]))
    out.sort(key=lambda x: (x[0], x[1], len(x[2])))
    return out


def _weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def _ftrl(examples: list[tuple], bits: int, epochs: int) -> tuple[float, np.ndarray]:
    """Bias (not shrunk) and weights by place."""
    good = sum(y for _, y, _ in examples)
    shift, seen = float(np.log((good + 0.5) / (len(examples) - good + 0.5))), 1.0
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    for _ in range(epochs):
        for _, y, at in examples:
            zi, ni = z[at], n[at]
            w = _weights(zi, ni)
            g = 1 / (1 + np.exp(-np.clip(shift + w.sum(), -35, 35))) - y
            z[at] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA * w
            n[at] = ni + g * g
            seen += g * g
            shift -= ALPHA * g / np.sqrt(seen)
    return shift, _weights(z, n)


def best_cut(logits: np.ndarray, labels: np.ndarray) -> float:
    """The cut between two neighbouring logits that gives the best F1; of equally good ones that in the widest gap."""
    order = np.argsort(-logits, kind="stable")
    v, y = logits[order], labels[order]
    f1 = 2 * np.cumsum(y) / (np.arange(1, len(y) + 1) + y.sum())
    gap = v - np.append(v[1:], v[-1] - 1)
    f1[gap <= 0] = -1
    best = np.flatnonzero(f1 >= f1.max() - 1e-12)
    k = best[np.argmax(gap[best])]
    return float(v[k] - gap[k] / 2)


def train(batches: list[pa.RecordBatch], bits: int = BITS, epochs: int = EPOCHS, threshold: float = THRESHOLD) -> tuple[float, np.ndarray, np.ndarray]:
    """(bias, places, weights) by FTRL-proximal.

    The weights are of all examples. The bias is set so that the score ``threshold`` is the cut that is best on examples that
    a model has not seen: each half is scored by a model of the other half.
    """
    examples = _examples(batches)
    shift, w = _ftrl(examples, bits, epochs)
    logits = np.zeros(len(examples))
    for half in (0, 1):
        own, weights = _ftrl(examples[1 - half :: 2], bits, epochs)
        logits[half::2] = [own + weights[at].sum() for _, _, at in examples[half::2]]
    labels = np.array([y for _, y, _ in examples])
    if 0 < labels.sum() < len(labels):
        shift += float(np.log(threshold / (1 - threshold))) - best_cut(logits, labels)
    on = np.flatnonzero(w)
    return shift, on, w[on].astype(np.float32)


def _score(model, bits: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bias, places, weights = model.value
        dense = np.zeros(1 << bits, np.float32)
        dense[places] = weights
        for batch in batches:
            out = [np.zeros(0)]
            for lo, hi, buf, offs in core.chunks(batch.column("text")):
                row, place = features(buf, offs, bits)
                on = dense[place] != 0
                both = np.unique((row[on] << bits) | place[on])
                logit = bias + np.bincount(both >> bits, dense[both & ((1 << bits) - 1)], minlength=hi - lo)
                out.append(1 / (1 + np.exp(-np.clip(logit, -35, 35))))
            yield core.batch_of(doc_id=batch.column("doc_id"), score=pa.array(np.concatenate(out)))

    return run


def fit(docs: DataFrame, labels: DataFrame, modulus: int = 3, held_out: int = 1, limit: int = labelled.MAX_TRAIN, bits: int = BITS, threshold: float = THRESHOLD) -> tuple[float, np.ndarray, np.ndarray]:
    examples = labelled.sample(docs, labels, "toxic", modulus, held_out, limit).mapInArrow(_encode(bits), "rank bigint, y int, places array<int>")
    return labelled.fit_in_one_task(examples, lambda batches: train(batches, bits, threshold=threshold))


def toxicity(docs: DataFrame, labels: DataFrame, modulus: int = 3, held_out: int = 1, limit: int = labelled.MAX_TRAIN, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, modulus, held_out, limit, threshold=threshold))
    slim = core.bounded_batches(docs).select("doc_id", "text")
    scored = slim.mapInArrow(_score(model, BITS), core.out_schema(slim, "doc_id", score="double"))
    return scored.select("doc_id", F.coalesce(labelled.fold(modulus) == held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))

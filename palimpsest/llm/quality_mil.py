"""Quality classifier: attention-based multiple-instance learning over passages.

A text is cut into passages of ``PASSAGE`` words (the last one may be shorter); all of them are encoded, as a row of figures
(``FIGURES``) beside hashed word n-grams: each word and each pair of neighbours adds +1 or -1 to one of ``HASHED`` places,
divided by the root of the number of words. The row is standardised and mapped by a learned layer, which thereby learns a
vector for each place, to h = tanh(W x + b). A passage weighs
softmax(w . (tanh(V h) * sigmoid(U h))) within its document (gated attention), and the document's score is
sigmoid(c . sum(weight * h) + d). Only document labels are used in training: Adam on the log loss, by hand-written
gradients, on a bounded sample (``labelled.MAX_TRAIN``).

Scale. The model is a thousand numbers; scoring is one pass without a shuffle, over passages in slices.

Defined results. Empty table: no rows. Null or empty text, or no word: one passage with figures 0. No usable label: the untrained model's constant
score 0.5. Repeated rows get equal scores. Null ids are scored, held_out false. Whole texts are scored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm import core, labelled

PASSAGE, HIDDEN, GATE, EPOCHS, RATE, BATCH, SEED = 100, 12, 8, 40, 0.02, 256, 5
FIGURES = ("words", "word_length", "long_words", "symbols", "pipes", "exclaims", "capitals", "all_capitals", "digits", "non_ascii", "sentences", "commas", "lines", "distinct", "same_as_before", "same_as_two_before")
HASHED = 48
WIDTH = len(FIGURES) + HASHED
_KIND = core.mix(np.arange(70, 72, dtype=np.uint64))


def passages(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Figures of each passage of a chunk, row after row, and the number of passages of each row (1 at least)."""
    s, e = core.runs(buf, offs, core.IS_WORD)
    at = core.row_spans(s, offs)
    words = np.diff(at)
    n = np.maximum(-(-words // PASSAGE), 1)
    rank = core.ranges(np.zeros(len(n), np.int64), n)  # place of the passage in its row
    lo = np.repeat(at[:-1], n) + rank * PASSAGE
    hi = np.minimum(lo + PASSAGE, np.repeat(at[1:], n))
    size = hi - lo
    x = np.zeros((int(n.sum()), WIDTH))
    some = size > 0
    if not some.any():
        return x, n
    lo, hi, size = lo[some], hi[some], size[some]
    b0, b1 = s[lo], e[hi - 1]
    bytes_ = (e - s).astype(float)

    def chars(flags: np.ndarray) -> np.ndarray:
        total = np.append(0, np.cumsum(flags))
        return (total[b1] - total[b0]) / size

    def per_word(flags: np.ndarray) -> np.ndarray:
        total = np.append(0.0, np.cumsum(flags))
        return (total[hi] - total[lo]) / size

    h = core.hash_spans(core.LOWER[buf], s, e)
    own = np.repeat(np.arange(len(lo)), size)  # passage of each word
    order = np.lexsort((h, own))
    new = np.append(True, (h[order][1:] != h[order][:-1]) | (own[order][1:] != own[order][:-1]))
    upper = (buf >= 65) & (buf <= 90)
    ups = np.append(0, np.cumsum(upper))
    letters = np.append(0, np.cumsum(upper | (buf >= 97) & (buf <= 122) | (buf >= 128)))
    caps = (ups[e] - ups[s] == letters[e] - letters[s]) & (letters[e] - letters[s] > 1)
    last = buf[e - 1]

    def before(k: int) -> np.ndarray:
        same = np.zeros(len(h), bool)
        same[k:] = (h[k:] == h[:-k]) & (own[k:] == own[:-k])
        return same

    symbol = np.zeros(256, bool)
    symbol[list(b"#*$%&<>=@^~_{}[]\\")] = True
    columns = (
        np.log1p(size), per_word(bytes_), per_word(bytes_ > 14), chars(symbol[buf]), chars(buf == 0x7C), chars(buf == 0x21), chars(upper), per_word(caps), chars((buf >= 48) & (buf <= 57)),
        chars((buf & 0xC0) == 0xC0), per_word((last == 0x2E) | (last == 0x3F)), chars(buf == 0x2C), chars(buf == 10), np.bincount(own[order][new], minlength=len(lo)) / size, per_word(before(1)), per_word(before(2)),
    )
    x[some, : len(FIGURES)] = np.stack(columns, 1)
    x[some, len(FIGURES) :] = hashed(h, own, len(lo)) / np.sqrt(size)[:, None]
    return x, n


def hashed(h: np.ndarray, own: np.ndarray, n: int) -> np.ndarray:
    """Signed counts by place of the words (hashes ``h``) and neighbours of each of ``n`` passages; ``own`` is a word's passage."""
    pair = np.flatnonzero(own[1:] == own[:-1])
    with np.errstate(over="ignore"):
        grams = core.mix(np.concatenate([h ^ _KIND[0], (h[pair] * core.STEP[0] + h[pair + 1] * core.STEP[1]) ^ _KIND[1]]))
    at = np.concatenate([own, own[pair]]) * HASHED + (grams >> np.uint64(8)).astype(np.int64) % HASHED
    sign = 1.0 - 2.0 * (grams & np.uint64(1)).astype(float)
    return np.bincount(at, sign, minlength=n * HASHED).reshape(n, HASHED)


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, buf, offs in core.chunks(batch.column("text")):
            x, n = passages(buf, offs)
            yield core.batch_of(rank=batch.column("rank").slice(lo, hi - lo), y=batch.column("y").slice(lo, hi - lo), x=core.list_array(x.astype(np.float32).ravel(), n * WIDTH, pa.float32()))


def _sigmoid(v: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(v, -35, 35)))


def forward(model: dict, x: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, dict]:
    """Scores of the documents whose passages are ``n`` rows of ``x`` each, and what the gradients need."""
    first = np.cumsum(n) - n
    own = np.repeat(np.arange(len(n)), n)
    x = np.clip((x - model["mean"]) / model["scale"], -8, 8)
    h = np.tanh(x @ model["W"] + model["b"])
    t, g = np.tanh(h @ model["V"]), _sigmoid(h @ model["U"])
    a = (t * g) @ model["w"]
    a = np.exp(a - np.maximum.reduceat(a, first)[own])
    a /= np.add.reduceat(a, first)[own]
    z = np.add.reduceat(a[:, None] * h, first, axis=0)
    return _sigmoid(z @ model["c"] + model["d"][0]), {"x": x, "h": h, "t": t, "g": g, "a": a, "z": z, "first": first, "own": own}


def _gradients(model: dict, p: np.ndarray, y: np.ndarray, k: dict) -> dict:
    dl = (p - y) / len(y)
    dz = dl[:, None] * model["c"]
    rows = dz[k["own"]]
    da = (rows * k["h"]).sum(1)
    dots = k["a"] * (da - np.add.reduceat(k["a"] * da, k["first"])[k["own"]])  # through the softmax
    dt, dg = dots[:, None] * model["w"] * k["g"], dots[:, None] * model["w"] * k["t"]
    dt, dg = dt * (1 - k["t"] ** 2), dg * k["g"] * (1 - k["g"])
    dh = (k["a"][:, None] * rows + dt @ model["V"].T + dg @ model["U"].T) * (1 - k["h"] ** 2)
    return {"W": k["x"].T @ dh, "b": dh.sum(0), "V": k["h"].T @ dt, "U": k["h"].T @ dg, "w": (k["t"] * k["g"]).T @ dots, "c": k["z"].T @ dl, "d": np.array([dl.sum()])}


def train(batches: list[pa.RecordBatch], epochs: int = EPOCHS) -> dict:
    """Fit on (rank, y, x); the order of documents is fixed by rank."""
    width = WIDTH
    examples = []
    for b in batches:
        offs, flat = b.column("x").offsets.to_numpy(), b.column("x").values.to_numpy().astype(float)
        for i, (rank, y) in enumerate(zip(b.column("rank").to_pylist(), b.column("y").to_pylist(), strict=True)):
            examples.append((rank, y, flat[offs[i] : offs[i + 1]].reshape(-1, width)))
    examples.sort(key=lambda v: (v[0], v[1], len(v[2]), v[2].sum()))
    rng = np.random.Generator(np.random.PCG64(SEED))
    model = {"W": rng.normal(0, width**-0.5, (width, HIDDEN)), "b": np.zeros(HIDDEN), "V": rng.normal(0, HIDDEN**-0.5, (HIDDEN, GATE)), "U": rng.normal(0, HIDDEN**-0.5, (HIDDEN, GATE)), "w": rng.normal(0, GATE**-0.5, GATE), "c": np.zeros(HIDDEN), "d": np.zeros(1)}
    model |= {"mean": np.zeros(width), "scale": np.ones(width)}
    if not examples:
        return model
    x = np.concatenate([v[2] for v in examples])
    n = np.array([len(v[2]) for v in examples])
    y = np.array([v[1] for v in examples], float)
    first = np.cumsum(n) - n
    model |= {"mean": x.mean(0), "scale": x.std(0) + 1e-3}
    names = ("W", "b", "V", "U", "w", "c", "d")
    m, v, step = {k: 0.0 for k in names}, {k: 0.0 for k in names}, 0
    for epoch in range(epochs):
        order = rng.permutation(len(n))
        for i in range(0, len(order), BATCH):
            pick = order[i : i + BATCH]
            p, kept = forward(model, x[core.ranges(first[pick], n[pick])], n[pick])
            step += 1
            for k, g in _gradients(model, p, y[pick], kept).items():
                g = g + 1e-4 * model[k]
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                model[k] = model[k] - RATE * (1 - epoch / epochs) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return model


def _score(model) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [np.zeros(0)]
            for _, _, buf, offs in core.chunks(batch.column("text")):
                out.append(forward(model.value, *passages(buf, offs))[0])
            yield core.batch_of(doc_id=batch.column("doc_id"), score=pa.array(np.concatenate(out)))

    return run


def fit(docs: DataFrame, labels: DataFrame, modulus: int = 4, held_out: int = 2, limit: int = labelled.MAX_TRAIN) -> dict:
    examples = labelled.sample(docs, labels, "quality", modulus, held_out, limit).mapInArrow(_encode, "rank bigint, y int, x array<float>")
    return labelled.fit_in_one_task(examples, train)


def quality(docs: DataFrame, labels: DataFrame, modulus: int = 4, held_out: int = 2, limit: int = labelled.MAX_TRAIN, threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, modulus, held_out, limit))
    slim = core.bounded_batches(docs).select("doc_id", "text")
    scored = slim.mapInArrow(_score(model), core.out_schema(slim, "doc_id", score="double"))
    return scored.select("doc_id", F.coalesce(labelled.fold(modulus) == held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))

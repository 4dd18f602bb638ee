from __future__ import annotations

import numpy as np
import odd
import pyarrow as pa
import pytest

from palimpsest.llm import core, quality_mil, quality_rules, toxicity, weak


def test_figures_match_brute_force(spark):
    rows = odd.documents() + [(100, "a b c a b c d\n\nx\nx\n \n x", *odd.REST), (101, "# * $ % & | < > é\nÉ", *odd.REST)]
    done = quality_rules.quality(odd.frame(spark, rows))
    assert len(done.columns) == len(set(done.columns)) and "lang" in done.columns
    want = sorted((str(r[0]), *odd.figures(r[1]).values()) for r in rows)
    got = done.collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert sorted((str(r["doc_id"]), *(r[c] for c in names)) for r in got) == want
    for r in got:
        failed = r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]
        assert r["base_failed"] == failed and not (failed and r["kept"])


def test_keep_good_keeps_what_quality_keeps(spark):
    docs = odd.frame(spark)
    kept = sorted(str(r["doc_id"]) for r in quality_rules.quality(docs).where("kept").collect())
    out = quality_rules.keep_good(docs)
    assert out.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in out.collect()) == kept != []
    assert quality_rules.quality(odd.frame(spark, [])).collect() == [] == quality_rules.keep_good(odd.frame(spark, [])).collect()


def test_em_finds_reliable_rules():
    rng = np.random.default_rng(3)
    accuracy = (0.95, 0.9, 0.6, 0.85, 0.55)
    counts: dict[str, int] = {}
    truth: dict[str, list[int]] = {}
    for _ in range(20_000):
        y = int(rng.random() < 0.8)
        p = "".join("-" if rng.random() < 0.2 else str(y if rng.random() < a else 1 - y) for a in accuracy)
        counts[p] = counts.get(p, 0) + 1
        truth.setdefault(p, []).append(y)
    begin, prior = weak.votes_begin(np.full(5, 0.8)), np.array([0.3, 0.7])
    share, table, post = weak.fit(counts, begin, prior)
    assert abs(share[1] - 0.8) < 0.05
    voted = table[1, :, 2] / (table[1, :, 1] + table[1, :, 2])
    assert np.abs(voted - accuracy).max() < 0.08
    right = sum(sum(v) if post[p] >= 0.5 else len(v) - sum(v) for p, v in truth.items())
    assert right / 20_000 > 0.95
    assert weak.fit({}, begin, prior)[2] == {} == weak.classifier({}, {})


def em_by_brute_force(rows: list[str], rounds: int) -> list[float]:
    """EM over texts one by one, with plain loops: a class for each family of rules, and the good one."""
    families = list(dict.fromkeys(r[0] for r in quality_rules.RULES))
    classes = [*families, "good"]
    start = {(c, r): quality_rules.RIGHT if c == rule[0] else 1 - quality_rules.RIGHT if c == "good" else 0.5 for c in classes for r, rule in enumerate(quality_rules.RULES)}
    first = {c: quality_rules.GOOD if c == "good" else (1 - quality_rules.GOOD) / len(families) for c in classes}
    against, share, out = dict(start), dict(first), []
    for _ in range(rounds):
        out = []
        for v in rows:
            p = dict(share)
            for c in classes:
                for r, x in enumerate(v):
                    p[c] *= 1.0 if x == "?" else against[c, r] if x == "0" else 1 - against[c, r]
            total = sum(p.values())
            out.append({c: x / total for c, x in p.items()})
        for c in classes:
            for r in range(len(quality_rules.RULES)):
                no = sum(o[c] for o, v in zip(out, rows, strict=True) if v[r] == "0")
                yes = sum(o[c] for o, v in zip(out, rows, strict=True) if v[r] == "1")
                against[c, r] = (no + start[c, r]) / (no + yes + 1)
            share[c] = (sum(o[c] for o in out) + first[c]) / (len(rows) + 1)
    return [o["good"] for o in out]


def test_verdict_matches_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    keyed = core.wrap(docs)
    figured = keyed.mapInArrow(quality_rules._figures(), core.out_schema(keyed, "row", "key", **{c: "bigint" for c in quality_rules.FIGURES}))
    votes = {r["doc_id"]: r["votes"] for r in figured.select("row.doc_id", quality_rules.votes().alias("votes")).collect()}
    want = dict(zip(votes, em_by_brute_force(list(votes.values()), 60), strict=True))
    got = {r["doc_id"]: r for r in quality_rules.quality(docs).collect()}
    assert set(got) == set(want)
    for i, r in got.items():
        assert abs(r["posterior"] - want[i]) < 0.01
        assert r["kept"] == (want[i] >= 0.5 and not r["base_failed"])


def test_verdict_is_not_all_must_pass():
    """A vote that the rules of its family contradict is outvoted; a vote that they share is not."""
    counts = {"1" * 11: 9000, "000" + "1" * 8: 500, "111000" + "1" * 5: 300, "11111100111": 200, "1110?111111": 12, "0" + "1" * 10: 5, "?00" + "1" * 8: 3}
    post = weak.fit(counts, *quality_rules.begin())[2]
    assert post["1110?111111"] > 0.5 and post["0" + "1" * 10] > 0.5
    assert max(post["000" + "1" * 8], post["111000" + "1" * 5], post["11111100111"], post["?00" + "1" * 8]) < 0.1


def test_rules_agree_with_labels(spark, small):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    got = quality_rules.quality(spark.read.parquet(f"{small}/documents.parquet")).collect()
    judged = [(r["kept"], labels[r["doc_id"]]) for r in got if r["doc_id"] in labels and r["n_words"] >= 50]
    assert sum(k == bool(y) for k, y in judged) / len(judged) > 0.97
    assert sum(not k for k, y in judged if y) / sum(y for _, y in judged) < 0.01


def test_attention_gradients():
    rng = np.random.default_rng(0)
    model = quality_mil.train([])
    for k in ("W", "V", "U", "w", "c", "b", "d"):
        model[k] = rng.normal(0, 0.5, np.shape(model[k]))
    n = np.array([1, 3, 2])
    x, y = rng.normal(size=(6, quality_mil.WIDTH)), np.array([1.0, 0.0, 1.0])

    def loss() -> float:
        p = quality_mil.forward(model, x, n)[0]
        return float(-np.mean(y * np.log(p) + (1 - y) * np.log(1 - p)))

    p, kept = quality_mil.forward(model, x, n)
    grads = quality_mil._gradients(model, p, y, kept)
    for k, g in grads.items():
        flat, own = model[k].ravel(), np.ravel(g)
        for i in range(0, len(flat), max(1, len(flat) // 7)):
            old = flat[i]
            flat[i] = old + 1e-6
            up = loss()
            flat[i] = old - 1e-6
            down = loss()
            flat[i] = old
            assert abs((up - down) / 2e-6 - own[i]) < 1e-5, k


def test_attention_matches_plain_loops():
    rng = np.random.default_rng(1)
    model = quality_mil.train([])
    for k in ("W", "V", "U", "w", "c", "b", "d", "mean"):
        model[k] = rng.normal(0, 0.5, np.shape(model[k]))
    texts = [odd.prose(i, 40 * i) for i in range(1, 8)] + [""]
    (_, _, buf, offs), = core.chunks(pa.array(texts))
    x, n = quality_mil.passages(buf, offs)
    got = quality_mil.forward(model, x, n)[0]
    at = 0
    for i, k in enumerate(n.tolist()):
        hidden, weight = [], []
        for row in x[at : at + k]:
            z = [min(8.0, max(-8.0, (v - m) / s)) for v, m, s in zip(row, model["mean"], model["scale"], strict=True)]
            h = [np.tanh(sum(z[a] * model["W"][a, b] for a in range(len(z))) + model["b"][b]) for b in range(quality_mil.HIDDEN)]
            gate = [np.tanh(sum(h[a] * model["V"][a, g] for a in range(len(h)))) / (1 + np.exp(-sum(h[a] * model["U"][a, g] for a in range(len(h))))) for g in range(quality_mil.GATE)]
            hidden.append(h)
            weight.append(np.exp(sum(g * w for g, w in zip(gate, model["w"], strict=True))))
        mean = [sum(w * h[b] for w, h in zip(weight, hidden, strict=True)) / sum(weight) for b in range(quality_mil.HIDDEN)]
        want = 1 / (1 + np.exp(-(sum(a * b for a, b in zip(mean, model["c"], strict=True)) + model["d"][0])))
        assert abs(got[i] - want) < 1e-9
        at += k


def test_hashed_words_match_plain_counts():
    words = ("red green red blue " * 60).split()
    (_, _, buf, offs), = core.chunks(pa.array([" ".join(words)]))
    x, n = quality_mil.passages(buf, offs)
    assert n.tolist() == [3]
    one = {}
    for w in set(words):  # the place and sign of a word, from a text of this word alone
        (_, _, b, o), = core.chunks(pa.array([w]))
        one[w] = quality_mil.passages(b, o)[0][0, len(quality_mil.FIGURES) :]
    pairs = {}
    for v, w in {(v, w) for v in words for w in words}:
        (_, _, b, o), = core.chunks(pa.array([f"{v} {w}"]))
        pairs[v, w] = quality_mil.passages(b, o)[0][0, len(quality_mil.FIGURES) :] * np.sqrt(2) - one[v] - one[w]
    for k in range(3):
        own = words[100 * k : 100 * k + 100]
        want = sum(one[w] for w in own) + sum(pairs[v, w] for v, w in zip(own, own[1:], strict=False))
        assert np.allclose(x[k, len(quality_mil.FIGURES) :] * np.sqrt(len(own)), want)


def test_ftrl_matches_plain_steps():
    """Weights and bias of the online fit, against the textbook step with a dictionary a coordinate."""
    import math

    rng = np.random.default_rng(5)
    examples = [(i, int(rng.random() < 0.4), np.unique(rng.integers(0, 64, 12))) for i in range(200)]
    good = sum(y for _, y, _ in examples)
    bias, seen, z, n = math.log((good + 0.5) / (200 - good + 0.5)), 1.0, {}, {}

    def weight(i: int) -> float:
        zi = z.get(i, 0.0)
        if abs(zi) <= toxicity.L1:
            return 0.0
        return (math.copysign(toxicity.L1, zi) - zi) / ((toxicity.BETA + math.sqrt(n[i])) / toxicity.ALPHA + toxicity.L2)

    for _ in range(3):
        for _, y, at in examples:
            w = {int(i): weight(int(i)) for i in at}
            g = 1 / (1 + math.exp(-(bias + sum(w.values())))) - y
            for i, wi in w.items():
                old = n.get(i, 0.0)
                z[i] = z.get(i, 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) / toxicity.ALPHA * wi
                n[i] = old + g * g
            seen += g * g
            bias -= toxicity.ALPHA * g / math.sqrt(seen)
    got_bias, got = toxicity._ftrl(examples, 6, 3)
    assert abs(got_bias - bias) < 1e-9
    assert np.allclose(got, [weight(i) if i in n else 0.0 for i in range(64)]) and np.count_nonzero(got) > 0


def test_passages_count_by_chunks():
    texts = pa.array([t for _, t, *_ in odd.documents()] + ["w " * 250])
    whole = np.concatenate([quality_mil.passages(b, o)[0] for _, _, b, o in core.chunks(texts, 1 << 40)])
    parts = [quality_mil.passages(b, o) for _, _, b, o in core.chunks(texts, 10)]
    assert np.allclose(whole, np.concatenate([x for x, _ in parts]))
    assert parts[-1][1].tolist() == [3] and all((n >= 1).all() for _, n in parts)


@pytest.mark.parametrize(("operator", "label", "modulus", "out"), [(toxicity.toxicity, "toxic", 3, 1), (quality_mil.quality, "quality", 4, 2)])
def test_classifiers(spark, small, operator, label, modulus, out):
    import zlib

    docs, labels = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet")
    got = operator(docs, labels).collect()
    assert len(got) == docs.count()
    truth = {r["doc_id"]: r[label] for r in labels.collect()}
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % modulus == out) for r in got)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)
    held = [(r["score"], truth[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in truth]
    above = [(a > b) + 0.5 * (a == b) for a, x in held for b, y in held if x > y]
    assert sum(above) / len(above) > 0.9
    # labels of the held-out fold are never read
    cheat = labels.withColumn(label, (1 - labels[label])).where(f"crc32(cast(cast(doc_id as string) as binary)) % {modulus} = {out}")
    honest = labels.where(f"crc32(cast(cast(doc_id as string) as binary)) % {modulus} <> {out}")
    assert sorted(map(tuple, operator(docs, honest.unionByName(cheat)).collect())) == sorted(map(tuple, got))


@pytest.mark.parametrize(("operator", "label"), [(toxicity.toxicity, "toxic"), (quality_mil.quality, "quality")])
def test_classifiers_on_odd_documents(spark, operator, label):
    none = spark.createDataFrame([], f"doc_id bigint, {label} int")
    some = spark.createDataFrame([(0, 1), (0, None), (None, 1), (1, 0), (2, 1), (6, 1), (8, 0), (999, 1), (4, 0), (4, 1)], f"doc_id bigint, {label} int")
    for labels in (none, some):
        got = operator(odd.frame(spark), labels).collect()
        assert len(got) == len(odd.documents())
        assert all(0 <= r["score"] <= 1 for r in got)
        assert not any(r["held_out"] for r in got if r["doc_id"] is None)
    assert operator(odd.frame(spark, []), none).collect() == []

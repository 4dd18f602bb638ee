from __future__ import annotations

import random

import numpy as np
import odd
import pyarrow as pa
import pytest

from palimpsest.llm import core, decontaminate, line_dedup, near_dedup, quality_rules, substring_dedup, toxicity


def test_words_and_hashes_follow_bytes():
    texts = [t for _, t, *_ in odd.documents()] + ["", None, "a b", "ab", "é è", "  x"]
    for limit in (1, 50, 1 << 20):
        got, hashes = [], {}
        for lo, hi, buf, offs in core.chunks(pa.array(texts, pa.string()), limit):
            s, e = core.runs(buf, offs, core.IS_WORD)
            at = core.row_spans(s, offs)
            h = core.hash_spans(buf, s, e, seg=64)
            for r in range(hi - lo):
                own = [bytes(buf[a:b]) for a, b in zip(s[at[r] : at[r + 1]], e[at[r] : at[r + 1]], strict=True)]
                got.append(own)
                for w, x in zip(own, h[at[r] : at[r + 1]].tolist(), strict=True):
                    assert hashes.setdefault(w, x) == x
        assert got == [odd.words(t) for t in texts]
        assert len(set(hashes.values())) == len(hashes)


def test_windows_equal_only_for_equal_sequences():
    rng = np.random.default_rng(0)
    h = core.mix(rng.integers(0, 4, 4000).astype(np.uint64))
    for width in (3, 15, 35):
        g = core.windows(h, width)
        seen: dict = {}
        for i in range(len(g)):
            assert seen.setdefault(int(g[i]), h[i : i + width].tobytes()) == h[i : i + width].tobytes()


def test_every_cover_is_one():
    for v, cover in substring_dedup.COVERS.items():
        for i in range(v):
            for j in range(v):
                assert any((i + k) % v in cover and (j + k) % v in cover for k in range(v))


@pytest.mark.parametrize(("window", "period"), [(35, 21), (20, 13), (9, 7)])
def test_substrings_match_brute_force(spark, window, period):
    rows = odd.documents()
    done = substring_dedup.remove_repeats(odd.frame(spark, rows), window, period)
    assert done.columns == [c for c in odd.frame(spark, rows).columns if c != "n_words"] + ["n_words", "n_removed"]
    want = sorted(zip([str(r[0]) for r in rows], odd.repeated_windows([r[1] for r in rows], window), strict=True))
    got = sorted((str(r["doc_id"]), (r["n_words"], r["n_removed"], r["text"])) for r in done.collect())
    assert got == want
    assert sum(w[1][1] for w in want) > 0


def test_substrings_over_many_blocks(spark, monkeypatch):
    rng = random.Random(5)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randrange(80))) for _ in range(60)]
    rows = [(i, t, *odd.REST) for i, t in enumerate(texts)]
    monkeypatch.setattr(substring_dedup, "BLOCK", 50)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["text"]) for r in substring_dedup.remove_repeats(odd.frame(spark, rows), 9, 7).collect()}
    assert got == dict(enumerate(odd.repeated_windows(texts, 9)))


def test_lines_match_brute_force(spark, monkeypatch):
    rows = [r for r in odd.documents() if r[0] is not None and r[1] is not None and r[0] not in (1, 7)]
    want = odd.deduped_lines([(r[0], r[1]) for r in rows], 3)
    assert sum(w[1] for w in want.values()) > 10
    for block in (2_000_000, 2):
        monkeypatch.setattr(line_dedup, "BLOCK", block)
        got = {r["doc_id"]: (r["n_lines"], r["n_removed"], r["text"]) for r in line_dedup.dedup_lines(odd.frame(spark, rows)).collect()}
        assert got == want


@pytest.mark.parametrize("name", ["hash_spans", "_second"])
def test_lines_survive_equal_hashes_of_other_windows(spark, monkeypatch, name):
    """One of the two hashes may fail, even wholly: no line goes by it alone."""
    hash_of = lambda buf, s, e: np.zeros(len(s), np.uint64)
    rows = [r for r in odd.documents() if r[0] is not None and r[1] is not None and r[0] not in (1, 7)]
    monkeypatch.setattr(core if name == "hash_spans" else line_dedup, name, hash_of)
    for block in (2_000_000, 2):
        monkeypatch.setattr(line_dedup, "BLOCK", block)
        got = {r["doc_id"]: (r["n_lines"], r["n_removed"], r["text"]) for r in line_dedup.dedup_lines(odd.frame(spark, rows)).collect()}
        assert got == odd.deduped_lines([(r[0], r[1]) for r in rows], 3)
    monkeypatch.setattr(line_dedup, "_second", hash_of)
    monkeypatch.setattr(core, "hash_spans", hash_of)
    both = {r["doc_id"]: r["n_removed"] for r in line_dedup.dedup_lines(odd.frame(spark, rows)).collect()}
    assert sum(both.values()) > sum(r[1] for r in got.values())  # the patches do reach the workers


def test_every_line_under_a_later_window_goes(spark, monkeypatch):
    """A passage goes from the first document of a group of copies too, and so does the pipeline's stage."""
    import corpus_pipeline

    passage = "\n".join(odd.prose(900 + i, 8) for i in range(4))
    copied = "\n".join([odd.prose(910, 8), odd.prose(911, 8), passage, odd.prose(912, 8), odd.prose(913, 8)])
    rows = [r for r in odd.documents() if r[0] is not None and r[1] is not None and r[0] not in (1, 7)]
    rows += [(100, passage, *odd.REST), (101, copied, *odd.REST), (102, copied, *odd.REST)]
    texts = [(r[0], r[1]) for r in rows]
    want = odd.deduped_lines(texts, 3)
    assert want[101][1] == 4
    for block in (2_000_000, 2):
        monkeypatch.setattr(line_dedup, "BLOCK", block)
        got = {r["doc_id"]: (r["n_lines"], r["n_removed"], r["text"]) for r in line_dedup.dedup_lines(odd.frame(spark, rows)).collect()}
        assert got == want
    staged = corpus_pipeline.line_stage(spark, odd.frame(spark, rows), "")
    assert {r["doc_id"]: r["text"] for r in staged.collect()} == {i: t for i, (_, _, t) in want.items()}


def test_lines_of_documents_with_text_ids(spark):
    """Which occurrence stays goes by a hash of the id then; as many lines go as with numbers."""
    rows = [r for r in odd.documents() if r[0] is not None and r[1] is not None and r[0] not in (1, 7)]
    numbers = odd.frame(spark, rows)
    texts = numbers.selectExpr("concat('id-', doc_id) as doc_id", *[c for c in numbers.columns if c != "doc_id"])
    got = line_dedup.dedup_lines(texts).collect()
    assert sum(r["n_lines"] for r in got) == sum(w[0] for w in odd.deduped_lines([(r[0], r[1]) for r in rows], 3).values())
    assert all(r["n_removed"] <= r["n_lines"] for r in got) and sum(r["n_removed"] for r in got) > 10


def test_lines_of_odd_documents(spark):
    got = line_dedup.dedup_lines(odd.frame(spark)).collect()
    assert len(got) == len(odd.documents())
    assert [r["text"] for r in got if r["doc_id"] == 3] == [None]
    assert len({(r["n_removed"], r["text"]) for r in got if r["doc_id"] == 1}) == 1
    assert {r["lang"] for r in got} == {"en"}


@pytest.mark.parametrize(("size", "percent"), [(4, 80), (5, 80), (1, 60)])
def test_near_duplicates_match_brute_force(spark, size, percent):
    rows = odd.documents()
    want = odd.groups([r[1] for r in rows], size, percent)
    least = {g: min((r[0] for r, h in zip(rows, want, strict=True) if h == g and r[0] is not None), default=None) for g in want}
    got = near_dedup.near_duplicates(odd.frame(spark, rows), size, percent).collect()
    expected = sorted((str(r[0]), len(odd.shingles(r[1], size)), str(least[g] if odd.shingles(r[1], size) else r[0])) for r, g in zip(rows, want, strict=True))
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in got) == expected
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


@pytest.mark.parametrize("block", [5, 500_000])
def test_near_duplicates_in_drifting_groups(spark, monkeypatch, block):
    """Chains of edits, whose ends are far apart, in one large group, over several blocks."""
    rng = random.Random(1)
    texts = []
    for g in range(3):
        w = odd.prose(100 + g, 120).split()
        for _ in range(60):
            for _ in range(rng.choice([1, 2, 3])):
                w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
            texts.append(" ".join(w))
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    monkeypatch.setattr(core, "EDGE_BLOCK", block)
    rows = [(i, t, *odd.REST) for i, t in enumerate(texts)]
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(odd.frame(spark, rows), 4).collect()}
    assert got == dict(enumerate(odd.groups(texts, 4, 80)))


def test_pages_of_one_template(spark, monkeypatch):
    """Pages that share most words and have a text of their own each are not compared in pairs; groups are as by brute force."""
    rng = random.Random(4)
    shared, texts = odd.prose(500, 100), []
    for i in range(150):
        texts.append(shared + " " + odd.prose(5000 + i, 17 if i % 3 else 40))
    texts += [shared + " " + odd.prose(7000 + i // 4, 17) + (" end" if i % 4 else "") for i in range(40)]
    texts += [shared, shared + " one more", " ".join(shared.split()[:85])]
    rng.shuffle(texts)
    rows = [(i, t, *odd.REST) for i, t in enumerate(texts)]
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(odd.frame(spark, rows), 4).collect()}
    assert got == dict(enumerate(odd.groups(texts, 4, 80)))


def test_only_possible_links_are_heavy(spark):
    """No link has two light ends, and none has an end that is left out."""
    rng = random.Random(8)
    sets = {i: frozenset(rng.sample(range(40), rng.randrange(20, 40))) | {1000 + 50 * i + k for k in range(rng.randrange(0, 9))} for i in range(60)}
    held = spark.createDataFrame([(i, np.array(sorted(x), np.int64).tobytes()) for i, x in sets.items()], "node bigint, shingles binary")
    some = spark.createDataFrame([(i, len(x)) for i, x in sets.items()], "node bigint, n bigint")
    heavy = {r["node"]: r["heavy"] for r in near_dedup._heavy(some, held, 80).collect()}
    links = [(a, b) for a in sets for b in range(a) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    assert links and all(a in heavy and b in heavy and (heavy[a] or heavy[b]) for a, b in links)
    assert not all(heavy.values())


@pytest.mark.parametrize("block", [3, 500_000])
def test_components(spark, monkeypatch, block):
    """Blocks of three edges, which take many rounds, and one block."""
    monkeypatch.setattr(core, "EDGE_BLOCK", block)
    rng = random.Random(2)
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(300)] + [(i, i + 1) for i in range(1000, 1080)]
    parent = {x: x for p in pairs for x in p}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    got = {r["node"]: r["component"] for r in core.components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    assert got == {x: find(x) for x in parent if any(x in p and p[0] != p[1] for p in pairs)}


@pytest.mark.parametrize("operator", [substring_dedup.remove_repeats, line_dedup.dedup_lines, near_dedup.near_duplicates])
def test_empty_tables(spark, operator):
    assert operator(odd.frame(spark, [])).collect() == []


def test_worker_code_is_small_when_pickled():
    """Tables that hashing makes on the driver do not go along with functions pickled by value."""
    from pyspark import cloudpickle

    buf, at, to = np.frombuffer(b"ab cd ab", np.uint8), np.array([0, 3, 6]), np.array([2, 5, 8])
    here = core.hash_spans(buf, at, to)
    for f in (core.hash_spans, quality_rules._figures(), decontaminate._item_windows(8), toxicity._encode(20)):
        assert len(cloudpickle.dumps(f)) < 500_000
    assert (cloudpickle.loads(cloudpickle.dumps(core.hash_spans))(buf, at, to) == here).all()

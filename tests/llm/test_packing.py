from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import odd
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from palimpsest.llm import packing
from palimpsest.llm.queries import vocabulary

EXACT = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
ENCODE = packing.encoder(**vocabulary())


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=200))
def test_ids_are_those_of_the_tokenizer(text):
    assert ENCODE([text]) == [EXACT.encode(text, add_special_tokens=False).ids]


def check(windows: list[list], docs: dict[int, np.ndarray], size: int) -> None:
    pieces = defaultdict(list)
    for w in windows:
        total = sum(len(p[2]) for p in w)
        assert total == size or total < size and total & (total - 1) == 0
        for doc, start, ids in w:
            pieces[doc].append((start, ids))
    for doc, ids in docs.items():
        own = sorted(pieces[doc], key=lambda p: p[0])
        assert [s for s, _ in own] == np.cumsum([0] + [len(x) for _, x in own])[:-1].tolist()
        assert np.concatenate([x for _, x in own]).tolist() == ids.tolist()


@pytest.mark.parametrize(("size", "windows"), [(1024, 64), (64, 4), (8, 1)])
def test_packer_loses_nothing_and_pads_nothing(size, windows):
    rng = random.Random(size)
    docs = {i: np.arange(rng.choice([1, 3, size // 2, size, size + 1, 5 * size, rng.randrange(1, 3 * size)])) for i in range(500)}
    packer, out = packing.Packer(size, windows), []
    for i, ids in docs.items():
        out += packer.add(i, ids)
        assert len(packer.windows) <= windows
    check(out + list(packer.finish()), docs, size)


def test_pieces_of_odd_documents(spark):
    rows = odd.documents()
    got = packing.pack(odd.frame(spark, rows), **vocabulary()).collect()
    want = sorted(str((r[0], EXACT.encode(r[1] or "", add_special_tokens=False).ids + [0])) for r in rows)
    by_sequence, made = defaultdict(list), defaultdict(list)
    for r in got:
        by_sequence[r["sequence_id"]].append(r)
        made[r["doc_id"]].append(r)
        assert r["length"] * 4 == len(r["ids"])
    for rows_ in by_sequence.values():
        rows_.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in rows_] == np.cumsum([0] + [r["length"] for r in rows_])[:-1].tolist()
        total = sum(r["length"] for r in rows_)
        assert total == 1024 or total & (total - 1) == 0
    single = [d for d in made if sum(1 for r in rows if r[0] == d) == 1]
    texts = [str((d, np.frombuffer(b"".join(r["ids"] for r in sorted(made[d], key=lambda r: r["start"])), "<u4").tolist())) for d in single]
    assert set(texts) <= set(want)
    assert sum(r["length"] for r in got) == sum(len(EXACT.encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in rows)


def test_query(spark, tiny):
    from palimpsest.llm.queries import op1_packing

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()}
    got = op1_packing(spark, tiny).collect()
    ids = {i: np.array(EXACT.encode(t, add_special_tokens=False).ids + [0], "<u4") for i, t in texts.items()}
    assert all(r["ids_crc32"] == zlib.crc32(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]].tobytes()) and r["doc_tokens"] == len(ids[r["doc_id"]]) for r in got)
    again = op1_packing(spark, tiny).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


@pytest.mark.parametrize("text", [" " * 1_000_000, "\n" * 1_000_000, "a" * 200_000, "7" * 200_000, "-" * 200_000, "a" + " \t" * 300_000 + "b", "\u00a0" * 200_000, "'" * 200_000])
def test_very_long_runs(text):
    assert ENCODE([text]) == [EXACT.encode(text, add_special_tokens=False).ids]


def test_empty_table(spark):
    assert packing.pack(odd.frame(spark, []), **vocabulary()).collect() == []

from __future__ import annotations

import random

import odd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from palimpsest.llm import core, queries


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory) -> str:
    """Planted documents among clean ones, odd ones included."""
    rng = random.Random(9)
    texts = [odd.prose(i, 80 + i % 60).replace(" ", ". ", 3) for i in range(120)]
    texts = ["\n".join(" ".join(w[k : k + 12]) for k in range(0, len(w), 12)) for w in (t.split() for t in texts)]
    for i in range(0, 20, 2):  # near copies of the document before
        w = texts[i].split(" ")
        w[rng.randrange(len(w))] = "edited"
        texts[i + 1] = " ".join(w)
    for i in range(50, 60, 2):  # and of texts without lines
        w = odd.prose(3000 + i, 110).split(" ")
        texts[i] = " ".join(w)
        w[rng.randrange(20, 90)] = "edited"
        texts[i + 1] = " ".join(w)
    shared = "\n".join(odd.prose(700 + k, 9) for k in range(4))
    for i in range(30, 36):
        texts[i] += "\n" + shared
    question = odd.prose(800, 40)
    texts[40] += " " + question
    texts[41] = "*** ".join(texts[41].split()) + " | | |"
    texts[42] = "again and again " * 60
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)] + [(0, texts[0], "en", "s", 1), (None, None, None, None, None), (500, "", "en", "s", 0), (None, odd.prose(900, 90), "en", "s", 0)]
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(2).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, question), (2, None)], "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages_match_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "line_dedup", "near_dedup", "decontamination", "packing"]
    columns = docs.columns

    good = core.cut(corpus_pipeline.STAGES[0][1](spark, docs, folder))
    ids = {r["doc_id"] for r in good.collect()}
    assert good.columns == columns
    assert set(range(120)) - ids == {41, 42} and 500 not in ids

    lines = core.cut(corpus_pipeline.STAGES[1][1](spark, good, folder))
    assert lines.columns == columns
    once = {r["doc_id"]: r["text"] for r in good.collect() if r["doc_id"] is not None}
    got = {r["doc_id"]: r["text"] for r in lines.collect() if r["doc_id"] is not None}
    want = {i: t for i, (_, _, t) in odd.deduped_lines(list(once.items()), 3).items()}
    assert got == want and sum(got[i] != once[i] for i in got) >= 10

    near = core.cut(corpus_pipeline.STAGES[2][1](spark, lines, folder))
    rows = sorted(((r["doc_id"], r["text"]) for r in lines.dropDuplicates(["doc_id", "text"]).collect()), key=lambda r: (r[0] is None, r[0] or 0))
    first = odd.groups([t for _, t in rows], 5, 80)
    assert sorted(str(rows[k]) for k in set(first)) == sorted(str((r["doc_id"], r["text"])) for r in near.collect())
    assert len(set(first)) == len(rows) - 5

    clean = core.cut(corpus_pipeline.STAGES[3][1](spark, near, folder))
    assert {r["doc_id"] for r in near.collect()} - {r["doc_id"] for r in clean.collect()} == {40}

    pieces = corpus_pipeline.STAGES[4][1](spark, clean, folder)
    sums = pieces.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("m")).where("doc_id is not null")
    assert sums.where("n <> m").isEmpty() and sums.count() == clean.where("doc_id is not null").count()


def test_stages_on_odd_documents(spark, folder):
    """Nulls everywhere, repeated rows, and columns named as operators name theirs: no crash, columns as they were."""
    docs = odd.frame(spark).withColumns({"n_removed": F.lit("mine"), "component_id": F.lit(5), "label": F.lit(None).cast("string")})
    for frame in (docs, docs.limit(0), docs.withColumns({c: F.lit(None).cast(t) for c, t in docs.dtypes})):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, frame, folder)
            if name != "packing":
                assert out.columns == frame.columns
                assert {r["n_removed"] for r in out.collect()} <= {r["n_removed"] for r in frame.collect()}
            else:
                assert out.select("doc_id").distinct().count() == frame.select("doc_id").distinct().count()


def test_run_is_all_stages(spark, folder):
    got = corpus_pipeline.run(spark, folder)
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert got.count() > 50
    assert corpus_pipeline.ORACLE_SQL is None


def test_every_operator_has_a_query():
    names = list(queries.queries())
    assert [n for n in names if n.startswith("op")] == [next(x for x in names if x.startswith(f"op{k}_")) for k in range(1, 11)]
    assert "pipeline" in names
    assert set(queries.oracle_sql()) <= set(names)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracles(spark, tiny, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for table in ("documents", "pages"):
        con.sql(f"create view {table} as select * from '{tiny}/{table}.parquet'")
    want = con.sql(queries.oracle_sql()[name])
    order = sorted(want.columns)
    rows = sorted(repr(tuple(r[want.columns.index(c)] for c in order)) for r in want.fetchall())
    got = queries.queries()[name](spark, tiny)
    assert sorted(got.columns) == order
    assert sorted(repr(tuple(r[c] for c in order)) for r in got.collect()) == rows

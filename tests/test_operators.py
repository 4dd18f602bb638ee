from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.functions.temporal import as_of
from palimpsest.model import INFINITY, Attribute, Axis, Entity, QueryError, Relationship
from palimpsest.operators import backfill, diff, director, relate, rules, writes
from palimpsest.sources import store
from palimpsest.streaming import fold_sink

INT, DOUBLE, STRING = T.IntegerType(), T.DoubleType(), T.StringType()
B, P = Axis("businessDate", "FROM_Z", "THRU_Z"), Axis("processingDate", "IN_Z", "OUT_Z", default=INFINITY)
E = Entity("Balance", (Attribute("id", INT, key=True), Attribute("q", DOUBLE), Attribute("label", STRING)), B, P)
CUT = Entity("Balance", E.attributes, B, Axis("processingDate", "IN_Z", "OUT_Z", default=INFINITY, future_expiring=False))
AUDIT = Entity("Audit", E.attributes, processing=P)
HOLD = Entity("Hold", E.attributes, business=B)
LOG = "id int, op string, b timestamp_ntz, u timestamp_ntz, p timestamp_ntz, seq int, q double, label string, p_to timestamp_ntz"
B0, B1, B2, B3 = (dt.datetime(2026, m, 1) for m in (1, 3, 6, 9))
P0, P1, P2 = dt.datetime(2026, 3, 1, 9), dt.datetime(2026, 3, 2, 9), dt.datetime(2026, 3, 3, 9)
INF = INFINITY


def log(spark, *rows):
    full = [(1, op, b, u, p, n, q, None, rest[0] if rest else None) for n, (op, b, u, p, q, *rest) in enumerate(rows)]
    return spark.createDataFrame(full, LOG)


def rects(df, e=E):
    return sorted(tuple(r) for r in df.select("q", *e.bounds).collect())


GOLDEN = {
    "update": ([("insert", B0, None, P0, 10.0), ("update", B2, None, P1, 55.0)], [(10.0, B0, INF, P0, P1), (10.0, B0, B2, P1, INF), (55.0, B2, INF, P1, INF)]),
    "terminate": ([("insert", B0, None, P0, 10.0), ("terminate", B2, None, P1, None)], [(10.0, B0, INF, P0, P1), (10.0, B0, B2, P1, INF)]),
    "update_until": ([("insert", B0, None, P0, 10.0), ("update_until", B1, B2, P1, 55.0)], [(10.0, B0, INF, P0, P1), (10.0, B0, B1, P1, INF), (10.0, B2, INF, P1, INF), (55.0, B1, B2, P1, INF)]),
    "terminate_until": ([("insert", B0, None, P0, 10.0), ("terminate_until", B1, B2, P1, None)], [(10.0, B0, INF, P0, P1), (10.0, B0, B1, P1, INF), (10.0, B2, INF, P1, INF)]),
    "increment": ([("insert", B0, None, P0, 10.0), ("increment", B1, None, P1, 5.0)], [(10.0, B0, INF, P0, P1), (10.0, B0, B1, P1, INF), (15.0, B1, INF, P1, INF)]),
    "increment_until": ([("insert", B0, None, P0, 10.0), ("increment_until", B0, B2, P1, 5.0)], [(10.0, B0, INF, P0, P1), (10.0, B2, INF, P1, INF), (15.0, B0, B2, P1, INF)]),
    "insert_with_increment_until": ([("insert", B1, None, P0, 10.0), ("insert_with_increment_until", B0, B2, P1, 5.0)], [(5.0, B0, B1, P1, INF), (10.0, B1, INF, P0, P1), (10.0, B2, INF, P1, INF), (15.0, B1, B2, P1, INF)]),
    "insert_with_increment": ([("insert", B1, None, P0, 10.0), ("insert_with_increment", B0, None, P1, 5.0)], [(5.0, B0, B1, P1, INF), (10.0, B1, INF, P0, P1), (15.0, B1, INF, P1, INF)]),
    "zero length": ([("insert_until", B0, B0, P0, 1.0)], [(1.0, B0, B0, P0, INF)]),
    "in place": ([("insert", B0, None, P0, 10.0), ("in_place", B1, None, P1, 7.0)], [(7.0, B0, INF, P0, INF)]),
    "purge": ([("insert", B0, None, P0, 10.0), ("update", B1, None, P1, 5.0), ("purge", B1, None, P2, None)], []),
    "archive": ([("insert", B0, None, P0, 10.0), ("archive", B1, B3, P1, None, P2)], [(10.0, B0, B3, P0, P2)]),
    "recover": ([("recover", B0, B1, P0, 3.0, P1)], [(3.0, B0, B1, P0, P1)]),
    "same instant, later date": ([("insert", B0, None, P0, 10.0), ("update", B2, None, P0, 20.0)], [(10.0, B0, B2, P0, INF), (20.0, B2, INF, P0, INF)]),
    "same instant, same date": ([("insert", B0, None, P0, 10.0), ("update", B0, None, P0, 20.0)], [(20.0, B0, INF, P0, INF)]),
    "second life": ([("insert", B0, None, P0, 10.0), ("terminate", B1, None, P1, None), ("insert", B2, None, P2, 4.0)], [(4.0, B2, INF, P2, INF), (10.0, B0, B1, P1, INF), (10.0, B0, INF, P0, P1)]),
}


@pytest.mark.parametrize("name", GOLDEN)
def test_golden_rectangles(spark, name):
    rows, want = GOLDEN[name]
    out = director.fold(E, log(spark, *rows))
    assert rects(out) == sorted(want)
    assert director.history_overlaps(E, out).isEmpty()


def test_late_facts(spark):
    start = [("insert", B0, None, P0, 10.0), ("update", B2, None, P1, 20.0)]
    for late, june in ((("update", B1, None, P2, 15.0), 15.0), (("update_until", B1, B2, P2, 15.0), 20.0)):
        out = director.fold(E, log(spark, *start, late))

        def value(b, p, out=out):
            return [r["q"] for r in as_of(out, E, b, p).collect()]

        assert value(B1, INF) == [15.0] and value(B2, INF) == [june]
        assert value(B1, P1) == [10.0] and value(B2, P1) == [20.0]


def test_ends_are_cut_where_no_row_expires_in_the_future(spark):
    out = director.fold(CUT, log(spark, ("insert", B0, None, P0, 10.0), ("update", B2, None, P1, 55.0)))
    assert (10.0, B0, P1 + dt.timedelta(days=1), P0, P1) in rects(out)


@pytest.mark.parametrize(("rows", "code"), [
    ([("insert", B0, None, P0, 1.0), ("insert", B1, None, P1, 1.0)], "DIR-002"), ([("insert", B0, None, P0, 1.0), ("insert_with_increment", B1, None, P1, 1.0)], "DIR-001"),
    ([("recover", B0, B0, P0, 1.0, P1)], "DIR-003"), ([("frobnicate", B0, None, P0, 1.0)], "DIR-004"),
])
def test_refusals(spark, rows, code):
    with pytest.raises(Exception, match=code):
        director.fold(E, log(spark, *rows)).collect()
    if code == "DIR-002":
        held = director.fold(E, log(spark, rows[0]))
        assert director.insert_conflicts(E, held, log(spark, rows[1])).count() == 1


def test_one_axis(spark):
    rows = [("insert", B0, None, P0, 10.0), ("update", B1, None, P1, 20.0), ("terminate", B2, None, P2, None)]
    assert rects(director.fold(AUDIT, log(spark, *rows)), AUDIT) == [(10.0, P0, P1), (20.0, P1, P2)]
    assert rects(director.fold(HOLD, log(spark, *rows)), HOLD) == [(10.0, B0, B1), (20.0, B1, B2)]


def test_payload_that_is_not_set_stays(spark):
    rows = [(1, "insert", B0, None, P0, 0, 1.0, "a", None), (1, "update", B1, None, P1, 1, None, "b", None)]
    got = director.fold(E, spark.createDataFrame(rows, LOG)).select("q", "label", "FROM_Z").collect()
    assert (1.0, "b", B1) in {tuple(r) for r in got}


def random_log(seed: int, kind: str) -> list[tuple]:
    rng = random.Random(seed)
    out = []
    for key in range(6):
        out.append((key, "insert", dt.datetime(2020, 1, 1), None, dt.datetime(2020, 1, 1), 0, 0.0, None, None))
        for n in range(rng.randrange(1, 9)):
            b = dt.datetime(2020, 1, 1) + dt.timedelta(days=rng.randrange(400))
            until = rng.random() < 0.4
            op = rng.choice({"updates": ["update"], "ends": ["update", "update", "terminate"], "increments": ["increment"]}[kind]) + ("_until" if until else "")
            out.append((key, op, b, b + dt.timedelta(days=rng.randrange(1, 200)) if until else None, dt.datetime(2020, 1, 2) + dt.timedelta(hours=n * 24 + rng.randrange(24)), n + 1, float(rng.randrange(100)), None, None))
    return out


@pytest.mark.parametrize("kind", ["updates", "ends", "increments"])
def test_fold_tick_and_log_agree(spark, kind):
    rows = random_log(len(kind), kind)
    full = spark.createDataFrame(rows, LOG)
    folded = director.fold(E, full).cache()
    assert director.history_overlaps(E, folded).isEmpty()
    ticked = director.fold(E, full.where("seq = 0"))
    for n in range(1, max(r[5] for r in rows) + 1):
        step = director.tick(E, ticked, full.where(F.col("seq") == n)).collect()
        ticked = spark.createDataFrame(step, E.schema())
    assert rects(ticked) == rects(folded)
    rng = random.Random(1)
    for _ in range(4):
        b, p = dt.datetime(2020, 1, 1) + dt.timedelta(days=rng.randrange(500)), dt.datetime(2020, 1, 1) + dt.timedelta(hours=rng.randrange(300))
        a = sorted(tuple(r) for r in as_of(folded, E, b, p).select("id", "q").collect())
        assert a == sorted(tuple(r) for r in director.value_as_of(full, ["id"], b, p, "q").collect())


def test_writes(spark):
    e = Entity("Row", (Attribute("k", INT, key=True), Attribute("v", STRING)))
    held = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], e.schema())

    def table(*rows):
        return spark.createDataFrame(list(rows), e.schema())

    def rows(df):
        return sorted(map(tuple, df.collect()), key=str)

    assert rows(writes.insert(e, held, table((4, "d")))) == [(1, "a"), (2, None), (3, "c"), (4, "d")]
    for bad in (table((1, "x")), table((5, "x"), (5, "y"))):
        with pytest.raises(QueryError, match="WRITE-001"):
            writes.insert(e, held, bad)
    assert rows(writes.update(e, held, table((2, None)), table((2, "b")))) == [(1, "a"), (2, "b"), (3, "c")]
    with pytest.raises(QueryError, match="WRITE-002"):
        writes.update(e, held, table((1, "old")), table((1, "b")))
    with pytest.raises(QueryError, match="WRITE-003"):
        writes.update(e, held, table((1, "a")), table((9, "b")))
    assert rows(writes.delete(e, held, table((2, None)))) == [(1, "a"), (3, "c")]
    with pytest.raises(QueryError, match="WRITE-002"):
        writes.delete(e, held, table((2, "stale")))
    assert rows(writes.delete(e, held, table((2, "stale"), (1, "a")), quietly=True)) == [(2, None), (3, "c")]
    assert rows(writes.upsert(e, held, table((2, "z"), (7, "n")))) == [(1, "a"), (2, "z"), (3, "c"), (7, "n")]
    with pytest.raises(QueryError, match="WRITE-004"):
        writes.upsert(e, held, table((2, "z"), (2, "y")))
    assert rows(writes.purge(e, held, table((1, None)))) == [(2, None), (3, "c")]
    assert rows(writes.delete_where(held, F.col("v") == "a")) == [(2, None), (3, "c")]
    assert rows(writes.update_where(held, F.col("v") != "a", {"v": F.lit("w")})) == [(1, "a"), (2, None), (3, "w")]
    staged = spark.createDataFrame([(1, 1, "x"), (1, 3, "z"), (1, 2, "y"), (2, 1, None)], "k int, seq int, v string")
    assert rows(writes.fold_staged(staged, ["k"], "seq").select("k", "v")) == [(1, "z"), (2, None)]


def test_diff(spark):
    e = Entity("Row", (Attribute("k", INT, key=True), Attribute("v", STRING)), processing=P)

    def table(*rows):
        return spark.createDataFrame([(k, v, P0, o) for k, v, o in rows], e.schema())

    want = table((1, "a", INF), (2, None, INF), (3, "c", INF), (4, "d", P1))
    got = table((1, "a", INF), (2, "b", P1), (4, "d", INF), (5, None, INF))
    found = sorted((r["k"], r["kind"], r["column"] or "") for r in diff.compare(e, want, got).collect())
    # a row with another end is another row
    assert found == [(2, "EXTRA", ""), (2, "MISSING", ""), (3, "MISSING", ""), (4, "EXTRA", ""), (4, "MISSING", ""), (5, "EXTRA", "")]
    other = table((1, "x", INF), (2, None, INF), (3, "c", INF), (4, "d", P1))
    assert [tuple(r) for r in diff.compare(e, want, other).select("k", "kind", "column", "expected", "actual").collect()] == [(1, "VALUE", "v", "a", "x")]
    with pytest.raises(Exception, match="DIFF-001"):
        diff.compare(e, want, want.unionByName(want)).collect()
    assert diff.compare(e, want, want).isEmpty()
    assert tuple(diff.verify(e, want, want).first()) == (4, 4, 0, True)
    assert tuple(diff.verify(e, want.limit(0), want).first()) == (0, 0, 0, False)
    with pytest.raises(QueryError, match="DIFF-001"):
        diff.require_unique(e, want.unionByName(want))


def test_versioned_table(spark, tmp_path):
    t = store.VersionedTable(spark, str(tmp_path / "t"))
    assert not t.exists() and t.commit(spark.range(3).toDF("x")) == 1
    assert t.commit(t.read().where("x > 0")) == 2
    assert t.read().count() == 2 and t.read(1).count() == 3
    with pytest.raises(QueryError, match="TXN-004"):
        t.commit(spark.range(9).toDF("x"), after=1)
    assert t.read().count() == 2
    root = str(tmp_path / "many")
    store.commit_all(spark, root, {"a": spark.range(1).toDF("x"), "b": spark.range(2).toDF("x")})
    store.VersionedTable(spark, root, "a").commit(spark.range(5).toDF("x"))
    assert [store.VersionedTable(spark, root, n).read().count() for n in "ab"] == [5, 2]
    with pytest.raises(QueryError, match="TXN-001"):
        store.VersionedTable(spark, root, "c").read()


def test_backfill(spark, tmp_path):
    rows = director.fold(E, spark.createDataFrame(random_log(3, "updates"), LOG)).cache()
    target = store.VersionedTable(spark, str(tmp_path / "target"))
    done = backfill.Checkpoint(spark, str(tmp_path / "done"), "s1")
    first = backfill.run(E, rows.where("id < 3"), target, done)
    assert first.verified and first.rows_read == rows.where("id < 3").count() and first.skipped_keys == 0
    again = backfill.run(E, rows, target, done)
    assert again.verified and again.skipped_keys == 3
    assert diff.compare(E, rows, target.read()).isEmpty()
    with pytest.raises(QueryError, match="FILL-001"):
        backfill.run(E, rows, target, backfill.Checkpoint(spark, str(tmp_path / "done"), "s2"))
    with pytest.raises(QueryError, match="DIFF-001"):
        backfill.run(E, rows.unionByName(rows), target)
    with pytest.raises(QueryError, match="FILL-002"):
        backfill.run(E, spark.createDataFrame(rows.withColumn("THRU_Z", F.lit(None).cast("timestamp_ntz")).collect(), rows.withColumn("THRU_Z", F.lit(None).cast("timestamp_ntz")).schema), target)
    empty = store.VersionedTable(spark, str(tmp_path / "empty"))
    assert not backfill.run(E, rows.limit(0), empty).verified
    assert backfill.run(E, rows.limit(0), empty, empty_ok=True).verified


def test_streamed_log(spark, tmp_path):
    rows = random_log(8, "ends")
    source, target = str(tmp_path / "log"), store.VersionedTable(spark, str(tmp_path / "target"))
    full = spark.createDataFrame(rows, LOG)
    for n in range(3):
        full.where(F.col("seq") == 0 if n == 0 else (F.col("seq") > 0) & (F.col("seq") < 4) if n == 1 else F.col("seq") >= 4).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(full.schema).parquet(source)
        q = fold_sink.write(E, stream, target, str(tmp_path / "checkpoint"), availableNow=True)
        q.awaitTermination()
    assert rects(target.read()) == rects(director.fold(E, full))
    held = target.version()
    fold_sink.apply_batch(E, target, full, 2)  # delivered again
    assert target.version() == held


def test_navigation(spark):
    child = Entity("Entry", (Attribute("entry", INT, key=True), Attribute("id", INT), Attribute("amount", DOUBLE)), B, P)
    rel = Relationship("entries", "Entry", (("id", "id"),))
    parents = spark.createDataFrame([(1, 1.0, "a", B0, INF, P0, INF), (2, 1.0, "b", B0, INF, P0, INF)], E.schema())
    kids = spark.createDataFrame([(10, 1, 5.0, B0, INF, P0, P1), (10, 1, 6.0, B0, INF, P1, INF), (11, 1, 7.0, B0, B1, P0, INF)], child.schema())
    fetched = {r["id"]: sorted(x["amount"] for x in r["kids"]) for r in relate.deep_fetch(rel, parents, child, kids, "kids", B0, P0).collect()}
    assert fetched == {1: [5.0, 7.0], 2: []}
    assert {r["id"]: len(r["kids"]) for r in relate.deep_fetch(rel, parents, child, kids, "kids", B2).collect()} == {1: 1, 2: 0}
    assert [r["id"] for r in relate.exists(rel, parents, kids, F.col("amount") > 6.5).collect()] == [1]
    assert [r["id"] for r in relate.not_exists(rel, parents, kids).collect()] == [2]
    both = relate.temporal_join(E, parents, child, kids, [("id", "id")])
    assert sorted(r["r_amount"] for r in both.collect()) == [5.0, 6.0, 7.0]
    down = director.cascade(spark.createDataFrame([(1, "terminate", B1, P2)], "id int, op string, b timestamp_ntz, p timestamp_ntz"), kids, [("id", "id")], ["entry"])
    assert sorted(r["entry"] for r in down.collect()) == [10, 11]


def test_decision_tables(spark):
    held = spark.createDataFrame([(1, "r1", 5, "LOW", True), (2, "r2", 5, "TIE", True), (3, "r3", 9, "OFF", False), (4, "r4", 99, "BARE", True)], "rule_id int, rule_name string, priority int, label string, active boolean")
    kind = "rule_id int, attribute string, operator string, text string, low double, high double"
    criteria = spark.createDataFrame([(1, "x", "LT", None, 5.0, None), (2, "x", "LT", None, 6.0, None), (2, "s", "IN", "a , b", None, None), (3, "x", "GT", None, 0.0, None)], kind)
    rows = spark.createDataFrame([(1, 3.0, "a"), (2, 5.5, "b"), (3, 9.0, "a"), (4, None, "a"), (5, 5.5, "c")], "k int, x double, s string")
    got = {r["k"]: (r["rule_id"], r["label"]) for r in rules.classify(rows, ["k"], held, criteria, ["x"], ["s"]).collect()}
    assert got == {1: (1, "LOW"), 2: (2, "TIE"), 3: (0, "UNCLASSIFIED"), 4: (0, "UNCLASSIFIED"), 5: (0, "UNCLASSIFIED")}
    with pytest.raises(ValueError, match="RULE-001"):
        rules.classify(rows, ["k"], held, spark.createDataFrame([(1, "s", "LT", "a", None, None)], kind), ["x"], ["s"])


def test_tick_refuses_what_fold_refuses(spark):
    base = (1, "insert", B1, None, P0, 0, 1.0, "a", None)
    held = director.fold(E, spark.createDataFrame([base], LOG))
    for row, code in (((1, "insert", B1, None, P1, 1, 2.0, "b", None), "DIR-002"), ((1, "insert_with_increment", B1, None, P1, 1, 2.0, "b", None), "DIR-001")):
        for apply in (lambda log: director.fold(E, log, held), lambda log: director.tick(E, held, log)):
            with pytest.raises(Exception, match=code):
                apply(spark.createDataFrame([row], LOG)).collect()
    two = spark.createDataFrame([(1, "update", B1, None, P1, 1, 2.0, "b", None), (1, "update", B1, None, P1, 2, 3.0, "c", None)], LOG)
    with pytest.raises(Exception, match="DIR-006"):
        director.tick(E, held, two).collect()


def test_overlaps_match_all_pairs(spark):
    """Random rectangles of a few keys, closed and open ones and some of zero length, against a comparison of all pairs."""
    rng = random.Random(3)
    day = lambda n: dt.datetime(2000, 1, 1) + dt.timedelta(days=n)
    made = []
    for k in range(12):
        for _ in range(rng.randrange(1, 14)):
            f, i = rng.randrange(60), rng.randrange(60)
            made.append((k, 1.0, "x", day(f), day(f + rng.randrange(15)), day(i), INF if rng.random() < 0.2 else day(i + rng.randrange(15))))
    rows = spark.createDataFrame([(m[0], m[1], m[2], *m[3:]) for m in made], E.schema())
    live = sorted((m for m in made if m[3] < m[4] and m[5] < m[6]), key=lambda m: (m[0], m[5], m[3], m[4], m[6]))
    want = [x for n, x in enumerate(live) if any(y[0] == x[0] and y[3] < x[4] and y[4] > x[3] and y[5] < x[6] and y[6] > x[5] for y in live[:n])]
    got = director.history_overlaps(E, rows).collect()
    assert len(got) == len(want) > 10
    assert sorted(tuple(r) for r in got) == sorted(want)

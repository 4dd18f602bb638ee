"""Mutation logs folded into rectangles, held against closed forms on the logs."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.temporal import as_of, encode
from palimpsest.model import INFINITY, Attribute, Axis, Entity
from palimpsest.operators import director
from palimpsest.queries import INF, TEXT, belief_log, query
from palimpsest.queries.temporal import B, P, asof_sql
from palimpsest.sources.tables import table
from palimpsest.views import BELIEF, BUSINESS, DOUBLE, LONG, PROCESSING, belief_log as log_of

_B, _P = "TIMESTAMP '1998-06-01'", "TIMESTAMP '1999-01-01'"
_COVER = f"b <= {_B} AND u > {_B} AND p <= {_P}"
_ENDS = f"SELECT o_custkey, arg_max(value, p) AS value FROM (SELECT *, bool_or(op LIKE 'terminate%') OVER (PARTITION BY o_custkey) AS ended FROM log WHERE {_COVER}) WHERE NOT ended GROUP BY o_custkey"
_SUMS = f"SELECT o_custkey, round(sum(value), 2) AS value FROM log WHERE {_COVER} GROUP BY o_custkey"


@query("director_updates", f"WITH {belief_log('updates')} {asof_sql(_B, _P)}")
def director_updates(spark: SparkSession, d: str) -> DataFrame:
    return as_of(director.fold(BELIEF, log_of(spark, d, "updates")), BELIEF, B, P).select("o_custkey", "value")


@query("director_terminates", f"WITH {belief_log('ends')} {_ENDS}")
def director_terminates(spark: SparkSession, d: str) -> DataFrame:
    return as_of(director.fold(BELIEF, log_of(spark, d, "ends")), BELIEF, B, P).select("o_custkey", "value")


@query("director_increments", f"WITH {belief_log('increments')} {_SUMS}")
def director_increments(spark: SparkSession, d: str) -> DataFrame:
    return as_of(director.fold(BELIEF, log_of(spark, d, "increments")), BELIEF, B, P).select("o_custkey", F.round("value", 2).alias("value"))


@query("log_as_of_updates", f"WITH {belief_log('updates')} {asof_sql(_B, _P)}")
def log_as_of_updates(spark: SparkSession, d: str) -> DataFrame:
    """The same answer from the log, without rectangles."""
    return director.value_as_of(log_of(spark, d, "updates"), ["o_custkey"], B, P)


@query("log_as_of_terminates", f"WITH {belief_log('ends')} {_ENDS}")
def log_as_of_terminates(spark: SparkSession, d: str) -> DataFrame:
    return director.value_as_of(log_of(spark, d, "ends"), ["o_custkey"], B, P)


@query("log_as_of_increments", f"WITH {belief_log('increments')} {_SUMS}")
def log_as_of_increments(spark: SparkSession, d: str) -> DataFrame:
    return director.value_as_of(log_of(spark, d, "increments"), ["o_custkey"], B, P).select("o_custkey", F.round("value", 2).alias("value"))


@query("director_rectangles")
def director_rectangles(spark: SparkSession, d: str) -> DataFrame:
    """Every rectangle of every customer; no plain SQL makes them."""
    rows = director.fold(BELIEF, log_of(spark, d, "ends"))
    return rows.select("o_custkey", "value", *[encode(c).alias(c.lower()) for c in BELIEF.bounds])


_FIRST = "first AS (SELECT o_custkey, min(o_orderdate) AS d1, max(o_orderdate) AS d2, max_by(o_totalprice, o_orderkey) AS v FROM orders GROUP BY o_custkey)"
_T0, _T1 = "TIMESTAMP '2002-01-01'", "TIMESTAMP '2002-02-01'"


def _start(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """One open rectangle a customer from its first order on, and a mutation a customer at its last order date."""
    first = table(spark, d, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("d1"), F.max("o_orderdate").alias("d2"), F.max_by("o_totalprice", "o_orderkey").alias("v"))
    t0 = F.expr("TIMESTAMP_NTZ '2002-01-01'")
    log = first.select("o_custkey", F.lit("insert").alias("op"), F.col("d1").alias("b"), F.lit(None).cast("timestamp_ntz").alias("u"), t0.alias("p"), F.lit(0).alias("seq"), F.lit(1.0).alias("value"))
    return director.fold(BELIEF, log), first


def _mutated(spark: SparkSession, d: str, op: str, until: str | None = None, value: str | None = "v") -> DataFrame:
    rows, first = _start(spark, d)
    log = first.select("o_custkey", F.lit(op).alias("op"), F.col("d2").alias("b"), (F.expr(until) if until else F.lit(None)).cast("timestamp_ntz").alias("u"), F.expr("TIMESTAMP_NTZ '2002-02-01'").alias("p"), (F.expr(value) if value else F.lit(None).cast("double")).alias("value"))
    out = director.tick(BELIEF, rows, log)
    return out.select("o_custkey", "value", *[encode(c).alias(c.lower()) for c in BELIEF.bounds])


def _rects(*parts: str) -> str:
    """SQL for rectangles (value, f, t, i, o) of each customer of ``first``, empty ones left out."""
    rows = " UNION ALL ".join(f"SELECT o_custkey, {p} FROM first" for p in parts)
    return f"WITH {_FIRST}, r(o_custkey, value, f, t, i, o) AS ({rows}) SELECT o_custkey, CAST(value AS DOUBLE) AS value, strftime(f, {TEXT}) AS from_z, strftime(t, {TEXT}) AS thru_z, strftime(i, {TEXT}) AS in_z, strftime(o, {TEXT}) AS out_z FROM r WHERE f < t"


_CLOSED = f"1.0, d1, {INF}, {_T0}, {_T1}"
_HEAD = f"1.0, d1, d2, {_T1}, {INF}"
_U = "d2 + INTERVAL 30 DAY"
_TAIL = f"1.0, {_U}, {INF}, {_T1}, {INF}"

for _name, _op, _until, _value, _parts in (
    ("tick_update", "update", None, "v", (_CLOSED, _HEAD, f"v, d2, {INF}, {_T1}, {INF}")),
    ("tick_update_until", "update_until", "d2 + interval 30 days", "v", (_CLOSED, _HEAD, f"v, d2, {_U}, {_T1}, {INF}", _TAIL)),
    ("tick_increment", "increment", None, "v", (_CLOSED, _HEAD, f"1.0 + v, d2, {INF}, {_T1}, {INF}")),
    ("tick_increment_until", "increment_until", "d2 + interval 30 days", "v", (_CLOSED, _HEAD, f"1.0 + v, d2, {_U}, {_T1}, {INF}", _TAIL)),
    ("tick_terminate", "terminate", None, None, (_CLOSED, _HEAD)),
    ("tick_terminate_until", "terminate_until", "d2 + interval 30 days", None, (_CLOSED, _HEAD, _TAIL)),
    ("tick_in_place", "in_place", None, "v", (f"v, d1, {INF}, {_T0}, {INF}",)),
):
    query(_name, _rects(*_parts))(lambda spark, d, op=_op, until=_until, value=_value: _mutated(spark, d, op, until, value))


_V = "d1 - INTERVAL 30 DAY"
_GAP, _WIDE = f"v, {_V}, d1, {_T1}, {INF}", "d1 + INTERVAL 30 DAY"
_BOUNDED = (_CLOSED, _GAP, f"1.0 + v, d1, {_WIDE}, {_T1}, {INF}", f"1.0, {_WIDE}, {INF}, {_T1}, {INF}")
_OPEN = (_CLOSED, _GAP, f"1.0 + v, d1, {INF}, {_T1}, {INF}")


def _filled(spark: SparkSession, d: str, apply, until: bool) -> DataFrame:
    """An insert with increment 30 days before the first row of each customer: a gap filled, the rest incremented."""
    rows, first = _start(spark, d)
    op, end = ("insert_with_increment_until", "d1 + interval 30 days") if until else ("insert_with_increment", "cast(null as timestamp_ntz)")
    log = first.select("o_custkey", F.lit(op).alias("op"), F.expr("d1 - interval 30 days").alias("b"), F.expr(end).alias("u"), F.expr("TIMESTAMP_NTZ '2002-02-01'").alias("p"), F.lit(1).alias("seq"), F.col("v").alias("value"))
    return apply(rows, log).select("o_custkey", "value", *[encode(c).alias(c.lower()) for c in BELIEF.bounds])


for _name, _apply, _bounded in (
    ("fold_insert_with_increment", lambda rows, log: director.fold(BELIEF, log, rows), False),
    ("fold_insert_with_increment_until", lambda rows, log: director.fold(BELIEF, log, rows), True),
    ("tick_insert_with_increment", lambda rows, log: director.tick(BELIEF, rows, log), False),
    ("tick_insert_with_increment_until", lambda rows, log: director.tick(BELIEF, rows, log), True),
):
    query(_name, _rects(*(_BOUNDED if _bounded else _OPEN)))(lambda spark, d, apply=_apply, until=_bounded: _filled(spark, d, apply, until))


@query("terminate_and_reinsert", _rects(_CLOSED, _HEAD, f"v, d2 + INTERVAL 10 DAY, {INF}, TIMESTAMP '2002-03-01', {INF}"))
def terminate_and_reinsert(spark: SparkSession, d: str) -> DataFrame:
    """A second life: ended at the last order, begun anew ten days later."""
    rows, first = _start(spark, d)
    none = F.lit(None).cast("timestamp_ntz").alias("u")
    ended = first.select("o_custkey", F.lit("terminate").alias("op"), F.col("d2").alias("b"), none, F.expr("TIMESTAMP_NTZ '2002-02-01'").alias("p"), F.lit(1).alias("seq"), F.lit(None).cast("double").alias("value"))
    again = first.select("o_custkey", F.lit("insert").alias("op"), F.expr("d2 + interval 10 days").alias("b"), none, F.expr("TIMESTAMP_NTZ '2002-03-01'").alias("p"), F.lit(2).alias("seq"), F.col("v").alias("value"))
    out = director.fold(BELIEF, ended.unionByName(again), rows)
    return out.select("o_custkey", "value", *[encode(c).alias(c.lower()) for c in BELIEF.bounds])


#: Operations with their begin and end, on customers with a row from d1 to d2 + 60 days.
_TRIED = (
    ("insert", "d2 + interval 90 days", None), ("insert_until", "d2 + interval 90 days", "d2 + interval 99 days"), ("update", "d1 + interval 3 days", None), ("update_until", "d1 + interval 3 days", "d2 + interval 5 days"),
    ("increment", "d1", None), ("increment_until", "d1 - interval 9 days", "d2 + interval 70 days"), ("terminate", "d2", None), ("terminate_until", "d1", "d2 + interval 1 day"), ("in_place", "d1", None), ("purge", "d1", None),
    ("archive", "d1", "d2 + interval 1 day"), ("recover", "d2 + interval 70 days", "d2 + interval 80 days"), ("insert_with_increment", "d1 - interval 5 days", None), ("insert_with_increment_until", "d1 - interval 5 days", "d1 + interval 5 days"),
)


@query("tick_matches_fold", f"SELECT unnest([{', '.join(repr(t[0]) for t in _TRIED)}]) AS op, CAST(0 AS BIGINT) AS differing")
def tick_matches_fold(spark: SparkSession, d: str) -> DataFrame:
    """Every operation by joins and by the fold of logs: rectangles that only one of them makes."""
    _, first = _start(spark, d)
    at = lambda x: F.expr(x).cast("timestamp_ntz")
    start = first.select("o_custkey", F.lit("insert_until").alias("op"), F.col("d1").alias("b"), at("d2 + interval 60 days").alias("u"), at("TIMESTAMP_NTZ '2002-01-01'").alias("p"), F.lit(0).alias("seq"), F.lit(1.0).alias("value"))
    rows, out = director.fold(BELIEF, start), None
    for op, b, u in _TRIED:
        log = first.select("o_custkey", F.lit(op).alias("op"), at(b).alias("b"), at(u or "null").alias("u"), at("TIMESTAMP_NTZ '2002-02-01'").alias("p"), at("TIMESTAMP_NTZ '2003-01-01'").alias("p_to"), F.lit(1).alias("seq"), F.col("v").alias("value"))
        a, c = director.tick(BELIEF, rows, log), director.fold(BELIEF, log, rows)
        both = a.withColumn("n", F.lit(1)).unionByName(c.select(*a.columns).withColumn("n", F.lit(-1)))
        part = both.groupBy(*a.columns).agg(F.sum("n").alias("n")).where("n <> 0").agg(F.lit(op).alias("op"), F.count("*").alias("differing"))
        out = part if out is None else out.unionByName(part)
    return out


@query("tick_purge", "SELECT DISTINCT o_custkey FROM orders WHERE o_custkey % 2 = 1")
def tick_purge(spark: SparkSession, d: str) -> DataFrame:
    rows, first = _start(spark, d)
    log = first.where("o_custkey % 2 = 0").select("o_custkey", F.lit("purge").alias("op"), F.col("d2").alias("b"), F.expr("TIMESTAMP_NTZ '2002-02-01'").alias("p"))
    return director.tick(BELIEF, rows, log).select("o_custkey")


AUDIT = Entity("AuditValue", (Attribute("o_custkey", LONG, key=True), Attribute("value", DOUBLE)), processing=PROCESSING)
HOLDING = Entity("Holding", (Attribute("o_custkey", LONG, key=True), Attribute("value", DOUBLE)), business=BUSINESS)


@query("director_audit_only", f"SELECT o_custkey, o_totalprice AS value, strftime(o_orderdate, {TEXT}) AS in_z, strftime(coalesce(lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate), {INF}), {TEXT}) AS out_z FROM (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderdate ORDER BY o_orderkey DESC) = 1)")
def director_audit_only(spark: SparkSession, d: str) -> DataFrame:
    """Without a business axis: each update closes the version before; of one instant the last one stays."""
    o = table(spark, d, "orders")
    from pyspark.sql import Window

    op = F.when(F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")) == 1, "insert").otherwise("update")
    log = o.select("o_custkey", op.alias("op"), F.col("o_orderdate").alias("p"), F.col("o_orderkey").alias("seq"), F.col("o_totalprice").alias("value"))
    return director.fold(AUDIT, log).select("o_custkey", "value", encode("IN_Z").alias("in_z"), encode("OUT_Z").alias("out_z"))


@query("director_business_only", f"SELECT o_custkey, o_totalprice AS value, strftime(o_orderdate, {TEXT}) AS from_z, strftime(coalesce(lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate), {INF}), {TEXT}) AS thru_z FROM (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderdate ORDER BY o_orderkey DESC) = 1)")
def director_business_only(spark: SparkSession, d: str) -> DataFrame:
    """Without a processing axis: an update splits the open row, and what it replaces is not kept."""
    o = table(spark, d, "orders")
    from pyspark.sql import Window

    op = F.when(F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")) == 1, "insert").otherwise("update")
    log = o.select("o_custkey", op.alias("op"), F.col("o_orderdate").alias("b"), F.col("o_orderkey").alias("seq"), F.col("o_totalprice").alias("value"))
    return director.fold(HOLDING, log).select("o_custkey", "value", encode("FROM_Z").alias("from_z"), encode("THRU_Z").alias("thru_z"))


@query("director_insert_with_increment", f"WITH {_FIRST} SELECT o_custkey, count(*) AS n, round(sum(value), 2) AS total FROM (SELECT o_custkey, 1.0 AS value FROM first UNION ALL SELECT o_custkey, v FROM first UNION ALL SELECT o_custkey, 1.0 + v FROM first UNION ALL SELECT o_custkey, 1.0 FROM first) GROUP BY o_custkey")
def director_insert_with_increment(spark: SparkSession, d: str) -> DataFrame:
    """Four rows a customer: closed original, gap fill, incremented window, tail."""
    rows, first = _start(spark, d)
    log = first.select("o_custkey", F.lit("insert_with_increment_until").alias("op"), F.expr("d1 - interval 30 days").alias("b"), F.expr("d1 + interval 30 days").alias("u"), F.expr("TIMESTAMP_NTZ '2002-02-01'").alias("p"), F.lit(1).alias("seq"), F.col("v").alias("value"))
    return director.fold(BELIEF, log, rows).groupBy("o_custkey").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("director_same_instant", f"WITH {_FIRST} SELECT o_custkey, CAST(CASE WHEN d1 = d2 THEN 1 ELSE 2 END AS BIGINT) AS n FROM first")
def director_same_instant(spark: SparkSession, d: str) -> DataFrame:
    """A row that began at the very instant of its change is dropped, not closed."""
    rows, first = _start(spark, d)
    log = first.select("o_custkey", F.lit("update").alias("op"), F.col("d2").alias("b"), F.expr("TIMESTAMP_NTZ '2002-01-01'").alias("p"), F.lit(1).alias("seq"), F.col("v").alias("value"))
    return director.fold(BELIEF, log, rows).groupBy("o_custkey").agg(F.count("*").alias("n"))


@query("director_archive_recover", f"WITH {_FIRST} SELECT o_custkey, strftime(d1, {TEXT}) AS from_z, strftime(d2 + INTERVAL 1 DAY, {TEXT}) AS thru_z, strftime(TIMESTAMP '2003-01-01', {TEXT}) AS out_z FROM first UNION ALL SELECT o_custkey, strftime(d2 + INTERVAL 2 DAY, {TEXT}), strftime(d2 + INTERVAL 9 DAY, {TEXT}), strftime(TIMESTAMP '2003-06-01', {TEXT}) FROM first")
def director_archive_recover(spark: SparkSession, d: str) -> DataFrame:
    rows, first = _start(spark, d)
    archived = first.select("o_custkey", F.lit("archive").alias("op"), F.col("d1").alias("b"), F.expr("d2 + interval 1 day").alias("u"), F.expr("TIMESTAMP_NTZ '2002-02-01'").alias("p"), F.expr("TIMESTAMP_NTZ '2003-01-01'").alias("p_to"), F.lit(1).alias("seq"))
    recovered = first.select("o_custkey", F.lit("recover").alias("op"), F.expr("d2 + interval 2 days").alias("b"), F.expr("d2 + interval 9 days").alias("u"), F.expr("TIMESTAMP_NTZ '2002-03-01'").alias("p"), F.expr("TIMESTAMP_NTZ '2003-06-01'").alias("p_to"), F.lit(2).alias("seq"))
    out = director.fold(BELIEF, archived.unionByName(recovered).withColumn("value", F.lit(5.0)), rows)
    return out.select("o_custkey", encode("FROM_Z").alias("from_z"), encode("THRU_Z").alias("thru_z"), encode("OUT_Z").alias("out_z"))


CUT = Entity("Cut", BELIEF.attributes, BUSINESS, Axis("processingDate", "IN_Z", "OUT_Z", default=INFINITY, future_expiring=False))


@query("director_cut_ends", f"WITH {_FIRST} SELECT o_custkey, strftime(TIMESTAMP '2002-02-02', {TEXT}) AS thru_z FROM first")
def director_cut_ends(spark: SparkSession, d: str) -> DataFrame:
    """Where no row expires in the future, a closed open-ended row ends a day after its closing."""
    rows, first = _start(spark, d)
    log = first.select("o_custkey", F.lit("update").alias("op"), F.col("d2").alias("b"), F.expr("TIMESTAMP_NTZ '2002-02-01'").alias("p"), F.lit(1).alias("seq"), F.col("v").alias("value"))
    closed = director.fold(CUT, log, rows).where(F.col("OUT_Z") == F.expr("TIMESTAMP_NTZ '2002-02-01'"))
    return closed.select("o_custkey", encode("THRU_Z").alias("thru_z"))


@query("cascade_terminate", "SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey % 10 = 0")
def cascade_terminate(spark: SparkSession, d: str) -> DataFrame:
    """A mutation of a customer reaches all its lines."""
    from palimpsest.views import belief_line

    parents = table(spark, d, "customer").where("c_custkey % 10 = 0").select(F.col("c_custkey").alias("o_custkey"), F.lit("terminate").alias("op"), F.expr("TIMESTAMP_NTZ '1999-01-01'").alias("b"), F.expr("TIMESTAMP_NTZ '2002-01-01'").alias("p"))
    return director.cascade(parents, belief_line(spark, d), [("o_custkey", "o_custkey")], ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber")


@query("insert_until_zero_length", f"WITH {_FIRST} SELECT o_custkey, strftime(d2, {TEXT}) AS at FROM first".replace("AS at", "AS moment"))
def insert_until_zero_length(spark: SparkSession, d: str) -> DataFrame:
    """An insert until its own date is stored, with no length."""
    _, first = _start(spark, d)
    log = first.select("o_custkey", F.lit("insert_until").alias("op"), F.col("d2").alias("b"), F.col("d2").alias("u"), F.expr("TIMESTAMP_NTZ '2002-02-01'").alias("p"), F.lit(1).alias("seq"), F.col("v").alias("value"))
    return director.fold(BELIEF, log).where("FROM_Z = THRU_Z").select("o_custkey", encode("FROM_Z").alias("moment"))



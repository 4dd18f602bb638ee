"""Comparison of row sets, verification of copies, invariants of histories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.temporal import encode
from palimpsest.model import INFINITY, instant
from palimpsest.operators import backfill, diff, director
from palimpsest.queries import BELIEF_LINE, CUST_PRIORITY, INF, TEXT, USER_STATE, query
from palimpsest.sources.store import VersionedTable, reconcile, scratch
from palimpsest.sources.tables import table
from palimpsest.views import BELIEF, BELIEF_LINE as LINE, CUST_PRIORITY as PRIORITY, ORDERS, USER_STATE as STATE, belief_line, belief_log as log_of, cust_priority, user_state

#: A damaged copy of ``user_state``: rows lost, changed, cut short and added.
_BAD = f"bad AS (SELECT user_id + CASE WHEN event_id % 97 = 0 THEN 100000 ELSE 0 END AS user_id, event_id, CASE WHEN event_id % 13 = 0 THEN NULL ELSE event_type END AS event_type, value, IN_Z, CASE WHEN event_id % 17 = 0 AND OUT_Z <> {INF} THEN OUT_Z + INTERVAL 1 DAY ELSE OUT_Z END AS OUT_Z FROM user_state WHERE event_id % 11 <> 0)"


def _damaged(spark: SparkSession, d: str) -> DataFrame:
    rows = user_state(spark, d).where("event_id % 11 <> 0")
    late = (F.col("event_id") % 17 == 0) & (F.col("OUT_Z") != instant(INFINITY))
    return rows.withColumns({
        "user_id": F.col("user_id") + F.when(F.col("event_id") % 97 == 0, 100000).otherwise(0),
        "event_type": F.when(F.col("event_id") % 13 != 0, F.col("event_type")),
        "OUT_Z": F.when(late, F.col("OUT_Z") + F.expr("interval 1 day")).otherwise(F.col("OUT_Z")),
    }).select(*STATE.columns)


_PAIRS = f"WITH {USER_STATE}, {_BAD}, j AS (SELECT x.user_id AS xu, y.user_id AS yu, coalesce(x.user_id, y.user_id) AS user_id, coalesce(x.IN_Z, y.IN_Z) AS IN_Z, coalesce(x.OUT_Z, y.OUT_Z) AS OUT_Z, x.event_type AS xt, y.event_type AS yt FROM user_state x FULL JOIN bad y ON x.user_id = y.user_id AND x.IN_Z = y.IN_Z AND x.OUT_Z = y.OUT_Z)"
_AT = f"user_id, strftime(IN_Z, {TEXT}) AS since, strftime(OUT_Z, {TEXT}) AS until"
_DIFFS = f"SELECT {_AT}, 'MISSING' AS kind, NULL AS col FROM j WHERE yu IS NULL UNION ALL SELECT {_AT}, 'EXTRA', NULL FROM j WHERE xu IS NULL UNION ALL SELECT {_AT}, 'VALUE', 'event_type' FROM j WHERE xu IS NOT NULL AND yu IS NOT NULL AND xt IS DISTINCT FROM yt"


@query("rowset_diff", f"{_PAIRS} {_DIFFS}")
def rowset_diff(spark: SparkSession, d: str) -> DataFrame:
    out = diff.compare(STATE, user_state(spark, d), _damaged(spark, d))
    return out.select("user_id", encode("IN_Z").alias("since"), encode("OUT_Z").alias("until"), "kind", F.col("column").alias("col"))


@query("missing_rows", f"WITH {USER_STATE}, {_BAD} SELECT user_id, event_id FROM user_state ANTI JOIN bad USING (user_id, IN_Z, OUT_Z)")
def missing_rows(spark: SparkSession, d: str) -> DataFrame:
    return diff.missing(STATE, user_state(spark, d), _damaged(spark, d)).select("user_id", "event_id")


@query("extra_rows", f"WITH {USER_STATE}, {_BAD} SELECT user_id, event_id FROM bad ANTI JOIN user_state USING (user_id, IN_Z, OUT_Z)")
def extra_rows(spark: SparkSession, d: str) -> DataFrame:
    return diff.missing(STATE, _damaged(spark, d), user_state(spark, d)).select("user_id", "event_id")


@query("set_intersect", "SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'")
def set_intersect(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.where("o_orderstatus = 'F'").select("o_custkey").intersect(o.where("o_orderstatus = 'O'").select("o_custkey"))


@query("set_except", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 100000")
def set_except(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_custkey").alias("k")).exceptAll(table(spark, d, "orders").where("o_totalprice > 100000").select("o_custkey").distinct())


@query("duplicate_identity", "SELECT o_custkey, count(*) AS n FROM (SELECT o_custkey, o_orderdate FROM orders) GROUP BY o_custkey, o_orderdate HAVING count(*) > 1")
def duplicate_identity(spark: SparkSession, d: str) -> DataFrame:
    """Orders of one customer and day, taken for versions of one rectangle."""
    rows = table(spark, d, "orders").withColumns({"FROM_Z": F.col("o_orderdate"), "THRU_Z": instant(INFINITY)})
    return diff.duplicate_identity(PRIORITY, rows).select("o_custkey", "n")


@query("missing_boundaries", "SELECT o_orderkey FROM orders WHERE o_orderkey % 9 = 0 OR o_custkey % 12 = 0")
def missing_boundaries(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").withColumns({"FROM_Z": F.when(F.col("o_orderkey") % 9 != 0, F.col("o_orderdate")), "o_custkey": F.when(F.col("o_custkey") % 12 != 0, F.col("o_custkey")), "THRU_Z": instant(INFINITY)})
    return diff.missing_bounds(PRIORITY, rows).select("o_orderkey")


@query("backfill_verify", f"{_PAIRS}, diffs AS ({_DIFFS}) SELECT (SELECT count(*) FROM user_state) AS rows_read, (SELECT count(*) FROM bad SEMI JOIN user_state USING (user_id)) AS rows_written, (SELECT count(*) FROM diffs WHERE user_id < 100000) AS divergences, FALSE AS verified")
def backfill_verify(spark: SparkSession, d: str) -> DataFrame:
    return diff.verify(STATE, user_state(spark, d), _damaged(spark, d))


@query("verify_scope", f"WITH {CUST_PRIORITY} SELECT o_custkey, count(*) AS n FROM cust_priority WHERE o_custkey % 5 = 0 GROUP BY o_custkey")
def verify_scope(spark: SparkSession, d: str) -> DataFrame:
    """Rows of a target whose key the source has."""
    rows = cust_priority(spark, d)
    return diff.scoped(PRIORITY, rows.where("o_custkey % 5 = 0"), rows).groupBy("o_custkey").agg(F.count("*").alias("n"))


@query("invariant_no_overlap", "SELECT CAST(0 AS BIGINT) AS overlapping")
def invariant_no_overlap(spark: SparkSession, d: str) -> DataFrame:
    """What the director makes never overlaps."""
    rows = director.fold(BELIEF, log_of(spark, d, "ends"))
    return director.history_overlaps(BELIEF, rows).agg(F.count("*").alias("overlapping"))


@query("invariant_overlap_found", f"WITH {BELIEF_LINE}, x AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY IN_Z, FROM_Z, THRU_Z, OUT_Z, l_orderkey, l_linenumber) AS place FROM belief_line) SELECT count(*) AS overlapping FROM x WHERE EXISTS (SELECT 1 FROM x y WHERE y.o_custkey = x.o_custkey AND y.place < x.place AND y.FROM_Z < x.THRU_Z AND y.THRU_Z > x.FROM_Z AND y.IN_Z < x.OUT_Z AND y.OUT_Z > x.IN_Z)")
def invariant_overlap_found(spark: SparkSession, d: str) -> DataFrame:
    """Lines of one customer do overlap, if taken for versions of one thing; the SQL compares all pairs on both axes."""
    from palimpsest.model import Attribute, Entity
    from palimpsest.views import LONG

    e = Entity("Taken", (Attribute("o_custkey", LONG, key=True),), LINE.business, LINE.processing)
    return director.history_overlaps(e, belief_line(spark, d)).agg(F.count("*").alias("overlapping"))


@query("derived_zero_length", f"WITH {CUST_PRIORITY} SELECT o_custkey, o_orderkey FROM cust_priority WHERE FROM_Z = THRU_Z")
def derived_zero_length(spark: SparkSession, d: str) -> DataFrame:
    return cust_priority(spark, d).where("FROM_Z = THRU_Z").select("o_custkey", "o_orderkey")


@query("invariant_closed_overlap", "SELECT count(*) AS overlapping FROM (SELECT DISTINCT o_custkey FROM orders)")
def invariant_closed_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Two versions a customer that overlap in the past on both axes, and are both closed, are found; two that meet are not."""
    keys = table(spark, d, "orders").select("o_custkey").distinct()
    span = lambda a, b: F.array(*[F.expr(f"TIMESTAMP_NTZ '{x}-01-01'") for x in (*a, *b)])
    held = [span((2001, 2010), (2000, 2005)), span((2005, 2012), (2002, 2009)), span((2012, 2015), (2002, 2009)), span((2001, 2012), (2009, 2011))]
    rows = keys.withColumn("v", F.explode(F.array(*held))).select("o_custkey", F.lit(1.0).alias("value"), *[F.col("v")[i].alias(c) for i, c in enumerate(BELIEF.bounds)])
    return director.history_overlaps(BELIEF, rows).agg(F.count("*").alias("overlapping"))


@query("backfill_run", "SELECT 'first' AS run, count(*) AS read, count(*) AS written, CAST(0 AS BIGINT) AS skipped, TRUE AS verified FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT 'resumed', count(*) FILTER (WHERE o_orderkey % 2 = 1), count(*) FILTER (WHERE o_orderkey % 2 = 1), count(*) FILTER (WHERE o_orderkey % 2 = 0), TRUE FROM orders UNION ALL SELECT 'empty', 0, 0, 0, FALSE UNION ALL SELECT 'empty, declared', 0, 0, 0, TRUE")
def backfill_run(spark: SparkSession, d: str) -> DataFrame:
    """A copy of half a table, checkpointed; the whole then, done keys skipped; an empty source, which alone is no success."""
    root, rows = scratch(spark), table(spark, d, "orders").select(*ORDERS.columns)
    target, done = VersionedTable(spark, f"{root}/target"), backfill.Checkpoint(spark, f"{root}/done", "snapshot-1")
    runs = {
        "first": backfill.run(ORDERS, rows.where("o_orderkey % 2 = 0"), target, done),
        "resumed": backfill.run(ORDERS, rows, target, done),
        "empty": backfill.run(ORDERS, rows.limit(0), VersionedTable(spark, f"{root}/none")),
        "empty, declared": backfill.run(ORDERS, rows.limit(0), VersionedTable(spark, f"{root}/said"), empty_ok=True),
    }
    return spark.createDataFrame([(k, r.rows_read, r.rows_written, r.skipped_keys, r.verified) for k, r in runs.items()], "run string, read bigint, written bigint, skipped bigint, verified boolean")


@query("schema_outcomes", "SELECT unnest(['CREATE', 'BACKFILL_INDEX_KEY', 'VALIDATE']) AS outcome, unnest(['orders', 'BYCUST', 'orders']) AS name")
def schema_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """A table that is not there, one with an index whose keys are missing in some rows, and one where nothing is to do."""
    from dataclasses import replace

    from palimpsest.functions.keys import secondary_key

    named, held = replace(ORDERS, table="orders"), table(spark, d, "orders")
    stamped = held.withColumn("_key_BYCUST", secondary_key(ORDERS, "BYCUST", ["o_custkey"]))
    partly = stamped.withColumn("_key_BYCUST", F.when(F.col("o_orderkey") % 2 == 0, F.col("_key_BYCUST")))
    index = {"BYCUST": ["o_custkey"]}
    rows = reconcile(named, None) + reconcile(named, partly, index) + reconcile(named, stamped, index)
    return spark.createDataFrame(rows, "outcome string, name string")


@query("schema_reconcile", "SELECT unnest(['VALIDATE', 'ADD_COLUMN', 'INCOMPATIBLE', 'ADD_INDEX']) AS outcome, unnest(['orders', 'note', 'o_totalprice', 'BYCUST']) AS name")
def schema_reconcile(spark: SparkSession, d: str) -> DataFrame:
    from dataclasses import replace

    from palimpsest.model import Attribute
    from palimpsest.views import INT, STRING

    held = table(spark, d, "orders")
    named = replace(ORDERS, table="orders")
    noted = replace(ORDERS, attributes=(*ORDERS.attributes, Attribute("note", STRING)))
    other = replace(ORDERS, attributes=tuple(Attribute("o_totalprice", INT) if a.name == "o_totalprice" else a for a in ORDERS.attributes))
    rows = reconcile(named, held) + reconcile(noted, held) + reconcile(other, held) + reconcile(ORDERS, held, {"BYCUST": ["o_custkey"]})
    return spark.createDataFrame(rows, "outcome string, name string")

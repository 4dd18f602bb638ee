"""As-of selection on one and two axes."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.temporal import EDGE, as_of, as_of_grid, decode, encode, holds, whole_millis
from palimpsest.model import INFINITY, Axis, instant
from palimpsest.operators import director
from palimpsest.plans.finder import Finder
from palimpsest.queries import BELIEF_LINE, CUST_PRIORITY, INF, TEXT, USER_STATE, belief_log, query
from palimpsest.sources.tables import table
from palimpsest.views import BELIEF, BELIEF_LINE as LINE, CUST_PRIORITY as PRIORITY, USER_STATE as STATE, belief_line, cust_priority, user_state
from palimpsest.views import belief_log as log_of

JAN, B, P = dt.datetime(2024, 1, 15), dt.datetime(1998, 6, 1), dt.datetime(1999, 1, 1)
_B, _P = "TIMESTAMP '1998-06-01'", "TIMESTAMP '1999-01-01'"


def asof_sql(business: str, processing: str, line: str = "log") -> str:
    """Value as of two dates, by the closed form on a log of updates."""
    return f"SELECT o_custkey, value FROM {line} WHERE b <= {business} AND u > {business} AND p <= {processing} QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY p DESC, seq DESC) = 1"


@query("asof_audit_only", f"WITH {USER_STATE} SELECT user_id, event_id, event_type FROM user_state WHERE IN_Z <= TIMESTAMP '2024-01-15' AND OUT_Z > TIMESTAMP '2024-01-15'")
def asof_audit_only(spark: SparkSession, d: str) -> DataFrame:
    return Finder(STATE, user_state(spark, d)).as_of(processing=JAN).find().select("user_id", "event_id", "event_type")


@query("asof_business_only", f"WITH {CUST_PRIORITY} SELECT o_custkey, o_orderkey, o_orderpriority FROM cust_priority WHERE FROM_Z <= {_B} AND THRU_Z > {_B}")
def asof_business_only(spark: SparkSession, d: str) -> DataFrame:
    return Finder(PRIORITY, cust_priority(spark, d)).as_of(B).find().select("o_custkey", "o_orderkey", "o_orderpriority")


@query("asof_business", f"WITH {BELIEF_LINE} SELECT l_orderkey, l_linenumber, strftime(IN_Z, {TEXT}) AS known FROM belief_line WHERE FROM_Z <= {_B} AND THRU_Z > {_B}")
def asof_business(spark: SparkSession, d: str) -> DataFrame:
    return as_of(belief_line(spark, d), LINE, B, EDGE).select("l_orderkey", "l_linenumber", encode("IN_Z").alias("known"))


@query("asof_processing", f"WITH {BELIEF_LINE} SELECT l_orderkey, l_linenumber, strftime(FROM_Z, {TEXT}) AS since FROM belief_line WHERE IN_Z <= {_P} AND OUT_Z > {_P}")
def asof_processing(spark: SparkSession, d: str) -> DataFrame:
    return as_of(belief_line(spark, d), LINE, EDGE, P).select("l_orderkey", "l_linenumber", encode("FROM_Z").alias("since"))


@query("asof_both", f"WITH {belief_log('updates')} {asof_sql(_B, _P)}")
def asof_both(spark: SparkSession, d: str) -> DataFrame:
    return as_of(director.fold(BELIEF, log_of(spark, d, "updates")), BELIEF, B, P).select("o_custkey", "value")


@query("asof_current", f"WITH {USER_STATE} SELECT user_id, event_id FROM user_state WHERE OUT_Z = {INF}")
def asof_current(spark: SparkSession, d: str) -> DataFrame:
    return as_of(user_state(spark, d), STATE, processing=INFINITY).select("user_id", "event_id")


@query("asof_inclusive", f"WITH {CUST_PRIORITY} SELECT o_custkey, o_orderkey FROM cust_priority WHERE FROM_Z < {_B} AND THRU_Z >= {_B}")
def asof_inclusive(spark: SparkSession, d: str) -> DataFrame:
    return cust_priority(spark, d).where(holds(Axis("businessDate", "FROM_Z", "THRU_Z", to_inclusive=True), B)).select("o_custkey", "o_orderkey")


@query("asof_default_processing", f"WITH {BELIEF_LINE} SELECT l_orderkey, l_linenumber FROM belief_line WHERE FROM_Z <= {_B} AND THRU_Z > {_B} AND OUT_Z = {INF}")
def asof_default_processing(spark: SparkSession, d: str) -> DataFrame:
    return Finder(LINE, belief_line(spark, d)).as_of(B).find().select("l_orderkey", "l_linenumber")


@query("asof_infinity_both", f"WITH {belief_log('updates')} {asof_sql(f'{INF} - INTERVAL 1 SECOND', INF)}")
def asof_infinity_both(spark: SparkSession, d: str) -> DataFrame:
    return as_of(director.fold(BELIEF, log_of(spark, d, "updates")), BELIEF, INFINITY, INFINITY).select("o_custkey", "value")


@query("history_edge_points", f"WITH {USER_STATE} SELECT user_id, event_id, strftime(IN_Z, {TEXT}) AS since, strftime(OUT_Z, {TEXT}) AS until FROM user_state")
def history_edge_points(spark: SparkSession, d: str) -> DataFrame:
    """Every physical rectangle of all users."""
    return Finder(STATE, user_state(spark, d)).edge_points().find().select("user_id", "event_id", encode("IN_Z").alias("since"), encode("OUT_Z").alias("until"))


@query("zero_length_invisible", f"WITH {CUST_PRIORITY} SELECT count(*) AS all_rows, count(*) FILTER (WHERE FROM_Z = THRU_Z) AS zero_length, count(*) FILTER (WHERE FROM_Z = THRU_Z AND FROM_Z <= {_B} AND THRU_Z > {_B}) AS seen FROM cust_priority")
def zero_length_invisible(spark: SparkSession, d: str) -> DataFrame:
    """Rows of zero length are among the edge points and in no as-of answer."""
    zero = F.col("FROM_Z") == F.col("THRU_Z")
    count = lambda c: F.count(F.when(c, 1))
    return cust_priority(spark, d).agg(F.count("*").alias("all_rows"), count(zero).alias("zero_length"), count(zero & holds(PRIORITY.business, B)).alias("seen"))


@query("history_ordered", f"WITH {CUST_PRIORITY} SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY FROM_Z, o_orderkey) AS version FROM cust_priority")
def history_ordered(spark: SparkSession, d: str) -> DataFrame:
    """The versions of all customers."""
    from pyspark.sql import Window

    rows = Finder(PRIORITY, cust_priority(spark, d)).edge_points().find()
    return rows.withColumn("version", F.row_number().over(Window.partitionBy("o_custkey").orderBy("FROM_Z", "o_orderkey")).cast("bigint")).select("o_custkey", "o_orderkey", "version")


_THEN, _NOW = "TIMESTAMP '1998-07-01'", INF


@query("belief_then_vs_now", f"WITH {belief_log('updates')}, before AS ({asof_sql(_B, _THEN)}), after AS ({asof_sql(_B, _NOW)}) SELECT o_custkey, before.value AS believed_then, after.value AS believed_now, before.value <> after.value AS corrected FROM before JOIN after USING (o_custkey)")
def belief_then_vs_now(spark: SparkSession, d: str) -> DataFrame:
    """One business date as it was known then, and as it is known now."""
    log = log_of(spark, d, "updates")
    then = director.value_as_of(log, ["o_custkey"], B, dt.datetime(1998, 7, 1)).select("o_custkey", F.col("value").alias("believed_then"))
    now = director.value_as_of(log, ["o_custkey"], B, INFINITY).select("o_custkey", F.col("value").alias("believed_now"))
    return then.join(now, "o_custkey").withColumn("corrected", F.col("believed_then") != F.col("believed_now"))


_DATES = ("1996-01-01", "1997-07-01", "1999-01-01", "2000-06-15")


@query("asof_grid", f"WITH {CUST_PRIORITY}, dates AS (SELECT unnest([{', '.join(f'TIMESTAMP {x!r}' for x in _DATES)}]) AS as_of) SELECT as_of, o_custkey, o_orderkey FROM cust_priority JOIN dates ON FROM_Z <= as_of AND THRU_Z > as_of")
def asof_grid(spark: SparkSession, d: str) -> DataFrame:
    dates = spark.createDataFrame([(dt.datetime.fromisoformat(x),) for x in _DATES], "as_of timestamp_ntz")
    return as_of_grid(cust_priority(spark, d), PRIORITY, dates).select("as_of", "o_custkey", "o_orderkey")


@query("derive_audit_versions", f"WITH {USER_STATE} SELECT user_id, count(*) AS versions, count(*) FILTER (WHERE OUT_Z = {INF}) AS open FROM user_state GROUP BY user_id")
def derive_audit_versions(spark: SparkSession, d: str) -> DataFrame:
    return user_state(spark, d).groupBy("user_id").agg(F.count("*").alias("versions"), F.count(F.when(F.col("OUT_Z") == instant(INFINITY), 1)).alias("open"))


@query("derive_business_versions", f"WITH {CUST_PRIORITY} SELECT o_custkey, count(*) AS versions, max(o_orderkey) AS newest FROM cust_priority GROUP BY o_custkey")
def derive_business_versions(spark: SparkSession, d: str) -> DataFrame:
    return cust_priority(spark, d).groupBy("o_custkey").agg(F.count("*").alias("versions"), F.max("o_orderkey").alias("newest"))


@query("date_range_overlap", f"WITH {BELIEF_LINE} SELECT l_orderkey, l_linenumber, strftime(FROM_Z, {TEXT}) AS since FROM belief_line WHERE FROM_Z < TIMESTAMP '1998-09-01' AND THRU_Z > {_B}")
def date_range_overlap(spark: SparkSession, d: str) -> DataFrame:
    f = Finder(LINE, belief_line(spark, d))
    return f.between_dates(B, dt.datetime(1998, 9, 1)).select("l_orderkey", "l_linenumber", encode("FROM_Z").alias("since"))


@query("temporal_encode", f"SELECT event_id, strftime(date_trunc('millisecond', ts), {TEXT}) AS text, TRUE AS back, date_trunc('millisecond', ts) = ts AS whole FROM events")
def temporal_encode(spark: SparkSession, d: str) -> DataFrame:
    cut = F.date_trunc("millisecond", "ts").cast("timestamp_ntz")
    rows = table(spark, d, "events").select("event_id", "ts", cut.alias("cut")).withColumn("text", encode("cut"))
    return rows.select("event_id", "text", (decode("text") == F.col("cut")).alias("back"), whole_millis("ts").alias("whole"))

"""Temporal tables derived from the plain ones: histories of users, customers and lines, and logs of beliefs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.model import INFINITY, Attribute, Axis, Entity, Relationship, instant
from palimpsest.sources.tables import table

BUSINESS = Axis("businessDate", "FROM_Z", "THRU_Z")
PROCESSING = Axis("processingDate", "IN_Z", "OUT_Z", default=INFINITY)
LONG, INT, DOUBLE, STRING = T.LongType(), T.IntegerType(), T.DoubleType(), T.StringType()

USER_STATE = Entity("UserState", (Attribute("user_id", LONG, key=True), Attribute("event_id", LONG), Attribute("event_type", STRING), Attribute("value", DOUBLE)), processing=PROCESSING)
CUST_PRIORITY = Entity("CustPriority", (Attribute("o_custkey", LONG, key=True), Attribute("o_orderkey", LONG), Attribute("o_orderpriority", STRING), Attribute("o_totalprice", DOUBLE)), business=BUSINESS)
BELIEF = Entity("Belief", (Attribute("o_custkey", LONG, key=True), Attribute("value", DOUBLE)), BUSINESS, PROCESSING, (Relationship("lines", "BeliefLine", (("o_custkey", "o_custkey"),), reverse="belief"),))
BELIEF_LINE = Entity("BeliefLine", (Attribute("l_orderkey", LONG, key=True), Attribute("l_linenumber", INT, key=True), Attribute("o_custkey", LONG), Attribute("l_quantity", DOUBLE)), BUSINESS, PROCESSING, (Relationship("belief", "Belief", (("o_custkey", "o_custkey"),), many=False),))
CUSTOMER = Entity("Customer", (Attribute("c_custkey", LONG, key=True), Attribute("c_name", STRING), Attribute("c_nationkey", INT), Attribute("c_acctbal", DOUBLE), Attribute("c_mktsegment", STRING)), relationships=(Relationship("orders", "Orders", (("c_custkey", "o_custkey"),)), Relationship("nation", "Nation", (("c_nationkey", "n_nationkey"),), many=False)))
ORDERS = Entity("Orders", (Attribute("o_orderkey", LONG, key=True), Attribute("o_custkey", LONG), Attribute("o_orderstatus", STRING), Attribute("o_totalprice", DOUBLE), Attribute("o_orderdate", T.TimestampNTZType()), Attribute("o_orderpriority", STRING)), relationships=(Relationship("lines", "Lineitem", (("o_orderkey", "l_orderkey"),)),))
LINEITEM = Entity("Lineitem", tuple(Attribute(n, k, key=n in ("l_orderkey", "l_linenumber")) for n, k in (("l_orderkey", LONG), ("l_partkey", LONG), ("l_suppkey", LONG), ("l_linenumber", INT), ("l_quantity", DOUBLE), ("l_extendedprice", DOUBLE), ("l_discount", DOUBLE), ("l_returnflag", STRING), ("l_shipdate", T.TimestampNTZType()))))


def _until_next(of: str, by: str, order: list[str]) -> Column:
    return F.coalesce(F.lead(of).over(Window.partitionBy(by).orderBy(*order)), instant(INFINITY))


def user_state(spark: SparkSession, d: str) -> DataFrame:
    """The last event of each user, versioned by the time it became known."""
    e = table(spark, d, "events").withColumn("IN_Z", F.date_trunc("millisecond", "ts").cast("timestamp_ntz"))
    return e.withColumn("OUT_Z", _until_next("IN_Z", "user_id", ["ts", "event_id"])).select(*USER_STATE.columns)


def cust_priority(spark: SparkSession, d: str) -> DataFrame:
    """The last order of each customer, by business date; orders of one date leave rows of zero length."""
    o = table(spark, d, "orders").withColumn("FROM_Z", F.col("o_orderdate"))
    return o.withColumn("THRU_Z", _until_next("FROM_Z", "o_custkey", ["o_orderdate", "o_orderkey"])).select(*CUST_PRIORITY.columns)


def belief_log(spark: SparkSession, d: str, kind: str) -> DataFrame:
    """Mutations of a value a customer: a base of 0 in 1990, then one an order, known late; ``kind`` is updates, ends or increments.

    Every fifth order holds for 90 days only; with ``ends`` every seventh one terminates.
    """
    o = table(spark, d, "orders")
    known = F.expr("o_orderdate + make_dt_interval(cast((o_orderkey * 37) % 120 as int), 0, 0, cast(o_orderkey % 86400 as int))")
    bounded = F.col("o_orderkey") % 5 == 0
    op = F.when(bounded, "increment_until").otherwise("increment") if kind == "increments" else F.when(bounded, "update_until").otherwise("update")
    if kind == "ends":
        op = F.when(F.col("o_orderkey") % 7 == 0, F.when(bounded, "terminate_until").otherwise("terminate")).otherwise(op)
    rows = o.select("o_custkey", op.alias("op"), F.col("o_orderdate").alias("b"), F.when(bounded, F.expr("o_orderdate + interval 90 days")).alias("u"), known.alias("p"), F.col("o_orderkey").alias("seq"), F.col("o_totalprice").alias("value"))
    start = F.expr("TIMESTAMP_NTZ '1990-01-01 00:00:00'")
    base = o.select("o_custkey").distinct().select("o_custkey", F.lit("insert").alias("op"), start.alias("b"), F.lit(None).cast("timestamp_ntz").alias("u"), start.alias("p"), F.lit(0).cast("bigint").alias("seq"), F.lit(0.0).alias("value"))
    return base.unionByName(rows)


def belief_line(spark: SparkSession, d: str) -> DataFrame:
    """Order lines held for 180 days from shipping, known from the order date; every second one for a year only."""
    j = table(spark, d, "lineitem").join(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    out = F.when((F.col("l_orderkey") + F.col("l_linenumber")) % 2 == 0, instant(INFINITY)).otherwise(F.expr("o_orderdate + interval 365 days"))
    return j.select("l_orderkey", "l_linenumber", "o_custkey", "l_quantity", F.col("l_shipdate").alias("FROM_Z"), F.expr("l_shipdate + interval 180 days").alias("THRU_Z"), F.col("o_orderdate").alias("IN_Z"), out.alias("OUT_Z"))

"""Finding rows by key, by parts of it, by foreign keys; writes as set operations; keys and layouts."""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.functions import keys as K
from palimpsest.functions.temporal import encode
from palimpsest.model import INFINITY, Attribute, Entity
from palimpsest.operators import writes as W
from palimpsest.plans.finder import Finder
from palimpsest.queries import BELIEF_LINE, CUST_PRIORITY, INF, TEXT, USER_STATE, query
from palimpsest.sources import xml_model
from palimpsest.sources.store import VersionedTable, commit_all, current_layout, scratch
from palimpsest.sources.tables import rows as in_memory, table
from palimpsest.views import BELIEF_LINE as LINE, CUST_PRIORITY as PRIORITY, LINEITEM, LONG, ORDERS, USER_STATE as STATE, belief_line, cust_priority, user_state

_LINE = ["l_orderkey", "l_linenumber", "l_quantity"]
WHEN = dt.datetime(1998, 6, 1)


@query("find_one_pk", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey = 42")
def find_one_pk(spark: SparkSession, d: str) -> DataFrame:
    f = Finder(ORDERS, table(spark, d, "orders"))
    return f.where(f.o_orderkey.eq(42)).find_one().select("o_orderkey", "o_custkey", "o_totalprice")


@query("find_many_pk", f"WITH {USER_STATE} SELECT user_id, event_id FROM user_state WHERE user_id = 7")
def find_many_pk(spark: SparkSession, d: str) -> DataFrame:
    f = Finder(STATE, user_state(spark, d)).edge_points()
    return f.where(f.user_id.eq(7)).find().select("user_id", "event_id")


@query("find_pk_in", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey IN (1, 5, 9, 100, 101, 999999999)")
def find_pk_in(spark: SparkSession, d: str) -> DataFrame:
    f = Finder(ORDERS, table(spark, d, "orders"))
    return f.where(f.o_orderkey.is_in([1, 5, 9, 100, 101, 999999999])).find().select("o_orderkey", "o_custkey")


@query("find_processing_from_eq", f"WITH {BELIEF_LINE} SELECT l_orderkey, l_linenumber, l_quantity FROM belief_line WHERE IN_Z = TIMESTAMP '1998-06-01'")
def find_processing_from_eq(spark: SparkSession, d: str) -> DataFrame:
    f = Finder(LINE, belief_line(spark, d)).edge_points()
    return f.where(f.IN_Z.eq(WHEN)).find().select(*_LINE)


@query("find_business_from_range", f"WITH {BELIEF_LINE} SELECT l_orderkey, l_linenumber, l_quantity FROM belief_line WHERE o_custkey = 7 AND FROM_Z > TIMESTAMP '1997-01-01' AND FROM_Z <= TIMESTAMP '1998-06-01'")
def find_business_from_range(spark: SparkSession, d: str) -> DataFrame:
    f = Finder(LINE, belief_line(spark, d)).edge_points()
    return f.where(f.o_custkey.eq(7) & f.FROM_Z.gt(dt.datetime(1997, 1, 1)) & f.FROM_Z.lte(WHEN)).find().select(*_LINE)


@query("find_exact_rectangle", f"WITH {CUST_PRIORITY} SELECT o_custkey, o_orderkey, strftime(THRU_Z, {TEXT}) AS until FROM cust_priority WHERE FROM_Z = TIMESTAMP '1998-06-01' AND THRU_Z > FROM_Z")
def find_exact_rectangle(spark: SparkSession, d: str) -> DataFrame:
    f = Finder(PRIORITY, cust_priority(spark, d)).edge_points()
    return f.where(f.FROM_Z.eq(WHEN) & f.THRU_Z.gt(f.FROM_Z)).find().select("o_custkey", "o_orderkey", encode("THRU_Z").alias("until"))


@query("find_by_fk", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey = 4")
def find_by_fk(spark: SparkSession, d: str) -> DataFrame:
    f = Finder(ORDERS, table(spark, d, "orders"))
    return f.where(f.o_custkey.eq(4)).find().select("o_orderkey", "o_custkey")


@query("find_by_fk_in", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (4, 8, 15, 16, 23, 42)")
def find_by_fk_in(spark: SparkSession, d: str) -> DataFrame:
    f = Finder(ORDERS, table(spark, d, "orders"))
    return f.where(f.o_custkey.is_in([4, 8, 15, 16, 23, 42])).find().select("o_orderkey", "o_custkey")


@query("find_by_composite_fk", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey = 10 AND l_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_partkey = 10)")
def find_by_composite_fk(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem")
    pairs = rows.where("l_partkey = 10").select("l_partkey", "l_suppkey").distinct()
    return rows.join(pairs, ["l_partkey", "l_suppkey"], "left_semi").select("l_orderkey", "l_linenumber")


@query("current_rows", f"WITH {BELIEF_LINE} SELECT l_orderkey, l_linenumber FROM belief_line WHERE OUT_Z = {INF} AND FROM_Z <= TIMESTAMP '1998-06-01' AND THRU_Z > TIMESTAMP '1998-06-01'")
def current_rows(spark: SparkSession, d: str) -> DataFrame:
    """From a stored table that is partitioned by whether a row is open: closed versions are not read."""
    return Finder(LINE, _stored(spark, d)).as_of(WHEN, INFINITY).find().select("l_orderkey", "l_linenumber")


def _stored(spark: SparkSession, d: str) -> DataFrame:
    held = VersionedTable(spark, scratch(spark))
    held.commit(current_layout(LINE, belief_line(spark, d)), partition_by=["is_current"])
    return held.read()


@query("explain_counters", f"WITH {BELIEF_LINE} SELECT count(*) AS examined, count(*) FILTER (WHERE FROM_Z <= TIMESTAMP '1998-06-01' AND THRU_Z > TIMESTAMP '1998-06-01') AS returned FROM belief_line WHERE OUT_Z = {INF}")
def explain_counters(spark: SparkSession, d: str) -> DataFrame:
    """A read of what is open now examines the current partition alone."""
    return Finder(LINE, _stored(spark, d)).as_of(WHEN, INFINITY).counters()


@query("cursor_rows", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey IN (4, 8, 15, 16, 23, 42)")
def cursor_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows of a few keys, one by one through a cursor."""
    f = Finder(ORDERS, table(spark, d, "orders"))
    got = [(r["o_orderkey"], r["o_totalprice"]) for r in f.where(f.o_custkey.is_in([4, 8, 15, 16, 23, 42])).cursor()]
    return spark.createDataFrame(got, "o_orderkey bigint, o_totalprice double")


@query("memory_rows", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey IN (1, 5, 9)")
def memory_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows given in memory, as the keys to look up in a table."""
    asked = in_memory(spark, Entity("Asked", (Attribute("o_orderkey", LONG, key=True),)), [(1,), (5,), (9,), (10**12,)])
    return table(spark, d, "orders").join(asked, "o_orderkey", "left_semi").select("o_orderkey", "o_custkey")


MODEL = """<MithraObject objectType="transactional"><PackageName>shop</PackageName><ClassName>Order</ClassName><DefaultTable>ORDERS</DefaultTable>
<Attribute name="id" javaType="long" columnName="o_orderkey" primaryKey="true" nullable="false"/>
<Attribute name="customer" javaType="long" columnName="o_custkey"/><Attribute name="price" javaType="double" columnName="o_totalprice"/>
</MithraObject>"""


@query("xml_model_find", "SELECT o_orderkey AS id, o_custkey AS customer, o_totalprice AS price FROM orders WHERE o_totalprice > 300000")
def xml_model_find(spark: SparkSession, d: str) -> DataFrame:
    """A table found through an entity that XML describes, with names of its own."""
    e = xml_model.parse(MODEL)
    f = Finder(e, e.conform(table(spark, d, "orders")))
    return f.where(f.price.gt(300000.0)).find()


@query("write_first_failure", "SELECT CAST(20 AS BIGINT) AS slot, 'WRITE-002' AS code FROM orders HAVING count(*) > 0")
def write_first_failure(spark: SparkSession, d: str) -> DataFrame:
    """Of the failing slots of a unit of work the first, and why it fails: from slot 20 prices are stale, from 30 keys are held."""
    held = table(spark, d, "orders")
    slotted = held.where("o_orderkey <= 1000").withColumn("slot", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("o_orderkey")).cast("bigint"))
    priors = slotted.where("slot < 30").withColumn("o_totalprice", F.expr("case when slot >= 20 then o_totalprice + 1 else o_totalprice end"))
    new = slotted.withColumn("o_orderkey", F.expr("case when slot < 30 then -1 - o_orderkey else o_orderkey end"))
    return W.first_failure(ORDERS, held, new, priors)


@query("commit_two_tables", "SELECT 'customer' AS name, count(*) AS n FROM customer UNION ALL SELECT 'orders', count(*) FROM orders")
def commit_two_tables(spark: SparkSession, d: str) -> DataFrame:
    """Two tables committed as one, then read by the version that both have."""
    root = scratch(spark)
    version = commit_all(spark, root, {n: table(spark, d, n) for n in ("customer", "orders")})
    counts = [VersionedTable(spark, root, n).read(version).agg(F.lit(n).alias("name"), F.count("*").alias("n")) for n in ("customer", "orders")]
    return counts[0].unionByName(counts[1])


@query("refusals", "SELECT unnest(['axis without a date', 'too many rows', 'scan not asked for', 'stale commit', 'key twice in a batch', 'text key with a separator', 'entity without a key', 'two attributes of one name', 'key of type double', 'axis without infinity']) AS asked, unnest(['ASOF-001', 'PLAN-007', 'PLAN-001', 'TXN-004', 'WRITE-004', 'KEY-001', 'CFG-001', 'CFG-013', 'CFG-016', 'CFG-003']) AS code")
def refusals(spark: SparkSession, d: str) -> DataFrame:
    """What is refused, and by which rule."""
    from palimpsest.views import BUSINESS, DOUBLE, STRING

    orders, name = table(spark, d, "orders"), Attribute("k", STRING, key=True)
    held, f = VersionedTable(spark, scratch(spark)), Finder(ORDERS, orders)
    held.commit(orders.limit(3))
    asked = {
        "axis without a date": lambda: Finder(PRIORITY, cust_priority(spark, d)).find(),
        "too many rows": lambda: f.where(f.o_custkey.gt(0)).strict(max_rows=3).find(),
        "scan not asked for": lambda: f.strict().find(),
        "stale commit": lambda: held.commit(orders.limit(4), after=0),
        "key twice in a batch": lambda: W.upsert(ORDERS, orders, orders.limit(1).unionByName(orders.limit(1))),
        "text key with a separator": lambda: spark.createDataFrame([("a#b",)], "k string").select(K.partition_key(Entity("Named", (name,)))).collect(),
        "entity without a key": lambda: Entity("E", (Attribute("v", STRING),)),
        "two attributes of one name": lambda: Entity("E", (name, Attribute("K", STRING))),
        "key of type double": lambda: Entity("E", (Attribute("v", DOUBLE, key=True),)),
        "axis without infinity": lambda: Entity("E", (name,), replace(BUSINESS, infinity=None)),
    }
    return spark.createDataFrame([(k, _code(v)) for k, v in asked.items()], "asked string, code string")


def _code(run) -> str:
    try:
        run()
    except Exception as x:
        found = re.search(r"[A-Z]{3,5}-[0-9]{3}", str(x))
        if not found:
            raise
        return found[0]
    return "not refused"


@query("scan_all_current", f"WITH {USER_STATE} SELECT user_id, event_id FROM user_state WHERE OUT_Z = {INF}")
def scan_all_current(spark: SparkSession, d: str) -> DataFrame:
    return Finder(STATE, user_state(spark, d)).find().select("user_id", "event_id")


@query("refresh_rectangle", f"WITH {CUST_PRIORITY} SELECT o_custkey, o_orderkey FROM cust_priority WHERE o_custkey % 50 = 1 AND FROM_Z < TIMESTAMP '1997-01-01'")
def refresh_rectangle(spark: SparkSession, d: str) -> DataFrame:
    held = cust_priority(spark, d).where("FROM_Z < TIMESTAMP_NTZ '1997-01-01'")
    return W.refresh(PRIORITY, held, cust_priority(spark, d).where("o_custkey % 50 = 1").distinct()).select("o_custkey", "o_orderkey")


@query("write_insert_conflicts", "SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 2 = 0")
def write_insert_conflicts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders")
    return W.insert_conflicts(ORDERS, rows.where("o_orderkey % 2 = 0"), rows.where("o_orderkey % 3 = 0")).select("o_orderkey")


@query("write_optimistic_check", "SELECT o_orderkey FROM orders WHERE o_orderkey % 10 = 0 AND o_orderkey % 20 = 0 AND o_totalprice IS NOT NULL")
def write_optimistic_check(spark: SparkSession, d: str) -> DataFrame:
    """Prior images that are stale: half of those checked had another price when they were read."""
    rows = table(spark, d, "orders")
    prior = rows.where("o_orderkey % 10 = 0").withColumn("o_totalprice", F.expr("case when o_orderkey % 20 = 0 then o_totalprice + 1 else o_totalprice end"))
    return W.stale(ORDERS, rows, prior).select("o_orderkey")


@query("upsert_latest_wins", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 4 = 0")
def upsert_latest_wins(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders")
    new = rows.where("o_orderkey % 4 = 0").withColumn("o_totalprice", F.col("o_totalprice") * 2)
    return W.upsert(ORDERS, rows.where("o_orderkey % 2 = 0"), new).select("o_orderkey", "o_totalprice")


@query("write_update", "SELECT o_orderkey, CASE WHEN o_orderkey % 100 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def write_update(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders")
    prior = rows.where("o_orderkey % 100 = 0")
    return W.update(ORDERS, rows, prior, prior.withColumn("o_orderstatus", F.lit("X"))).select("o_orderkey", "o_orderstatus")


@query("write_delete", "SELECT o_orderkey FROM orders WHERE NOT (o_orderkey % 50 = 0 AND o_orderkey % 100 <> 0)")
def write_delete(spark: SparkSession, d: str) -> DataFrame:
    """A quiet batch delete: images that are stale stay."""
    rows = table(spark, d, "orders")
    prior = rows.where("o_orderkey % 50 = 0").withColumn("o_custkey", F.expr("case when o_orderkey % 100 = 0 then o_custkey + 1 else o_custkey end"))
    return W.delete(ORDERS, rows, prior, quietly=True).select("o_orderkey")


@query("write_purge", f"WITH {USER_STATE} SELECT user_id, event_id FROM user_state WHERE user_id % 3 <> 0")
def write_purge(spark: SparkSession, d: str) -> DataFrame:
    rows = user_state(spark, d)
    return W.purge(STATE, rows, rows.where("user_id % 3 = 0").select("user_id").distinct()).select("user_id", "event_id")


@query("fold_staged_writes", "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def fold_staged_writes(spark: SparkSession, d: str) -> DataFrame:
    staged = table(spark, d, "events").select("user_id", "event_id", "event_type", F.struct("ts", "event_id").alias("seq"))
    return W.fold_staged(staged, ["user_id"], "seq").select("user_id", "event_id", "event_type")


@query("delete_where", "SELECT o_orderkey FROM orders WHERE NOT coalesce(CASE WHEN o_custkey % 11 = 0 THEN NULL ELSE o_totalprice > 100000 END, FALSE)")
def delete_where(spark: SparkSession, d: str) -> DataFrame:
    price = F.when(F.col("o_custkey") % 11 != 0, F.col("o_totalprice"))
    return W.delete_where(table(spark, d, "orders"), price > 100000).select("o_orderkey")


@query("update_where", "SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 'U' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def update_where(spark: SparkSession, d: str) -> DataFrame:
    return W.update_where(table(spark, d, "orders"), F.col("o_orderpriority") == "1-URGENT", {"o_orderstatus": F.lit("U")}).select("o_orderkey", "o_orderstatus")


@query("item_size_estimate", "SELECT o_orderkey, CAST(10 + 9 + 13 + 12 + 11 + 15 + ceil(length(CAST(o_orderkey AS VARCHAR)) / 2.0) + 1 + ceil(length(CAST(o_custkey AS VARCHAR)) / 2.0) + 1 + octet_length(encode(o_orderstatus)) + 8 + 17 + octet_length(encode(o_orderpriority)) AS BIGINT) AS bytes FROM orders")
def item_size_estimate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", K.row_size(ORDERS).alias("bytes"))


@query("key_derivation", f"WITH {BELIEF_LINE} SELECT l_orderkey, l_linenumber, concat('v1#BELIEFLINE#', l_orderkey, '#', l_linenumber) AS pk, concat('v1#P#', strftime(IN_Z, {TEXT}), '#B#', strftime(FROM_Z, {TEXT})) AS sk, concat('v1#BYCUST#o_custkey#', o_custkey) AS fk, OUT_Z = {INF} AS current FROM belief_line")
def key_derivation(spark: SparkSession, d: str) -> DataFrame:
    return belief_line(spark, d).select("l_orderkey", "l_linenumber", K.partition_key(LINE).alias("pk"), K.sort_key(LINE).alias("sk"), K.secondary_key(LINE, "BYCUST", ["o_custkey"]).alias("fk"), K.is_current(LINE).alias("current"))


@query("index_key_stamps", "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber <> 3 THEN concat('v1#BYPART#l_partkey#', l_partkey, '#l_suppkey#', l_suppkey) END AS fk FROM lineitem")
def index_key_stamps(spark: SparkSession, d: str) -> DataFrame:
    """A row with a null part has no secondary key."""
    rows = table(spark, d, "lineitem").withColumn("l_partkey", F.when(F.col("l_linenumber") != 3, F.col("l_partkey")))
    return rows.select("l_orderkey", "l_linenumber", K.secondary_key(LINEITEM, "BYPART", ["l_partkey", "l_suppkey"]).alias("fk"))

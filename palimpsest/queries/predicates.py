"""Typed predicates, boolean shapes, order and top-n, on the plain tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import predicates as P
from palimpsest.model import Attribute, Entity
from palimpsest.plans.domain import Domain, combinations
from palimpsest.plans.finder import Finder
from palimpsest.queries import query
from palimpsest.sources.tables import table
from palimpsest.views import CUSTOMER, INT, LINEITEM, LONG, ORDERS, STRING

C, O, L = P.attributes(CUSTOMER), P.attributes(ORDERS), P.attributes(LINEITEM)
#: Customers without a segment if the key is divisible by 7.
NULLABLE = Entity("CustNullable", (Attribute("c_custkey", LONG, key=True), Attribute("seg", STRING), Attribute("nation", INT)))
N = P.attributes(NULLABLE)
_NULLABLE = "n AS (SELECT c_custkey, CASE WHEN c_custkey % 7 <> 0 THEN c_mktsegment END AS seg, CASE WHEN c_custkey % 5 <> 0 THEN c_nationkey END AS nation FROM customer)"


def _customers(spark: SparkSession, d: str) -> Finder:
    return Finder(CUSTOMER, table(spark, d, "customer"))


def _orders(spark: SparkSession, d: str) -> Finder:
    return Finder(ORDERS, table(spark, d, "orders"))


def _lines(spark: SparkSession, d: str) -> Finder:
    return Finder(LINEITEM, table(spark, d, "lineitem"))


def _nullable(spark: SparkSession, d: str) -> Finder:
    return Finder(NULLABLE, table(spark, d, "customer").selectExpr("c_custkey", "case when c_custkey % 7 <> 0 then c_mktsegment end as seg", "case when c_custkey % 5 <> 0 then c_nationkey end as nation"))


def _simple(name: str, finder, condition, columns: list[str], sql: str) -> None:
    query(name, sql)(lambda spark, d: finder(spark, d).where(condition()).find().select(*columns))


_K = ["c_custkey", "seg"]
DAY = dt.datetime(1998, 6, 1)
_simple("pred_eq", _nullable, lambda: N["seg"].eq("BUILDING"), _K, f"WITH {_NULLABLE} SELECT c_custkey, seg FROM n WHERE seg = 'BUILDING'")
_simple("pred_not_eq", _nullable, lambda: N["seg"].not_eq("BUILDING"), _K, f"WITH {_NULLABLE} SELECT c_custkey, seg FROM n WHERE seg <> 'BUILDING'")
_simple("pred_gt", _customers, lambda: C["c_acctbal"].gt(5000.0), ["c_custkey", "c_acctbal"], "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 5000")
_simple("pred_gte", _orders, lambda: O["o_orderdate"].gte(DAY), ["o_orderkey", "o_orderdate"], "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '1998-06-01'")
_simple("pred_lt", _customers, lambda: C["c_custkey"].lt(100), ["c_custkey", "c_name"], "SELECT c_custkey, c_name FROM customer WHERE c_custkey < 100")
_simple("pred_lte", _orders, lambda: O["o_totalprice"].lte(50000.0), ["o_orderkey", "o_totalprice"], "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice <= 50000")
_simple("pred_between", _lines, lambda: L["l_quantity"].between(10.0, 12.0), ["l_orderkey", "l_linenumber", "l_quantity"], "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity BETWEEN 10 AND 12")
_simple("pred_in", _nullable, lambda: N["seg"].is_in(["BUILDING", "MACHINERY"]), _K, f"WITH {_NULLABLE} SELECT c_custkey, seg FROM n WHERE seg IN ('BUILDING', 'MACHINERY')")
_simple("pred_not_in", _nullable, lambda: N["seg"].not_in(["BUILDING", "MACHINERY"]), _K, f"WITH {_NULLABLE} SELECT c_custkey, seg FROM n WHERE seg NOT IN ('BUILDING', 'MACHINERY')")
_simple("pred_is_null", _nullable, lambda: N["seg"].is_null(), _K, f"WITH {_NULLABLE} SELECT c_custkey, seg FROM n WHERE seg IS NULL")
_simple("pred_is_not_null", _nullable, lambda: N["seg"].is_not_null(), _K, f"WITH {_NULLABLE} SELECT c_custkey, seg FROM n WHERE seg IS NOT NULL")
for _name, _test, _sql in (
    ("pred_starts_with", lambda: N["seg"].starts_with("B"), "seg LIKE 'B%'"),
    ("pred_ends_with", lambda: N["seg"].ends_with("G"), "seg LIKE '%G'"),
    ("pred_contains", lambda: N["seg"].contains("O"), "seg LIKE '%O%'"),
    ("pred_not_starts_with", lambda: N["seg"].not_starts_with("B"), "seg NOT LIKE 'B%'"),
    ("pred_not_ends_with", lambda: N["seg"].not_ends_with("G"), "seg NOT LIKE '%G'"),
    ("pred_not_contains", lambda: N["seg"].not_contains("O"), "seg NOT LIKE '%O%'"),
    ("pred_wildcard", lambda: N["seg"].wildcard("?U*G"), "seg LIKE '_U%G'"),
    ("pred_wildcard_not", lambda: N["seg"].not_wildcard("?U*G"), "seg NOT LIKE '_U%G'"),
    ("pred_like", lambda: N["seg"].like("%ACHI%"), "seg LIKE '%ACHI%'"),
):
    _simple(_name, _nullable, _test, _K, f"WITH {_NULLABLE} SELECT c_custkey, seg FROM n WHERE {_sql}")
_simple("pred_self_eq", _lines, lambda: F.col("l_partkey") % 100 == F.col("l_suppkey") % 100, ["l_orderkey", "l_linenumber"], "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey % 100 = l_suppkey % 100")
_simple("pred_tuple_in", _lines, lambda: P.tuple_in(["l_orderkey", "l_linenumber"], [(1, 1), (2, 2), (3, 1), (100, 1)]), ["l_orderkey", "l_linenumber", "l_quantity"], "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE (l_orderkey, l_linenumber) IN ((1, 1), (2, 2), (3, 1), (100, 1))")
_simple("bool_and_residual", _orders, lambda: O["o_orderstatus"].eq("F") & O["o_orderpriority"].ends_with("H") & O["o_totalprice"].gt(100000.0), ["o_orderkey"], "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority LIKE '%H' AND o_totalprice > 100000")
_simple("bool_or_mixed", _orders, lambda: O["o_orderkey"].lt(50) | O["o_orderpriority"].starts_with("1"), ["o_orderkey"], "SELECT o_orderkey FROM orders WHERE o_orderkey < 50 OR o_orderpriority LIKE '1%'")
_simple("bool_nested", _orders, lambda: (O["o_orderstatus"].eq("O") | O["o_totalprice"].lt(2000.0)) & (O["o_orderpriority"].contains("URG") | O["o_custkey"].is_in([1, 2, 3])), ["o_orderkey"], "SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'O' OR o_totalprice < 2000) AND (o_orderpriority LIKE '%URG%' OR o_custkey IN (1, 2, 3))")
_simple("bool_dnf", _orders, lambda: P.any_of(*[P.all_of(O["o_custkey"].eq(k), O["o_orderstatus"].eq(s)) for k in (1, 2, 4, 7) for s in "FO"]), ["o_orderkey", "o_custkey"], "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (1, 2, 4, 7) AND o_orderstatus IN ('F', 'O')")
_simple("bool_demorgan", _nullable, lambda: N["seg"].not_eq("BUILDING") & N["nation"].not_in([1, 2, 3]), _K, f"WITH {_NULLABLE} SELECT c_custkey, seg FROM n WHERE NOT (seg = 'BUILDING' OR nation IN (1, 2, 3))")
_simple("empty_contradiction", _orders, lambda: P.all_of(O["o_orderkey"].eq(1), O["o_orderkey"].eq(2)), ["o_orderkey"], "SELECT o_orderkey FROM orders WHERE FALSE")
_simple("empty_none", _orders, lambda: P.nothing(), ["o_orderkey"], "SELECT o_orderkey FROM orders WHERE FALSE")
_simple("pk_domain_intersection", _orders, lambda: Domain("o_orderkey").among(range(1, 200)).without([5, 6]).above(3).below(40, inclusive=True).column(), ["o_orderkey"], "SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT unnest(range(1, 200))) AND o_orderkey NOT IN (5, 6) AND o_orderkey > 3 AND o_orderkey <= 40")
_simple("composite_pk_in", _lines, lambda: P.tuple_in(["l_orderkey", "l_linenumber"], combinations([Domain("l_orderkey").among(range(1, 30)), Domain("l_linenumber").among([1, 2])])), ["l_orderkey", "l_linenumber"], "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey BETWEEN 1 AND 29 AND l_linenumber IN (1, 2)")
_simple("pred_multi_equality", _orders, lambda: P.all_of(O["o_custkey"].eq(4), O["o_orderstatus"].eq("F")), ["o_orderkey"], "SELECT o_orderkey FROM orders WHERE o_custkey = 4 AND o_orderstatus = 'F'")
_simple("pred_all", _customers, lambda: P.everything(), ["c_custkey"], "SELECT c_custkey FROM customer")


@query("pred_in_large", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def pred_in_large(spark: SparkSession, d: str) -> DataFrame:
    keys = table(spark, d, "customer").where("c_acctbal > 0").select("c_custkey")
    return P.semi_in(table(spark, d, "orders"), "o_custkey", keys).select("o_orderkey", "o_custkey")


@query("pred_tuple_exists", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND (o_custkey % 7) + 1 = l_linenumber)")
def pred_tuple_exists(spark: SparkSession, d: str) -> DataFrame:
    tuples = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), ((F.col("o_custkey") % 7) + 1).cast("int").alias("l_linenumber"))
    return P.tuple_exists(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], tuples).select("l_orderkey", "l_linenumber")


_IEEE = "x AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN CAST('nan' AS DOUBLE) WHEN 1 THEN CAST('inf' AS DOUBLE) WHEN 2 THEN CAST('-inf' AS DOUBLE) WHEN 3 THEN NULL ELSE value END AS v FROM events)"


@query("pred_double_ieee", f"WITH {_IEEE} SELECT event_id, CASE WHEN v IS NULL THEN NULL ELSE v > 50 AND NOT isnan(v) END AS gt, CASE WHEN v IS NULL THEN NULL ELSE v <> 50 OR isnan(v) END AS ne, CASE WHEN v IS NULL THEN NULL ELSE FALSE END AS eq_nan FROM x")
def pred_double_ieee(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import types as T

    v = "case event_id % 5 when 0 then double('nan') when 1 then double('inf') when 2 then double('-inf') when 3 then null else value end"
    a, kept = P.Attr("v", T.DoubleType()), F.col("v").isNotNull()
    rows = table(spark, d, "events").selectExpr("event_id", f"{v} as v")
    return rows.select("event_id", F.when(kept, a.gt(50.0)).alias("gt"), F.when(kept, a.not_eq(50.0)).alias("ne"), F.when(kept, a.eq(float("nan"))).alias("eq_nan"))


@query("pred_decimal_scale", "SELECT o_orderkey FROM orders WHERE CAST(round(o_totalprice, 0) AS DECIMAL(30, 4)) % 10 IN (1.10 - 0.10, 2.5 * 2)")
def pred_decimal_scale(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import types as T

    rows = table(spark, d, "orders").selectExpr("o_orderkey", "cast(cast(round(o_totalprice, 0) as decimal(30, 4)) % 10 as decimal(30, 4)) as last")
    return rows.where(P.Attr("last", T.DecimalType(30, 4)).is_in(["1.0", "5.00"])).select("o_orderkey")


@query("order_multi_key", f"WITH {_NULLABLE} SELECT c_custkey, row_number() OVER (ORDER BY seg ASC NULLS FIRST, nation DESC NULLS LAST, c_custkey ASC) AS place FROM n ORDER BY place LIMIT 200")
def order_multi_key(spark: SparkSession, d: str) -> DataFrame:
    """The first 200 of a chained order; the place is kept in a column, as sets of rows are compared without order."""
    top = _nullable(spark, d).order_by("seg", F.col("nation").desc()).top(200).find()
    return top.selectExpr("c_custkey", "seg", "nation").withColumn("place", F.row_number().over(_window()).cast("bigint")).select("c_custkey", "place")


def _window():
    from pyspark.sql import Window

    # over the 200 rows that are left
    return Window.orderBy("seg", F.col("nation").desc(), "c_custkey")


@query("top_n", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 25")
def top_n(spark: SparkSession, d: str) -> DataFrame:
    return _orders(spark, d).order_by(F.col("o_totalprice").desc()).top(25).find().select("o_orderkey", "o_totalprice")


@query("limit_unordered", "SELECT CAST(10 AS BIGINT) AS n")
def limit_unordered(spark: SparkSession, d: str) -> DataFrame:
    """Any ten rows: only their number is defined."""
    return _orders(spark, d).top(10).find().agg(F.count("*").alias("n"))


@query("order_binary", "SELECT c_custkey, row_number() OVER (ORDER BY unhex(substring(md5(c_name), 1, 6)), c_custkey) AS place FROM customer ORDER BY place LIMIT 50")
def order_binary(spark: SparkSession, d: str) -> DataFrame:
    """Bytes order unsigned, a prefix before what it begins."""
    from pyspark.sql import Window

    rows = table(spark, d, "customer").select("c_custkey", F.unhex(F.substring(F.md5("c_name"), 1, 6)).alias("bytes"))
    first = rows.orderBy("bytes", "c_custkey").limit(50)
    return first.withColumn("place", F.row_number().over(Window.orderBy("bytes", "c_custkey")).cast("bigint")).select("c_custkey", "place")


@query("union_dedup", "SELECT o_orderkey FROM orders WHERE o_custkey < 20 UNION SELECT o_orderkey FROM orders WHERE o_totalprice > 300000")
def union_dedup(spark: SparkSession, d: str) -> DataFrame:
    f = _orders(spark, d)
    a, b = f.where(O["o_custkey"].lt(20)).find(), f.where(O["o_totalprice"].gt(300000.0)).find()
    return a.select("o_orderkey").unionByName(b.select("o_orderkey")).dropDuplicates()


@query("count_find", "SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority LIKE '%H'")
def count_find(spark: SparkSession, d: str) -> DataFrame:
    return _orders(spark, d).where(O["o_orderstatus"].eq("F") & O["o_orderpriority"].ends_with("H")).count()


@query("agg_group_having", "SELECT o_custkey, count(*) AS n, max(o_totalprice) AS top, CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) AS total FROM orders WHERE o_orderstatus <> 'P' GROUP BY o_custkey HAVING count(*) >= 5 AND (max(o_totalprice) > 200000 OR count(*) <> 6)")
def agg_group_having(spark: SparkSession, d: str) -> DataFrame:
    total = F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double")
    return _orders(spark, d).where(O["o_orderstatus"].not_eq("P")).aggregate(["o_custkey"], (F.col("n") >= 5) & ((F.col("top") > 200000) | (F.col("n") != 6)), n=F.count("*"), top=F.max("o_totalprice"), total=total)


@query("compute_function", "SELECT o_orderkey, upper(substring(o_orderpriority, 3)) AS word, year(o_orderdate) AS y, o_totalprice * 2 AS twice FROM orders")
def compute_function(spark: SparkSession, d: str) -> DataFrame:
    out = _orders(spark, d).compute(word="upper(substring(o_orderpriority, 3))", y="cast(year(o_orderdate) as bigint)", twice="o_totalprice * 2")
    return out.select("o_orderkey", "word", "y", "twice")

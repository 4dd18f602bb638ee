"""Navigation between entities, and the decision table."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.temporal import as_of
from palimpsest.model import INFINITY, Attribute, Axis, Entity, Relationship
from palimpsest.operators import director, relate, rules
from palimpsest.queries import BELIEF_LINE, INF, TEXT, belief_log, query
from palimpsest.queries.temporal import B, P, asof_sql
from palimpsest.sources.tables import table
from palimpsest.views import BELIEF, BELIEF_LINE as LINE, CUSTOMER, DOUBLE, INT, LINEITEM, LONG, ORDERS, STRING, belief_line, belief_log as log_of

_LINES_AT = f"lines AS (SELECT * FROM belief_line WHERE FROM_Z <= TIMESTAMP '1998-06-01' AND THRU_Z > TIMESTAMP '1998-06-01' AND IN_Z <= TIMESTAMP '1999-01-01' AND OUT_Z > TIMESTAMP '1999-01-01')"
_PARENTS_AT = f"parents AS ({asof_sql('TIMESTAMP ' + repr('1998-06-01'), 'TIMESTAMP ' + repr('1999-01-01'))})"
_BOTH = f"WITH {belief_log('updates')}, {_PARENTS_AT}, {BELIEF_LINE}, {_LINES_AT}"


def _parents(spark: SparkSession, d: str) -> DataFrame:
    return as_of(director.fold(BELIEF, log_of(spark, d, "updates")), BELIEF, B, P)


@query("rel_one_to_many", f"{_BOTH} SELECT o_custkey, value, l_orderkey, l_linenumber FROM parents JOIN lines USING (o_custkey)")
def rel_one_to_many(spark: SparkSession, d: str) -> DataFrame:
    """The parent's dates hold for the children."""
    out = relate.joined(BELIEF.relationship("lines"), _parents(spark, d), LINE, belief_line(spark, d), B, P)
    return out.select("o_custkey", "value", F.col("child_l_orderkey").alias("l_orderkey"), F.col("child_l_linenumber").alias("l_linenumber"))


def _of_lines(spark: SparkSession, d: str, lines: DataFrame) -> DataFrame:
    out = relate.joined(LINE.relationship("belief"), as_of(lines, LINE, B, P), BELIEF, director.fold(BELIEF, log_of(spark, d, "updates")), B, P)
    return out.select("l_orderkey", "l_linenumber", "o_custkey", F.col("child_value").alias("value"))


@query("rel_many_to_one", f"{_BOTH} SELECT l_orderkey, l_linenumber, o_custkey, value FROM lines JOIN parents USING (o_custkey)")
def rel_many_to_one(spark: SparkSession, d: str) -> DataFrame:
    """The parents of all lines."""
    return _of_lines(spark, d, belief_line(spark, d))


@query("deep_fetch_one", f"{_BOTH} SELECT o_custkey, CAST(count(l_orderkey) AS BIGINT) AS n, CAST(coalesce(sum(l_orderkey), 0) AS BIGINT) AS keys FROM parents LEFT JOIN lines USING (o_custkey) GROUP BY o_custkey")
def deep_fetch_one(spark: SparkSession, d: str) -> DataFrame:
    out = relate.deep_fetch(BELIEF.relationship("lines"), _parents(spark, d), LINE, belief_line(spark, d), "lines", B, P, ["l_orderkey", "l_linenumber"])
    return out.select("o_custkey", F.size("lines").cast("bigint").alias("n"), F.aggregate("lines", F.lit(0).cast("bigint"), lambda a, x: a + x["l_orderkey"]).alias("keys"))


@query("deep_fetch_two", "SELECT c_custkey, count(DISTINCT o_orderkey) AS orders, count(l_linenumber) AS lines FROM customer LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY c_custkey")
def deep_fetch_two(spark: SparkSession, d: str) -> DataFrame:
    """Children with their children: one join a level."""
    orders = relate.deep_fetch(ORDERS.relationship("lines"), table(spark, d, "orders").select("o_orderkey", "o_custkey"), LINEITEM, table(spark, d, "lineitem"), "lines", columns=["l_linenumber", "l_quantity"])
    whole = Entity("Orders", (Attribute("o_orderkey", LONG, key=True), Attribute("o_custkey", LONG)))
    out = relate.deep_fetch(CUSTOMER.relationship("orders"), table(spark, d, "customer").select("c_custkey"), whole, orders, "orders", columns=["o_orderkey", "lines"])
    lines = F.aggregate("orders", F.lit(0).cast("bigint"), lambda a, x: a + F.size(x["lines"]))
    return out.select("c_custkey", F.size("orders").cast("bigint").alias("orders"), lines.alias("lines"))


@query("rel_lonely_parent", "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 350000 GROUP BY c_custkey")
def rel_lonely_parent(spark: SparkSession, d: str) -> DataFrame:
    out = relate.joined(CUSTOMER.relationship("orders"), table(spark, d, "customer"), ORDERS, table(spark, d, "orders").where("o_totalprice > 350000"), how="left")
    return out.groupBy("c_custkey").agg(F.count("child_o_orderkey").alias("n"))


@query("rel_semi_predicate", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def rel_semi_predicate(spark: SparkSession, d: str) -> DataFrame:
    return relate.exists(CUSTOMER.relationship("orders"), table(spark, d, "customer"), table(spark, d, "orders"), F.col("o_totalprice") > 300000).select("c_custkey")


@query("rel_exists", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def rel_exists(spark: SparkSession, d: str) -> DataFrame:
    return relate.exists(CUSTOMER.relationship("orders"), table(spark, d, "customer"), table(spark, d, "orders")).select("c_custkey")


@query("rel_not_exists", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def rel_not_exists(spark: SparkSession, d: str) -> DataFrame:
    return relate.not_exists(CUSTOMER.relationship("orders"), table(spark, d, "customer"), table(spark, d, "orders"), F.col("o_orderstatus") == "F").select("c_custkey")


SUPPLIER = Entity("Supplier", (Attribute("s_suppkey", LONG, key=True), Attribute("chief", LONG), Attribute("s_nationkey", INT), Attribute("s_acctbal", DOUBLE)), relationships=(Relationship("manager", "Supplier", (("chief", "s_suppkey"),), many=False),))


@query("rel_self", "SELECT s.s_suppkey, m.s_suppkey AS manager, m.s_acctbal AS manager_balance FROM supplier s JOIN supplier m ON m.s_suppkey = s.s_suppkey // 10 + 1")
def rel_self(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "supplier").selectExpr("s_suppkey", "s_suppkey div 10 + 1 as chief", "s_nationkey", "s_acctbal")
    out = relate.joined(SUPPLIER.relationship("manager"), rows, SUPPLIER, rows, prefix="m_")
    return out.select("s_suppkey", F.col("m_s_suppkey").alias("manager"), F.col("m_s_acctbal").alias("manager_balance"))


@query("rel_related", "SELECT DISTINCT n_nationkey, n_name FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE c_acctbal > 9000")
def rel_related(spark: SparkSession, d: str) -> DataFrame:
    nation = Entity("Nation", (Attribute("n_nationkey", INT, key=True), Attribute("n_name", STRING), Attribute("n_regionkey", INT)))
    return relate.related(CUSTOMER.relationship("nation"), table(spark, d, "customer").where("c_acctbal > 9000"), nation, table(spark, d, "nation")).select("n_nationkey", "n_name")


_TIMELINE = f"prices AS (SELECT o_custkey, o_orderkey, o_orderdate AS FROM_Z, coalesce(lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), {INF}) AS THRU_Z FROM orders)"


_COMMON = f"WITH {BELIEF_LINE}, {_TIMELINE} SELECT l_orderkey, l_linenumber, p.o_orderkey AS priority_order, strftime(greatest(l.FROM_Z, p.FROM_Z), {TEXT}) AS since, strftime(least(l.THRU_Z, p.THRU_Z), {TEXT}) AS until FROM belief_line l JOIN prices p ON l.o_custkey = p.o_custkey AND greatest(l.FROM_Z, p.FROM_Z) < least(l.THRU_Z, p.THRU_Z)"


def _joined_in_time(spark: SparkSession, d: str, lines: DataFrame) -> DataFrame:
    from palimpsest.functions.temporal import encode
    from palimpsest.views import CUST_PRIORITY, cust_priority

    out = relate.temporal_join(LINE, lines, CUST_PRIORITY, cust_priority(spark, d), [("o_custkey", "o_custkey")])
    return out.select("l_orderkey", "l_linenumber", F.col("r_o_orderkey").alias("priority_order"), encode("common_FROM_Z").alias("since"), encode("common_THRU_Z").alias("until"))


@query("temporal_join", _COMMON)
def temporal_join(spark: SparkSession, d: str) -> DataFrame:
    """Lines of all customers and the order in force, with the time that both hold."""
    return _joined_in_time(spark, d, belief_line(spark, d))


# Cars, and rules with the date from which they hold.
CARS = (
    (1, 1985, "Toyota", "MR2", 4, "RED", "COUPE", "4CYL"), (2, 1985, "Toyota", "Corolla", 4, "WHITE", "SEDAN", "4CYL"), (3, 1972, "Volkswagen", "Beetle", 4, "YELLOW", "SEDAN", "4CYL"),
    (4, 1957, "Chevrolet", "Bel Air", 4, "TURQUOISE", "COUPE", "V8"), (5, 2018, "Tesla", "Model 3", 4, "BLACK", "SEDAN", "ELECTRIC"), (6, 2005, "Honda", "Civic", 4, "SILVER", "SEDAN", "4CYL"),
    (7, 1985, "Reliant", "Robin", 3, "BLUE", "SEDAN", "4CYL"), (8, 1994, "Mazda", "MX-5", 4, "RED", "COUPE", "4CYL"), (9, 1965, "Ford", "Mustang", 4, "BLUE", "COUPE", "V8"), (10, 2020, "Porsche", "911", 4, "YELLOW", "COUPE", "FLAT6"),
)
RULES = ((1, "2010-01-01", 40, "COOL"), (2, "2015-01-01", 70, "EIGHTIES_COOL"), (3, "2020-01-01", 80, "RETRO"), (4, "2010-01-01", 50, "CLASSIC"), (5, "2022-01-01", 90, "VINTAGE"), (6, "2010-01-01", 100, "EXOTIC"), (7, "2018-01-01", 60, "MODERN"))
CRITERIA = ((1, "car_year", "BETWEEN", None, 1980.0, 1989.0), (2, "car_year", "BETWEEN", None, 1980.0, 1989.0), (2, "body_style", "EQ", "COUPE", None, None), (3, "car_year", "BETWEEN", None, 1980.0, 1989.0), (4, "car_year", "LT", None, 1975.0, None), (5, "car_year", "LT", None, 1960.0, None), (6, "wheel_count", "NE", None, 4.0, None), (7, "car_year", "GT", None, 2015.0, None))
ASKED = ("2012-06-01", "2016-06-01", "2021-06-01", "2026-09-12")
RULE = Entity("Rule", (Attribute("rule_id", INT, key=True), Attribute("rule_name", STRING), Attribute("priority", INT), Attribute("label", STRING)), Axis("businessDate", "FROM_Z", "THRU_Z"), Axis("processingDate", "IN_Z", "OUT_Z", default=INFINITY))
_SEEN = dt.datetime(2010, 1, 1)
_V = ", ".join(f"({r[0]}, DATE '{r[1]}', {r[2]}, '{r[3]}')" for r in RULES)
_CV = ", ".join(f"({c[0]}, {c[1]}, '{c[6]}', {c[4]})" for c in CARS)
_MATCH = "CASE rule_id WHEN 1 THEN y BETWEEN 1980 AND 1989 WHEN 2 THEN y BETWEEN 1980 AND 1989 AND body = 'COUPE' WHEN 3 THEN y BETWEEN 1980 AND 1989 WHEN 4 THEN y < 1975 WHEN 5 THEN y < 1960 WHEN 6 THEN wheels <> 4 WHEN 7 THEN y > 2015 END"


@query("classify_asof", f"WITH cars(car_id, y, body, wheels) AS (VALUES {_CV}), rules(rule_id, since, priority, label) AS (VALUES {_V}), dates AS (SELECT unnest([{', '.join(f'DATE {x!r}' for x in ASKED)}]) AS as_of), hit AS (SELECT as_of, car_id, rule_id, label FROM cars, dates, rules WHERE since <= as_of AND {_MATCH} QUALIFY row_number() OVER (PARTITION BY as_of, car_id ORDER BY priority DESC, rule_id) = 1) SELECT strftime(d.as_of, '%Y-%m-%d') AS as_of, c.car_id, CAST(coalesce(h.rule_id, 0) AS BIGINT) AS rule_id, coalesce(h.label, 'UNCLASSIFIED') AS label FROM cars c CROSS JOIN dates d LEFT JOIN hit h ON h.as_of = d.as_of AND h.car_id = c.car_id")
def classify_asof(spark: SparkSession, d: str) -> DataFrame:
    cars = spark.createDataFrame(list(CARS), "car_id int, car_year int, make string, model string, wheel_count int, color string, body_style string, engine string")
    table_rows = [(r[0], f"R{r[0]}", r[2], r[3], dt.datetime.fromisoformat(r[1]), INFINITY, _SEEN, INFINITY) for r in RULES]
    held = spark.createDataFrame(table_rows, RULE.schema()).withColumn("active", F.lit(True))
    criteria = spark.createDataFrame(list(CRITERIA), "rule_id int, attribute string, operator string, text string, low double, high double")
    out = None
    for day in ASKED:
        now = as_of(held, RULE, dt.datetime.fromisoformat(day), INFINITY)
        part = rules.classify(cars, ["car_id"], now, criteria, ["car_year", "wheel_count"], ["make", "model", "color", "body_style", "engine"]).select(F.lit(day).alias("as_of"), "car_id", "rule_id", "label")
        out = part if out is None else out.unionByName(part)
    return out


@query("classify_orders", "SELECT o_orderkey, CASE WHEN o_totalprice > 300000 AND o_orderstatus = 'F' THEN 'LARGE_DONE' WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'SOON' WHEN o_totalprice < 20000 THEN 'SMALL' ELSE 'UNCLASSIFIED' END AS label FROM orders")
def classify_orders(spark: SparkSession, d: str) -> DataFrame:
    """The decision table over a whole table."""
    table_rows = [(1, "large", 30, "LARGE_DONE", True), (2, "soon", 20, "SOON", True), (3, "small", 10, "SMALL", True), (4, "never", 99, "NEVER", True), (5, "off", 98, "OFF", False)]
    held = spark.createDataFrame(table_rows, "rule_id int, rule_name string, priority int, label string, active boolean")
    criteria = spark.createDataFrame([(1, "o_totalprice", "GT", None, 300000.0, None), (1, "o_orderstatus", "EQ", "F", None, None), (2, "o_orderpriority", "IN", "1-URGENT, 2-HIGH", None, None), (3, "o_totalprice", "LT", None, 20000.0, None), (5, "o_totalprice", "GT", None, 0.0, None)], "rule_id int, attribute string, operator string, text string, low double, high double")
    return rules.classify(table(spark, d, "orders"), ["o_orderkey"], held, criteria, ["o_totalprice"], ["o_orderstatus", "o_orderpriority"]).select("o_orderkey", "label")

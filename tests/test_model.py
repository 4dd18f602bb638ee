from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.functions import keys as K
from palimpsest.functions import predicates as P
from palimpsest.functions.temporal import EDGE, as_of, decode, encode
from palimpsest.model import INFINITY, Attribute, Axis, Entity, ModelError, QueryError, Relationship, spark_type, tick
from palimpsest.plans.domain import Domain, combinations
from palimpsest.plans.finder import Finder
from palimpsest.sources import xml_model

INT, LONG, DOUBLE, STRING = T.IntegerType(), T.LongType(), T.DoubleType(), T.StringType()


def t(ms: int) -> dt.datetime:
    return dt.datetime(1970, 1, 1) + dt.timedelta(milliseconds=ms)


# One row a line, of every type.
ROWS = [
    (1, -10, -9007199254740993, -10.5, -10.5, "-10.5000", "alpha", False, t(-1001), b"\x00\xff"),
    (2, 0, 0, 0.0, 0.0, "0.0000", "", False, t(-1), b""),
    (3, 2, 9007199254740992, 2.5, 2.5, "2.5000", "beta", True, t(0), b"\x01\x02"),
    (4, 10, 9007199254740993, 10.5, 10.5, "10.5000", "alphabet", True, t(1), b"\x80"),
    (5, None, None, None, None, None, None, None, None, None),
    (6, 2, 9007199254740992, 2.5, 2.5, "2.5000", "zbeta", True, t(0), b"\x01\x02"),
    (7, 100, 9007199254740994, 100.5, 100.5, "100.5000", "aXmidYz", False, t(1001), b"\xff"),
]
KINDS = {"i": INT, "l": LONG, "d": DOUBLE, "f": T.FloatType(), "n": T.DecimalType(30, 4), "s": STRING, "b": T.BooleanType(), "t": T.TimestampNTZType(), "y": T.BinaryType()}
VALUES = Entity("Values", (Attribute("row_id", INT, key=True), *(Attribute(n, k) for n, k in KINDS.items())))
A = {n: P.Attr(n, k) for n, k in KINDS.items()}


@pytest.fixture(scope="module")
def values(spark):
    raw = spark.createDataFrame(ROWS, "row_id int, i int, l bigint, d double, f float, n string, s string, b boolean, t timestamp_ntz, y binary")
    return VALUES.conform(raw.withColumn("n", F.col("n").cast("decimal(30,4)")))


def ids(df) -> list[int]:
    return sorted(r["row_id"] for r in df.collect())


CASES = {
    "i": (2, [-10, 2]), "l": (9007199254740992, [-9007199254740993, 9007199254740992]), "d": (2.5, [-10.5, 2.5]), "f": (2.5, [-10.5, 2.5]), "n": ("2.5", ["-10.5", "2.50"]),
    "t": (t(0), [t(-1001), t(0)]), "y": (b"\x01\x02", [b"\x00\xff", b"\x01\x02"]),
}


@pytest.mark.parametrize("name", CASES)
def test_type_by_operator(values, name):
    value, some = CASES[name]
    a = A[name]
    assert ids(values.where(a.eq(value))) == [3, 6]
    assert ids(values.where(a.not_eq(value))) == [1, 2, 4, 7]
    assert ids(values.where(a.gt(value))) == [4, 7]
    assert ids(values.where(a.lt(value))) == [1, 2]
    assert ids(values.where(a.gte(value))) == [3, 4, 6, 7]
    assert ids(values.where(a.lte(value))) == [1, 2, 3, 6]
    assert ids(values.where(a.between(value, value))) == [3, 6]
    assert ids(values.where(a.is_in(some))) == [1, 3, 6]
    assert ids(values.where(a.not_in(some))) == [2, 4, 7]
    assert ids(values.where(a.is_null())) == [5]
    assert ids(values.where(a.is_not_null())) == [1, 2, 3, 4, 6, 7]


def test_texts_and_booleans(values):
    s, b = A["s"], A["b"]
    for test, want in (
        (s.eq("beta"), [3]), (s.not_eq("beta"), [1, 2, 4, 6, 7]), (s.gt("beta"), [6]), (s.lt("beta"), [1, 2, 4, 7]), (s.is_in(["alpha", "beta"]), [1, 3]), (b.eq(True), [3, 4, 6]), (b.not_eq(True), [1, 2, 7]), (b.is_in([True, False]), [1, 2, 3, 4, 6, 7]),
        (s.starts_with("alpha"), [1, 4]), (s.ends_with("beta"), [3, 6]), (s.contains("pha"), [1, 4]), (s.not_starts_with("alpha"), [2, 3, 6, 7]), (s.not_ends_with("beta"), [1, 2, 4, 7]), (s.not_contains("pha"), [2, 3, 6, 7]),
        (s.is_in([]), []), (s.not_in([]), [1, 2, 3, 4, 6, 7]), (P.all_of(), [1, 2, 3, 4, 5, 6, 7]), (P.any_of(), []),
        ((s.starts_with("a") | A["i"].eq(2)) & ~A["b"].is_null() & A["i"].not_eq(10), [1, 3, 6, 7]),
    ):
        assert ids(values.where(test)) == want
    for bad in (lambda: s.eq(None), lambda: s.is_in(["a", None]), lambda: A["i"].is_in(range(P.LITERAL_LIMIT + 1))):
        with pytest.raises(QueryError):
            bad()


def test_large_sets_are_joined(spark, values):
    many = spark.range(0, 5000).select(F.col("id").cast("int").alias("v"))
    assert ids(P.semi_in(values, "i", many)) == [2, 3, 4, 6, 7]


def test_wildcards(spark):
    texts = ["aXmidYz", "a_mid_z", "amidYz", "aXmidYzx", "a*", "a%b", "a_b", "a?b", None, "a\\b", "a'b"]
    df = spark.createDataFrame([(i + 1, x) for i, x in enumerate(texts)], "row_id int, s string")
    for pattern, want in (("a?mid*z", [1, 2]), ("a%b", [6]), ("a_b", [7]), ("a'?b", [8]), ("a'*", [5]), ("a\\b", [10]), ("a''b", [11]), ("*", [1, 2, 3, 4, 5, 6, 7, 8, 10, 11])):
        assert ids(df.where(P.Attr("s").wildcard(pattern))) == want
    assert ids(df.where(P.Attr("s").not_wildcard("a*"))) == []


def test_ieee(spark):
    df = spark.createDataFrame([(1, float("-inf")), (2, float("inf")), (3, float("nan")), (4, None), (5, -0.0)], "row_id int, v double")
    v = P.Attr("v", DOUBLE)
    nan = float("nan")
    for test, want in ((v.gt(0.0), [2]), (v.lt(0.0), [1]), (v.gte(0.0), [2, 5]), (v.eq(nan), []), (v.not_eq(nan), [1, 2, 3, 5]), (v.not_eq(1.0), [1, 2, 3, 5]), (v.eq(0.0), [5]), (v.is_in([nan, 0.0]), [5]), (v.not_in([0.0]), [1, 2, 3]), (v.gt(nan), [])):
        assert ids(df.where(test)) == want


def test_exact_order(spark):
    df = spark.createDataFrame([(1, "9007199254740993.0000"), (2, "9007199254740992.0000"), (3, "9007199254740994.0000"), (4, None)], "row_id int, n string")
    e = Entity("D", (Attribute("row_id", INT, key=True), Attribute("n", T.DecimalType(30, 4))))
    f = Finder(e, df.withColumn("n", F.col("n").cast("decimal(30,4)")))
    assert [r["row_id"] for r in f.order_by("n").find().collect()] == [4, 2, 1, 3]
    assert [r["row_id"] for r in f.order_by(F.col("n").desc()).top(2).find().collect()] == [3, 1]


B0, B1, B2 = dt.datetime(2026, 1, 1), dt.datetime(2026, 6, 1), dt.datetime(2026, 9, 1)
P0, P1 = dt.datetime(2026, 3, 1, 9), dt.datetime(2026, 3, 2, 9)
BALANCE = Entity("Balance", (Attribute("id", INT, key=True), Attribute("label", STRING)), Axis("businessDate", "FROM_Z", "THRU_Z"), Axis("processingDate", "IN_Z", "OUT_Z", default=INFINITY))


@pytest.fixture(scope="module")
def balance(spark):
    rows = [(201, "t1", B0, B2, P0, P1), (201, "t2", B0, B1, P1, INFINITY), (201, "t3", B1, B2, P1, INFINITY), (201, "t4", B2, INFINITY, P0, INFINITY)]
    return spark.createDataFrame(rows, BALANCE.schema())


MS = dt.timedelta(milliseconds=1)


@pytest.mark.parametrize(("business", "processing", "want"), [
    (B1 + MS, P0, ["t1"]), (B1 + MS, P1, ["t3"]), (B0 - MS, INFINITY, []), (B0, INFINITY, ["t2"]), (B1 - MS, INFINITY, ["t2"]), (B1, INFINITY, ["t3"]), (B2 - MS, INFINITY, ["t3"]), (B2, INFINITY, ["t4"]),
    (B1 + MS, P0 - MS, []), (B1 + MS, P1 - MS, ["t1"]), (INFINITY, INFINITY, ["t4"]), (EDGE, EDGE, ["t1", "t2", "t3", "t4"]), (B1, None, ["t3"]), (EDGE, None, ["t2", "t3", "t4"]),
])
def test_as_of(balance, business, processing, want):
    got = as_of(balance, BALANCE, business, processing)
    assert sorted(r["label"] for r in got.select("label").collect()) == want


def test_as_of_refuses_to_guess(balance):
    with pytest.raises(QueryError, match="ASOF-001"):
        as_of(balance, BALANCE)
    with pytest.raises(QueryError, match="ASOF-002"):
        as_of(balance, VALUES, B0)
    with pytest.raises(QueryError, match="ASOF-003"):
        as_of(balance, BALANCE, "never")


def test_finder(spark, balance):
    f = Finder(BALANCE, balance)
    assert f.as_of(B1).where(f.id.eq(201)).find_one().select("label").first()["label"] == "t3"
    assert f.edge_points().count().first()["n"] == 4
    assert [r["label"] for r in f.edge_points().order_by("IN_Z", "FROM_Z").find().select("label").collect()] == ["t1", "t4", "t2", "t3"]
    assert f.between_dates(B1, B1 + MS).count() == 2
    assert f.edge_points().aggregate(["id"], F.col("n") > 3, n=F.count("*")).count() == 1
    assert f.as_of(B1).compute(up="upper(label)").first()["up"] == "T3"
    assert f.edge_points().where(P.all_of(f.id.eq(1), f.id.eq(2))).explain()["path"] == "EMPTY"
    assert len(list(f.edge_points().find().select("id").toLocalIterator())) == 4
    with pytest.raises(QueryError, match="PLAN-001"):
        f.edge_points().strict().find()
    with pytest.raises(QueryError, match="PLAN-007"):
        f.edge_points().where(f.id.gt(0)).strict(max_rows=3).find()
    with pytest.raises(AttributeError):
        f.unknown


def test_encoding(spark):
    times = [t(-1001), t(-1), t(0), t(1), t(1001), dt.datetime(2024, 2, 29, 23, 59, 59, 999000)]
    df = spark.createDataFrame([(x,) for x in times], "x timestamp_ntz").withColumn("e", encode("x"))
    got = [(r["x"], r["e"]) for r in df.withColumn("x", decode("e")).collect()]
    assert [x for x, _ in got] == times and [e for _, e in got] == sorted(e for _, e in got)
    assert spark.createDataFrame([(INFINITY,)], "x timestamp_ntz").select(encode("x").alias("e")).first()["e"] == "99991201235900000"
    assert spark.createDataFrame([("bad",)], "e string").select(decode("e").alias("x")).first()["x"] is None
    assert tick(dt.datetime(2026, 1, 1, 0, 0, 0, 19_999)) == dt.datetime(2026, 1, 1, 0, 0, 0, 10_000)


def test_keys(spark, balance):
    row = balance.where("label = 't1'").select(K.partition_key(BALANCE).alias("p"), K.sort_key(BALANCE).alias("s"), K.sort_key(VALUES).alias("n")).first()
    named = Entity("Named", (Attribute("a", STRING, key=True), Attribute("b", STRING, key=True)))
    for bad, code in ((("a#b", "c"), "KEY-001"), ((None, "c"), "KEY-002")):
        with pytest.raises(Exception, match=code):
            balance.sparkSession.createDataFrame([bad], "a string, b string").select(K.partition_key(named)).collect()
    assert tuple(row) == ("v1#BALANCE#201", "v1#P#20260301090000000#B#20260101000000000", "v1#ND")


def test_domains():
    d = Domain("k").among([1, 2, 3, 50]).without([2]).below(60)
    assert d.finite() == [1, 3, 50] and d.above(3).finite() == [50] and d.eq(1).above(1).empty
    assert Domain("k").above(5).below(5).empty and not Domain("k").above(5, True).below(5, True).empty
    assert len(combinations([d, Domain("j").among("ab")])) == 6
    with pytest.raises(QueryError, match="PLAN-002"):
        combinations([Domain("k").among(range(2000))])
    with pytest.raises(QueryError, match="PLAN-001"):
        combinations([Domain("k").above(1)])


@pytest.mark.parametrize(("make", "code"), [
    (lambda: Entity("E", (Attribute("a", INT),)), "CFG-001"),
    (lambda: Entity("E", (Attribute("a", DOUBLE, key=True),)), "CFG-016"),
    (lambda: Entity("E", (Attribute("a", INT, key=True), Attribute("b", INT, column="A"))), "CFG-013"),
    (lambda: Entity("E", (Attribute("a#", INT, key=True),)), "CFG-008"),
    (lambda: Entity("E", (Attribute("a", INT, key=True),), Axis("x", "f", "t", None)), "CFG-003"),
    (lambda: Entity("E", (Attribute("a", INT, key=True),), relationships=(Relationship("r", "F", (("z", "a"),)),)), "CFG-005"),
    (lambda: spark_type("map"), "CFG-001"),
    (lambda: spark_type("decimal", 39, 0), "CFG-001"),
])
def test_models_that_are_refused(make, code):
    with pytest.raises(ModelError) as x:
        make()
    assert x.value.code == code


XML = """<?xml version="1.0"?>
<AnObject>
  <PackageName>p</PackageName><ClassName>Balance</ClassName><DefaultTable>BALANCE</DefaultTable>
  <AsOfAttribute name="businessDate" fromColumnName="FROM_Z" toColumnName="THRU_Z" toIsInclusive="false" infinityDate="[D.inf()]"/>
  <AsOfAttribute name="processingDate" fromColumnName="IN_Z" toColumnName="OUT_Z" isProcessingDate="true" infinityDate="[D.inf()]" defaultIfNotSpecified="[D.inf()]" futureExpiringRowsExist="false"/>
  <Attribute name="balanceId" javaType="int" columnName="BALANCE_ID" primaryKey="true"/>
  <Attribute name="amount" javaType="BigDecimal" columnName="AMOUNT" precision="18" scale="4" nullable="true"/>
  <Attribute name="label" javaType="String" columnName="LABEL" nullable="false"/>
  <Relationship name="entries" relatedObject="Entry" cardinality="one-to-many" reverseRelationshipName="balance">this.balanceId = Entry.balanceId</Relationship>
</AnObject>"""


def test_models_from_xml(spark):
    e = xml_model.parse(XML)
    assert (e.name, e.table, e.keys, e.payload, e.bounds) == ("Balance", "BALANCE", ["balanceId"], ["amount", "label"], ["FROM_Z", "THRU_Z", "IN_Z", "OUT_Z"])
    assert e.processing.default == INFINITY and e.business.default is None and not e.processing.future_expiring
    assert e.attributes[1].type == T.DecimalType(18, 4) and not e.attributes[2].nullable
    assert e.relationship("entries").on == (("balanceId", "balanceId"),) and e.relationship("entries").many
    rows = spark.createDataFrame([(1, "x", B0, INFINITY, P0, INFINITY)], "BALANCE_ID int, LABEL string, FROM_Z timestamp_ntz, THRU_Z timestamp_ntz, IN_Z timestamp_ntz, OUT_Z timestamp_ntz")
    assert e.conform(rows).select("balanceId", "amount", "label").first() == (1, None, "x")


@pytest.mark.parametrize(("old", "new", "code"), [
    ('<?xml version="1.0"?>', '<!DOCTYPE a [<!ENTITY x "y">]>', "CFG-001"), ("AnObject>", "APureObject>", "CFG-002"), ("<ClassName>", "<SourceAttribute/><ClassName>", "CFG-012"), ('primaryKey="true"', 'primaryKey="true" identity="true"', "CFG-004"),
    ('toIsInclusive="false"', 'infinityIsNull="true"', "CFG-003"), ('primaryKey="true"', 'primaryKey="true" nullable="true"', "CFG-001"), ('javaType="int"', 'javaType="double"', "CFG-016"), ("this.balanceId =", "this.balanceId &gt;", "CFG-005"), ("</AnObject>", "", "CFG-001"),
])
def test_xml_that_is_refused(old, new, code):
    with pytest.raises(ModelError) as x:
        xml_model.parse(XML.replace(old, new))
    assert x.value.code == code

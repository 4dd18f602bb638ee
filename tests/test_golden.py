"""Known histories: a renamed customer, price windows, facts learnt late."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import types as T

from palimpsest.functions.temporal import EDGE, as_of
from palimpsest.model import INFINITY, Attribute, Axis, Entity
from palimpsest.operators import director

D = dt.datetime
MONEY = T.DecimalType(18, 2)
BUSINESS = Axis("businessDate", "FROM_Z", "THRU_Z")
CUSTOMER = Entity("Customer", (Attribute("id", T.IntegerType(), key=True), Attribute("name", T.StringType()), Attribute("revenue", MONEY)), BUSINESS, Axis("processingDate", "IN_Z", "OUT_Z", default=INFINITY, future_expiring=False))
PRICE = Entity("Price", (Attribute("id", T.IntegerType(), key=True), Attribute("price", MONEY)), BUSINESS, Axis("processingDate", "IN_Z", "OUT_Z", default=INFINITY))
KIND = "id int, op string, b timestamp_ntz, u timestamp_ntz, p timestamp_ntz, seq int"


def test_customer_history(spark):
    rows = [
        (1, "insert", D(2025, 1, 1), None, D(2025, 1, 2, 9), 0, "Acme Corp", Decimal(50000000)),
        (1, "update", D(2025, 3, 1), None, D(2025, 3, 10, 9), 1, "Acme Corporation", None),
        (1, "update", D(2025, 5, 1), None, D(2025, 5, 1, 9), 2, None, Decimal(62000000)),
    ]
    got = director.fold(CUSTOMER, spark.createDataFrame(rows, KIND + ", name string, revenue decimal(18,2)"))
    out = got.select("IN_Z", "OUT_Z", "FROM_Z", "THRU_Z", "name", "revenue").orderBy("IN_Z", "FROM_Z", "THRU_Z").collect()
    assert sorted(map(tuple, out)) == sorted([
        (D(2025, 1, 2, 9), D(2025, 3, 10, 9), D(2025, 1, 1), D(2025, 3, 11, 9), "Acme Corp", Decimal(50000000)),
        (D(2025, 3, 10, 9), INFINITY, D(2025, 1, 1), D(2025, 3, 1), "Acme Corp", Decimal(50000000)),
        (D(2025, 3, 10, 9), D(2025, 5, 1, 9), D(2025, 3, 1), D(2025, 5, 2, 9), "Acme Corporation", Decimal(50000000)),
        (D(2025, 5, 1, 9), INFINITY, D(2025, 3, 1), D(2025, 5, 1), "Acme Corporation", Decimal(50000000)),
        (D(2025, 5, 1, 9), INFINITY, D(2025, 5, 1), INFINITY, "Acme Corporation", Decimal(62000000)),
    ])
    assert as_of(got, CUSTOMER, EDGE, EDGE).count() == 5


@pytest.mark.parametrize(("business", "price"), [(D(2025, 2, 1), 100), (D(2025, 5, 1), 80), (D(2025, 7, 15), 105), (D(2025, 9, 1), 100)])
def test_price_windows(spark, business, price):
    rows = [
        (1, "insert", D(2025, 1, 1), None, D(2025, 1, 2, 9), 0, Decimal(100)),
        (1, "update_until", D(2025, 4, 1), D(2025, 7, 1), D(2025, 3, 20, 9), 1, Decimal(80)),
        (1, "increment_until", D(2025, 7, 1), D(2025, 8, 1), D(2025, 6, 20, 9), 2, Decimal(5)),
    ]
    got = director.fold(PRICE, spark.createDataFrame(rows, KIND + ", price decimal(18,2)"))
    assert [r["price"] for r in as_of(got, PRICE, business, D(2025, 10, 1)).collect()] == [Decimal(price)]


def test_facts_learnt_late(spark):
    """What was reported then stays reproducible after a correction, and an end does not undo what was known."""
    rows = [
        (1, "insert", D(2025, 1, 1), None, D(2025, 1, 2, 9), 0, Decimal(100000)),
        (1, "update", D(2025, 3, 1), None, D(2025, 6, 15, 9), 1, Decimal(85000)),
        (2, "insert", D(2025, 1, 1), None, D(2025, 1, 2, 9), 0, Decimal(10000)),
        (2, "terminate", D(2025, 8, 15), None, D(2025, 8, 15, 9), 1, None),
    ]
    got = director.fold(PRICE, spark.createDataFrame(rows, KIND + ", price decimal(18,2)"))

    def seen(key, b, p):
        return [r["price"] for r in as_of(got, PRICE, b, p).where(f"id = {key}").collect()]

    assert seen(1, D(2025, 4, 1), D(2025, 4, 2)) == [Decimal(100000)] and seen(1, D(2025, 4, 1), D(2025, 10, 1)) == [Decimal(85000)]
    assert seen(2, D(2025, 8, 1), D(2025, 10, 1)) == [Decimal(10000)] and seen(2, D(2025, 8, 16), D(2025, 10, 1)) == []
    assert seen(2, D(2025, 8, 16), D(2025, 8, 1)) == [Decimal(10000)]

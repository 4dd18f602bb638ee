"""The finder: conditions, as-of dates, order and top-n of one entity, compiled to one DataFrame.

Everything is lazy and left to Catalyst, so predicates and columns reach the Parquet scan. The finder adds what Catalyst
cannot know: defaults of as-of dates, and that rows open now lie in the partition ``is_current = true``.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.predicates import Attr, attributes
from palimpsest.functions.temporal import EDGE, When, as_of, overlaps
from palimpsest.model import Entity, QueryError


#: A partition column is read back as text.
OPEN = "cast(is_current as boolean)"


@dataclass(frozen=True)
class Finder:
    entity: Entity
    rows: DataFrame
    condition: Column | None = None
    business: When | str = None
    processing: When | str = None
    order: tuple[Column, ...] = ()
    limit: int | None = None
    keyed_only: bool = False
    max_rows: int | None = None

    def __getattr__(self, name: str) -> Attr:
        if name.startswith("_"):
            raise AttributeError(name)
        try:
            return attributes(self.entity)[name]
        except KeyError as x:
            raise AttributeError(name) from x

    def where(self, condition: Column) -> Finder:
        return replace(self, condition=condition if self.condition is None else self.condition & condition)

    def as_of(self, business: When | str = None, processing: When | str = None) -> Finder:
        return replace(self, business=self.business if business is None else business, processing=self.processing if processing is None else processing)

    def edge_points(self) -> Finder:
        """Every rectangle, on both axes."""
        return replace(self, business=EDGE if self.entity.business else None, processing=EDGE if self.entity.processing else None)

    def order_by(self, *columns: Column | str) -> Finder:
        """Ascending with nulls first, descending with nulls last; the identity breaks ties."""
        return replace(self, order=self.order + tuple(F.col(c) if isinstance(c, str) else c for c in columns))

    def top(self, n: int) -> Finder:
        return replace(self, limit=n)

    def strict(self, max_rows: int | None = None) -> Finder:
        """Refuse a query without a condition, and one with more rows than given."""
        return replace(self, keyed_only=True, max_rows=max_rows)

    def find(self) -> DataFrame:
        if self.keyed_only and self.condition is None:
            raise QueryError("PLAN-001", f"{self.entity.name}: a scan of all rows was not asked for")
        df = self.rows
        infinity = self.entity.processing.infinity if self.entity.processing else None
        wanted = self.processing if self.processing is not None else self.entity.processing.default if self.entity.processing else None
        if infinity and isinstance(wanted, dt.datetime) and wanted == infinity and "is_current" in df.columns:
            df = df.where(OPEN)
        df = as_of(df, self.entity, self.business, self.processing).select(*self.entity.columns)
        if self.condition is not None:
            df = df.where(self.condition)
        if self.order:
            df = df.orderBy(*self.order, *self.entity.identity)
        if self.limit is not None:
            df = df.limit(self.limit)
        if self.max_rows is not None and df.limit(self.max_rows + 1).count() > self.max_rows:
            raise QueryError("PLAN-007", f"more than {self.max_rows} rows")
        return df

    def find_one(self) -> DataFrame:
        return replace(self, limit=1).find()

    def count(self) -> DataFrame:
        return replace(self, order=()).find().agg(F.count("*").alias("n"))

    def between_dates(self, low: dt.datetime, high: dt.datetime) -> DataFrame:
        """Every version that holds at some business date of [low, high)."""
        if not self.entity.business:
            raise QueryError("ASOF-002", f"{self.entity.name} has no business axis")
        return self.edge_points().where(overlaps(self.entity.business, low, high)).find()

    def aggregate(self, by: list[str], having: Column | None = None, **aggregates: Column) -> DataFrame:
        """Grouped aggregates of what is found, and a condition on the groups."""
        out = replace(self, order=()).find().groupBy(*by).agg(*[c.alias(k) for k, c in aggregates.items()])
        return out if having is None else out.where(having)

    def compute(self, **expressions: str) -> DataFrame:
        """What is found, with SQL expressions over its columns."""
        return self.find().selectExpr("*", *[f"{sql} as `{name}`" for name, sql in expressions.items()])

    def cursor(self):
        """Rows one by one, a partition at a time on the driver."""
        return self.find().toLocalIterator(prefetchPartitions=True)

    def counters(self) -> DataFrame:
        """One row: rows examined (of the table or, for open rows, of its current partition) and rows returned."""
        current = "is_current" in self.rows.columns and (self.processing or self.entity.processing.default) == self.entity.processing.infinity
        held = self.rows.where(OPEN) if current else self.rows
        # two one-row tables
        return held.agg(F.count("*").alias("examined")).join(replace(self, order=()).find().agg(F.count("*").alias("returned")))

    def explain(self) -> dict[str, str]:
        """The access path in a word, and Spark's plan."""
        df = self.find()
        plan = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        empty = "LocalTableScan" in plan and "FileScan" not in plan and "Scan parquet" not in plan
        path = "EMPTY" if empty else "CURRENT" if "is_current" in plan else "FILTERED SCAN" if "PushedFilters: [" in plan and "PushedFilters: []" not in plan else "SCAN"
        return {"path": path, "plan": plan}

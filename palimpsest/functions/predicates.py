"""Typed predicates as Spark columns, under SQL's three-valued logic.

``Predicate`` wraps a Column, so that Catalyst pushes down, simplifies and prunes as usual. What is added here: IEEE
comparison (nothing compares equal to, or orders with, NaN, where Spark takes NaN as equal to itself and largest), wildcards
with their own escape, sets too large for a literal list, and the intersection of constraints on a key.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence
from decimal import Decimal
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.model import Entity, QueryError, instant

#: A set of more values is joined (``semi_in``), not written into the plan.
LITERAL_LIMIT = 1000


class Attr:
    """An attribute of an entity, with the comparisons that finders offer."""

    def __init__(self, name: str, kind: T.DataType | None = None):
        self.name, self.kind = name, kind

    @property
    def col(self) -> Column:
        return F.col(f"`{self.name}`")

    @property
    def _ieee(self) -> bool:
        return isinstance(self.kind, T.FloatType | T.DoubleType)

    def _lit(self, value: Any) -> Column:
        if isinstance(value, Attr):
            return value.col
        if value is None:
            raise QueryError("PRED-001", f"{self.name}: compare with null by is_null")
        if hasattr(value, "hour"):
            return instant(value)
        if isinstance(self.kind, T.DecimalType) and not isinstance(value, Column):
            return F.lit(Decimal(str(value)))
        lit = F.lit(value)
        return lit.cast(self.kind) if isinstance(self.kind, T.FloatType) else lit

    def _nan(self, value: Any) -> bool:
        return isinstance(value, float) and math.isnan(value)

    def _ordered(self, value: Any, test: Column) -> Column:
        """Neither side may be NaN."""
        if not self._ieee:
            return test
        if self._nan(value):
            return F.lit(False)
        test = test & ~F.isnan(self.col)
        return test & ~F.isnan(value.col) if isinstance(value, Attr) and value._ieee else test

    def eq(self, value: Any) -> Column:
        return self._ordered(value, self.col == self._lit(value)) if not self._nan(value) else F.lit(False)

    def not_eq(self, value: Any) -> Column:
        if self._ieee and self._nan(value):
            return self.col.isNotNull()
        test = self.col != self._lit(value)
        return test | F.isnan(self.col) & self._lit(value).isNotNull() if self._ieee else test

    def gt(self, value: Any) -> Column:
        return self._ordered(value, self.col > self._lit(value))

    def gte(self, value: Any) -> Column:
        return self._ordered(value, self.col >= self._lit(value))

    def lt(self, value: Any) -> Column:
        return self._ordered(value, self.col < self._lit(value))

    def lte(self, value: Any) -> Column:
        return self._ordered(value, self.col <= self._lit(value))

    def between(self, low: Any, high: Any) -> Column:
        return self.gte(low) & self.lte(high)

    def _values(self, values: Iterable[Any]) -> list[Any]:
        values = list(dict.fromkeys(values))
        if any(v is None for v in values):
            raise QueryError("PRED-001", f"{self.name}: a set holds no null")
        if len(values) > LITERAL_LIMIT:
            raise QueryError("PRED-002", f"{self.name}: {len(values)} values; use semi_in")
        return [v for v in values if not self._nan(v)]

    def is_in(self, values: Iterable[Any]) -> Column:
        values = self._values(values)
        if not values:
            return F.lit(False)
        return self._ordered(values[0], self.col.isin([self._lit(v) for v in values]))

    def not_in(self, values: Iterable[Any]) -> Column:
        values = self._values(values)
        if not values:
            return self.col.isNotNull()
        test = ~self.col.isin([self._lit(v) for v in values])
        return test | F.isnan(self.col) if self._ieee else test

    def is_null(self) -> Column:
        return self.col.isNull()

    def is_not_null(self) -> Column:
        return self.col.isNotNull()

    def starts_with(self, text: str) -> Column:
        return self.col.startswith(text)

    def ends_with(self, text: str) -> Column:
        return self.col.endswith(text)

    def contains(self, text: str) -> Column:
        return self.col.contains(text)

    def not_starts_with(self, text: str) -> Column:
        return ~self.col.startswith(text)

    def not_ends_with(self, text: str) -> Column:
        return ~self.col.endswith(text)

    def not_contains(self, text: str) -> Column:
        return ~self.col.contains(text)

    def like(self, pattern: str) -> Column:
        return self.col.like(pattern)

    def wildcard(self, pattern: str) -> Column:
        return self.col.like(like_of(pattern))

    def not_wildcard(self, pattern: str) -> Column:
        return ~self.col.like(like_of(pattern))


def like_of(pattern: str) -> str:
    """A LIKE pattern (escape \\) for a wildcard: * any text, ? one character, ' takes the next character literally."""
    out, quoted = [], False
    for c in pattern:
        if not quoted and c == "'":
            quoted = True
            continue
        out.append({"*": "%", "?": "_"}.get(c) if not quoted and c in "*?" else "\\" + c if c in "%_\\" else c)
        quoted = False
    return "".join(out) + ("'" if quoted else "")


def attributes(entity: Entity) -> dict[str, Attr]:
    """The attributes and boundary columns of an entity, by name."""
    out = {a.name: Attr(a.name, a.type) for a in entity.attributes}
    return out | {c: Attr(c, T.TimestampNTZType()) for c in entity.bounds}


def all_of(*parts: Column) -> Column:
    """Conjunction; of nothing, every row."""
    out = F.lit(True)
    for p in parts:
        out = out & p
    return out


def any_of(*parts: Column) -> Column:
    """Disjunction; of nothing, no row."""
    out = F.lit(False)
    for p in parts:
        out = out | p
    return out


def everything() -> Column:
    return F.lit(True)


def nothing() -> Column:
    return F.lit(False)


def tuple_in(names: Sequence[str], tuples: Iterable[Sequence[Any]]) -> Column:
    """Rows whose columns equal one of the tuples; null equals nothing."""
    return any_of(*[all_of(*[F.col(n) == F.lit(v) for n, v in zip(names, t, strict=True)]) for t in tuples])


def semi_in(df: DataFrame, name: str, values: DataFrame) -> DataFrame:
    """Rows whose ``name`` is among the first column of ``values``: a set of any size. Catalyst broadcasts it only if small."""
    return tuple_exists(df, [name], values.select(F.col(values.columns[0]).alias(name)))


def tuple_exists(df: DataFrame, names: Sequence[str], tuples: DataFrame) -> DataFrame:
    """Rows for which ``tuples`` has a row with equal ``names``."""
    return df.join(tuples.select(*names).distinct(), list(names), "left_semi")

"""Key domains: what a conjunction of constraints leaves of one key attribute, worked out before the plan is made.

Catalyst pushes the constraints down but does not intersect ``IN`` lists with equalities and ranges; a contradiction found
here becomes an empty relation, without reading anything.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace
from itertools import product
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.model import QueryError


@dataclass(frozen=True)
class Domain:
    """The values that are left: a finite set, or a range, without the excluded ones."""

    name: str
    values: frozenset | None = None
    low: tuple[Any, bool] | None = None
    high: tuple[Any, bool] | None = None
    excluded: frozenset = frozenset()

    def among(self, values: Iterable[Any]) -> Domain:
        new = frozenset(values)
        return replace(self, values=new if self.values is None else self.values & new)

    def eq(self, value: Any) -> Domain:
        return self.among([value])

    def without(self, values: Iterable[Any]) -> Domain:
        return replace(self, excluded=self.excluded | frozenset(values))

    def above(self, value: Any, inclusive: bool = False) -> Domain:
        if self.low is None or value > self.low[0] or value == self.low[0] and not inclusive:
            return replace(self, low=(value, inclusive))
        return self

    def below(self, value: Any, inclusive: bool = False) -> Domain:
        if self.high is None or value < self.high[0] or value == self.high[0] and not inclusive:
            return replace(self, high=(value, inclusive))
        return self

    def _fits(self, v: Any) -> bool:
        if v in self.excluded:
            return False
        if self.low and not (v > self.low[0] or self.low[1] and v == self.low[0]):
            return False
        return not self.high or v < self.high[0] or self.high[1] and v == self.high[0]

    def finite(self) -> list | None:
        return None if self.values is None else sorted(v for v in self.values if self._fits(v))

    @property
    def empty(self) -> bool:
        left = self.finite()
        if left is not None:
            return not left
        if self.low and self.high:
            return self.low[0] > self.high[0] or self.low[0] == self.high[0] and not (self.low[1] and self.high[1])
        return False

    def column(self) -> Column:
        """The reduced condition; false for a contradiction."""
        c, left = F.col(self.name), self.finite()
        if self.empty:
            return F.lit(False)
        if left is not None:
            return c == left[0] if len(left) == 1 else c.isin(left)
        out = c.isNotNull()
        if self.low:
            out = out & (c >= self.low[0] if self.low[1] else c > self.low[0])
        if self.high:
            out = out & (c <= self.high[0] if self.high[1] else c < self.high[0])
        return out & ~c.isin(sorted(self.excluded)) if self.excluded else out


def combinations(domains: list[Domain], limit: int = 1000) -> list[tuple]:
    """All keys of finite domains; their number is checked before they are made."""
    sets, n = [d.finite() for d in domains], 1
    for d, s in zip(domains, sets, strict=True):
        if s is None:
            raise QueryError("PLAN-001", f"{d.name} is not bound to values")
        n *= len(s)
    if n > limit:
        raise QueryError("PLAN-002", f"{n} keys, the limit is {limit}")
    return list(product(*sets))

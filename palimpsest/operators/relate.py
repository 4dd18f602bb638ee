"""Navigation along relationships, as joins. As-of dates of the parent hold for the children too."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.temporal import When, as_of
from palimpsest.model import Entity, Relationship


def _tie(r: Relationship, left: str = "p", right: str = "c") -> Column:
    test = F.lit(True)
    for own, other in r.on:
        test = test & (F.col(f"{left}.{own}") == F.col(f"{right}.{other}"))
    return test


def related(rel: Relationship, parents: DataFrame, child: Entity, children: DataFrame, business: When | str = None, processing: When | str = None) -> DataFrame:
    """The distinct related rows of some parents, as of the parents' dates."""
    rows = as_of(children, child, business if child.business else None, processing if child.processing else None)
    return rows.alias("c").join(parents.alias("p"), _tie(rel), "left_semi")


def joined(rel: Relationship, parents: DataFrame, child: Entity, children: DataFrame, business: When | str = None, processing: When | str = None, prefix: str = "child_", how: str = "inner") -> DataFrame:
    """Parents with their related rows, whose columns are prefixed. ``how='left'`` keeps parents without any."""
    rows = as_of(children, child, business if child.business else None, processing if child.processing else None)
    named = rows.select(*[F.col(c).alias(prefix + c) for c in rows.columns])
    test = F.lit(True)
    for own, other in rel.on:
        test = test & (F.col(own) == F.col(prefix + other))
    return parents.join(named, test, how)


def deep_fetch(rel: Relationship, parents: DataFrame, child: Entity, children: DataFrame, into: str, business: When | str = None, processing: When | str = None, columns: list[str] | None = None) -> DataFrame:
    """Parents with an array of their related rows, empty for those without any: one join a level.

    The array of a parent is as long as its children are many; for unbounded ones use ``joined``.
    """
    rows = as_of(children, child, business if child.business else None, processing if child.processing else None)
    ons = [other for _, other in rel.on]
    packed = rows.groupBy(*ons).agg(F.sort_array(F.collect_list(F.struct(*(columns or [c for c in rows.columns if c not in ons])))).alias(into))
    named = packed.select(*[F.col(c).alias(f"_on_{c}") for c in ons], into)
    test = F.lit(True)
    for own, other in rel.on:
        test = test & (F.col(own) == F.col(f"_on_{other}"))
    kind = packed.schema[into].dataType.simpleString()
    return parents.join(named, test, "left").drop(*[f"_on_{c}" for c in ons]).withColumn(into, F.coalesce(into, F.expr(f"cast(array() as {kind})")))


def exists(rel: Relationship, parents: DataFrame, children: DataFrame, where: Column | None = None) -> DataFrame:
    """Parents with a related row (that meets a condition)."""
    rows = children if where is None else children.where(where)
    return parents.alias("p").join(rows.alias("c"), _tie(rel), "left_semi")


def not_exists(rel: Relationship, parents: DataFrame, children: DataFrame, where: Column | None = None) -> DataFrame:
    """Parents without a related row (that meets a condition)."""
    rows = children if where is None else children.where(where)
    return parents.alias("p").join(rows.alias("c"), _tie(rel), "left_anti")


def temporal_join(left: Entity, lefts: DataFrame, right: Entity, rights: DataFrame, on: list[tuple[str, str]], prefix: str = "r_") -> DataFrame:
    """Pairs with equal columns that hold together, with the common rectangle (``common_<boundary>``).

    An equality join; the ranges are a further condition on it, so only rows of one key meet.
    """
    named = rights.select(*[F.col(c).alias(prefix + c) for c in rights.columns])
    test = F.lit(True)
    for a, b in on:
        test = test & (F.col(a) == F.col(prefix + b))
    out = []
    for mine, other in ((left.business, right.business), (left.processing, right.processing)):
        if mine and other:
            low, high = F.greatest(F.col(mine.start), F.col(prefix + other.start)), F.least(F.col(mine.end), F.col(prefix + other.end))
            test = test & (low < high)
            out += [low.alias(f"common_{mine.start}"), high.alias(f"common_{mine.end}")]
    return lefts.join(named, test).select("*", *out)


"""Exact comparison of two sets of rows, and checks of one.

Rows are matched by identity: the key and every boundary, starts and ends. What differs is MISSING (expected only), EXTRA
(actual only) or VALUE (a payload column); a row with another end is another row, so MISSING and EXTRA. One aggregate over
both sides by identity, combined before its only shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.model import Entity, QueryError


def duplicate_identity(e: Entity, rows: DataFrame) -> DataFrame:
    """Identities held by more than one row, with their number."""
    return rows.groupBy(*e.identity).agg(F.count("*").alias("n")).where("n > 1")


def require_unique(e: Entity, rows: DataFrame) -> DataFrame:
    """The rows; raises if an identity is held twice."""
    if not duplicate_identity(e, rows).isEmpty():
        raise QueryError("DIFF-001", f"{e.name}: two rows have one identity")
    return rows


def missing_bounds(e: Entity, rows: DataFrame) -> DataFrame:
    """Rows without a key or a boundary: a batch that holds one is refused."""
    test: Column = F.lit(False)
    for c in e.identity:
        test = test | F.col(c).isNull()
    return rows.where(test)


def compare(e: Entity, expected: DataFrame, actual: DataFrame) -> DataFrame:
    """A row for each difference: identity, kind, column, and both values as text. Refused (DIFF-001, when it runs) if one side
    holds an identity twice."""
    held = F.struct(*e.payload) if e.payload else F.struct(F.lit(1).alias("_"))
    both = expected.select(*e.identity, held.alias("x"), F.lit(1).alias("nx"), F.lit(0).alias("ny"))
    both = both.unionByName(actual.select(*e.identity, held.alias("x"), F.lit(0).alias("nx"), F.lit(1).alias("ny")))
    side = lambda n: F.max_by("x", n)
    met = both.groupBy(*e.identity).agg(F.sum("nx").alias("left"), F.sum("ny").alias("right"), side("nx").alias("x"), side("ny").alias("y"))
    text = F.lit(None).cast("string")

    def alone(kind: str) -> Column:
        return F.array(F.struct(F.lit(kind).alias("kind"), text.alias("column"), text.alias("expected"), text.alias("actual"), F.lit(True).alias("differs")))

    checks = [F.struct(F.lit("VALUE").alias("kind"), F.lit(c).alias("column"), F.col(f"x.`{c}`").cast("string").alias("expected"), F.col(f"y.`{c}`").cast("string").alias("actual"), (~F.col(f"x.`{c}`").eqNullSafe(F.col(f"y.`{c}`"))).alias("differs")) for c in e.payload]
    twice = F.raise_error(F.lit(f"DIFF-001: {e.name}: two rows have one identity"))
    same = F.filter(F.array(*checks), lambda d: d["differs"]) if checks else F.slice(alone("VALUE"), 1, 0)
    diffs = F.when((F.col("left") > 1) | (F.col("right") > 1), twice).when(F.col("right") == 0, alone("MISSING")).when(F.col("left") == 0, alone("EXTRA")).otherwise(same)
    return met.select(*e.identity, F.explode(diffs).alias("d")).select(*e.identity, *[F.col(f"d.{c}").alias(c) for c in ("kind", "column", "expected", "actual")])


def missing(e: Entity, expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Expected rows without one of that identity."""
    return expected.join(actual.select(*e.identity), e.identity, "left_anti")


def scoped(e: Entity, source: DataFrame, target: DataFrame) -> DataFrame:
    """The rows of the target whose key the source has; others are not judged."""
    return target.join(source.select(*e.keys).distinct(), e.keys, "left_semi")


def verify(e: Entity, source: DataFrame, target: DataFrame) -> DataFrame:
    """One row: rows_read, rows_written, divergences, verified. An empty source verifies nothing."""
    held = scoped(e, source, target)
    read = source.agg(F.count("*").alias("rows_read"))
    written = held.agg(F.count("*").alias("rows_written"))
    bad = compare(e, source, held).agg(F.count("*").alias("divergences"))
    # three one-row tables
    return read.join(written).join(bad).withColumn("verified", (F.col("rows_read") > 0) & (F.col("divergences") == 0))

"""Writes as set operations on tables: conditional inserts, optimistic updates, upserts, deletes, staged images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.model import Entity, QueryError


def insert_conflicts(e: Entity, held: DataFrame, new: DataFrame) -> DataFrame:
    """New rows whose identity is held already."""
    return new.join(held.select(*e.identity), e.identity, "left_semi")


def insert(e: Entity, held: DataFrame, new: DataFrame) -> DataFrame:
    """The table with the new rows; refused if one is there already, or twice among the new."""
    if not insert_conflicts(e, held, new).isEmpty() or not new.groupBy(*e.identity).count().where("count > 1").isEmpty():
        raise QueryError("WRITE-001", f"{e.name}: unique key violated")
    return held.unionByName(new)


def stale(e: Entity, held: DataFrame, prior: DataFrame) -> DataFrame:
    """Prior images that no longer equal the stored row in every attribute (null equals null), or have none."""
    test: Column = F.lit(True)
    for c in e.columns:
        test = test & F.col(f"h.{c}").eqNullSafe(F.col(f"p.{c}"))
    return prior.alias("p").join(held.alias("h"), test, "left_anti")


def update(e: Entity, held: DataFrame, prior: DataFrame, new: DataFrame) -> DataFrame:
    """The table with the prior images replaced by new ones of the same identities; refused if a prior image is stale."""
    if not stale(e, held, prior).isEmpty():
        raise QueryError("WRITE-002", f"{e.name}: a row has changed since it was read")
    if not new.select(*e.keys).exceptAll(prior.select(*e.keys)).isEmpty():
        raise QueryError("WRITE-003", f"{e.name}: an update may not change a key")
    return held.join(prior.select(*e.identity), e.identity, "left_anti").unionByName(new)


def delete(e: Entity, held: DataFrame, prior: DataFrame, quietly: bool = False) -> DataFrame:
    """The table without the prior images. Stale images are refused, or quietly left."""
    if not quietly and not stale(e, held, prior).isEmpty():
        raise QueryError("WRITE-002", f"{e.name}: a row has changed since it was read")
    test: Column = F.lit(True)
    for c in e.columns:
        test = test & F.col(f"h.{c}").eqNullSafe(F.col(f"p.{c}"))
    return held.alias("h").join(prior.alias("p"), test, "left_anti")


def purge(e: Entity, held: DataFrame, keys: DataFrame) -> DataFrame:
    """The table without any version of the keys."""
    return held.join(keys.select(*e.keys), e.keys, "left_anti")


def upsert(e: Entity, held: DataFrame, new: DataFrame) -> DataFrame:
    """The table with the new rows, over what they replace; refused if an identity is twice among the new."""
    if not new.groupBy(*e.identity).count().where("count > 1").isEmpty():
        raise QueryError("WRITE-004", f"{e.name}: one batch writes an identity twice")
    return held.join(new.select(*e.identity), e.identity, "left_anti").unionByName(new)


def first_failure(e: Entity, held: DataFrame, inserts: DataFrame, priors: DataFrame) -> DataFrame:
    """The first failing slot of a unit of work, by ``slot``, and why: unique key violated, or a row changed since it was read.

    ``inserts`` are new rows and ``priors`` the images that updates and deletes start from, each with its slot. No row: none
    fails.
    """
    taken = insert_conflicts(e, held, inserts).select("slot", F.lit("WRITE-001").alias("code"))
    changed = stale(e, held, priors).select("slot", F.lit("WRITE-002").alias("code"))
    return taken.unionByName(changed).agg(F.min_by(F.struct("slot", "code"), "slot").alias("x")).where("x is not null").select("x.slot", "x.code")


def delete_where(held: DataFrame, condition: Column) -> DataFrame:
    """The table without the rows that meet a condition; those for which it is null stay."""
    return held.where(~F.coalesce(condition, F.lit(False)))


def update_where(held: DataFrame, condition: Column, values: dict[str, Column]) -> DataFrame:
    """The table with columns set in the rows that meet a condition."""
    met = F.coalesce(condition, F.lit(False))
    return held.withColumns({c: F.when(met, v).otherwise(F.col(c)) for c, v in values.items()})


def fold_staged(staged: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last image of each key among staged writes. One maximum a key, combined before the shuffle."""
    rest = [c for c in staged.columns if c not in keys]
    last = F.max_by(F.struct(*rest), F.col(order)).alias("last")
    return staged.groupBy(*keys).agg(last).select(*keys, *[F.col(f"last.`{c}`").alias(c) for c in rest])


def refresh(e: Entity, held: DataFrame, identity: DataFrame) -> DataFrame:
    """The stored rows of the given rectangles, read anew; none for those that are gone."""
    return held.join(identity.select(*e.identity), e.identity, "left_semi")


def argmax(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in an order (for ties that need every column)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")

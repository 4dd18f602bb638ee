"""Verified copies: rows are written, read back, and compared; keys done under a snapshot are not copied again."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.model import Entity, QueryError
from palimpsest.operators import diff, writes
from palimpsest.sources.store import VersionedTable


@dataclass(frozen=True)
class Result:
    rows_read: int
    rows_written: int
    divergences: int
    skipped_keys: int
    empty_declared: bool = False

    @property
    def verified(self) -> bool:
        return self.divergences == 0 and (self.rows_read > 0 or self.skipped_keys > 0 or self.empty_declared)


class Checkpoint:
    """Keys that are done, as a table of one snapshot; another snapshot's checkpoint is refused."""

    def __init__(self, spark: SparkSession, path: str, snapshot: str):
        self.table, self.snapshot = VersionedTable(spark, path), snapshot

    def done(self, e: Entity) -> DataFrame | None:
        if not self.table.exists():
            return None
        held = self.table.read()
        if not held.where(F.col("snapshot") != self.snapshot).isEmpty():
            raise QueryError("FILL-001", f"the checkpoint is not of snapshot {self.snapshot}")
        return held.select(*e.keys)

    def add(self, e: Entity, keys: DataFrame) -> None:
        new = keys.select(*e.keys).distinct().withColumn("snapshot", F.lit(self.snapshot))
        self.table.commit(self.table.read().unionByName(new) if self.table.exists() else new)


def run(e: Entity, source: DataFrame, target: VersionedTable, checkpoint: Checkpoint | None = None, empty_ok: bool = False) -> Result:
    """Copy the rows of a source into the target and compare what is read back.

    The batch is refused if a key or boundary is null or an identity is held twice. Only clean runs are checkpointed.
    """
    if not diff.missing_bounds(e, source).isEmpty():
        raise QueryError("FILL-002", f"{e.name}: a row has no key or boundary")
    diff.require_unique(e, source)
    rows, skipped = source, 0
    done = checkpoint.done(e) if checkpoint else None
    if done is not None:
        rows = source.join(done, e.keys, "left_anti")
        skipped = source.join(done, e.keys, "left_semi").select(*e.keys).distinct().count()
    target.commit(writes.upsert(e, target.read(), rows) if target.exists() else rows)
    found = diff.verify(e, rows, target.read()).first()
    result = Result(found["rows_read"], found["rows_written"], found["divergences"], skipped, empty_ok)
    if checkpoint and result.divergences == 0 and result.rows_read:
        checkpoint.add(e, rows)
    return result

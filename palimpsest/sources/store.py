"""A versioned Parquet table: each commit writes a new data folder, then switches one small manifest file.

Readers see the version that the manifest names, whole; a writer that dies leaves the old one. Commits are optimistic: they
name the version they were made from, and fail if another one came first. Several tables commit as one through ``commit_all``,
whose single manifest covers them.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

from palimpsest.model import Entity, QueryError


class _Files:
    """Whole small files on whatever file system the path is on."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm = spark._jvm
        self.root = root.rstrip("/")
        self.fs = self.jvm.org.apache.hadoop.fs.Path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def read(self, name: str) -> str | None:
        if not self.fs.exists(self.path(name)):
            return None
        stream = self.fs.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Write a file that must not exist yet, through a rename, which either happens or not."""
        temp = self.path(f".{uuid.uuid4().hex}")
        self.fs.mkdirs(self.path("."))
        out = self.fs.create(temp, False)
        try:
            out.write(text.encode())
        finally:
            out.close()
        if self.fs.exists(self.path(name)) or not self.fs.rename(temp, self.path(name)):
            self.fs.delete(temp, False)
            return False
        return True

    def names(self) -> list[str]:
        return [s.getPath().getName() for s in self.fs.listStatus(self.path("."))] if self.fs.exists(self.path(".")) else []

    def drop(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


class Manifest:
    """Numbered files ``v<number>.json`` that name the data folder of each table."""

    def __init__(self, spark: SparkSession, root: str):
        self.files = _Files(spark, root)

    def version(self) -> int:
        numbers = [int(n[1:-5]) for n in self.files.names() if n.startswith("v") and n.endswith(".json")]
        return max(numbers, default=0)

    def read(self, version: int | None = None) -> dict[str, str]:
        text = self.files.read(f"v{version or self.version()}.json")
        return json.loads(text) if text else {}

    def switch(self, after: int, tables: dict[str, str]) -> int:
        if not self.files.create(f"v{after + 1}.json", json.dumps(self.read(after) | tables if after else tables, sort_keys=True)):
            raise QueryError("TXN-004", f"another commit followed version {after}")
        return after + 1


class VersionedTable:
    def __init__(self, spark: SparkSession, root: str, name: str = "rows"):
        self.spark, self.root, self.name = spark, root.rstrip("/"), name
        self.manifest = Manifest(spark, self.root)

    def exists(self) -> bool:
        return self.name in self.manifest.read()

    def version(self) -> int:
        return self.manifest.version()

    def read(self, version: int | None = None) -> DataFrame:
        held = self.manifest.read(version)
        if self.name not in held:
            raise QueryError("TXN-001", f"{self.name} has no version {version or ''}")
        return self.spark.read.parquet(f"{self.root}/{held[self.name]}")

    def stage(self, rows: DataFrame, partition_by: list[str] | None = None) -> str:
        """Write a data folder that no manifest names yet."""
        folder = f"data-{self.name}-{uuid.uuid4().hex}"
        writer = rows.write.partitionBy(*partition_by) if partition_by else rows.write
        writer.parquet(f"{self.root}/{folder}")
        return folder

    def commit(self, rows: DataFrame, after: int | None = None, partition_by: list[str] | None = None) -> int:
        """Replace the table by rows (which may be made from it); returns the new version."""
        base = self.version() if after is None else after
        return self.manifest.switch(base, {self.name: self.stage(rows, partition_by)})


def commit_all(spark: SparkSession, root: str, tables: dict[str, DataFrame], after: int | None = None) -> int:
    """Write several tables and switch them at once."""
    manifest = Manifest(spark, root)
    base = manifest.version() if after is None else after
    return manifest.switch(base, {name: VersionedTable(spark, root, name).stage(df) for name, df in tables.items()})


def scratch(spark: SparkSession) -> str:
    """A new folder in the shared one named by spark.checkpoint.dir, or, where that is unset, below the warehouse."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    return f"{root.rstrip('/')}/tables-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def current_layout(e: Entity, rows: DataFrame) -> DataFrame:
    """Rows with ``is_current`` (partition by it) so that reads of what is open now touch no closed version."""
    from palimpsest.functions.keys import is_current

    return rows.withColumn("is_current", is_current(e)).repartition(*e.keys).sortWithinPartitions(*e.keys, *[a.start for a in e.axes])


def reconcile(e: Entity, held: DataFrame | None, indexes: dict[str, list[str]] | None = None) -> list[tuple[str, str]]:
    """What makes a stored table fit an entity: CREATE, VALIDATE, ADD_COLUMN, ADD_INDEX, BACKFILL_INDEX_KEY or INCOMPATIBLE."""
    if held is None:
        return [("CREATE", e.table or e.name)]
    have = {f.name: f.dataType for f in held.schema.fields}
    out = []
    for f in e.schema().fields:
        if f.name not in have:
            out.append(("ADD_COLUMN" if f.nullable else "INCOMPATIBLE", f.name))
        elif have[f.name] != f.dataType:
            out.append(("INCOMPATIBLE", f.name))
    for name, columns in (indexes or {}).items():
        if any(c not in have for c in columns):
            out.append(("INCOMPATIBLE", name))
        elif f"_key_{name}" not in have:
            out.append(("ADD_INDEX", name))
        elif not held.where(f"`_key_{name}` is null and " + " and ".join(f"`{c}` is not null" for c in columns)).isEmpty():
            out.append(("BACKFILL_INDEX_KEY", name))
    return out or [("VALIDATE", e.table or e.name)]

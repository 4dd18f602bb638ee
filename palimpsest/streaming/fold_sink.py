"""A streaming sink that applies micro-batches of mutations to a versioned table.

The batch number is part of the commit, so a batch that is delivered again changes nothing. Within a batch the mutations of a
key are applied in order; batches must come in order of the processing instant.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from palimpsest.model import Entity
from palimpsest.operators import director
from palimpsest.sources.store import Manifest, VersionedTable


def apply_batch(e: Entity, table: VersionedTable, log: DataFrame, batch: int) -> None:
    """Fold one batch into the table, unless it has been folded already."""
    manifest = Manifest(table.spark, table.root)
    held = manifest.read()
    if int(held.get("_batch", "-1")) >= batch:
        return
    if table.name in held:
        rows = table.read()
        keys = log.select(*e.keys).distinct()
        touched = rows.join(keys, e.keys, "left_semi")
        rest = rows.join(keys, e.keys, "left_anti")
        new = rest.unionByName(director.fold(e, log, touched))
    else:
        new = director.fold(e, log)
    manifest.switch(manifest.version(), {table.name: table.stage(new), "_batch": str(batch)})


def write(e: Entity, log: DataFrame, table: VersionedTable, checkpoint: str, **trigger) -> StreamingQuery:
    """Start the sink for a streaming log (columns as ``director`` takes them)."""
    writer = log.writeStream.foreachBatch(lambda df, n: apply_batch(e, table, df, n)).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()


def late_counts(log: DataFrame, keys: list[str], delay: str = "1 day") -> DataFrame:
    """Mutations a day of processing time and key, with a watermark: late ones are dropped after ``delay``."""
    day = F.window(F.col("p").cast("timestamp"), "1 day")
    return log.withColumn("p", F.col("p").cast("timestamp")).withWatermark("p", delay).groupBy(day, *keys).agg(F.count("*").alias("n"))

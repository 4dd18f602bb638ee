"""As-of selection on the time axes, and the sortable text form of instants."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.model import Axis, Entity, QueryError, instant

When = dt.datetime | Column | None
#: Marks every rectangle instead of those of one date.
EDGE = "edge point"


def holds(axis: Axis, when: dt.datetime | Column, prefix: str = "") -> Column:
    """Whether the axis of a row holds a date; exactly at infinity, whether the row is open."""
    start, end = F.col(prefix + axis.start), F.col(prefix + axis.end)
    if isinstance(when, dt.datetime) and when == axis.infinity:
        return end == instant(axis.infinity)
    at = instant(when)
    inside = (start < at) & (end >= at) if axis.to_inclusive else (start <= at) & (end > at)
    if isinstance(when, dt.datetime):
        return inside
    return F.when(at == instant(axis.infinity), end == instant(axis.infinity)).otherwise(inside)


def as_of(df: DataFrame, entity: Entity, business: When | str = None, processing: When | str = None, prefix: str = "") -> DataFrame:
    """The rows of an entity as of a date on each axis; EDGE takes every rectangle of that axis.

    An axis without a date takes its default; without a default the query is refused rather than a date guessed.
    """
    for axis, when in ((entity.business, business), (entity.processing, processing)):
        if axis is None:
            if when is not None and when != EDGE:
                raise QueryError("ASOF-002", f"{entity.name} has no such axis")
            continue
        if when is None:
            when = axis.default
        if when is None:
            raise QueryError("ASOF-001", f"{entity.name}.{axis.name}: no as-of date and no default")
        if isinstance(when, str):
            if when != EDGE:
                raise QueryError("ASOF-003", f"{when!r} is no date")
            continue
        df = df.where(holds(axis, when, prefix))
    return df


def overlaps(axis: Axis, low: dt.datetime, high: dt.datetime) -> Column:
    """Rows that hold at some instant of [low, high)."""
    return (F.col(axis.start) < instant(high)) & (F.col(axis.end) > instant(low))


def as_of_grid(df: DataFrame, entity: Entity, dates: DataFrame, column: str = "as_of", axis: Axis | None = None) -> DataFrame:
    """The rows as of each date of a short list (broadcast: its size is checked), one copy a date.

    A row holds for few of the dates, so the list is an array that each row is matched against; nothing is cross-joined.
    """
    axis = axis or entity.business or entity.processing
    days = [r[0] for r in dates.select(column).distinct().limit(10_001).collect()]
    if len(days) > 10_000:
        raise QueryError("ASOF-004", "more than 10000 dates: join on a key instead")
    listed = F.array(*[instant(d) for d in sorted(days)]) if days else F.expr("cast(array() as array<timestamp_ntz>)")
    start, end, open_end = F.col(axis.start), F.col(axis.end), instant(axis.infinity)

    def inside(at: Column) -> Column:
        within = (start < at) & (end >= at) if axis.to_inclusive else (start <= at) & (end > at)
        return F.when(at == open_end, end == open_end).otherwise(within)

    return df.withColumn(column, F.explode(F.filter(listed, inside)))


def encode(col: Column | str) -> Column:
    """Seventeen digits, yyyyMMddHHmmssSSS; sorts as the instants do, before the epoch too."""
    return F.date_format(col, "yyyyMMddHHmmssSSS")


def decode(col: Column | str) -> Column:
    text = F.col(col) if isinstance(col, str) else col
    parts = F.concat(
        F.substring(text, 1, 4), F.lit("-"), F.substring(text, 5, 2), F.lit("-"), F.substring(text, 7, 2), F.lit(" "),
        F.substring(text, 9, 2), F.lit(":"), F.substring(text, 11, 2), F.lit(":"), F.substring(text, 13, 2), F.lit("."), F.substring(text, 15, 3),
    )
    digits = (F.length(text) == 17) & (F.translate(text, "0123456789", "") == "")
    return F.when(digits, parts.try_cast("timestamp_ntz"))


def whole_millis(col: Column | str) -> Column:
    """Whether an instant is on a millisecond, as stored instants must be."""
    c = F.col(col) if isinstance(col, str) else col
    return F.date_trunc("millisecond", c).cast("timestamp_ntz") == c

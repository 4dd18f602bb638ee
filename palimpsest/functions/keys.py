"""Text keys of rows: partition key, sort key and secondary keys, and the estimated stored size of a row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.functions.temporal import encode
from palimpsest.model import Entity, Flavour


def component(name: str, kind: T.DataType) -> Column:
    """One key part as text: bytes in hexadecimal, booleans T or F, instants encoded, decimals plain.

    A text that holds the separator # is refused (KEY-001, when it runs): two keys could become one.
    """
    c = F.col(name)
    if isinstance(kind, T.StringType):
        return F.when(F.contains(c, F.lit("#")), F.raise_error(F.lit(f"KEY-001: {name} holds #"))).otherwise(c)
    if isinstance(kind, T.BinaryType):
        return F.hex(c)
    if isinstance(kind, T.BooleanType):
        return F.when(c, "T").otherwise("F")
    if isinstance(kind, T.TimestampNTZType):
        return encode(c)
    return c.cast("string")


def partition_key(e: Entity) -> Column:
    """v1#ENTITY#part...; a null part is refused (KEY-002, when it runs)."""
    parts = [F.coalesce(component(a.name, a.type), F.raise_error(F.lit(f"KEY-002: {a.name} is null")).cast("string")) for a in e.attributes if a.key]
    return F.concat_ws("#", F.lit("v1"), F.lit(e.name.upper()), *parts)


def sort_key(e: Entity) -> Column:
    """v1#P#from#B#from, with the axes that the entity has; v1#ND without any."""
    if e.flavour is Flavour.NONE:
        return F.lit("v1#ND")
    parts = [F.lit("v1")]
    for tag, axis in (("P", e.processing), ("B", e.business)):
        if axis:
            parts += [F.lit(tag), encode(axis.start)]
    return F.concat_ws("#", *parts)


def secondary_key(e: Entity, index: str, columns: list[str]) -> Column:
    """v1#INDEX#column#value...; null when a part is null, so that the row is not in the index."""
    kinds = {a.name: a.type for a in e.attributes}
    parts = [F.lit("v1"), F.lit(index)]
    missing = F.lit(False)
    for c in columns:
        parts += [F.lit(c), component(c, kinds[c])]
        missing = missing | F.col(c).isNull()
    return F.when(~missing, F.concat_ws("#", *parts))


def is_current(e: Entity) -> Column:
    """Rows still open on the processing axis: the predicate of the sparse current-row layout."""
    from palimpsest.model import instant

    return F.col(e.processing.end) == instant(e.processing.infinity) if e.processing else F.lit(True)


def row_size(e: Entity) -> Column:
    """Bytes of a row in an attribute-value store: names plus values, numbers by their digits."""
    size = F.lit(0)
    for a in e.attributes:
        c = F.col(a.name)
        if isinstance(a.type, T.StringType | T.BinaryType):
            n = F.octet_length(c)
        elif isinstance(a.type, T.BooleanType):
            n = F.lit(1)
        elif isinstance(a.type, T.TimestampNTZType):
            n = F.lit(17)
        elif isinstance(a.type, T.DoubleType):
            n = F.lit(8)
        elif isinstance(a.type, T.FloatType):
            n = F.lit(4)
        else:
            n = F.ceil(F.length(c.cast("string")) / 2).cast("int") + 1
        size = size + F.lit(len(a.name)) + F.coalesce(n, F.lit(1))
    return (size + F.lit(sum(len(c) + 17 for c in e.bounds))).cast("bigint")

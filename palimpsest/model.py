"""Entities: named, typed attributes over a table whose rows are rectangles on up to two time axes.

An axis is a pair of boundary columns. A row holds in [from, to) on it, or in (from, to] when the axis is to-inclusive; the
infinity sentinel in ``to`` marks the open end. Boundaries are TIMESTAMP_NTZ, so no session zone plays a part.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field, replace
from enum import Enum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The conventional open end of an axis.
INFINITY = dt.datetime(9999, 12, 1, 23, 59)


class ModelError(ValueError):
    """A model that cannot be mapped; ``code`` names the rule."""

    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code = code


class QueryError(ValueError):
    """A query that is refused by name."""

    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code = code


class Flavour(Enum):
    NONE = "none"
    AUDIT_ONLY = "audit-only"
    BUSINESS_ONLY = "business-only"
    BITEMPORAL = "bitemporal"


#: Spark types by the names that models use; CHAR and the time of day are strings.
TYPES: dict[str, T.DataType] = {
    "boolean": T.BooleanType(),
    "byte": T.ByteType(),
    "short": T.ShortType(),
    "int": T.IntegerType(),
    "long": T.LongType(),
    "float": T.FloatType(),
    "double": T.DoubleType(),
    "char": T.StringType(),
    "string": T.StringType(),
    "date": T.DateType(),
    "timestamp": T.TimestampNTZType(),
    "time": T.StringType(),
    "bytes": T.BinaryType(),
}


def spark_type(name: str, precision: int | None = None, scale: int | None = None) -> T.DataType:
    if name == "decimal":
        if not 1 <= (precision or 38) <= 38 or (scale or 0) < 0:
            raise ModelError("CFG-001", f"decimal({precision}, {scale}) is out of range")
        return T.DecimalType(precision or 38, scale or 0)
    if name not in TYPES:
        raise ModelError("CFG-001", f"unknown type {name}")
    return TYPES[name]


@dataclass(frozen=True)
class Attribute:
    name: str
    type: T.DataType
    key: bool = False
    nullable: bool = True
    column: str | None = None

    @property
    def stored(self) -> str:
        return self.column or self.name


@dataclass(frozen=True)
class Axis:
    """One time axis. ``default`` is the as-of date that a query without one takes; None: it must say."""

    name: str
    start: str
    end: str
    infinity: dt.datetime = INFINITY
    to_inclusive: bool = False
    default: dt.datetime | None = None
    future_expiring: bool = True


@dataclass(frozen=True)
class Relationship:
    """Equality of own and related columns; ``many`` if several related rows may match one."""

    name: str
    related: str
    on: tuple[tuple[str, str], ...]
    many: bool = True
    reverse: str | None = None


@dataclass(frozen=True)
class Entity:
    name: str
    attributes: tuple[Attribute, ...]
    business: Axis | None = None
    processing: Axis | None = None
    relationships: tuple[Relationship, ...] = field(default=())
    table: str | None = None

    def __post_init__(self) -> None:
        validate(self)

    @property
    def flavour(self) -> Flavour:
        if self.business and self.processing:
            return Flavour.BITEMPORAL
        return Flavour.BUSINESS_ONLY if self.business else Flavour.AUDIT_ONLY if self.processing else Flavour.NONE

    @property
    def axes(self) -> tuple[Axis, ...]:
        return tuple(a for a in (self.business, self.processing) if a)

    @property
    def keys(self) -> list[str]:
        return [a.name for a in self.attributes if a.key]

    @property
    def payload(self) -> list[str]:
        return [a.name for a in self.attributes if not a.key]

    @property
    def bounds(self) -> list[str]:
        return [c for a in self.axes for c in (a.start, a.end)]

    @property
    def identity(self) -> list[str]:
        """What tells one stored row from another: the key and every boundary."""
        return self.keys + self.bounds

    @property
    def columns(self) -> list[str]:
        return [a.name for a in self.attributes] + self.bounds

    def schema(self) -> T.StructType:
        fields = [T.StructField(a.name, a.type, a.nullable and not a.key, {"column": a.stored, "key": a.key}) for a in self.attributes]
        return T.StructType(fields + [T.StructField(c, T.TimestampNTZType(), False) for c in self.bounds])

    def relationship(self, name: str) -> Relationship:
        for r in self.relationships:
            if r.name == name:
                return r
        raise QueryError("REL-001", f"{self.name} has no relationship {name}")

    def conform(self, df: DataFrame) -> DataFrame:
        """Stored columns renamed and cast to the declared schema; a nullable attribute that is missing is null."""
        have = set(df.columns)
        out = []
        for a in self.attributes:
            source = a.stored if a.stored in have else a.name if a.name in have else None
            if source is None and not a.nullable:
                raise ModelError("CFG-001", f"{self.name}.{a.name} is missing")
            out.append((F.col(source) if source else F.lit(None)).cast(a.type).alias(a.name))
        return df.select(*out, *[F.col(c).cast("timestamp_ntz").alias(c) for c in self.bounds])

    def with_relationships(self, *more: Relationship) -> Entity:
        return replace(self, relationships=self.relationships + more)


_NO_KEY = (T.FloatType, T.DoubleType, T.ArrayType, T.MapType, T.StructType)


def validate(e: Entity) -> None:
    """Refuse what cannot be mapped, by rule."""
    if not e.keys:
        raise ModelError("CFG-001", f"{e.name} has no primary key")
    seen: set[str] = set()
    for name in [a.stored.lower() for a in e.attributes] + [c.lower() for c in e.bounds]:
        if name in seen:
            raise ModelError("CFG-013", f"{e.name}: two attributes are stored as {name}")
        seen.add(name)
    for a in e.attributes:
        if a.key and isinstance(a.type, _NO_KEY):
            raise ModelError("CFG-016", f"{e.name}.{a.name}: {a.type.simpleString()} cannot be part of a key")
        if isinstance(a.type, T.ArrayType | T.MapType | T.StructType):
            raise ModelError("CFG-001", f"{e.name}.{a.name}: attributes are scalar")
        if "#" in a.name:
            raise ModelError("CFG-008", f"{e.name}.{a.name}: # is not allowed in names")
    for x in e.axes:
        if x.infinity is None:
            raise ModelError("CFG-003", f"{e.name}.{x.name}: an axis needs an infinity date")
    known = {a.name for a in e.attributes}
    for r in e.relationships:
        for own, _ in r.on:
            if own not in known:
                raise ModelError("CFG-005", f"{e.name}.{r.name}: unknown attribute {own}")


def instant(value: dt.datetime | Column) -> Column:
    """A literal instant, or a column, as TIMESTAMP_NTZ."""
    if isinstance(value, Column):
        return value.cast("timestamp_ntz")
    return F.expr(f"TIMESTAMP_NTZ '{value:%Y-%m-%d %H:%M:%S.%f}'")


def tick(value: dt.datetime) -> dt.datetime:
    """The processing instant that a transaction gets: floored to 10 milliseconds."""
    return value.replace(microsecond=value.microsecond // 10_000 * 10_000)

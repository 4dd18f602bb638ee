"""Temporal mutations: logged operations turned into rectangles.

A mutation is a row of the key columns and: op; b, the business date from which it holds; u, until when (null: for ever); p,
the processing instant (use ``model.tick``); seq, the order of mutations with equal p; and new payload values, null where a
value stays. Operations:

insert, insert_until            a new rectangle over [b, u); of zero length if u = b
update, update_until            every current row that meets [b, u) is closed at p; what lies outside [b, u) is stored again
                                with the old payload, the part inside with the new one, segment by segment
increment, increment_until      the same with the numeric payload added to the old one
terminate, terminate_until      the same without the part inside
insert_with_increment(_until)   refused if a current row holds b; fills the gap before the next segment, increments the rest
in_place                        the payload of the current row that holds b is overwritten; no version is kept
purge                           every version of the key goes
archive                         the current row that holds b gets the ends u and p_to
recover                         the four bounds are stored as given: b, u, p, p_to; none may be of zero length

A row whose version began at p itself is dropped instead of closed. Without a processing axis every row counts as such: a
mutation destroys what it replaces. Without a business axis [b, u) is all of time.

``fold`` applies whole logs, a key at a time, as one array expression a key: native, no Python. Its cost for a key grows with
the key's mutations times its rectangles, and a key's log is one array. ``tick`` applies one mutation at most to each key
(DIR-006 otherwise), with the same results and refusals, by joins, and suits any amount of keys and of rows a key. ``value_as_of`` answers as-of questions on a log itself, without
rectangles, by aggregates that combine before the shuffle.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.model import INFINITY, Entity, QueryError, instant

INSERTS = ("insert", "insert_until", "insert_with_increment", "insert_with_increment_until", "recover")
UPDATES = ("update", "update_until")
INCREMENTS = ("increment", "increment_until", "insert_with_increment", "insert_with_increment_until")
ENDS = ("terminate", "terminate_until")
CHANGES = UPDATES + INCREMENTS + ENDS
OPERATIONS = ("in_place", "purge", "archive", *INSERTS, *UPDATES, "increment", "increment_until", *ENDS)
BEGIN = dt.datetime(1, 1, 1)


def _quoted(names: tuple[str, ...]) -> str:
    return ", ".join(f"'{n}'" for n in names)


def _ts(x: dt.datetime) -> str:
    # strftime does not pad years below 1000
    return f"TIMESTAMP_NTZ '{x.year:04d}-{x:%m-%d %H:%M:%S.%f}'"


class _Step:
    """SQL text of one step of the fold: rectangles ``acc`` and mutation ``m`` to rectangles."""

    def __init__(self, payload: list[str], numeric: list[str], future_expiring: bool, infinity: dt.datetime):
        self.payload, self.numeric, self.future, self.inf = payload, numeric, future_expiring, _ts(infinity)

    def rect(self, f: str, t: str, i: str, o: str, value: dict[str, str]) -> str:
        return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in {"f": f, "t": t, "i": i, "o": o, **value}.items()) + ")"

    def old(self, r: str = "r") -> dict[str, str]:
        return {c: f"{r}.`{c}`" for c in self.payload}

    def new(self, r: str = "r") -> dict[str, str]:
        out = {}
        for c in self.payload:
            if c in self.numeric:
                added = f"{r}.`{c}` + coalesce(m.`{c}`, 0)"
                out[c] = f"case when m.op in ({_quoted(INCREMENTS)}) then {added} else coalesce(m.`{c}`, {r}.`{c}`) end"
            else:
                out[c] = f"coalesce(m.`{c}`, {r}.`{c}`)"
        return out

    def given(self) -> dict[str, str]:
        return {c: f"m.`{c}`" for c in self.payload}

    def sql(self) -> str:
        inf = self.inf
        hit = f"(r.o = {inf} and r.f < m.u and r.t > m.b)"
        holds_b = f"(r.o = {inf} and r.f <= m.b and r.t > m.b)"
        # closing an open-ended row that has begun may also cut its business end, a day after p
        end = "r.t" if self.future else f"case when r.t = {inf} and r.f <= m.p then m.p + interval 1 day else r.t end"
        closed = f"case when r.i < m.p then {self.rect('r.f', end, 'r.i', 'm.p', self.old())} end"
        head = f"case when r.f < m.b then {self.rect('r.f', 'm.b', 'm.p', inf, self.old())} end"
        middle = f"case when m.op not in ({_quoted(ENDS)}) then {self.rect('greatest(r.f, m.b)', 'least(r.t, m.u)', 'm.p', inf, self.new())} end"
        tail = f"case when r.t > m.u then {self.rect('m.u', 'r.t', 'm.p', inf, self.old())} end"
        split = f"flatten(transform(filter(acc, r -> {hit}), r -> filter(array({closed}, {head}, {middle}, {tail}), x -> x is not null)))"
        kept = f"filter(acc, r -> not {hit})"
        changed = self.changed = f"concat({kept}, {split})"
        gap_end = f"least(m.u, coalesce(array_min(transform(filter(acc, r -> {hit}), r -> r.f)), m.u))"
        refused = f"exists(acc, r -> {holds_b})"
        gap = f"array({self.rect('m.b', gap_end, 'm.p', inf, self.given())})"
        with_gap = f"case when {refused} then raise_error('DIR-001: a current row holds the date of an insert with increment') else concat({changed}, {gap}) end"
        self.hit, self.holds_b = hit, holds_b
        clash = f"exists(acc, r -> {hit} and m.b < m.u)"
        insert = f"case when {clash} then raise_error('DIR-002: an insert overlaps a current row') else concat(acc, array({self.rect('m.b', 'm.u', 'm.p', inf, self.given())})) end"
        recover = f"case when m.b = m.u or m.p = m.p_to then raise_error('DIR-003: a recovered row of zero length') else concat(acc, array({self.rect('m.b', 'm.u', 'm.p', f'coalesce(m.p_to, {inf})', self.given())})) end"
        overwrite = f"transform(acc, r -> case when {holds_b} then {self.rect('r.f', 'r.t', 'r.i', 'r.o', {c: f'coalesce(m.`{c}`, r.`{c}`)' for c in self.payload})} else r end)"
        archive = f"transform(acc, r -> case when {holds_b} then {self.rect('r.f', 'm.u', 'r.i', f'coalesce(m.p_to, {inf})', self.old())} else r end)"
        return f"""case
            when m.op = 'purge' then filter(acc, r -> false)
            when m.op in ('insert', 'insert_until') then {insert}
            when m.op = 'recover' then {recover}
            when m.op in ('insert_with_increment', 'insert_with_increment_until') then {with_gap}
            when m.op = 'in_place' then {overwrite}
            when m.op = 'archive' then {archive}
            when m.op in ({_quoted(CHANGES)}) then {changed}
            else raise_error(concat('DIR-004: unknown operation ', m.op)) end"""


def _numeric(e: Entity) -> list[str]:
    return [a.name for a in e.attributes if not a.key and isinstance(a.type, T.NumericType)]


def _log(e: Entity, log: DataFrame) -> DataFrame:
    """The log with all columns, in the entity's types and axes."""
    have = set(log.columns)
    kinds = {a.name: a.type for a in e.attributes}
    now = F.col("p").cast("timestamp_ntz") if e.processing else instant(INFINITY) - F.expr("interval 1 second")
    until = F.coalesce(F.col("u").cast("timestamp_ntz"), instant(e.business.infinity)) if e.business and "u" in have else F.expr(_ts(INFINITY))
    until = F.when(F.col("op").endswith("_until") | F.col("op").isin("recover", "archive"), until).otherwise(F.expr(_ts(INFINITY)))
    begin = F.col("b").cast("timestamp_ntz") if e.business else F.expr(_ts(BEGIN))
    last = F.col("p_to").cast("timestamp_ntz") if "p_to" in have else F.lit(None).cast("timestamp_ntz")
    seq = F.col("seq") if "seq" in have else F.lit(0)
    order = F.col("p").cast("timestamp_ntz") if "p" in have else F.col("b").cast("timestamp_ntz")
    payload = [(F.col(c) if c in have else F.lit(None)).cast(kinds[c]).alias(c) for c in e.payload]
    return log.select(*e.keys, order.alias("at"), seq.cast("bigint").alias("seq"), "op", begin.alias("b"), until.alias("u"), now.alias("p"), last.alias("p_to"), *payload)


def _rows(e: Entity, rects: DataFrame) -> DataFrame:
    """Exploded rectangles ``r`` as rows of the entity."""
    out = [F.col(k) for k in e.keys] + [F.col(f"r.`{c}`").alias(c) for c in e.payload]
    if e.business:
        out += [F.col("r.f").alias(e.business.start), F.col("r.t").alias(e.business.end)]
    if e.processing:
        out += [F.col("r.i").alias(e.processing.start), F.col("r.o").alias(e.processing.end)]
    return rects.select(*out)


def _rect_type(e: Entity) -> str:
    kinds = {a.name: a.type.simpleString() for a in e.attributes}
    return "struct<f:timestamp_ntz,t:timestamp_ntz,i:timestamp_ntz,o:timestamp_ntz" + "".join(f",`{c}`:{kinds[c]}" for c in e.payload) + ">"


def _as_rects(e: Entity, rows: DataFrame) -> DataFrame:
    f, t = (F.col(e.business.start), F.col(e.business.end)) if e.business else (F.expr(_ts(BEGIN)), F.expr(_ts(INFINITY)))
    i, o = (F.col(e.processing.start), F.col(e.processing.end)) if e.processing else (instant(INFINITY) - F.expr("interval 1 second"), F.expr(_ts(INFINITY)))
    rect = F.struct(f.alias("f"), t.alias("t"), i.alias("i"), o.alias("o"), *e.payload).cast(_rect_type(e))
    return rows.select(*e.keys, rect.alias("r"))


def _step(e: Entity) -> str:
    if e.processing is None and e.business is None:
        raise QueryError("DIR-005", f"{e.name} has no time axis")
    future = e.processing.future_expiring if e.processing and e.business else True
    return _Step(e.payload, _numeric(e), future, INFINITY).sql()


def fold(e: Entity, log: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """The rectangles that a log makes out of ``start`` (none by default), every version included."""
    order = F.struct("at", "seq", "op", "b", "u", "p", "p_to", *e.payload)
    logs = _log(e, log).groupBy(*e.keys).agg(F.array_sort(F.collect_list(order)).alias("log"))
    none = f"cast(array() as array<{_rect_type(e)}>)"
    if start is None:
        both = logs.withColumn("rects", F.expr(none))
    else:
        held = _as_rects(e, start).groupBy(*e.keys).agg(F.collect_list("r").alias("rects"))
        both = held.join(logs, e.keys, "full").withColumn("rects", F.coalesce("rects", F.expr(none)))
    kind = f"array<{_rect_type(e)}>"
    done = both.withColumn("out", F.expr(f"case when log is null then rects else aggregate(log, rects, (acc, m) -> cast({_step(e)} as {kind})) end"))
    return _rows(e, done.select(*e.keys, F.explode("out").alias("r")))


def tick(e: Entity, rows: DataFrame, mutations: DataFrame) -> DataFrame:
    """The rows after at most one mutation a key, by joins: no key is gathered in one place."""
    names = ("op", "b", "u", "p", "p_to", *e.payload)
    log = _log(e, mutations).groupBy(*e.keys).agg(F.count("*").alias("n"), F.first(F.struct(*names)).alias("m"))
    log = log.select(*e.keys, F.when(F.col("n") > 1, F.raise_error(F.lit("DIR-006: more than one mutation of a key"))).otherwise(F.col("m")).alias("m"))
    step = _Step(e.payload, _numeric(e), e.processing.future_expiring if e.processing and e.business else True, INFINITY)
    sql, kind = step.sql(), f"array<{_rect_type(e)}>"
    # each row on its own: the step on an array of this row alone; what is new is added below
    added = "m.op in ('insert', 'insert_until', 'recover')"
    filled = "m.op in ('insert_with_increment', 'insert_with_increment_until')"
    alone = f"case when m is null or {added} then array(r) when {filled} then cast({step.changed} as {kind}) else cast({sql} as {kind}) end"
    rects = _as_rects(e, rows)
    changed = rects.join(log, e.keys, "left").withColumn("acc", F.array("r"))
    changed = _rows(e, changed.select(*e.keys, F.explode(F.expr(alone)).alias("r")))
    # a new rectangle depends on the current rows of its key by three aggregates only
    fresh = log.where(f"{added} or {filled}").join(rects, e.keys, "left").groupBy(*e.keys).agg(
        F.first("m").alias("m"), F.expr(f"bool_or({step.hit} and m.b < m.u)").alias("clash"), F.expr(f"bool_or({step.holds_b})").alias("held"), F.expr(f"min(case when {step.hit} then r.f end)").alias("next"))
    inf = _ts(INFINITY)
    new = f"""case
        when {added} and m.op <> 'recover' and clash then raise_error('DIR-002: an insert overlaps a current row')
        when {filled} and held then raise_error('DIR-001: a current row holds the date of an insert with increment')
        when m.op = 'recover' and (m.b = m.u or m.p = m.p_to) then raise_error('DIR-003: a recovered row of zero length')
        else {step.rect('m.b', f'case when {filled} then least(m.u, coalesce(next, m.u)) else m.u end', 'm.p', f"case when m.op = 'recover' then coalesce(m.p_to, {inf}) else {inf} end", step.given())} end"""
    fresh = _rows(e, fresh.select(*e.keys, F.expr(f"cast({new} as {_rect_type(e)})").alias("r")))
    return changed.unionByName(fresh)


def value_as_of(log: DataFrame, keys: list[str], business: dt.datetime, processing: dt.datetime, value: str = "value") -> DataFrame:
    """The value of each key as of two dates, from the log alone.

    For logs in which every key begins with an insert over all business time and nothing is inserted again. A key with a
    terminating mutation that covers the dates has no row; otherwise the last covering update counts (base included), or,
    with increments, the sum of the covering ones. Updates and increments may not be mixed in a log.
    """
    at, now = instant(business), instant(processing)
    covering = (F.col("b") <= at) & (F.coalesce(F.col("u"), F.expr(_ts(INFINITY))) > at) & (F.col("p") <= now)
    last = F.max_by(value, F.struct("p", "seq"))
    total = F.sum(value)
    seen = log.where(covering).groupBy(*keys).agg(
        F.max(F.col("op").isin(*ENDS).cast("int")).alias("ended"), F.max(F.col("op").isin(*INCREMENTS).cast("int")).alias("added"), last.alias("last"), total.alias("total"))
    return seen.where("ended = 0").select(*keys, F.when(F.col("added") == 1, F.col("total")).otherwise(F.col("last")).alias(value))


def insert_conflicts(e: Entity, rows: DataFrame, log: DataFrame) -> DataFrame:
    """The inserts of a log that overlap a current row."""
    new = _log(e, log).where(F.col("op").isin("insert", "insert_until"))
    now = _as_rects(e, rows).where(F.col("r.o") == F.expr(_ts(INFINITY)))
    return new.join(now, e.keys).where((F.col("r.f") < F.col("u")) & (F.col("r.t") > F.col("b"))).select(*e.keys, "b", "u").distinct()


def cascade(parents: DataFrame, related: DataFrame, on: list[tuple[str, str]], keys: list[str]) -> DataFrame:
    """The mutations of the related rows that mutations of their parents imply: same op, dates and instant."""
    tie = [F.col(f"p.{a}") == F.col(f"c.{b}") for a, b in on]
    test = tie[0]
    for t in tie[1:]:
        test = test & t
    return parents.alias("p").join(related.alias("c"), test).select(*[F.col(f"c.{k}").alias(k) for k in keys], *[F.col(f"p.{x}").alias(x) for x in ("op", "b", "u", "p", "seq") if x in parents.columns]).distinct()


def _sweep(keys: list[str], bounds: tuple[str, str, str, str]):
    """Over rows in order of key and processing start: those that meet a row still open, on both axes.

    What is held is the rows of one key that are open on the processing axis, not its log.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa

        own, held = None, np.zeros((0, 3), np.int64)
        for batch in batches:
            f, t, i, o = (batch.column(c).cast(pa.int64()).to_numpy() for c in bounds)
            names = list(zip(*[batch.column(k).to_pylist() for k in keys], strict=True))
            bad = np.zeros(batch.num_rows, bool)
            for r in range(batch.num_rows):
                if names[r] != own:
                    own, held = names[r], np.zeros((0, 3), np.int64)
                if len(held):
                    held = held[held[:, 2] > i[r]]
                    bad[r] = bool(((held[:, 0] < t[r]) & (held[:, 1] > f[r])).any())
                held = np.concatenate([held, [[f[r], t[r], o[r]]]])
            yield batch.filter(pa.array(bad))

    return run


def history_overlaps(e: Entity, rows: DataFrame) -> DataFrame:
    """The rows that hold at the same time, on all axes, as an earlier one of their key; empty for a sound history.

    Earlier is by processing start, then business start and ends. Rows of zero length hold never. With one axis a window
    compares each row with the largest end before it. With two, rows are sorted by key and processing start and swept: each is
    compared with the rows of its key that are open then, closed versions included.
    """
    live = F.lit(True)
    for a in e.axes:
        live = live & (F.col(a.start) < F.col(a.end))
    rows = rows.where(live)
    if e.business and e.processing:
        bounds = (e.business.start, e.business.end, e.processing.start, e.processing.end)
        kept = rows.select(*e.columns)
        placed = kept.repartition(*e.keys).sortWithinPartitions(*e.keys, bounds[2], bounds[0], bounds[1], bounds[3])
        return placed.mapInArrow(_sweep(e.keys, bounds), kept.schema)
    from pyspark.sql import Window

    axis = e.axes[0]
    w = Window.partitionBy(*e.keys).orderBy(axis.start, axis.end)
    prior = F.max(axis.end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("prior_end", prior).where(F.col("prior_end") > F.col(axis.start))

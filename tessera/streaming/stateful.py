"""Stateful operators on ``transformWithState``: rows in order across micro-batches, with timers.

Two kinds of order:

* With ``ts`` (a timestamp column that does not fall while ``seq`` rises), a map state per bucket is
  a reorder buffer of packed batches with their bounds in time: rows wait until the watermark (``delay`` behind the greatest timestamp) has
  passed them and are then taken in the order of (timestamp, seq).  Arrival may be shuffled by up
  to ``delay``; what comes later still may be dropped, as with any watermark.  Results do
  not depend on how rows are cut into batches.
* Without ``ts``, rows are ordered by ``seq`` inside a batch and a later batch counts as later.

Streams are dealt by a hash of their keys to ``BUCKETS`` buckets, and a bucket is what Spark
groups by: its rows travel and wait as Arrow record batches, its small values are one table, so a
micro-batch costs a few calls of the state store for a bucket, not several for a row.
State lives in RocksDB (these functions set the provider of the session) and moves with the
task when an executor is lost.  A key keeps its unreleased rows and one small value; a
``forget_ms`` ends that value so long after the key's last row, in event time.  What a task
holds in memory are the rows of one bucket that are released together, as Arrow columns: those of one
batch, or those that the watermark passes at once; the source's rate limit bounds both.  ``SLICE`` of
them at a time are Python rows, or ``COLUMNS`` of them columns of a step that works by columns.  A row that comes when its bucket has released later ones is dropped.

Rows without a ``seq`` (or without ``ts``, where that orders) take no part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..sources.framing import COMMAND, CONTAINER, DATA, EVENT, HELD, RESPONSE, Framer, outcome, outcomes

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Chunks of a stream that may wait for a missing one.
MOST_HELD = 1024
#: Groups of streams; a state that was begun with another number is not read by this one.
BUCKETS = 256
#: Rows and bytes that are dealt to buckets at once, and bytes of one packed batch.
DEALT, DEALT_BYTES, PACKED_BYTES = 1 << 18, 32 << 20, 2 << 20
#: Rows of one bucket that are Python objects at once.
SLICE = 1 << 15
#: Rows of one bucket that a step by columns takes at once.
COLUMNS = 1 << 18
#: Bytes of early chunks of one bucket in memory; more wait in the state store one by one.
EARLY_BYTES = 16 << 20
#: Behind all times.
NEVER = (1 << 63) - 1

State = tuple | None
#: (key, rows in order, state) to the new state and output rows; rows begin with (microseconds, seq).
Step = Callable[[tuple, list[tuple], State], tuple[State, list[tuple]]]
#: The same by columns: (rows of several keys by key and in order, states by key, schema of the output) to output rows; the states are brought up to date.
Whole = Callable[[pa.RecordBatch, dict[tuple, tuple], pa.Schema], pa.Table]


def use_rocksdb(spark: SparkSession) -> None:
    """The state store that ``transformWithState`` needs, if the session has another."""
    if not spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("RocksDBStateStoreProvider"):
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)


def _packs(batch: pa.RecordBatch) -> Iterator[bytes]:
    """A record batch without its schema, cut into pieces of about ``PACKED_BYTES``."""
    step = max(1, PACKED_BYTES * batch.num_rows // max(1, batch.nbytes))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step).serialize().to_pybytes()


def _unpack(data: bytes, schema: pa.Schema) -> pa.RecordBatch:
    return pa.ipc.read_record_batch(pa.py_buffer(data), schema)


def _dealt(rows: DataFrame, keys: list[str]) -> tuple[DataFrame, pa.Schema]:
    """(bucket, least, most, rows): packed rows with the bounds of their column ``at``; and the schema of what is packed."""
    schema = to_arrow_schema(rows.schema)
    place = rows.columns.index("at") + 1 if "at" in rows.columns else None

    def packed(some):
        table = pa.Table.from_batches(some).combine_chunks()
        table = table.take(pc.sort_indices(table.column(0))).combine_chunks()
        bucket = table.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)]
        times = table.column(place).to_numpy() if place is not None else np.zeros(len(bucket), np.int64)
        whole = table.drop_columns([table.column_names[0]]).cast(schema).to_batches()[0]
        out = []
        for a, b in zip(cuts, cuts[1:]):
            least, most = int(times[a:b].min()), int(times[a:b].max())
            out += ((int(bucket[a]), least, most, data) for data in _packs(whole.slice(a, b - a)))
        step = max(1, len(out) * DEALT_BYTES // max(1, whole.nbytes) // 4)
        for k in range(0, len(out), step):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[k : k + step]), (pa.int32(), pa.int64(), pa.int64(), pa.binary()))], names=["bucket", "least", "most", "rows"])

    def run(batches):
        some, n, size = [], 0, 0
        for batch in batches:
            if batch.num_rows:
                some.append(batch)
                n, size = n + batch.num_rows, size + batch.nbytes
            if n >= DEALT or size >= DEALT_BYTES:
                yield from packed(some)
                some, n, size = [], 0, 0
        if some:
            yield from packed(some)

    bucket = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int").alias("__bucket")
    return rows.select(bucket, *rows.columns).mapInArrow(run, "bucket int, least long, most long, rows binary"), schema


def _opened(packed: DataFrame, schema: StructType) -> DataFrame:
    """The rows of packed batches."""
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            for data in batch.column(0).to_pylist():
                yield _unpack(data, arrow)

    return packed.select("rows").mapInArrow(run, schema)


class Ordered(StatefulProcessor):
    """Runs a step over the rows of each key of a bucket in order; see the module text.

    ``due(state)`` is when a state needs attention by itself (microseconds, or None) and
    ``expire(key, state)`` what happens then; both in event time only.
    """

    def __init__(self, width: int, rows: pa.Schema, state: pa.Schema, out: pa.Schema, step: Step, timed: bool, due: Callable[[tuple], int | None], expire: Callable[[tuple, tuple], tuple[State, list[tuple]]], whole: Whole | None = None):
        self.width, self.rows, self.state, self.out = width, rows, state, out
        self.step, self.timed, self.due, self.expire, self.whole = step, timed, due, expire, whole

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getListState("now", "rows binary")
        if self.timed:
            self.held = handle.getMapState("held", "number long", "rows binary")
            self.times = handle.getValueState("times", "passed long, due long, packs binary")

    def _kept(self) -> dict[tuple, tuple]:
        kept = {}
        for (data,) in self.now.get():
            for row in zip(*(c.to_pylist() for c in _unpack(bytes(data), self.state).columns)):
                kept[row[: self.width]] = row[self.width :]
        return kept

    def _keep(self, kept: dict[tuple, tuple]) -> None:
        if kept:
            self.now.put([(data,) for data in _packs(_batch([(*key, *value) for key, value in kept.items()], self.state))])
        else:
            self.now.clear()

    def _packed(self, found: list[tuple]) -> Iterator[Row]:
        yield from (Row(rows=data) for data in _packs(_batch(found, self.out)))

    def _steps(self, table: pa.Table, kept: dict[tuple, tuple]) -> Iterator[Row]:
        """Take the rows of a bucket, by key and in order; ``kept`` is brought up to date."""
        width, found = self.width, []
        names = [*range(width), table.column_names.index("at"), table.column_names.index("seq")]
        table = table.take(pc.sort_indices(table, [(table.column_names[k], "ascending") for k in names]))
        if self.whole is not None:
            for at in range(0, table.num_rows, COLUMNS):
                some = table.slice(at, COLUMNS).combine_chunks().to_batches()[0]
                yield from (Row(rows=data) for batch in self.whole(some, kept, self.out).to_batches() for data in _packs(batch))
            return
        for at in range(0, table.num_rows, SLICE):
            rows = zip(*(c.to_pylist() for c in table.slice(at, SLICE).columns))
            for key, mine in groupby(rows, key=lambda r: r[:width]):
                after, new = self.step(key, [r[width:] for r in mine], kept.get(key))
                if after is None:
                    kept.pop(key, None)
                else:
                    kept[key] = after
                found += new
            if len(found) >= SLICE:
                yield from self._packed(found)
                found = []
        if found:
            yield from self._packed(found)

    def _times(self) -> tuple[int, int, list[list[int]]]:
        """What has been released, when something is due, and the number, least and greatest time of each waiting batch."""
        passed, due, packs = self.times.get() if self.times.exists() else (-NEVER, NEVER, b"")
        return passed, due, np.frombuffer(bytes(packs), np.int64).reshape(-1, 3).tolist()

    def _hold(self, packs: list[list[int]], least: int, most: int, data: bytes) -> None:
        number = packs[-1][0] + 1 if packs else 0
        self.held.updateValue((number,), (data,))
        packs.append([number, least, most])

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        if self.timed:
            passed, due, packs = self._times()
            for r in rows:
                self._hold(packs, r["least"], r["most"], bytes(r["rows"]))
            least = min(due, *(pack[1] for pack in packs), NEVER)
            self.times.update((passed, least, np.array(packs, np.int64).tobytes()))
            if least < due:
                self.handle.registerTimer(-(-least // 1000))
            return
        kept = self._kept()
        yield from self._steps(pa.Table.from_batches([_unpack(bytes(r["rows"]), self.rows) for r in rows]), kept)
        self._keep(kept)

    def handleExpiredTimer(self, key: Any, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        passed, due, packs = self._times()
        if due > now:  # an earlier timer has done it
            return
        ready, wait = [], []
        for number, least, most in packs:  # batches that are wholly ahead stay where they are
            if least > now:
                continue
            batch = _unpack(bytes(self.held.getValue((number,))[0]), self.rows)
            self.held.removeKey((number,))
            times = batch.column("at")
            if most > now:
                wait.append(batch.filter(pc.greater(times, now)))
            ready.append(batch if most <= now and least > passed else batch.filter(pc.and_(pc.less_equal(times, now), pc.greater(times, passed))))
        packs = [pack for pack in packs if pack[1] > now]
        for batch in pa.Table.from_batches(wait, self.rows).combine_chunks().to_batches():
            for data in _packs(batch):
                bounds = pc.min_max(_unpack(data, self.rows).column("at")).as_py()
                self._hold(packs, bounds["min"], bounds["max"], data)
        ready = pa.Table.from_batches(ready, self.rows)
        del wait
        kept = self._kept()
        yield from self._steps(ready, kept)
        del ready
        found, next_due = [], NEVER
        for k, state in list(kept.items()):
            if (at := self.due(state)) is not None and at <= now:
                state, more = self.expire(k, state)
                found += more
                if state is None:
                    del kept[k]
                    continue
                kept[k] = state
                at = self.due(state)
            next_due = min(next_due, NEVER if at is None else max(at, now + 1))
        if found:
            yield from self._packed(found)
        self._keep(kept)
        next_due = min(next_due, *(pack[1] for pack in packs), NEVER)
        self.times.update((now, next_due, np.array(packs, np.int64).tobytes()))
        if next_due < NEVER:
            self.handle.registerTimer(-(-next_due // 1000))

    def close(self) -> None:
        pass


def ordered(df: DataFrame, keys: list[str], values: list[Column], out: str, state: str, step: Step | None, ts: str | None, delay: str, due=None, expire=None, whole: Whole | None = None) -> DataFrame:
    """``keys`` + columns of ``out`` from a step over the rows ``(microseconds, seq, *values)`` of each key.

    A step may get the rows of a key in several pieces, in order; ``whole`` does its work by columns ``*keys, at, seq, v0, v1, ..``.
    """
    use_rocksdb(df.sparkSession)
    at = F.unix_micros(F.col(ts).cast("timestamp")) if ts else F.lit(0).cast("long")
    named = [v.alias(f"v{k}") for k, v in enumerate(values)]
    rows = df.select(*keys, at.alias("at"), F.col("seq").cast("long").alias("seq"), *named).where("at IS NOT NULL AND seq IS NOT NULL")
    head = [rows.schema[k] for k in keys]
    schema = StructType([*head, *StructType.fromDDL(out).fields])
    packed, inner = _dealt(rows, keys)
    if ts:  # the greatest time of a packed batch moves the watermark as its rows would
        packed = packed.withColumn("event_time", F.timestamp_micros("most")).withWatermark("event_time", delay)
    kept = to_arrow_schema(StructType([*head, *StructType.fromDDL(state).fields]))
    processor = Ordered(len(keys), inner, kept, to_arrow_schema(schema), step, ts is not None, due or (lambda state: None), expire or (lambda key, state: (None, [])), whole)
    found = packed.groupBy("bucket").transformWithState(processor, StructType.fromDDL("rows binary"), "append", "EventTime" if ts else "None")
    return _opened(found, schema)


def _forgotten(ts: str | None, forget_ms: int | None):
    """``due`` of a state that ends with the time of the key's last row."""
    if forget_ms is not None and ts is None:
        raise ValueError("forget_ms counts in event time: give ts")
    return (lambda state: state[-1] + forget_ms * 1000) if forget_ms is not None else None


def first_seen(events: DataFrame, added: list[int], removed: list[int], ts: str | None = None, delay: str = "10 minutes", forget_ms: int | None = None) -> DataFrame:
    """(stream_id, handle, seq): handles when they are first seen; a removal forgets the handle, so it may come again.

    The first parameter of an event is its handle (null where there is none).  Without
    ``forget_ms`` a handle once seen stays seen for good, as one flag.
    """
    rows = events.where(F.col("code").isin(*added, *removed)).withColumn("handle", F.get("params", F.lit(0)))

    def step(key, rows, state):
        held, found = state is not None, []
        for _, seq, code, *_ in rows:
            if code in removed:
                held = False
            elif not held:
                held = True
                found.append((*key, seq))
        return (rows[-1][0],) if held else None, found

    return ordered(rows, ["stream_id", "handle"], [F.col("code")], "seq long", "last long", step, ts, delay, _forgotten(ts, forget_ms))


def changes(rows: DataFrame, value: str, ts: str | None = None, delay: str = "10 minutes", forget_ms: int | None = None) -> DataFrame:
    """(stream_id, seq): rows whose value differs from the one before in their stream; the first counts, null equals null."""

    def step(key, rows, state):
        found = []
        for at, seq, digest, *_ in rows:
            if state is None or state[0] != digest:
                found.append((*key, seq))
            state = (digest, at)
        return state, found

    return ordered(rows, ["stream_id"], [F.md5(F.col(value).cast("string"))], "seq long", "digest string, last long", step, ts, delay, _forgotten(ts, forget_ms))


def presence(datagrams: DataFrame, vendors: list[int], ts: str | None = None, delay: str = "10 minutes", forget_ms: int | None = None) -> DataFrame:
    """(vendor_id, product_id, seq, attached): attach and detach of devices of registered vendors; a repeated action gives nothing new."""

    def step(key, rows, state):
        here, found = state is not None and state[0], []
        for _, seq, action, *_ in rows:
            if (action == "add") != here:
                here = not here
                found.append((*key, seq, here))
        return (here, rows[-1][0]), found

    due = _forgotten(ts, forget_ms)
    return ordered(datagrams.where(F.col("vendor_id").isin(*vendors)), ["vendor_id", "product_id"], [F.col("action")], "seq long, attached boolean", "here boolean, last long", step, ts, delay, due)


class Deadline(StatefulProcessor):
    """One outcome a key: the first ready row within the deadline, counted in processing time from the key's first row."""

    def __init__(self, deadline_ms: int, forget_ms: int | None, out: list[str]):
        self.deadline_ms, self.forget_ms, self.out = deadline_ms, forget_ms, out

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.end = handle.getValueState("end", "at long, done boolean", *([self.forget_ms] if self.forget_ms else []))

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        first = min((r["seq"] for r in rows if r["ready"]), default=None)  # takes all rows, holds one number
        now = timerValues.getCurrentProcessingTimeInMs()
        if self.end.exists():
            at, done = self.end.get()
        else:  # the deadline is set here only and never moves
            at, done = now + self.deadline_ms, False
            self.end.update((at, False))
            if first is None:
                self.handle.registerTimer(at)
        if done or now > at or first is None:
            return
        self.end.update((at, True))
        self.handle.deleteTimer(at)
        yield Row(*self.out)(*key, first, False)

    def handleExpiredTimer(self, key: Any, timerValues, expiredTimerInfo) -> Iterator[Row]:
        at, done = self.end.get() if self.end.exists() else (0, True)
        if not done:
            self.end.update((at, True))
            yield Row(*self.out)(*key, None, True)

    def close(self) -> None:
        pass


def settled(polls: DataFrame, ready: Column, deadline_ms: int, ts: str | None = None, delay: str = "10 minutes", forget_ms: int | None = None) -> DataFrame:
    """(stream_id, seq, timed_out): of each stream the first poll that meets a predicate, or a time-out; one outcome a stream.

    The deadline counts from the stream's first poll and never moves, however often it is
    polled.  Without ``ts`` it is a processing-time timer; with it, poll times and the watermark
    decide, so a replay gives the same outcomes.  A poll behind the deadline does not count.
    """
    good = F.coalesce(ready.cast("boolean"), F.lit(False))
    if ts is None:
        use_rocksdb(polls.sparkSession)
        rows = polls.select("stream_id", F.col("seq").cast("long").alias("seq"), good.alias("ready"))
        schema = StructType([rows.schema["stream_id"], *StructType.fromDDL("seq long, timed_out boolean").fields])
        return rows.groupBy("stream_id").transformWithState(Deadline(deadline_ms, forget_ms, schema.names), schema, "append", "ProcessingTime")

    def step(key, rows, state):
        start, done, _ = state or (rows[0][0], False, 0)
        found = []
        for at, seq, is_ready, *_ in rows:
            late = at > start + deadline_ms * 1000
            if not done and (late or is_ready):
                done = True
                found.append((*key, None if late else seq, late))
        return (start, done, rows[-1][0]), found

    def due(state):
        start, done, last = state
        if not done:
            return start + deadline_ms * 1000
        return None if forget_ms is None else last + forget_ms * 1000

    def expire(key, state):
        start, done, last = state
        return (None, []) if done else ((start, True, last), [(*key, None, True)])

    return ordered(polls, ["stream_id"], [good], "seq long, timed_out boolean", "start long, done boolean, last long", step, ts, delay, due, expire)


TRANSACTION = "tx_id long, op int, params binary, data binary, response int, response_params binary, stale long, future long, data_phases long, error string"


def _closed(key: tuple, state: tuple) -> tuple:
    *row, _ = state
    return *key, *row, outcome(row[6], row[7], row[8], row[4])


def _joined(state: tuple, more: tuple) -> tuple:
    """A transaction and what a later piece of its stream adds to it."""
    tx, op, params, data, answer, answer_params, stale, future, phases, _ = state
    if answer is None and more[9]:
        answer, answer_params = more[4], more[5]
    return tx, op, params, data if phases else more[3], answer, answer_params, stale + more[6], future + more[7], phases + more[8], more[10]


def transaction_runs(rows: pa.RecordBatch, kept: dict[tuple, tuple], schema: pa.Schema) -> pa.Table:
    """The transactions that rows ``(stream, at, seq, typ, code, tx_id, body)`` close; ``kept`` holds the open one of each stream.

    A run of rows from one opening command to the next is a transaction; all runs are counted at once.  Only the first and
    the last of a stream are Python rows, as they go on from and to other pieces.
    """
    rows = rows.filter(pc.and_(rows.column("v2").is_valid(), pc.fill_null(pc.not_equal(rows.column("v0"), EVENT), True)))
    n = rows.num_rows
    if not n:
        return schema.empty_table()
    stream, code, body = rows.column(0), rows.column("v1"), rows.column("v3")
    at, tx = rows.column("at").to_numpy(), rows.column("v2").to_numpy()
    typ = rows.column("v0").fill_null(0).to_numpy()
    named = stream.dictionary_encode(null_encoding="encode").indices.to_numpy()
    head = np.r_[True, named[1:] != named[:-1]]  # first row of a stream
    keys = [(k,) for k in stream.take(pa.array(np.flatnonzero(head))).to_pylist()]
    of = np.cumsum(head) - 1
    # a command opens a transaction unless the command before it had the same id
    commands = np.flatnonzero(typ == COMMAND)
    mine = of[commands]
    opens = np.ones(len(commands), bool)
    opens[1:] = (tx[commands][1:] != tx[commands][:-1]) | (mine[1:] != mine[:-1])
    for k in np.flatnonzero(np.r_[True, mine[1:] != mine[:-1]][: len(mine)]).tolist():
        before = kept.get(keys[mine[k]])
        opens[k] = before is None or before[0] != tx[commands[k]]
    opened = np.zeros(n, bool)
    opened[commands[opens]] = True
    # runs of rows of one transaction; the first of a stream may go on with a kept one
    starts = np.flatnonzero(head | opened)
    ends = np.r_[starts[1:], n] - 1
    run = np.cumsum(head | opened) - 1
    goes_on, last, whose = ~opened[starts], np.r_[head[starts[1:]], True], of[starts]
    now = tx[starts].copy()
    alive = np.ones(len(starts), bool)
    for k in np.flatnonzero(goes_on).tolist():
        before = kept.get(keys[whose[k]])
        alive[k] = before is not None
        now[k] = before[0] if before is not None else 0
    this = now[run]
    stale, future = (np.add.reduceat((x < y).astype(np.int64), starts) for x, y in ((tx, this), (this, tx)))
    data = np.flatnonzero((tx == this) & (typ == DATA))
    phases = np.bincount(run[data], minlength=len(starts))
    first_data, answer = np.full(len(starts), -1), np.full(len(starts), -1)
    first_data[run[data[::-1]]] = data[::-1]  # the last one set is the first in order
    replies = np.flatnonzero((tx == this) & (typ == RESPONSE))
    coded = replies[code.is_valid().to_numpy(zero_copy_only=False)[replies]][::-1]
    answer[run[replies]] = replies  # without any code the last body stays
    answer[run[coded]] = coded

    def columns(runs):
        took = lambda column, rows: column.take(pa.array(rows[runs], mask=rows[runs] < 0))
        numbers = (pa.array(x[runs], pa.int64()) for x in (stale, future, phases))
        return [pa.array(now[runs]), took(code, starts), took(body, starts), took(body, first_data), took(code, answer), took(body, answer), *numbers]

    closed = np.flatnonzero(~goes_on & ~last)
    some = columns(closed)
    wrong = outcomes(stale[closed], future[closed], phases[closed], some[4].is_valid().to_numpy(zero_copy_only=False))
    # an open transaction that nothing adds to ends with the command at the head of the piece
    done = [_closed(keys[k], kept[keys[k]]) for k in whose[head[starts] & opened[starts]].tolist() if keys[k] in kept]
    edges = np.flatnonzero((goes_on & alive) | (last & ~goes_on))
    for k, *row, answered, when in zip(edges.tolist(), *(c.to_pylist() for c in columns(edges)), (answer[edges] >= 0).tolist(), at[ends[edges]].tolist()):
        key = keys[whose[k]]
        state = _joined(kept[key], (*row, answered, when)) if goes_on[k] else (*row, when)
        if last[k]:
            kept[key] = state
        else:
            done.append(_closed(key, state))
    found = [c.cast(t) for c, t in zip([stream.take(pa.array(starts[closed])), *some, wrong], schema.types)]
    return pa.Table.from_batches([pa.RecordBatch.from_arrays(found, schema=schema), *([_batch(done, schema)] if done else [])])


def transactions(found: DataFrame, ts: str, delay: str = "10 minutes", linger_ms: int = 60_000) -> DataFrame:
    """Transactions of live streams: the rows of the batch operator of ``sources.framing``, as they close.

    Containers of a stream are taken in order; the open transaction is the stream's only
    state, with counts of late replies instead of their bodies.  It closes, answered or not,
    with the stream's next command of another id, or when the watermark is ``linger_ms`` past its last
    container.  A stream does not use an id twice.
    """

    state = TRANSACTION.replace("error string", "last long")
    values = [F.col(c) for c in ("typ", "code", "tx_id", "body")]
    due, expire = (lambda state: state[9] + linger_ms * 1000), (lambda key, state: (None, [_closed(key, state)]))
    return ordered(found.where("error IS NULL"), ["stream_id"], values, TRANSACTION, state, None, ts, delay, due, expire, transaction_runs)


class Framing(StatefulProcessor):
    """Containers out of numbered chunks of a bucket's streams; a chunk that comes early waits."""

    def __init__(self, first: int, most_held: int, patience_ms: int | None, chunks: pa.Schema, out: pa.Schema):
        self.first, self.most_held, self.patience_ms, self.chunks, self.out = first, most_held, patience_ms, chunks, out
        stream = chunks.field(0)
        self.kept = pa.schema([stream, ("expected", pa.int64()), ("residue", pa.binary()), ("seq", pa.int64()), ("since", pa.int64())])
        self.early = pa.schema([stream, ("seq", pa.int64()), ("data", pa.binary()), ("number", pa.int64())])

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept_state = handle.getListState("kept", "rows binary")
        self.early_state = handle.getListState("early", "rows binary")
        self.stored = handle.getMapState("stored", "number long", "data binary")

    @staticmethod
    def _read(state, schema: pa.Schema) -> Iterator[tuple]:
        for (data,) in state.get():
            yield from zip(*(c.to_pylist() for c in _unpack(bytes(data), schema).columns))

    @staticmethod
    def _write(state, rows: list[tuple], schema: pa.Schema) -> None:
        if rows:
            state.put([(data,) for data in _packs(_batch(rows, schema))])
        else:
            state.clear()

    def _load(self) -> None:
        self.made, self.made_bytes = [], 0
        # of each stream: the next chunk, what is left over, the next container, since when chunks wait
        self.streams = {key: [expected, residue, seq, since] for key, expected, residue, seq, since in self._read(self.kept_state, self.kept)}
        self.waiting: dict[Any, dict[int, tuple]] = {}
        self.waiting_bytes, self.number = 0, 0
        for key, seq, data, number in self._read(self.early_state, self.early):
            self.waiting.setdefault(key, {})[seq] = (data, number)
            self.waiting_bytes += len(data or b"")
            self.number = max(self.number, 0 if number is None else number + 1)

    def _save(self) -> None:
        self._write(self.early_state, [(key, seq, *chunk) for key, mine in self.waiting.items() for seq, chunk in mine.items()], self.early)
        waits = []
        for key, s in self.streams.items():
            s[3] = (self.now if s[3] is None else s[3]) if self.waiting.get(key) else None
            waits += [] if s[3] is None else [s[3]]
        self._write(self.kept_state, [(key, *s) for key, s in self.streams.items()], self.kept)
        if waits and self.patience_ms is not None:
            self.handle.registerTimer(max(self.now + 1, min(waits) + self.patience_ms))

    def _wait(self, key: Any, seq: int, data: bytes) -> None:
        mine = self.waiting.setdefault(key, {})
        if seq in mine:
            self._taken(key, seq)
        if self.waiting_bytes + len(data) <= EARLY_BYTES:
            mine[seq] = (data, None)
            self.waiting_bytes += len(data)
        else:
            self.stored.updateValue((self.number,), (data,))
            mine[seq] = (None, self.number)
            self.number += 1

    def _taken(self, key: Any, seq: int) -> bytes:
        data, number = self.waiting[key].pop(seq)
        if number is None:
            self.waiting_bytes -= len(data)
            return data
        data = bytes(self.stored.getValue((number,))[0])
        self.stored.removeKey((number,))
        return data

    def _rows(self, key: Any, found: list[dict], all_of_it: bool = False) -> Iterator[Row]:
        """Gathers containers and hands them on when they are ``HELD`` bytes."""
        for r in found:
            self.made.append((key, r["seq"], r["length"], r["typ"], r["code"], r["tx_id"], r["body"], r["error"]))
            self.made_bytes += 64 + len(r["body"] or b"")
        if self.made and (all_of_it or self.made_bytes > HELD):
            yield from (Row(rows=data) for data in _packs(_batch(self.made, self.out)))
            self.made, self.made_bytes = [], 0

    def _drain(self, key: Any, skip: bool) -> Iterator[Row]:
        """Take early chunks whose turn has come; with ``skip`` the missing ones are given up and reported."""
        state, mine = self.streams[key], self.waiting.get(key, {})
        framer = Framer(state[1], state[2])
        if skip and mine:
            least = min(mine)
            framer.residue.clear()
            yield from self._rows(key, [framer._row(None, None, None, None, None, f"chunks {state[0]} to {least - 1} are missing")])
            state[0], state[3] = least, None
        while state[0] in mine:
            yield from self._rows(key, framer.feed(self._taken(key, state[0])))
            state[0] += 1
        state[1], state[2] = bytes(framer.residue), framer.seq
        if not mine:
            self.waiting.pop(key, None)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        self.now = timerValues.getCurrentProcessingTimeInMs()
        self._load()
        for r in rows:  # one packed batch in memory at a time
            for stream, seq, data in zip(*(c.to_pylist() for c in _unpack(bytes(r["rows"]), self.chunks).columns)):
                state = self.streams.get(stream)
                if state is None:
                    state = self.streams[stream] = [self.first, b"", 0, None]
                if seq == state[0]:
                    framer = Framer(state[1], state[2])
                    found = framer.feed(data or b"")
                    state[:3] = seq + 1, bytes(framer.residue), framer.seq
                    if found:
                        yield from self._rows(stream, found)
                    if stream in self.waiting:
                        yield from self._drain(stream, False)
                elif seq > state[0]:  # a chunk below was taken before: it is a repeat
                    self._wait(stream, seq, data or b"")
        for stream in list(self.waiting):
            while len(self.waiting.get(stream, ())) > self.most_held:
                yield from self._drain(stream, True)
        yield from self._rows(None, [], True)
        self._save()

    def handleExpiredTimer(self, key: Any, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.now = timerValues.getCurrentProcessingTimeInMs()
        self._load()
        for stream in list(self.waiting):
            since = self.streams[stream][3]
            if since is not None and since + self.patience_ms <= self.now:
                yield from self._drain(stream, True)
        yield from self._rows(None, [], True)
        self._save()

    def close(self) -> None:
        pass


def frame_stream(chunks: DataFrame, first: int = 0, most_held: int = MOST_HELD, patience_ms: int | None = None) -> DataFrame:
    """Containers out of live byte streams, whose chunks are numbered without gaps from ``first``.

    State of a bucket: the bytes that are left over and the running numbers of its streams, and their early chunks, of
    which those beyond ``EARLY_BYTES`` stay in a map on disk.  A task holds these, one packed batch of chunks
    and ``HELD`` bytes of containers at a time, however large the micro-batch (lower
    ``spark.sql.execution.arrow.maxRecordsPerBatch`` for large chunks).  When more than ``most_held`` chunks of a stream wait at the end of a batch, or some have waited
    ``patience_ms`` of processing time, the missing ones are reported as an error row, what was
    left over is dropped and framing goes on with the next chunk.  Repeated chunks are left out.
    """
    use_rocksdb(chunks.sparkSession)
    rows = chunks.where("seq IS NOT NULL").select("stream_id", F.col("seq").cast("long").alias("seq"), F.col("data").cast("binary").alias("data"))
    schema = StructType([rows.schema["stream_id"], *StructType.fromDDL(CONTAINER).fields])
    packed, inner = _dealt(rows, ["stream_id"])
    processor = Framing(first, most_held, patience_ms, inner, to_arrow_schema(schema))
    found = packed.groupBy("bucket").transformWithState(processor, StructType.fromDDL("rows binary"), "append", "None" if patience_ms is None else "ProcessingTime")
    return _opened(found, schema)

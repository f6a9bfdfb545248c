"""Transactions of a bucket by columns against a plain loop, however the rows are cut into pieces."""

import random

import numpy as np
import pyarrow as pa
import pytest

from tessera.sources.framing import MOST_STALE, outcome, outcomes
from tessera.streaming import stateful

ROWS = pa.schema([("stream_id", pa.string()), ("at", pa.int64()), ("seq", pa.int64()), ("v0", pa.int32()), ("v1", pa.int32()), ("v2", pa.int64()), ("v3", pa.binary())])
OUT = pa.schema([("stream_id", pa.string()), ("tx_id", pa.int64()), ("op", pa.int32()), ("params", pa.binary()), ("data", pa.binary()), ("response", pa.int32()), ("response_params", pa.binary()),
                 ("stale", pa.int64()), ("future", pa.int64()), ("data_phases", pa.int64()), ("error", pa.string())])


def plain(rows, kept):
    """One row after the other."""
    done = []
    for stream, at, _, typ, code, tx, body in rows:
        if tx is None or typ == 4:
            continue
        state = kept.get((stream,))
        if typ == 1 and (state is None or state[0] != tx):
            if state is not None:
                done.append((stream, *state[:9], outcome(state[6], state[7], state[8], state[4])))
            state = (tx, code, body, None, None, None, 0, 0, 0, at)
        if state is None:
            continue
        now, op, params, data, answer, answer_params, stale, future, phases, _ = state
        if tx != now:
            stale, future = stale + (tx < now), future + (tx > now)
        elif typ == 2:
            data, phases = (body if not phases else data), phases + 1
        elif typ == 3 and answer is None:
            answer, answer_params = code, body
        kept[(stream,)] = (now, op, params, data, answer, answer_params, stale, future, phases, at)
    return done


def made(rnd, n):
    rows = []
    for stream in ("a", "b", None):
        tx = 1
        for k in range(rnd.randrange(n)):
            typ = rnd.choice([1, 1, 2, 2, 3, 3, 3, 4, None, 7])
            tx += rnd.random() < 0.3
            rows.append((stream, 10 * k, k, typ, rnd.choice([None, 5, 6]), rnd.choice([tx, tx, tx, tx, tx - 1, tx + 1, None]), rnd.choice([None, b"", b"x%d" % k])))
    return rows


@pytest.mark.parametrize("seed", range(40))
def test_runs_equal_a_loop(seed):
    rnd = random.Random(seed)
    rows, piece, kept, want_kept, got = made(rnd, 120), rnd.choice([1, 2, 7, 50, 1000]), {}, {}, []
    want = plain(rows, want_kept)
    for k in range(0, len(rows), piece):
        batch = pa.RecordBatch.from_pylist([dict(zip(ROWS.names, r)) for r in rows[k : k + piece]], ROWS)
        got += [tuple(r.values()) for r in stateful.transaction_runs(batch, kept, OUT).to_pylist()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert kept == want_kept


def test_many_rows_are_not_python_rows(monkeypatch):
    """A bucket's transactions are counted at once; only the open one of a stream is a Python row."""
    n, made = 20_000, []
    cols = [["s"] * 2 * n, range(2 * n), range(2 * n), [1, 3] * n, [5] * 2 * n, np.repeat(np.arange(n), 2), [None] * 2 * n]
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, ROWS.types)], schema=ROWS)
    true = stateful._batch
    monkeypatch.setattr(stateful, "_batch", lambda rows, schema: made.extend(rows) or true(rows, schema))
    packer = stateful.Ordered(1, ROWS, OUT, OUT, None, True, None, None, stateful.transaction_runs)
    kept = {}
    out = [stateful._unpack(r["rows"], OUT) for r in packer._steps(pa.Table.from_batches([batch]), kept)]
    assert sum(b.num_rows for b in out) == n - 1 and [k for k in kept] == [("s",)] and len(made) < 10


def test_outcomes_equal_outcome():
    cases = [(s, f, d, a) for s in (0, MOST_STALE, MOST_STALE + 1) for f in (0, 1) for d in (0, 1, 2) for a in (None, 7)]
    stale, future, phases = (np.array(c) for c in list(zip(*cases))[:3])
    got = outcomes(stale, future, phases, np.array([c[3] is not None for c in cases]))
    assert got.to_pylist() == [outcome(*c) for c in cases]


class Handle:
    """States of one bucket in memory; counts the batches that are read back."""

    def __init__(self):
        self.map, self.value, self.rows, self.read, self.timers = {}, None, [], 0, []

    def getMapState(self, *_):  # noqa: N802
        state = type("Held", (), {})()
        state.updateValue = lambda k, v: self.map.__setitem__(k, v)
        state.removeKey = self.map.pop
        state.getValue = lambda k: (setattr(self, "read", self.read + 1), self.map[k])[1]
        return state

    def getListState(self, *_):  # noqa: N802
        state = type("Now", (), {})()
        state.get, state.put, state.clear = lambda: iter(self.rows), lambda rows: self.rows.__setitem__(slice(None), rows), self.rows.clear
        return state

    def getValueState(self, *_):  # noqa: N802
        state = type("Times", (), {})()
        state.exists, state.get, state.update = lambda: self.value is not None, lambda: self.value, lambda v: setattr(self, "value", v)
        return state

    def registerTimer(self, at):  # noqa: N802
        self.timers.append(at)


def test_batches_ahead_of_the_watermark_are_not_read_back():
    handle = Handle()
    packer = stateful.Ordered(1, ROWS, pa.schema([ROWS.field(0), *list(OUT)[1:10], ("last", pa.int64())]), OUT, None, True, lambda s: None, lambda k, s: (None, []), stateful.transaction_runs)
    packer.init(handle)
    rnd, n, got = random.Random(3), 400, []
    rows = [("s", 1000 * k, k, 1 if k % 4 == 0 else 3, 5, k // 4, None) for k in range(n)]
    parts = [rows[k : k + 100] for k in range(0, n, 100)]
    for k, part in enumerate(parts):
        rnd.shuffle(part)
        cut = [part[j::4] for j in range(4)]
        batches = [pa.RecordBatch.from_pylist([dict(zip(ROWS.names, r)) for r in c], ROWS) for c in cut]
        packed = [{"rows": b.serialize().to_pybytes(), "least": min(r[1] for r in c), "most": max(r[1] for r in c)} for b, c in zip(batches, cut)]
        list(packer.handleInputRows(None, iter(packed), None))
        # the watermark is 25 rows behind the greatest time of the delivery before
        timer = type("T", (), {"getCurrentWatermarkInMs": lambda self, k=k: 100 * k - 25})()
        before = handle.read
        got += [r for r in packer.handleExpiredTimer(None, timer, None)]
        assert handle.read - before <= (0 if k == 0 else 5)  # four new batches are let alone; what was left of the last ones is one
    timer = type("T", (), {"getCurrentWatermarkInMs": lambda self: 10**6})()
    got += list(packer.handleExpiredTimer(None, timer, None))
    ids = [r["tx_id"] for b in got for r in stateful._unpack(b["rows"], OUT).to_pylist()]
    assert sorted(ids) == list(range(n // 4 - 1)) and not handle.map


def test_deliveries_hold_every_container_once(spark):
    from tessera.plans import more_queries as Q

    orders = spark.createDataFrame([(k * 3, k % 70, "OFP"[k % 3], f"{k}-x") for k in range(400)], "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string")
    most = 399 * 3 * 16 + 16
    whole = sorted(r["seq"] for r in Q._containers_of(orders).collect())
    parts = [[r["seq"] for r in Q._transaction_delivery(orders, most, k).collect()] for k in range(Q.DELIVERIES)]
    assert all(parts) and sorted(s for part in parts for s in part) == whole
    key = [k * 3 for k in range(400)]
    assert len(whole) == 400 + sum(2 * (k % 4 == 0) + 9 * (k % 4 == 1) + (k % 11 == 0) + (k % 9 != 0) for k in key) + sum(k % 3 == 0 for k in range(400))

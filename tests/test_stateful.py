"""Stateful operators: shuffled arrival over several micro-batches against plain Python and the batch operators."""

import datetime as dt
import random
import time

import pytest
from pyspark.sql import functions as F

from tessera.sources import framing
from tessera.sources.framing import Framer
from tessera.streaming import events as S

BASE = 86_400
at = lambda s: dt.datetime.fromtimestamp(BASE + s, dt.timezone.utc)


def feed(spark, tmp_path, schema, batches, build, restart_after=None, wait=None):
    """One file a delivery; the query may be stopped and started again between two of them."""
    folder, out, ck = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "ck")
    folder.mkdir()
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    start = lambda: build(source).writeStream.format("parquet").option("path", out).option("checkpointLocation", ck)
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
        if k == restart_after:
            start().trigger(availableNow=True).start().awaitTermination()
    start().trigger(availableNow=True).start().awaitTermination()
    return [tuple(r) for r in spark.read.parquet(out).collect()]


def shuffled(rows, seed, parts, late):
    """Deliveries of rows (.., seq, .., ts): each row comes up to ``late`` seconds after its time."""
    rnd = random.Random(seed)
    ends = len(rows) / parts
    out = [[] for _ in range(parts)]
    for k, r in enumerate(rows):
        out[min(parts - 1, int((k + rnd.random() * late) / ends))].append(r)
    for part in out:
        rnd.shuffle(part)
    return out


def test_changes_in_order_across_batches(spark, tmp_path):
    rnd = random.Random(1)
    rows = [(rnd.choice("ab"), k, rnd.choice([None, None, "x", "y"]), at(k)) for k in range(120)]
    last = [("end", 10**6, None, at(10**6))]
    got = feed(spark, tmp_path, "stream_id string, seq long, v string, ts timestamp", [*shuffled(rows, 2, 5, 15), last], lambda d: S.changes(d, "v", "ts", "16 seconds"), restart_after=2)
    want, state = [("end", 10**6)], {}
    for s, k, v, _ in rows:
        if s not in state or state[s] != v:
            want.append((s, k))
        state[s] = v
    assert sorted(x for x in got if x[0] != "end") == sorted(x for x in want if x[0] != "end")


def test_null_first_value_counts(spark, tmp_path):
    got = feed(spark, tmp_path, "stream_id string, seq long, v string", [[("a", 1, None), ("a", 2, "x")], [("a", 3, "x"), ("a", None, "z"), ("b", 4, None)]], lambda d: S.changes(d, "v"))
    assert sorted(got) == [("a", 1), ("a", 2), ("b", 4)]


def test_first_seen_is_forgotten_in_event_time(spark, tmp_path):
    a, r = 0x4002, 0x4003
    row = lambda seq, code, handle, s: ("s", seq, code, None if handle is None else [handle], at(s))
    batches = [[row(1, a, 7, 10), row(0, a, 8, 5), row(2, a, None, 11)], [row(4, a, 7, 30), row(3, r, 8, 20)], [row(5, a, 8, 60), row(6, a, 7, 200)], [row(7, a, 7, 210), row(8, a, 9, 10**6)]]
    got = feed(spark, tmp_path, "stream_id string, seq long, code int, params array<bigint>, ts timestamp", batches, lambda d: S.first_seen(d, [a], [r], "ts", "10 seconds", forget_ms=100_000))
    assert sorted((h or 0, s) for _, h, s in got if s != 8) == [(0, 2), (7, 1), (7, 6), (8, 0), (8, 5)]


def test_deadline_in_event_time(spark, tmp_path):
    """Polled every 0.5 s with a deadline of 2 s: the deadline does not slide, and there is one outcome a stream."""
    poll = lambda s, seq, ready, t: (s, seq, ready, at(t))
    rows = [poll("often", k, False, k / 2) for k in range(12)] + [poll("often", 12, True, 6.0), poll("often", 13, True, 6.5)]
    rows += [poll("once", 0, False, 1.0), poll("good", 0, None, 0.5), poll("good", 1, True, 2.5), poll("good", 2, True, 2.6), poll("late", 0, False, 0.0), poll("late", 1, True, 2.001)]
    rows.sort(key=lambda r: r[3])
    got = feed(spark, tmp_path, "stream_id string, seq long, ready boolean, ts timestamp", [*shuffled(rows, 3, 5, 3), [poll("end", 0, True, 10**6)]], lambda d: S.settled(d, F.col("ready"), 2000, "ts", "5 seconds"), restart_after=1)
    assert sorted(x for x in got if x[0] != "end") == [("good", 1, False), ("late", None, True), ("often", None, True), ("once", None, True)]


def test_deadline_in_processing_time(spark, tmp_path):
    folder, name = tmp_path / "in", f"sink_{time.time_ns()}"
    folder.mkdir()
    schema = "stream_id string, seq long, ready boolean"
    source = spark.readStream.schema(schema).parquet(str(folder))
    q = S.settled(source, F.col("ready"), 3000, forget_ms=60_000).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "ck")).start()
    drop = lambda *rows: spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(str(folder))
    try:
        k, outcomes, end = 0, [], time.time() + 90
        while time.time() < end and not any(r["stream_id"] == "often" for r in outcomes):
            drop(("often", k, False), *([("good", 0, False), ("good", 1, True)] if k == 0 else []))
            k += 1
            time.sleep(0.5)
            outcomes = spark.table(name).collect()
        drop(("often", k, True), ("good", 2, True), ("new", 0, True))
        while time.time() < end and not any(r["stream_id"] == "new" for r in outcomes):
            time.sleep(0.5)
            outcomes = spark.table(name).collect()
    finally:
        q.stop()
    assert k > 4
    assert sorted(map(tuple, outcomes)) == [("good", 1, False), ("new", 0, False), ("often", None, True)]


def test_transactions_equal_the_batch_operator(spark, tmp_path):
    rnd, rows = random.Random(4), []
    for s in ("a", "b", "c"):
        seq = tx = 0

        def put(typ, tx_id, body=b"", error=None):
            nonlocal seq
            rows.append((s, seq, typ, rnd.randrange(100), tx_id, bytearray(body), error))
            seq += 1

        put(3, 5)  # an answer without a command
        for _ in range(14):
            tx += rnd.randrange(1, 3)
            put(1, tx, b"op")
            for _ in range(rnd.choice([0, 0, 1, 8, 9])):
                put(3, tx - rnd.randrange(1, 5))
            for _ in range(rnd.choice([0, 1, 1, 2])):
                put(2, tx, b"data%d" % seq)
            put(4, tx + 50)
            if rnd.random() < 0.2:
                put(rnd.choice([2, 3]), tx + 7)
            if rnd.random() < 0.1:
                put(1, tx, b"again")
            if rnd.random() < 0.8:
                put(3, tx, b"answer")
            put(3, None)
            put(3, tx, error="broken")
    schema = "stream_id string, seq long, typ int, code int, tx_id long, body binary, error string"
    want = framing.transactions(spark.createDataFrame(rows, schema)).drop("n").collect()
    live = sorted(((*r, at(r[1])) for r in rows), key=lambda r: r[1])
    last = [("end", 10**6, 1, 1, 1, None, None, at(10**6))]
    got = feed(spark, tmp_path, schema + ", ts timestamp", [*shuffled(live, 5, 5, 30), last], lambda d: S.transactions(d, "ts", "40 seconds"), restart_after=2)
    key = lambda r: (r[0], r[1])
    assert len(want) == 42 and len({r["error"] for r in want}) == 5
    assert sorted((tuple(r) for r in got if r[0] != "end"), key=key) == sorted(map(tuple, want), key=key)


def stream_bytes(n, size=0):
    u = lambda v, k: v.to_bytes(k, "little")
    return b"".join(u(12 + k + size, 4) + u(2, 2) + u(k, 2) + u(k, 4) + bytes(k + size) for k in range(n))


def test_framing_of_early_and_repeated_chunks(spark, tmp_path):
    data = stream_bytes(40)
    chunks = [data[k : k + 23] for k in range(0, len(data), 23)]
    rows = [(s, k, bytearray(c)) for s in ("s", "t") for k, c in enumerate(chunks)]
    rows += rows[5:9] + [("s", None, bytearray(b"x"))]
    random.Random(6).shuffle(rows)
    got = feed(spark, tmp_path, "stream_id string, seq long, data binary", [rows[k::5] for k in range(5)], S.frame_stream, restart_after=2)
    want = [(s, w["seq"], w["code"], bytes(w["body"])) for s in ("s", "t") for w in Framer().feed(data)]
    assert sorted((r[0], r[1], r[4], bytes(r[6])) for r in got) == want


def test_framing_reports_missing_chunks(spark, tmp_path):
    data = stream_bytes(12)
    chunks = [data[k : k + 17] for k in range(0, len(data), 17)]
    batches = [[("s", k, bytearray(c))] if k != 3 else [("t", 0, bytearray(data))] for k, c in enumerate(chunks)]
    got = feed(spark, tmp_path, "stream_id string, seq long, data binary", batches[:8], lambda d: S.frame_stream(d, most_held=2))
    plain = Framer()
    want = [w for c in chunks[:3] for w in plain.feed(c)]
    plain.residue.clear()
    want.append(plain._row(None, None, None, None, None, "chunks 3 to 3 are missing"))
    want += [w for c in chunks[4:8] for w in plain.feed(c)]
    assert sorted((r[1], r[4], r[7]) for r in got if r[0] == "s") == sorted((w["seq"], w["code"], w["error"]) for w in want)
    assert len([r for r in got if r[0] == "t"]) == 12


def test_upserts_do_not_change_when_a_batch_is_replayed(spark, tmp_path):
    place, handed = str(tmp_path / "out"), []

    class Stream:
        def foreachBatch(self, handle):  # noqa: N802
            handed.append(handle)

    S.upserts(Stream(), place)
    first = spark.createDataFrame([("a", 1), ("b", 1)], "k string, v int")
    second = spark.createDataFrame([("b", None), ("c", 2)], "k string, v int")
    for batch, number in ((first, 0), (second, 1), (second, 1), (second, 1)):
        handed[0](batch, number)
        got = S.read_upserts(spark, place, ["k"])
    assert sorted(map(tuple, got.collect()), key=str) == [("a", 1), ("b", None), ("c", 2)]
    S.compact_upserts(spark, place, str(tmp_path / "small"), ["k"])
    assert sorted(map(tuple, S.read_upserts(spark, str(tmp_path / "small"), ["k"]).collect()), key=str) == [("a", 1), ("b", None), ("c", 2)]


def test_forgetting_needs_a_time(spark):
    rows = spark.createDataFrame([("a", 1, "x")], "stream_id string, seq long, v string")
    with pytest.raises(ValueError, match="event time"):
        S.changes(rows, "v", forget_ms=5)

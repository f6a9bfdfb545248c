"""Streaming operators: several micro-batches against what one pass over all rows gives."""

import time

import pytest
from pyspark.sql import functions as F

from tessera.sources import bundles
from tessera.sources.framing import Framer
from tessera.streaming import events as S


def run(spark, tmp_path, schema, batches, build, mode="append"):
    """Drop one file a batch, run the query over each, return the sink's rows."""
    folder = tmp_path / "in"
    folder.mkdir()
    name = f"sink_{time.time_ns()}"
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    q = build(source).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "ck")).start()
    try:
        for rows in batches:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
            q.processAllAvailable()
        return spark.table(name).collect()
    finally:
        q.stop()


EV = "stream_id string, seq long, code int, params array<bigint>"


def test_first_seen_and_forgotten(spark, tmp_path):
    a, r = 0x4002, 0x4003
    got = run(spark, tmp_path, EV, [[("s", 0, a, [7]), ("s", 1, a, [7]), ("s", 2, 1, [8])], [("s", 3, a, [7]), ("s", 4, r, [7]), ("s", 5, a, [7]), ("t", 6, a, [7])]], lambda d: S.first_seen(d, [a], [r]))
    assert sorted((x.stream_id, x.handle, x.seq) for x in got) == [("s", 7, 0), ("s", 7, 5), ("t", 7, 6)]


def test_changes_across_batches(spark, tmp_path):
    rows = [[("s", k, v) for k, v in part] for part in ([(0, "a"), (1, "a"), (2, "b")], [(3, "b"), (4, "a")])]
    got = run(spark, tmp_path, "stream_id string, seq long, v string", rows, lambda d: S.changes(d, "v"))
    assert sorted(x.seq for x in got) == [0, 2, 4]


def test_presence(spark, tmp_path):
    rows = [[(1, 2, 0, "add"), (1, 2, 1, "add"), (9, 9, 2, "add")], [(1, 2, 3, "remove")]]
    got = run(spark, tmp_path, "vendor_id int, product_id int, seq long, action string", rows, lambda d: S.presence(d, [1]))
    assert sorted((x.seq, x.attached) for x in got) == [(0, True), (3, False)]


def test_settled(spark, tmp_path):
    # processing-time timeouts ask for batches without data forever, which processAllAvailable would wait for
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    try:
        settled(spark, tmp_path)
    finally:
        spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")


def settled(spark, tmp_path):
    got = run(spark, tmp_path, "stream_id string, seq long, n int", [[("s", 0, 1), ("s", 1, 5)], [("s", 2, 5), ("t", 3, 5)]], lambda d: S.settled(d, F.col("n") == 5, 60_000))
    assert sorted((x.stream_id, x.seq, x.timed_out) for x in got) == [("s", 1, False), ("t", 3, False)]


def test_counts_and_latest(spark, tmp_path):
    got = run(spark, tmp_path, EV, [[("s", 0, 1, [])], [("s", 1, 1, []), ("s", 2, 2, [])]], S.counts, "complete")
    assert sorted((x.code, x.n) for x in got) == [(1, 2), (2, 1)]


def test_latest(spark, tmp_path):
    got = run(spark, tmp_path, EV, [[("s", 0, 1, [])], [("s", 5, 2, []), ("s", 3, 9, [])]], lambda d: S.latest(S.matching(d, [1, 2, 9]), ["stream_id"], "seq", ["code"]), "complete")
    assert [(x.seq, x.code) for x in got] == [(5, 2)]


def test_frames_across_batches(spark, tmp_path):
    u = lambda v, n: v.to_bytes(n, "little")
    data = b"".join(u(12 + k, 4) + u(2, 2) + u(k, 2) + u(k, 4) + bytes(k) for k in range(5))
    rows = [[("s", 0, bytearray(data[:17])), ("s", 1, bytearray(data[17:20]))], [("s", 2, bytearray(data[20:]))]]
    got = run(spark, tmp_path, "stream_id string, seq long, data binary", rows, S.frame_stream)
    want = Framer().feed(data)
    assert sorted((x.seq, x.code, len(x.body)) for x in got) == [(w["seq"], w["code"], len(w["body"])) for w in want]


def test_for_each_batch(spark, tmp_path):
    folder, seen = tmp_path / "in", []
    spark.createDataFrame([("s", 0, 1, [1])], EV).write.parquet(str(folder))
    q = S.for_each_batch(S.event_drop(spark, str(folder), EV), lambda b, k: seen.append((k, b.count())), str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    assert seen == [(0, 1)]


def test_bundle_and_text_snapshots(spark, tmp_path):
    for k, name in enumerate(("001-op9209-in.bin", "002-op9209-in.bin", "003-op1001-in.bin", "note.txt")):
        (tmp_path / name).write_bytes(bytes([k]))
    last = bundles.last_file(bundles.read_bundle(spark, str(tmp_path), "op9209")).collect()
    assert [bytes(r.content) for r in last] == [b"\x01"]
    df = spark.createDataFrame([(0x5007, 400), (0xD20D, 7)], "code int, value long")
    bundles.write_text_snapshot(df, str(tmp_path / "snap"))
    back = bundles.read_text_snapshot(spark, str(tmp_path / "snap"))
    assert sorted(map(tuple, back.collect())) == [(0x5007, 400), (0xD20D, 7)]


@pytest.mark.parametrize("n, ok", [(10, True), (16, True), (12, False)])
def test_downloads(spark, n, ok):
    objects = spark.createDataFrame([(1, 10)], "handle int, size int")
    contents = spark.createDataFrame([(1, bytearray(n))], "handle int, content binary")
    assert bundles.downloads(objects, contents, block=8).first().complete == ok

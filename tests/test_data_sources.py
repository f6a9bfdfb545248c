"""Data sources of the library's own: capture bundles, event spools, byte ranges."""

import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, IsNotNull, Not, StringContains
from pyspark.sql.types import StructType

from tessera.sources import capture, event_spool, files, ranges
from tessera.sources.framing import Framer


@pytest.fixture
def bundle(tmp_path):
    folder = tmp_path / "bundle"
    for session in ("a", "b"):
        (folder / session).mkdir(parents=True)
        for k, op in enumerate((0x9209, 0x1001, 0x9209, 0x1014), 1):
            (folder / session / f"{k:03d}-op{op:04X}-in.bin").write_bytes(session.encode() * k)
    (folder / "note.txt").write_text("no payload")
    (folder / "_staging-x" / "y").mkdir(parents=True)
    (folder / "_staging-x" / "y" / "009-op9209-in.bin").write_bytes(b"left over")
    return str(folder)


def test_filters_keep_files_closed(bundle):
    schema = StructType.fromDDL(capture.CAPTURE)
    reader = capture.CaptureReader(bundle, schema, 4)
    opened = []
    reader.open = lambda below, real=reader.open: (opened.append(below), real(below))[1]
    kept = list(reader.pushFilters([EqualTo(("operation",), 0x9209), IsNotNull(("phase",)), In(("session",), ("b",)), Not(EqualTo(("name",), "x")), StringContains(("name",), "op9209"), GreaterThan(("ordinal",), 1), EqualTo(("content",), b"")]))
    assert [type(f).__name__ for f in kept] == ["Not", "EqualTo"]
    rows = [r for p in reader.partitions() for r in reader.read(p)]
    assert opened == ["b/003-op9209-in.bin"] and rows == [("b", "003-op9209-in.bin", 3, 0x9209, "in", 3, b"bbb")]
    reader = capture.CaptureReader(bundle, StructType.fromDDL("name string, length long"), 4)
    reader.open = lambda below: pytest.fail("opened")
    assert sorted(r for p in reader.partitions() for r in reader.read(p))[0] == ("001-op9209-in.bin", 1)


def test_groups_of_files(bundle):
    reader = capture.CaptureReader(bundle, StructType.fromDDL(capture.CAPTURE), 5)
    groups = [[f["length"] for f in p.files] for p in reader.partitions()]
    assert sum(groups, []) == [1, 2, 3, 4, 1, 2, 3, 4] and all(sum(g) <= 5 for g in groups)


def test_captures_in_spark(spark, bundle):
    got = capture.read_captures(spark, bundle).where("operation = 37385 AND ordinal > 1").orderBy("session")
    assert [(r["session"], bytes(r["content"])) for r in got.collect()] == [("a", b"aaa"), ("b", b"bbb")]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Filter (" not in plan and "- Filter" not in plan, plan  # both filters went to the source
    assert [bytes(r["content"]) for r in capture.last_capture(spark, bundle, 0x1014).collect()] == [b"bbbb"]
    assert capture.read_captures(spark, bundle + "/none").collect() == []
    assert capture.read_captures(spark, bundle, content=False).count() == 8


WRITTEN = [("s", 1, 0x9209, [1, 2], 7, bytearray(b"abc"), 0, 12, None), ("s", 2, 0x1016, None, 8, None, 4, 1, "device\nbusy"), ("t", 1000, 0x1001, [], None, bytearray(b"xy"), None, None, None), (None, 3, 1, [5], 9, bytearray(b""), 0, 0, None)]


def test_written_bundles_and_logs(spark, tmp_path):
    folder = str(tmp_path / "out")
    df = spark.createDataFrame(WRITTEN, capture.WRITTEN).withColumn("more", F.lit(1))
    capture.write_captures(df.repartition(3), folder)
    got = capture.read_captures(spark, folder).orderBy("session").collect()
    assert [(r["session"], r["name"], bytes(r["content"])) for r in got] == [("s", "001-op9209-in.bin", b"abc"), ("t", "1000-op1001-in.bin", b"xy")]
    log = capture.read_session_log(spark, folder).orderBy("ordinal").collect()
    assert [tuple(r) for r in log] == [(1, 0x9209, [1, 2], 7, 3, 0, 12, None), (2, 0x1016, [], 8, 0, 4, 1, "device busy"), (3, 1, [5], 9, 0, 0, 0, None), (1000, 0x1001, [], 0, 2, 0, 0, None)]
    capture.write_captures(df.where("ordinal = 1"), folder, "overwrite")
    assert capture.read_captures(spark, folder).count() == 1 and capture.read_session_log(spark, folder).count() == 1
    assert not [n for n in os.listdir(folder) if n.startswith("_")]
    with pytest.raises(Exception, match="needs the columns"):
        df.drop("data").write.format("capture_bundle").mode("append").save(folder)


class Failing(capture.CaptureWriter):
    """Fails behind its first file, as long as the marker is there."""

    def files(self, rows):
        for k, f in enumerate(super().files(rows)):
            yield f
            if k == 0 and os.path.exists(self.uri + ".fail"):
                os.remove(self.uri + ".fail")
                raise OSError("lost")


def test_failed_tasks_leave_no_orphans(tmp_path):
    folder = str(tmp_path / "out")
    writer = Failing(folder, False, StructType.fromDDL(capture.WRITTEN))
    rows = [dict(zip(StructType.fromDDL(capture.WRITTEN).names, r)) for r in WRITTEN[:3]]
    open(folder + ".fail", "w").close()
    with pytest.raises(OSError):
        writer.write(iter(rows))
    again = writer.write(iter(rows))  # the second attempt
    assert capture.listed(folder) == []  # nothing is seen before the commit
    writer.commit([again, None])
    assert [b for b, *_ in files.listed(folder) if b.endswith(".bin")] == ["s/001-op9209-in.bin", "t/1000-op1001-in.bin"]
    assert sorted(os.listdir(folder)) == ["s", "t"]
    other = Failing(folder, False, StructType.fromDDL(capture.WRITTEN))
    other.abort([other.write(iter(rows[:1]))])
    assert sorted(os.listdir(folder)) == ["s", "t"]


def test_ranges(spark, tmp_path):
    data = bytes(range(256)) * 40
    for name in ("x", "y"):
        (tmp_path / name).write_bytes(data)
    big = tmp_path / "big"
    with open(big, "wb") as f:  # a sparse file beyond 32 bits
        f.seek(5 << 30)
        f.write(b"end")
    x, y = (f"file://{tmp_path}/{n}" for n in "xy")
    asked = [(x, 0, 4), (x, 255, 3), (y, 10_239, 5), (y, 10_240, 5), (y, 1 << 40, 1), (x, None, 1), (x, -1, 4), (x, 3, -1), (x, 7, 0), (None, 0, 1), (str(tmp_path / "none"), 0, 1), (str(big), (5 << 30) - 1, 4)]
    got = ranges.read_ranges(spark.createDataFrame(asked, "path string, offset long, length long")).collect()
    want = [b"\0\1\2\3", b"\xff\0\1", b"\xff", b"", b"", None, None, None, b"", None, None, b"\0end"]
    key = lambda r: tuple(map(str, r))
    assert sorted(((r[0], r[1], r[2], None if r[3] is None else bytes(r[3])) for r in got), key=key) == sorted(((*a, w) for a, w in zip(asked, want)), key=key)


def test_only_asked_bytes_are_read(tmp_path, monkeypatch):
    (tmp_path / "x").write_bytes(bytes(10_000))
    read = []

    class Source:
        def __init__(self, real):
            self.real = real

        def size(self):
            return self.real.size()

        def read_at(self, n, at):
            read.append(n)
            return self.real.read_at(n, at)

    class Files:
        def open_input_file(self, path):
            return Source(real.open_input_file(path))

    real, _ = files.located(str(tmp_path))
    monkeypatch.setattr(ranges, "located", lambda uri: (Files(), uri))

    class Requests:
        columns = ["path", "offset", "length"]
        schema = StructType.fromDDL("path string, offset long, length long")

        def repartition(self, *_):
            return self

        def sortWithinPartitions(self, *_):  # noqa: N802
            return self

        def mapInArrow(self, run, schema):  # noqa: N802
            import pyarrow as pa

            batch = pa.RecordBatch.from_pydict({"path": [str(tmp_path / "x")] * 2, "offset": [5, 9_990], "length": [7, 100]})
            return list(run([batch]))

    monkeypatch.setattr(ranges.F, "col", lambda c: 1)
    monkeypatch.setattr(ranges.F, "floor", lambda c: c)
    assert [len(b) for batch in ranges.read_ranges(Requests()) for b in batch.column(3).to_pylist()] == [7, 10]
    assert read == [7, 10]


def events(stream, first, n):
    return [(stream, first + k, 0x4002 + k % 3, k, [k, 2**32 - 1][: k % 3]) for k in range(n)]


def test_spool_is_polled_and_replayed(spark, tmp_path):
    event_spool.register(spark)
    folder, out, ck = (str(tmp_path / n) for n in ("spool", "out", "ck"))
    schema = "stream_id string, seq long, code int, tx_id long, params array<bigint>"
    written = []

    def collect(*parts):
        for rows in parts:
            written.extend(rows)
            spark.createDataFrame(rows, schema).coalesce(1).write.format("event_spool").mode("append").save(folder)

    def poll():
        q = spark.readStream.format("event_spool").load(folder).writeStream.format("parquet").option("path", out).option("checkpointLocation", ck).trigger(availableNow=True).start()
        q.awaitTermination()
        return sum(p["numInputRows"] for p in q.recentProgress)

    os.mkdir(folder)
    assert poll() == 0  # an empty spool is no error
    collect(events("a", 0, 5), events("b", 0, 3))
    assert poll() == 8
    assert poll() == 0
    collect(events("a", 5, 4), events("c", 0, 2))
    assert poll() == 6
    got = sorted((r["stream_id"], r["seq"], r["code"], r["tx_id"], r["params"]) for r in spark.read.parquet(out).collect())
    assert got == sorted(written)
    whole = spark.read.format("event_spool").option("partitionBytes", 30).load(folder)
    assert whole.count() == 14 and whole.rdd.getNumPartitions() > 2
    assert whole.where("ingest_ts IS NULL").count() == 0


def test_spool_offsets(tmp_path):
    reader = event_spool.SpoolStreamReader(str(tmp_path), 1 << 20)
    assert reader.initialOffset() == {} == reader.latestOffset()
    writer = event_spool.SpoolWriter(str(tmp_path), False)
    keys = ("stream_id", "seq", "code", "tx_id", "params")
    for first in (0, 3, 6):
        writer = event_spool.SpoolWriter(str(tmp_path), False)
        writer.commit([writer.write(iter([dict(zip(keys, e)) for e in events("s", first, 3)]))])
    end = reader.latestOffset()
    assert end == {"s": "000000000006.bin"}
    some = reader.partitions({"s": "000000000000.bin"}, {"s": "000000000003.bin"})
    assert [f[1] for p in some for f in p.files] == ["000000000003.bin"]
    assert [r[1] for p in reader.partitions({}, end) for r in reader.read(p)] == list(range(9))
    assert reader.partitions(end, end) == []
    assert len(Framer().feed(files.read_file(str(tmp_path), "s/000000000000.bin"))) == 3

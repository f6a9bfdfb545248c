"""Capture bundles as a Spark data source: raw replies, one file for each inbound phase, and a session log.

``spark.read.format("capture_bundle").load(folder)`` has a row for each file
``<session>/<ordinal>-op<code>-in.bin``.  Filters on session, name, ordinal, operation and phase
are pushed down to the file names, so files that they exclude are not opened; a schema without
``content`` opens none.  A task reads a group of files of about ``partitionBytes``.

``df.write.format("capture_bundle").save(folder)`` takes transactions and writes the files and a
log line for each; see :class:`files.StagedWriter` for what failed tasks leave (nothing).
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, IsNotNull, LessThan, LessThanOrEqual, StringContains, StringEndsWith, StringStartsWith
from pyspark.sql.types import StructType

from .files import Group, StagedWriter, grouped, listed, read_file

CAPTURE = "session string, name string, ordinal int, operation int, phase string, length long, content binary"
#: What a transaction needs to be written; a null ``data`` or an empty one makes no file.
WRITTEN = "session string, ordinal int, op int, params array<bigint>, tx_id long, data binary, sent long, duration_ms long, error string"
_WRITTEN_NAMES = [column.split()[0] for column in WRITTEN.split(", ")]
PARTITION_BYTES = 32 << 20

# fixed values: the name of a payload file and the line of a transaction in the session log
_NAME = re.compile(r"(?:(.*)/)?((\d{3,})-op([0-9A-F]{4})-(in|out)\.bin)")
_FILE = "%03d-op%04X-in.bin"
_LINE = "  [%03d] op=0x%04X params=%s tx=%d in=%dB out=%dB %s %s"
_LOGGED = r"^  \[(\d+)\] op=0x([0-9A-F]+) params=\[([^\]]*)\] tx=(\d+) in=(\d+)B out=(\d+)B (\d+)ms (.*)$"

_TESTS = {
    EqualTo: lambda v, x: v == x, EqualNullSafe: lambda v, x: v == x, In: lambda v, x: v in x, GreaterThan: lambda v, x: v > x, GreaterThanOrEqual: lambda v, x: v >= x,
    LessThan: lambda v, x: v < x, LessThanOrEqual: lambda v, x: v <= x, StringStartsWith: lambda v, x: v.startswith(x), StringEndsWith: lambda v, x: v.endswith(x), StringContains: lambda v, x: x in v,
}


class CaptureReader(DataSourceReader):
    def __init__(self, folder: str, schema: StructType, partition_bytes: int):
        self.folder, self.names, self.partition_bytes = folder, schema.names, partition_bytes
        self.tests: list[tuple[str, type, Any]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            column = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if column in ("session", "name", "ordinal", "operation", "phase", "length") and (type(f) in _TESTS or isinstance(f, IsNotNull)):
                if not isinstance(f, IsNotNull):  # facts of a file name are never null
                    self.tests.append((column, type(f), f.value))
            else:
                yield f

    def facts(self) -> Iterator[dict]:
        for below, length, _ in listed(self.folder):
            if m := _NAME.fullmatch(below):
                fact = {"session": m[1] or "", "name": m[2], "ordinal": int(m[3]), "operation": int(m[4], 16), "phase": m[5], "length": length, "below": below}
                if all(x is not None and _TESTS[kind](fact[c], x) for c, kind, x in self.tests):
                    yield fact

    def partitions(self) -> list[Group]:
        weight = (lambda f: f["length"]) if "content" in self.names else (lambda f: 64)
        return grouped(self.facts(), weight, self.partition_bytes) or [Group([])]

    def open(self, below: str) -> bytes:
        return read_file(self.folder, below)

    def read(self, partition: Group) -> Iterator[tuple]:
        for fact in partition.files:
            content = self.open(fact["below"]) if "content" in self.names else None
            yield tuple(content if n == "content" else fact[n] for n in self.names)


class CaptureWriter(StagedWriter):
    def __init__(self, folder: str, overwrite: bool, schema: StructType):
        super().__init__(folder, overwrite)
        if missing := set(_WRITTEN_NAMES) - set(schema.names):
            raise ValueError(f"a bundle needs the columns {sorted(missing)}")

    def files(self, rows: Iterator) -> Iterator[tuple[str, bytes]]:
        log: dict[str, list[str]] = {}
        for r in rows:
            data, session = r["data"] or b"", r["session"] or ""
            params = f"[{' '.join(map(str, r['params'] or []))}]"
            line = _LINE % (r["ordinal"], r["op"], params, r["tx_id"] or 0, len(data), r["sent"] or 0, f"{r['duration_ms'] or 0}ms", "ok" if r["error"] is None else "ERR " + r["error"].replace("\n", " "))
            log.setdefault(session, []).append(line)
            if data:
                yield (f"{session}/" if session else "") + _FILE % (r["ordinal"], r["op"]), bytes(data)
        for session, lines in log.items():  # a line for each transaction of the task
            yield (f"{session}/" if session else "") + f"session-{uuid.uuid4().hex}.log", ("\n".join(lines) + "\n").encode()


class CaptureBundle(DataSource):
    @classmethod
    def name(cls) -> str:
        return "capture_bundle"

    def schema(self) -> str:
        return CAPTURE

    def reader(self, schema: StructType) -> CaptureReader:
        return CaptureReader(self.options["path"], schema, int(self.options.get("partitionBytes", PARTITION_BYTES)))

    def writer(self, schema: StructType, overwrite: bool) -> CaptureWriter:
        return CaptureWriter(self.options["path"], overwrite, schema)


def register(spark: SparkSession) -> None:
    """Make ``capture_bundle`` known to a session and let it take filters."""
    spark.dataSource.register(CaptureBundle)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read_captures(spark: SparkSession, folder: str, content: bool = True) -> DataFrame:
    register(spark)
    reader = spark.read.format("capture_bundle")
    return (reader if content else reader.schema(CAPTURE.replace(", content binary", ""))).load(folder)


def last_capture(spark: SparkSession, folder: str, operation: int) -> DataFrame:
    """The last file by name of an operation's replies; the only one that is opened."""
    names = read_captures(spark, folder, content=False).where((F.col("operation") == operation) & (F.col("phase") == "in"))
    last = names.agg(F.max(F.struct("session", "name")).alias("f")).select("f.session", "f.name").first()  # one row
    return read_captures(spark, folder).where((F.col("session") == last["session"]) & (F.col("name") == last["name"]))


def write_captures(transactions: DataFrame, folder: str, mode: str = "append") -> None:
    register(transactions.sparkSession)
    transactions.select(*_WRITTEN_NAMES).write.format("capture_bundle").mode(mode).save(folder)


def read_session_log(spark: SparkSession, folder: str) -> DataFrame:
    """The transactions of session logs: ordinal, op, params, tx_id, received and sent bytes, duration_ms, error; other lines are left out."""
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "session-*.log").text(folder)
    part = lambda k: F.regexp_extract("value", _LOGGED, k)
    params = F.transform(F.filter(F.split(part(3), " "), lambda x: x != ""), lambda x: x.cast("long"))
    return lines.where(F.col("value").rlike(_LOGGED)).select(
        part(1).cast("int").alias("ordinal"), F.conv(part(2), 16, 10).cast("int").alias("op"), params.alias("params"), part(4).cast("long").alias("tx_id"), part(5).cast("long").alias("received"), part(6).cast("long").alias("sent"),
        part(7).cast("long").alias("duration_ms"), F.when(part(8) != "ok", F.substring(part(8), 5, 1 << 30)).alias("error"))

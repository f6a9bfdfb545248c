"""A polled source of events: a collector appends files of event containers, a stream takes what is new.

A spool is a folder ``<stream>/<number of the first event, 12 digits>.bin``; names of a stream
ascend.  The offset is the last file taken of each stream, so it does not depend on clocks: a poll
without new files gives the same offset and no batch, and after a restart the files between two
checkpointed offsets are read again, no other ones.

``spark.read.format("event_spool")`` reads all that is there; ``df.write.format("event_spool")`` is
the collector's side: files of about ``FILE_BYTES`` for each run of rows of one stream, numbered on from the first one's ``seq``.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from itertools import groupby

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader
from pyspark.sql.types import StructType

from .files import Group, StagedWriter, grouped, listed, read_file
from .framing import EVENT, HEADER, Framer

EVENTS = "stream_id string, seq long, code int, tx_id long, params array<bigint>, ingest_ts timestamp"
PARTITION_BYTES = 8 << 20
#: Bytes behind which the writer begins another file, so that no task holds a whole stream.
FILE_BYTES = 4 << 20


class _Spool:
    def __init__(self, folder: str, partition_bytes: int):
        self.folder, self.partition_bytes = folder, partition_bytes

    def found(self) -> Iterator[tuple[str, str, int, float]]:
        for below, size, mtime in listed(self.folder):
            stream, _, name = below.rpartition("/")
            if stream and name.endswith(".bin") and name[:-4].isdigit():
                yield stream, name, size, mtime

    def dealt(self, files: list) -> list[Group]:
        return grouped(files, lambda f: f[2], self.partition_bytes)

    def read(self, partition: Group) -> Iterator[tuple]:
        for stream, name, _, mtime in partition.files:
            when = dt.datetime.fromtimestamp(mtime, dt.timezone.utc)
            for k, c in enumerate(c for c in Framer().each(read_file(self.folder, f"{stream}/{name}")) if c["typ"] == EVENT):
                params = [int.from_bytes(c["body"][i : i + 4], "little") for i in range(0, len(c["body"]) - 3, 4)]
                yield stream, int(name[:-4]) + k, c["code"], c["tx_id"], params, when


class SpoolReader(_Spool, DataSourceReader):
    def partitions(self) -> list[Group]:
        return self.dealt(list(self.found())) or [Group([])]


class SpoolStreamReader(_Spool, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {stream: name for stream, name, *_ in self.found()}  # names ascend: the last stays

    def partitions(self, start: dict, end: dict) -> list[Group]:
        return self.dealt([f for f in self.found() if start.get(f[0], "") < f[1] <= end.get(f[0], "")])


class SpoolWriter(StagedWriter):
    def files(self, rows: Iterator) -> Iterator[tuple[str, bytes]]:
        for stream, events in groupby(rows, key=lambda r: r["stream_id"]):
            first, n, out = None, 0, bytearray()
            for e in events:
                if len(out) >= FILE_BYTES:
                    yield f"{stream}/{first:012d}.bin", bytes(out)
                    first, n, out = first + n, 0, bytearray()
                first = e["seq"] if first is None else first
                n += 1
                body = b"".join(p.to_bytes(4, "little") for p in e["params"] or [])
                out += (HEADER + len(body)).to_bytes(4, "little") + EVENT.to_bytes(2, "little") + e["code"].to_bytes(2, "little") + e["tx_id"].to_bytes(4, "little") + body
            yield f"{stream}/{first:012d}.bin", bytes(out)


class EventSpool(DataSource):
    @classmethod
    def name(cls) -> str:
        return "event_spool"

    def schema(self) -> str:
        return EVENTS

    def _args(self) -> tuple[str, int]:
        return self.options["path"], int(self.options.get("partitionBytes", PARTITION_BYTES))

    def reader(self, schema: StructType) -> SpoolReader:
        return SpoolReader(*self._args())

    def streamReader(self, schema: StructType) -> SpoolStreamReader:
        return SpoolStreamReader(*self._args())

    def writer(self, schema: StructType, overwrite: bool) -> SpoolWriter:
        return SpoolWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(EventSpool)

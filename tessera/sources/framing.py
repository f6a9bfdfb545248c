"""Byte streams to containers, containers to transactions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HEADER, MOST = 12, 512 << 20
COMMAND, DATA, RESPONSE, EVENT = 1, 2, 3, 4
#: Late replies of earlier transactions that are skipped before giving up.
MOST_STALE = 8
#: Bytes of containers that a task gathers before it hands them on.
HELD = 16 << 20
CONTAINER = "seq long, length long, typ int, code int, tx_id long, body binary, error string"


class Framer:
    """Cuts containers out of chunks; what is left of one chunk goes before the next."""

    def __init__(self, residue: bytes = b"", seq: int = 0):
        self.residue, self.seq = bytearray(residue), seq

    def feed(self, chunk: bytes) -> list[dict]:
        return list(self.each(chunk))

    def each(self, chunk: bytes) -> Iterator[dict]:
        """The containers one by one; to be taken to the end."""
        self.residue += chunk
        at = 0
        data = self.residue
        while True:
            if len(data) - at < HEADER:
                break
            length = int.from_bytes(data[at : at + 4], "little")
            kind = int.from_bytes(data[at + 4 : at + 6], "little")
            if not 1 <= kind <= 4 and length < HEADER:  # padding behind a container
                at = len(data)
                break
            if length < HEADER or length > MOST:
                yield self._row(length, kind, None, None, None, f"container length {length}")
                at = len(data)
                break
            if len(data) - at < length:
                break
            code, tx = int.from_bytes(data[at + 6 : at + 8], "little"), int.from_bytes(data[at + 8 : at + 12], "little")
            yield self._row(length, kind, code, tx, bytes(data[at + HEADER : at + length]), None)
            at += length
        del data[:at]

    def _row(self, length, typ, code, tx, body, error):
        self.seq += 1
        return {"seq": self.seq - 1, "length": length, "typ": typ, "code": code, "tx_id": tx, "body": body, "error": error}


def containers(chunks: DataFrame) -> DataFrame:
    """``chunks(stream_id, seq, data)`` to containers; an incomplete last one is an error row.

    The order within a stream matters, so a stream's rows go to one task in order of
    ``seq``; Spark's sort spills, and the task keeps the residue of one stream and at most
    ``HELD`` bytes of rows, however long the stream is.
    """
    kind = chunks.schema["stream_id"].dataType.simpleString()
    names = ["stream_id", "seq", "length", "typ", "code", "tx_id", "body", "error"]

    def run(batches):
        framer = key = None
        out, held = [], 0

        def rows(id_type):
            types = [id_type, pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array([r[n] for r in out], t) for n, t in zip(names, types)], names=names)

        def rest():
            return [framer._row(None, None, None, None, bytes(framer.residue), "truncated container")] if framer and any(framer.residue) else []

        id_type = None
        for batch in batches:
            id_type = batch.column(0).type
            for now, chunk in zip(batch.column(0), batch.column(1)):
                now = now.as_py()
                new = []
                if framer is None or now != key:
                    new += [r | {"stream_id": key} for r in rest()]
                    framer, key = Framer(), now
                new += [r | {"stream_id": key} for r in framer.feed(chunk.as_py() or b"")]
                out += new
                held += sum(len(r["body"] or b"") + 64 for r in new)
                if held > HELD:
                    yield rows(id_type)
                    out, held = [], 0
        out += [r | {"stream_id": key} for r in rest()]
        if out:
            yield rows(id_type)

    dealt = chunks.select("stream_id", "seq", "data").repartition("stream_id").sortWithinPartitions("stream_id", F.col("seq").asc_nulls_last())
    return dealt.select("stream_id", "data").mapInArrow(run, f"stream_id {kind}, {CONTAINER}")


#: What may be wrong with a transaction, the first of several.
WRONG = ("a container of a later transaction", "too many late replies", "two data phases", "no response")


def outcome(stale: int, future: int, data_phases: int, response: int | None) -> str | None:
    """What is wrong with a transaction, by its counts and its answer; the first of several."""
    return next((text for text, is_so in zip(WRONG, (future > 0, stale > MOST_STALE, data_phases > 1, response is None)) if is_so), None)


def outcomes(stale: np.ndarray, future: np.ndarray, data_phases: np.ndarray, answered: np.ndarray) -> pa.Array:
    """:func:`outcome` of many transactions."""
    kind = np.select([future > 0, stale > MOST_STALE, data_phases > 1, ~answered], [0, 1, 2, 3], -1)
    return pa.array(WRONG, pa.string()).take(pa.array(kind, mask=kind < 0))


def transactions(found: DataFrame) -> DataFrame:
    """One row per (stream, transaction): its command, data and response phases.

    A container whose id is below that of the command before it is a late reply: it does
    not count, and more than ``MOST_STALE`` of them before the answer, or an id from the
    future, make the transaction an error.
    """
    order = Window.partitionBy("stream_id").orderBy("seq")
    now = F.last(F.when(F.col("typ") == COMMAND, F.col("tx_id")), ignorenulls=True).over(order)
    rows = found.where("error IS NULL").withColumn("now", now)
    mine, stale, future = F.col("tx_id") == F.col("now"), F.col("tx_id") < F.col("now"), F.col("tx_id") > F.col("now")
    of = lambda typ, col: F.min_by(col, F.when(mine & (F.col("typ") == typ), F.col("seq")))
    out = rows.where("now IS NOT NULL AND typ <> 4").groupBy("stream_id", F.col("now").alias("tx_id")).agg(
        of(COMMAND, "code").alias("op"), of(COMMAND, "body").alias("params"), of(DATA, "body").alias("data"), of(RESPONSE, "code").alias("response"), of(RESPONSE, "body").alias("response_params"),
        F.count_if(stale).alias("stale"), F.count_if(future).alias("future"), F.count_if(mine & (F.col("typ") == DATA)).alias("data_phases"))
    error = F.when(F.col("future") > 0, "a container of a later transaction").when(F.col("stale") > MOST_STALE, "too many late replies").when(F.col("data_phases") > 1, "two data phases").when(F.col("response").isNull(), "no response")
    return out.withColumn("error", error)

"""Streams of any length are framed batch by batch."""

import pytest
from pyspark.sql import functions as F

from tessera.sources import framing


def container(tx, body=b""):
    return (12 + len(body)).to_bytes(4, "little") + (2).to_bytes(2, "little") + (7).to_bytes(2, "little") + tx.to_bytes(4, "little") + body


@pytest.mark.parametrize("held", [0, 1 << 20])
def test_a_stream_is_not_one_group(spark, held, monkeypatch):
    monkeypatch.setattr(framing, "HELD", held)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        chunks = []
        for stream in (None, 1, 2, 3):
            data = b"".join(container(k, bytes([k] * k)) for k in range(1, 60)) + container(99, b"torn")[: -2 if stream == 2 else None]
            chunks += [(stream, at // 5, bytearray(data[at : at + 5])) for at in range(0, len(data), 5)]
        df = spark.createDataFrame(chunks, "stream_id int, seq int, data binary").orderBy(F.rand(1))
        found = framing.containers(df)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "FlatMapGroups" not in plan and "Sort" in plan  # no group is held whole
        rows = sorted(found.collect(), key=lambda r: (r.stream_id or 0, r.seq))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for n, stream in enumerate((None, 1, 2, 3)):
        mine = rows[60 * n : 60 * n + 60]
        assert [(r.stream_id, r.seq) for r in mine] == [(stream, k) for k in range(60)]
        assert [bytes(r.body) for r in mine[:59]] == [bytes([k] * k) for k in range(1, 60)]
        assert (mine[59].error is None) == (stream != 2)

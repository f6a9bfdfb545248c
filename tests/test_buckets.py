"""Streams share the state of their bucket: its rows do not grow with the number of streams."""

import pytest

from tessera.streaming import events as S
from tessera.streaming import stateful

N = 3000


def container(k):
    return (16).to_bytes(4, "little") + (2).to_bytes(2, "little") + (7).to_bytes(2, "little") + k.to_bytes(4, "little") * 2


FEEDS = {
    "frame_stream": ("stream_id string, seq long, data binary", lambda k: [(f"s{k}", 1, bytearray(container(k)[9:])), (f"s{k}", 0, bytearray(container(k)[:9]))], S.frame_stream),
    "changes": ("stream_id string, seq long, v string", lambda k: [(f"s{k}", 1, "x"), (f"s{k}", 0, "x")], lambda d: S.changes(d, "v")),
}


@pytest.mark.parametrize("name", sorted(FEEDS))
def test_state_rows_are_those_of_buckets(spark, tmp_path, name):
    schema, rows, build = FEEDS[name]
    folder = str(tmp_path / "in")
    spark.createDataFrame([r for k in range(N) for r in rows(k)], schema).coalesce(1).write.parquet(folder)
    source = spark.readStream.schema(schema).parquet(folder)
    q = build(source).writeStream.format("memory").queryName(f"buckets_{name}").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]) <= 2 * stateful.BUCKETS
    got = spark.table(f"buckets_{name}").collect()
    assert sorted(r["stream_id"] for r in got) == sorted(f"s{k}" for k in range(N)) and {r["seq"] for r in got} == {0}

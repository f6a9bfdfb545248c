"""Steps whose cost or range once grew faster than their input."""

import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.util import PythonEvalType

from tessera.codecs import lossless_jpeg as L
from tessera.functions import wire as W
from tessera.plans import more_queries, view_queries
from tessera.sources import event_spool, table_functions
from tessera.sources.framing import Framer


def test_code_width_of_products_beyond_63_bits(spark, tmp_path):
    rows = [(9_000_000, 1_200_000, k, 2) for k in (0, 1, 19)] + [(1 << 60, 1 << 60, 3, 1), (1, 5, 3, 3), (1, 2, 3, 3), (None, 1, 3, 1), (-4, 7, 3, 1)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int").write.parquet(str(tmp_path / "lineitem.parquet"))
    want: dict[int, int] = {}
    for o, p, c, n in rows:
        total = None if o is None else o * p * (1 + n % 3 * 1048576)
        width = 0 if total is None or c <= 0 or c >= total else sum((c << k) < total for k in range(15))
        want[width] = want.get(width, 0) + 1
    assert {r["width"]: r["n"] for r in more_queries.code_width_wide(spark, str(tmp_path)).collect()} == want


def test_small_tiles_share_a_code_table_and_need_no_arrays(monkeypatch):
    rnd = random.Random(5)
    L.code_table.cache_clear()
    for k in range(60):
        px = np.array([rnd.choice([0, 1, 8191, 16383, rnd.randrange(1 << 14)]) for _ in range(2 * rnd.randrange(1, 12))]).reshape(-1, 1, 2 if k % 2 else 1)[: 1 + k % 3]
        scan = L.Scan(L.encode(px, 14))
        assert (L.decode(scan) == px).all() and (L.decode(scan, general=True) == px).all()
        with monkeypatch.context() as m:
            m.setattr(L, "FEW", 0)
            assert (L.decode(scan) == px).all()
        if len(scan.data) > 3:  # both ways refuse what ends early
            scan.data = scan.data[:1]
            for few in (0, 64):
                monkeypatch.setattr(L, "FEW", few)
                with pytest.raises(L.Malformed):
                    L.decode(scan)
    assert L.code_table.cache_info().misses == 1


def test_code_list_takes_its_bytes_once(spark):
    df = spark.createDataFrame([(k, [c % 65536 for c in range(k * 7919, k * 7919 + k)]) for k in range(40)] + [(99, None)], "k int, codes array<int>")
    out = df.select("codes", W.code_list(W.put_code_list(F.col("codes"))).alias("back"))
    assert out._jdf.queryExecution().executedPlan().toString().count("array_join") == 1
    assert all(r["codes"] == r["back"] for r in out.collect() if r["codes"] is not None)
    short = spark.createDataFrame([(bytearray(b"\2\0\0\0\1\0\2"),), (bytearray(b"\1\0"),), (None,)], "raw binary")
    assert [r[0] for r in short.select(W.code_list(F.col("raw"))).collect()] == [None, None, None]


def test_table_functions_make_no_table_for_a_blob(spark):
    from pyspark.sql.types import StructType

    made = table_functions.table_function("tiff", StructType.fromDDL("tag int"))
    assert made.evalType == PythonEvalType.SQL_TABLE_UDF
    assert "RoundRobin" in view_queries.tiff_entries_by_sql(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()


def test_spool_files_are_bounded(tmp_path, monkeypatch):
    rows = [Row(stream_id="s", seq=2 * k, code=7, tx_id=k, params=[k]) for k in range(1000)]
    monkeypatch.setattr(event_spool, "FILE_BYTES", 1600)
    writer = event_spool.SpoolWriter(str(tmp_path), False)
    parts = list(writer.files(iter(rows)))
    assert len(parts) == 10 and all(len(data) == 1600 for _, data in parts) and parts[1][0] == "s/000000000100.bin"
    writer.commit([writer.write(iter(rows))])
    reader = event_spool.SpoolReader(str(tmp_path), 1 << 20)
    got = [r for p in reader.partitions() for r in reader.read(p)]
    assert [r[1] for r in got] == list(range(1000)) and [r[3] for r in got] == list(range(1000))


def test_containers_are_read_one_by_one():
    data = b"".join((16).to_bytes(4, "little") + (4).to_bytes(2, "little") + bytes(2) + k.to_bytes(4, "little") * 2 for k in range(50_000))
    tracemalloc.start()
    assert sum(1 for _ in Framer().each(data)) == 50_000
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4 * len(data)

"""Composed views of snapshots and devices, encoders, malformed bytes."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import cursor
from tessera.functions import wire as W
from tessera.operators import catalogue as C
from tessera.operators import devices as V
from tessera.operators import snapshot as P
from tessera.operators import statistics as S
from tessera.sources import bundles, records


def test_strings_with_half_pairs(spark):
    texts = ["", "a", "naïve 漢字", "\U0001f600 x", "a\0", "\0", "a\0b", "x" * 254]
    blobs = [cursor.put_text(t) for t in texts]
    units = [b"\x00\xd8", b"\x00\xdc", b"\x41\x00", b"\x3d\xd8\x00\xde", b"\x00\x00"]
    for a in units:
        for b in units:
            for c in units:
                raw = a + b + c
                blobs.append(bytes([len(raw) // 2]) + raw)
    blobs += [b"", b"\x05a\0", b"\x02\x00\xd8\x00"]
    want = []
    for b in blobs:
        try:
            want.append(cursor.Cursor(b).text())
        except cursor.Short:
            want.append(None)
    df = spark.createDataFrame([(k, bytearray(b)) for k, b in enumerate(blobs)], "k int, b binary")
    assert [r[0] for r in df.orderBy("k").select(W.get_string(F.col("b"))).collect()] == want


def test_datagrams_of_any_bytes(spark):
    good = b"add@/devices/x\0SUBSYSTEM=usb\0DEVTYPE=usb_device\0PRODUCT=4cb/2b6/100\0BUSNUM=001\0DEVNUM=012\0NAME=\xff\xfe\0"
    df = spark.createDataFrame([(1, bytearray(good)), (2, bytearray(b"\xff\xc0")), (3, None)], "id int, raw binary")
    assert [(r["id"], r["vendor_id"], r["product_id"], r["location"]) for r in records.datagram(df, "raw").collect()] == [(1, 0x4CB, 0x2B6, (1 << 16) + 12)]


def test_missing_downloads_stay(spark):
    objects = spark.createDataFrame([(1, 10), (2, 3)], "handle int, size int")
    contents = spark.createDataFrame([(1, bytearray(10))], "handle int, content binary")
    assert {r["handle"]: r["complete"] for r in bundles.downloads(objects, contents).collect()} == {1: True, 2: False}


DESCRIPTORS = "device int, code int, ordinal int, getset int, current struct<num:bigint>, choices array<bigint>"


def test_settable_exposure(spark):
    rows = [(1, 0x500D, 0, 1, (1500,), [1500, 3000]), (1, 0x5007, 1, 1, (280,), [280]), (1, 0x500F, 2, 0, (400,), [200, 400]), (1, 0x500D, 9, 0, (7,), None), (2, 0x500F, 0, 1, (800,), None), (2, 0x5001, 1, 1, (50,), [1, 2])]
    got = P.settable_exposure(spark.createDataFrame(rows, DESCRIPTORS), ["device"], 0x500D, 0x5007, 0x500F).orderBy("device").collect()
    assert [tuple(r) for r in got] == [(1, 0.0015, True, 2.8, False, 400, False), (2, None, None, None, None, 800, False)]


def test_metadata(spark):
    rows = [(1, 10, 0, (None, "Ann")), (1, 10, 1, (None, "Bob")), (1, 11, 2, (None, "")), (1, 20, 3, (2, None)), (2, 20, 0, (1, None)), (3, 99, 0, (2, None))]
    df = spark.createDataFrame(rows, "device int, code int, ordinal int, current struct<num:bigint,str:string>")
    got = P.metadata(df, ["device"], {"photographer": 10, "copyright": 11}, 20, 2).orderBy("device").collect()
    assert [tuple(r) for r in got] == [(1, "Ann", "", True, True), (2, None, None, False, True), (3, None, None, False, False)]


def test_known_and_models(spark):
    captured = spark.createDataFrame([(5, 1, "first"), (5, 2, "second")], "code int, ordinal int, label string")
    got = P.known(spark.createDataFrame([(5,), (6,)], "prop int"), "prop", captured, ["label"])
    assert sorted(map(tuple, got.collect())) == [(5, "first", True), (6, None, False)]
    vendors = spark.createDataFrame([(0x54C, "Sony"), (0x4CB, "Fuji")], "usb_id int, vendor string")
    models = spark.createDataFrame([(0x54C, 0xD10, "A7")], "usb_id int, product_id int, model string")
    devices = spark.createDataFrame([(0x54C, 0xD10), (0x54C, 0xE), (1, 2)], "vendor_id int, product_id int")
    rows = V.with_models(devices, vendors, models).select("vendor_id", "vendor", "model", "is_known").collect()
    assert sorted(map(tuple, rows), key=str) == [(1, None, None, False), (0x54C, "Sony", "A7", True), (0x54C, "Sony", "Sony device 0x000E", True)]


def plain_sweep(kinds, most):
    fails, out = 0, {"described": 0, "declined": 0, "failed": 0}
    for k in kinds:
        out[{"ok": "described", "no": "declined"}.get(k, "failed")] += 1
        fails = 0 if k == "ok" else fails + (k == "failed")
        if k == "gone" or fails >= most:
            return (*out.values(), True)
    return (*out.values(), False)


def test_sweeps_that_give_up(spark):
    import random

    rnd = random.Random(2)
    sweeps = {d: [rnd.choice(["ok", "no", "failed", "failed", "failed"] + ["gone"] * (d % 5 == 0)) for _ in range(25)] for d in range(40)}
    df = spark.createDataFrame([(d, k, kind) for d, kinds in sweeps.items() for k, kind in enumerate(kinds)], "device int, seq int, kind string")
    of = lambda k: F.col("kind") == k
    got = S.sweep_until(df, ["device"], ["seq"], of("ok"), of("no"), of("gone"), 4)
    assert {r["device"]: tuple(r)[1:] for r in got.collect()} == {d: plain_sweep(k, 4) for d, k in sweeps.items()}


def test_counts_and_lookup(spark):
    df = spark.createDataFrame([(1, 1, 0x3801, 0), (2, 1, 0x3001, 0), (3, 2, 0x3801, 2)], "handle int, storage_id int, format int, parent int")
    assert [tuple(r) for r in C.count_objects(df, ["storage_id"], fmt=0x3001).orderBy("storage_id").collect()] == [(1, 1), (2, 0)]
    assert C.count_objects(df).first()[0] == 3 and C.count_objects(df.limit(0)).first()[0] == 0
    assert [r["handle"] for r in C.select_objects(df, handle=3).collect()] == [3]
    assert C.select_objects(df, handle=7).collect() == []


def test_object_info_and_code_lists(spark):
    raw = W.put_object_info({"storage_id": F.lit(0x10001), "format": F.lit(0x3801), "size": F.lit(2**32 - 1), "parent": F.lit(7), "file_name": F.lit("DSC 漢.JPG"), "keywords": F.lit("a")})
    df = spark.range(1).select("id", raw.alias("raw"))
    row = records.decode(df, "raw", "object_info", ["id"]).first()
    assert (row["storage_id"], row["format"], row["size"], row["parent"], row["file_name"], row["captured"], row["keywords"], row["error"]) == (0x10001, 0x3801, 2**32 - 1, 7, "DSC 漢.JPG", "", "a", None)
    with pytest.raises(ValueError, match="colour"):
        W.put_object_info({"colour": F.lit(1)})
    lists = spark.createDataFrame([([0xDC01, 0xDC07, 5],), ([],)], "codes array<int>").select("codes", W.put_code_list(F.col("codes")).alias("raw"))
    got = lists.select("codes", W.code_list(F.col("raw")).alias("back"), W.code_list(F.substring("raw", 1, 5)).alias("cut")).collect()
    assert all(r["back"] == r["codes"] for r in got) and [r["cut"] for r in got] == [None, []]


def test_decoders_of_the_callers_own(spark):
    def lengths(data):
        yield {"n": len(data)}
        if data[:1] == b"x":
            raise cursor.Short("x is no start")

    records.register_kernel("lengths", lengths, "n int")
    try:
        df = spark.createDataFrame([(1, bytearray(b"abc")), (2, bytearray(b"xy"))], "id int, raw binary")
        got = records.decode(df, "raw", "lengths", ["id"]).orderBy("id", "ordinal").collect()
        assert [tuple(r) for r in got] == [(1, 0, 3, None), (2, 0, 2, None), (2, 1, None, "x is no start")]
        with pytest.raises(ValueError, match="lengths"):
            records.register_kernel("lengths", lengths, "n int")
    finally:
        del records.KERNELS["lengths"]

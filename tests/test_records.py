"""Record decoders on hand-made bytes: values, partial rows, malformed input."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import cursor as C
from tessera.operators import catalogue, snapshot
from tessera.sources import framing, records

u = lambda v, n: (v % (1 << 8 * n)).to_bytes(n, "little")


def decode(spark, blob, kernel):
    df = spark.createDataFrame([(1, bytearray(blob) if blob is not None else None)], "id int, blob binary")
    return records.decode(df, "blob", kernel, ["id"]).orderBy("ordinal").collect()


def entry(code, kind, getset, enabled, initial, current, form=b"\0"):
    return u(code, 2) + u(kind, 2) + bytes([getset, enabled]) + C.put_value(kind, initial) + C.put_value(kind, current) + form


def enum(kind, *lists):
    return b"\x02" + b"".join(u(len(x), 2) + b"".join(C.put_value(kind, v) for v in x) for x in lists)


def blob(*entries, n=None):
    return u(len(entries) if n is None else n, 4) + u(0, 4) + b"".join(entries)


def test_snapshot_entries(spark):
    got = decode(spark, blob(
        entry(0x5007, 4, 1, 1, 400, 560, enum(4, [280, 400, 560])),
        entry(0x5010, 3, 1, 1, 0, -1000, b"\x01" + u(-3000, 2) + u(3000, 2) + u(333, 2)),
        entry(0xD21E, 6, 1, 1, 100, 3200, enum(6, [100, 200], [100, 3200, 6400])),
        entry(0xD20C, 2, 1, 1, 1, 2, enum(2, [1, 2])),
        entry(0xD20D, 0x4004, 0x81, 0, [280, 400], [560]),
        entry(0xD2C1, 0xFFFF, 0, 2, "a", "é"),
    ), "snapshot")
    by = {r.code: r for r in got}
    assert len(by) == 6 and not any(r.error for r in got)
    assert (by[0x5007].current.num, by[0x5007].choices) == (560, [280, 400, 560])
    assert (by[0x5010].current.num, by[0x5010].low, by[0x5010].high, by[0x5010].step) == (-1000, -3000, 3000, 333)
    assert by[0xD21E].choices == [100, 3200, 6400]  # the second list replaces the first
    assert by[0xD20C].choices == [1, 2]  # what follows is a property, not a list
    assert (by[0xD20D].initial.arr, by[0xD20D].current.arr) == ([280, 400], [560])
    assert by[0xD2C1].current.str == "é"  # the string code has the array bit as well


@pytest.mark.parametrize("data, rows", [(b"", 0), (u(0xFFFF, 4), 0), (blob(n=0xFFFF), 0), (blob(entry(1, 4, 1, 1, 1, 1), n=5), 1), (blob(entry(1, 4, 1, 1, 1, 1))[:-2], 0), (blob(entry(1, 4, 1, 1, 1, 1, b"\x02" + u(0xFFF0, 2))), 0)])
def test_malformed_snapshots_keep_the_rows_before(spark, data, rows):
    got = decode(spark, data, "snapshot")
    assert len(got) == rows + 1 and got[-1].error and got[-1].code is None


def test_null_blob_gives_no_row(spark):
    assert decode(spark, None, "snapshot") == []


def test_unsigned_64_bits_keep_their_pattern(spark):
    assert decode(spark, blob(entry(1, 8, 1, 1, 2**64 - 1, 5)), "snapshot")[0].initial.num == -1


def test_128_bit_types_are_refused(spark):
    assert "0x000A" in decode(spark, blob(u(1, 2) + u(10, 2) + b"\1\1" + bytes(32)), "snapshot")[0].error


def prop_row(handle, prop, kind, v):
    return u(handle, 4) + u(prop, 2) + u(kind, 2) + C.put_value(kind, v)


def test_catalogue(spark):
    rows = [prop_row(0xC0005, 0xDC07, 0xFFFF, "_DSC0449.JPG"), prop_row(0xC0005, 0xDC04, 6, 1), prop_row(0xC0005, 0xDC04, 6, 3080192), prop_row(0xC0009, 0xDC87, 6, 4912), prop_row(0xC0009, 0xDC88, 6, 3264)]
    df = spark.createDataFrame([(1, bytearray(u(len(rows), 4) + b"".join(rows)))], "id int, blob binary")
    eav = records.decode(df, "blob", "prop_list", ["id"])
    wide = {r.handle: r for r in catalogue.pivot(eav, {"size": 0xDC04, "width": 0xDC87}, value="value.num").collect()}
    assert (wide[0xC0005].size, wide[0xC0005].width, wide[0xC0009].width) == (3080192, None, 4912)
    maps = {r.handle: r.properties for r in catalogue.by_handle(eav).collect()}
    assert maps[0xC0005][0xDC04].num == 3080192 and len(maps[0xC0005]) == 2
    assert decode(spark, u(9, 4) + rows[0], "prop_list")[-1].error


def test_object_info(spark):
    data = u(1, 4) + u(0x3801, 2) + u(0, 2) + u(3080192, 4) + u(0, 2) + bytes(12) + u(4912, 4) + u(3264, 4) + u(24, 4) + bytes(14) + b"".join(map(C.put_text, ("_DSC0449.JPG", "20200831T142530", "", "")))
    got = decode(spark, data, "object_info")[0]
    assert (got.file_name, got.size, got.width, got.height, got.depth, got.captured) == ("_DSC0449.JPG", 3080192, 4912, 3264, 24, "20200831T142530")
    assert decode(spark, data[:60], "object_info")[0].error


def test_string_range_descriptor(spark):
    data = u(0xD1, 2) + u(0xFFFF, 2) + b"\1" + C.put_text("0") + C.put_text("1") + b"\1" + b"".join(map(C.put_text, ("-6,-4,1", "6,4,6", "1,1,1")))
    got = decode(spark, data, "descriptor")[0]
    assert (got.low_str, got.high_str, got.step_str, got.current.str) == ("-6,-4,1", "6,4,6", "1,1,1", "1")


def test_array_valued_descriptor_is_read_as_array(spark):
    data = u(0xD1, 2) + u(0x4004, 2) + b"\1" + C.put_value(0x4004, [1, 2]) + C.put_value(0x4004, [3])
    got = decode(spark, data, "descriptor")[0]
    assert (got.initial.arr, got.current.arr, got.form) == ([1, 2], [3], None)


def test_other_records(spark):
    arr = lambda *v: u(len(v), 4) + b"".join(u(x, 2) for x in v)
    got = decode(spark, u(100, 2) + u(6, 4) + u(1, 2) + C.put_text("x") + u(0, 2) + arr(0x1001) + arr() + arr(1, 2) + arr() + arr(0x3801) + b"".join(map(C.put_text, "abcd")), "device_info")[0]
    assert (got.operations, got.properties, got.serial) == ([0x1001], [1, 2], "d")
    assert decode(spark, u(300, 2) + arr(1) + arr(2, 3), "ext_info")[0].protocol_mode == 3
    lic = decode(spark, b"\2" + u(0xFFFFFFFF, 4) + b"\2ab" + u(5, 4) + b"\1c", "licenses")
    assert [(r.hours, r.license) for r in lic] == [(None, "ab"), (5, "c")]
    st = decode(spark, u(4, 2) + u(2, 2) + u(0, 2) + u(2**64 - 1, 8) + u(7, 8) + u(1, 4) + C.put_text("SD") + C.put_text(""), "storage_info")[0]
    assert (st.capacity, st.free_bytes, st.description) == (None, 7, "SD")
    ev = decode(spark, u(99, 4) + u(4, 2) + u(0x4002, 2) + u(1, 4) + u(77, 4), "event")[0]
    assert (ev.code, ev.params) == (0x4002, [77])
    assert decode(spark, u(16, 4) + u(3, 2) + bytes(10), "event")[0].error
    assert len(decode(spark, bytes(4096), "histogram")) == 1024 and decode(spark, bytes(4095), "histogram")[0].error
    assert decode(spark, b"x\xff\xd8ab\xff\xd9cd\xff\xd9zz", "jpeg")[0].image == b"\xff\xd8ab\xff\xd9cd\xff\xd9"
    assert decode(spark, b"x\xff\xd8ab", "jpeg")[0].image == b"\xff\xd8ab"


def test_hotplug_datagrams(spark):
    gram = lambda action, kind, product: bytearray(f"{action}@/devices/x\0ACTION={action}\0SUBSYSTEM=usb\0DEVTYPE={kind}\0PRODUCT={product}\0".encode())
    df = spark.createDataFrame([(gram("add", "usb_device", "4cb/2d8/100"),), (gram("remove", "usb_device", "54c/1/1"),), (gram("add", "usb_interface", "4cb/1/1"),), (gram("change", "usb_device", "4cb/1/1"),)], "d binary")
    got = sorted((r.action, r.vendor_id, r.product_id) for r in records.datagram(df, "d").collect())
    assert got == [("add", 0x4CB, 0x2D8), ("remove", 0x54C, 1)]


def test_hotplug_datagram_fields(spark):
    gram = lambda head, *fields: bytearray("\0".join((head, *fields)).encode())
    usb = ("SUBSYSTEM=usb", "DEVTYPE=usb_device")
    many = [f"K{k}=v" for k in range(3000)]
    rows = [
        gram("add@/a", *many, *usb, "PRODUCT=54c/1/2", "BUSNUM=003", "DEVNUM=65537"),
        gram("remove@/a", "ACTION=add", *usb, "PRODUCT=1/2"),
        gram("add@/a", "DEVTYPE=usb_device", "PRODUCT=1/2"),
        gram("add@/a", *usb, "PRODUCT=12345/zz", "DEVNUM=x", "SUBSYSTEM=usb"),
        gram("add@/a", *usb, "PRODUCT=7/8", "PRODUCT=9/a", "DEVTYPE=usb_device=x"),
        gram("add@/a", *usb, "PRODUCT=7/8", "PRODUCT=9/a", "NOTE=a=b", "noequals"),
    ]
    got = [(r.action, r.vendor_id, r.product_id, r.location) for r in records.datagram(spark.createDataFrame([(r,) for r in rows], "d binary").coalesce(1), "d").collect()]
    assert got == [("add", 0x54C, 1, 3 << 16 | 1), ("remove", 1, 2, 0), ("add", 0, 0, 0), ("add", 9, 10, 0)]
    assert records.datagram(spark.createDataFrame([(r,) for r in rows], "d binary"), "d", [9]).count() == 1


def test_byte_range_is_64_bit(spark):
    from tessera.operators.catalogue import byte_range

    ask = [(0, 3), (4, 100), (6, 1), (2**33, 5), (1, 2**40), (0, 0)]
    df = spark.createDataFrame([(bytearray(b"abcdef"), o, n) for o, n in ask], "c binary, o long, n long").coalesce(1)
    assert [bytes(r[0]) for r in df.select(byte_range(F.col("c"), F.col("o"), F.col("n"))).collect()] == [b"abcdef"[o : o + n] for o, n in ask]


def container(typ, code, tx, body=b""):
    return u(12 + len(body), 4) + u(typ, 2) + u(code, 2) + u(tx, 4) + body


def test_framing_residue_padding_and_truncation(spark):
    stream = container(2, 0x1008, 1, b"first") + container(3, 0x2001, 1) + container(2, 0x1008, 2, b"second") + container(3, 0x2001, 2)
    chunks = [(1, 0, bytearray(stream[:30])), (1, 1, bytearray(stream[30:31])), (1, 2, bytearray(stream[31:])), (2, 0, bytearray(container(3, 0x2001, 9) + bytes(7))), (3, 0, bytearray(container(2, 1, 1, b"abc")[:-1])), (4, 0, bytearray(u(1 << 30, 4) + u(2, 2) + bytes(6)))]
    got = framing.containers(spark.createDataFrame(chunks, "stream_id int, seq int, data binary")).collect()
    assert [bytes(r.body) for r in sorted((r for r in got if r.stream_id == 1), key=lambda r: r.seq)] == [b"first", b"", b"second", b""]
    assert [r.error for r in got if r.stream_id == 2] == [None]
    assert "truncated" in next(r.error for r in got if r.stream_id == 3)
    assert "length" in next(r.error for r in got if r.stream_id == 4)


def test_transactions(spark):
    def stream(k, *parts):
        return (k, 0, bytearray(b"".join(parts)))

    good = stream(1, container(1, 0x1001, 5), container(3, 0x2019, 4), container(2, 0x1001, 5, b"data"), container(3, 0x2001, 5))
    late = stream(2, container(1, 1, 50), *(container(3, 0x2001, k) for k in range(9)), container(3, 0x2001, 50))
    future = stream(3, container(1, 1, 1), container(3, 0x2001, 2))
    twice = stream(4, container(1, 1, 1), container(2, 1, 1), container(2, 1, 1), container(3, 0x2001, 1))
    got = {r.stream_id: r for r in framing.transactions(framing.containers(spark.createDataFrame([good, late, future, twice], "stream_id int, seq int, data binary"))).collect()}
    assert (bytes(got[1].data), got[1].response, got[1].stale, got[1].error) == (b"data", 0x2001, 1, None)
    assert "late" in got[2].error and "later" in got[3].error and "two data" in got[4].error


def test_snapshot_predicates(spark):
    one = lambda c: spark.range(1).select(c.alias("v")).first()[0]
    assert one(snapshot.writable(F.lit(0x81), F.lit(0))) and one(snapshot.writable(F.lit(0), F.lit(1))) and not one(snapshot.writable(F.lit(0), F.lit(2)))
    assert tuple(one(snapshot.settable(F.lit(True), F.array(F.lit(1))))) == (False, "controlled by the device")
    assert one(snapshot.valid(F.lit(500), F.lit(1), F.array(F.lit(0)), F.lit(-3000), F.lit(3000)))  # a range across zero
    assert not one(snapshot.supports_all(F.array(F.lit(1), F.lit(2)), [1, 3]))
    none = spark.createDataFrame([(1, None, None, None)], "id int, usable boolean, writing boolean, remaining int")
    assert snapshot.readiness(none, ["id"]).first().ready  # no slot reported


def test_exposure_last_entry_wins(spark):
    rows = [(1, k, c, (4, v, None, None)) for k, (c, v) in enumerate([(0x5007, 400), (0x500D, 0x000103E8), (0x500F, 100), (0x5007, 560)])]
    df = spark.createDataFrame(rows, f"id int, ordinal int, code int, current {C.VALUE}")
    got = snapshot.exposure(df, ["id"], 0x5007, 0x500D, 0x500F).first()
    assert (got.f_number, got.seconds, got.iso.iso, got.bulb) == (5.6, 0.001, 100, False)


def test_one_device(spark):
    from tessera.operators.statistics import one_device

    df = spark.createDataFrame([("a", 1), ("b", 2)], "serial string, n int")
    assert one_device(df, "b").first().n == 2
    for s in (None, "zz"):
        with pytest.raises(Exception, match="devices found"):
            one_device(df, s).collect()


def test_scans_merge_and_all_failing_is_an_error(spark):
    good = spark.createDataFrame([(1, 5, None)], "handle int, a int, error string")
    bad = spark.createDataFrame([(None, "refused")], "handle int, error string")
    assert sorted(str(r.error) for r in catalogue.merge_scans([good, bad]).collect()) == ["None", "refused"]
    assert "every scan failed" in catalogue.merge_scans([bad, bad]).first().error


def test_tiff_loops_end(spark):
    data = b"II*\0" + u(8, 4) + u(1, 2) + u(256, 2) + u(3, 2) + u(1, 4) + u(7, 4) + u(8, 4)
    assert [r.tag for r in decode(spark, data, "tiff")] == [256]
    assert decode(spark, b"XX" + data[2:], "tiff")[0].error

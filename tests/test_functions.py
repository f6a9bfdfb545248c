"""Scalar encodings, wire values, naming, time and text."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import dimensions as D
from tessera.functions import encodings as E
from tessera.functions import wire as W
from tessera.functions.cursor import put_text


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()[0]


@pytest.mark.parametrize("f, wire", [(4.0, 400), (9.5, 950), (1.4, 140), (2.8, 280), (22.0, 2200)])
def test_aperture(spark, f, wire):
    assert one(spark, E.aperture_encode(F.lit(f))) == wire
    assert one(spark, E.aperture_encode(F.lit(f), truncate=True)) == wire
    assert one(spark, E.aperture_decode(F.lit(wire))) == f


def test_aperture_sentinels_are_null(spark):
    assert one(spark, E.aperture_decode(F.lit(0xFFFE))) is None


@pytest.mark.parametrize("s, wire", [(1.5, 0x000F000A), (0.001, 0x000103E8), (0.5, 0x00010002), (0.0, 0), (0.7, 0x0007000A), (9999.0, 0xFFFF000A)])
def test_shutter_encode(spark, s, wire):
    assert one(spark, E.shutter_encode(F.lit(s))) == wire


@pytest.mark.parametrize("wire, s", [(0x001E000A, 3.0), (0x00010004, 0.25), (0, None), (0xFFFFFFFF, None), (0x00010000, None)])
def test_shutter_decode(spark, wire, s):
    assert one(spark, E.shutter_decode(F.lit(wire))) == s


@pytest.mark.parametrize("s, wire", [(1 / 900, 0x000103E8), (3.0, 0x0028000A), (3600.0, 0x0064000A), (1e-6, 0x000103E8)])
def test_nearest_shutter_by_ratio(spark, s, wire):
    ladder = F.array(*(F.lit(v).cast("long") for v in (0x000103E8, 0x00010002, 0x000A000A, 0x0028000A, 0x0064000A)))
    assert one(spark, E.nearest_shutter(ladder, F.lit(s)).cast("long")) == wire


def test_nearest_first_of_equals_and_across_zero(spark):
    assert one(spark, E.nearest_value(F.array(F.lit(1), F.lit(3)), F.lit(2))) == 1
    assert one(spark, E.nearest_value(F.array(F.lit(-2), F.lit(3)), F.lit(-1))) == -2
    assert one(spark, E.nearest_value(F.array().cast("array<int>"), F.lit(7))) == 7


def test_extended_iso_mode_survives(spark):
    got = one(spark, E.iso_decode(E.iso_encode(F.lit(0xFFFFFF), F.lit(0x10))))
    assert (got.iso, got.mode, got.auto) == (0xFFFFFF, 0x10, True)


@pytest.mark.parametrize("ev, rounded, cut", [(0.7, 700, 700), (-1.3, -1300, -1300), (-0.0006, -1, 0)])
def test_exposure_bias(spark, ev, rounded, cut):
    assert one(spark, E.ev_encode(F.lit(ev))) == rounded
    assert one(spark, E.ev_encode(F.lit(ev), truncate=True)) == cut


@pytest.mark.parametrize("value, size", [(0, 1), (255, 1), (65535, 2), (4294967295, 4), (-1, 8), (2**63 - 1, 8)])
def test_wire_integers(spark, value, size):
    data = W.put_uint(F.lit(value), size)
    assert one(spark, data) == (value % (1 << 8 * size)).to_bytes(size, "little")
    assert one(spark, W.get_uint(data, 0, size)) == value


def test_wire_integers_stop_at_the_end(spark):
    assert one(spark, W.get_uint(F.unhex(F.lit("0102")), 1, 2)) is None
    assert one(spark, W.get_int(F.unhex(F.lit("00feff")), 1, 2)) == -2


@pytest.mark.parametrize("s", ["", "a", "DSC0449.JPG", "é한"])
def test_wire_strings(spark, s):
    assert one(spark, W.put_string(F.lit(s))) == put_text(s)
    assert one(spark, W.get_string(F.lit(bytearray(b"\xff" + put_text(s))), 1)) == s


def test_wire_string_too_long_is_refused(spark):
    assert one(spark, W.put_string(F.lit("x" * 255))) is None
    with pytest.raises(ValueError):
        put_text("x" * 255)


def test_names_by_layer_then_hex(spark):
    df = spark.createDataFrame([(0x5007,), (0xD001,), (0xD002,)], "code int")
    first = spark.createDataFrame([(0xD001, "b"), (0xD001, "a")], "code int, name string")
    got = {r.code: r.name for r in D.named(df, "code", [first, D.dimension(spark, "property")], "Prop").collect()}
    assert got == {0x5007: "FNumber", 0xD001: "a", 0xD002: "Prop(0xD002)"}


def test_reverse_names_first_layer_then_lowest_code(spark):
    a = spark.createDataFrame([(5, "Iso"), (3, "ISO")], "code int, name string")
    b = spark.createDataFrame([(1, "iso"), (2, "Zoom")], "code int, name string")
    asked = spark.createDataFrame([("iso",), ("zoom",), ("none",)], "n string")
    assert {r.n: r.code for r in D.codes_of(asked, "n", [a, b]).collect()} == {"iso": 3, "zoom": 2, "none": None}


@pytest.mark.parametrize("table, n", [("response", 33), ("operation", 32), ("event", 18), ("format", 11), ("object_property", 21), ("property", 37)])
def test_dimensions_are_complete(spark, table, n):
    df = D.dimension(spark, table)
    assert df.count() == n == df.select("code").distinct().count()


def test_vendor_twice_is_refused(spark):
    with pytest.raises(ValueError):
        D.vendors(spark, [(1, "a"), (1, "b")])


def test_value_names(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (2, 9)], "prop int, value int")
    layer = spark.createDataFrame([(1, 1, "one")], "prop int, value int, name string")
    got = D.values_named(df, "prop", "value", [layer], F.when(F.col("value") == 2, "two")).select("label").collect()
    assert sorted(r[0] for r in got) == ["9", "one", "two"]


@pytest.mark.parametrize("text, iso", [("20200831T142530", "2020-08-31T14:25:30"), ("20200831T142530Z", "2020-08-31T14:25:30"), ("20200831T142530.5", "2020-08-31T14:25:30.500000"), ("20200831T142530+0200", "2020-08-31T12:25:30"), ("20200831T1425", "2020-08-31T14:25:00"), ("bad", None), ("", None)])
def test_date_times(spark, text, iso):
    got = one(spark, E.date_time(F.lit(text)).cast("timestamp_ntz"))
    assert (got and got.isoformat()) == iso


@pytest.mark.parametrize("text, want", [("0x5007=400", (0x5007, None, 400)), ("ISO=0x10", (None, "ISO", 16)), ("7=x", (7, None, None))])
def test_assignments(spark, text, want):
    assert tuple(one(spark, E.parse_assignment(F.lit(text)))) == want


def test_texts(spark):
    assert one(spark, E.first_names(F.array(*map(F.lit, "abcd")), 2)) == "a, b (2 more)"
    assert one(spark, E.hex_list(F.array(F.lit(1), F.lit(0x9209)))) == "0x0001 0x9209"
    assert one(spark, E.printable_runs(F.lit(bytearray(b"\x00abcd\x01xy\xffEFGHI")))) == ["abcd", "EFGHI"]


def test_codec_terms(spark):
    assert [one(spark, E.zigzag_decode(F.lit(k))) for k in range(5)] == [0, -1, 1, -2, 2]
    assert [one(spark, E.quantise(F.lit(d), 18, 67, 276)) for d in (0, -1, 18, 67, -300)] == [0, -1, 2, 3, -4]
    assert one(spark, E.code_width(F.lit(9), F.lit(2))) == 3
    for total, count in ((1 << 29, 1), ((1 << 29) + 1, 1 << 15), (1 << 14, 1), ((1 << 14) + 1, 1), (1 << 40, 3), (5, 0), (5, -1), (0, 3), (3, 3), (2**31 * 7, 7 << 20)):
        want = next((k for k in range(15) if count << k >= total), 15) if 0 < count < total else 0
        assert one(spark, E.code_width(F.lit(total), F.lit(count))) == want, (total, count)
    assert one(spark, E.magnitude_extend(F.lit(2), F.lit(3))) == -5
    assert one(spark, E.tone_curve(F.lit(15), [10, 20, 30, 40])) == 10 + 5 * 2

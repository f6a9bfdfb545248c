"""Names by layers in one join, with models; texts of encoded values."""

from pyspark.sql import functions as F

from tessera.functions import dimensions as D
from tessera.functions import encodings as E


def joins(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Join ")


def test_named_in_one_join(spark):
    first = spark.createDataFrame([(1, "one", None), (2, "two for model 3", 8), (2, "also for 3", 8), (2, "two for model 5", 32), (7, None, None)], "code int, name string, models long")
    second = spark.createDataFrame([(1, "uno"), (2, "dos"), (3, "tres"), (3, "drei")], "code int, name string")
    third = spark.createDataFrame([(4, "vier"), (7, "sieben")], "code int, name string")
    df = spark.createDataFrame([(c, m, "x") for c in (1, 2, 3, 4, 5, 7, None) for m in (3, 5, 0, None)], "code int, model int, key_0 string")
    got = D.named(df, "code", [first, second, third], "Prop", model="model")
    assert joins(got) == 1 and got.columns == ["code", "model", "key_0", "name"]
    two = {3: "also for 3", 5: "two for model 5"}
    want = {1: "one", 3: "drei", 4: "vier", 5: "Prop(0x0005)", 7: "sieben", None: None}
    rows = {(r["code"], r["model"]): r["name"] for r in got.collect()}
    assert len(rows) == 28
    for (code, model), name in rows.items():
        assert name == (two.get(model, "dos") if code == 2 else want[code]) or code is None
    plain = D.named(df.select("code"), "code", [first, second], "Prop").distinct()
    assert {r["code"]: r["name"] for r in plain.collect()}[2] == "dos"
    assert D.named(df.select("code").where("code = 5"), "code", [], "Prop").first()["name"] == "Prop(0x0005)"


def test_values_in_the_order_of_their_kinds(spark):
    curated = spark.createDataFrame([(1, 5, "five"), (2, 7, "seven")], "prop int, value long, name string")
    enums = spark.createDataFrame([(1, 5, "FIVE"), (1, 6, "SIX"), (0xD20D, 100, "never")], "prop int, value long, name string")
    df = spark.createDataFrame([(1, 5), (1, 6), (1, -7), (2, 7), (3, 7), (0xD20D, 100), (0xD20D, 0x000103E8), (0xD20D, 0), (0xD20D, 0xFFFFFFFF), (0x5007, 280), (0x5007, 0xFFFF), (0xD21E, 0xFFFFFF), (0xD21E, 800), (0xD21E, 0x1000320), (0x5010, -1000), (0x5010, 300)], "prop int, value long")
    text = D.exposure_text(F.col("prop"), F.col("value"), 0xD20D, 0x5007, 0xD21E, 0x5010)
    got = D.values_named(df, "prop", "value", [curated], text, enums=[enums])
    assert joins(got) == 2
    rows = {(r["prop"], r["value"]): r["label"] for r in got.collect()}
    assert rows == {
        (1, 5): "five", (1, 6): "SIX", (1, -7): "-7", (2, 7): "seven", (3, 7): "7", (0xD20D, 100): "0s", (0xD20D, 0x000103E8): "1ms", (0xD20D, 0): "Bulb", (0xD20D, 0xFFFFFFFF): "4294967295",
        (0x5007, 280): "f/2.8", (0x5007, 0xFFFF): "65535", (0xD21E, 0xFFFFFF): "AUTO", (0xD21E, 800): "800", (0xD21E, 0x1000320): "800 (mode 1)", (0x5010, -1000): "-1.0 EV", (0x5010, 300): "+0.3 EV",
    }


def test_durations(spark):
    want = {0.0: "0s", 1e-9: "1ns", 1.5e-6: "1.5µs", 0.001: "1ms", 1 / 60: "16.666666ms", 0.5: "500ms", 1.0: "1s", 1.3: "1.3s", 30.0: "30s", 60.0: "1m0s", 90.5: "1m30.5s", 3600.0: "1h0m0s", 3723.25: "1h2m3.25s", 100.0: "1m40s"}
    df = spark.createDataFrame([(k,) for k in want], "s double").select("s", E.duration_text(F.col("s")).alias("t"))
    assert {r["s"]: r["t"] for r in df.collect()} == want

"""Table functions in SQL against the DataFrame form."""

import struct

import pytest

from tessera.sources import records, table_functions
from test_columnar import blobs, prop_list


def tiff(n):
    entries = b"".join(struct.pack("<HHII", 256 + k, 4, 1, k) for k in range(n))
    return b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", n) + entries + bytes(4)


def test_equal_to_the_dataframe_form(spark):
    assert "decode_tiff" in table_functions.register(spark)
    data = [*blobs(prop_list, 5, 60), None]
    df = spark.createDataFrame([(k, None if b is None else bytearray(b)) for k, b in enumerate(data)], "id int, raw binary")
    df.createOrReplaceTempView("prop_blobs")
    want = sorted(map(str, records.decode(df, "raw", "prop_list", ["id"]).collect()))
    got = spark.sql("SELECT b.id, t.* FROM prop_blobs b, LATERAL decode_prop_list(raw) t")
    assert got.columns == ["id", "ordinal", "handle", "prop", "value", "error"]
    assert sorted(map(str, got.collect())) == want


def test_columns_follow_the_asked_fields(spark):
    table_functions.register(spark)
    spark.createDataFrame([(1, bytearray(tiff(3))), (2, bytearray(b"no"))], "id int, raw binary").createOrReplaceTempView("tiffs")
    got = spark.sql("SELECT id, t.* FROM tiffs, LATERAL decode_tiff(raw, 'tag, error') t ORDER BY id, tag")
    assert got.columns == ["id", "tag", "error"]
    assert [tuple(r) for r in got.collect()] == [(1, 256, None), (1, 257, None), (1, 258, None), (2, None, "no TIFF byte order mark")]
    for bad, message in (("decode_tiff(raw, 'nothing')", "no such columns"), ("decode_tiff(id)", "binary column")):
        with pytest.raises(Exception, match=message):
            spark.sql(f"SELECT * FROM tiffs, LATERAL {bad}").collect()

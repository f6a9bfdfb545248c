"""Registered queries of composed views and of the record decoders: columns encoded to bytes, decoded, and compared with the columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dimensions as D
from ..functions import encodings as E
from ..functions import wire as W
from ..operators import catalogue as C
from ..operators import devices as V
from ..operators import snapshot as P
from ..operators import statistics as S
from ..sources import records, table_functions
from .queries import query, t


def _u(v, size):
    return W.put_uint(v if not isinstance(v, int) else F.lit(v), size)


def _cat(*parts):
    return F.concat(*parts)


# --- views ---------------------------------------------------------------------------


@query("""
SELECT user_id, arg_min(event_id % 2000 + 100, event_id) FILTER (event_type = 'click') / 1000000 AS seconds, arg_min(event_id % 2 = 1 AND event_id % 3 > 0, event_id) FILTER (event_type = 'click') AS seconds_settable,
  arg_min(event_id % 2000 + 100, event_id) FILTER (event_type = 'view') / 100 AS f_number, arg_min(event_id % 2 = 1 AND event_id % 3 > 0, event_id) FILTER (event_type = 'view') AS f_number_settable,
  coalesce(arg_min(event_id % 2000 + 100, event_id) FILTER (event_type = 'purchase'), -1) AS iso, arg_min(event_id % 2 = 1 AND event_id % 3 > 0, event_id) FILTER (event_type = 'purchase') AS iso_settable
FROM events WHERE event_type IN ('click', 'view', 'purchase') GROUP BY user_id""")
def settable_exposure_view(spark, sf):
    id_, kind = F.col("event_id"), F.col("event_type")
    code = F.when(kind == "click", 0x500D).when(kind == "view", 0x5007).when(kind == "purchase", 0x500F).otherwise(0)
    rows = t(spark, sf, "events").select("user_id", code.alias("code"), id_.alias("ordinal"), (id_ % 2).alias("getset"), F.struct((id_ % 2000 + 100).alias("num")).alias("current"), F.sequence(F.lit(0), id_ % 3).alias("choices"))
    return P.settable_exposure(rows, ["user_id"], 0x500D, 0x5007, 0x500F).withColumn("iso", F.coalesce("iso", F.lit(-1)))


@query("""
SELECT o_custkey, arg_min(o_orderpriority, o_orderkey) FILTER (o_orderkey % 3 = 0) AS photographer, arg_min(o_orderpriority, o_orderkey) FILTER (o_orderkey % 3 = 1) AS copyright,
  coalesce(arg_min(o_orderstatus = 'O', o_orderkey) FILTER (o_orderkey % 3 = 2), FALSE) AS embedding, count(*) FILTER (o_orderkey % 3 = 2) > 0 AS has_embedding
FROM orders GROUP BY o_custkey""")
def metadata_projection(spark, sf):
    key = F.col("o_orderkey")
    current = F.struct(F.when(F.col("o_orderstatus") == "O", 2).otherwise(1).alias("num"), F.col("o_orderpriority").alias("str"))
    rows = t(spark, sf, "orders").select("o_custkey", (key % 3).alias("code"), key.alias("ordinal"), current.alias("current"))
    return P.metadata(rows, ["o_custkey"], {"photographer": 0, "copyright": 1}, 2, 2)


@query("""
SELECT c_custkey, n_name AS vendor, CASE WHEN n_name IS NOT NULL THEN coalesce(s_name, n_name || ' device 0x' || lpad(upper(hex(c_custkey % 400)), 4, '0')) END AS model, n_name IS NOT NULL AS is_known
FROM (SELECT c_custkey, c_nationkey FROM customer) LEFT JOIN (SELECT * FROM nation WHERE n_regionkey <> 1) ON c_nationkey = n_nationkey
LEFT JOIN (SELECT s_nationkey, s_suppkey % 400 AS p, min(s_name) AS s_name FROM supplier GROUP BY ALL) ON s_nationkey = c_nationkey AND p = c_custkey % 400""")
def device_models(spark, sf):
    devices = t(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").cast("int").alias("vendor_id"), (F.col("c_custkey") % 400).cast("int").alias("product_id"))
    vendors = t(spark, sf, "nation").where("n_regionkey <> 1").select(F.col("n_nationkey").alias("usb_id"), F.col("n_name").alias("vendor"))
    models = t(spark, sf, "supplier").select(F.col("s_nationkey").alias("usb_id"), (F.col("s_suppkey") % 400).alias("product_id"), F.col("s_name").alias("model"))
    return V.with_models(devices, vendors, models).select("c_custkey", "vendor", "model", "is_known")


@query("SELECT l_orderkey, l_linenumber, p_name AS label, p_name IS NOT NULL AS is_known FROM lineitem LEFT JOIN (SELECT p_size, arg_min(p_name, p_partkey) AS p_name FROM part WHERE p_size % 2 = 0 GROUP BY p_size) ON p_size = l_quantity")
def known_properties(spark, sf):
    """Codes of a table looked up in a reference capture that lists some of them several times."""
    captured = t(spark, sf, "part").where("p_size % 2 = 0").select(F.col("p_size").cast("long").alias("code"), F.col("p_partkey").alias("ordinal"), F.col("p_name").alias("label"))
    lines = t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("long").alias("prop"))
    return P.known(lines, "prop", captured, ["label"]).select("l_orderkey", "l_linenumber", "label", "is_known")


@query("""
SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 1 THEN coalesce('curated ' || CASE WHEN l_quantity % 5 = 0 THEN CAST(l_quantity AS BIGINT) END, CASE WHEN l_quantity % 2 = 0 THEN 'enum ' || CAST(l_quantity AS BIGINT) END, CAST(-CAST(l_quantity AS BIGINT) AS VARCHAR))
  WHEN l_linenumber = 2 THEN printf('f/%.1f', CAST(l_quantity AS BIGINT) * 50 / 100.0) WHEN l_linenumber = 3 THEN CAST(CAST(l_quantity AS BIGINT) * 100 AS VARCHAR)
  WHEN l_linenumber = 4 THEN printf('%+.1f EV', (CAST(l_quantity AS BIGINT) - 25) * 500 / 1000.0) WHEN l_linenumber = 5 THEN CAST(l_quantity AS BIGINT) || 's' ELSE CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) END AS label
FROM lineitem""")
def value_labels(spark, sf):
    """Values named by a curated layer, by their encoding, by an enum layer, or as the signed number."""
    q, line = F.col("l_quantity").cast("long"), F.col("l_linenumber")
    prop = F.when(line == 1, 1).when(line == 2, 0x5007).when(line == 3, 0xD21E).when(line == 4, 0x5010).when(line == 5, 0xD20D).otherwise(2)
    value = F.when(line == 1, -q).when(line == 2, q * 50).when(line == 3, q * 100).when(line == 4, (q - 25) * 500).when(line == 5, q * 65536 + 1).otherwise(q)
    rows = t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", prop.alias("prop"), value.alias("value"))
    numbers = spark.range(1, 101).select(F.lit(1).alias("prop"), (-F.col("id")).alias("value"), F.col("id"))
    curated = numbers.where("id % 5 = 0").select("prop", "value", F.format_string("curated %d", "id").alias("name"))
    enums = numbers.where("id % 2 = 0").select("prop", "value", F.format_string("enum %d", "id").alias("name"))
    text = D.exposure_text(F.col("prop"), F.col("value"), 0xD20D, 0x5007, 0xD21E, 0x5010)
    return D.values_named(rows, "prop", "value", [curated], text, enums=[enums]).select("l_orderkey", "l_linenumber", "label")


@query("""
SELECT c_custkey, coalesce(CASE WHEN n_regionkey IN (1, 3) AND c_custkey % 3 = 1 THEN 'model ' || n_name END, CASE WHEN n_regionkey < 4 THEN n_name END, 'Prop(0x' || lpad(upper(hex(c_nationkey)), 4, '0') || ')') AS name
FROM customer JOIN nation ON n_nationkey = c_nationkey""")
def layered_names(spark, sf):
    """Two layers in one join; the first holds for one model in three."""
    nation = t(spark, sf, "nation")
    first = nation.where("n_regionkey IN (1, 3)").select(F.col("n_nationkey").alias("code"), F.concat(F.lit("model "), "n_name").alias("name"), F.lit(2).alias("models"))
    second = nation.where("n_regionkey < 4").select(F.col("n_nationkey").alias("code"), F.col("n_name").alias("name"))
    rows = t(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("code"), (F.col("c_custkey") % 3).alias("model"))
    return D.named(rows, "code", [first, second], "Prop", model="model").select("c_custkey", "name")


@query("""
WITH RECURSIVE e AS (SELECT user_id, event_id, CASE WHEN event_id % 97 = 0 THEN 'gone' WHEN event_type = 'view' THEN 'ok' WHEN event_type = 'click' THEN 'no' ELSE 'failed' END AS kind, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
r AS (SELECT user_id, n, kind, CASE WHEN kind = 'failed' THEN 1 ELSE 0 END AS run FROM e WHERE n = 1
  UNION ALL SELECT e.user_id, e.n, e.kind, CASE e.kind WHEN 'failed' THEN r.run + 1 WHEN 'ok' THEN 0 ELSE r.run END FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1 WHERE r.kind <> 'gone' AND r.run < 5)
SELECT user_id, count(*) FILTER (kind = 'ok') AS described, count(*) FILTER (kind = 'no') AS declined, count(*) FILTER (kind IN ('failed', 'gone')) AS failed, bool_or(kind = 'gone' OR run >= 5) AS aborted FROM r GROUP BY user_id""")
def sweeps_given_up(spark, sf):
    kind, gone = F.col("event_type"), F.col("event_id") % 97 == 0
    return S.sweep_until(t(spark, sf, "events"), ["user_id"], ["event_id"], kind == "view", kind == "click", gone)


@query("SELECT o_custkey, count(*) FILTER (o_orderstatus = 'O' AND o_orderkey % 4 = 1) AS n_objects FROM orders GROUP BY o_custkey")
def object_counts(spark, sf):
    rows = t(spark, sf, "orders").select("o_custkey", F.col("o_orderstatus").alias("format"), (F.col("o_orderkey") % 4).alias("parent"))
    return C.count_objects(rows, ["o_custkey"], fmt="O", parent=1)


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey = (SELECT max(o_orderkey) FROM orders)")
def object_lookup(spark, sf):
    """One object by its handle."""
    orders = t(spark, sf, "orders")
    last = orders.agg(F.max("o_orderkey")).first()[0]
    found = C.select_objects(orders.withColumn("handle", F.col("o_orderkey")), handle=last)
    return found.select("o_orderkey", "o_custkey", "o_orderstatus")


# --- decoders ------------------------------------------------------------------------


@query("SELECT l_orderkey, CAST(count(*) AS INTEGER) AS n, CAST(sum(l_partkey % 65536) AS BIGINT) AS total, min(CAST(l_partkey % 65536 AS INTEGER)) AS least FROM lineitem GROUP BY l_orderkey")
def supported_codes(spark, sf):
    """Each order's parts as a list of 16-bit codes."""
    lists = t(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list((F.col("l_partkey") % 65536).cast("int")).alias("codes"))
    back = lists.select("l_orderkey", W.code_list(W.put_code_list(F.col("codes"))).alias("codes"))
    return back.select("l_orderkey", F.size("codes").alias("n"), F.aggregate("codes", F.lit(0).cast("long"), lambda a, c: a + c).alias("total"), F.array_min("codes").alias("least"))


@query("SELECT p_partkey, p_name AS file_name, CAST(p_size AS BIGINT) AS width, p_partkey * 3 AS size, CASE WHEN p_size % 2 = 0 THEN 12289 ELSE 14337 END AS format FROM part")
def object_infos(spark, sf):
    raw = W.put_object_info({"format": F.when(F.col("p_size") % 2 == 0, 0x3001).otherwise(0x3801), "size": F.col("p_partkey") * 3, "width": F.col("p_size"), "file_name": F.col("p_name")})
    found = records.decode(t(spark, sf, "part").select("p_partkey", raw.alias("raw")), "raw", "object_info", ["p_partkey"])
    return found.select("p_partkey", "file_name", "width", "size", F.col("format").cast("int").alias("format"))


@query("SELECT s_suppkey, CAST(s_suppkey % 5 AS INTEGER) AS storage_type, CASE WHEN s_suppkey % 7 > 0 THEN s_suppkey * 1000000007 ELSE -1 END AS capacity, s_suppkey * 5000011 AS free_bytes, s_name AS label FROM supplier")
def storage_infos(spark, sf):
    key = F.col("s_suppkey")
    raw = _cat(_u(key % 5, 2), _u(2, 2), _u(0, 2), _u(F.when(key % 7 > 0, key * 1000000007).otherwise(-1), 8), _u(key * 5000011, 8), _u(9, 4), W.put_string(F.lit("card")), W.put_string(F.col("s_name")))
    found = records.decode(t(spark, sf, "supplier").select("s_suppkey", raw.alias("raw")), "raw", "storage_info", ["s_suppkey"])
    return found.select("s_suppkey", "storage_type", F.coalesce("capacity", F.lit(-1)).alias("capacity"), "free_bytes", "label")


@query("SELECT c_custkey, c_name AS model, CAST(2 + c_custkey % 3 AS INTEGER) AS n_operations, CAST(c_custkey % 65536 AS BIGINT) AS last_operation, CAST(c_nationkey AS VARCHAR) AS serial FROM customer")
def device_infos(spark, sf):
    key = F.col("c_custkey")
    codes = F.concat(F.array(F.lit(0x1001)), F.array_repeat(F.lit(0x1002), (key % 3).cast("int")), F.array((key % 65536).cast("int")))
    nothing = F.array().cast("array<int>")
    raw = _cat(_u(100, 2), _u(6, 4), _u(100, 2), W.put_string(F.lit("x")), _u(0, 2), W.put_code_list(codes), *(W.put_code_list(nothing) for _ in range(4)), *(W.put_string(s) for s in (F.lit("maker"), F.col("c_name"), F.lit("1.0"), F.col("c_nationkey").cast("string"))))
    found = records.decode(t(spark, sf, "customer").select("c_custkey", raw.alias("raw")), "raw", "device_info", ["c_custkey"])
    return found.select("c_custkey", "model", F.size("operations").alias("n_operations"), F.element_at("operations", -1).alias("last_operation"), "serial")


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 3 ELSE 2 END AS protocol_mode, CAST(p_size AS BIGINT) AS first_property, CAST(1 AS INTEGER) AS n_controls FROM part")
def extension_infos(spark, sf):
    size = F.col("p_size")
    raw = _cat(_u(F.when(size % 2 == 0, 300).otherwise(200), 2), W.put_code_list(F.array(size.cast("int"), F.lit(7))), W.put_code_list(F.array(F.lit(9))))
    found = records.decode(t(spark, sf, "part").select("p_partkey", raw.alias("raw")), "raw", "ext_info", ["p_partkey"])
    return found.select("p_partkey", "protocol_mode", F.get("properties", F.lit(0)).alias("first_property"), F.size("controls").alias("n_controls"))


@query("SELECT p_partkey, CAST(CASE WHEN p_size % 5 > 0 THEN p_size * 24 ELSE -1 END AS BIGINT) AS hours, p_type AS license FROM part")
def license_lists(spark, sf):
    name = F.encode("p_type", "UTF-8")
    raw = _cat(_u(1, 1), _u(F.when(F.col("p_size") % 5 > 0, F.col("p_size") * 24).otherwise(0xFFFFFFFF), 4), _u(F.octet_length(name), 1), name)
    found = records.decode(t(spark, sf, "part").select("p_partkey", raw.alias("raw")), "raw", "licenses", ["p_partkey"])
    return found.select("p_partkey", F.coalesce("hours", F.lit(-1)).alias("hours"), "license")


@query("""
SELECT l_orderkey, l_linenumber, 20487 AS code, CAST(l_quantity AS BIGINT) AS current, CAST(CASE WHEN l_linenumber % 2 = 0 THEN l_linenumber - 4 ELSE -99 END AS BIGINT) AS low, CASE WHEN l_linenumber % 2 = 0 THEN 1 ELSE 2 END AS form,
  CASE WHEN l_linenumber % 2 = 1 THEN 2 ELSE -1 END AS n_choices, NULL AS text FROM lineitem
UNION ALL SELECT l_orderkey, l_linenumber, 20510, -1, -99, 0, -1, l_returnflag FROM lineitem""")
def self_describing_snapshots(spark, sf):
    """A snapshot of two properties a line: a signed number with a range or two lists of choices, and a string."""
    q, line = F.col("l_quantity").cast("long"), F.col("l_linenumber").cast("long")
    form = F.when(line % 2 == 0, _cat(_u(1, 1), _u(line - 4, 2), _u(100, 2), _u(1, 2))).otherwise(_cat(_u(2, 1), _u(1, 2), _u(q, 2), _u(2, 2), _u(q, 2), _u(line, 2)))
    number = _cat(_u(0x5007, 2), _u(3, 2), _u(1, 1), _u(1, 1), _u(0, 2), _u(q, 2), form)
    text = _cat(_u(0x501E, 2), _u(0xFFFF, 2), _u(1, 1), _u(1, 1), W.put_string(F.lit("")), W.put_string(F.col("l_returnflag")), _u(0, 1))
    raw = _cat(_u(2, 4), _u(0, 4), number, text)
    rows = t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", raw.alias("raw"))
    found = records.decode(rows, "raw", "snapshot", ["l_orderkey", "l_linenumber"])
    return found.select("l_orderkey", "l_linenumber", "code", F.coalesce("current.num", F.lit(-1)).alias("current"), F.coalesce("low", F.lit(-99)).alias("low"), "form", F.coalesce(F.size("choices"), F.lit(-1)).alias("n_choices"), F.col("current.str").alias("text"))


@query("SELECT o_orderkey, CAST(o_custkey % 65536 AS INTEGER) AS code, CASE WHEN o_orderstatus = 'O' THEN o_orderpriority END AS text, CAST(CASE WHEN o_orderstatus <> 'O' THEN o_orderkey ELSE -1 END AS BIGINT) AS current, CAST(CASE WHEN o_orderstatus = 'O' THEN 2 ELSE -1 END AS INTEGER) AS n_texts FROM orders")
def descriptors(spark, sf):
    """Standard property descriptors, of strings with a list of strings, or of 32-bit numbers without a form."""
    key, text = F.col("o_orderkey"), W.put_string(F.col("o_orderpriority"))
    head = _u(F.col("o_custkey") % 65536, 2)
    words = _cat(head, _u(0xFFFF, 2), _u(1, 1), W.put_string(F.lit("")), text, _u(2, 1), _u(2, 2), text, W.put_string(F.lit("other")))
    numbers = _cat(head, _u(6, 2), _u(0, 1), _u(0, 4), _u(key, 4), _u(0, 1))
    raw = F.when(F.col("o_orderstatus") == "O", words).otherwise(numbers)
    found = records.decode(t(spark, sf, "orders").select("o_orderkey", raw.alias("raw")), "raw", "descriptor", ["o_orderkey"])
    return found.select("o_orderkey", "code", F.col("current.str").alias("text"), F.coalesce("current.num", F.lit(-1)).alias("current"), F.coalesce(F.size("choices_str"), F.lit(-1)).alias("n_texts"))


@query("SELECT p_partkey, CAST(256 + k AS INTEGER) AS tag, CAST(CASE k WHEN 0 THEN p_size ELSE p_partkey END AS BIGINT) AS value FROM part, (SELECT unnest([0, 1]) AS k)")
def tiff_entries_by_sql(spark, sf):
    """Directories of two entries, read by a table function in SQL."""
    table_functions.register(spark)
    entry = lambda tag, v: _cat(_u(tag, 2), _u(4, 2), _u(1, 4), _u(v, 4))
    raw = _cat(F.unhex(F.lit("49492A00")), _u(8, 4), _u(2, 2), entry(256, F.col("p_size")), entry(257, F.col("p_partkey")), _u(0, 4))
    rows = t(spark, sf, "part").select("p_partkey", raw.alias("raw")).repartition(spark.sparkContext.defaultParallelism)  # the file is small for what its rows cost
    found = spark.sql("SELECT p_partkey, e.* FROM {rows}, LATERAL decode_tiff(raw, 'tag, value') e", rows=rows)
    return found.select("p_partkey", "tag", W.get_uint(F.col("value"), 0, 4).alias("value"))


@query("SELECT p_partkey, hex(encode(p_name)) AS image FROM part")
def jpeg_spans(spark, sf):
    """An image between its markers, inside other bytes."""
    start, end = F.unhex(F.lit("FFD8")), F.unhex(F.lit("FFD9"))
    raw = _cat(F.unhex(F.lit("00FF")), start, F.encode("p_name", "UTF-8"), end, F.unhex(F.lit("0102")))
    found = records.decode(t(spark, sf, "part").select("p_partkey", raw.alias("raw")), "raw", "jpeg", ["p_partkey"])
    return found.select("p_partkey", F.hex(F.substring("image", F.lit(3), F.octet_length("image") - 4)).alias("image"))


@query("SELECT c_custkey, duration || CASE WHEN c_custkey % 1000 = 0 THEN '' ELSE 'ms' END AS duration, valid FROM (SELECT c_custkey, CASE WHEN c_custkey % 1000 = 0 THEN '0s' ELSE CAST(c_custkey % 1000 AS VARCHAR) END AS duration, c_custkey % 1000 BETWEEN 1 AND 999 OR c_custkey % 1000 = 0 AS valid FROM customer)")
def duration_texts(spark, sf):
    """Durations through microseconds and back, as text, and whether the wire format holds them."""
    seconds = E.shutter_micros_decode(E.shutter_micros_encode((F.col("c_custkey") % 1000) / 1000))
    return t(spark, sf, "customer").select("c_custkey", E.duration_text(F.round(seconds, 6)).alias("duration"), E.shutter_valid(seconds).alias("valid"))

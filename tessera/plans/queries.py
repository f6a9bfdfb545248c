"""The registered queries of the device-telemetry operators, each with its SQL.

The driver's tables hold no device bytes, so a numeric or event column carries each
operator: decoders get the column encoded to wire bytes and the SQL never sees the codec,
only the column itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dimensions as D
from ..functions import encodings as E
from ..functions import wire as W
from ..operators import catalogue as C
from ..operators import snapshot as P
from ..operators import statistics as S
from ..sources import framing, records

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def snapshot_blob(*entries: tuple[Column, int, Column, int]) -> Column:
    """A property snapshot of scalar entries (code, type, value, size), encoded in the JVM."""
    parts = [W.put_uint(F.lit(len(entries)), 4), W.put_uint(F.lit(0), 4)]
    for code, kind, value, size in entries:
        v = W.put_uint(value, size)
        parts += [W.put_uint(code, 2), W.put_uint(F.lit(kind), 2), F.unhex(F.lit("0101")), v, v, F.unhex(F.lit("00"))]
    return F.concat(*parts)


# --- decode and scalar derivation ---------------------------------------------------


@query("""
SELECT l_returnflag, count(*) AS n, round(avg(l_quantity), 6) AS avg_f, min(l_quantity) AS min_f, max(l_quantity) AS max_f
FROM lineitem GROUP BY l_returnflag""")
def aperture_roundtrip(spark, sf):
    """Encode an aperture property, decode the snapshot, derive the f-number, summarise."""
    rows = t(spark, sf, "lineitem").select("l_returnflag", snapshot_blob((F.lit(0x5007), 4, E.aperture_encode(F.col("l_quantity")), 2)).alias("blob"))
    found = rows.select("l_returnflag", F.inline(W.scalar_entries(F.col("blob"), 2))).select("l_returnflag", E.aperture_decode(F.col("current")).alias("f"))
    return found.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.round(F.avg("f"), 6).alias("avg_f"), F.min("f").alias("min_f"), F.max("f").alias("max_f"))


@query("SELECT l_linestatus, count(*) AS n, CAST(sum(l_orderkey) AS BIGINT) AS total, min(l_orderkey) AS low, max(l_orderkey) AS high FROM lineitem GROUP BY l_linestatus")
def u32_wire_roundtrip(spark, sf):
    """Four little-endian bytes out and in again, all in the JVM."""
    rows = t(spark, sf, "lineitem").select("l_linestatus", W.get_uint(W.put_uint(F.col("l_orderkey"), 4), 0, 4).alias("v"))
    return rows.groupBy("l_linestatus").agg(F.count("*").alias("n"), F.sum("v").alias("total"), F.min("v").alias("low"), F.max("v").alias("high"))


@query("SELECT CAST(l_linenumber - 4 AS BIGINT) AS v, count(*) AS n FROM lineitem GROUP BY ALL")
def i16_sign_extension(spark, sf):
    rows = t(spark, sf, "lineitem").select(W.get_int(W.put_uint(F.col("l_linenumber") - 4, 2), 0, 2).alias("v"))
    return rows.groupBy("v").agg(F.count("*").alias("n"))


@query("SELECT p_partkey, p_name AS name, CAST(length(p_name) AS INTEGER) AS n FROM part UNION ALL SELECT n_nationkey, n_name, CAST(length(n_name) AS INTEGER) FROM nation")
def string_wire_roundtrip(spark, sf):
    both = t(spark, sf, "part").select("p_partkey", "p_name").union(t(spark, sf, "nation").select("n_nationkey", "n_name"))
    name = W.get_string(W.put_string(F.col("p_name")))
    return both.select("p_partkey", name.alias("name"), F.length(name).alias("n"))


@query("SELECT o_orderkey AS handle, o_custkey AS customer, o_orderstatus AS status FROM orders")
def prop_list_roundtrip(spark, sf):
    """Encode (handle, property, value) rows of two types, decode them, pivot them back."""
    row = lambda prop, kind, v: F.concat(W.put_uint(F.col("o_orderkey"), 4), W.put_uint(F.lit(prop), 2), W.put_uint(F.lit(kind), 2), v)
    blob = F.concat(W.put_uint(F.lit(2), 4), row(0xDC04, 6, W.put_uint(F.col("o_custkey"), 4)), row(0xDC07, 0xFFFF, W.put_string(F.col("o_orderstatus"))))
    eav = records.decode(t(spark, sf, "orders").select("o_orderkey", blob.alias("blob")), "blob", "prop_list", ["o_orderkey"])
    return C.pivot(eav, {"customer": (0xDC04, "value.num"), "status": (0xDC07, "value.str")})


@query("SELECT event_id, CAST(16386 AS INTEGER) AS code, user_id AS tx_id, event_id % 1000 AS param FROM events")
def event_packet_roundtrip(spark, sf):
    packet = F.concat(W.put_uint(F.lit(16), 4), W.put_uint(F.lit(4), 2), W.put_uint(F.lit(0x4002), 2), W.put_uint(F.col("user_id"), 4), W.put_uint(F.col("event_id") % 1000, 4))
    found = t(spark, sf, "events").select("event_id", W.event_packet(packet).alias("e"))
    return found.select("event_id", "e.code", "e.tx_id", F.get("e.params", F.lit(0)).alias("param"))


@query("SELECT o_custkey AS stream_id, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS total FROM orders GROUP BY o_custkey")
def stream_framing(spark, sf):
    """Two containers an order, cut at odd places, put together again from each customer's stream."""
    frame = lambda typ, code: F.concat(W.put_uint(F.lit(16), 4), W.put_uint(F.lit(typ), 2), W.put_uint(F.lit(code), 2), W.put_uint(F.col("o_orderkey"), 4), W.put_uint(F.col("o_orderkey"), 4))
    both = t(spark, sf, "orders").select(F.col("o_custkey").alias("stream_id"), "o_orderkey", F.concat(frame(1, 0x1008), frame(3, 0x2001)).alias("bytes"))
    chunks = both.select("stream_id", F.explode(F.array(F.struct((F.col("o_orderkey") * 2).alias("seq"), F.substring("bytes", 1, 21).alias("data")), F.struct((F.col("o_orderkey") * 2 + 1).alias("seq"), F.substring("bytes", 22, 100).alias("data")))).alias("c")).select("stream_id", "c.*")
    done = framing.transactions(framing.containers(chunks)).where("response = 8193 AND error IS NULL")
    return done.groupBy("stream_id").agg(F.count("*").alias("n"), F.sum(W.get_uint(F.col("response_params"), 0, 4)).alias("total"))


_SHUTTER = "CAST(CASE WHEN s <= 0 THEN 0 WHEN s < 1 AND floor(1 / s + 0.5) >= 1 AND abs(1 / floor(1 / s + 0.5) - s) <= s * 0.02 THEN 65536 + least(65535, floor(1 / s + 0.5)) ELSE greatest(1, least(65535, floor(s * 10 + 0.5))) * 65536 + 10 END AS BIGINT)"


@query(f"SELECT wire, count(*) AS n FROM (SELECT {_SHUTTER} AS wire FROM (SELECT l_discount * l_quantity / 10 AS s FROM lineitem)) GROUP BY wire")
def packed_shutter_encode(spark, sf):
    """From Bulb over unit fractions to tenths."""
    return t(spark, sf, "lineitem").select(E.shutter_encode(F.col("l_discount") * F.col("l_quantity") / 10).alias("wire")).groupBy("wire").agg(F.count("*").alias("n"))


@query("SELECT l_linenumber, CAST(l_quantity AS BIGINT) AS num, round(l_quantity / l_linenumber, 9) AS seconds, count(*) AS n FROM lineitem GROUP BY ALL")
def packed_shutter_decode(spark, sf):
    wire = F.col("l_quantity").cast("long") * 65536 + F.col("l_linenumber")
    rows = t(spark, sf, "lineitem").select("l_linenumber", F.col("l_quantity").cast("long").alias("num"), F.round(E.shutter_decode(wire), 9).alias("seconds"))
    return rows.groupBy("l_linenumber", "num", "seconds").agg(F.count("*").alias("n"))


@query("SELECT l_linenumber AS mode, CAST(sum(l_orderkey % 16777215) AS BIGINT) AS total, count(*) FILTER (l_orderkey % 1000 = 0) AS n_auto FROM lineitem GROUP BY l_linenumber")
def iso_pack_unpack(spark, sf):
    iso = F.when(F.col("l_orderkey") % 1000 == 0, E.ISO_AUTO).otherwise(F.col("l_orderkey") % 16777215)
    rows = t(spark, sf, "lineitem").select("l_orderkey", E.iso_decode(E.iso_encode(iso, F.col("l_linenumber"))).alias("d"))
    value = F.when(F.col("d.auto"), F.col("l_orderkey") % 16777215).otherwise(F.col("d.iso"))
    return rows.groupBy(F.col("d.mode").cast("int").alias("mode")).agg(F.sum(value).alias("total"), F.count_if("d.auto").alias("n_auto"))


@query("SELECT c_custkey, CAST(sign(c_acctbal / 1000) * floor(abs(c_acctbal / 1000 * 1000) + 0.5) AS BIGINT) AS rounded, CAST(trunc(c_acctbal / 1000 * 1000) AS BIGINT) AS cut FROM customer")
def ev_encode(spark, sf):
    ev = F.col("c_acctbal") / 1000
    return t(spark, sf, "customer").select("c_custkey", E.ev_encode(ev).alias("rounded"), E.ev_encode(ev, truncate=True).alias("cut"))


_LADDER = (0x00010000 + 1000, 0x00010000 + 60, 0x00010000 + 2, 0x000A000A, 0x0064000A)


@query("""
WITH l(i, wire, s) AS (VALUES (0, 66536, 0.001), (1, 65596, 1 / 60.0), (2, 65538, 0.5), (3, 655370, 1.0), (4, 6553610, 10.0)),
q AS (SELECT DISTINCT l_quantity AS want FROM lineitem),
b AS (SELECT want, wire, row_number() OVER (PARTITION BY want ORDER BY greatest(s / (want / 20), (want / 20) / s), i) AS r FROM q, l)
SELECT CAST(wire AS BIGINT) AS wire, count(*) AS n FROM lineitem JOIN b ON want = l_quantity AND r = 1 GROUP BY wire""")
def nearest_shutter_ratio(spark, sf):
    ladder = F.array(*(F.lit(v).cast("long") for v in _LADDER))
    return t(spark, sf, "lineitem").select(E.nearest_shutter(ladder, F.col("l_quantity") / 20).cast("long").alias("wire")).groupBy("wire").agg(F.count("*").alias("n"))


@query("SELECT l_linestatus, count(*) FILTER (l_extendedprice / 10 - 100 <= 0 OR l_extendedprice / 10 - 100 BETWEEN 1 / 65535.0 AND 6553.5) AS n_valid, count(*) AS n FROM lineitem GROUP BY l_linestatus")
def shutter_validate(spark, sf):
    rows = t(spark, sf, "lineitem").select("l_linestatus", E.shutter_valid(F.col("l_extendedprice") / 10 - 100).alias("ok"))
    return rows.groupBy("l_linestatus").agg(F.count_if("ok").alias("n_valid"), F.count("*").alias("n"))


@query("SELECT l_quantity AS q, CAST(CASE WHEN l_quantity <= 1 THEN 0 ELSE ceil(log2(l_quantity)) END AS INTEGER) AS width, CAST(sum(CASE WHEN (l_orderkey % 64) % 2 = 0 THEN (l_orderkey % 64) // 2 ELSE -(((l_orderkey % 64) + 1) // 2) END) AS BIGINT) AS zigzag FROM lineitem GROUP BY l_quantity")
def adaptive_code_terms(spark, sf):
    """Code width and zig-zag of the adaptive codec, as expressions."""
    rows = t(spark, sf, "lineitem").select(F.col("l_quantity").alias("q"), E.code_width(F.col("l_quantity"), F.lit(1)).alias("width"), E.zigzag_decode(F.col("l_orderkey") % 64).alias("z"))
    return rows.groupBy("q", "width").agg(F.sum("z").alias("zigzag"))


@query("SELECT CAST(CASE ((l_partkey % 2) * 2 + (l_suppkey % 2)) WHEN 0 THEN 'R' WHEN 3 THEN 'B' ELSE 'G' END AS VARCHAR) AS colour, count(*) AS n FROM lineitem GROUP BY ALL")
def mosaic_colour_counts(spark, sf):
    pattern = F.array(*map(F.lit, (0, 1, 1, 2)))
    colour = E.pattern_letters(F.array(E.pattern_at(pattern, 2, 2, F.col("l_suppkey"), F.col("l_partkey"))))
    return t(spark, sf, "lineitem").select(colour.alias("colour")).groupBy("colour").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, o_orderdate AS captured, date_trunc('minute', o_orderdate) + INTERVAL 1 MINUTE AS next_minute FROM orders")
def capture_date_parse(spark, sf):
    """Formatted in four layouts by key, parsed back."""
    text = E.date_time_text(F.col("o_orderdate"))
    text = F.when(F.col("o_orderkey") % 4 == 1, F.concat(text, F.lit("Z"))).when(F.col("o_orderkey") % 4 == 2, F.concat(text, F.lit(".0"))).when(F.col("o_orderkey") % 4 == 3, F.concat(text, F.lit("+0000"))).otherwise(text)
    got = E.date_time(text)
    return t(spark, sf, "orders").select("o_orderkey", got.cast("timestamp_ntz").alias("captured"), E.next_minute(got).cast("timestamp_ntz").alias("next_minute"))


@query("SELECT page_id, CAST(len(regexp_extract_all(html, '[\\x20-\\x7E]{4,}')) AS INTEGER) AS runs, CAST(list_sum(list_transform(regexp_extract_all(html, '[\\x20-\\x7E]{4,}'), lambda s: length(s))) AS BIGINT) AS chars FROM pages")
def printable_runs(spark, sf):
    runs = E.printable_runs(F.encode(F.col("html"), "UTF-8"))
    total = F.aggregate(runs, F.lit(0).cast("long"), lambda a, s: a + F.length(s))
    return t(spark, sf, "pages").select("page_id", F.size(runs).alias("runs"), total.alias("chars"))


# --- naming and snapshots ------------------------------------------------------------

_CODE = "CASE event_type WHEN 'click' THEN 16386 WHEN 'view' THEN 16397 WHEN 'purchase' THEN 49665 ELSE 50000 + length(event_type) END"


def _event_code() -> Column:
    e = F.col("event_type")
    return F.when(e == "click", 0x4002).when(e == "view", 0x400D).when(e == "purchase", 0xC201).otherwise(50000 + F.length(e))


@query(f"""
SELECT CASE c WHEN 16386 THEN 'ObjectAdded' WHEN 16397 THEN 'CaptureComplete' WHEN 49665 THEN 'SonyPropertyChanged' ELSE 'Event(0x' || upper(hex(c)) || ')' END AS name, count(*) AS n
FROM (SELECT {_CODE} AS c FROM events) GROUP BY ALL""")
def event_name_fallback(spark, sf):
    rows = t(spark, sf, "events").select(_event_code().alias("code"))
    counts = rows.groupBy("code").agg(F.count("*").alias("n"))  # name the few codes, not every event
    return D.named(counts, "code", [D.dimension(spark, "event")], "Event").groupBy("name").agg(F.sum("n").alias("n"))


@query("SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS value, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY ALL")
def snapshot_last_wins(spark, sf):
    return P.last_wins(t(spark, sf, "events"), ["user_id", "event_type"], F.struct("ts", "event_id"), ["value", "event_id"])


@query("SELECT user_id, arg_min(event_type, event_id) AS event_type, min(event_id) AS event_id FROM events GROUP BY user_id")
def snapshot_first_match(spark, sf):
    return P.first_match(t(spark, sf, "events"), ["user_id"], "event_id", ["event_type", "event_id"])


@query("""
WITH h AS (SELECT *, event_id < (SELECT max(event_id) // 2 FROM events) AS early FROM events),
s AS (SELECT early, user_id, arg_max(event_type, event_id) AS v FROM h GROUP BY ALL)
SELECT o.user_id, o.v AS old, n.v AS new FROM s o JOIN s n ON o.user_id = n.user_id AND o.early AND NOT n.early WHERE o.v <> n.v AND o.user_id <> 1""")
def snapshot_diff(spark, sf):
    events = t(spark, sf, "events")
    half = events.agg(F.floor(F.max("event_id") / 2).alias("half"))
    rows = events.join(F.broadcast(half))  # one row
    old = P.last_wins(rows.where("event_id < half"), ["user_id"], "event_id", ["event_type"])
    new = P.last_wins(rows.where("event_id >= half"), ["user_id"], "event_id", ["event_type"])
    return P.difference(old, new, "user_id", "event_type", ignore=[1])


@query("SELECT DISTINCT user_id FROM events WHERE event_id % 2 = 0 AND user_id NOT IN (SELECT user_id FROM events WHERE event_id % 101 = 0)")
def new_frames(spark, sf):
    events = t(spark, sf, "events")
    return C.unseen(events.where("event_id % 2 = 0").select("user_id"), events.where("event_id % 101 = 0"), "user_id").distinct()


@query("SELECT user_id, count(*) FILTER (user_id NOT IN (SELECT user_id FROM events WHERE event_id % 101 = 0)) > 0 AS is_new, count(*) AS n FROM events GROUP BY user_id")
def tag_new_frames(spark, sf):
    events = t(spark, sf, "events")
    return C.tag_new(events.select("user_id"), events.where("event_id % 101 = 0"), "user_id").groupBy("user_id", "is_new").agg(F.count("*").alias("n"))


@query("SELECT user_id, arg_max(value, event_id) FILTER (event_type = 'click') AS click, arg_max(value, event_id) FILTER (event_type = 'view') AS viewed FROM events GROUP BY user_id")
def eav_pivot(spark, sf):
    return C.pivot(t(spark, sf, "events"), {"click": "click", "viewed": "view"}, "user_id", "event_type", "value", "event_id")


@query("SELECT user_id, CAST(count(DISTINCT event_type) AS INTEGER) AS n_properties, arg_max(value, event_id) FILTER (event_type = 'click') AS last_click FROM events GROUP BY user_id")
def eav_by_handle(spark, sf):
    maps = C.by_handle(t(spark, sf, "events"), "user_id", "event_type", "value", "event_id")
    return maps.select("user_id", F.size("properties").alias("n_properties"), F.try_element_at("properties", F.lit("click")).alias("last_click"))


@query("""
SELECT o_orderkey, o_orderstatus <> 'F' AND o_orderpriority <> '1-URGENT' AS settable,
  CASE WHEN o_orderstatus = 'F' THEN 'read-only' WHEN o_orderpriority = '1-URGENT' THEN 'controlled by the device' END AS reason,
  o_custkey % 10 IN (1, 3, 5) AS is_choice, o_custkey % 10 - 5 BETWEEN -3 AND 3 AS in_range
FROM orders""")
def settable_reason(spark, sf):
    choices = F.when(F.col("o_orderpriority") == "1-URGENT", F.array(F.lit(1))).otherwise(F.array(*map(F.lit, (1, 3, 5))))
    can = P.writable(F.when(F.col("o_orderstatus") == "F", 0).otherwise(0x81), F.lit(0))
    v = F.col("o_custkey") % 10
    three = F.array(*(F.lit(x).cast("long") for x in (1, 3, 5)))
    out = t(spark, sf, "orders").select("o_orderkey", P.settable(can, choices).alias("s"), P.valid(v, F.lit(2), three, F.lit(0), F.lit(0)).alias("is_choice"), P.valid(v - 5, F.lit(1), three, F.lit(-3), F.lit(3)).alias("in_range"))
    return out.select("o_orderkey", "s.settable", "s.reason", "is_choice", "in_range")


@query("""
SELECT s_nationkey, count(*) FILTER (k <> 0) AS n_slots, coalesce(bool_or(k = 1) FILTER (k <> 0), FALSE) AS any_usable, coalesce(bool_or(s_acctbal < 0) FILTER (k <> 0), FALSE) AS any_writing,
  coalesce(max(s_suppkey) FILTER (k = 1), -1) AS remaining,
  count(*) FILTER (k <> 0) = 0 OR (coalesce(bool_or(k = 1), FALSE) AND NOT coalesce(bool_or(s_acctbal < 0) FILTER (k <> 0), FALSE)) AS ready
FROM (SELECT *, s_suppkey % 3 AS k FROM supplier) GROUP BY s_nationkey""")
def readiness(spark, sf):
    k = F.col("s_suppkey") % 3
    slots = t(spark, sf, "supplier").select("s_nationkey", F.when(k != 0, k == 1).alias("usable"), F.when(k != 0, F.col("s_acctbal") < 0).alias("writing"), F.col("s_suppkey").alias("remaining"))
    return P.readiness(slots, ["s_nationkey"]).fillna(-1, ["remaining"])


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'no space' WHEN c_mktsegment = 'BUILDING' THEN 'busy' WHEN c_nationkey = 3 THEN 'mode dial' END AS reason FROM customer")
def precondition_reason(spark, sf):
    return t(spark, sf, "customer").select("c_custkey", P.precondition((F.col("c_acctbal") >= 0, "no space"), (F.col("c_mktsegment") != "BUILDING", "busy"), (F.col("c_nationkey") != 3, "mode dial")).alias("reason"))


@query("SELECT count(*) FILTER (n_regionkey < 3) AS n_named, count(*) FILTER (n_regionkey >= 3) AS n_unknown FROM customer JOIN nation ON c_nationkey = n_nationkey")
def named_and_unknown(spark, sf):
    names = t(spark, sf, "nation").where("n_regionkey < 3").select(F.col("n_nationkey").alias("code"), F.col("n_name").alias("name"))
    return P.named_share(t(spark, sf, "customer"), "c_nationkey", names)


# --- statistics and selection ----------------------------------------------------------


@query("""
WITH r AS (SELECT doc_id, source, lang, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id DESC) AS r FROM documents)
SELECT source, lang, count(*) AS n, array_to_string(list(CAST(doc_id AS VARCHAR) ORDER BY doc_id) FILTER (r <= 8), ' ') AS last_names FROM r GROUP BY ALL""")
def format_counts(spark, sf):
    docs = t(spark, sf, "documents").select("source", "lang", "doc_id", F.col("doc_id").cast("string").alias("name"))
    return C.format_counts(docs, ["source", "lang"], "name", "doc_id").withColumn("last_names", F.array_join("last_names", " "))


@query("""
SELECT l_returnflag AS channel, count(*) AS total, count(*) FILTER (b = 255) AS clipped, round(count(*) FILTER (b = 255) / count(*), 6) AS share
FROM (SELECT l_returnflag, least(255, CAST(floor(l_extendedprice / 300) AS BIGINT)) AS b FROM lineitem) GROUP BY l_returnflag""")
def hist_total_clipped(spark, sf):
    bins = t(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("channel"), F.least(F.lit(255), F.floor(F.col("l_extendedprice") / 300)).alias("bin")).agg(F.count("*").alias("n"))
    return S.channel_totals(bins, ["channel"]).withColumn("share", F.round("share", 6))


@query("SELECT user_id, count(*) FILTER (p IS NULL OR p <> event_type) AS n_changed, count(*) FILTER (p = event_type) AS n_same FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) GROUP BY user_id")
def adjacent_change(spark, sf):
    rows = S.changes(t(spark, sf, "events"), ["user_id"], ["ts", "event_id"], "event_type")
    return rows.groupBy("user_id").agg(F.count_if("changed").alias("n_changed"), F.count_if(~F.col("changed")).alias("n_same"))


@query("SELECT user_id, count(*) FILTER (p IS NULL OR p <> props) AS n_distinct, count(*) FILTER (p = props) AS n_repeated FROM (SELECT *, lag(props) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events) GROUP BY user_id")
def frame_repeats(spark, sf):
    return S.repeats(t(spark, sf, "events"), ["user_id"], ["event_id"], "props")


@query("SELECT event_type, count(*) AS frames, CAST(sum(strlen(props)) AS BIGINT) AS bytes, round(count(*) / (epoch_us(max(ts)) - epoch_us(min(ts))) * 1e6, 9) AS per_second FROM events GROUP BY event_type")
def frame_rate(spark, sf):
    events = t(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return S.rate(events, ["event_type"], "props", "ts").withColumn("per_second", F.round("per_second", 9))


@query("SELECT l_linestatus, count(*) AS frames, round(sum(l_tax), 4) AS total, round(avg(l_tax), 6) AS mean, max(l_tax) AS slowest, round(avg(l_discount), 6) AS mean_change FROM lineitem GROUP BY l_linestatus")
def burst_statistics(spark, sf):
    out = S.burst(t(spark, sf, "lineitem"), ["l_linestatus"], "l_tax", "l_discount")
    return out.withColumn("total", F.round("total", 4)).withColumn("mean", F.round("mean", 6)).withColumn("mean_change", F.round("mean_change", 6))


@query("""
WITH r AS (SELECT *, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS g FROM events),
q AS (SELECT *, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, g ORDER BY event_id) AS k FROM r),
s AS (SELECT *, coalesce(sum(CASE WHEN k >= 2 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stop FROM q)
SELECT user_id, count(*) AS looked_at, count(*) FILTER (event_type = 'error') AS failed FROM s WHERE stop = 0 GROUP BY user_id""")
def failure_cutoff(spark, sf):
    rows = S.until_failures(t(spark, sf, "events"), ["user_id"], ["event_id"], F.col("event_type") == "error", 2)
    return rows.groupBy("user_id").agg(F.count("*").alias("looked_at"), F.count_if(F.col("event_type") == "error").alias("failed"))


@query("SELECT user_id, arg_min(event_type, event_id) AS event_type, min(event_id) AS event_id FROM events WHERE event_type IN ('click', 'purchase') GROUP BY user_id")
def first_matching_event(spark, sf):
    return S.first_of(t(spark, sf, "events"), ["user_id"], F.col("event_type").isin("click", "purchase"), F.col("event_id"), ["event_type", "event_id"])


@query("SELECT DISTINCT name FROM (SELECT p_name AS name FROM part UNION ALL SELECT n_name FROM nation UNION ALL SELECT s_name FROM supplier) WHERE contains(lower(name), 'an') ORDER BY name LIMIT 8")
def name_suggest_top8(spark, sf):
    cols = [("part", "p_name"), ("nation", "n_name"), ("supplier", "s_name")]
    return S.suggest([t(spark, sf, n).select(F.col(c).alias("name")) for n, c in cols], "name", "AN")


@query("SELECT n_name, upper(n_name) AS asked, CAST(n_nationkey AS INTEGER) AS code FROM nation")
def reverse_name_lookup(spark, sf):
    nation = t(spark, sf, "nation")
    layer = nation.select(F.col("n_nationkey").alias("code"), F.col("n_name").alias("name"))
    return D.codes_of(nation.select("n_name", F.upper("n_name").alias("asked")), "asked", [layer]).select("n_name", "asked", F.col("code").cast("int").alias("code"))

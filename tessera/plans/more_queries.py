"""Registered queries of further operators: projections, catalogues, transactions, codecs and feeds."""

from __future__ import annotations

import atexit
import datetime as dt
import shutil
import tempfile
import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..codecs import lossless_jpeg
from ..functions import dimensions as D
from ..functions import encodings as E
from ..functions import rendering as R
from ..functions import wire as W
from ..operators import catalogue as C
from ..operators import devices as V
from ..operators import snapshot as P
from ..operators import statistics as S
from ..sources import records
from ..streaming import events as feeds
from .queries import query, t

_TYPES = {"click": 1, "view": 2, "purchase": 3}
_TYPE = "CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'purchase' THEN 3 ELSE 9 END"


def _entries(spark, sf):
    """Events as property entries of their user: code, ordinal and the current value."""
    code = F.lit(9)
    for name, k in _TYPES.items():
        code = F.when(F.col("event_type") == name, k).otherwise(code)
    return t(spark, sf, "events").select("user_id", code.alias("code"), F.col("event_id").alias("ordinal"), F.struct((F.col("event_id") % 1000 + 100).alias("num")).alias("current"))


@query("""
SELECT action, vendor_id, product_id, location, count(*) AS n FROM (
  SELECT CASE WHEN event_id % 3 = 0 THEN 'remove' ELSE 'add' END AS action, CAST(user_id % 40 AS INTEGER) AS vendor_id, CAST(event_id % 50 AS INTEGER) AS product_id,
    (user_id % 5) * 65536 + event_id % 8 AS location
  FROM events WHERE event_id % 7 <> 0) GROUP BY ALL""")
def hotplug_datagrams(spark, sf):
    """Datagrams with a value that holds '=' and an ACTION key that contradicts the head."""
    id_ = F.col("event_id")
    head = F.concat(F.when(id_ % 3 == 0, "remove").otherwise("add"), F.lit("@/devices/usb1"))
    product = F.concat(F.lit("PRODUCT="), F.lower(F.hex(F.col("user_id") % 40)), F.lit("/"), F.lower(F.hex(id_ % 50)), F.lit("/100"))
    numbers = [F.concat(F.lit("BUSNUM="), (F.col("user_id") % 5).cast("string")), F.concat(F.lit("DEVNUM="), (id_ % 8).cast("string"))]
    system = F.when(id_ % 7 == 0, "SUBSYSTEM=input").otherwise("SUBSYSTEM=usb")
    gram = F.concat_ws("\0", head, F.lit("ACTION=change"), F.lit("NOTE=a=b"), system, F.lit("DEVTYPE=usb_device"), product, *numbers)
    rows = records.datagram(t(spark, sf, "events").select(F.encode(gram, "UTF-8").alias("d")), "d")
    return rows.groupBy("action", "vendor_id", "product_id", "location").agg(F.count("*").alias("n"))


@query("""
SELECT width, count(*) AS n FROM (
  SELECT CASE WHEN c <= 0 OR c >= s THEN 0 ELSE len(list_filter(range(15), lambda k: (c << k) < s)) END AS width
  FROM (SELECT CAST(l_orderkey AS BIGINT) * l_partkey * (1 + l_linenumber % 3 * 1048576) AS s, CAST(l_suppkey % 20 AS BIGINT) AS c FROM lineitem)) GROUP BY width""")
def code_width_wide(spark, sf):
    """Over ratios from below one to beyond 2**31, and counts of zero; products of large keys have more than 63 bits."""
    most = 1 << 62  # beyond every count that is compared; factors are whole and not 0
    exact = lambda c: c.cast("decimal(19,0)")
    held = lambda c: F.when(c > most, most).when(c < -most, -most).otherwise(c).cast("decimal(19,0)")
    total = held(held(exact(F.col("l_orderkey")) * exact(F.col("l_partkey"))) * exact(F.col("l_linenumber") % 3 * 1048576 + 1)).cast("long")
    pairs = t(spark, sf, "lineitem").select(total.alias("total"), (F.col("l_suppkey") % 20).cast("long").alias("count"))  # made once, not for every shift
    rows = pairs.select(E.code_width(F.col("total"), F.col("count")).cast("long").alias("width"))
    return rows.groupBy("width").agg(F.count("*").alias("n"))


@query(f"""
WITH e AS (SELECT user_id, event_id, event_id % 1000 + 100 AS v, {_TYPE} AS c FROM events),
w AS (SELECT user_id, arg_max(v, event_id) FILTER (c = 1) AS a, arg_max(v, event_id) FILTER (c = 2) AS s, arg_max(v, event_id) FILTER (c = 3) AS i FROM e WHERE c <> 9 GROUP BY user_id)
SELECT user_id, round(a / 100.0, 6) AS f_number, i % 16777216 AS iso FROM w""")
def exposure_projection(spark, sf):
    out = P.exposure(_entries(spark, sf), ["user_id"], 1, 2, 3)
    return out.select("user_id", F.round("f_number", 6).alias("f_number"), F.col("iso.iso").cast("long").alias("iso"))


@query(f"""
SELECT user_id, arg_max(event_id % 1000 + 100, event_id) FILTER (c = 1) AS clicked, arg_max(event_id % 1000 + 100, event_id) FILTER (c = 3) AS bought
FROM (SELECT *, {_TYPE} AS c FROM events) WHERE c IN (1, 3) GROUP BY user_id""")
def property_projection(spark, sf):
    return P.projection(_entries(spark, sf), ["user_id"], {"clicked": 1, "bought": 3})


@query(f"""
SELECT user_id, coalesce(bool_or(c = 1 AND event_id % 1000 = 7), FALSE) AS lucky, coalesce(bool_or(c = 3 AND event_id % 1000 = 3), FALSE) AS sold
FROM (SELECT *, {_TYPE} AS c FROM events) GROUP BY user_id""")
def property_flags(spark, sf):
    return P.flags(_entries(spark, sf), ["user_id"], {"lucky": (1, 107), "sold": (3, 103)})


@query("SELECT n_nationkey AS code, n_name, s_suppkey IS NULL AS absent, coalesce(s_suppkey, -1) AS s_suppkey FROM nation LEFT JOIN (SELECT * FROM supplier WHERE s_suppkey % 3 = 0) ON s_nationkey = n_nationkey")
def required_properties(spark, sf):
    have = t(spark, sf, "supplier").where("s_suppkey % 3 = 0").select(F.col("s_nationkey").alias("code"), "s_suppkey")
    return P.required(have, t(spark, sf, "nation").select(F.col("n_nationkey").alias("code"), "n_name"), "code").select("code", "n_name", "absent", F.coalesce("s_suppkey", F.lit(-1)).alias("s_suppkey"))


@query("SELECT c_custkey, c_nationkey AS code, CASE WHEN n_regionkey < 3 THEN n_name END AS name, n_regionkey >= 3 AS unknown FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_nationkey % 2 = 0")
def visible_properties(spark, sf):
    nation = t(spark, sf, "nation")
    names = nation.where("n_regionkey < 3").select(F.col("n_nationkey").alias("code"), F.col("n_name").alias("name"))
    supported = nation.where("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("code"))
    return P.visible(t(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("code")), "code", supported, names)


@query("SELECT o_orderkey AS handle, 0 AS line FROM orders WHERE o_orderstatus <> 'F' UNION ALL SELECT l_orderkey, CAST(l_linenumber AS INTEGER) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F')")
def append_unseen_handles(spark, sf):
    """Lines of orders that are not in the list of open orders, behind that list."""
    seen = t(spark, sf, "orders").where("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("handle"), F.lit(0).alias("line"))
    now = t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("handle"), F.col("l_linenumber").cast("int").alias("line"))
    return C.append_unseen(seen, now)


@query("SELECT o_orderkey, o_custkey, o_orderpriority FROM orders WHERE o_orderstatus = 'O' AND o_custkey % 10 = 3")
def selected_objects(spark, sf):
    rows = t(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", F.col("o_orderstatus").alias("format"), (F.col("o_custkey") % 10).alias("parent"))
    return C.select_objects(rows, fmt="O", parent=3).select("o_orderkey", "o_custkey", "o_orderpriority")


@query("SELECT doc_id, hex(encode(text)[CAST(doc_id % 50 + 1 AS BIGINT) : CAST(least(strlen(text), doc_id % 50 + 12) AS BIGINT)]) AS part FROM documents WHERE text IS NOT NULL")
def byte_ranges(spark, sf):
    raw = F.encode("text", "UTF-8")
    return t(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", F.hex(C.byte_range(raw, F.col("doc_id") % 50, F.lit(12))).alias("part"))


@query("""
WITH s AS (SELECT *, sum(CASE WHEN event_id % 9 < user_id % 9 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id % 9, user_id ORDER BY event_id) AS stale FROM events)
SELECT user_id, event_id, CAST(stale AS BIGINT) AS stale, event_id % 9 <= user_id % 9 AND stale <= 8 AS in_step FROM s""")
def replies_in_step(spark, sf):
    rows = t(spark, sf, "events").select("user_id", "event_id", (F.col("event_id") % 9).alias("tx"), (F.col("user_id") % 9).alias("asked"))
    return S.in_step(rows, ["user_id"], "event_id", "tx", "asked").select("user_id", "event_id", "stale", "in_step")


@query("SELECT user_id, count(*) FILTER (event_type = 'view') AS described, count(*) FILTER (event_type = 'click') AS declined, count(*) FILTER (event_type NOT IN ('view', 'click')) AS failed FROM events GROUP BY user_id")
def sweep_outcomes(spark, sf):
    return S.sweep(t(spark, sf, "events"), ["user_id"], F.col("event_type") == "view", F.col("event_type") == "click")


@query("SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 'first' || p_size WHEN p_size % 4 = 1 THEN 'second' || p_size ELSE CAST(p_size AS VARCHAR) END AS label FROM part")
def layered_value_names(spark, sf):
    """Curated names of two layers, the first before the second, then the number."""
    part = t(spark, sf, "part").select("p_partkey", F.lit(7).alias("prop"), F.col("p_size").cast("int").alias("value"))
    layer = lambda word, k: part.where(F.col("value") % 4 <= k).select("prop", "value", F.concat(F.lit(word), F.col("value").cast("string")).alias("name")).distinct()
    return D.values_named(part, "prop", "value", [layer("first", 0), layer("second", 1)]).select("p_partkey", "label")


@query("SELECT l_orderkey, l_linenumber, CAST(l_partkey % 16384 AS INTEGER) AS v FROM lineitem")
def lossless_jpeg_roundtrip(spark, sf):
    """Each order's keys as one lossless-JPEG tile of its own, coded and decoded."""
    lines = t(spark, sf, "lineitem").select("l_orderkey", F.struct("l_linenumber", (F.col("l_partkey") % 16384).alias("v")).alias("s"))
    tiles = lines.groupBy("l_orderkey").agg(F.sort_array(F.collect_list("s")).alias("s"))  # seven lines an order at most

    def code(batches):
        import pyarrow as pa

        for batch in batches:
            back, lists = [], batch.column(1)
            values, ends = lists.flatten().field("v").to_numpy(), (lists.offsets.to_numpy() - lists.offsets[0].as_py()).tolist()
            for a, b in zip(ends, ends[1:]):
                back.append(lossless_jpeg.decode(lossless_jpeg.Scan(lossless_jpeg.encode(values[a:b].reshape(1, -1, 1), 14))).ravel())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(back, pa.list_(pa.int32()))], names=["l_orderkey", "lines", "back"])

    rows = tiles.select(F.col("l_orderkey").cast("long").alias("l_orderkey"), "s", F.col("s.l_linenumber").cast("array<int>").alias("lines"))
    coded = rows.mapInArrow(code, "l_orderkey long, lines array<int>, back array<int>")
    both = coded.select("l_orderkey", F.inline(F.arrays_zip("lines", "back")))
    types = dict(t(spark, sf, "lineitem").dtypes)
    return both.select(F.col("l_orderkey").cast(types["l_orderkey"]).alias("l_orderkey"), F.col("lines").cast(types["l_linenumber"]).alias("l_linenumber"), F.col("back").alias("v"))


def _shared_folder(spark) -> str:
    """``spark.checkpoint.dir``; where it is unset, a local master gets a temporary folder and any other is refused."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        folder = tempfile.mkdtemp(prefix="tessera-feeds-")
        atexit.register(shutil.rmtree, folder, True)
        root = f"file://{folder}"
    return root.rstrip("/")


#: Deliveries of the registered feeds; each is a micro-batch.
DELIVERIES = 6
#: Files of a delivery grow with the rows of the feed up to so many.
MOST_FILES, FILE_ROWS = 32, 1_000_000
#: Feeds start a day behind the epoch, where watermarks start.
DAY = 86_400


def _fed(spark, rows, build, mode="append", end=None, keys=None, count=None):
    """Rows, delivered in the order of their column ``arrival``, through a Structured Streaming query; its table.

    Every delivery is a micro-batch of its own, so state crosses batches.  ``end`` is a last
    delivery whose timestamp lets the watermark pass all rows.  ``rows`` may be a function that
    makes the rows of one delivery from a part of its table; ``count`` is then about how many there are.
    """
    place = f"{_shared_folder(spark)}/feed-{uuid.uuid4().hex}"
    if callable(rows):
        delivery, plain = rows, rows(0)
    else:
        rows.write.partitionBy("arrival").parquet(f"{place}/dealt")  # rows are made once, not for every delivery
        dealt, plain = spark.read.schema(rows.schema).parquet(f"{place}/dealt"), rows.drop("arrival")
        delivery, count = (lambda k: dealt.where(F.col("arrival") == k).select(*plain.columns)), dealt.count()
    files = max(1, min(MOST_FILES, max(4, count // FILE_ROWS), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    for k in range(DELIVERIES):
        delivery(k).repartition(files).write.mode("append").parquet(f"{place}/in")
    if end is not None:
        spark.createDataFrame([end], plain.schema).repartition(1).write.mode("append").parquet(f"{place}/in")
    source = spark.readStream.schema(plain.schema).option("maxFilesPerTrigger", files).parquet(f"{place}/in")
    stream = build(source).writeStream.outputMode(mode).option("checkpointLocation", f"{place}/ck").trigger(availableNow=True)
    if mode == "append":
        stream.format("parquet").option("path", f"{place}/out").start().awaitTermination()
        out = spark.read.parquet(f"{place}/out")
    else:
        feeds.upserts(stream, f"{place}/out").start().awaitTermination()
        out = feeds.read_upserts(spark, f"{place}/out", keys)
    _clean(spark, f"{place}/dealt", f"{place}/in", f"{place}/ck")
    atexit.register(_clean, spark, place)
    return out


def _clean(spark, *places):
    """Delete folders of a feed, whatever file system they are on."""
    try:
        for place in places:
            path = spark._jvm.org.apache.hadoop.fs.Path(place)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the session has ended; its owner cleans the folder
        pass


def _delivered(rows, key, most):
    """Rows in shuffled deliveries: one comes up to a quarter of a delivery late.  Also the delay that covers it."""
    size = max(4, -(-(most + 1) // DELIVERIES))
    late = F.pmod(F.xxhash64(key), F.lit(size // 4))
    arrival = F.least(F.floor((key + late) / size), F.lit(DELIVERIES - 1)).cast("int")
    return rows.withColumn("arrival", arrival).withColumn("ingest_ts", F.timestamp_seconds(key + DAY)), f"{size // 4 + 1} seconds"


def _keys_of(delivery, most):
    """Least and greatest key that a delivery of :func:`_delivered` may hold; the last has no greatest."""
    size = max(4, -(-(most + 1) // DELIVERIES))
    return delivery * size - size // 4, (delivery + 1) * size if delivery < DELIVERIES - 1 else None


def _event_feed(spark, sf, *columns):
    """Events of the table, a second apart, in shuffled deliveries; their delay; the greatest id."""
    events = t(spark, sf, "events")
    most = events.agg(F.max("event_id")).first()[0] or 0
    rows, delay = _delivered(events.select("event_id", *columns), F.col("event_id"), most)
    return rows.withColumnRenamed("event_id", "seq"), delay, most


def _end(most, *values, after=10**8):
    """A row (seq, *values, ingest_ts) far behind all others."""
    return (most + after, *values, dt.datetime.fromtimestamp(most + after + DAY, dt.timezone.utc))


@query("SELECT CAST(user_id AS VARCHAR) AS stream_id, event_id AS seq FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events) WHERE p IS NULL OR p <> event_type")
def streamed_changes(spark, sf):
    rows, delay, most = _event_feed(spark, sf, F.col("user_id").cast("string").alias("stream_id"), "event_type")
    found = _fed(spark, rows, lambda d: feeds.changes(d, "event_type", "ingest_ts", delay), end=_end(most, "end", None))
    return found.where("stream_id <> 'end'").select("stream_id", "seq")


@query("""
WITH e AS (SELECT *, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS life FROM events WHERE event_type IN ('click', 'purchase'))
SELECT CAST(user_id % 10 AS VARCHAR) AS stream_id, user_id AS handle, min(event_id) AS seq FROM e WHERE event_type = 'click' GROUP BY user_id, life""")
def streamed_first_seen(spark, sf):
    """A click adds its user as a handle, a purchase removes it."""
    code = F.when(F.col("event_type") == "click", 0x4002).when(F.col("event_type") == "purchase", 0x4003).otherwise(1)
    rows, delay, most = _event_feed(spark, sf, (F.col("user_id") % 10).cast("string").alias("stream_id"), code.alias("code"), F.array(F.col("user_id")).alias("params"))
    found = _fed(spark, rows, lambda d: feeds.first_seen(d, [0x4002], [0x4003], "ingest_ts", delay), end=_end(most, "end", 0x4002, [0]))
    return found.where("stream_id <> 'end'").select("stream_id", "handle", "seq")


@query("""
WITH d AS (SELECT CAST(user_id % 40 AS INTEGER) AS vendor_id, CAST(user_id % 3 AS INTEGER) AS product_id, event_id AS seq, event_type = 'click' AS attached FROM events WHERE user_id % 40 < 30),
l AS (SELECT *, coalesce(lag(attached) OVER (PARTITION BY vendor_id, product_id ORDER BY seq), FALSE) AS before FROM d)
SELECT vendor_id, product_id, seq, attached FROM l WHERE attached <> before""")
def streamed_presence(spark, sf):
    """A click attaches the device of its user, anything else detaches it."""
    user = F.col("user_id")
    rows, delay, most = _event_feed(spark, sf, (user % 40).cast("int").alias("vendor_id"), (user % 3).cast("int").alias("product_id"), F.when(F.col("event_type") == "click", "add").otherwise("remove").alias("action"))
    found = _fed(spark, rows, lambda d: feeds.presence(d, list(range(30)), "ingest_ts", delay), end=_end(most, 0, 99, "remove"))
    return found.where("product_id <> 99")


@query("""
WITH f AS (SELECT user_id, min(event_id) AS start FROM events GROUP BY user_id)
SELECT CAST(user_id AS VARCHAR) AS stream_id, coalesce(min(event_id) FILTER (event_type = 'purchase' AND event_id <= start + 400), -1) AS seq,
  count(*) FILTER (event_type = 'purchase' AND event_id <= start + 400) = 0 AS timed_out
FROM events JOIN f USING (user_id) GROUP BY user_id""")
def streamed_settled(spark, sf):
    """Events poll their user; a purchase within 400 seconds of the first poll settles it."""
    rows, delay, most = _event_feed(spark, sf, F.col("user_id").cast("string").alias("stream_id"), (F.col("event_type") == "purchase").alias("ready"))
    found = _fed(spark, rows, lambda d: feeds.settled(d, F.col("ready"), 400_000, "ingest_ts", delay), end=_end(most, "end", True))
    return found.where("stream_id <> 'end'").select("stream_id", F.coalesce("seq", F.lit(-1)).alias("seq"), "timed_out")


@query("SELECT CAST(user_id AS VARCHAR) AS stream_id, max(event_id) AS seq, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def streamed_latest(spark, sf):
    """The newest event of each user, kept by the upsert sink."""
    rows, _, _ = _event_feed(spark, sf, F.col("user_id").cast("string").alias("stream_id"), "event_type")
    return _fed(spark, rows, lambda d: feeds.latest(d, ["stream_id"], "seq", ["event_type"]), mode="update", keys=["stream_id"])


@query("SELECT CAST(o_custkey AS VARCHAR) AS stream_id, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS total FROM orders GROUP BY o_custkey")
def streamed_framing(spark, sf):
    """A container an order, cut in two, framed from each customer's live stream; chunks come out of order."""
    key = F.col("o_orderkey")
    whole = F.concat(W.put_uint(F.lit(16), 4), W.put_uint(F.lit(3), 2), W.put_uint(F.lit(0x2001), 2), W.put_uint(key, 4), W.put_uint(key, 4))
    nth = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).cast("long") * 2
    halves = F.array(F.struct((F.col("nth") - 2).alias("seq"), F.substring(whole, 1, 7).alias("data")), F.struct((F.col("nth") - 1).alias("seq"), F.substring(whole, 8, 9).alias("data")))
    numbered = t(spark, sf, "orders").select("o_custkey", "o_orderkey", nth.alias("nth"))
    rows = numbered.select(F.col("o_custkey").cast("string").alias("stream_id"), F.explode(halves).alias("c")).select("stream_id", "c.*")
    rows = rows.withColumn("arrival", F.pmod(F.xxhash64("stream_id", "seq"), F.lit(DELIVERIES)).cast("int"))
    found = _fed(spark, rows, feeds.frame_stream)
    return found.groupBy("stream_id").agg(F.count("*").alias("n"), F.sum(W.get_uint(F.col("body"), 0, 4)).alias("total"))


def _containers_of(orders):
    """The containers of every order: its command, late replies, one of a later transaction, data and answer."""
    key, place = F.col("key"), F.col("place")
    some = lambda when, *places: F.when(when, F.array(*(F.lit(p) for p in places)))
    none = F.array().cast("array<int>")
    places = F.concat(F.array(F.lit(0)), some(key % 4 == 0, 1, 2).when(key % 4 == 1, F.array(*(F.lit(p) for p in range(1, 10)))).otherwise(none),
                      some(key % 11 == 0, 10).otherwise(none), some(F.col("o_orderstatus") == "O", 11).otherwise(none), some(key % 9 != 0, 12).otherwise(none))
    rows = orders.withColumn("key", F.col("o_orderkey").cast("long")).select("o_custkey", "o_orderpriority", "key", F.explode(places).alias("place"))
    command, late, data = place == 0, place.between(1, 9), place == 11
    return rows.select(
        (key * 16 + place).alias("seq"), (F.col("o_custkey") % 50).cast("string").alias("stream_id"), F.when(command, 1).when(data, 2).otherwise(3).alias("typ"),
        F.when(command, 4096 + F.col("o_custkey") % 7).when(data, 0).otherwise(0x2001).cast("int").alias("code"), F.when(late, key - place).when(place == 10, key + 1).otherwise(key).alias("tx_id"),
        F.when(command, F.encode(key.cast("string"), "UTF-8")).when(data, F.encode("o_orderpriority", "UTF-8")).alias("body"), F.lit(None).cast("string").alias("error"))


def _transaction_delivery(orders, most, k):
    """The containers of one delivery, from the orders whose keys may be in it."""
    least, greatest = _keys_of(k, most)
    near = F.col("o_orderkey") >= least // 16 - 1
    if greatest is not None:
        near &= F.col("o_orderkey") <= greatest // 16 + 1
    return _delivered(_containers_of(orders.where(near)), F.col("seq"), most)[0].where(F.col("arrival") == k).drop("arrival")


@query("""
SELECT CAST(o_custkey % 50 AS VARCHAR) AS stream_id, o_orderkey AS tx_id, CAST(4096 + o_custkey % 7 AS INTEGER) AS op, CASE WHEN o_orderstatus = 'O' THEN o_orderpriority END AS data,
  CASE WHEN o_orderkey % 9 <> 0 THEN 8193 ELSE -1 END AS response, CASE o_orderkey % 4 WHEN 0 THEN 2 WHEN 1 THEN 9 ELSE 0 END AS stale,
  CASE WHEN o_orderkey % 11 = 0 THEN 1 ELSE 0 END AS future,
  CASE WHEN o_orderkey % 11 = 0 THEN 'a container of a later transaction' WHEN o_orderkey % 4 = 1 THEN 'too many late replies' WHEN o_orderkey % 9 = 0 THEN 'no response' END AS error
FROM orders""")
def streamed_transactions(spark, sf):
    """Every order is a transaction of its customer group's stream, with late replies and some without an answer."""
    orders = t(spark, sf, "orders")
    n, last = orders.agg(F.count("*"), F.max("o_orderkey")).first()
    most = (last or 0) * 16 + 16
    delay = _delivered(_containers_of(orders), F.col("seq"), most)[1]
    end = _end(most, "end", 1, 1, 1, None, None)
    found = _fed(spark, lambda k: _transaction_delivery(orders, most, k), lambda d: feeds.transactions(d, "ingest_ts", delay, linger_ms=20_000), end=end, count=5 * n)
    text = F.decode(F.col("data"), "UTF-8")
    return found.where("stream_id <> 'end'").select("stream_id", "tx_id", "op", text.alias("data"), F.coalesce("response", F.lit(-1)).alias("response"), F.col("stale").cast("int").alias("stale"), F.col("future").cast("int").alias("future"), "error")


@query("""
SELECT s_suppkey, '"' || s_name || '" ' || CASE s_suppkey % 6 WHEN 1 THEN 'fixed ROM' WHEN 2 THEN 'removable ROM (card)' WHEN 3 THEN 'fixed RAM (internal buffer)' WHEN 4 THEN 'removable RAM (card)' ELSE 'type 0x000' || (s_suppkey % 6) END
  || ', ' || CASE s_nationkey % 4 WHEN 0 THEN 'read-write' WHEN 1 THEN 'read-only' WHEN 2 THEN 'read + delete, no write' ELSE 'access 0x0003' END
  || ', ' || CASE WHEN s_suppkey % 5 = 0 THEN 'capacity unknown' ELSE s_suppkey || ' of ' || (s_suppkey * 10) || ' bytes free' END AS line
FROM supplier""")
def storage_lines(spark, sf):
    key = F.col("s_suppkey")
    line = R.storage_line(key % 6, F.col("s_nationkey") % 4, F.when(key % 5 == 0, -1).otherwise(key * 10), key, F.lit(""), F.col("s_name"))
    return t(spark, sf, "supplier").select("s_suppkey", line.alias("line"))


@query("""
SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_name || '/' ELSE rpad(p_name, CAST(greatest(16, length(p_name)) AS INTEGER), ' ') || ' JPEG           ' || lpad(CAST(p_partkey AS VARCHAR), 8, ' ') || ' bytes  ' || p_size || 'x' || (p_size * 2) END AS line, p_size % 3 <> 0 AS is_image
FROM part""")
def object_lines(spark, sf):
    fmt = F.when(F.col("p_size") % 3 == 0, 0x3001).otherwise(0x3801)
    line = R.object_line(F.col("p_name"), fmt, F.lit("JPEG"), F.col("p_partkey"), F.col("p_size"), F.col("p_size") * 2)
    return t(spark, sf, "part").select("p_partkey", line.alias("line"), R.is_image(fmt).alias("is_image"))


@query("""
SELECT l_orderkey, CAST(count(*) FILTER (l_quantity <> 7) AS INTEGER) AS n, round(min(CASE WHEN l_quantity <> 7 THEN l_quantity / l_linenumber END), 9) AS shortest,
  round(max(CASE WHEN l_quantity <> 7 THEN l_quantity / l_linenumber END), 9) AS longest, coalesce(bool_or(l_quantity = 7), FALSE) AS has_bulb
FROM lineitem GROUP BY l_orderkey""")
def shutter_ladders(spark, sf):
    """Each order's lines as the choices of one descriptor; a quantity of 7 stands for Bulb."""
    wire = F.when(F.col("l_quantity") == 7, F.lit(E.SHUTTER_BULB).cast("long")).otherwise(F.col("l_quantity").cast("long") * 65536 + F.col("l_linenumber"))
    choices = t(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list(wire).alias("choices"))
    ladder = choices.select("l_orderkey", V.shutter_ladder(F.col("choices")).alias("l")).select("l_orderkey", "l.*")
    return ladder.select("l_orderkey", F.size("seconds").alias("n"), F.round(F.get("seconds", F.lit(0)), 9).alias("shortest"), F.round(F.try_element_at("seconds", F.lit(-1)), 9).alias("longest"), "has_bulb")


@query("SELECT o_custkey, count(*) FILTER (o_orderkey % 3 = 1) AS n_waiting FROM orders GROUP BY o_custkey")
def frames_waiting(spark, sf):
    return V.waiting(t(spark, sf, "orders").withColumn("storage_id", F.col("o_orderkey") % 3), ["o_custkey"], 1)


@query("""
SELECT c_custkey, CASE c_nationkey % 4 WHEN 0 THEN 'unknown' WHEN 2 THEN 'USB class 2' WHEN 1 THEN 'still image (PTP)' ELSE 'mass storage' END AS mode, c_nationkey % 4 = 1 AS is_ptp,
  CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE printf('%04x:%04x@0x%08x', c_nationkey, c_custkey % 1000, c_custkey) END AS label
FROM customer WHERE c_nationkey IN (3, 5, 6, 8, 12, 21)""")
def device_modes(spark, sf):
    code = F.col("c_nationkey") % 4
    rows = t(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("vendor_id"), (F.col("c_custkey") % 1000).alias("product_id"), F.col("c_custkey").alias("location"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).otherwise("").alias("serial"), F.when(code == 1, 6).when(code == 3, 8).otherwise(code).alias("interface_class"))
    return V.described(V.of_vendors(rows, [3, 5, 6, 8, 12, 21])).select("c_custkey", "mode", "is_ptp", "label")

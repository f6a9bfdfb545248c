"""Registered queries of the data sources: tables written as bundles and spools, then read back by their own readers."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import wire as W
from ..sources import capture, event_spool, ranges
from .more_queries import _clean, _shared_folder
from .queries import query, t


def _folder(spark, label):
    place = f"{_shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    atexit.register(_clean, spark, place)
    return place


#: Orders of a reply are those of one session (key modulo 8) and one stretch of 512 keys, so at most 64.
SESSION, ORDINAL = "CAST(o_orderkey % 8 AS STRING)", "CAST(o_orderkey DIV 512 + 1 AS INT)"


def _captured(spark, sf):
    """The folder of a capture bundle that holds every order: replies of (order key, customer key) pairs."""
    pair = F.struct("o_orderkey", F.concat(W.put_uint(F.col("o_orderkey"), 4), W.put_uint(F.col("o_custkey"), 4)).alias("raw"))
    replies = t(spark, sf, "orders").groupBy(F.expr(SESSION).alias("session"), F.expr(ORDINAL).alias("ordinal")).agg(F.sort_array(F.collect_list(pair)).alias("pairs"))
    data = F.unhex(F.array_join(F.transform("pairs", lambda p: F.hex(p["raw"])), ""))
    rows = replies.select(
        "session", "ordinal", (F.lit(0x9200) + F.col("ordinal") % 3).alias("op"), F.array(F.size("pairs").cast("long")).alias("params"), F.col("ordinal").cast("long").alias("tx_id"), data.alias("data"),
        F.lit(0).cast("long").alias("sent"), (F.col("ordinal") % 7).cast("long").alias("duration_ms"), F.when(F.col("ordinal") % 5 == 0, "device busy").alias("error"))
    folder = _folder(spark, "bundle")
    capture.write_captures(rows, folder)
    return folder


@query("""
SELECT CAST(o_orderkey % 8 AS VARCHAR) AS session, CAST(o_orderkey // 512 + 1 AS INTEGER) AS ordinal, 8 * count(*) AS length, min(o_orderkey) AS first_order, arg_max(o_custkey, o_orderkey) AS last_customer
FROM orders WHERE (o_orderkey // 512 + 1) % 3 = 1 GROUP BY ALL""")
def captured_replies(spark, sf):
    """Replies of one operation; files of the others are not opened."""
    found = capture.read_captures(spark, _captured(spark, sf)).where("operation = 37377 AND phase = 'in'")
    content = F.col("content")
    last = F.substring(content, F.octet_length(content) - 3, F.lit(4))
    return found.select("session", "ordinal", "length", W.get_uint(content, 0, 4).alias("first_order"), W.get_uint(last, 0, 4).alias("last_customer"))


@query("SELECT o_orderkey, o_custkey FROM orders")
def captured_ranges(spark, sf):
    """Each order's own eight bytes of its reply, by seek and read."""
    folder = _captured(spark, sf)
    place = F.row_number().over(Window.partitionBy("session", "ordinal").orderBy("o_orderkey")) - 1
    orders = t(spark, sf, "orders").select("o_orderkey", F.expr(SESSION).alias("session"), F.expr(ORDINAL).alias("ordinal"))
    name = F.format_string("%s/%s/%03d-op%04X-in.bin", F.lit(folder), F.col("session"), F.col("ordinal"), F.lit(0x9200) + F.col("ordinal") % 3)
    asked = orders.select("o_orderkey", name.alias("path"), (place * 8).cast("long").alias("offset"), F.lit(8).cast("long").alias("length"))
    got = ranges.read_ranges(asked)
    key = W.get_uint(F.col("bytes"), 0, 4)
    return got.where(key == F.col("o_orderkey")).select("o_orderkey", W.get_uint(F.col("bytes"), 4, 4).alias("o_custkey"))


@query("""
SELECT CAST(o_orderkey // 512 + 1 AS INTEGER) AS ordinal, CAST(37376 + (o_orderkey // 512 + 1) % 3 AS INTEGER) AS op, count(DISTINCT o_orderkey % 8) AS replies, 8 * count(*) AS received,
  count(*) AS announced, CASE WHEN (o_orderkey // 512 + 1) % 5 = 0 THEN 'device busy' END AS error
FROM orders GROUP BY ALL""")
def captured_log(spark, sf):
    """What the session logs say of each transaction, all sessions together."""
    log = capture.read_session_log(spark, _captured(spark, sf))
    return log.groupBy("ordinal", "op", "error").agg(F.count("*").alias("replies"), F.sum("received").alias("received"), F.sum(F.get("params", F.lit(0))).alias("announced"))


@query("SELECT CAST(user_id % 8 AS VARCHAR) AS stream_id, event_id AS seq, CASE event_type WHEN 'click' THEN 16386 ELSE 16387 END AS code, user_id AS handle FROM events")
def spooled_events(spark, sf):
    """Events through the polled source: two deliveries, and a stream that stops and goes on between them; transaction ids carry the event ids."""
    event_spool.register(spark)
    events = t(spark, sf, "events")
    rows = events.select((F.col("user_id") % 8).cast("string").alias("stream_id"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "click", 0x4002).otherwise(0x4003).alias("code"), F.col("event_id").alias("tx_id"), F.array("user_id").alias("params"))
    half = (events.agg(F.max("event_id")).first()[0] or 0) // 2
    place = _folder(spark, "spool")
    for part in (F.col("seq") <= half, F.col("seq") > half):
        rows.where(part).repartition("stream_id").sortWithinPartitions("stream_id", "seq").write.format("event_spool").mode("append").save(f"{place}/in")
        stream = spark.readStream.format("event_spool").load(f"{place}/in").drop("ingest_ts")
        stream.writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/ck").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{place}/out").select("stream_id", F.col("tx_id").alias("seq"), "code", F.get("params", F.lit(0)).alias("handle"))

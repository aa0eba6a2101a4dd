"""Packet-shaped views of the provided tables, in Spark and, for the oracles, in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts):
    """Microseconds since 1970 of a timestamp without zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {ts})")


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One packet for each event: sources are users, ports follow the event's key."""
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    value = F.floor("value").cast("int")
    return e.select(
        F.col("event_id").alias("packet_id"), micros("ts").alias("ts_us"),
        F.concat(F.lit("10.0."), F.floor(F.col("user_id") / 250).cast("int").cast("string"), F.lit("."), (F.col("user_id") % 250 + 1).cast("string")).alias("src_ip"),
        F.concat(F.lit("192.168."), (F.col("k") % 4).cast("string"), F.lit("."), (value % 16 + 1).cast("string")).alias("dst_ip"),
        (40000 + F.col("event_id") % 1000).cast("int").alias("src_port"), (20 + F.col("k")).alias("dst_port"),
        F.when(F.col("k") % 10 == 0, "UDP").when(F.col("k") % 10 == 1, "ICMP").otherwise("TCP").alias("protocol"),
        F.expr("CASE event_type WHEN 'view' THEN 2 WHEN 'click' THEN 16 WHEN 'purchase' THEN 24 WHEN 'signup' THEN 1 WHEN 'error' THEN 4 END").alias("tcp_flags"),
        (60 + value).alias("length"), "k", "user_id", "event_type",
    )


PACKETS = """
packets AS (
  SELECT event_id AS packet_id, epoch_us(ts) AS ts_us,
    '10.0.' || CAST(CAST(floor(user_id / 250) AS INT) AS VARCHAR) || '.' || CAST(user_id % 250 + 1 AS VARCHAR) AS src_ip,
    '192.168.' || CAST(k % 4 AS VARCHAR) || '.' || CAST(CAST(floor(value) AS INT) % 16 + 1 AS VARCHAR) AS dst_ip,
    CAST(40000 + event_id % 1000 AS INT) AS src_port, 20 + k AS dst_port,
    CASE k % 10 WHEN 0 THEN 'UDP' WHEN 1 THEN 'ICMP' ELSE 'TCP' END AS protocol,
    CASE event_type WHEN 'view' THEN 2 WHEN 'click' THEN 16 WHEN 'purchase' THEN 24 WHEN 'signup' THEN 1 WHEN 'error' THEN 4 END AS tcp_flags,
    60 + CAST(floor(value) AS INT) AS length, k, user_id, event_type
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)
)"""


#: Service port of each of eight servers.
PORTS = (22, 21, 80, 4444, 443, 8080, 3306, 25)
#: Payloads by server, direction (c2s, s2c) and event type, so that every kind of session occurs.
PAYLOADS = {
    ("22", "c2s", "click"): "SSH-2.0-client", ("22", "s2c", "view"): "SSH-2.0-server", ("22", "s2c", "click"): "SSH-2.0-server",
    ("21", "s2c", "view"): "220 (vsFTPd 3.0.3)", ("21", "c2s", "click"): "PASS secret", ("21", "s2c", "click"): "530 Login incorrect",
    ("80", "c2s", "click"): "GET /k HTTP/1.1", ("80", "s2c", "view"): "HTTP/1.1 200 OK", ("4444", "c2s", "view"): "whoami; /bin/sh -i", ("4444", "s2c", "view"): "uid=0 root", ("4444", "s2c", "click"): "ls",
    ("443", "c2s", "view"): "hello", ("8080", "c2s", "view"): "POST /k HTTP/1.1", ("8080", "c2s", "click"): "GET /k HTTP/1.1", ("3306", "c2s", "view"): "bash -c id", ("3306", "s2c", "view"): "ok",
}


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TCP segments of a connection for each user and server, in both directions, with payloads."""
    p = packets(spark, sf_dir)
    port = F.element_at(F.lit(list(PORTS)), F.col("k") % 8 + 1)
    client = F.concat(F.lit("10.0."), F.floor(F.col("user_id") / 250).cast("int").cast("string"), F.lit("."), (F.col("user_id") % 250 + 1).cast("string"))
    server = F.when(F.col("k") % 8 == 3, F.concat(F.lit("93.184.216."), (F.col("user_id") % 4 + 1).cast("string"))).otherwise(F.concat(F.lit("192.168.0."), (F.col("k") % 8 + 1).cast("string")))
    p = p.select("packet_id", "ts_us", "event_type", "k", port.alias("service_port"), client.alias("client_ip"), server.alias("server_ip"), (40000 + F.col("user_id") % 1000).cast("int").alias("client_port"), F.when(F.col("packet_id") % 2 == 0, "c2s").otherwise("s2c").alias("dir"))
    text = F.lit("")
    for (q, d, e), v in PAYLOADS.items():
        text = F.when((F.col("service_port") == int(q)) & (F.col("dir") == d) & (F.col("event_type") == e), F.lit(v)).otherwise(text)
    text = F.replace(text, F.lit("/k "), F.concat(F.lit("/"), F.col("k").cast("string"), F.lit(" ")))
    flags = F.expr("CASE event_type WHEN 'purchase' THEN 2 WHEN 'signup' THEN 17 WHEN 'error' THEN 4 ELSE 24 END")
    return p.withColumn("payload", text).withColumn("tcp_flags", flags)


_CASES = " ".join(f"WHEN service_port = {q} AND dir = '{d}' AND event_type = '{e}' THEN '{v}'" for (q, d, e), v in PAYLOADS.items())
SEGMENTS = f"""
{PACKETS}, segments AS (
  SELECT packet_id, ts_us, event_type, k, service_port, client_ip, server_ip, client_port, dir,
    replace(CASE {_CASES} ELSE '' END, '/k ', '/' || CAST(k AS VARCHAR) || ' ') AS payload,
    CASE event_type WHEN 'purchase' THEN 2 WHEN 'signup' THEN 17 WHEN 'error' THEN 4 ELSE 24 END AS tcp_flags
  FROM (
    SELECT packet_id, ts_us, event_type, k, CAST([{", ".join(map(str, PORTS))}][k % 8 + 1] AS INT) AS service_port, src_ip AS client_ip,
      CASE WHEN k % 8 = 3 THEN '93.184.216.' || CAST(user_id % 4 + 1 AS VARCHAR) ELSE '192.168.0.' || CAST(k % 8 + 1 AS VARCHAR) END AS server_ip,
      CAST(40000 + user_id % 1000 AS INT) AS client_port, CASE WHEN packet_id % 2 = 0 THEN 'c2s' ELSE 's2c' END AS dir
    FROM packets)
)"""

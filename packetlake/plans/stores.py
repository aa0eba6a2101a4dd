"""Queries over alerts, incidents and the other stored relations."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from packetlake.operators import alerts as A
from packetlake.operators import reassembly, store
from packetlake.plans.base import DAY, query
from packetlake.plans.detection import anchors_sql
from packetlake.plans.views import PACKETS, packets, table

_SEVERITY = "CASE k % 5 WHEN 0 THEN 'INFO' WHEN 1 THEN 'LOW' WHEN 2 THEN 'MEDIUM' WHEN 3 THEN 'HIGH' ELSE 'CRITICAL' END"
_ALERT = """SELECT packet_id, packet_id AS alert_id, ts_us, CAST(90001 + k % 17 AS BIGINT) AS sid, src_ip, '192.168.' || CAST(k % 4 AS {s}) || '.1' AS dst_ip, src_port, dst_port, protocol, {severity} AS severity, CAST(k AS INT) AS confidence, event_type AS category,
  'Detection ' || event_type || ' on port ' || CAST(dst_port AS {s}) AS message, 'distinct_targets=' || CAST(length % 50 AS {s}) AS evidence FROM {p} WHERE event_type IN ('error', 'signup') OR protocol = 'ICMP'"""


def alerts(spark, sf_dir):
    packets(spark, sf_dir).createOrReplaceTempView("packetlake_packets")
    return spark.sql(_ALERT.format(s="STRING", severity=_SEVERITY, p="packetlake_packets"))


ALERTS = f"{PACKETS}, alerts AS ({_ALERT.format(s='VARCHAR', severity=_SEVERITY, p='packets')})"


@query(f"""
WITH {ALERTS}, f AS (SELECT *, sha256('1|' || sid || '|1|' || src_ip || '|' || dst_ip || '|' || dst_port || '|' || protocol || '|||' || evidence || '|' || message) AS fingerprint FROM alerts)
SELECT fingerprint, min(ts_us) AS first_us, max(ts_us) AS last_us, count(*) AS occurrences, arg_max(packet_id, (ts_us, packet_id)) AS packet_id, any_value(sid) AS sid FROM f GROUP BY fingerprint""")
def alert_dedup(spark, sf_dir):
    a = alerts(spark, sf_dir)
    return A.deduplicated(a.withColumn("fingerprint", A.fingerprint(a.columns)), keep=("sid",))


@query(anchors_sql(f"SELECT packet_id, ts_us, src_ip, CAST(90001 + k % 17 AS BIGINT) % 5 AS sid FROM packets WHERE event_type IN ('error', 'signup') OR protocol = 'ICMP'", "src_ip, sid", 4 * DAY, "packet_id, anchor AS ts_us, src_ip, sid"))
def alert_episodes(spark, sf_dir):
    a = alerts(spark, sf_dir).select("packet_id", "ts_us", "src_ip", (F.col("sid") % 5).alias("sid"))
    return A.episodes(a, ["src_ip", "sid"], 4 * DAY)


@query(f"""
WITH {ALERTS}, r AS (SELECT alert_id, severity, confidence, CAST(least(100, CASE severity WHEN 'INFO' THEN 0 WHEN 'LOW' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'HIGH' THEN 3 ELSE 4 END * 20 + confidence // 2) AS INT) AS risk FROM alerts)
SELECT *, CAST(CASE WHEN risk > 0 THEN greatest(1, 5 - risk // 25) ELSE 3 END AS INT) AS priority FROM r""")
def alert_risk_priority(spark, sf_dir):
    return A.scored(alerts(spark, sf_dir).select("alert_id", "severity", "confidence"))


_CUT = f"""
{ALERTS}, c AS (SELECT *, CASE WHEN ts_us - lag(ts_us) OVER (PARTITION BY category, src_ip, dst_ip, protocol ORDER BY ts_us, packet_id) > {5 * DAY} THEN 1 ELSE 0 END AS fresh FROM alerts WHERE severity <> 'INFO'),
members AS (SELECT *, 1 + sum(fresh) OVER (PARTITION BY category, src_ip, dst_ip, protocol ORDER BY ts_us, packet_id ROWS UNBOUNDED PRECEDING) AS island FROM c),
m2 AS (SELECT *, sha256(category || '|' || src_ip || '|' || dst_ip || '|' || protocol || '|' || CAST(island AS VARCHAR)) AS incident_id FROM members),
inc AS (SELECT incident_id, category, src_ip, dst_ip, protocol, min(ts_us) AS first_us, max(ts_us) AS last_us, count(*) AS alert_count,
  CASE max(CASE severity WHEN 'LOW' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'HIGH' THEN 3 ELSE 4 END) WHEN 1 THEN 'LOW' WHEN 2 THEN 'MEDIUM' WHEN 3 THEN 'HIGH' ELSE 'CRITICAL' END AS severity FROM m2 GROUP BY incident_id, category, src_ip, dst_ip, protocol)"""
NOW = 1706400000000000


def _members(spark, sf_dir):
    return A.incident_alerts(alerts(spark, sf_dir), 5 * DAY)


@query(f"WITH {_CUT} SELECT * FROM inc")
def incident_islands(spark, sf_dir):
    return A.incidents(_members(spark, sf_dir)).drop("sids")


@query(f"WITH {_CUT} SELECT incident_id, CASE WHEN last_us < {NOW - 5 * DAY} THEN 'RESOLVED' ELSE 'OPEN' END AS status, severity FROM inc")
def incident_status(spark, sf_dir):
    return A.incidents(_members(spark, sf_dir), NOW, 5 * DAY).select("incident_id", "status", "severity")


@query(f"WITH {_CUT} SELECT incident_id, m2.alert_id, m2.sid, m2.message, count(*) OVER (PARTITION BY incident_id) AS total FROM m2")
def incident_drilldown(spark, sf_dir):
    bridge = _members(spark, sf_dir).select("incident_id", "alert_id")
    rows = store.drill_down(bridge, alerts(spark, sf_dir))
    return rows.select("incident_id", "alert_id", "sid", "message", F.count("*").over(Window.partitionBy("incident_id")).alias("total"))


@query(f"WITH {ALERTS} SELECT count(*) FILTER (severity = 'CRITICAL') AS critical, count(*) FILTER (severity = 'HIGH') AS high, count(*) FILTER (severity = 'MEDIUM') AS medium, count(*) FILTER (severity = 'LOW') AS low, count(*) AS total FROM alerts")
def severity_counts(spark, sf_dir):
    n = lambda s: F.count_if(F.col("severity") == s).alias(s.lower())
    return alerts(spark, sf_dir).agg(n("CRITICAL"), n("HIGH"), n("MEDIUM"), n("LOW"), F.count("*").alias("total"))


@query(f"WITH {ALERTS} SELECT alert_id, ts_us, sid, message FROM alerts WHERE contains(lower(message), 'port 4') OR contains(lower(src_ip), 'port 4') OR contains(lower(dst_ip), 'port 4') ORDER BY ts_us DESC, alert_id DESC LIMIT 50 OFFSET 50")
def alert_search_page(spark, sf_dir):
    rows = store.Filter(term="Port 4").apply(alerts(spark, sf_dir))
    return store.paginate(rows, [F.desc("ts_us"), F.desc("alert_id")], 2).select("alert_id", "ts_us", "sid", "message")


@query(f"WITH {PACKETS} SELECT packet_id, ts_us, src_ip, dst_port FROM packets WHERE protocol = 'UDP' AND (contains(src_ip, '50') OR contains(dst_ip, '50') OR src_port = 50 OR dst_port = 50 OR length = 50) ORDER BY ts_us DESC, packet_id DESC LIMIT 20")
def traffic_search_page(spark, sf_dir):
    rows = store.Filter(equal={"protocol": "udp"}, term="50", fields=store.TRAFFIC_FIELDS, numbers=("src_port", "dst_port", "length")).apply(packets(spark, sf_dir))
    return store.paginate(rows, [F.desc("ts_us"), F.desc("packet_id")], 1, 20).select("packet_id", "ts_us", "src_ip", "dst_port")


@query(f"WITH {ALERTS} SELECT alert_id, sid, evidence FROM alerts WHERE NOT (sid = 90002 AND CAST(regexp_extract(evidence, 'distinct_targets=([0-9]+)', 1) AS BIGINT) < 30)")
def purge_unjustified(spark, sf_dir):
    a = alerts(spark, sf_dir)
    return store.purge(a, a.select("alert_id"), store.unjustified(a, 90002, "distinct_targets=([0-9]+)", 30))[0].select("alert_id", "sid", "evidence")


@query(f"""
WITH {ALERTS} SELECT (SELECT count(*) FROM packets) AS packets, (SELECT count(*) FROM alerts) AS alerts, (SELECT count(DISTINCT ip) FROM (SELECT src_ip AS ip FROM packets UNION ALL SELECT dst_ip FROM packets)) AS unique_ips,
  (SELECT count(*) FROM (SELECT DISTINCT src_ip, src_port, dst_ip, dst_port, protocol FROM packets)) AS unique_flows, (SELECT CAST(sum(length) AS BIGINT) FROM packets) AS bytes""")
def overview_stats(spark, sf_dir):
    p = packets(spark, sf_dir)
    counts = p.agg(F.count("*").alias("packets"), F.count_distinct("src_ip", "src_port", "dst_ip", "dst_port", "protocol").alias("unique_flows"), F.sum(F.col("length").cast("bigint")).alias("bytes"))
    ips = p.select(F.explode(F.array("src_ip", "dst_ip")).alias("ip")).agg(F.count_distinct("ip").alias("unique_ips"))
    n = alerts(spark, sf_dir).agg(F.count("*").alias("alerts"))
    one = F.lit(1).alias("one")  # rows of one figure each, side by side
    return counts.select("*", one).join(ips.select("*", one), "one").join(n.select("*", one), "one").drop("one")


@query("SELECT event_type AS name, event_id AS id, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def latest_statistic(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("name"), F.col("event_id").alias("id"), "value", "ts")
    return store.latest(e, time="ts").drop("ts")


@query(r"""
WITH r AS (SELECT quality = 0 AS e, regexp_matches(text, '(!!|\*\*\*|\|)') AS o FROM labels JOIN documents USING (doc_id)), c AS (SELECT count(*) FILTER (e AND o) AS tp, count(*) FILTER (NOT e AND o) AS fp, count(*) FILTER (e AND NOT o) AS fn, count(*) FILTER (NOT e AND NOT o) AS tn FROM r),
d AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall FROM c) SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM d""")
def evaluation_metrics(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", F.col("text").rlike(r"(!!|\*\*\*|\|)").alias("observed")), "doc_id")
    return A.confusion(rows, F.col("quality") == 0, F.col("observed"))


@query("""
WITH f AS (SELECT conv_id, turn, text, turn = max(turn) OVER (PARTITION BY conv_id) AS last, min(turn) OVER (PARTITION BY conv_id) AS low FROM conversations), k AS (SELECT * FROM f WHERE NOT (conv_id % 3 = 0 AND turn = low + 1))
SELECT conv_id, string_agg(text, '' ORDER BY turn) AS data, CAST(count(*) AS INT) AS fragments FROM f WHERE conv_id NOT IN (SELECT conv_id FROM f WHERE conv_id % 3 = 0 AND turn = low + 1) GROUP BY conv_id""")
def fragment_reassembly(spark, sf_dir):
    w = Window.partitionBy("conv_id")
    c = table(spark, sf_dir, "conversations")
    f = c.withColumns({"last": F.col("turn") == F.max("turn").over(w), "low": F.min("turn").over(w), "offset": F.coalesce(F.sum(F.length("text")).over(w.orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "data": F.col("text")})
    return reassembly.fragments(f.where("NOT (conv_id % 3 = 0 AND turn = low + 1)"), ["conv_id"])


@query("""
WITH t AS (SELECT conv_id, string_agg(text, '' ORDER BY turn) AS text, count(*) AS n FROM conversations GROUP BY conv_id) SELECT conv_id, sha256(text) AS sha256, CAST(2 * n AS INT) AS segments, CAST(n AS INT) AS retransmissions FROM t""")
def tcp_reassembly(spark, sf_dir):
    """Every turn is a segment sent twice, and turns arrive in the order of their texts."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf_dir, "conversations").withColumn("payload", F.encode("text", "UTF-8"))
    c = c.withColumn("tcp_sequence", 1000 + F.coalesce(F.sum(F.length("payload")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    c = c.withColumn("packet_id", F.explode(F.array(F.xxhash64("text", "turn"), F.xxhash64("turn", "text"))))
    return reassembly.tcp_streams(c, ["conv_id"]).select("conv_id", F.sha2("data", 256).alias("sha256"), "segments", "retransmissions")



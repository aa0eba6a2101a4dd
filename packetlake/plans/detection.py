"""Queries of the packet detectors; events are sparse, so windows are days and thresholds small."""

from __future__ import annotations

from pyspark.sql import functions as F

from packetlake.functions import net
from packetlake.operators import detectors as D
from packetlake.operators import windows as W
from packetlake.plans.base import DAY, query
from packetlake.plans.views import PACKETS, packets, table


def _edge_sql(source: str, keys: str, n: str, threshold: int, columns: str) -> str:
    """Rising edge of the count ``n`` over ``source``."""
    return f"""
WITH {PACKETS}, counted AS (SELECT *, {n} AS n FROM ({source})),
edged AS (SELECT *, lag(n) OVER (PARTITION BY {keys} ORDER BY ts_us, packet_id) AS before FROM counted)
SELECT {columns} FROM edged WHERE n >= {threshold} AND (before IS NULL OR before < {threshold})"""


def _range(keys: str, days: int) -> str:
    return f"OVER (PARTITION BY {keys} ORDER BY ts_us RANGE BETWEEN {days * DAY} PRECEDING AND CURRENT ROW)"


PROBE = """CASE WHEN tcp_flags & 3 = 3 THEN NULL WHEN tcp_flags & 2 = 2 AND tcp_flags & 20 = 0 THEN 'syn' WHEN tcp_flags & 63 = 16 THEN 'ack' WHEN tcp_flags & 63 = 17 THEN 'maimon'
  WHEN tcp_flags & 63 = 1 THEN 'fin' WHEN tcp_flags & 63 = 0 THEN 'null' WHEN tcp_flags & 63 = 41 THEN 'xmas' END"""


@query(f"""
WITH {PACKETS}
SELECT packet_id, ts_us, protocol, src_ip || ':' || src_port AS source, dst_ip || ':' || dst_port AS destination, length,
  CASE tcp_flags WHEN 2 THEN 'S' WHEN 16 THEN 'A' WHEN 24 THEN 'PA' WHEN 1 THEN 'F' WHEN 4 THEN 'R' END AS flags
FROM packets""")
def packet_projection(spark, sf_dir):
    p = packets(spark, sf_dir)
    return p.select("packet_id", "ts_us", "protocol", net.endpoint(F.col("src_ip"), F.col("src_port")).alias("source"), net.endpoint(F.col("dst_ip"), F.col("dst_port")).alias("destination"), "length", net.flag_letters(F.col("tcp_flags")).alias("flags"))


@query(f"""
WITH {PACKETS}
SELECT count(*) AS packets, count(*) FILTER (protocol = 'TCP') AS tcp, count(*) FILTER (protocol = 'UDP') AS udp, count(*) FILTER (protocol = 'ICMP') AS icmp, CAST(sum(length) AS BIGINT) AS bytes,
  count(*) FILTER (protocol = 'TCP' AND tcp_flags & 2 = 2) AS syn FROM packets""")
def protocol_counters(spark, sf_dir):
    is_ = lambda x: F.count_if(F.col("protocol") == x)
    return packets(spark, sf_dir).agg(F.count("*").alias("packets"), is_("TCP").alias("tcp"), is_("UDP").alias("udp"), is_("ICMP").alias("icmp"), F.sum(F.col("length").cast("bigint")).alias("bytes"), F.count_if((F.col("protocol") == "TCP") & net.has(F.col("tcp_flags"), net.SYN)).alias("syn"))


#: Flag bytes of many kinds, from the events' keys.
FLAG_BYTES = "CAST((k * 7 + packet_id) % 64 AS INT)"


@query(f"WITH {PACKETS} SELECT packet_id, tcp_flags, {PROBE} AS probe FROM (SELECT packet_id, {FLAG_BYTES} AS tcp_flags FROM packets)")
def probe_class(spark, sf_dir):
    p = packets(spark, sf_dir).select("packet_id", F.expr(FLAG_BYTES).alias("tcp_flags"))
    return p.withColumn("probe", net.probe_class(F.col("tcp_flags")))


ADDRESS = "CAST((c_custkey * 37) % 224 AS {s}) || '.' || CAST((c_custkey * 11) % 256 AS {s}) || '.' || CAST(c_nationkey % 4 AS {s}) || '.' || CAST(c_custkey % 256 AS {s})"
_LONG = "CAST(split_part({c}, '.', 1) AS BIGINT) * 16777216 + CAST(split_part({c}, '.', 2) AS BIGINT) * 65536 + CAST(split_part({c}, '.', 3) AS BIGINT) * 256 + CAST(split_part({c}, '.', 4) AS BIGINT)"
_LOCAL = [(0, 16777215), (167772160, 184549375), (1681915904, 1686110207), (2130706432, 2147483647), (2851995648, 2852061183), (2886729728, 2887778303), (3221225472, 3221225727), (3221225984, 3221226239), (3232235520, 3232301055), (3323068416, 3323199487), (3325256704, 3325256959), (3405803776, 3405804031), (3758096384, 4294967295)]


def _private_sql(c: str) -> str:
    n = _LONG.format(c=c)
    return "(" + " OR ".join(f"{n} BETWEEN {a} AND {b}" for a, b in _LOCAL) + ")"


@query(f"""
SELECT c_custkey, dst_ip, CASE WHEN {_private_sql('src_ip')} AND {_private_sql('dst_ip')} AND regexp_replace(src_ip, '\\.[0-9]+$', '') = regexp_replace(dst_ip, '\\.[0-9]+$', '') THEN 'local'
  WHEN {_private_sql('dst_ip')} THEN 'private' ELSE 'public' END AS scope
FROM (SELECT c_custkey, {ADDRESS.format(s='VARCHAR')} AS dst_ip, '10.11.' || CAST(c_nationkey % 4 AS VARCHAR) || '.9' AS src_ip FROM customer)""")
def target_scope(spark, sf_dir):
    c = table(spark, sf_dir, "customer").selectExpr("c_custkey", f"{ADDRESS.format(s='STRING')} AS dst_ip", "'10.11.' || CAST(c_nationkey % 4 AS STRING) || '.9' AS src_ip")
    return c.select("c_custkey", "dst_ip", net.target_scope(F.col("src_ip"), F.col("dst_ip")).alias("scope"))


@query(f"""
WITH {PACKETS}
SELECT packet_id, src_ip, dst_ip, src_ip LIKE '10.0.1.%' AS in_a, {_LONG.format(c='src_ip')} BETWEEN 167772160 AND 167772175 AS in_b FROM packets
WHERE {_LONG.format(c='dst_ip')} BETWEEN 3232235520 AND 3232236031""")
def cidr_filter(spark, sf_dir):
    p = packets(spark, sf_dir).where(net.in_cidr(F.col("dst_ip"), "192.168.0.0/23"))
    return p.select("packet_id", "src_ip", "dst_ip", net.in_cidr(F.col("src_ip"), "10.0.1.0/24").alias("in_a"), net.in_cidr(F.col("src_ip"), "10.0.0.0/28").alias("in_b"))


@query(_edge_sql(f"SELECT *, {PROBE} AS probe FROM packets WHERE protocol = 'TCP' AND ({PROBE}) NOT IN ('ack', 'maimon')", "src_ip, probe", f"count(DISTINCT dst_port) {_range('src_ip, probe', 7)}", 4, "packet_id, ts_us, src_ip, probe, n"))
def port_scan(spark, sf_dir):
    return D.port_scan(packets(spark, sf_dir), 7 * DAY, 4, keys=("src_ip",)).select("packet_id", "ts_us", "src_ip", "probe", "n")


@query(_edge_sql("SELECT * FROM packets WHERE protocol = 'UDP' AND src_port NOT IN (53, 67, 68, 123, 161)", "src_ip", f"count(DISTINCT dst_port) {_range('src_ip', 10)}", 3, "packet_id, ts_us, src_ip, n"))
def udp_scan(spark, sf_dir):
    return D.udp_scan(packets(spark, sf_dir), 10 * DAY, 3, keys=("src_ip",)).select("packet_id", "ts_us", "src_ip", "n")


@query(f"""
WITH {PACKETS}, probes AS (SELECT packet_id, ts_us, src_ip, '-' AS dst_ip, dst_port, false AS answer FROM packets WHERE protocol = 'TCP' AND tcp_flags = 16),
answers AS (SELECT r.packet_id, r.ts_us, r.src_ip, '-' AS dst_ip, r.dst_port, true AS answer FROM packets r WHERE protocol = 'TCP' AND tcp_flags = 4
  AND EXISTS (SELECT 1 FROM probes p WHERE p.src_ip = r.src_ip AND p.dst_port = r.dst_port AND p.ts_us BETWEEN r.ts_us - {20 * DAY} AND r.ts_us)),
both_ AS (SELECT *, CASE WHEN NOT answer THEN dst_port END AS port FROM (SELECT * FROM probes UNION ALL SELECT * FROM answers)),
counted AS (SELECT *, count(DISTINCT port) {_range('src_ip', 20)} AS n, count(*) FILTER (answer) {_range('src_ip', 20)} AS answers FROM both_),
edged AS (SELECT *, lag(CASE WHEN answers > 0 THEN n ELSE 0 END) OVER (PARTITION BY src_ip ORDER BY ts_us, packet_id) AS before FROM counted)
SELECT packet_id, ts_us, src_ip, n, answers FROM edged WHERE answers > 0 AND n >= 3 AND (before IS NULL OR before < 3)""")
def ack_scan_with_response(spark, sf_dir):
    p = packets(spark, sf_dir).where("protocol = 'TCP'").withColumn("dst_ip", F.lit("-"))
    return D.ack_scan(p.where("tcp_flags = 16"), p.where("tcp_flags = 4"), 20 * DAY, 3).select("packet_id", "ts_us", "src_ip", "n", "answers")


_ANSWER = "CASE WHEN protocol = 'ICMP' THEN 'icmp_unreachable' WHEN protocol = 'TCP' AND tcp_flags = 4 THEN 'rst' WHEN protocol = 'TCP' AND tcp_flags = 24 THEN 'syn_ack' END"


@query(f"""
WITH {PACKETS}, seen AS (SELECT packet_id, ts_us, src_ip, dst_port % 8 AS dst_port, CASE WHEN protocol = 'TCP' AND tcp_flags = 16 THEN 'probe' ELSE {_ANSWER} END AS kind FROM packets),
both_ AS (SELECT * FROM seen s WHERE kind = 'probe' OR (kind IS NOT NULL AND EXISTS (SELECT 1 FROM seen p WHERE p.kind = 'probe' AND p.src_ip = s.src_ip AND p.dst_port = s.dst_port AND p.ts_us BETWEEN s.ts_us - {20 * DAY} AND s.ts_us))),
counted AS (SELECT *, count(DISTINCT CASE WHEN kind = 'probe' THEN dst_port END) {_range('src_ip', 20)} AS n, count(DISTINCT CASE WHEN kind = 'syn_ack' THEN dst_port END) {_range('src_ip', 20)} AS syn_ack,
  count(DISTINCT CASE WHEN kind = 'rst' THEN dst_port END) {_range('src_ip', 20)} AS rst, count(DISTINCT CASE WHEN kind = 'icmp_unreachable' THEN dst_port END) {_range('src_ip', 20)} AS icmp_unreachable FROM both_)
SELECT packet_id, ts_us, src_ip, dst_port, n, syn_ack, rst, icmp_unreachable FROM counted WHERE kind = 'probe'""")
def scan_responses(spark, sf_dir):
    p = packets(spark, sf_dir).withColumn("dst_port", F.col("dst_port") % 8).withColumn("kind", F.expr(_ANSWER))
    return D.scan_responses(p.where("protocol = 'TCP' AND tcp_flags = 16"), p.where("kind IS NOT NULL"), 20 * DAY, ("src_ip",))


_SWEEP = "SELECT *, CASE WHEN protocol = 'ICMP' THEN 'echo' ELSE CAST(dst_port AS VARCHAR) END AS signature FROM packets WHERE protocol = 'ICMP' OR (protocol = 'TCP' AND tcp_flags & 22 = 2)"


@query(_edge_sql(_SWEEP, "src_ip, protocol, signature", f"count(DISTINCT dst_ip) {_range('src_ip, protocol, signature', 7)}", 3, "packet_id, ts_us, src_ip, protocol, signature, 'private' AS scope, n"))
def host_sweep(spark, sf_dir):
    return D.host_sweep(packets(spark, sf_dir), 7 * DAY, 3).select("packet_id", "ts_us", "src_ip", "protocol", "signature", "scope", "n")


@query(f"WITH {PACKETS} SELECT packet_id, ts_us, src_ip, dst_ip FROM packets WHERE protocol = 'ICMP'")
def icmp_visibility(spark, sf_dir):
    return D.icmp_visibility(packets(spark, sf_dir)).select("packet_id", "ts_us", "src_ip", "dst_ip")


@query(_edge_sql("SELECT packet_id, ts_us, src_ip, '-' AS dst_ip, protocol FROM packets WHERE protocol = 'ICMP'", "src_ip, dst_ip, protocol", f"count(*) {_range('src_ip, dst_ip, protocol', 5)}", 3, "packet_id, ts_us, src_ip, n"))
def icmp_flood(spark, sf_dir):
    return D.icmp_flood(packets(spark, sf_dir).withColumn("dst_ip", F.lit("-")), 5 * DAY, 3).select("packet_id", "ts_us", "src_ip", "n")


_QNAME = "CASE WHEN event_type = 'error' THEN NULL ELSE 'host' || CAST(k % 10 AS {s}) || '.example' END"


@query(_edge_sql(f"SELECT packet_id, ts_us, src_ip, {_QNAME.format(s='VARCHAR')} AS qname FROM packets WHERE k < 30", "src_ip", f"coalesce(nullif(count(DISTINCT qname) {_range('src_ip', 7)}, 0), count(*) {_range('src_ip', 7)})", 3, "packet_id, ts_us, src_ip, n"))
def dns_rate(spark, sf_dir):
    q = packets(spark, sf_dir).where("k < 30").withColumn("qname", F.expr(_QNAME.format(s="STRING")))
    return D.dns_rate(q, 7 * DAY, 3).select("packet_id", "ts_us", "src_ip", "n")


@query(_edge_sql("SELECT packet_id, ts_us, src_ip, '-' AS dst_ip, dst_port % 4 AS dst_port FROM packets WHERE protocol = 'TCP' AND tcp_flags IN (1, 4)", "src_ip, dst_ip, dst_port", f"count(*) {_range('src_ip, dst_ip, dst_port', 7)}", 2, "packet_id, ts_us, src_ip, dst_port, n"))
def connection_failures(spark, sf_dir):
    p = packets(spark, sf_dir).withColumn("dst_ip", F.lit("-")).withColumn("dst_port", F.col("dst_port") % 4)
    return D.connection_failures(p, 7 * DAY, 2).select("packet_id", "ts_us", "src_ip", "dst_port", "n")


@query(f"WITH {PACKETS} SELECT packet_id, ts_us, src_ip, dst_ip, tcp_flags FROM (SELECT packet_id, ts_us, src_ip, dst_ip, protocol, {FLAG_BYTES} AS tcp_flags FROM packets) WHERE protocol = 'TCP' AND tcp_flags & 3 = 3")
def invalid_flags(spark, sf_dir):
    p = packets(spark, sf_dir).withColumn("tcp_flags", F.expr(FLAG_BYTES))
    return D.invalid_flags(p).select("packet_id", "ts_us", "src_ip", "dst_ip", "tcp_flags")


@query(f"""
WITH {PACKETS}, syns AS (SELECT packet_id, ts_us, src_ip, k % 2 AS dst_port, k % 5 AS seq FROM packets WHERE event_type = 'view'),
answered AS (SELECT s.*, (SELECT min(a.ts_us) FROM packets a WHERE a.event_type = 'click' AND a.src_ip = s.src_ip AND a.k % 2 = s.dst_port AND a.k % 5 = s.seq AND a.ts_us > s.ts_us) AS at FROM syns s),
counted AS (SELECT *, (SELECT count(*) FROM answered b WHERE b.src_ip = a.src_ip AND b.dst_port = a.dst_port AND b.ts_us BETWEEN a.ts_us - {5 * DAY} AND a.ts_us AND (b.at IS NULL OR b.at > a.ts_us)) AS n FROM answered a),
edged AS (SELECT *, lag(n) OVER (PARTITION BY src_ip, dst_port ORDER BY ts_us, packet_id) AS before FROM counted)
SELECT packet_id, ts_us, src_ip, dst_port, n FROM edged WHERE n >= 3 AND (before IS NULL OR before < 3)""")
def syn_flood(spark, sf_dir):
    p = packets(spark, sf_dir).select("packet_id", "ts_us", "src_ip", (F.col("k") % 2).alias("dst_port"), (F.col("k") % 5).alias("seq"), "event_type")
    hits = D.syn_flood(p.where("event_type = 'view'"), p.where("event_type = 'click'"), ["src_ip", "dst_port"], "seq", 5 * DAY, 3)
    return hits.select("packet_id", "ts_us", "src_ip", "dst_port", "n")


def anchors_sql(rows: str, keys: str, window: int, columns: str) -> str:
    """Openers of windows, by recursion along each key's rows."""
    on = " AND ".join(f"o.{k.strip()} = r.{k.strip()}" for k in keys.split(","))
    names = ", ".join(f"o.{k.strip()}" for k in keys.split(","))
    return f"""
WITH RECURSIVE {PACKETS}, o AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY ts_us, packet_id) AS i FROM ({rows})),
r AS (SELECT {names}, o.i, o.packet_id, o.ts_us AS anchor, true AS opens FROM o WHERE o.i = 1
  UNION ALL SELECT {names}, o.i, o.packet_id, CASE WHEN o.ts_us - r.anchor > {window} THEN o.ts_us ELSE r.anchor END, o.ts_us - r.anchor > {window} FROM r JOIN o ON {on} AND o.i = r.i + 1)
SELECT {columns} FROM r WHERE opens"""


@query(f"""
WITH {PACKETS}, fails AS (SELECT packet_id, ts_us, src_ip FROM packets WHERE protocol = 'TCP' AND tcp_flags & 5 <> 0),
counted AS (SELECT *, count(*) {_range('src_ip', 2)} AS n, CASE WHEN ts_us - lag(ts_us) OVER (PARTITION BY src_ip ORDER BY ts_us, packet_id) > {2 * DAY} THEN 1 ELSE 0 END AS fresh FROM fails),
cut AS (SELECT *, 1 + sum(fresh) OVER (PARTITION BY src_ip ORDER BY ts_us, packet_id ROWS UNBOUNDED PRECEDING) AS island FROM counted),
hot AS (SELECT *, row_number() OVER (PARTITION BY src_ip, island ORDER BY ts_us, packet_id) AS i FROM cut WHERE n >= 3)
SELECT packet_id, ts_us, src_ip, CAST(island AS BIGINT) AS island, n FROM hot WHERE i = 1""")
def latch_islands(spark, sf_dir):
    p = packets(spark, sf_dir).where((F.col("protocol") == "TCP") & (F.col("tcp_flags").bitwiseAND(F.lit(5)) != 0)).select("packet_id", "ts_us", "src_ip")
    return W.first_per_island(p, ["src_ip"], 2 * DAY, 3).select("packet_id", "ts_us", "src_ip", F.col("island").cast("bigint").alias("island"), "n")


@query(f"""
WITH {PACKETS}, v AS (SELECT src_ip, list_sort(list(DISTINCT dst_port)) AS p FROM packets GROUP BY src_ip)
SELECT src_ip, array_to_string(p[1:20], ', ') || CASE WHEN len(p) > 20 THEN ', ... (+' || (len(p) - 20) || ' more)' ELSE '' END AS ports, CAST(len(p) AS BIGINT) AS n FROM v""")
def evidence_list(spark, sf_dir):
    p = packets(spark, sf_dir).groupBy("src_ip").agg(F.collect_set("dst_port").alias("p"))
    return p.select("src_ip", W.evidence_list(F.col("p"), 20).alias("ports"), F.size("p").cast("bigint").alias("n"))

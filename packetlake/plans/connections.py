"""Queries over flows and connections."""

from __future__ import annotations

from pyspark.sql import functions as F

from packetlake.operators import detectors as D
from packetlake.operators import sessions as S
from packetlake.plans.base import DAY, query
from packetlake.plans.detection import _private_sql
from packetlake.plans.views import PACKETS, SEGMENTS, packets, segments

_SHELL, _STRONG = (S.any_of(x).replace("'", "''") for x in (S.SHELL, S.STRONG_SHELL))
_REQ, _RESP = r"^[A-Z]+\s+\S+\s+HTTP/1\.[01]", r"^HTTP/(1\.|2 )"

CONN = f"""
{SEGMENTS}, conn AS (
  SELECT client_ip, client_port, server_ip, service_port, max(packet_id) AS packet_id, min(ts_us) AS first_us, max(ts_us) AS last_us, max(ts_us) FILTER (tcp_flags & 5 <> 0) AS closed_us,
    bool_or(tcp_flags & 2 = 2) AS syn, count(*) FILTER (dir = 'c2s' AND payload <> '') AS c_packets, count(*) FILTER (dir = 's2c' AND payload <> '') AS s_packets,
    CAST(coalesce(sum(length(payload)) FILTER (dir = 'c2s'), 0) AS BIGINT) AS c_bytes, CAST(coalesce(sum(length(payload)) FILTER (dir = 's2c'), 0) AS BIGINT) AS s_bytes,
    bool_or(dir = 'c2s' AND starts_with(payload, 'SSH-')) AS c_ssh, bool_or(dir = 's2c' AND starts_with(payload, 'SSH-')) AS s_ssh, bool_or(dir = 's2c' AND starts_with(payload, '220')) AS s_220, bool_or(dir = 'c2s' AND payload <> '') AS c_data,
    min(ts_us) FILTER (dir = 'c2s' AND starts_with(payload, 'PASS')) AS pass_us, max(ts_us) FILTER (dir = 's2c' AND regexp_matches(payload, '^5[0-9][0-9]')) AS refused_us,
    bool_or(dir = 'c2s' AND regexp_matches(payload, '{_REQ}')) AS c_http, bool_or(dir = 's2c' AND regexp_matches(payload, '{_RESP}')) AS s_http,
    count(*) FILTER (payload <> '' AND (regexp_matches(payload, '{_REQ}') OR regexp_matches(payload, '{_RESP}'))) AS web, count(*) FILTER (payload <> '' AND NOT (regexp_matches(payload, '{_REQ}') OR regexp_matches(payload, '{_RESP}'))) AS raw,
    bool_or(regexp_matches(lower(payload), '{_SHELL}')) AS shell, bool_or(regexp_matches(lower(payload), '{_STRONG}')) AS strong, bool_or(dir = 'c2s' AND regexp_matches(lower(payload), '{_STRONG}')) AS c_strong
  FROM segments GROUP BY client_ip, client_port, server_ip, service_port
)"""

_CONN_COLUMNS = ["client_ip", "client_port", "server_ip", "service_port", "packet_id", "first_us", "last_us", "closed_us", "syn", "c_packets", "s_packets", "c_bytes", "s_bytes", "c_ssh", "s_ssh", "s_220", "pass_us", "refused_us", "web", "raw", "shell", "strong"]


#: -1 where there was none.
_TIMES = ("closed_us", "pass_us", "refused_us")


@query(f"WITH {CONN} SELECT {', '.join(f'coalesce({c}, -1) AS {c}' if c in _TIMES else c for c in _CONN_COLUMNS)} FROM conn")
def connection_summary(spark, sf_dir):
    return S.connections(segments(spark, sf_dir)).select(*(F.coalesce(F.col(c), F.lit(-1)).cast("bigint").alias(c) if c in _TIMES else c for c in _CONN_COLUMNS))


_BOTH = "SELECT packet_id, ts_us, length, tcp_flags, CASE WHEN packet_id % 3 = 0 THEN dst ELSE src END AS src_ip, CASE WHEN packet_id % 3 = 0 THEN dport ELSE sport END AS src_port, CASE WHEN packet_id % 3 = 0 THEN src ELSE dst END AS dst_ip, CASE WHEN packet_id % 3 = 0 THEN sport ELSE dport END AS dst_port, protocol FROM (SELECT packet_id, ts_us, length, tcp_flags, protocol, src_ip AS src, CAST(50000 + user_id % 7 AS INT) AS sport, '192.168.0.' || CAST(k % 4 AS {s}) AS dst, CAST(20 + k % 4 AS INT) AS dport FROM {p})"


def _two_way(spark, sf_dir):
    packets(spark, sf_dir).createOrReplaceTempView("packetlake_packets")
    return spark.sql(_BOTH.format(s="STRING", p="packetlake_packets"))


@query(f"""
WITH {PACKETS}, p AS ({_BOTH.format(s='VARCHAR', p='packets')}),
keyed AS (SELECT *, (src_port, src_ip) > (dst_port, dst_ip) AS swap FROM p),
k2 AS (SELECT *, CASE WHEN swap THEN dst_ip ELSE src_ip END AS ip_a, CASE WHEN swap THEN dst_port ELSE src_port END AS port_a, CASE WHEN swap THEN src_ip ELSE dst_ip END AS ip_b, CASE WHEN swap THEN src_port ELSE dst_port END AS port_b FROM keyed),
k3 AS (SELECT *, first_value(src_ip) OVER (PARTITION BY ip_a, port_a, ip_b, port_b, protocol ORDER BY ts_us, packet_id) AS client_ip FROM k2)
SELECT ip_a, port_a, ip_b, port_b, protocol, client_ip, min(ts_us) AS first_us, max(ts_us) AS last_us, count(*) AS packets, CAST(sum(length) AS BIGINT) AS bytes, count(*) FILTER (src_ip = client_ip) AS forward_packets,
  CAST(coalesce(sum(length) FILTER (src_ip = client_ip), 0) AS BIGINT) AS forward_bytes, count(*) FILTER (src_ip <> client_ip) AS reverse_packets, CAST(coalesce(sum(length) FILTER (src_ip <> client_ip), 0) AS BIGINT) AS reverse_bytes,
  CASE WHEN bool_or(tcp_flags & 4 = 4) THEN 'closed' WHEN bool_or(src_ip = client_ip) AND bool_or(src_ip <> client_ip) THEN 'established' WHEN bool_or(tcp_flags & 1 = 1) THEN 'closing' ELSE 'new' END AS state
FROM k3 GROUP BY ip_a, port_a, ip_b, port_b, protocol, client_ip""")
def flow_stats(spark, sf_dir):
    return S.flow_stats(S.flow_key(_two_way(spark, sf_dir)))


@query(f"""
WITH {PACKETS}, cut AS (SELECT *, CASE WHEN ts_us - lag(ts_us) OVER (PARTITION BY src_ip, protocol ORDER BY ts_us, packet_id) >= {2 * DAY} THEN 1 ELSE 0 END AS fresh FROM packets),
numbered AS (SELECT *, 1 + sum(fresh) OVER (PARTITION BY src_ip, protocol ORDER BY ts_us, packet_id ROWS UNBOUNDED PRECEDING) AS session FROM cut)
SELECT src_ip, protocol, CAST(session AS BIGINT) AS session, min(ts_us) AS first_us, max(ts_us) AS last_us, count(*) AS packets, CAST(sum(length) AS BIGINT) AS bytes FROM numbered GROUP BY src_ip, protocol, session""")
def flow_sessions(spark, sf_dir):
    return S.flow_sessions(packets(spark, sf_dir), ["src_ip", "protocol"], 2 * DAY).withColumn("session", F.col("session").cast("bigint"))


def _conn_edge(where: str, keys: str, n: str, threshold: int, columns: str, extra: str = "") -> str:
    return f"""
WITH {CONN}, done AS (SELECT *, closed_us AS ts_us{extra} FROM conn WHERE closed_us IS NOT NULL), able AS (SELECT * FROM done WHERE {where}),
counted AS (SELECT *, {n} AS n FROM able), edged AS (SELECT *, lag(n) OVER (PARTITION BY {keys} ORDER BY ts_us, packet_id) AS before FROM counted)
SELECT {columns} FROM edged WHERE n >= {threshold} AND (before IS NULL OR before < {threshold})"""


def _over(keys: str, days: int) -> str:
    return f"OVER (PARTITION BY {keys} ORDER BY ts_us RANGE BETWEEN {days * DAY} PRECEDING AND CURRENT ROW)"


@query(_conn_edge("syn AND c_ssh AND s_ssh", "server_ip, service_port", f"count(DISTINCT client_port) {_over('server_ip, service_port', 2)}", 3, "packet_id, ts_us, server_ip, service_port, n"))
def ssh_brute_force(spark, sf_dir):
    return S.ssh_brute_force(S.connections(segments(spark, sf_dir)), 2 * DAY, 3, keys=("server_ip", "service_port")).select("packet_id", "ts_us", "server_ip", "service_port", "n")


@query(_conn_edge("syn AND pass_us < refused_us", "server_ip, service_port", f"count(*) {_over('server_ip, service_port', 3)}", 2, "packet_id, ts_us, server_ip, service_port, n"))
def ftp_brute_force(spark, sf_dir):
    return S.ftp_brute_force(S.connections(segments(spark, sf_dir)), 3 * DAY, 2, keys=("server_ip", "service_port")).select("packet_id", "ts_us", "server_ip", "service_port", "n")


_KIND = f", CASE WHEN s_ssh AND NOT c_ssh THEN 'ssh' WHEN s_220 AND syn AND NOT c_data THEN 'ftp' WHEN s_http AND NOT c_http AND NOT s_220 AND {_private_sql('server_ip')} THEN 'http' END AS kind"


@query(_conn_edge("kind IS NOT NULL", "client_ip, server_ip, service_port, kind", f"count(*) {_over('client_ip, server_ip, service_port, kind', 1)}", 1, "packet_id, ts_us, client_ip, server_ip, service_port, kind, CASE WHEN kind = 'ftp' THEN 'vsFTPd 3.0.3' END AS version, n", _KIND))
def banner_grab(spark, sf_dir):
    return S.banner_grabs(S.connections(segments(spark, sf_dir)), DAY).select("packet_id", "ts_us", "client_ip", "server_ip", "service_port", "kind", "version", "n")


_PARTS = f"""
parts AS (SELECT *, service_port NOT IN ({', '.join(map(str, S.COMMON_PORTS))}) AS unusual, {_private_sql('client_ip')} AND NOT {_private_sql('server_ip')} AS outbound,
  c_packets >= 3 AND s_packets >= 3 AND c_bytes > 0 AND s_bytes > 0 AS interactive, coalesce(closed_us, last_us) - first_us >= {5 * DAY} AS long_lived FROM conn),
scored AS (SELECT *, CAST(unusual AS INT) + CAST(outbound AS INT) + CAST(interactive AS INT) + CAST(long_lived AS INT) + 2 * CAST(shell AS INT) AS score FROM parts),
judged AS (SELECT *, syn AND c_packets + s_packets >= 2 AND NOT c_ssh AND NOT s_ssh AND NOT (s_220 AND NOT c_data) AND NOT (s_http AND NOT c_http) AND {_private_sql('client_ip')} AND NOT (web > 0 AND raw = 0)
  AND NOT (service_port IN (80, 443, 8080, 8443) AND NOT shell) AND ((shell AND (interactive OR long_lived OR unusual)) OR (strong AND (unusual OR outbound)) OR (unusual AND outbound AND interactive AND long_lived AND score >= 4 AND raw > 5)) AS alert FROM scored)"""


@query(f"WITH {CONN}, {_PARTS} SELECT client_ip, client_port, server_ip, service_port, unusual, outbound, interactive, long_lived, shell, score, alert, least(95, 55 + 8 * score) AS confidence FROM judged")
def reverse_shell_score(spark, sf_dir):
    return S.shell_scores(S.connections(segments(spark, sf_dir)), 5 * DAY).select("client_ip", "client_port", "server_ip", "service_port", "unusual", "outbound", "interactive", "long_lived", "shell", "score", "alert", "confidence")


@query(f"WITH {CONN} SELECT packet_id, client_ip, server_ip, service_port FROM conn WHERE c_strong AND service_port IN ({', '.join(map(str, S.EXPLOIT_PORTS))}) AND NOT ({_private_sql('client_ip')} AND NOT {_private_sql('server_ip')})")
def exploit_payload(spark, sf_dir):
    return S.exploit_payloads(S.connections(segments(spark, sf_dir))).select("packet_id", "client_ip", "server_ip", "service_port")


@query(f"WITH {SEGMENTS} SELECT packet_id, payload, regexp_matches(lower(payload), '{_SHELL}') AS shell, regexp_matches(lower(payload), '{_STRONG}') AS strong FROM segments WHERE payload <> ''")
def shell_markers(spark, sf_dir):
    p = segments(spark, sf_dir).where("payload <> ''")
    low = S.decoded(F.col("payload"))
    return p.select("packet_id", "payload", low.rlike(S.any_of(S.SHELL)).alias("shell"), low.rlike(S.any_of(S.STRONG_SHELL)).alias("strong"))


@query(f"""
WITH {SEGMENTS}, paths AS (SELECT packet_id, ts_us, server_ip AS dst_ip, service_port AS dst_port, regexp_extract(payload, '^([A-Z]+)\\s+(\\S+)\\s+HTTP/1\\.[01]', 2) AS path FROM segments),
able AS (SELECT * FROM paths WHERE path <> ''), counted AS (SELECT *, count(DISTINCT path) {_over('dst_ip, dst_port', 2)} AS n FROM able),
edged AS (SELECT *, lag(n) OVER (PARTITION BY dst_ip, dst_port ORDER BY ts_us, packet_id) AS before FROM counted)
SELECT packet_id, ts_us, dst_ip, dst_port, path, n FROM edged WHERE n >= 5 AND (before IS NULL OR before < 5)""")
def http_enumeration(spark, sf_dir):
    p = segments(spark, sf_dir).select("packet_id", "ts_us", F.col("server_ip").alias("dst_ip"), F.col("service_port").alias("dst_port"), "payload")
    return D.http_enumeration(p, 2 * DAY, 5, keys=("dst_ip", "dst_port")).select("packet_id", "ts_us", "dst_ip", "dst_port", "path", "n")


@query(f"""
WITH {CONN}, {_PARTS}, recon AS (SELECT ts_us, server_ip AS attacker, client_ip AS victim FROM segments WHERE event_type = 'error'),
calls AS (SELECT packet_id, last_us AS ts_us, client_ip AS victim, server_ip AS attacker FROM judged WHERE alert)
SELECT c.packet_id, c.ts_us, c.attacker, c.victim, max(r.ts_us) AS recon_us FROM calls c JOIN recon r ON r.attacker = c.attacker AND r.victim = c.victim AND r.ts_us BETWEEN c.ts_us - {10 * DAY} AND c.ts_us GROUP BY ALL""")
def multi_stage(spark, sf_dir):
    seg = segments(spark, sf_dir)
    recon = seg.where("event_type = 'error'").select("ts_us", F.col("server_ip").alias("attacker"), F.col("client_ip").alias("victim"))
    calls = S.shell_scores(S.connections(seg), 5 * DAY).where("alert").select("packet_id", F.col("last_us").alias("ts_us"), F.col("client_ip").alias("client"), F.col("server_ip").alias("server"))
    return S.multi_stage(recon, calls, 10 * DAY)



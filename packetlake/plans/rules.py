"""Queries of the rule engine and the protocol inspectors; payloads are texts of documents, pages and segments."""

from __future__ import annotations

from pyspark.sql import functions as F

from packetlake.operators import inspect as I
from packetlake.operators import rules as R
from packetlake.plans.base import DAY, query
from packetlake.plans.views import PACKETS, SEGMENTS, packets, segments, table

RULES = R.load_rules(
    [
        {"sid": 1001, "protocol": "TCP", "content": ["Apache License"], "message": "Apache licence line", "severity": "LOW"},
        {"sid": 1002, "protocol": "TCP", "content": ["gnu general public"], "nocase": True, "message": "GNU licence line", "severity": "MEDIUM"},
        {"sid": 1003, "protocol": "TCP", "content": ["$$$", "%%%"], "message": "Marks", "severity": "INFO"},
        {"sid": 1004, "protocol": "TCP", "content": ["The"], "offset": 0, "depth": 20, "message": "Begins with The", "severity": "LOW"},
        {"sid": 1005, "protocol": "TCP", "content": ["token = |22|"], "message": "Token", "severity": "HIGH"},
        {"sid": 1006, "protocol": "TCP", "content": ["the"], "message": "Frequent word", "severity": "INFO"},
    ]
)


def _documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("packet_id"), "text", F.lit("TCP").alias("protocol"), F.lit(40000).alias("src_port"), F.lit(80).alias("dst_port"), F.lit("10.0.0.1").alias("src_ip"), F.lit("10.0.0.2").alias("dst_ip"))


_CONTENT = """
hits AS (
  SELECT doc_id AS packet_id, 1001 AS sid, 0 AS i FROM documents WHERE contains(text, 'Apache License')
  UNION ALL SELECT doc_id, 1002, 1 FROM documents WHERE contains(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'gnu general public')
  UNION ALL SELECT doc_id, 1003, 2 FROM documents WHERE contains(text, '$$$') AND contains(text, '%%%')
  UNION ALL SELECT doc_id, 1004, 3 FROM documents WHERE contains(substr(text, 1, 20), 'The')
  UNION ALL SELECT doc_id, 1005, 4 FROM documents WHERE contains(text, 'token = "')
  UNION ALL SELECT doc_id, 1006, 5 FROM documents WHERE contains(text, 'the'))"""


@query(f"WITH {_CONTENT} SELECT packet_id, CAST(sid AS BIGINT) AS sid FROM hits")
def rule_content_match(spark, sf_dir):
    return R.match(_documents(spark, sf_dir), RULES, F.col("text")).select("packet_id", "sid")


@query(f"WITH {_CONTENT} SELECT packet_id, CAST(sid AS BIGINT) AS sid, CAST(i AS INT) AS rule_order FROM (SELECT *, row_number() OVER (PARTITION BY packet_id ORDER BY i) AS n FROM hits) WHERE n <= 2")
def rule_top2_per_packet(spark, sf_dir):
    return R.match(_documents(spark, sf_dir), RULES, F.col("text"), most=2).select("packet_id", "sid", "rule_order")


REGEXES = R.load_rules([{"sid": 2001, "protocol": "IP", "regex": r"[0-9]+@mail[0-9]\.example\.com", "message": "Mail address"}, {"sid": 2002, "protocol": "IP", "regex": r"\+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4}", "message": "Phone number"}, {"sid": 2003, "protocol": "TCP", "regex": "version [0-9]", "nocase": True, "message": "Version"}])


@query(r"""SELECT doc_id AS packet_id, CAST(2001 AS BIGINT) AS sid, 'Mail address' AS message FROM documents WHERE regexp_matches(text, '[0-9]+@mail[0-9]\.example\.com')
UNION ALL SELECT doc_id, 2002, 'Phone number' FROM documents WHERE regexp_matches(text, '\+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4}') UNION ALL SELECT doc_id, 2003, 'Version' FROM documents WHERE regexp_matches(text, '(?i)version [0-9]')""")
def rule_regex_match(spark, sf_dir):
    return R.match(_documents(spark, sf_dir), REGEXES, F.col("text")).select("packet_id", "sid", "message")


@query("""
WITH a AS (SELECT doc_id, text, strpos(text, 'icense') AS p1 FROM documents), b AS (SELECT *, CASE WHEN p1 > 0 THEN strpos(substr(text, p1 + 8), 'ersion') ELSE 0 END AS q FROM a),
c AS (SELECT *, p1 + 7 + q AS p2 FROM b WHERE q > 0)
SELECT doc_id AS packet_id, CAST(p1 AS INT) AS position FROM c WHERE p2 + 6 <= p1 + 6 + 2 + 60""")
def rule_content_chain(spark, sf_dir):
    d = _documents(spark, sf_dir).withColumn("position", R.chain_position(F.col("text"), [b"icense", b"ersion"], distance=2, within=60))
    return d.where("position > 0").select("packet_id", "position")


PORT_RULES = R.load_rules([{"sid": 3001, "protocol": "IP", "dst_port": "20:40,77", "regex": ".", "message": "Low ports"}, {"sid": 3002, "protocol": "TCP", "dst_port": "[80,443]", "src_port": "40000:40500", "regex": ".", "message": "Web"}, {"sid": 3003, "protocol": "UDP", "dst_port": "$HTTP_PORTS", "regex": ".", "message": "UDP on a web port"}, {"sid": 3004, "protocol": "ICMP", "src_ip": "10.0.0.0/26", "message": "ICMP"}])

_PORTS = """
hits AS (SELECT packet_id, ts_us, src_ip, 3001 AS sid FROM packets WHERE dst_port BETWEEN 20 AND 40 OR dst_port = 77
  UNION ALL SELECT packet_id, ts_us, src_ip, 3002 FROM packets WHERE protocol = 'TCP' AND dst_port IN (80, 443) AND src_port BETWEEN 40000 AND 40500
  UNION ALL SELECT packet_id, ts_us, src_ip, 3003 FROM packets WHERE protocol = 'UDP' AND dst_port IN (80, 8080, 8000)
  UNION ALL SELECT packet_id, ts_us, src_ip, 3004 FROM packets WHERE protocol = 'ICMP' AND src_ip LIKE '10.0.0.%' AND CAST(split_part(src_ip, '.', 4) AS INT) < 64)"""


@query(f"WITH {PACKETS}, {_PORTS} SELECT packet_id, CAST(sid AS BIGINT) AS sid FROM hits")
def rule_port_ranges(spark, sf_dir):
    return R.match(packets(spark, sf_dir), PORT_RULES, F.lit("x")).select("packet_id", "sid")


@query(f"""
WITH {PACKETS}, {_PORTS}, counted AS (SELECT *, count(*) OVER (PARTITION BY src_ip, sid ORDER BY ts_us RANGE BETWEEN {5 * DAY} PRECEDING AND CURRENT ROW) AS n FROM hits),
edged AS (SELECT *, lag(n) OVER (PARTITION BY src_ip, sid ORDER BY ts_us, packet_id) AS before FROM counted) SELECT packet_id, ts_us, src_ip, CAST(sid AS BIGINT) AS sid, n FROM edged WHERE n >= 4 AND (before IS NULL OR before < 4)""")
def rule_threshold(spark, sf_dir):
    hits = R.match(packets(spark, sf_dir), PORT_RULES, F.lit("x")).select("packet_id", "ts_us", "src_ip", "sid")
    return R.enforce_threshold(hits, ["src_ip", "sid"], 4, 5 * DAY)


@query("""SELECT * FROM (VALUES ('80', '80'), ('80,443', '80,443'), ('[80,443]', '80,443'), ('1:1024', '1:1024'), (':1023', '0:1023'), ('60000:', '60000:65535'), ('20,21,22', '20:22'), ('443,80,80', '80,443'), ('$HTTP_PORTS', '80,8000,8080'), ('any', 'any'), ('20:25,22:30', '20:30')) AS t(expression, canonical)""")
def port_expression_table(spark, sf_dir):
    given = ["80", "80,443", "[80,443]", "1:1024", ":1023", "60000:", "20,21,22", "443,80,80", "$HTTP_PORTS", "any", "20:25,22:30"]
    return spark.createDataFrame([(x, R.canonical_ports(R.parse_ports(x))) for x in given], "expression STRING, canonical STRING")


@query(r"""
WITH r AS (SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'GET ' || url ELSE 'GET ' || regexp_replace(url, '^https?://[^/]+', '') END || CASE WHEN page_id % 7 = 0 THEN '' ELSE ' HTTP/1.1' END AS line, regexp_extract(url, '^https?://([^/]+)', 1) AS host FROM pages)
SELECT page_id, CASE WHEN page_id % 11 = 0 THEN 'incomplete' WHEN page_id % 7 = 0 THEN 'malformed' ELSE 'complete' END AS status, CASE WHEN page_id % 7 <> 0 AND page_id % 11 <> 0 THEN 'GET' END AS method,
  CASE WHEN page_id % 7 <> 0 AND page_id % 11 <> 0 THEN split_part(line, ' ', 2) END AS uri, CASE WHEN page_id % 7 <> 0 AND page_id % 11 <> 0 THEN host END AS host, CASE WHEN page_id % 7 <> 0 AND page_id % 11 <> 0 THEN 'probe/1.0' END AS user_agent
FROM r""")
def http_request_fields(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    uri = F.when(F.col("page_id") % 5 == 0, F.col("url")).otherwise(F.regexp_replace("url", "^https?://[^/]+", ""))
    text = F.concat(F.lit("GET "), uri, F.when(F.col("page_id") % 7 == 0, "").otherwise(" HTTP/1.1"), F.lit("\r\nHost: "), F.regexp_extract("url", "^https?://([^/]+)", 1), F.lit("\r\nUser-Agent:  probe/1.0"), F.when(F.col("page_id") % 11 == 0, "").otherwise("\r\n\r\n"))
    return p.withColumn("f", I.http_fields(text)).select("page_id", "f.status", "f.method", "f.uri", "f.host", "f.user_agent")


@query(r"SELECT page_id, replace(url, '/', '\') || '%41+b%zz' AS uri, url || 'A+b%zz' AS normalized FROM pages")
def uri_normalize(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", F.concat(F.replace("url", F.lit("/"), F.lit("\\")), F.lit("%41+b%zz")).alias("uri"))
    return p.withColumn("normalized", I.normalized_uri(F.col("uri")))


@query(f"""
WITH {SEGMENTS}, e AS (SELECT packet_id, service_port, payload, list_filter([
    CASE WHEN service_port IN (80, 8080, 8000) THEN {{'s': 'HTTP', 'p': 25}} END, CASE WHEN service_port IN (443, 8443) THEN {{'s': 'TLS', 'p': 25}} END, CASE WHEN service_port = 22 THEN {{'s': 'SSH', 'p': 25}} END, CASE WHEN service_port = 21 THEN {{'s': 'FTP', 'p': 25}} END,
    CASE WHEN service_port IN (25, 587, 465) THEN {{'s': 'SMTP', 'p': 25}} END, CASE WHEN regexp_matches(payload, '^(GET |POST |PUT |HEAD |HTTP/1\\.)') THEN {{'s': 'HTTP', 'p': 80}} END, CASE WHEN starts_with(payload, 'SSH-') THEN {{'s': 'SSH', 'p': 80}} END,
    CASE WHEN regexp_matches(payload, '^(220 |EHLO |HELO )') THEN {{'s': 'SMTP', 'p': 70}} END, CASE WHEN regexp_matches(payload, '^(USER |220-)') THEN {{'s': 'FTP', 'p': 60}} END], lambda x: x IS NOT NULL) AS ev FROM segments),
t AS (SELECT *, list_max(list_transform(ev, lambda x: x.p)) AS top FROM e), w AS (SELECT *, list_filter(ev, lambda x: x.p = top)[1].s AS winner FROM t)
SELECT packet_id, CASE WHEN len(ev) = 0 THEN 'GENERIC_TCP' ELSE winner END AS service, CAST(CASE WHEN len(ev) = 0 THEN 10 ELSE top END AS INT) AS score,
  CASE WHEN len(ev) = 0 THEN 'suspected' WHEN top >= 70 AND len(list_filter(ev, lambda x: x.s <> winner AND x.p >= 25)) > 0 THEN 'conflicted' WHEN top >= 70 THEN 'identified' ELSE 'suspected' END AS confidence FROM w""")
def service_identify(spark, sf_dir):
    return segments(spark, sf_dir).withColumn("s", I.service(F.lit("TCP"), F.col("service_port"), F.col("payload"))).select("packet_id", "s.service", "s.score", "s.confidence")

"""Fixed schemas of the relations; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES = {"BIGINT": T.LongType(), "INT": T.IntegerType(), "STRING": T.StringType(), "BOOLEAN": T.BooleanType(), "BINARY": T.BinaryType(), "TIMESTAMP": T.TimestampType()}
_TYPES |= {
    "INTS": T.ArrayType(T.IntegerType()), "BINARIES": T.ArrayType(T.BinaryType()), "DETAILS": T.MapType(T.StringType(), T.StringType()),
    "RANGES": T.ArrayType(T.StructType([T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType())])),
}


def _struct(text: str) -> T.StructType:
    """From pairs of name and type; no session is needed, unlike for DDL."""
    return T.StructType([T.StructField(n, _TYPES[t]) for n, t in (x.split() for x in text.split(","))])


FRAMES = _struct("packet_id BIGINT, file STRING, ts TIMESTAMP, ts_us BIGINT, captured_length INT, original_length INT, frame BINARY")

PACKETS = _struct("""
    packet_id BIGINT, ts TIMESTAMP, ts_us BIGINT, captured_length INT, original_length INT, length INT, ether_type INT, vlan_ids INTS, vlan_priorities INTS, ip_version INT, ttl INT, ip_id INT,
    ip_protocol INT, total_length INT, fragment_offset INT, fragment_id BIGINT, more_fragments BOOLEAN, fragmented BOOLEAN, protocol STRING, src_ip STRING, dst_ip STRING, src_port INT, dst_port INT,
    tcp_flags INT, tcp_sequence BIGINT, tcp_acknowledgment BIGINT, tcp_window INT, tcp_header_length INT, udp_length INT, icmp_type INT, icmp_code INT, icmp_id INT, icmp_sequence INT,
    icmp_inner_src_ip STRING, icmp_inner_dst_ip STRING, icmp_inner_src_port INT, icmp_inner_dst_port INT, icmp_inner_protocol STRING, payload BINARY, status STRING, error STRING, details DETAILS
""")

RULES = _struct("""
    gid INT, sid BIGINT, rev INT, action STRING, protocol STRING, src_ip STRING, dst_ip STRING, src_ports RANGES, dst_ports RANGES, direction STRING, flow STRING,
    service STRING, buffer STRING, content BINARIES, regex STRING, nocase BOOLEAN, offset INT, depth INT, distance INT, within INT, threshold_count INT, threshold_seconds INT, suppression_key STRING,
    category STRING, severity STRING, priority INT, message STRING, rule_text STRING, enabled BOOLEAN
""")

ALERTS = _struct("sid BIGINT, packet_id BIGINT, ts_us BIGINT, src_ip STRING, dst_ip STRING, src_port INT, dst_port INT, protocol STRING, severity STRING, confidence INT, message STRING, evidence STRING, event_id STRING")
INCIDENTS = _struct("incident_id STRING, category STRING, status STRING, src_ip STRING, dst_ip STRING, protocol STRING, severity STRING, first_seen_us BIGINT, last_seen_us BIGINT, alert_count BIGINT, event_count BIGINT")
EVALUATION = _struct("name STRING, expected_alert BOOLEAN, observed_alert BOOLEAN")

"""Times the headline queries: one JSON line.

Reads $BENCH_SF_DIR (default /root/testdata/sf0.1) on local[$BENCH_CPUS]; each
query runs once to warm up and is timed on the next run. The decoder is timed on
a capture file made here and reported in packets a second.
"""

from __future__ import annotations

import json
import os
import struct
import tempfile
import time

from pyspark.sql import SparkSession

QUERIES = (
    "packet_projection", "port_scan", "udp_scan", "host_sweep", "dns_rate", "connection_failures", "syn_flood", "ack_scan_with_response", "frame_dedup", "connection_summary", "reverse_shell_score", "multi_stage", "flow_stats", "flow_sessions",
    "rule_content_match", "rule_port_ranges", "service_identify", "alert_dedup", "incident_islands", "alert_search_page", "overview_stats", "fragment_reassembly", "rule_table_match", "flow_lifetimes", "port_scan_first_seen", "all_packet_alerts", "all_connection_alerts", "decoded_frames",
)
PACKETS = 50_000


def capture(path: str, n: int) -> None:
    """A capture file of ``n`` small UDP packets."""
    ip = struct.pack(">BBHHHBBH4s4s", 0x45, 0, 48, 0, 0, 64, 17, 0, b"\x0a\0\0\1", b"\x0a\0\0\2")
    frame = b"\2" * 12 + b"\x08\0" + ip + struct.pack(">HHHH", 1000, 53, 28, 0) + b"x" * 20
    with open(path, "wb") as f:
        f.write(struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1))
        for i in range(n):
            f.write(struct.pack("<IIII", i // 1000, i % 1000, len(frame), len(frame)) + frame)


def timed(make) -> float:
    took = 0.0
    for _ in range(2):
        began = time.perf_counter()
        make().write.format("noop").mode("overwrite").save()
        took = time.perf_counter() - began
    return took


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from packetlake.plans.registry import QUERIES as known
    from packetlake.sources import decode, pcap

    out = {name: round(timed(lambda name=name: known[name](spark, sf_dir)), 3) for name in QUERIES}
    with tempfile.TemporaryDirectory() as d:
        for i in range(int(cpus)):
            capture(f"{d}/{i}.pcap", PACKETS)
        took = timed(lambda: decode.packets(pcap.read(spark, d)))
    rate = round(int(cpus) * PACKETS / took)
    print(json.dumps({"metric": "total_warm_query_time", "value": round(sum(out.values()), 3), "unit": "sec", "queries": out | {"decode_capture": round(took, 3)}, "decoded_packets_per_sec": rate, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()

"""Rules as a table against rules as expressions, connections, frames, stores and what the registered queries don't reach."""

import json
import random

import pytest
from pyspark.sql import functions as F

from packetlake.config import DetectorConfig
from packetlake.operators import detectors as D
from packetlake.operators import frames
from packetlake.operators import inspect as I
from packetlake.operators import rules as R
from packetlake.operators import sessions as S
from packetlake.operators import store
from packetlake.operators import windows as W

SECOND = 1_000_000
COLUMNS = "packet_id LONG, ts_us LONG, src_ip STRING, dst_ip STRING, src_port INT, dst_port INT, protocol STRING, tcp_flags INT, length INT, payload BINARY"


def frame(spark, rows):
    """Rows of (seconds, source, target, source port, target port, flags, payload), all TCP."""
    return spark.createDataFrame([(i, round(t * SECOND), s, d, sp, dp, "TCP", fl, 60, p) for i, (t, s, d, sp, dp, fl, p) in enumerate(rows)], COLUMNS)


def test_table_of_rules_equals_expressions(spark):
    r = random.Random(4)
    text = lambda n: "".join(r.choice("abAB ") for _ in range(n))
    rows = [(i, i, f"10.0.{r.randrange(2)}.{r.randrange(4)}", f"192.168.{r.randrange(2)}.{r.randrange(4)}", r.choice((53, 80, 4000)), r.choice((53, 80, 4000)), r.choice(("TCP", "UDP", "ICMP")), 2, 60, None if r.random() < 0.1 else text(r.randrange(30)).encode()) for i in range(300)]
    packets = spark.createDataFrame(rows, COLUMNS).withColumn("dir", F.when(F.col("packet_id") % 2 == 0, "c2s").otherwise("s2c"))
    rules = []
    for i in range(60):
        maybe = lambda x: x if r.random() < 0.4 else None
        content = [text(r.randint(1, 2)) for _ in range(r.randint(1, 3))]
        rules.append({"sid": i + 1, "message": "m", "protocol": r.choice(("IP", "TCP", "UDP", "ICMP")), "direction": r.choice(("->", "<-", "<>")), "src_ip": maybe(r.choice(("10.0.0.0/24", "192.168.1.0/30", "10.0.1.2"))), "dst_ip": maybe(r.choice(("192.168.0.0/16", "10.0.1.1"))), "src_port": maybe("53,80"), "dst_port": maybe("80:5000"), "content": content, "nocase": r.random() < 0.5, "offset": maybe(2), "depth": maybe(9), "distance": maybe(1), "within": maybe(6), "regex": maybe("a.b"), "flow": maybe(r.choice(("to_server", "from_server,established")))})
    rules = R.load_rules(rules)
    one = sorted((x["packet_id"], x["sid"]) for x in R.match(packets, rules).select("packet_id", "sid").collect())
    many = R.match_many(packets, R.rules_frame(spark, rules))
    assert one == sorted((x["packet_id"], x["rule_sid"]) for x in many.select("packet_id", "rule_sid").collect()) and len(one) > 100


def test_each_rule_is_evaluated_once(spark):
    packets = frame(spark, [(0, "10.0.0.1", "10.0.0.2", 1, 80, 2, b"GET")])
    rules = R.load_rules([{"sid": 1, "protocol": "TCP", "content": ["needle-in-plan"], "message": "x"}, {"sid": 2, "protocol": "TCP", "buffer": "http_uri", "content": ["GET"], "message": "no such buffer"}])
    plan = R.match(packets, rules)._jdf.queryExecution().optimizedPlan().toString()
    # once in the condition and once in the evidence's text
    assert plan.count("needle-in-plan") == 2
    assert R.match(packets.drop("payload"), rules).count() == 0 and R.match(packets, rules).count() == 0


def test_match_without_text_does_not_hold(spark):
    packets = frame(spark, [(0, "10.0.0.1", "10.0.0.2", 1, 80, 2, b"GET /evil")])
    rule = R.load_rules([{"sid": 1, "protocol": "TCP", "content": ["evil"], "message": "x"}])
    got = R.match(packets, rule).first()
    assert got["evidence"] == "protocol=TCP; payload_match=evil" and got["explanation"] == "rule 1 matched buffer payload on protocol TCP"
    assert R.match(packets.drop("payload"), rule).count() == 0


@pytest.mark.parametrize("strict", [False, True])
def test_anchored_against_a_fold(spark, strict):
    r = random.Random(8)
    rows = [(i, r.randrange(600), f"k{r.randrange(4)}") for i in range(500)] + [(1000 + i, 10 * i, "long") for i in range(400)]
    got = {x["packet_id"] for x in W.anchored(spark.createDataFrame(rows, "packet_id LONG, ts_us LONG, k STRING").repartition(3), ["k"], 25, strict).collect()}
    want, last = set(), {}
    for i, t, k in sorted(rows, key=lambda x: (x[1], x[0])):
        if k not in last or (t - last[k] >= 25 if strict else t - last[k] > 25):
            want.add(i)
            last[k] = t
    assert got == want


def test_connections_are_cut_and_turned(spark):
    a, b = ("10.0.0.1", "10.0.0.2"), ("10.0.0.2", "10.0.0.1")
    rows = [(0, *b, 22, 4000, 24, b"late"), (1, *a, 4000, 22, 2, b""), (2, *b, 22, 4000, 18, b"SSH-2.0"), (3, *a, 4000, 22, 17, b""), (10, *b, 22, 4000, 16, b"tail"), (70, *b, 22, 4000, 16, b"after"), (75, *a, 4000, 22, 2, b""), (300, *a, 4000, 22, 24, b"idle")]
    got = S.connection_segments(frame(spark, rows), 120 * SECOND).orderBy("packet_id").collect()
    assert [x["connection"] for x in got] == [0, 0, 0, 0, 0, 1, 2, 4]
    assert {x["client_ip"] for x in got} == {"10.0.0.1"} and [x["dir"] for x in got[:3]] == ["s2c", "c2s", "s2c"] and got[2]["payload"] == "SSH-2.0"


def test_run_over_packets_of_connections(spark):
    """A scan by a server, then a shell back to it: reconnaissance, reverse shell, multi-stage; the client is the source."""
    me, out = "10.0.0.5", "93.184.216.34"
    rows = [(i, out, me, 5555, i + 1, 2, b"") for i in range(9)]
    rows += [(20, me, out, 40001, 4444, 2, b""), (21, me, out, 40001, 4444, 24, b"/bin/sh -i"), (22, out, me, 4444, 40001, 24, b"id"), (23, me, out, 40001, 4444, 24, b"uid=0"), (60, out, me, 4444, 40001, 17, b"")]
    got = {r["sid"]: r for r in D.run_all(frame(spark, rows), DetectorConfig(port_threshold=8)).collect()}
    assert {90003, 90009, 90012} <= set(got)
    assert (got[90009]["src_ip"], got[90009]["dst_port"], got[90012]["src_ip"], got[90012]["dst_ip"]) == (me, 4444, out, me)
    assert got[90003]["evidence"].startswith("distinct_ports=8; probe=syn") and "score=" in got[90009]["evidence"]


def test_dns_names_reach_the_detector(spark):
    ask = lambda n: bytes.fromhex("000101000001000000000000") + bytes([len(n)]) + n + b"\x03com\0" + bytes.fromhex("00010001")
    rows = [(i, i * SECOND, "10.0.0.1", "10.0.0.9", 4000, 53, "UDP", None, 60, ask(b"h%d" % (i % 3))) for i in range(8)]
    alerts = D.run_all(spark.createDataFrame(rows, COLUMNS), DetectorConfig(dns_threshold=3)).where("sid = 90004").collect()
    assert [r["evidence"] for r in alerts] == ["queries=3"]


def test_rule_files_and_port_groups(spark, tmp_path, monkeypatch):
    path = tmp_path / "rules.json"
    path.write_text(json.dumps([{"sid": 1, "protocol": "TCP", "content": "a", "dst_port": "$LAB_PORTS", "direction": "client_to_server", "message": "x", "threshold": {"count": 2, "seconds": 5}}]))
    groups = tmp_path / "groups.json"
    groups.write_text(json.dumps({"lab_ports": [7, 9], "bad": ["x"], "HTTP_PORTS": [81]}))
    monkeypatch.setenv("PACKETLAKE_PORT_VARIABLES", json.dumps({"HTTP_PORTS": [82]}))
    known = R.port_variables(str(groups))
    assert known["LAB_PORTS"] == "7,9" and known["HTTP_PORTS"] == "82" and "BAD" not in known and known["SSH_PORTS"] == "22"
    rule = R.rules_file(spark, str(path), known)[0]
    assert (R.canonical_ports(rule["dst_ports"]), rule["flow"], rule["threshold_count"], rule["threshold_seconds"]) == ("7,9", "to_server", 2, 5)
    for bad in ('{"a": 1}', "[1]", "no json", json.dumps([{"sid": 1, "protocol": "TCP", "content": "a", "message": "x", "threshold": {"count": 0, "seconds": 5}}])):
        path.write_text(bad)
        with pytest.raises(R.RuleError):
            R.rules_file(spark, str(path))


def test_live_rules_tell_when_they_change():
    now = [R.load_rules([{"sid": 1, "protocol": "ICMP", "message": "x"}])]
    live = R.LiveRules(lambda: now[0])
    assert len(live()) == 1 and live.changed
    live()
    assert not live.changed
    now[0] = R.load_rules([{"sid": 1, "protocol": "ICMP", "message": "y"}, {"sid": 2, "protocol": "ICMP", "message": "off", "enabled": False}])
    assert [r["message"] for r in live()] == ["y"] and live.changed


def test_quiet_streams_and_mirror_ports(spark):
    said = []
    listener = frames.QuietListener("eth0", said.append)
    for t, n in ((0, 0), (5, 0), (11, 0), (30, 0)):
        listener.take(t, n)
    assert len(said) == 1 and "eth0" in said[0] and "11 s" in said[0]
    busy = frames.QuietListener("eth0", said.append)
    for t, n in ((0, 3), (50, 0)):
        busy.take(t, n)
    assert len(said) == 1
    ports = spark.createDataFrame([("eth0", True, False), ("x", False, True)], "name STRING, capture_capable BOOLEAN, link_up BOOLEAN")
    assert [frames.check_mirror_port(n, ports)["ok"] for n in ("eth0", "x", "nope", "")] == [True, False, False, False]


def test_rule_index_and_metrics(spark):
    got = frames.rule_index(spark, ["page\nHigh\nALERT\nTCP\n1001\n2\nA message \nLow\nLOG\nUDP\n1002\n1\nOther\n", "nothing"]).orderBy("sid").collect()
    assert [(r["sid"], r["rev"], r["severity"], r["message"], r["enabled"]) for r in got] == [(1001, 2, "HIGH", "A message", False), (1002, 1, "LOW", "Other", False)]
    p = frame(spark, [(0, "10.0.0.1", "10.0.0.2", 1, 80, 2, b"GET")])
    assert frames.rule_metrics(p, 5, 3).first().asDict() == {"rules_loaded": 3, "rules_evaluated": 5, "rules_matched": 1}
    from pyspark.sql import Observation

    seen = Observation()
    frames.observed(p, seen).collect()
    assert seen.get["packets_processed"] == 1 and seen.get["tcp"] == 1


def test_system_info_and_oversized_payloads(spark):
    row = store.system_info(spark, api_port=8080).first()
    assert row["api_port"] == 8080 and row["timezone_name"] == "UTC" and row["timezone_offset_seconds"] == 0
    big = spark.createDataFrame([("HTTP", "x" * 20)], "service STRING, payload STRING")
    assert I.inspected(big, cap=10).select("inspection.status").first()[0] == "limit_exceeded"


def test_decoded_frames_of_users_and_packets_beyond_the_wire(spark, tmp_path):
    """Users whose third part of an address goes beyond 255, and packets whose sequences go beyond 32 bits."""
    import duckdb

    from packetlake.plans.registry import ORACLES, QUERIES
    from tests.oracle import compare

    c, path = duckdb.connect(), tmp_path / "events.parquet"
    users, offsets = "[0, 63999, 64000, 89999, 16383999, 16384000, 4030463999]", "[0, 613566700, 59000000000]"
    c.execute(f"""COPY (SELECT i * 7 + j + f AS event_id, TIMESTAMP '2024-01-01 00:00:00' + to_seconds(i) AS ts, u AS user_id, ['view', 'click', 'error'][i % 3 + 1] AS event_type, 20.5 AS value, '{{"k": ' || i || '}}' AS props
      FROM range(100) r(i), (SELECT unnest({users}) AS u, generate_subscripts({users}, 1) - 1 AS j), (SELECT unnest({offsets}) AS f)) TO '{path}' (FORMAT parquet)""")
    c.execute(f"CREATE VIEW events AS SELECT * FROM '{path}'")
    assert c.execute("SELECT count(DISTINCT event_id) FROM events").fetchone() == (2100,)
    compare(spark, c, str(tmp_path), QUERIES["decoded_frames"], ORACLES["decoded_frames"])

"""Detector vectors: how many alerts a sequence of packets raises."""

import pytest
from pyspark.sql import functions as F

from packetlake.config import DetectorConfig
from packetlake.operators import detectors as D
from packetlake.operators import sessions as S
from packetlake.operators import windows as W

S_, A, R, FIN = 2, 16, 4, 1
SECOND = 1_000_000
COLUMNS = "packet_id LONG, ts_us LONG, src_ip STRING, dst_ip STRING, src_port INT, dst_port INT, protocol STRING, tcp_flags INT, icmp_type INT, length INT"


def frame(spark, rows):
    """Rows of (seconds, source, target, source port, target port, protocol, flags, icmp type)."""
    return spark.createDataFrame([(i, round(t * SECOND), s, d, sp, dp, pr, fl, ic, 60) for i, (t, s, d, sp, dp, pr, fl, ic) in enumerate(rows)], COLUMNS)


def tcp(t, port, flags=S_, src="10.0.0.1", dst="10.0.0.2", sport=40000):
    return (t, src, dst, sport, port, "TCP", flags, None)


def udp(t, port, dst="10.0.0.2", sport=40000, src="10.0.0.1"):
    return (t, src, dst, sport, port, "UDP", None, None)


def ping(t, dst, src="10.0.0.1"):
    return (t, src, dst, None, None, "ICMP", None, 8)


W30 = 30 * SECOND


@pytest.mark.parametrize("exact", [False, True])
@pytest.mark.parametrize(
    ("flags", "ports", "want"),
    [(S_, [1, 2, 3], [3]), (FIN, [1, 2, 3], [3]), (0, [1, 2, 3], [3]), (41, [1, 2, 3], [3]), (17, [1, 2, 3], []), (A, [1, 2, 3], []), (S_, [1, 1, 2], []), (3, [1, 2, 3], [])],
)
def test_port_scan(spark, flags, ports, want, exact):
    p = frame(spark, [tcp(i, x, flags) for i, x in enumerate(ports)])
    assert [r["n"] for r in D.port_scan(p, W30, 3, exact=exact).collect()] == want


def test_scan_responses(spark):
    """Each kind of answer, answers to nothing, repeated ones, and those that leave the window."""
    back = lambda t, port, flags: (t, "10.0.0.2", "10.0.0.1", port, 40000, "TCP", flags, None)
    p = frame(spark, [tcp(0, 1), back(1, 1, S_ | A), back(1, 1, S_ | A), back(2, 9, R), tcp(3, 2), back(4, 2, R | A), tcp(5, 3), tcp(6, 4), tcp(33, 5)])
    quoted = spark.createDataFrame([(100, round(5.5 * SECOND), "10.0.0.9", "10.0.0.1", None, None, "ICMP", None, 3, 60, "10.0.0.1", "10.0.0.2", 40000, 3, "TCP")], COLUMNS + ", icmp_inner_src_ip STRING, icmp_inner_dst_ip STRING, icmp_inner_src_port INT, icmp_inner_dst_port INT, icmp_inner_protocol STRING")
    p = p.unionByName(quoted, allowMissingColumns=True)
    probes = p.where("tcp_flags = 2")
    got = D.scan_responses(probes, D.probe_answers(p), W30).orderBy("ts_us").select("dst_port", "n", *D.ANSWERS).collect()
    assert [tuple(r) for r in got] == [(1, 1, 0, 0, 0), (2, 2, 1, 0, 0), (3, 3, 1, 1, 0), (4, 4, 1, 1, 1), (5, 4, 0, 1, 1)]
    assert D.scan_responses(probes.limit(0), D.probe_answers(p), W30).count() == 0


def test_port_scan_rearms(spark):
    p = frame(spark, [tcp(0, 1), tcp(1, 2), tcp(10, 1), tcp(11, 2)])
    assert D.port_scan(p, 5 * SECOND, 2).count() == 2


def test_campaigns(spark):
    p = frame(spark, [tcp(60 * m + i * 0.1, i) for m in (0, 1, 5, 10, 25) for i in range(12)])
    assert D.port_scan(p, W30, 8).count() == 5


def test_udp_scan(spark):
    assert D.udp_scan(frame(spark, [udp(i, x) for i, x in enumerate((53, 123, 161))]), W30, 3).count() == 1
    assert D.udp_scan(frame(spark, [udp(i, x, dst=f"10.0.0.{i + 2}") for i, x in enumerate((53, 123, 161))]), W30, 3).count() == 0
    assert D.udp_scan(frame(spark, [udp(i * 0.1, 9) for i in range(20)]), W30, 3).count() == 0


def test_ack_scan_needs_answers(spark):
    probes = frame(spark, [tcp(i, i + 1, A) for i in range(3)])
    answers = frame(spark, [tcp(5, 2, R)]).withColumn("packet_id", F.lit(9).cast("long"))
    assert D.ack_scan(probes, answers.limit(0), W30, 3).count() == 0
    assert [(r["n"], r["answers"]) for r in D.ack_scan(probes, answers, W30, 3).collect()] == [(3, 1)]
    late = answers.withColumn("ts_us", F.lit(500 * SECOND))
    assert D.ack_scan(probes, late, W30, 3).count() == 0


def test_sweeps(spark):
    hosts = [f"10.0.0.{i + 2}" for i in range(10)]
    assert [(r["scope"], r["n"]) for r in D.host_sweep(frame(spark, [tcp(i * 0.1, 445, dst=h) for i, h in enumerate(hosts)]), W30, 5).collect()] == [("local", 5)]
    assert D.host_sweep(frame(spark, [(i, "10.0.0.1", f"10.0.0.{i}", None, None, "ARP", None, None) for i in range(20)]), W30, 5).count() == 0
    public = frame(spark, [ping(i, f"8.8.8.{i}") for i in range(6)])
    assert D.host_sweep(public, W30, 5).count() == 0
    assert D.host_sweep(public, W30, 5, remote_threshold=5).count() == 1
    assert D.host_sweep(frame(spark, [udp(i, 137, dst=f"10.0.0.{i + 2}") for i in range(7)]), W30, 5).count() == 1
    assert D.host_sweep(frame(spark, [ping(t, f"10.0.0.{i + 2}") for i, t in enumerate((1, 1.1, 1.2, 500))]), W30, 4).count() == 0
    assert D.host_sweep(frame(spark, [tcp(i * 0.1, 445) for i in range(12)]), W30, 5).count() == 0


def test_counts(spark):
    assert [r["n"] for r in D.connection_failures(frame(spark, [tcp(i, 22, R) for i in range(4)]), W30, 3).collect()] == [3]
    assert D.icmp_flood(frame(spark, [ping(i * 0.1, "10.0.0.2") for i in range(30)]), W30, 30).count() == 1
    assert D.invalid_flags(frame(spark, [tcp(i, 80, 3) for i in range(3)])).count() == 3
    assert D.latched_failures(frame(spark, [tcp(t, 22, R) for t in (0, 1, 40, 41, 60, 61)]), W30, 2).count() == 2


def test_dns(spark):
    named = frame(spark, [udp(i, 53) for i in range(6)]).withColumn("qname", F.concat(F.lit("h"), F.col("packet_id").cast("string")))
    assert [r["n"] for r in D.dns_rate(named, W30, 5).collect()] == [5]
    bare = frame(spark, [udp(i, 53) for i in range(4)]).withColumn("qname", F.lit(None).cast("string"))
    assert [r["n"] for r in D.dns_rate(bare, W30, 3).collect()] == [3]


def test_syn_flood(spark):
    def run(n, answered):
        syns = spark.createDataFrame([(i, i * 1000, "a", i) for i in range(n)], "packet_id LONG, ts_us LONG, k STRING, seq INT")
        answers = syns.where(F.col("seq") < answered).withColumn("ts_us", F.col("ts_us") + 10).withColumn("packet_id", F.col("packet_id") + 1000)
        return D.syn_flood(syns, answers, ["k"], "seq", W30, 100).count()

    assert [run(100, 0), run(99, 0), run(120, 60)] == [1, 0, 0]


def test_windows_edges(spark):
    df = spark.createDataFrame([(1, 0, "k", "a"), (2, 5, "k", "b"), (3, 10, "k", "a"), (4, 10, "k", None), (5, 16, "k", "c")], "packet_id LONG, ts_us LONG, k STRING, v STRING")
    n = {r["packet_id"]: r["n"] for r in W.sliding_distinct(df, ["k"], "v", 5).collect()}
    assert n == {1: 1, 2: 2, 3: 2, 4: 2, 5: 1}
    assert sorted(r["packet_id"] for r in W.anchored(df, ["k"], 9).collect()) == [1, 3]
    assert W.sliding_distinct(df.limit(0), ["k"], "v", 5).count() == 0


def test_evidence_list(spark):
    one = spark.range(1).select(W.evidence_list(F.sequence(F.lit(1), F.lit(150))).alias("x")).first()["x"]
    assert one.startswith("1, 2, 3") and one.endswith("(+54 more)")


def connection(spark, rows):
    """Segments of one connection each: (client port, seconds, direction, flags, payload)."""
    data = [(i, round(t * SECOND), "10.0.0.9", cp, "10.0.0.2" if port != 4444 else "93.184.216.1", port, d, fl, pl) for i, (cp, port, t, d, fl, pl) in enumerate(rows)]
    return spark.createDataFrame(data, "packet_id LONG, ts_us LONG, client_ip STRING, client_port INT, server_ip STRING, service_port INT, dir STRING, tcp_flags INT, payload STRING")


def ssh(cp, t):
    return [(cp, 22, t, "c2s", 2, ""), (cp, 22, t + 0.1, "c2s", 24, "SSH-2.0-x"), (cp, 22, t + 0.2, "s2c", 24, "SSH-2.0-y"), (cp, 22, t + 0.3, "c2s", 17, "")]


def test_ssh_brute_force(spark):
    for n, want in ((9, 0), (10, 1), (14, 1)):
        conn = S.connections(connection(spark, [x for i in range(n) for x in ssh(50000 + i, i)]))
        assert S.ssh_brute_force(conn, 60 * SECOND, 10).count() == want


def test_banner_grabs(spark):
    rows = [(1, 22, 0, "c2s", 2, ""), (1, 22, 1, "s2c", 24, "SSH-2.0-y"), (1, 22, 2, "c2s", 17, ""), (2, 21, 0, "c2s", 2, ""), (2, 21, 1, "s2c", 24, "220 (vsFTPd 3.0.3)"), (2, 21, 2, "c2s", 17, "")]
    rows += [(3, 80, 0, "c2s", 2, ""), (3, 80, 1, "s2c", 24, "HTTP/1.1 200 OK"), (3, 80, 2, "c2s", 17, ""), (4, 80, 0, "c2s", 2, ""), (4, 80, 1, "c2s", 24, "GET / HTTP/1.1"), (4, 80, 1.5, "s2c", 24, "HTTP/1.1 200 OK"), (4, 80, 2, "c2s", 17, "")]
    got = {(r["kind"], r["version"]) for r in S.banner_grabs(S.connections(connection(spark, rows)), 60 * SECOND).collect()}
    assert got == {("ssh", None), ("ftp", "vsFTPd 3.0.3"), ("http", None)}


def test_ftp_brute_force(spark):
    def login(cp, t, reply):
        return [(cp, 21, t, "c2s", 2, ""), (cp, 21, t + 0.1, "s2c", 24, "220 hi"), (cp, 21, t + 0.2, "c2s", 24, "PASS x"), (cp, 21, t + 0.3, "s2c", 24, reply), (cp, 21, t + 0.4, "c2s", 17, "")]

    for n, reply, want in ((10, "530 no", 1), (9, "530 no", 0), (10, "230 ok", 0)):
        assert S.ftp_brute_force(S.connections(connection(spark, [x for i in range(n) for x in login(i, i, reply)])), 60 * SECOND, 10).count() == want


def test_reverse_shell(spark):
    rows = [(1, 4444, 0, "c2s", 2, "")] + [(1, 4444, 1 + i, "c2s", 24, "whoami") for i in range(3)] + [(1, 4444, 10 + i, "s2c", 24, "root") for i in range(3)] + [(1, 4444, 35, "c2s", 17, "")]
    r = S.shell_scores(S.connections(connection(spark, rows)), 30 * SECOND).first()
    assert r["alert"] and r["score"] == 6 and r["interactive"] and r["confidence"] == 95
    web = [(1, 443, 0, "c2s", 2, ""), (1, 443, 1, "c2s", 24, "GET /?q=whoami HTTP/1.1"), (1, 443, 2, "s2c", 24, "HTTP/1.1 200 OK"), (1, 443, 40, "c2s", 17, "")]
    assert not S.shell_scores(S.connections(connection(spark, web)), 30 * SECOND).first()["alert"]


def test_multi_stage(spark):
    recon = spark.createDataFrame([(100 * SECOND, "a", "v")], "ts_us LONG, attacker STRING, victim STRING")
    calls = spark.createDataFrame([(1, 600 * SECOND, "v", "a"), (2, 800 * SECOND, "v", "a"), (3, 200 * SECOND, "w", "a")], "packet_id LONG, ts_us LONG, client STRING, server STRING")
    assert [r["packet_id"] for r in S.multi_stage(recon, calls, 600 * SECOND).collect()] == [1]


def test_run_all_and_config(spark):
    p = frame(spark, [tcp(i, i + 1) for i in range(9)] + [ping(20, "10.0.0.7")])
    got = {r["sid"] for r in D.run_all(p, DetectorConfig(port_threshold=8)).collect()}
    assert got == {90003, 90001}
    assert DetectorConfig(port_threshold=1).port_threshold == 2

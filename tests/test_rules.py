import pytest
from pyspark.sql import functions as F

from packetlake.operators import inspect as I
from packetlake.operators import rules as R


@pytest.mark.parametrize(("given", "want"), [("80", "80"), ("[80,443]", "80,443"), ("1:1024", "1:1024"), (":10", "0:10"), ("60000:", "60000:65535"), ("20,21,22,30", "20:22,30"), ("any", "any"), ("", "any"), (443, "443"), ([80, "443"], "80,443"), ("$SSH_PORTS", "22")])
def test_ports(given, want):
    assert R.canonical_ports(R.parse_ports(given)) == want


@pytest.mark.parametrize("bad", ["70000", "9:1", "x", "$NOPE", ":", "-1", [1.5]])
def test_bad_ports(bad):
    with pytest.raises(R.RuleError):
        R.parse_ports(bad)


def test_content():
    assert R.decode_content("User-Agent|3a| Nmap") == b"User-Agent: Nmap"
    for bad in ("a|3", "a|zz|"):
        with pytest.raises(R.RuleError):
            R.decode_content(bad)


def test_rule_round_trip():
    r = R.parse_rule('alert tcp 192.168.68.110 any -> any $HTTP_PORTS (msg:"A \\"b\\"; c"; content:"x|3a 00|y"; nocase; sid:100023; rev:123;)')
    assert (r["sid"], r["rev"], r["src_ip"], r["content"], r["nocase"], r["message"]) == (100023, 123, "192.168.68.110", [b"x:\0y"], True, 'A "b"; c')
    again = R.parse_rule(R.rule_text(r))
    assert {k: again[k] for k in r if k != "rule_text"} == {k: r[k] for k in r if k != "rule_text"}


@pytest.mark.parametrize("bad", ["nonsense", 'drop tcp any any -> any any (msg:"x"; content:"y"; sid:1;)', 'alert tcp any any -> any any (msg:"x"; sid:1;)', 'alert tcp any any -> any any (msg:"x"; content:"y";)', 'alert tcp any any -> any any (msg:"x"; content:"y"; sid:1; foo:2;)', 'alert tcp any any -> any any (msg:"x"; regex:"("; sid:1;)'])
def test_bad_rules(bad):
    with pytest.raises(R.RuleError):
        R.parse_rule(bad)


def test_load_is_all_or_nothing():
    one = {"sid": 1, "protocol": "ICMP", "message": "x"}
    assert len(R.load_rules([one, one | {"rev": 2}])) == 2
    with pytest.raises(R.RuleError):
        R.load_rules([one, one])


def packets(spark, payloads, protocol="TCP"):
    rows = [(i, i * 1_000_000, "10.0.0.1", "10.0.0.2", 40000, 80, protocol, p) for i, p in enumerate(payloads)]
    return spark.createDataFrame(rows, "packet_id LONG, ts_us LONG, src_ip STRING, dst_ip STRING, src_port INT, dst_port INT, protocol STRING, payload BINARY")


def sids(df):
    return sorted((r["packet_id"], r["sid"]) for r in df.collect())


def test_matching(spark):
    p = packets(spark, [b"GET /admin\0x", b"get /ADMIN", b"", None, b"zz abc--def"])
    rules = R.load_rules([{"sid": 1, "protocol": "TCP", "content": ["|00|"], "message": "nul"}, {"sid": 2, "protocol": "IP", "content": ["/admin"], "nocase": True, "message": "a"}, {"sid": 3, "protocol": "TCP", "content": ["GET"], "depth": 3, "message": "d"}, {"sid": 4, "protocol": "TCP", "content": ["abc", "def"], "distance": 2, "within": 5, "message": "c"}, {"sid": 5, "protocol": "TCP", "content": ["abc", "def"], "distance": 3, "message": "c"}, {"sid": 6, "protocol": "UDP", "content": ["abc"], "message": "u"}, {"sid": 7, "protocol": "TCP", "dst_port": "443", "content": ["abc"], "message": "p"}, {"sid": 8, "protocol": "TCP", "src_ip": "10.0.0.0/24", "regex": "^zz", "message": "n"}])
    assert sids(R.match(p, rules)) == [(0, 1), (0, 2), (0, 3), (1, 2), (4, 4), (4, 8)]
    assert sids(R.match(p, rules, most=1)) == [(0, 1), (1, 2), (4, 4)]
    many = R.match_many(p, R.rules_frame(spark, [r for r in rules if r["sid"] in (1, 2, 7)])).select("packet_id", F.col("rule_sid").alias("sid"))
    assert sids(many) == [(0, 1), (0, 2), (1, 2)]
    assert R.match(p, []).count() == 0


def test_dedup_keeps_first_two(spark):
    m = spark.createDataFrame([(1, 0, "a", 1, 0), (1, 0, "a", 2, 1), (1, 0, "a", 3, 2), (2, 10, "a", 1, 0), (2, 10, "a", 3, 2), (3, 50, "a", 1, 0)], "packet_id LONG, ts_us LONG, src_ip STRING, sid LONG, rule_order INT")
    assert sids(R.deduplicated(m, ["src_ip"], 30)) == [(1, 1), (1, 2), (3, 1)]


@pytest.mark.parametrize(("transport", "port", "text", "want"), [("TCP", 80, "GET / HTTP/1.1", ("HTTP", 80, "identified")), ("TCP", 9999, "", ("GENERIC_TCP", 10, "suspected")), ("TCP", 22, "GET /", ("HTTP", 80, "conflicted")), ("TCP", 443, "\x16\x03\x01", ("TLS", 80, "identified")), ("UDP", 53, "123456789012", ("DNS", 55, "suspected")), ("ICMP", None, None, ("ICMP", 100, "identified"))])
def test_service(spark, transport, port, text, want):
    df = spark.createDataFrame([(transport, port, text)], "t STRING, p INT, x STRING")
    assert tuple(df.select(I.service(F.col("t"), F.col("p"), F.col("x")).alias("s")).first()["s"]) == want


def test_http_and_tls(spark):
    text = "GET /a\\b HTTP/1.1\r\nHost: h\r\nX: 1\r\nhost: i\r\n\r\nbody"
    one = lambda t: spark.createDataFrame([(t,)], "x STRING").select(I.http_fields(F.col("x")).alias("f")).first()["f"]
    f = one(text)
    assert (f["status"], f["method"], f["normalized_uri"], f["host"], f["headers"]["x"]) == ("complete", "GET", "/a/b", "i", "1")
    assert one("HTTP/1.1 404 Not Found\r\n\r\n")["response_status"] == 404
    assert [one(t)["status"] for t in ("GET / HTTP/1.1\r\n", "GET /\r\n\r\n", "GET / HTTP/1.1\r\n: x\r\n\r\n", "HTTP/1.1 9\r\n\r\n")] == ["incomplete", "malformed", "malformed", "malformed"]
    t = spark.createDataFrame([("\x16\x03\x01\x00\x01\x01",)], "x STRING").select(I.tls_record(F.col("x")).alias("t")).first()["t"]
    assert (t["status"], t["length"], t["handshake_type"]) == ("complete", 1, 1)


def test_dns(spark):
    q = bytes.fromhex("1234 0100 0001 0000 0000 0000") + b"\3www\7Example\3com\0" + bytes.fromhex("0001 0001")
    got = I.dns_inspect(spark.createDataFrame([(q,), (q[:8],), (q[:12] + b"\xc0\x0c\0\1\0\1",)], "payload BINARY")).select("dns.*").collect()
    assert [(r["status"], r["qname"], r["qtype"]) for r in got] == [("complete", "www.example.com", 1), ("incomplete", None, None), ("malformed", None, None)]


def test_buffers(spark):
    df = spark.createDataFrame([("abcd",)], "x STRING")
    assert df.select(I.buffers(F.col("x"), cap=5).alias("b")).first()["b"] == {"payload": "abcd"}
    assert df.select(I.buffers(F.col("x"), cap=3).alias("b")).first()["b"] == {}

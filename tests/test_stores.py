import pytest
from pyspark.sql import functions as F

from packetlake.functions import net
from packetlake.operators import alerts as A
from packetlake.operators import reassembly, store
from packetlake.streaming import detectors as ST

ALERTS = "packet_id LONG, alert_id LONG, ts_us LONG, sid LONG, src_ip STRING, dst_ip STRING, src_port INT, dst_port INT, protocol STRING, severity STRING, category STRING, message STRING, evidence STRING"


def alerts(spark, times, severity="HIGH"):
    return spark.createDataFrame([(i, i, t, 90002, "a", "b", 1, 2, "TCP", severity, "scan", f"m{i}", f"distinct_targets={i}") for i, t in enumerate(times)], ALERTS)


def test_addresses(spark):
    ips = ["10.1.2.3", "172.32.0.1", "172.16.0.1", "8.8.8.8", "203.0.113.5", "224.0.0.1", "::1", "x", None]
    df = spark.createDataFrame([(i,) for i in ips], "ip STRING")
    assert [r[0] for r in df.select(net.is_private(F.col("ip"))).collect()] == [True, False, True, False, True, True, False, False, False]
    v6 = spark.createDataFrame([("2001:db8::1",), ("2001:db9::1",), ("10.0.0.1",)], "ip STRING")
    assert [r[0] for r in v6.select(net.in_cidr(F.col("ip"), "2001:db8::/32")).collect()] == [True, False, False]
    e = spark.createDataFrame([("1.2.3.4", 5), ("::1", 5), (None, 5), ("1.2.3.4", None)], "ip STRING, p INT")
    assert [r[0] for r in e.select(net.endpoint(F.col("ip"), F.col("p"))).collect()] == ["1.2.3.4:5", "[::1]:5", "-", "1.2.3.4"]
    assert spark.range(1).select(net.flags_value(F.lit("SAx"))).first()[0] == 18


def test_ports(spark):
    df = spark.createDataFrame([(80, [(1, 100)]), (None, [(1, 2)]), (None, []), (200, [(1, 100)])], "p INT, r ARRAY<STRUCT<first: INT, last: INT>>")
    assert [r[0] for r in df.select(net.port_matches(F.col("p"), F.col("r"))).collect()] == [True, False, True, False]


def test_dedup_and_merge(spark):
    a = alerts(spark, [5, 1, 9]).withColumn("message", F.lit("m")).withColumn("evidence", F.lit("e"))
    d = A.deduplicated(a.withColumn("fingerprint", A.fingerprint(a.columns)))
    assert [(r["first_us"], r["last_us"], r["occurrences"], r["packet_id"]) for r in d.collect()] == [(1, 9, 3, 2)]
    assert A.merged(d, d).first()["occurrences"] == 6


def test_episodes_and_incidents(spark):
    assert sorted(r["ts_us"] for r in A.episodes(alerts(spark, [100, 110, 161, 200]), ["src_ip"], 60).collect()) == [100, 161]
    m = A.incident_alerts(alerts(spark, [100, 120, 200]), 30)
    i = A.incidents(m, now_us=215, window_us=30).orderBy("first_us").collect()
    assert [(r["alert_count"], r["status"], r["severity"]) for r in i] == [(2, "RESOLVED", "HIGH"), (1, "OPEN", "HIGH")]
    assert A.incident_alerts(alerts(spark, [1], "INFO"), 30).count() == 0
    o = spark.createDataFrame([(i[0]["incident_id"], "ACKNOWLEDGED")], "incident_id STRING, status STRING")
    assert {r["status"] for r in A.with_overrides(A.incidents(m, 215, 30), o).collect()} == {"ACKNOWLEDGED", "OPEN"}


def test_confusion(spark):
    rows = spark.createDataFrame([(True, True), (True, False), (False, True), (False, False)], "e BOOLEAN, o BOOLEAN")
    r = A.confusion(rows, F.col("e"), F.col("o")).first()
    assert (r["precision"], r["recall"], r["f1"]) == (0.5, 0.5, 0.5)
    assert A.confusion(rows.limit(0), F.col("e"), F.col("o")).first()["f1"] == 0


def test_search_and_pages(spark):
    a = alerts(spark, range(10))
    assert store.Filter(term="90002").apply(a).count() == 10
    assert store.Filter(term="M3", since_us=3, until_us=3).apply(a).count() == 1
    assert store.Filter(term="%").apply(a).count() == 0
    assert store.Filter(equal={"severity": "high", "sid": 90002}, containing={"message": "m"}).apply(a).count() == 10
    assert [r["alert_id"] for r in store.paginate(a, [F.desc("ts_us")], 2, 3).collect()] == [6, 5, 4]
    assert store.paginate(a, [F.desc("ts_us")], 0, 0).count() == 1
    assert store.visible(alerts(spark, [1], "LOW")).count() == 0
    kept, bridge = store.purge(a, a.select("alert_id"), store.unjustified(a, 90002, "distinct_targets=([0-9]+)", 5))
    assert (kept.count(), bridge.count()) == (5, 5)
    assert '"alert_id":0' in store.export_json(a.limit(1)).first()["json"]


def test_small_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert one(store.query_fields(F.lit("a=1&a=2&b=x+y%21&c"))) == {"a": "1", "b": "x y!", "c": ""}
    assert [one(store.parse_time(F.lit(x))) for x in ("12", "1970-01-02", "1970-01-01 00:01", "x")] == [12, 86400, 60, None]
    assert one(store.loss_percent(F.lit(75), F.lit(25))) == 25.0 and one(store.loss_percent(F.lit(None).cast("int"), F.lit(1))) == -1.0
    assert [one(store.heartbeat_state(F.lit(a), F.lit(b))) for a, b in ((31, 0), (1, 5), (1, 20))] == ["STALE", "ACTIVE", "IDLE"]


def test_rules_table_and_reset(spark, tmp_path):
    rules = spark.createDataFrame([(1, 5, 1, True)], "gid INT, sid LONG, rev INT, enabled BOOLEAN")
    with pytest.raises(ValueError):
        store.add_rule(rules, rules)
    assert store.add_rule(rules, rules.withColumn("rev", F.lit(2))).count() == 2
    assert not store.set_enabled(rules, 5, False).first()["enabled"] and store.delete_rule(rules, 5).count() == 0
    store.append(alerts(spark, [1]), str(tmp_path / "alerts"))
    store.reset(spark, str(tmp_path), ("alerts",))
    assert spark.read.parquet(str(tmp_path / "alerts")).count() == 0


def test_interfaces(spark):
    fields = ("capture_capable", "operational", "link_up", "default_route", "has_ipv4", "has_ipv6", "loopback", "physical", "virtual", "link_down", "admin_down")
    yes = lambda *on: tuple(f in on for f in fields)
    rows = [("a", "lo", *yes("capture_capable", "operational", "link_up", "has_ipv4", "loopback")), ("b", "eth0", *yes("capture_capable", "operational", "link_up", "default_route", "has_ipv4", "has_ipv6", "physical")), ("c", "tun0", *yes("capture_capable", "operational", "link_up", "virtual")), ("d", "eth1", *yes("capture_capable", "link_down", "physical")), ("e", "eth2", *yes("operational", "link_up")), ("f", "eth3", *yes("capture_capable", "admin_down"))]
    df = spark.createDataFrame(rows, "stable_id STRING, name STRING, " + ", ".join(f"{f} BOOLEAN" for f in fields))
    got = [(r["name"], r["score"], r["suitable"], r["reason"]) for r in store.rank_interfaces(df).collect()]
    assert got == [("eth0", 150, True, "default route"), ("tun0", 90, True, "virtual or tunnel"), ("lo", 45, True, "loopback"), ("eth2", 60, False, "can't capture"), ("eth1", 20, False, "no link"), ("eth3", -5, False, "switched off")]


def test_fragments(spark):
    df = spark.createDataFrame([("k", 0, False, b"12345678"), ("k", 8, True, b"abcd"), ("g", 0, False, b"12345678"), ("g", 16, True, b"x"), ("r", 0, False, b"a"), ("r", 0, False, b"a"), ("r", 1, True, b"b")], "k STRING, offset INT, last BOOLEAN, data BINARY")
    assert [(r["k"], bytes(r["data"]), r["fragments"]) for r in reassembly.fragments(df, ["k"]).collect()] == [("k", b"12345678abcd", 2)]


def stream(spark, tmp_path, rows):
    spark.createDataFrame(rows, "packet_id LONG, ts_us LONG, src_ip STRING, dst_port INT, length INT").withColumn("ts", F.timestamp_micros("ts_us")).coalesce(1).write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))


def drain(df, name, tmp_path):
    df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination(90)
    return df.sparkSession.table(name)


def test_streaming_twins(spark, tmp_path):
    from packetlake.operators import detectors as D

    rows = [(i, (1000 + t) * 1_000_000, "s", p, 10) for i, (t, p) in enumerate([(0, 1), (1, 2), (2, 3), (2, 3), (500, 1), (501, 2), (502, 3)])]
    s = stream(spark, tmp_path, rows)
    got = sorted((r["packet_id"], r["n"]) for r in drain(ST.sliding_alerts(s, ["src_ip"], "dst_port", 30_000_000, 3), "edges", tmp_path).collect())
    batch = D.distinct_alerts(spark.read.parquet(str(tmp_path / "in")), ["src_ip"], "dst_port", 30_000_000, 3)
    assert got == sorted((r["packet_id"], r["n"]) for r in batch.collect()) == [(2, 3), (6, 3)]
    assert drain(ST.deduplicated(s, ["src_ip", "dst_port", "ts_us"]), "unique_frames", tmp_path).count() == 6
    assert drain(ST.flow_sessions(s, ["src_ip"]), "sessions", tmp_path).count() >= 1


def test_stream_into_table(spark, tmp_path):
    s = stream(spark, tmp_path, [(1, 5, "s", 1, 1), (2, 6, "s", 1, 1)]).withColumn("fingerprint", F.lit("f"))
    ST.into_table(s, str(tmp_path / "t"), str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(60)
    out = spark.read.parquet(ST.latest_generation(spark, str(tmp_path / "t")))
    assert [(r["occurrences"], r["packet_id"]) for r in out.collect()] == [(2, 2)]

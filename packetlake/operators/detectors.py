"""Behavioural detectors: packets in, rows that raise an alert out.

Each takes the packet relation and its own window and threshold, so that a
query can run on data of any density; ``run_all`` takes a DetectorConfig. Counts
are per key over the inclusive window [t - W, t]; an alert is the rising edge.
``exact=True`` keeps the first sighting of a value for its window instead of the
last one (see windows.first_seen_distinct).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from packetlake.config import DetectorConfig
from packetlake.functions import net
from packetlake.operators import sessions as S
from packetlake.operators import windows as W
from packetlake.operators.inspect import dns_inspect

#: Source ports of UDP services whose answers aren't probes (fixed values).
UDP_SERVICES = (53, 67, 68, 123, 161)
#: UDP ports of name services that a sweep may use.
NAME_PORTS = (137, 138)


def distinct_alerts(df: DataFrame, keys: list[str], value: str, window_us: int, threshold: int, exact: bool = False) -> DataFrame:
    count = W.first_seen_distinct if exact else W.sliding_distinct
    return W.rising_edge(count(df, keys, value, window_us), keys, threshold)


def count_alerts(df: DataFrame, keys: list[str], window_us: int, threshold: int) -> DataFrame:
    return W.rising_edge(W.sliding_count(df, keys, window_us), keys, threshold)


def port_scan(packets: DataFrame, window_us: int, threshold: int, keys: tuple[str, ...] = ("src_ip", "dst_ip"), exact: bool = False) -> DataFrame:
    """TCP probes of one class to many ports; ACK probes need answers and are left to ``ack_scan``, FIN+ACK probes never alert."""
    probes = packets.where("protocol = 'TCP'").withColumn("probe", net.probe_class(F.col("tcp_flags"))).where("probe NOT IN ('ack', 'maimon')")
    return distinct_alerts(probes, [*keys, "probe"], "dst_port", window_us, threshold, exact)


def udp_scan(packets: DataFrame, window_us: int, threshold: int, keys: tuple[str, ...] = ("src_ip", "dst_ip"), exact: bool = False) -> DataFrame:
    """UDP probes, and those quoted in ICMP port-unreachable answers."""
    probes = packets.where((F.col("protocol") == "UDP") & ~F.col("src_port").isin(*UDP_SERVICES))
    if "icmp_inner_protocol" in packets.columns:
        quoted = packets.where("icmp_type IN (1, 3) AND icmp_inner_protocol = 'UDP'")
        quoted = quoted.withColumns({c: F.col(f"icmp_inner_{c}") for c in ("src_ip", "dst_ip", "src_port", "dst_port")}).withColumn("protocol", F.lit("UDP"))
        probes = probes.unionByName(quoted)
    return distinct_alerts(probes, list(keys), "dst_port", window_us, threshold, exact)


def ack_scan(probes: DataFrame, answers: DataFrame, window_us: int, threshold: int) -> DataFrame:
    """ACK probes to many ports, at least one of which was answered with RST in the window after its probe.

    Both relations have packet_id, ts_us, src_ip, dst_ip and dst_port in the
    prober's direction. One relation is made of both, so nothing is joined: an
    answer counts if the latest probe of its port is inside the window.
    """
    keys = ["src_ip", "dst_ip"]
    cols = ["packet_id", "ts_us", *keys, "dst_port"]
    both = probes.select(*cols, F.lit(False).alias("answer")).unionByName(answers.select(*cols, F.lit(True).alias("answer")))
    probed = F.max(F.when(~F.col("answer"), F.col("ts_us"))).over(Window.partitionBy(*keys, "dst_port").orderBy("ts_us").rangeBetween(-window_us, 0))
    both = both.withColumn("probed", probed).where(~F.col("answer") | F.col("probed").isNotNull())
    both = both.withColumn("port", F.when(~F.col("answer"), F.col("dst_port")))
    n = W.sliding_distinct(both, keys, "port", window_us)
    n = n.withColumn("answers", F.count_if("answer").over(Window.partitionBy(*keys).orderBy("ts_us").rangeBetween(-window_us, 0)))
    n = n.withColumn("reached", F.when(F.col("answers") > 0, F.col("n")).otherwise(0))
    return W.rising_edge(n, keys, threshold, "reached").drop("port", "probed", "reached")


#: How a target can answer a probe.
ANSWERS = ("syn_ack", "rst", "icmp_unreachable")


def probe_answers(packets: DataFrame) -> DataFrame:
    """Answers to probes in the prober's direction, with their kind: SYN+ACK, RST, and the probes that ICMP errors quote."""
    cols, flags = ["packet_id", "ts_us", "src_ip", "dst_ip", "dst_port", "protocol"], F.col("tcp_flags")
    reset = net.has(flags, net.RST)
    tcp = packets.where((F.col("protocol") == "TCP") & (reset | net.has(flags, net.SYN | net.ACK)))
    tcp = tcp.select("packet_id", "ts_us", F.col("dst_ip").alias("src_ip"), F.col("src_ip").alias("dst_ip"), F.col("src_port").alias("dst_port"), "protocol", F.when(reset, "rst").otherwise("syn_ack").alias("kind"))
    if "icmp_inner_protocol" not in packets.columns:
        return tcp
    quoted = packets.where("(protocol = 'ICMP' AND icmp_type = 3 OR protocol = 'ICMPV6' AND icmp_type = 1) AND icmp_inner_protocol IN ('TCP', 'UDP')")
    return tcp.unionByName(quoted.select("packet_id", "ts_us", *(F.col(f"icmp_inner_{c}").alias(c) for c in cols[2:]), F.lit("icmp_unreachable").alias("kind")))


def scan_responses(probes: DataFrame, answers: DataFrame, window_us: int, keys: tuple[str, ...] = ("src_ip", "dst_ip")) -> DataFrame:
    """For each probe the distinct ports of its key in the window (``n``), and how many of them answered in each way.

    An answer counts if its port was probed in the window before it. A port is
    open from each sighting until the next one of its kind or W later, so one
    running sum for each kind gives all counts: two points a row, no join.
    """
    cols = ["packet_id", "ts_us", *keys, "dst_port"]
    both = probes.select(*cols, F.lit("n").alias("kind")).unionByName(answers.where(F.col("kind").isin(*ANSWERS)).select(*cols, "kind"))
    probe = F.col("kind") == "n"
    probed = F.max(F.when(probe, F.col("ts_us"))).over(Window.partitionBy(*keys, "dst_port").orderBy("ts_us").rangeBetween(-window_us, 0))
    both = both.withColumn("__probed", probed).where(probe | F.col("__probed").isNotNull())
    following = F.lead("ts_us").over(Window.partitionBy(*keys, "kind", "dst_port").orderBy("ts_us"))
    both = both.withColumn("__end", F.least(F.col("ts_us") + window_us + 1, following)).where(F.col("dst_port").isNotNull())
    point = lambda at, step: F.struct(F.col(at).alias("at"), F.lit(step).alias("step"))
    both = both.withColumn("__p", F.explode(F.array(point("ts_us", 1), point("__end", -1))))
    so_far = Window.partitionBy(*keys).orderBy("__p.at").rangeBetween(Window.unboundedPreceding, 0)
    both = both.withColumns({k: F.sum(F.when(F.col("kind") == k, F.col("__p.step")).otherwise(0)).over(so_far) for k in ("n", *ANSWERS)})
    return both.where(probe & (F.col("__p.step") == 1)).drop("kind", "__probed", "__end", "__p")


def is_discovery(packets: DataFrame):
    """Probes that look for hosts: echo requests, SYN, name service queries."""
    protocol = F.col("protocol")
    icmp = F.col("icmp_type") if "icmp_type" in packets.columns else F.lit(8)
    tcp = net.has(F.col("tcp_flags"), net.SYN) & (F.col("tcp_flags").bitwiseAND(F.lit(net.ACK | net.RST)) == 0)
    return ((protocol == "ICMP") & (icmp == 8)) | ((protocol == "ICMPV6") & (icmp == 128)) | ((protocol == "TCP") & tcp) | ((protocol == "UDP") & F.col("dst_port").isin(*NAME_PORTS))


def host_sweep(packets: DataFrame, window_us: int, threshold: int, remote_threshold: int | None = None, exact: bool = False) -> DataFrame:
    """One source probes many hosts the same way; public targets only with a threshold of their own."""
    probes = packets.where(is_discovery(packets)).withColumn("scope", net.target_scope(F.col("src_ip"), F.col("dst_ip")))
    probes = probes.withColumn("signature", F.when(F.col("protocol").isin("ICMP", "ICMPV6"), "echo").otherwise(F.col("dst_port").cast("string")))
    keys = ["src_ip", "protocol", "signature", "scope"]
    near = distinct_alerts(probes.where("scope <> 'public'"), keys, "dst_ip", window_us, threshold, exact)
    if remote_threshold is None:
        return near
    return near.unionByName(distinct_alerts(probes.where("scope = 'public'"), keys, "dst_ip", window_us, remote_threshold, exact))


def icmp_flood(packets: DataFrame, window_us: int, threshold: int) -> DataFrame:
    echo = packets.where(F.col("protocol").isin("ICMP", "ICMPV6"))
    if "icmp_type" in packets.columns:
        echo = echo.where("icmp_type IN (8, 128)")
    return count_alerts(echo, ["src_ip", "dst_ip", "protocol"], window_us, threshold)


def icmp_visibility(packets: DataFrame) -> DataFrame:
    echo = packets.where(F.col("protocol").isin("ICMP", "ICMPV6"))
    return echo.where("icmp_type IN (8, 128)") if "icmp_type" in packets.columns else echo


def dns_rate(queries: DataFrame, window_us: int, threshold: int) -> DataFrame:
    """Distinct query names of a source, or its queries where no name in the window could be read (``qname`` null)."""
    n = W.sliding_count(W.sliding_distinct(queries, ["src_ip"], "qname", window_us, "names"), ["src_ip"], window_us, "all_queries")
    return W.rising_edge(n.withColumn("n", F.when(F.col("names") > 0, F.col("names")).otherwise(F.col("all_queries"))), ["src_ip"], threshold)


def connection_failures(packets: DataFrame, window_us: int, threshold: int) -> DataFrame:
    return count_alerts(packets.where("protocol = 'TCP' AND tcp_flags IN (1, 4)"), ["src_ip", "dst_ip", "dst_port"], window_us, threshold)


def invalid_flags(packets: DataFrame) -> DataFrame:
    return packets.where((F.col("protocol") == "TCP") & net.has(F.col("tcp_flags"), net.SYN | net.FIN))


def syn_flood(syns: DataFrame, answers: DataFrame, keys: list[str], sequence: str, window_us: int, threshold: int) -> DataFrame:
    """Unanswered SYNs of a key: an answer (same key and sequence, later) takes its SYN out from then on.

    The next answer of each SYN comes from a window over both, not a join.
    """
    both = syns.withColumn("__answer", F.lit(False)).unionByName(answers.withColumn("__answer", F.lit(True)))
    later = Window.partitionBy(*keys, sequence).orderBy("ts_us").rangeBetween(1, Window.unboundedFollowing)
    both = both.withColumn("__at", F.min(F.when(F.col("__answer"), F.col("ts_us"))).over(later)).where("NOT __answer")
    counted = W.open_at(both.withColumn("__end", F.least(F.col("ts_us") + window_us + 1, "__at")), keys, "__end")
    return W.rising_edge(counted, keys, threshold).drop("__answer", "__at", "__end")


HTTP_REQUEST = r"^([A-Z]+)\s+(\S+)\s+HTTP/1\.[01]"


def http_enumeration(packets: DataFrame, window_us: int, threshold: int, payload: str = "payload", keys: tuple[str, ...] = ("src_ip", "dst_ip", "dst_port")) -> DataFrame:
    """Distinct request paths to a server."""
    paths = packets.withColumn("path", F.regexp_extract(payload, HTTP_REQUEST, 2)).where("path <> ''")
    return distinct_alerts(paths, list(keys), "path", window_us, threshold)


def latched_failures(packets: DataFrame, window_us: int, threshold: int) -> DataFrame:
    """The library's connection flood: RST or FIN, once until the key has been quiet for a window."""
    ends = packets.where((F.col("protocol") == "TCP") & (F.col("tcp_flags").bitwiseAND(F.lit(net.RST | net.FIN)) != 0))
    return W.first_per_island(ends, ["src_ip", "dst_ip", "dst_port"], window_us, threshold)


#: Alert text of each detector: number, severity, confidence, message.
PROFILE = {
    "icmp_visibility": (90001, "INFO", 20, "ICMP echo request seen"), "host_sweep": (90002, "HIGH", 90, "Host discovery sweep"), "port_scan": (90003, "HIGH", 85, "Port scan"), "udp_scan": (90003, "HIGH", 85, "UDP port scan"), "ack_scan": (90003, "HIGH", 85, "ACK scan"),
    "dns_rate": (90004, "MEDIUM", 65, "DNS query rate"), "connection_failures": (90005, "MEDIUM", 75, "Repeated connection failures"), "invalid_flags": (90006, "LOW", 90, "Invalid TCP flags"), "ssh_brute_force": (90007, "HIGH", 85, "SSH brute force"), "ftp_banner_grab": (90008, "MEDIUM", 75, "FTP banner grab"),
    "reverse_shell": (90009, "HIGH", 95, "Reverse shell"), "http_enumeration": (90010, "MEDIUM", 70, "HTTP enumeration"), "exploit_payload": (90011, "HIGH", 75, "Exploitation payload"), "multi_stage": (90012, "CRITICAL", 95, "Multi-stage attack"), "ftp_brute_force": (90013, "MEDIUM", 80, "FTP brute force"),
    "syn_flood": (90014, "HIGH", 85, "SYN flood"), "ssh_banner_grab": (90015, "MEDIUM", 70, "SSH banner grab"), "http_banner_grab": (90016, "MEDIUM", 70, "HTTP banner grab"), "icmp_flood": (90017, "HIGH", 85, "ICMP echo flood"),
}


#: What the count of a detector is called in its evidence.
COUNTED = {"host_sweep": "distinct_targets", "port_scan": "distinct_ports", "udp_scan": "distinct_ports", "ack_scan": "distinct_ports", "dns_rate": "queries", "http_enumeration": "distinct_paths", "ssh_brute_force": "distinct_client_ports"}


def as_alerts(hits: DataFrame, name: str) -> DataFrame:
    """Detector rows in the schema of alerts; the event id is a hash of detector and packet."""
    sid, severity, confidence, message = PROFILE[name]
    col = lambda c, kind: (F.col(c) if c in hits.columns else F.lit(None)).cast(kind).alias(c)
    facts = [(COUNTED.get(name, "count"), F.col("n") if "n" in hits.columns else F.lit(1))]
    facts += [(c, F.col(c)) for c in ("probe", "signature", "scope", "answers", "path", "version", "score", "recon_us") if c in hits.columns]
    evidence = F.concat_ws("; ", *(F.concat(F.lit(f"{k}="), v.cast("string")) for k, v in facts))
    sure = F.col("confidence").cast("int") if "confidence" in hits.columns else F.lit(confidence)
    return hits.select(
        F.lit(sid).cast("bigint").alias("sid"), "packet_id", "ts_us", col("src_ip", "string"), col("dst_ip", "string"), col("src_port", "int"), col("dst_port", "int"), col("protocol", "string"),
        F.lit(severity).alias("severity"), sure.alias("confidence"), F.lit(message).alias("message"), evidence.alias("evidence"), F.sha2(F.concat_ws("|", F.lit(name), F.col("packet_id").cast("string")), 256).alias("event_id"),
    )


def packet_hits(packets: DataFrame, cfg: DetectorConfig) -> dict[str, DataFrame]:
    """Rows of the detectors that work on single packets; those whose columns aren't there are left out."""
    w = cfg.us("scan_window")
    hits = {
        "icmp_visibility": icmp_visibility(packets), "icmp_flood": icmp_flood(packets, w, cfg.icmp_flood_threshold), "port_scan": port_scan(packets, w, cfg.port_threshold), "udp_scan": udp_scan(packets, w, cfg.port_threshold),
        "host_sweep": host_sweep(packets, w, cfg.ping_threshold, cfg.remote_sweep_threshold if cfg.remote_sweep_enabled else None), "connection_failures": connection_failures(packets, w, cfg.brute_force_threshold), "invalid_flags": invalid_flags(packets),
    }
    swapped = packets.where(F.col("protocol") == "TCP").where(net.has(F.col("tcp_flags"), net.RST)).withColumns({"src_ip": F.col("dst_ip"), "dst_ip": F.col("src_ip"), "dst_port": F.col("src_port")})
    hits["ack_scan"] = ack_scan(packets.where("protocol = 'TCP' AND tcp_flags = 16"), swapped, w, cfg.port_threshold)
    if "tcp_sequence" in packets.columns:
        key = ["src_ip", "dst_ip", "dst_port"]
        syns = packets.where("protocol = 'TCP' AND tcp_flags = 2").select("packet_id", "ts_us", *key, "protocol", F.col("tcp_sequence").alias("seq"))
        acks = packets.where("protocol = 'TCP' AND tcp_flags = 18").select("packet_id", "ts_us", F.col("dst_ip").alias("src_ip"), F.col("src_ip").alias("dst_ip"), F.col("src_port").alias("dst_port"), "protocol", (F.col("tcp_acknowledgment") - 1).alias("seq"))
        hits["syn_flood"] = syn_flood(syns, acks, key, "seq", w, cfg.syn_flood_threshold)
    if "payload" in packets.columns:
        binary = dict(packets.dtypes)["payload"] == "binary"
        text = packets.withColumn("__text", F.decode("payload", "ISO-8859-1") if binary else F.col("payload"))
        hits["http_enumeration"] = http_enumeration(text, cfg.us("http_enum_window"), cfg.http_enum_threshold, "__text")
        dns = packets.where("protocol = 'UDP' AND dst_port = 53 AND src_port <> 53")
        # a name that can't be read counts as a query without one
        names = dns_inspect(dns).withColumn("qname", F.when(~F.col("dns.response"), F.col("dns.qname"))).drop("dns") if binary else dns.withColumn("qname", F.lit(None).cast("string"))
        hits["dns_rate"] = dns_rate(names, w, cfg.dns_threshold)
    return hits


#: Detectors whose alerts count as reconnaissance of the target by the source.
RECON = ("host_sweep", "port_scan", "udp_scan", "ack_scan", "ssh_brute_force", "ssh_banner_grab", "ftp_brute_force", "ftp_banner_grab", "http_banner_grab", "http_enumeration", "exploit_payload")


def connection_hits(packets: DataFrame, cfg: DetectorConfig) -> dict[str, DataFrame]:
    """Rows of the detectors that judge whole connections, with the client as source whoever sent the packet that raised them."""
    conn = S.connections(S.connection_segments(packets, cfg.us("connection_idle_timeout")), (*S.CONNECTION, "connection"))
    thresholds = {"ssh": (cfg.ssh_banner_grab_threshold, "ssh_banner_grab_window"), "ftp": (cfg.ftp_grab_threshold, "ftp_enum_window"), "http": (cfg.http_banner_grab_threshold, "http_banner_grab_window")}
    shells = S.shell_scores(conn, cfg.us("reverse_shell_min_duration")).where("alert").withColumn("ts_us", F.coalesce("closed_us", "last_us"))
    hits = {
        "ssh_brute_force": S.ssh_brute_force(conn, cfg.us("ssh_brute_force_window"), cfg.ssh_brute_force_threshold), "ftp_brute_force": S.ftp_brute_force(conn, cfg.us("ftp_brute_force_window"), cfg.ftp_brute_force_threshold),
        **{f"{k}_banner_grab": S.banner_grabs(conn, cfg.us(window), n).where(F.col("kind") == k) for k, (n, window) in thresholds.items()},
        "reverse_shell": shells, "exploit_payload": S.exploit_payloads(conn).withColumn("ts_us", F.col("last_us")),
    }
    sides = {"src_ip": F.col("client_ip"), "src_port": F.col("client_port"), "dst_ip": F.col("server_ip"), "dst_port": F.col("service_port"), "protocol": F.lit("TCP")}
    return {name: h.withColumns(sides) for name, h in hits.items()}


def multi_stage_hits(hits: dict[str, DataFrame], window_us: int) -> DataFrame:
    """Reverse shells to a host that had looked the client over: the attacker is the source."""
    edges = [h.select("ts_us", F.col("src_ip").alias("attacker"), F.col("dst_ip").alias("victim")) for name, h in hits.items() if name in RECON]
    calls = hits["reverse_shell"].select("packet_id", "ts_us", F.col("src_ip").alias("client"), F.col("dst_ip").alias("server"))
    both = S.multi_stage(reduce(DataFrame.unionByName, edges), calls, window_us)
    return both.select("packet_id", "ts_us", F.col("attacker").alias("src_ip"), F.col("victim").alias("dst_ip"), F.lit("TCP").alias("protocol"), "recon_us")


def run_all(packets: DataFrame, cfg: DetectorConfig | None = None) -> DataFrame:
    """Alerts of all detectors over one packet relation (cache it if it is costly); those on connections need payloads."""
    cfg = cfg or DetectorConfig()
    if not cfg.enable_ipv6 and "ip_version" in packets.columns:
        packets = packets.where("ip_version IS NULL OR ip_version <> 6")
    hits = packet_hits(packets, cfg)
    if "payload" in packets.columns:
        hits |= connection_hits(packets, cfg)
        hits["multi_stage"] = multi_stage_hits(hits, cfg.us("correlation_window"))
    return reduce(DataFrame.unionByName, (as_alerts(h, name) for name, h in hits.items()))


def suppress_banners(alerts: DataFrame, sid: int = 1_000_003, ports: tuple[int, ...] = (22, 2222), client: str = "from_client") -> DataFrame:
    """Banner alerts of a rule: none on the service's own ports nor for the server's side; without event id, so that those of one service fold together.

    ``from_client`` says whether the client sent the packet; a missing one counts as yes.
    """
    mine = F.col("sid") == sid
    usual = F.coalesce(F.col("src_port").isin(*ports), F.lit(False)) | F.coalesce(F.col("dst_port").isin(*ports), F.lit(False))
    server = ~F.coalesce(F.col(client), F.lit(True)) if client in alerts.columns else F.lit(False)
    return alerts.where(~(mine & (usual | server))).withColumn("event_id", F.when(~mine, F.col("event_id")))

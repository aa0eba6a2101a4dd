"""Captured frames: duplicates, counters, traffic that doesn't come, and human-readable lines."""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from packetlake.functions import net
from packetlake.operators import windows as W

#: What two sightings of one frame share; the payload counts by digest and length.
FRAME_KEY = ("src_ip", "dst_ip", "protocol", "src_port", "dst_port", "ip_id", "tcp_flags", "tcp_sequence", "icmp_sequence")
log = logging.getLogger("packetlake")


def frame_key(packets: DataFrame) -> DataFrame:
    """Adds ``frame_key``: a digest of FRAME_KEY (missing values are values), payload digest and length. For IPv6 the fragment's id takes the place of ``ip_id``."""
    have = packets.columns
    number = F.when(F.col("ip_version") == 6, F.col("fragment_id")).otherwise(F.col("ip_id")) if {"ip_version", "fragment_id"} <= set(have) else F.col("ip_id") if "ip_id" in have else F.lit(None)
    value = lambda c: F.coalesce((number if c == "ip_id" else F.col(c) if c in have else F.lit(None)).cast("string"), F.lit("-"))
    payload = F.coalesce(F.col("payload").cast("binary"), F.lit(b"")) if "payload" in have else F.lit(b"")
    return packets.withColumn("frame_key", F.sha2(F.concat_ws("|", *(value(c) for c in FRAME_KEY), F.sha2(payload, 256), F.octet_length(payload).cast("string")), 256))


def deduplicated(packets: DataFrame, window_us: int) -> DataFrame:
    """Frames seen once: a copy within the window of the sighting that was kept goes, and doesn't extend it."""
    return W.anchored(frame_key(packets), ["frame_key"], window_us).drop("frame_key")


def counters(packets: DataFrame, prefix: str = "") -> dict[str, Column]:
    """Named counters of a relation, for ``agg`` or for ``observe``: packets, bytes, and packets by protocol."""
    one = lambda p: F.count_if(F.col("protocol") == p)
    return {f"{prefix}packets_processed": F.count("*"), f"{prefix}bytes_processed": F.coalesce(F.sum(F.col("length").cast("bigint")), F.lit(0)), **{f"{prefix}{p.lower()}": one(p) for p in ("TCP", "UDP", "ICMP")}}


def observed(packets: DataFrame, observation) -> DataFrame:
    """The packets as they are; ``observation`` has the counters once an action has run. Nothing is read twice."""
    return packets.observe(observation, *(c.alias(n) for n, c in counters(packets).items()))


def rule_metrics(matches: DataFrame, evaluated: int, loaded: int) -> DataFrame:
    """rules_loaded, rules_evaluated (rules by packets) and rules_matched, one row."""
    return matches.agg(F.lit(loaded).cast("bigint").alias("rules_loaded"), F.lit(evaluated).cast("bigint").alias("rules_evaluated"), F.count("*").alias("rules_matched"))


QUIET_SECONDS = 10
QUIET_HINTS = (
    "the switch's mirror session has source ports and this port as destination", "the cable from the mirror port is connected", "the mirror port passes the VLANs of the source ports", "the source ports carry traffic", "the process may capture",
)


def quiet_message(interface: str, seconds: float) -> str:
    """What to look at when no packet has come."""
    return f"No packets on mirror port {interface!r} for {seconds:.0f} s. Check that " + "; ".join(f"({i}) {h}" for i, h in enumerate(QUIET_HINTS, 1)) + "."


def check_mirror_port(interface: str, inventory: DataFrame) -> dict:
    """Whether an interface can serve as mirror port, by an inventory (name, capture_capable, link_up): ok, found, up and what is wrong."""
    if not interface:
        return {"ok": False, "found": False, "up": False, "error": "an interface name is needed"}
    row = inventory.where(F.col("name") == interface).limit(1).collect()
    if not row:
        return {"ok": False, "found": False, "up": False, "error": f"interface {interface!r} isn't there"}
    able = bool(row[0]["capture_capable"])
    # a port without link may come up later, so that is told but no error
    return {"ok": able, "found": True, "up": bool(row[0]["link_up"]), "error": None if able else f"interface {interface!r} can't capture"}


class QuietListener(StreamingQueryListener):
    """Warns once when a stream has had no rows for QUIET_SECONDS since it began."""

    def __init__(self, interface: str, warn=log.warning):
        self.interface, self.warn, self.seen, self.warned, self.began = interface, warn, False, False, None

    def onQueryStarted(self, event) -> None:
        self.began = None

    def take(self, seconds: float, rows: int) -> None:
        """A progress report: the time on the stream's clock and the rows it had."""
        self.began = seconds if self.began is None else self.began
        self.seen = self.seen or rows > 0
        if not self.seen and not self.warned and seconds - self.began >= QUIET_SECONDS:
            self.warned = True
            self.warn(quiet_message(self.interface, seconds - self.began))

    def onQueryProgress(self, event) -> None:
        from datetime import datetime

        self.take(datetime.fromisoformat(event.progress.timestamp.replace("Z", "+00:00")).timestamp(), event.progress.numInputRows)

    def onQueryIdle(self, event) -> None:
        from datetime import datetime

        self.take(datetime.fromisoformat(event.timestamp.replace("Z", "+00:00")).timestamp(), 0)

    def onQueryTerminated(self, event) -> None:
        pass


def alert_line(alerts: DataFrame) -> Column:
    """One alert for people: time in the session's zone, [gid:sid:rev], message, priority, protocol and endpoints; ports only where the protocol has some."""
    have = alerts.columns
    number = lambda c, default: F.coalesce(F.col(c), F.lit(default)).cast("string") if c in have else F.lit(str(default))
    protocol = F.upper(F.coalesce(F.nullif("protocol", F.lit("")), F.lit("IP")))
    port = lambda c: F.when(~protocol.isin("ICMP", "ICMPV6", "IP"), F.col(c))
    stamp = F.date_format(F.timestamp_micros("ts_us"), "MM/dd-HH:mm:ss.SSSSSS")
    return F.concat(
        stamp, F.lit("  [*] ["), number("gid", 1), F.lit(":"), number("sid", 0), F.lit(":"), number("rev", 1), F.lit("] "), F.coalesce("message", F.lit("Detection event")), F.lit(" [*]\n[Priority: "), number("priority", 3), F.lit("] {"), protocol, F.lit("} "),
        net.endpoint(F.col("src_ip"), port("src_port")), F.lit(" -> "), net.endpoint(F.col("dst_ip"), port("dst_port")),
    )


def rule_index(spark, texts: list[str]) -> DataFrame:
    """Rule metadata from the text of an index, six lines for a rule (severity, action, protocol, sid, revision, message); these rules have no content and can't match."""
    import re

    shape = re.compile(r"^(Critical|High|Medium|Low)\n(ALERT|LOG|PASS|DROP|REJECT)\n([A-Z0-9]+)\n(\d+)\n(\d+)\n([^\n]+)$", re.M)
    rows = [(int(m[4]), int(m[5]), m[2], m[3], m[1].upper(), m[6].strip(), False) for t in texts for m in shape.finditer(t)]
    return spark.createDataFrame(rows, "sid BIGINT, rev INT, action STRING, protocol STRING, severity STRING, message STRING, enabled BOOLEAN")

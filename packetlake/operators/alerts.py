"""Alerts and incidents: fingerprints, deduplication, episodes, grouping, state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetlake.functions import net
from packetlake.operators import windows as W

FINGERPRINT = ("gid", "sid", "rev", "src_ip", "dst_ip", "dst_port", "protocol", "service", "detection_type", "evidence", "message")


def fingerprint(columns: list[str], parts: tuple[str, ...] = FINGERPRINT, event_id: str | None = None) -> Column:
    """SHA-256 of an alert's identity; with an event id also its source port and the id. Missing addresses are empty, other missing values the word None."""
    fields = [*parts, *(["src_port", event_id] if event_id else [])]
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("" if c.endswith("_ip") else "None")) if c in columns else F.lit("1" if c in ("gid", "rev") else "")
    return F.sha2(F.concat_ws("|", *(text(c) for c in fields)), 256)


def deduplicated(alerts: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each fingerprint: first and last time, count, the packet seen last, and ``keep`` columns of that packet."""
    at = F.struct("ts_us", "packet_id")
    return alerts.groupBy("fingerprint").agg(F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"), F.count("*").alias("occurrences"), F.max_by("packet_id", at).alias("packet_id"), *(F.max_by(c, at).alias(c) for c in keep))


def merged(old: DataFrame, new: DataFrame) -> DataFrame:
    """Two deduplicated tables as one, for micro-batches; nothing but an aggregation by fingerprint."""
    rest = [c for c in old.columns if c not in ("fingerprint", "first_us", "last_us", "occurrences")]
    both = old.unionByName(new)
    return both.groupBy("fingerprint").agg(F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"), F.sum("occurrences").alias("occurrences"), *(F.max_by(c, "last_us").alias(c) for c in rest))


def episodes(alerts: DataFrame, keys: list[str], window_us: int) -> DataFrame:
    """Alerts that are emitted again: the first of a key, and each that comes over ``window_us`` after the last emitted one."""
    return W.anchored(alerts, keys, window_us)


def scored(alerts: DataFrame, severity: str = "severity", confidence: str = "confidence") -> DataFrame:
    risk = net.risk(F.col(severity), F.col(confidence))
    return alerts.withColumn("risk", risk).withColumn("priority", net.priority(F.col("risk")))


def unexpired(alerts: DataFrame, now_us: int, window_us: int) -> DataFrame:
    return alerts.where(F.col("last_us") >= now_us - window_us)


INCIDENT_KEYS = ("category", "src_ip", "dst_ip", "protocol")


def incident_alerts(alerts: DataFrame, window_us: int, keys: tuple[str, ...] = INCIDENT_KEYS) -> DataFrame:
    """Alerts with the incident they belong to: same keys, without a gap over the window. INFO alerts found none."""
    cut = W.islands(alerts.where("severity <> 'INFO'"), list(keys), window_us, "__island")
    return cut.withColumn("incident_id", F.sha2(F.concat_ws("|", *keys, F.col("__island").cast("string")), 256)).drop("__island")


def incidents(members: DataFrame, now_us: int | None = None, window_us: int | None = None, keys: tuple[str, ...] = INCIDENT_KEYS) -> DataFrame:
    """One row for each incident: span, number of alerts, highest severity, sets of sources and targets; resolved if idle over the window."""
    rank = net.severity_rank(F.col("severity"))
    out = members.groupBy("incident_id", *keys).agg(F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"), F.count("*").alias("alert_count"), F.max(rank).alias("__rank"), F.array_sort(F.collect_set("sid")).alias("sids"))
    out = out.withColumn("severity", F.element_at(F.lit(list(net.SEVERITIES)), F.col("__rank") + 1)).drop("__rank")
    if now_us is not None:
        out = out.withColumn("status", F.when(F.col("last_us") < now_us - window_us, "RESOLVED").otherwise("OPEN"))
    return out


def incident_risk(members: DataFrame, risk: str = "risk", occurrences: str = "occurrences") -> DataFrame:
    """Confidence, risk and events of each incident.

    An incident has the risk of its first alert; each further one gives the larger
    of both, and one more if it stands for several occurrences, up to 100. As the
    steps only rise, that is the largest of each alert's risk and the ones that
    follow it: a running sum, not a fold.
    """
    order = Window.partitionBy("incident_id").orderBy("ts_us", "packet_id")
    step = F.when(F.lag("ts_us").over(order).isNotNull() & (F.col(occurrences) > 1), 1).otherwise(0)
    later = Window.partitionBy("incident_id").orderBy(F.desc("ts_us"), F.desc("packet_id")).rowsBetween(Window.unboundedPreceding, 0)
    up = members.withColumn("__step", step).withColumn("__up", F.col(risk) + F.sum("__step").over(later))
    return up.groupBy("incident_id").agg(F.max("confidence").alias("confidence"), F.least(F.lit(100), F.max("__up")).cast("int").alias("risk"), F.sum(occurrences).cast("bigint").alias("event_count"))


def evict(incidents_: DataFrame, most: int) -> DataFrame:
    """The ``most`` newest incidents by first sighting: what is left when a table is bounded."""
    return incidents_.orderBy(F.desc("first_us"), F.desc("incident_id")).limit(most)


def with_overrides(incidents_: DataFrame, overrides: DataFrame) -> DataFrame:
    """Manual states (incident_id, status) over the computed ones."""
    o = overrides.select("incident_id", F.col("status").alias("__status"))
    return incidents_.join(o, "incident_id", "left").withColumn("status", F.coalesce("__status", "status")).drop("__status")


def confusion(rows: DataFrame, expected: Column, observed: Column) -> DataFrame:
    """Counts of a confusion matrix with precision, recall and F1; 0 where a denominator is 0."""
    c = rows.agg(F.count_if(expected & observed).alias("tp"), F.count_if(~expected & observed).alias("fp"), F.count_if(expected & ~observed).alias("fn"), F.count_if(~expected & ~observed).alias("tn"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    c = c.withColumns({"precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn"))})
    return c.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))

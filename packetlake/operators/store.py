"""Stored relations: filters, search, paging, exports, resets, and capture status."""

from __future__ import annotations

import dataclasses
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PAGE_SIZE, PAGE_MOST = 50, 500
ALERT_FIELDS, TRAFFIC_FIELDS = ("message", "src_ip", "dst_ip", "protocol", "severity"), ("src_ip", "dst_ip", "protocol")


def _is_number(term: str) -> bool:
    return term.isascii() and term.isdigit() and len(term) <= 18


def contains(col: str, term: str) -> Column:
    return F.contains(F.lower(F.coalesce(F.col(col).cast("string"), F.lit(""))), F.lit(term.lower()))


def search(term: str, fields: tuple[str, ...], numbers: tuple[str, ...] = ()) -> Column:
    """The term in any text field, or equal to a number field if it is one of up to 18 digits."""
    parts = [contains(c, term) for c in fields] + ([F.col(c) == int(term) for c in numbers] if _is_number(term) else [])
    return reduce(lambda a, b: a | b, parts)


@dataclasses.dataclass(frozen=True)
class Filter:
    """Equal (without case), contained, inclusive bounds of time, and a search term."""

    equal: dict[str, str | int] = dataclasses.field(default_factory=dict)
    containing: dict[str, str] = dataclasses.field(default_factory=dict)
    since_us: int | None = None
    until_us: int | None = None
    term: str | None = None
    fields: tuple[str, ...] = ALERT_FIELDS
    numbers: tuple[str, ...] = ("sid",)
    time: str = "ts_us"

    def apply(self, df: DataFrame) -> DataFrame:
        for c, v in self.equal.items():
            df = df.where(F.lower(c) == v.lower() if isinstance(v, str) else F.col(c) == v)
        for c, v in self.containing.items():
            df = df.where(contains(c, v))
        if self.since_us is not None:
            df = df.where(F.col(self.time) >= self.since_us)
        if self.until_us is not None:
            df = df.where(F.col(self.time) <= self.until_us)
        return df.where(search(self.term, self.fields, self.numbers)) if self.term else df


def paginate(df: DataFrame, order: list[Column], page: int = 1, size: int = PAGE_SIZE) -> DataFrame:
    """A page in order (give a unique last key); pages count from 1, sizes go from 1 to 500."""
    page, size = max(1, page), min(max(1, size), PAGE_MOST)
    return df.orderBy(*order).offset((page - 1) * size).limit(size)


def visible(alerts: DataFrame) -> DataFrame:
    return alerts.where(~F.col("severity").isin("LOW", "INFO"))


def latest(statistics: DataFrame, name: str = "name", time: str = "ts_us", tie: str = "id") -> DataFrame:
    """The newest row for each name."""
    w = Window.partitionBy(name).orderBy(F.desc(time), F.desc(tie))
    return statistics.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def unjustified(alerts: DataFrame, sid: int, pattern: str, threshold: int, evidence: str = "evidence") -> Column:
    """Alerts of a detector whose evidence names a count under the threshold."""
    n = F.regexp_extract(evidence, pattern, 1)
    return (F.col("sid") == sid) & (n != "") & (n.try_cast("bigint") < threshold)


RULE_FIELDS, INCIDENT_FIELDS = ("message", "protocol", "source_file"), ("category", "status", "explanation")


def search_rules(rules: DataFrame, term: str, everywhere: bool = False) -> DataFrame:
    """Rules whose message, protocol or file holds the term, or whose sid it is; ``everywhere`` looks through all plain columns."""
    if not everywhere:
        return rules.where(search(term, tuple(c for c in RULE_FIELDS if c in rules.columns), ("sid",)))
    plain = [c for c, kind in rules.dtypes if not kind.startswith(("array", "map", "struct", "binary"))]
    text = F.concat_ws(" ", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in plain))
    return rules.where(F.contains(F.lower(text), F.lit(term.lower())))


def search_incidents(incidents: DataFrame, term: str | None = None, status: str | None = None, category: str | None = None) -> DataFrame:
    equal = {k: v for k, v in (("status", status), ("category", category)) if v}
    return Filter(equal=equal, term=term, fields=tuple(c for c in INCIDENT_FIELDS if c in incidents.columns), numbers=()).apply(incidents)


def recent(df: DataFrame, n: int, time: str = "ts_us", tie: str = "packet_id") -> DataFrame:
    """The newest ``n`` rows, newest first: a top-k, not a sort."""
    return df.orderBy(F.desc(time), F.desc(tie)).limit(n)


def oldest(df: DataFrame, n: int, time: str = "last_us", tie: str = "packet_id") -> DataFrame:
    """The ``n`` rows that have been quiet for longest: what a bounded table would give up."""
    return df.orderBy(time, tie).limit(n)


def by_id(df: DataFrame, value, key: str = "alert_id") -> DataFrame:
    """The row with an id; the filter reaches the scan."""
    return df.where(F.col(key) == value)


def with_traffic(alerts: DataFrame, traffic: DataFrame, key: str = "packet_id") -> DataFrame:
    """Alerts with the traffic row that raised them (columns traffic_*), without one where it isn't kept."""
    rows = traffic.select(F.col(key).alias("__key"), *(F.col(c).alias(f"traffic_{c}") for c in traffic.columns if c != key))
    return alerts.join(rows, alerts[key] == F.col("__key"), "left").drop("__key")


def rule_metadata(rules: DataFrame, json: str = "rule_json", fields: tuple[str, ...] = ("message", "protocol", "category", "severity", "content", "direction")) -> DataFrame:
    """Fields of a rule from its row, else from its JSON (broken JSON counts as none), else null."""
    own = lambda c: F.nullif(F.col(c).cast("string"), F.lit("")) if c in rules.columns else F.lit(None).cast("string")
    return rules.select("gid", "sid", "rev", *(F.coalesce(own(c), F.get_json_object(json, f"$.{c}")).alias(c) for c in fields))


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A stored relation."""
    return spark.read.parquet(f"{root.rstrip('/')}/{name}")


def system_info(spark: SparkSession, **settings: str | int) -> DataFrame:
    """One row: time, zone and its offset, and the settings given (host, port, limits)."""
    now = F.current_timestamp()
    offset = F.unix_seconds(F.to_timestamp(F.date_format(now, "yyyy-MM-dd HH:mm:ss 'Z'"), "yyyy-MM-dd HH:mm:ss X")) - F.unix_seconds(now)
    return spark.range(1).select(F.unix_seconds(now).alias("epoch_seconds"), F.current_timezone().alias("timezone_name"), offset.alias("timezone_offset_seconds"), *(F.lit(v).alias(k) for k, v in sorted(settings.items())))


def table_stats(tables: dict[str, DataFrame], persisted: DataFrame | None = None) -> DataFrame:
    """(name, value): rows of each table, and the largest persisted value of each statistic."""
    counts = [t.agg(F.lit(n).alias("name"), F.count("*").alias("value")) for n, t in tables.items()]
    both = reduce(DataFrame.unionByName, counts)
    return both if persisted is None else both.unionByName(persisted.groupBy("name").agg(F.max("value").cast("bigint").alias("value")))


def purge(alerts: DataFrame, bridge: DataFrame, bad: Column) -> tuple[DataFrame, DataFrame]:
    """Alerts without the bad ones, and bridge rows of alerts that are left."""
    kept = alerts.where(~F.coalesce(bad, F.lit(False)))
    return kept, bridge.join(kept.select("alert_id"), "alert_id", "left_semi")


def drill_down(bridge: DataFrame, alerts: DataFrame) -> DataFrame:
    return bridge.join(alerts, "alert_id")


def export_json(df: DataFrame, out: str = "json") -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias(out))


def parse_time(value: Column) -> Column:
    """Seconds since 1970, or a date with or without time in the session's zone."""
    shapes = [F.try_to_timestamp(value, F.lit(f)) for f in ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd")]
    return F.coalesce(F.when(value.rlike("^[0-9]{1,18}$"), value.try_cast("bigint")), *(F.unix_seconds(s) for s in shapes))


def query_fields(query: Column) -> Column:
    """Fields of a query string, decoded; of equal names the first counts, at most 64 fields."""
    parts = F.slice(F.filter(F.split(query, "&"), lambda p: p != ""), 1, 64)
    decode = lambda s: F.coalesce(F.try_url_decode(s), s)
    pairs = F.transform(parts, lambda p: F.struct(decode(F.substring_index(p, "=", 1)).alias("key"), decode(F.when(F.contains(p, F.lit("=")), F.substring(p, F.locate("=", p) + 1, F.length(p))).otherwise("")).alias("value")))
    keys = F.array_distinct(F.transform(pairs, lambda e: e["key"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(pairs, lambda e: e["key"] == k), 1)["value"]))


def add_rule(rules: DataFrame, rule: DataFrame) -> DataFrame:
    """The rules with one more; an error if its gid, sid and revision are there already."""
    if rules.join(rule, ["gid", "sid", "rev"], "left_semi").limit(1).count():
        raise ValueError("a rule with this gid, sid and revision exists")
    return rules.unionByName(rule)


def set_enabled(rules: DataFrame, sid: int, enabled: bool) -> DataFrame:
    return rules.withColumn("enabled", F.when(F.col("sid") == sid, enabled).otherwise(F.col("enabled")))


def delete_rule(rules: DataFrame, sid: int) -> DataFrame:
    return rules.where(F.col("sid") != sid)


def reset(spark: SparkSession, root: str, tables: tuple[str, ...] = ("alerts", "incidents", "incident_alerts", "traffic", "statistics")) -> None:
    """Empties tables of a store, with their schemas; rules stay."""
    for t in tables:
        spark.createDataFrame([], spark.read.parquet(f"{root}/{t}").schema).write.mode("overwrite").parquet(f"{root}/{t}")


def append(df: DataFrame, path: str, date_of: str | None = None) -> None:
    """Appends rows, partitioned by day where ``date_of`` names the column of microseconds."""
    if date_of:
        df.withColumn("date", F.to_date(F.timestamp_micros(F.col(date_of)))).write.mode("append").partitionBy("date").parquet(path)
    else:
        df.write.mode("append").parquet(path)


def heartbeat_state(age_seconds: Column, last_packet_age: Column) -> Column:
    """STALE after 30 s without a heartbeat; else ACTIVE if a packet came in the last 10 s, IDLE if not."""
    return F.when(age_seconds > 30, "STALE").when(last_packet_age <= 10, "ACTIVE").otherwise("IDLE")


def loss_percent(received: Column, dropped: Column) -> Column:
    return F.when(received.isNull() | dropped.isNull() | (received + dropped == 0), -1.0).otherwise(dropped * 100.0 / (received + dropped))


#: Points of an interface for being chosen (fixed values).
INTERFACE_POINTS = {"capture_capable": 40, "operational": 25, "link_up": 20, "default_route": 30, "has_ipv4": 10, "has_ipv6": 5, "not_loopback": 15, "physical": 5, "virtual": -10, "link_down": -40, "loopback": -50, "admin_down": -60}


def rank_interfaces(inventory: DataFrame) -> DataFrame:
    """Interfaces by score, with the reason.

    ``inventory`` has stable_id, name and any of the boolean columns
    capture_capable, admin_down, operational, operational_down, link_up,
    link_down, default_route, has_ipv4, has_ipv6, loopback, physical (wired or
    wireless) and virtual. Suitable ones can capture and aren't down.
    """
    has = lambda c: F.coalesce(F.col(c), F.lit(False)) if c in inventory.columns else F.lit(False)
    flag = {c: has(c) for c in INTERFACE_POINTS} | {"not_loopback": ~has("loopback")}
    score = reduce(lambda a, b: a + b, (F.when(flag[c], p).otherwise(0) for c, p in INTERFACE_POINTS.items()))
    reason = (
        F.when(~has("capture_capable"), "can't capture").when(has("admin_down"), "switched off").when(has("operational_down"), "not operational").when(has("link_down"), "no link").when(has("default_route"), "default route")
        .when(has("virtual"), "virtual or tunnel").when(has("loopback"), "loopback").when(has("has_ipv4") | has("has_ipv6"), "has an address").otherwise("can capture")
    )
    suitable = has("capture_capable") & ~has("admin_down") & ~has("operational_down") & ~has("link_down")
    return inventory.withColumns({"score": score, "suitable": suitable, "reason": reason}).orderBy(F.desc("suitable"), F.desc("score"), "stable_id", "name")

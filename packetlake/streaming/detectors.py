"""Streaming twins: deduplication, flow sessions, alerts into a table, and stateful sliding-window detectors."""

from __future__ import annotations

from collections import Counter, deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from packetlake.operators import alerts as A

#: How late a packet may come.
LATE = "10 seconds"


def deduplicated(packets: DataFrame, keys: list[str], late: str = LATE) -> DataFrame:
    """Frames seen once within the watermark; a duplicate doesn't extend it."""
    return packets.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def flow_sessions(packets: DataFrame, keys: list[str], idle: str = "300 seconds", late: str = LATE) -> DataFrame:
    """Flows as session windows, given out once they are over."""
    grouped = packets.withWatermark("ts", late).groupBy(F.session_window("ts", idle), *keys)
    return grouped.agg(F.count("*").alias("packets"), F.sum(F.col("length").cast("bigint")).alias("bytes")).select(*keys, F.col("session_window.start").alias("started"), F.col("session_window.end").alias("ended"), "packets", "bytes")


def sliding_alerts(packets: DataFrame, keys: list[str], value: str | None, window_us: int, threshold: int, late: str = LATE) -> DataFrame:
    """Rising edges of the number of packets of a key, or of its distinct ``value``s, over [t - W, t].

    State is the window's (time, value) pairs and the last count; it goes by an
    event-time timer once the watermark has passed the window. Rows of a key are
    taken in event time within a micro-batch, and one that is older than the last
    counts for itself only, so a replay in order gives the batch detector's rows.
    """
    fields = ", ".join(f"`{k}` {packets.schema[k].dataType.simpleString()}" for k in keys)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        times, values, before = state.get if state.exists else ([], [], 0)
        window, counts = deque(zip(times, values, strict=True)), Counter(values)
        pdf = pd.concat(list(batches)).sort_values(["ts_us", "packet_id"], kind="stable")
        out = []
        rows = list(zip(pdf["ts_us"].tolist(), pdf["packet_id"].tolist(), pdf["__value"].tolist(), strict=True))
        i = 0
        while i < len(rows):
            j = i
            while j < len(rows) and rows[j][0] == rows[i][0]:  # rows of one time see each other
                if rows[j][2] is not None:
                    late = bool(window) and rows[j][0] < window[-1][0]
                    window.append((rows[j][0], rows[j][2]))
                    if late:
                        window = deque(sorted(window))
                    counts[rows[j][2]] += 1
                j += 1
            now = rows[i][0]
            while window and window[0][0] < now - window_us:
                gone = window.popleft()[1]
                counts[gone] -= 1
                if not counts[gone]:
                    del counts[gone]
            n = len(counts) if value else len(window)
            if n >= threshold > before:
                out.append((*key, rows[i][1], now, n))
            before, i = n, j
        times, values = [t for t, _ in window], [v for _, v in window]
        state.update((times, values, before))
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs() + 1, (max(times, default=0) + window_us) // 1000 + 1))
        if out:
            yield pd.DataFrame(out, columns=[*keys, "packet_id", "ts_us", "n"])

    source = packets.withWatermark("ts", late).withColumn("__value", (F.col(value).cast("string") if value else F.col("packet_id").cast("string")))
    return source.groupBy(*keys).applyInPandasWithState(step, f"{fields}, packet_id BIGINT, ts_us BIGINT, n BIGINT", "times ARRAY<BIGINT>, vals ARRAY<STRING>, before BIGINT", "append", GroupStateTimeout.EventTimeTimeout)


def into_table(alerts: DataFrame, path: str, checkpoint: str, keep: tuple[str, ...] = ()):
    """Starts a query that merges alerts into a deduplicated table, in two generations so that a reader always has a whole one."""

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = A.deduplicated(batch, keep)
        current = latest_generation(spark, path)
        merged = A.merged(spark.read.parquet(current), new) if current else new
        merged.write.mode("overwrite").parquet(f"{path}/generation={number}")

    return alerts.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)


def latest_generation(spark: SparkSession, path: str) -> str | None:
    """The newest whole generation of a table, by its success mark."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return None
    found = [s.getPath() for s in fs.listStatus(root) if fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    return max((str(p) for p in found), key=lambda p: int(p.rpartition("=")[2]), default=None)


def with_rules(packets: DataFrame, load: Callable[[], list[dict]], sink: Callable[[DataFrame], None], checkpoint: str):
    """Matches each micro-batch against the rules as they are then, so changed rules hold from the next one on."""
    from packetlake.operators import rules as R

    return packets.writeStream.foreachBatch(lambda batch, _: sink(R.match(batch, load()))).option("checkpointLocation", checkpoint)

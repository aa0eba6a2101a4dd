"""Sliding windows over event time, inclusive at both ends: [t - W, t].

Times are whole microseconds (``ts_us``), rows with one time see each other.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _over(keys: list[str]):
    return Window.partitionBy(*keys)


def sliding_count(df: DataFrame, keys: list[str], window_us: int, out: str = "n") -> DataFrame:
    return df.withColumn(out, F.count("*").over(_over(keys).orderBy("ts_us").rangeBetween(-window_us, 0)))


def open_at(df: DataFrame, keys: list[str], end: str, out: str = "n", counts: Column | None = None) -> DataFrame:
    """For each row how many rows of its key are open at its time, where a row is open from ``ts_us`` until before ``end``.

    A running sum of +1 at starts and -1 at ends: two points a row and one sort,
    whatever the window holds. Rows for which ``counts`` is false don't count.
    """
    step = F.lit(1) if counts is None else F.when(counts, 1).otherwise(0)
    both = df.withColumn("__step", step).withColumn("__p", F.explode(F.array(F.struct(F.col("ts_us").alias("at"), F.col("__step").alias("step"), F.lit(True).alias("row")), F.struct(F.col(end).alias("at"), (-F.col("__step")).alias("step"), F.lit(False).alias("row")))))
    n = F.sum("__p.step").over(_over(keys).orderBy("__p.at").rangeBetween(Window.unboundedPreceding, 0))
    return both.withColumn(out, n).where("__p.row").drop("__step", "__p")


def sliding_distinct(df: DataFrame, keys: list[str], value: str, window_us: int, out: str = "n") -> DataFrame:
    """Distinct values in the window, exactly and without sets: a value is open from each sighting until W later or its next sighting. Nulls don't count."""
    lead = F.lead("ts_us").over(_over([*keys, value]).orderBy("ts_us"))
    ends = df.withColumn("__end", F.least(F.col("ts_us") + window_us + 1, lead))
    return open_at(ends, keys, "__end", out, F.col(value).isNotNull()).drop("__end")


def rising_edge(df: DataFrame, keys: list[str], threshold: int, n: str = "n", order: tuple[str, ...] = ("ts_us", "packet_id")) -> DataFrame:
    """Rows where the count reaches the threshold, again only after it was below."""
    before = F.lag(n).over(_over(keys).orderBy(*order))
    return df.withColumn("__before", before).where((F.col(n) >= threshold) & (F.col("__before").isNull() | (F.col("__before") < threshold))).drop("__before")


def islands(df: DataFrame, keys: list[str], gap_us: int, out: str = "island", order: tuple[str, ...] = ("ts_us", "packet_id")) -> DataFrame:
    """Numbers stretches of a key without a gap over ``gap_us``, from 1."""
    w = _over(keys).orderBy(*order)
    new = F.when(F.col("ts_us") - F.lag("ts_us").over(w) > gap_us, 1).otherwise(0)
    return df.withColumn("__new", new).withColumn(out, 1 + F.sum("__new").over(w)).drop("__new")


def first_per_island(df: DataFrame, keys: list[str], window_us: int, threshold: int) -> DataFrame:
    """A latch that doesn't re-arm until the key's state has expired: the first crossing in each island."""
    hot = islands(sliding_count(df, keys, window_us), keys, window_us).where(F.col("n") >= threshold)
    w = _over([*keys, "island"]).orderBy("ts_us", "packet_id")
    return hot.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")


def anchored(df: DataFrame, keys: list[str], window_us: int, strict: bool = False) -> DataFrame:
    """Rows that open a window of their key: the first, and each that comes more than ``window_us`` after the last opener.

    Rows inside a window don't extend it, so this is an ordered fold, which
    starts anew after a gap over the window. The first row after a gap opens, and
    rows within the window of it can't, so window functions answer for all short
    stretches. What is left passes through Python in Arrow batches, in the
    order of the window's own sort and with one number of state, so a key of any
    length needs no memory and no further shuffle. With ``strict`` a window ends
    at (not after) ``window_us``.
    """
    w = _over(keys).orderBy("ts_us", "packet_id")
    before = F.lag("ts_us").over(w)
    fresh = before.isNull() | (F.col("ts_us") - before > window_us)
    late = F.col("ts_us") - F.max(F.when(F.col("__fresh"), F.col("ts_us"))).over(w)
    cut = df.withColumn("__fresh", fresh).withColumn("__late", late)
    cut = cut.where(F.col("__fresh") | (F.col("__late") >= window_us if strict else F.col("__late") > window_us)).drop("__late")
    least = window_us if strict else window_us + 1
    ts, first, width = cut.columns.index("ts_us"), len(cut.columns) - 1, len(df.columns)

    def fold(batches):
        last = 0
        for b in batches:
            keep = []
            for i, (t, new) in enumerate(zip(b.column(ts).to_pylist(), b.column(first).to_pylist(), strict=True)):
                if new or t - last >= least:
                    keep.append(i)
                    last = t
            yield b.select(range(width)).take(pa.array(keep, pa.int64()))

    return cut.sortWithinPartitions(*keys, "ts_us", "packet_id").mapInArrow(fold, df.schema)


def first_seen_distinct(df: DataFrame, keys: list[str], value: str, window_us: int, out: str = "n") -> DataFrame:
    """Distinct values where a repeated sighting doesn't refresh the first one (the exact mode of the scan detectors)."""
    opened = anchored(df.where(F.col(value).isNotNull()), [*keys, value], window_us)
    return sliding_distinct(opened, keys, value, window_us, out)


def evidence_list(values: Column, limit: int = 96, numeric: bool = False) -> Column:
    """Sorted distinct values, comma-joined, with the number of those left out."""
    s = F.array_sort(F.array_distinct(values))
    more = F.size(s) - limit
    text = F.array_join(F.transform(F.slice(s, 1, limit), lambda x: x.cast("string")), ", ")
    return F.when(more > 0, F.concat(text, F.lit(", ... (+"), more.cast("string"), F.lit(" more)"))).otherwise(text)

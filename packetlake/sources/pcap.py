"""Capture files as a relation of frames, in batch and as a stream of rotated files.

Files are read by Spark's own binary reader, so any store it knows works, and
split into records by Arrow batches. A file is one row until then (2 GB at
most); rotate captures below that, many files spread over many tasks.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: First bytes of a capture file: byte order and fraction of a second (fixed values).
MAGIC = {b"\xd4\xc3\xb2\xa1": ("<", 1_000_000), b"\xa1\xb2\xc3\xd4": (">", 1_000_000), b"\x4d\x3c\xb2\xa1": ("<", 1_000_000_000), b"\xa1\xb2\x3c\x4d": (">", 1_000_000_000)}
MAX_SNAPLEN = 262_144
#: Frames in an output batch.
BATCH = 4096


def records(data: bytes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]]:
    """Microseconds, captured lengths, original lengths and bytes of whole records, up to BATCH at a time; a cut-off last record is dropped."""
    if len(data) < 24 or data[:4] not in MAGIC:
        raise ValueError("not a capture file")
    order, parts = MAGIC[data[:4]]
    length = struct.Struct(order + "I").unpack_from
    at, stop = 24, len(data) - 16
    while at <= stop:
        places = []
        while at <= stop and len(places) < BATCH:
            captured = length(data, at + 8)[0]
            if captured > MAX_SNAPLEN or at + 16 + captured > len(data):
                stop = -1
                break
            places.append(at)
            at += 16 + captured
        if places:
            heads = np.frombuffer(b"".join([data[i : i + 16] for i in places]), order + "u4").reshape(-1, 4).astype(np.int64)
            sec, frac, captured, original = heads.T
            yield sec * 1_000_000 + frac * 1_000_000 // parts, captured, original, [data[i + 16 : i + 16 + n] for i, n in zip(places, captured.tolist(), strict=True)]


_ROWS = "file STRING, number BIGINT, ts_us BIGINT, captured_length INT, original_length INT, frame BINARY"
_ARROW = pa.schema([("file", pa.string()), ("number", pa.int64()), ("ts_us", pa.int64()), ("captured_length", pa.int32()), ("original_length", pa.int32()), ("frame", pa.binary())])


def _split(batches):
    for b in batches:
        for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            done = 0
            for us, captured, original, frames in records(content):
                n = len(frames)
                # lengths over 31 bits wrap, as INT does in Spark
                cols = [[path] * n, np.arange(done, done + n), us, captured.astype(np.int32), original.astype(np.int32), frames]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _ARROW, strict=True)], schema=_ARROW)
                done += n


def _frames(files: DataFrame) -> DataFrame:
    rows = files.select("path", "content").mapInArrow(_split, _ROWS)
    # a file that Spark reads as one value has under 2**27 records, which leaves 36 bits for the file: a clash gets likely at some 300,000 files
    number = F.xxhash64("file").bitwiseAND(F.lit((1 << 36) - 1)) * F.lit(1 << 27) + F.col("number")
    return rows.select(number.alias("packet_id"), "file", F.timestamp_micros("ts_us").alias("ts"), "ts_us", "captured_length", "original_length", "frame")


def read(spark: SparkSession, path: str, monotonic: bool = False) -> DataFrame:
    """Frames of all capture files under ``path``. ``monotonic`` replays each file with a clock that never goes back."""
    frames = _frames(spark.read.format("binaryFile").option("pathGlobFilter", "*.pcap").load(path))
    if monotonic:
        w = Window.partitionBy("file").orderBy("packet_id").rowsBetween(Window.unboundedPreceding, 0)
        frames = frames.withColumn("ts_us", F.max("ts_us").over(w)).withColumn("ts", F.timestamp_micros("ts_us"))
    return frames


def read_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """Frames of capture files as they are dropped into a folder."""
    source = spark.readStream.format("binaryFile").schema("path STRING, modificationTime TIMESTAMP, length BIGINT, content BINARY").option("pathGlobFilter", "*.pcap").option("maxFilesPerTrigger", files_per_trigger)
    return _frames(source.load(path))


def check_source(snaplen: int = 65_535, timeout_ms: int = 1000, interface: str | None = None, path: str | None = None) -> None:
    """Options of a source: snap length, timeout, and exactly one of interface and file."""
    if not 1 <= snaplen <= MAX_SNAPLEN:
        raise ValueError(f"snaplen must be 1 to {MAX_SNAPLEN}")
    if timeout_ms < 0:
        raise ValueError("timeout must not be negative")
    if bool(interface) == bool(path):
        raise ValueError("give an interface or a path")



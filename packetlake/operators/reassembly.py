"""TCP streams and IP fragments put together."""

from __future__ import annotations

import bisect

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fold_stream(seqs: list[int], payloads: list[bytes]) -> tuple[bytes, list[str]]:
    """Contiguous bytes from the first sequence number on, and what became of each segment.

    Bytes seen first win. accepted: new bytes; retransmission: nothing new and
    equal; overlap: partly new and equal where it overlaps; conflicting_overlap:
    differs from bytes seen before; ignored: empty.
    """
    starts: list[int] = []  # of the stretches without gaps that all segments make
    ends: list[int] = []
    for s, e in sorted((s, s + len(p)) for s, p in zip(seqs, payloads, strict=True) if p):
        if starts and s <= ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    data, there = ([bytearray(e - s) for s, e in zip(starts, ends, strict=True)] for _ in range(2))
    out = []
    for s, p in zip(seqs, payloads, strict=True):
        if not p:
            out.append("ignored")
            continue
        k = bisect.bisect_right(starts, s) - 1
        i, j = s - starts[k], s - starts[k] + len(p)
        old, seen = data[k][i:j], there[k][i:j]
        known = seen.count(1)
        new = p if not known else bytes(old) if known == len(p) else bytes(a if w else b for a, b, w in zip(old, p, seen, strict=True))
        if new != p:
            out.append("conflicting_overlap")
        elif known == len(p):
            out.append("retransmission")
        else:
            out.append("overlap" if known else "accepted")
        data[k][i:j] = new
        there[k][i:j] = b"\1" * len(p)
    return bytes(data[0]) if data else b"", out


def tcp_streams(segments: DataFrame, keys: list[str], sequence: str = "tcp_sequence", payload: str = "payload") -> DataFrame:
    """One row for each direction of a flow: contiguous data, segments, retransmissions, overlaps and whether there are gaps.

    An ordered fold, so a stream is one task's and has to fit in its memory; nothing of it is left out.
    """
    schema = ", ".join(f"`{k}` {segments.schema[k].dataType.simpleString()}" for k in keys)

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("packet_id", kind="stable")
        seqs, payloads = pdf[sequence].tolist(), [bytes(x) if x is not None else b"" for x in pdf[payload]]
        data, what = fold_stream(seqs, payloads)
        full = [(s, s + len(p)) for s, p in zip(seqs, payloads, strict=True) if p]
        gaps = bool(full) and max(e for _, e in full) > min(s for s, _ in full) + len(data)
        row = {k: pdf[k].iloc[0] for k in keys} | {"data": data, "segments": len(pdf), "retransmissions": what.count("retransmission"), "overlaps": what.count("overlap") + what.count("conflicting_overlap"), "gaps": gaps}
        return pd.DataFrame([row])

    return segments.groupBy(*keys).applyInPandas(fold, f"{schema}, data BINARY, segments INT, retransmissions INT, overlaps INT, gaps BOOLEAN")


def fragments(pieces: DataFrame, keys: list[str], offset: str = "offset", last: str = "last", data: str = "data") -> DataFrame:
    """Packets of which all fragments are there: the last one seen and offsets contiguous from 0. A repeated offset breaks it."""
    listed = F.array_sort(F.collect_list(F.struct(F.col(offset).cast("bigint").alias("o"), F.col(last).alias("l"), F.col(data).alias("d"))))
    grouped = pieces.groupBy(*keys).agg(listed.alias("__p"))
    end = F.aggregate("__p", F.lit(0).cast("bigint"), lambda at, p: F.when((at >= 0) & (p["o"] == at), at + F.length(p["d"])).otherwise(F.lit(-1).cast("bigint")))
    whole = (end >= 0) & F.element_at("__p", -1)["l"]
    joined = F.aggregate("__p", F.unhex(F.lit("")) if dict(pieces.dtypes)[data] == "binary" else F.lit(""), lambda a, p: F.concat(a, p["d"]))
    return grouped.where(whole).select(*keys, joined.alias("data"), F.size("__p").alias("fragments"))

"""Documents dealt into blocks, and tables of packed arrays between blocks and partitions.

Operators that need corpus-wide figures for every word of every text would
shuffle a row for each word. Instead a block (some megabytes of text) works in
numpy and exchanges packed arrays with partitions of keys: one row for a block
and a partition, holding what all words of the block have to ask there.
"""

from __future__ import annotations

import ctypes
import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROWS = "block long, part long, kind string, a binary, b binary, c binary, d binary, e binary, f binary"
_FIELDS = ("a", "b", "c", "d", "e", "f")


#: One of each for a worker: making them anew for every small array costs time and splinters memory.
_SQUEEZE, _UNSQUEEZE = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def pack(x: np.ndarray) -> bytes:
    """Compressed; whole numbers in the smallest type that holds them all, named by the first byte."""
    if x.dtype.kind in "iu" and (not x.size or int(x.min()) >= 0):
        top = int(x.max()) if x.size else 0
        kind = next(k for k in ("u1", "u2", "u4", "u8") if top < 1 << 8 * int(k[1]))
        return kind[1].encode() + _SQUEEZE.compress(x.astype(kind).tobytes())
    return (b"i" if x.dtype.kind in "iu" else b"f") + _SQUEEZE.compress(x.astype("i8" if x.dtype.kind in "iu" else "f8").tobytes())


def unpack(b: bytes) -> np.ndarray:
    kind = chr(b[0])
    x = np.frombuffer(_UNSQUEEZE.decompress(b[1:]), {"f": "f8", "i": "i8"}.get(kind, f"u{kind}"))
    return x if kind == "f" else x.astype(np.int64)


def keys(b: bytes) -> np.ndarray:
    return np.frombuffer(b, np.uint64)


def rows_table(rows: list[tuple]) -> pa.Table:
    """Rows of (block, part, kind, up to six binaries)."""
    cols = list(zip(*((*r, *[b""] * (9 - len(r))) for r in rows), strict=True)) if rows else [()] * 9
    kinds = (pa.int64(), pa.int64(), pa.string(), *[pa.binary()] * 6)
    return pa.table({n: pa.array(list(c), k) for n, c, k in zip(("block", "part", "kind", *_FIELDS), cols, kinds, strict=True)})


def by_part(part: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """A stable order by partition, and (partition, from, to) of its stretches."""
    order = np.argsort(part, kind="stable")
    if not len(part):
        return order, []
    p = part[order]
    starts = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])
    return order, list(zip(p[starts].tolist(), starts.tolist(), np.r_[starts[1:], len(p)].tolist(), strict=True))


#: Batches are dealt together up to so many bytes, whatever Spark's limit for one, so that a block gets few large pieces.
DEAL_BYTES = 16 << 20


def _gathered(batches):
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.nbytes
        if size >= DEAL_BYTES:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _deal(batches):
    for table in _gathered(batches):
        order, runs = by_part(table.column("block").to_numpy())
        table = table.drop_columns(["block"]).take(order)
        blocks, blobs = [], []
        for k, i, j in runs:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                w.write_table(table.slice(i, j - i))
            blocks.append(k)
            blobs.append(sink.getvalue().to_pybytes())
        yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array(blobs, pa.binary())], names=["block", "rows"])


def tidy() -> None:
    """Gives back memory that the last block's arrays and objects left with the allocators; workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


try:
    _LIBC = ctypes.CDLL("libc.so.6")
except OSError:  # another C library
    _LIBC = None


def dealt(table: pa.Table) -> pa.Table:
    """The documents of a block."""
    tidy()
    return pa.concat_tables([pa.ipc.open_stream(x).read_all() for x in table.column("rows").to_pylist()])


def count(docs: DataFrame, text_col: str, block_chars: int) -> int:
    """How many blocks of about ``block_chars`` the texts make (and as many partitions of keys)."""
    chars = docs.agg(F.sum(F.length(text_col))).first()[0] or 0
    return max(2, math.ceil(chars / block_chars))


def deal(rows: DataFrame, parts: int, *by: str | Column) -> DataFrame:
    """Rows (block, rows): the documents by the hash of ``by``, compressed."""
    return rows.withColumn("block", F.pmod(F.xxhash64(*by), F.lit(parts))).mapInArrow(_deal, "block long, rows binary")

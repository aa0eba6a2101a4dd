"""Shared plumbing: run a per-batch text function inside ``mapInArrow``.

Every operator here follows the same rules for odd inputs: a null text is an
empty text unless the operator says otherwise, repeated rows each give a row,
an empty table gives an empty result of the same schema, and input columns
that are not asked for are never read, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .blocks import tidy

#: Texts are handed to the per-batch functions in slices of about so many characters.
SLICE_CHARS = 2_000_000

#: ``bytes.split()`` without arguments cuts at exactly \x20 and \x09-\x0D.
def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split() if text else []


_UPPER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def lower_words(text: str | None) -> list[bytes]:
    """Words after lower-casing A-Z only."""
    return text.encode("utf-8", "surrogatepass").translate(_UPPER).split() if text else []


def hash_words(ws: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, ws), np.uint64, len(ws))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, so that sums of products spread over all bits."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


#: Odd multipliers for positions in an n-gram, from a fixed rule.
def multipliers(n: int, seed: int = 1) -> np.ndarray:
    return mix(np.arange(seed * 1000, seed * 1000 + n, dtype=np.uint64)) | np.uint64(1)


def gram_hashes(h: np.ndarray, n: int, seed: int = 1) -> np.ndarray:
    """One 64-bit hash for each run of ``n`` consecutive word hashes."""
    m = len(h) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(m, np.uint64)
    for j, c in enumerate(multipliers(n, seed)):
        out += h[j : j + m] * c
    return mix(out)


def slices(texts: list, limit: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``limit`` characters each (one row at least)."""
    lo = total = 0
    for i, t in enumerate(texts):
        total += len(t) if t else 0
        if total >= limit:
            yield lo, i + 1
            lo, total = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def map_texts(df: DataFrame, text_col: str, keep: list[str], fields: list[T.StructField], make: Callable[[], Callable[[list], dict]]) -> DataFrame:
    """``df[keep]`` plus ``fields`` computed from the texts.

    ``make()`` runs once per task and returns a function from a list of texts
    (None for null) to a dict of columns. A kept column that has the name of a
    field gives way to the field.
    """
    names = {f.name for f in fields}
    keep = [c for c in keep if c not in names]
    src = df.select(*[df[c] for c in keep], df[text_col].alias("__text"))
    schema = T.StructType([*(df.schema[c] for c in keep), *fields])
    arrow = to_arrow_schema(schema)
    types = {f.name: arrow.field(f.name).type for f in fields}

    def run(batches):
        tidy()
        fn = make()
        for b in batches:
            texts = b.column(len(keep)).to_pylist()
            for lo, hi in slices(texts):
                cols = fn(texts[lo:hi])
                made = [pa.array(cols[f.name], types[f.name]) for f in fields]
                kept = [b.column(i).slice(lo, hi - lo).cast(arrow.field(i).type) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*kept, *made], schema=arrow)
        b = texts = cols = made = kept = None
        tidy()

    return src.mapInArrow(run, schema)

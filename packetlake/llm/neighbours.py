"""Approximate nearest neighbours (operator 4): stable projections in kd-trees with a chi-square stopping test.

Largest inner product becomes smallest distance by one more coordinate,
sqrt(M^2 - |x|^2) with M the largest norm, and queries scaled to norm M. Vectors
are projected by DIMS Gaussian (2-stable) directions, so the squared projected
distance over the squared distance is chi-square distributed with DIMS degrees
of freedom. Vectors are dealt into cells, the leaves of a kd-tree over a bounded
sample of projections; in each cell a kd-tree over the projections is built. A
query takes the leaves of its cell's tree in order of projected distance and
verifies their vectors exactly until the test holds: with d the distance of the
k-th best so far and r the projected distance of the next leaf, it stops as soon
as P(chi2 <= r^2 / d^2) >= CONFIDENCE. The k-th distance of its home cell then
decides by the same test which other cells it has to visit.

Equal vectors are one point that carries its k+1 smallest ids, which is all that
the k nearest with ties to smaller ids can need. Vectors that are null, empty,
zero, or hold null or non-finite components take no part, nor do those of
another length than the most frequent one (the shorter on a tie). A repeated
row counts once; of different vectors with one id each is a candidate and the
smallest is the query. With k candidates or fewer all of them are returned.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .durable import saved

#: Degrees of freedom, the test's confidence, points in a leaf, in a cell, queries of a cell that are searched in one group.
DIMS, CONFIDENCE, LEAF, CELL, GROUP = 8, 0.9, 48, 16_384, 20_000
#: The cells are fitted on about so many projections, and on so many for each cell at least.
SAMPLE, EACH = 20_000, 16
#: Gaps between queries and cells worked out together.
GAPS = 2_000_000
#: Queries searched together.
TOGETHER = 128


def chi_square(x: np.ndarray, dims: int = DIMS) -> np.ndarray:
    """Distribution function for an even number of degrees of freedom."""
    h = np.minimum(x, 1e4) / 2
    term, total = np.ones_like(h), np.ones_like(h)
    for j in range(1, dims // 2):
        term = term * h / j
        total = total + term
    return 1 - np.exp(-h) * total


def directions(size: int) -> np.ndarray:
    return np.random.default_rng(20240229).standard_normal((size + 1, DIMS))


def lifted(x: np.ndarray, norm: float) -> np.ndarray:
    rest = np.sqrt(np.maximum(norm**2 - (x * x).sum(1), 0))
    return np.column_stack([x, rest])


def lifted_queries(q: np.ndarray, norm: float) -> np.ndarray:
    return np.column_stack([q * (norm / np.sqrt((q * q).sum(1)))[:, None], np.zeros(len(q))])


def _leaves(points: np.ndarray, most: int) -> list[np.ndarray]:
    """Rows of each leaf of a kd-tree: halves along the widest coordinate until ``most`` rows or equal points are left."""
    out, todo = [], [np.arange(len(points))]
    while todo:
        rows = todo.pop()
        if len(rows) <= most:
            out.append(rows)
            continue
        p = points[rows]
        axis = int(np.ptp(p, axis=0).argmax())
        half = len(rows) // 2
        order = np.argpartition(p[:, axis], half)
        todo += [rows[order[half:]], rows[order[:half]]]
    return out


class Cells:
    """A kd-tree over a sample: split axis and value of each inner node, breadth first, 2**depth cells."""

    def __init__(self, sample: np.ndarray, depth: int):
        self.depth = depth
        self.axis, self.cut = np.zeros(1 << depth, np.int64), np.zeros(1 << depth)
        groups = {1: sample}
        for node in range(1, 1 << depth):
            p = groups.pop(node)
            if len(p):
                a = int(np.ptp(p, axis=0).argmax())
                self.axis[node], self.cut[node] = a, np.median(p[:, a])
            left = p[:, self.axis[node]] < self.cut[node]
            groups[2 * node], groups[2 * node + 1] = p[left], p[~left]

    def find(self, p: np.ndarray) -> np.ndarray:
        node = np.ones(len(p), np.int64)
        for _ in range(self.depth):
            node = 2 * node + (p[np.arange(len(p)), self.axis[node]] >= self.cut[node])
        return node - (1 << self.depth)

    @functools.cached_property
    def bounds(self) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper corner of each cell's region, level by level."""
        lo, hi = np.full((1, DIMS), -np.inf), np.full((1, DIMS), np.inf)
        for level in range(self.depth):
            up = np.arange(1 << level, 2 << level)
            a, c, at = self.axis[up], self.cut[up], np.arange(len(up))
            lo, hi = np.repeat(lo, 2, axis=0), np.repeat(hi, 2, axis=0)
            hi[2 * at, a] = np.minimum(hi[2 * at, a], c)
            lo[2 * at + 1, a] = np.maximum(lo[2 * at + 1, a], c)
        return lo, hi

    def gaps(self, p: np.ndarray) -> np.ndarray:
        """Squared projected distance of each point to each cell's region (a lower bound), point by cell."""
        lo, hi = self.bounds
        out = np.zeros((len(p), len(lo)))
        for a in range(DIMS):
            x = p[:, a : a + 1]
            out += np.maximum(np.maximum(lo[:, a] - x, x - hi[:, a]), 0) ** 2
        return out


def _matrix(column: pa.ChunkedArray, size: int) -> np.ndarray:
    flat = column.combine_chunks().flatten() if column.num_chunks != 1 else column.chunk(0).flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)


def products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products row by row, always added in the same order."""
    return np.einsum("...d,...d->...", x, q)


def _search(points: np.ndarray, queries: np.ndarray, norm: float, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and inner products of each query's ``k`` best among ``points`` (row -1: none), by the stopping test."""
    r = directions(points.shape[1])
    proj, qproj = lifted(points, norm) @ r, lifted_queries(queries, norm) @ r
    leaves = _leaves(proj, LEAF)
    wide = max(map(len, leaves))
    table = np.full((len(leaves), wide), -1)
    for i, rows in enumerate(leaves):
        table[i, : len(rows)] = rows
    lo = np.stack([proj[x].min(0) for x in leaves])
    hi = np.stack([proj[x].max(0) for x in leaves])
    length = np.sqrt((queries * queries).sum(1))
    best = np.full((len(queries), k), -1)
    score = np.full((len(queries), k), -np.inf)
    for at in range(0, len(queries), TOGETHER):
        sel = np.arange(at, min(at + TOGETHER, len(queries)))
        p = qproj[sel]
        gap = np.zeros((len(sel), len(leaves)))
        for a in range(DIMS):
            x = p[:, a : a + 1]
            gap += np.maximum(np.maximum(lo[:, a] - x, x - hi[:, a]), 0) ** 2
        order = np.argsort(gap, axis=1, kind="stable")
        live = np.arange(len(sel))
        for step in range(len(leaves)):
            leaf = order[live, step]
            kth = score[sel[live], -1]
            # squared distance of the k-th best; infinite while there are fewer
            d2 = np.where(np.isfinite(kth), 2 * norm**2 - 2 * norm * np.where(np.isfinite(kth), kth, 0) / length[sel[live]], np.inf)
            test = chi_square(np.where(np.isfinite(d2), gap[live, leaf] / np.maximum(d2, 1e-12), 0))
            go = test < CONFIDENCE
            live, leaf = live[go], leaf[go]
            if not len(live):
                break
            rows = table[leaf]
            s = np.where(rows >= 0, products(points[rows], queries[sel[live]][:, None, :]), -np.inf)
            all_s, all_r = np.concatenate([score[sel[live]], s], 1), np.concatenate([best[sel[live]], rows], 1)
            top = np.argsort(-all_s, axis=1, kind="stable")[:, :k]
            score[sel[live]] = np.take_along_axis(all_s, top, 1)
            best[sel[live]] = np.where(np.take_along_axis(all_s, top, 1) > -np.inf, np.take_along_axis(all_r, top, 1), -1)
    return best, score


RESULT = "query_id long, vec_id long, score double, kth double"


def _cell_search(size: int, norm: float, k: int):
    def run(points: pa.Table, queries: pa.Table) -> pa.Table:
        out: dict[str, list] = {"query_id": [], "vec_id": [], "score": [], "kth": []}
        if points.num_rows and queries.num_rows:
            x, q = _matrix(points.column("v"), size), _matrix(queries.column("v"), size)
            own, ids = queries.column("query_id").to_pylist(), points.column("ids").to_pylist()
            best, score = _search(x, q, norm, k + 1)  # one more, as the query itself may be among them
            for i, me in enumerate(own):
                got = [(-s, v) for r, s in zip(best[i].tolist(), score[i].tolist(), strict=True) if r >= 0 for v in ids[r] if v != me]
                got = sorted(got)[:k]
                kth = -got[-1][0] if len(got) == k else -math.inf
                out["query_id"] += [me] * len(got)
                out["vec_id"] += [v for _, v in got]
                out["score"] += [-s for s, _ in got]
                out["kth"] += [kth] * len(got)
        return pa.table({"query_id": pa.array(out["query_id"], pa.int64()), "vec_id": pa.array(out["vec_id"], pa.int64()), "score": pa.array(out["score"], pa.float64()), "kth": pa.array(out["kth"], pa.float64())})

    return run


def nearest(vectors: DataFrame, is_query, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, cell: int = CELL) -> DataFrame:
    """query_id, rank, id and score of the ``k`` nearest found for every row that ``is_query`` (a condition) holds for."""
    spark = vectors.sparkSession
    v = F.col(vector_col)
    usable = vectors.where(F.col(id_col).isNotNull() & v.isNotNull() & (F.size(v) > 0))
    usable = usable.where(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf))) & F.exists(v, lambda x: x != 0))
    sizes = usable.groupBy(F.size(v).alias("size")).count().orderBy(F.desc("count"), "size").first()
    empty = spark.createDataFrame([], f"query_id long, rank int, {id_col} long, score double")
    if sizes is None:
        return empty
    size = sizes["size"]
    usable = usable.where(F.size(v) == size).select(F.col(id_col).cast("long").alias("id"), F.transform(v, lambda x: x.cast("double")).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q")).dropDuplicates(["id", "v"])
    total = usable.agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("m")).first()
    norm = math.sqrt(total["m"]) * (1 + 1e-12)

    first = Window.partitionBy("v").orderBy("id")
    points = usable.withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    depth = max(0, math.ceil(math.log2(max(1, total["n"] / cell))))
    r = directions(size)
    want = max(SAMPLE, EACH << depth) if depth else 1

    def projected(batches):
        for b in batches:
            if b.num_rows:
                p = lifted(_matrix(pa.Table.from_batches([b]).column("v"), size), norm) @ r
                yield pa.RecordBatch.from_arrays([pa.array(p.tolist(), pa.list_(pa.float64()))], names=["p"])

    share = usable.where(F.pmod(F.xxhash64("id"), F.lit(total["n"])) < want) if depth else usable.limit(1)
    sample = share.select("v").mapInArrow(projected, "p array<double>").toPandas()["p"]
    cells = Cells(np.array(sample.tolist(), float).reshape(-1, DIMS), depth)

    def place(batches):
        for b in batches:
            t = pa.Table.from_batches([b])
            if t.num_rows:
                c = cells.find(lifted(_matrix(t.column("v"), size), norm) @ r)
                yield from t.append_column("cell", pa.array(c)).to_batches()

    points = points.select("v", "ids").mapInArrow(place, "v array<double>, ids array<long>, cell long")
    at = usable.where("q").groupBy("id").agg(F.min("v").alias("v")).select(F.col("id").alias("query_id"), "v")

    def home(batches):
        for b in batches:
            t = pa.Table.from_batches([b])
            if t.num_rows:
                c = cells.find(lifted_queries(_matrix(t.column("v"), size), norm) @ r)
                yield from t.append_column("cell", pa.array(c)).to_batches()

    def others(batches):
        for b in batches:
            t = pa.Table.from_batches([b])
            if not t.num_rows:
                continue
            q = _matrix(t.column("v"), size)
            p = lifted_queries(q, norm) @ r
            kth = np.array([-math.inf if x is None else x for x in t.column("kth").to_pylist()])
            d2 = np.where(np.isfinite(kth), 2 * norm**2 - 2 * norm * np.where(np.isfinite(kth), kth, 0) / np.sqrt((q * q).sum(1)), np.inf)
            own, step = cells.find(p), max(1, GAPS >> depth)
            for i in range(0, len(q), step):
                some = slice(i, i + step)
                visit = chi_square(np.where(np.isfinite(d2[some])[:, None], cells.gaps(p[some]) / np.maximum(d2[some], 1e-12)[:, None], 0)) < CONFIDENCE
                visit[np.arange(len(visit)), own[some]] = False
                row, c = np.nonzero(visit)
                yield from t.select(["query_id"]).take(row + i).append_column("cell", pa.array(c)).to_batches()

    run = _cell_search(size, norm, k)

    def searched(visits: DataFrame) -> DataFrame:
        """The best of each query (query_id, v, cell) in its cell. A cell that more than GROUP queries visit serves them in groups, each with a copy of its points."""
        chunks = visits.groupBy("cell").agg(F.ceil(F.count("*") / GROUP).alias("chunks"))
        copies = points.join(chunks, "cell").select("v", "ids", "cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("grp"))
        dealt = visits.join(chunks, "cell").select("query_id", "v", "cell", F.pmod(F.xxhash64("query_id"), F.col("chunks")).alias("grp"))
        return copies.groupBy("cell", "grp").cogroup(dealt.groupBy("cell", "grp")).applyInArrow(run, RESULT)

    near = saved(searched(at.mapInArrow(home, "query_id long, v array<double>, cell long")))
    if not depth:
        out = near
    else:
        kths = near.groupBy("query_id").agg(F.max("kth").alias("kth"))
        rest = saved(at.join(kths, "query_id", "left").select("query_id", "v", "kth").mapInArrow(others, "query_id long, cell long"))
        out = near.unionByName(searched(rest.join(at, "query_id")))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    out = out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return out.select("query_id", "rank", F.col("vec_id").alias(id_col), "score")

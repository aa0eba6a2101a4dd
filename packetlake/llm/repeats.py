"""Substring dedup (operator 3): prefix-partitioned suffix trees over words.

A suffix is every place with at least WINDOW words left in its document. The
prefix that places it in a group has a variable length: it ends with the
smallest hash among the runs of GRAM words in the suffix's first WINDOW words,
so it has GRAM to WINDOW words, suffixes with the same first WINDOW words have
the same prefix, and neighbouring suffixes mostly share its end. Neighbouring
suffixes of a document with one such end make a segment, which is sent once.

1. Blocks of documents send each distinct segment (end of prefix, hash, smallest
   and largest document) to the partition of its end, which answers whether the
   end occurs in one document only (nothing can repeat), in one segment only (its
   smallest document holds for every suffix), or in several.
2. For the last, the block with a segment's smallest document sends its words.
   The partition builds the tree of its groups' suffixes (sorted, with the depth
   at which neighbours part); the smallest document below an internal node of
   depth WINDOW answers for all suffixes of it. Groups of more than SPLIT segments are split
   by their longest prefix: each suffix goes by all its WINDOW words (128 bits of
   hash) to a partition of its own.
3. Blocks remove the words of every suffix whose node has a smaller document.

Segments and split suffixes are compared by 128 bits of hash, words in trees by 64.

Null and empty texts have no words and the digest of nothing. Documents with a
null id neither lose words nor take them from others. Repeated rows with one id
each give a row and don't remove each other's words; empty tables give no rows;
other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import gram_hashes, hash_words, mix, words
from .blocks import ROWS, by_part, count, deal, dealt, keys, pack, rows_table, unpack
from .durable import saved

WINDOW, GRAM = 50, 8
#: Segments of a group at most, before it is split.
SPLIT = 20_000
BLOCK_CHARS = 3_000_000
NONE, ONE, TREE, SPREAD = range(4)
#: Stands for "no document", which is smaller than none.
NOBODY = np.int64(2**63 - 1)
STEP = np.uint64(0x9E3779B97F4A7C15)
STEPS = (STEP, np.uint64(0xC2B2AE3D27D4EB4F))


def distinct(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct rows of 128-bit keys (two columns) in order, the first place of each, and each row's number among them."""
    order = np.lexsort((pairs[:, 1], pairs[:, 0]))
    x = pairs[order]
    new = np.r_[True, (x[1:] != x[:-1]).any(1)][: len(x)]
    at = np.empty(len(x), np.int64)
    at[order] = np.cumsum(new) - 1
    return x[new], order[new], at  # lexsort is stable, so these are first places


def leftmost_min(v: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` values the place of its leftmost smallest."""
    at, m, have = np.arange(len(v)), v, 1
    while have < width:
        step = min(have, width - have)
        right = m[step:] < m[:-step]
        at, m = np.where(right, at[step:], at[:-step]), np.where(right, m[step:], m[:-step])
        have += step
    return at


def range_hashes(h: np.ndarray):
    """A function that gives the 128-bit hashes (two columns) of words [s, e) for arrays of s and e: two polynomials of the words' own hashes."""
    n, made = len(h), []
    for i, step in enumerate(STEPS):
        up = np.cumprod(np.r_[np.uint64(1), np.full(n, step)])
        down = np.cumprod(np.r_[np.uint64(1), np.full(n, np.uint64(pow(int(step), -1, 1 << 64)))])
        made.append((np.r_[np.uint64(0), np.cumsum(mix(h + np.uint64(i)) * up[:n])], down))
    return lambda s, e: np.stack([mix((total[e] - total[s]) * down[s]) for total, down in made], 1)


class Segments:
    """The segments of a block's documents: first suffix, number of suffixes, document, group, key; and the block's distinct ones."""

    def __init__(self, table: pa.Table, parts: int, window: int):
        self.ids = np.array([NOBODY if x is None else x for x in table.column("id").to_pylist()], np.int64)
        self.texts = [words(t) for t in table.column("text").to_pylist()]
        self.sizes = np.fromiter(map(len, self.texts), np.int64, len(self.texts))
        self.doc = np.repeat(np.arange(len(self.texts)), self.sizes)
        self.h = h = np.concatenate([hash_words(w) for w in self.texts]) if len(self.doc) else np.zeros(0, np.uint64)
        n, gram = len(h), min(GRAM, window)
        self.hash = range_hashes(h)
        if n < window:
            starts = at = np.zeros(0, np.int64)
            g = np.zeros(0, np.uint64)
        else:
            g = gram_hashes(h, gram)
            at = leftmost_min(g, window - gram + 1)
            starts = np.flatnonzero((self.doc[: n - window + 1] == self.doc[window - 1 :]) & (self.ids[self.doc[: n - window + 1]] != NOBODY))
            at = at[starts]
        new = np.flatnonzero(np.r_[True, (np.diff(at) != 0) | (np.diff(starts) != 1)]) if len(starts) else np.zeros(0, np.int64)
        self.first, self.many = starts[new], np.diff(np.r_[new, len(starts)])
        self.owner = self.ids[self.doc[self.first]]
        end = g[at[new]]
        key = self.hash(self.first, self.first + self.many + window - 1)
        key = mix(key + (mix(end + (at[new] - self.first).astype(np.uint64) * STEP) + self.many.astype(np.uint64))[:, None])
        # distinct ones, by partition then key
        self.key, place, self.which = distinct(key)
        self.place, self.end = place, end[place]
        self.low = np.full(len(self.key), NOBODY)
        np.minimum.at(self.low, self.which, self.owner)
        self.high = np.full(len(self.key), -NOBODY)
        np.maximum.at(self.high, self.which, self.owner)
        self.part = (mix(self.end) % np.uint64(parts)).astype(np.int64)
        self.order, self.runs = by_part(self.part)

    def suffixes(self, seg: np.ndarray) -> np.ndarray:
        """First words of all suffixes of the distinct segments ``seg``."""
        p = self.place[seg]
        many = self.many[p]
        return np.repeat(self.first[p], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)


def _group(docs: pa.Table) -> int:
    return docs.column("block")[0].as_py()


def _send(parts: int, window: int):
    def run(table: pa.Table) -> pa.Table:
        s = Segments(dealt(table), parts, window)
        return rows_table([(_group(table), p, "segments", s.key[o].tobytes(), s.end[o].tobytes(), pack(s.low[o]), pack(s.high[o])) for p, i, j in s.runs for o in [s.order[i:j]]])

    return run


def _meet(split: int):
    def run(table: pa.Table) -> pa.Table:
        part, blocks = table.column("part")[0].as_py(), table.column("block").to_pylist()
        key = [keys(x).reshape(-1, 2) for x in table.column("a").to_pylist()]
        end = np.concatenate([keys(x) for x in table.column("b").to_pylist()])
        low = np.concatenate([unpack(x) for x in table.column("c").to_pylist()])
        high = np.concatenate([unpack(x) for x in table.column("d").to_pylist()])
        segs, first, at = distinct(np.concatenate(key))
        least = np.full(len(segs), NOBODY)
        np.minimum.at(least, at, low)
        most = np.full(len(segs), -NOBODY)
        np.maximum.at(most, at, high)
        ends, group = np.unique(end[first], return_inverse=True)
        group = group.reshape(-1)
        n = np.bincount(group, minlength=len(ends))
        lo, hi = np.full(len(ends), NOBODY), np.full(len(ends), -NOBODY)
        np.minimum.at(lo, group, least)
        np.maximum.at(hi, group, most)
        state = np.where(lo == hi, NONE, np.where(n == 1, ONE, np.where(n <= split, TREE, SPREAD)))[group][at]
        answer = np.where(state == NONE, NOBODY, least[at])
        rows, i = [], 0
        for b, k in zip(blocks, key, strict=True):
            rows.append((b, part, "state", pack(state[i : i + len(k)]), pack(np.where(state[i : i + len(k)] == NONE, 0, answer[i : i + len(k)]))))
            i += len(k)
        return rows_table(rows)

    return run


def _states(s: Segments, answers: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """State and smallest document of each distinct segment of the block."""
    state, least = np.zeros(len(s.key), np.int64), np.full(len(s.key), NOBODY)
    got = {p: (a, b) for p, k, a, b in zip(*(answers.column(x).to_pylist() for x in ("part", "kind", "a", "b")), strict=True) if k == "state"}
    for p, i, j in s.runs:
        o = s.order[i:j]
        state[o], least[o] = unpack(got[p][0]), unpack(got[p][1])
    least[state == NONE] = NOBODY
    return state, least


def _spread(s: Segments, seg: np.ndarray, window: int, parts: int):
    """The suffixes of segments split by their longest prefix: distinct 128-bit keys, their order by partition, and each suffix's place."""
    at = s.suffixes(seg)
    both, _, place = distinct(s.hash(at, at + window))
    order, runs = by_part((both[:, 0] % np.uint64(parts)).astype(np.int64))
    return both, place, order, runs


def _send_words(parts: int, window: int):
    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return rows_table([])
        s, block, rows = Segments(dealt(table), parts, window), _group(table), []
        state, least = _states(s, answers)
        for p, i, j in s.runs:
            seg = s.order[i:j]
            seg = seg[state[seg] == TREE]
            if len(seg):
                own = seg[s.low[seg] == least[seg]]
                sizes = s.many[s.place[own]] + window - 1
                at = np.repeat(s.first[s.place[own]], sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                known, code = np.unique(s.h[at], return_inverse=True)
                rows.append((block, p, "tree", s.key[seg].tobytes(), s.key[own].tobytes(), pack(least[own]), pack(sizes), known.tobytes(), pack(code.reshape(-1))))
        seg = np.flatnonzero(state == SPREAD)
        if len(seg):
            both, place, order, runs = _spread(s, seg, window, parts)
            low = np.full(len(both), NOBODY)
            np.minimum.at(low, place, np.repeat(s.low[seg], s.many[s.place[seg]]))
            rows += [(block, p, "spread", both[o].tobytes(), pack(low[o])) for p, i, j in runs for o in [order[i:j]]]
        return rows_table(rows)

    return run


def suffix_tree(h: np.ndarray, suffix: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The tree of the given suffixes of a word sequence, cut at depth ``window``: the suffixes in order, and the depth (in words) at which each parts from the one before.

    Suffixes are sorted by prefix doubling; each doubling's ranks are kept, and
    two neighbours descend through them from the longest, which gives their
    common depth. The stretches of neighbours of a depth of at least d are the
    internal nodes of that depth and below.
    """
    levels, rank, have = [], np.unique(h, return_inverse=True)[1].reshape(-1).astype(np.int64), 1
    while True:
        levels.append((have, rank))
        step = min(have, window - have)
        n = len(rank) - step
        if not step or n <= 0:
            break
        rank = np.unique(rank[:n] * (int(rank.max()) + 1) + rank[step:], return_inverse=True)[1].reshape(-1)
        have += step
    order = suffix[np.argsort(levels[-1][1][suffix], kind="stable")]
    a, b = order[:-1].copy(), order[1:].copy()
    depth = np.zeros(len(order), np.int64)
    equal = levels[-1][1][a] == levels[-1][1][b]
    for length, ranks in reversed(levels[:-1]):
        go = np.flatnonzero(~equal)
        x, y = a[go], b[go]
        inside = np.maximum(x, y) < len(ranks)
        same = np.zeros(len(go), bool)
        same[inside] = ranks[x[inside]] == ranks[y[inside]]
        go = go[same]
        a[go] += length
        b[go] += length
        depth[1:][go] += length
    depth[1:][equal] = window
    return order, depth


def _trees(window: int):
    def run(table: pa.Table) -> pa.Table:
        part, rows = table.column("part")[0].as_py(), []
        kind = np.array(table.column("kind").to_pylist(), object)
        trees = table.filter(pa.array(kind == "tree")).to_pylist()
        if trees:
            own = np.concatenate([keys(x["b"]).reshape(-1, 2) for x in trees])
            least = np.concatenate([unpack(x["c"]) for x in trees])
            sizes = np.concatenate([unpack(x["d"]) for x in trees])
            h = np.concatenate([keys(x["e"])[unpack(x["f"])] for x in trees])
            many = sizes - window + 1
            first = np.cumsum(sizes) - sizes
            suffix = np.repeat(first, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            order, depth = suffix_tree(h, suffix, window)
            # the deep internal nodes, and single suffixes: a new one begins where neighbours part above the window
            node = np.empty(len(h), np.int64)
            node[order] = np.cumsum(depth < window) - 1
            node = node[suffix]
            low = np.full(int(node.max()) + 1, NOBODY)
            np.minimum.at(low, node, np.repeat(least, many))
            low = low[node]
            begin = np.cumsum(many) - many
            asked = [keys(x["a"]).reshape(-1, 2) for x in trees]
            code = distinct(np.concatenate([own, *asked]))[2]
            place = np.empty(int(code.max()) + 1, np.int64)
            place[code[: len(own)]] = np.arange(len(own))
            ends = len(own) + np.cumsum([len(x) for x in asked])
            for x, e, k in zip(trees, ends.tolist(), map(len, asked), strict=True):
                seg = place[code[e - k : e]]
                n = many[seg]
                at = np.repeat(begin[seg], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                rows.append((x["block"], part, "tree", pack(low[at])))
        spread = table.filter(pa.array(kind == "spread")).to_pylist()
        if spread:
            both = [keys(x["a"]).reshape(-1, 2) for x in spread]
            at = distinct(np.concatenate(both))[2]
            low = np.full(int(at.max()) + 1, NOBODY)
            np.minimum.at(low, at, np.concatenate([unpack(x["b"]) for x in spread]))
            low, i = low[at], 0
            for x, b in zip(spread, both, strict=True):
                rows.append((x["block"], part, "spread", pack(low[i : i + len(b)])))
                i += len(b)
        return rows_table(rows)

    return run


def _keep(parts: int, window: int):
    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        docs = dealt(table)
        s = Segments(docs, parts, window)
        state, least = _states(s, answers)
        got = {(p, k): a for p, k, a in zip(*(answers.column(x).to_pylist() for x in ("part", "kind", "a")), strict=True) if k != "state"}
        # the smallest document of every suffix of the distinct segments, one after the other
        many = s.many[s.place]
        begin = np.cumsum(many) - many
        low = np.repeat(least, many)
        spans = lambda seg: np.repeat(begin[seg], many[seg]) + np.arange(many[seg].sum()) - np.repeat(np.cumsum(many[seg]) - many[seg], many[seg])
        for p, i, j in s.runs:
            seg = s.order[i:j]
            seg = seg[state[seg] == TREE]
            if len(seg):
                low[spans(seg)] = unpack(got[p, "tree"])
        seg = np.flatnonzero(state == SPREAD)
        if len(seg):
            both, place, order, runs = _spread(s, seg, window, parts)
            found = np.zeros(len(both), np.int64)
            for p, i, j in runs:
                found[order[i:j]] = unpack(got[p, "spread"])
            low[spans(seg)] = found[place]
        # all segments of the block, not only the distinct ones
        n = s.many
        nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        lost = low[np.repeat(begin[s.which], n) + nth] < np.repeat(s.owner, n)
        at = (np.repeat(s.first, n) + nth)[lost]
        cover = np.zeros(len(s.h) + 1, np.int64)
        cover += np.bincount(at, minlength=len(cover)) - np.bincount(at + window, minlength=len(cover))
        gone = np.cumsum(cover)[:-1] > 0
        removed = np.bincount(s.doc[gone], minlength=len(s.texts))
        ends = np.cumsum(s.sizes)
        kept = []
        for w, r, e in zip(s.texts, removed.tolist(), ends.tolist(), strict=True):
            if r:
                g = gone[e - len(w) : e].tolist()
                w = [x for x, y in zip(w, g, strict=True) if not y]
            kept.append(b" ".join(w))
        return pa.table({"id": docs.column("id").cast(pa.int64()), "n_words": pa.array(s.sizes), "n_removed": pa.array(removed.astype(np.int64)), "kept": pa.array(kept, pa.binary())})

    return run


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, block_chars: int = BLOCK_CHARS, split: int = SPLIT) -> DataFrame:
    """id (a whole number), n_words, n_removed and ``text``, the kept words joined by blanks, of every document."""
    out = _deduplicated(docs, id_col, text_col, window, block_chars, split, _keep, T.StructField("kept", T.BinaryType()))
    return out.select(F.col("id").alias(id_col), "n_words", "n_removed", F.decode("kept", "UTF-8").alias(text_col))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, block_chars: int = BLOCK_CHARS, split: int = SPLIT) -> DataFrame:
    """id, n_words, n_removed and kept_sha256 of every document."""

    def digest(parts, window):
        keep = _keep(parts, window)

        def run(table, answers):
            t = keep(table, answers)
            return t.drop_columns(["kept"]).append_column("kept_sha256", pa.array([hashlib.sha256(x).hexdigest() for x in t.column("kept").to_pylist()]))

        return run

    out = _deduplicated(docs, id_col, text_col, window, block_chars, split, digest, T.StructField("kept_sha256", T.StringType()))
    return out.withColumnRenamed("id", id_col)


def _deduplicated(docs, id_col, text_col, window, block_chars, split, last, field) -> DataFrame:
    parts = count(docs, text_col, block_chars)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    blocks = deal(rows, parts, F.coalesce("id", F.xxhash64("text"))).groupBy("block")
    states = saved(blocks.applyInArrow(_send(parts, window), ROWS).groupBy("part").applyInArrow(_meet(split), ROWS))
    trees = blocks.cogroup(states.groupBy("block")).applyInArrow(_send_words(parts, window), ROWS)
    found = saved(trees.groupBy("part").applyInArrow(_trees(window), ROWS))
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), field])
    return blocks.cogroup(states.unionByName(found).groupBy("block")).applyInArrow(last(parts, window), schema)


ORACLE = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w FROM documents
), win AS (
  SELECT doc_id, p, array_to_string(w[p : p + 49], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS p FROM d WHERE len(w) >= 50)
), first AS (
  SELECT s, min(doc_id) AS low FROM win GROUP BY s
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS q FROM win JOIN first USING (s) WHERE low < doc_id
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY q) AS kept, count(*) AS n
  FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS q FROM d) AS a WHERE NOT EXISTS (SELECT 1 FROM gone AS g WHERE g.doc_id = a.doc_id AND g.q = a.q) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

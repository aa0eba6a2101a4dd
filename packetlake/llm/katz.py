"""LM scoring (operator 10): a Katz backoff bigram model.

Counts are Good-Turing discounted up to CUT, backoff weights are exactly
normalised, and a token is scored recursively: bigram if seen, else the
history's backoff weight times the unigram, else the mass kept for unknown
words. The tables are partitioned by the hash of the history. As neither the
corpus nor the tables fit anywhere whole, documents are dealt into blocks by
the hash of their row, and each block works with the table partitions by
requests that hold every distinct n-gram of the block once:

1. a block sends its distinct words with their training counts to the
   partitions of the unigram table, which add up and answer with the totals;
2. it sends its distinct bigrams with training counts, and the totals of their
   second words, to the partitions of the bigram table, which add up, answer
   with the totals and, for each history, with what its backoff weight needs;
3. it scores its documents.

A frequent history is spread over as many partitions as its share of all tokens
asks for, so none grows with it; their figures meet at the history's home, which
answers each block once. All counts cover the whole training set.

Discounts: d_r = (r*/r - A) / (1 - A) with r* = (r+1) n_{r+1} / n_r and
A = (CUT+1) n_{CUT+1} / n_1, for r <= CUT; where the figures don't give a value
in (0, 1) the count isn't discounted. A history whose seen bigrams would take
all its mass keeps 1/(c+1) of it for the rest. The unigram mass left by
discounting, or 1/(N+1) if none is left, goes to one class of unknown words.

Null and empty texts hold the end token only. Training rows are those whose
crc32(id as text) doesn't leave 2 when divided by 7 (a null id trains). Without
training rows N and V are 0 and every token is unknown. Repeated rows each
count and give a row; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .batches import hash_words, lower_words, mix
from .blocks import ROWS, by_part, count, deal, dealt, pack, rows_table, unpack
from .durable import saved

CUT = 5
#: Characters in a block, about.
BLOCK_CHARS = 12_000_000
#: The hash of the end token, which also opens every text.
END = np.uint64(0x9E3779B97F4A7C15)

def _text_tokens(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All tokens of a block one after the other, each text's number of tokens, and for each token whether it trains."""
    parts, sizes = [], []
    end = np.array([END])
    for t in table.column("text").to_pylist():
        w = lower_words(t)
        sizes.append(len(w) + 1)
        parts += [hash_words(w), end]
    sizes = np.array(sizes, np.int64)
    train = np.repeat(np.array(table.column("train").to_pylist(), bool), sizes)
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64), sizes, train


def _vocabulary(tok: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    words, at = np.unique(tok, return_inverse=True)
    return words, at.reshape(-1)


def _word_part(words: np.ndarray, parts: int) -> np.ndarray:
    return (mix(words) % np.uint64(parts)).astype(np.int64)


def _stats(counts: np.ndarray) -> np.ndarray:
    """N, V and n_1 ... n_{CUT+1} of a table partition."""
    seen = counts[counts > 0]
    return np.array([seen.sum(), len(seen), *np.bincount(seen[seen <= CUT + 1], minlength=CUT + 2)[1:]], np.int64)


def discounts(n: np.ndarray) -> np.ndarray:
    """d_0 ... d_CUT from n_1 ... n_{CUT+1}; d_0 is unused."""
    d = np.ones(CUT + 1)
    if n[0] > 0:
        a = (CUT + 1) * n[CUT] / n[0]
        for r in range(1, CUT + 1):
            if n[r - 1] > 0 and a < 1:
                x = ((r + 1) * n[r] / n[r - 1] / r - a) / (1 - a)
                if 0 < x < 1:
                    d[r] = x
    return d


class Unigrams:
    """Probabilities from counts; the class of unknown words has ``unknown``."""

    def __init__(self, stats: np.ndarray):
        self.n, self.v = int(stats[0]), int(stats[1])
        self.d = discounts(stats[2:])
        lost = sum((1 - self.d[r]) * r * stats[1 + r] for r in range(1, CUT + 1)) / max(1, self.n)
        self.unknown = lost if lost > 0 else 1 / (self.n + 1)
        self.scale = 1.0 if lost > 0 else self.n / (self.n + 1)

    def p(self, c: np.ndarray) -> np.ndarray:
        c = np.asarray(c)
        d = np.where(c <= CUT, self.d[np.minimum(c, CUT)], 1.0)
        return np.where(c > 0, self.scale * d * c / max(1, self.n), self.unknown)


def _slots(c: np.ndarray, n: int, parts: int) -> np.ndarray:
    """Over how many partitions the bigrams of a history with count ``c`` are spread."""
    return np.minimum(parts, 1 + (np.asarray(c, np.float64) * parts / max(1, n)).astype(np.int64))


def _send_words(parts: int):
    def run(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        tok, _, train = _text_tokens(dealt(table))
        words, at = _vocabulary(tok)
        c = np.bincount(at[train], minlength=len(words)).astype(np.uint32)
        order, runs = by_part(_word_part(words, parts))
        words, c = words[order], c[order]
        return rows_table([(block, p, "words", words[i:j].tobytes(), pack(c[i:j])) for p, i, j in runs])

    return run


def _add_words(table: pa.Table) -> pa.Table:
    part = table.column("part")[0].as_py()
    blocks = table.column("block").to_pylist()
    keys = [np.frombuffer(x, np.uint64) for x in table.column("a").to_pylist()]
    counts = np.concatenate([unpack(x) for x in table.column("b").to_pylist()])
    words, at = _vocabulary(np.concatenate(keys))
    total = np.bincount(at, counts, len(words)).astype(np.int64)
    back, rows, i = total[at], [], 0
    for block, k in zip(blocks, keys, strict=True):
        rows.append((block, part, "words", pack(back[i : i + len(k)])))
        i += len(k)
    return rows_table([*rows, (-1, part, "stats", _stats(total).tobytes())])


class _Block:
    """A block's tokens with the totals of its words, and its distinct bigrams by partition."""

    def __init__(self, table: pa.Table, answers: pa.Table, uni: Unigrams, parts: int):
        tok, self.sizes, self.train = _text_tokens(table)
        self.words, self.at = _vocabulary(tok)
        order, runs = by_part(_word_part(self.words, parts))
        got = dict(zip(answers.column("part").to_pylist(), answers.column("a").to_pylist(), strict=True))
        self.total = np.zeros(len(self.words), np.int64)
        self.total[order] = np.concatenate([unpack(got[p]) for p, _, _ in runs]) if runs else []
        ends = np.cumsum(self.sizes) - 1
        w = self.at
        h = np.roll(w, 1)
        h[np.r_[0, ends[:-1] + 1]] = w[ends[0]] if len(w) else 0  # every text begins after an end
        n = len(self.words)
        key = h * n + w
        self.pairs, self.pair_at = np.unique(key, return_inverse=True)
        self.pair_at = self.pair_at.reshape(-1)
        self.h, self.w = self.pairs // n, self.pairs % n
        self.slots = _slots(self.total, uni.n, parts)
        mixed = mix(self.words)
        home = (mixed % np.uint64(parts)).astype(np.int64)
        slot = (mix(mixed[self.w] + np.uint64(1)) % self.slots[self.h].astype(np.uint64)).astype(np.int64)
        self.part = (home[self.h] + slot) % parts
        # histories in several partitions are asked for at their home, which adds up their parts
        self.home = home
        self.ask = np.unique(self.h[self.slots[self.h] > 1])


def _send_pairs(uni: Unigrams, parts: int):
    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return rows_table([])
        b = _Block(dealt(table), answers, uni, parts)
        block = table.column("block")[0].as_py()
        c = np.bincount(b.pair_at[b.train], minlength=len(b.pairs)).astype(np.uint32)
        order, runs = by_part(b.part)
        rows = []
        for p, i, j in runs:
            sel = order[i:j]
            # pairs are sorted by history; how many each has, and whether the history has pairs elsewhere
            hist, k = np.unique(b.h[sel], return_counts=True)
            # second words by their place in a list of the different ones
            own, code = np.unique(b.w[sel], return_inverse=True)
            rows.append((block, p, "pairs", b.words[hist].tobytes(), pack(2 * k + (b.slots[hist] > 1)), b.words[own].tobytes(), pack(b.total[own]), pack(code.reshape(-1)), pack(c[sel])))
        order, runs = by_part(b.home[b.ask])
        rows += [(block, p, "ask", b.words[b.ask[order[i:j]]].tobytes()) for p, i, j in runs]
        return rows_table(rows)

    return run


def _add_pairs(uni: Unigrams, parts: int):
    def run(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        kind = np.array(table.column("kind").to_pylist(), object)
        rows = [(r["block"], part, "ask", r["a"]) for r in table.filter(pa.array(kind == "ask")).select(["block", "a"]).to_pylist()]
        table = table.filter(pa.array(kind == "pairs"))
        if not table.num_rows:
            return rows_table(rows)
        blocks = table.column("block").to_pylist()
        keys = [np.frombuffer(x, np.uint64) for x in table.column("a").to_pylist()]
        marked = [unpack(x) for x in table.column("b").to_pylist()]
        codes = [unpack(x) for x in table.column("e").to_pylist()]
        w = np.concatenate([np.frombuffer(x, np.uint64)[k] for x, k in zip(table.column("c").to_pylist(), codes, strict=True)])
        wc = np.concatenate([unpack(x)[k] for x, k in zip(table.column("d").to_pylist(), codes, strict=True)])
        c = np.concatenate([unpack(x) for x in table.column("f").to_pylist()])
        hist, hist_at = _vocabulary(np.concatenate(keys))
        many, spread = np.concatenate(marked) // 2, np.concatenate(marked) % 2 > 0
        h = np.repeat(hist_at, many)
        pairs, first, at = np.unique(mix(hist[h] * np.uint64(3) + mix(w)), return_index=True, return_inverse=True)
        at = at.reshape(-1)
        total = np.bincount(at, c, len(pairs)).astype(np.int64)
        ph, seen = h[first], total > 0
        sums = [np.bincount(ph[(total == r)], minlength=len(hist)) for r in range(1, CUT + 1)]
        sums.append(np.bincount(ph, np.where(total > CUT, total, 0), len(hist)).astype(np.int64))
        lower = np.bincount(ph[seen], uni.p(wc[first[seen]]), len(hist))
        sums = np.stack(sums).astype(np.int64)
        back, i, k = total[at], 0, 0
        for block, a in zip(blocks, keys, strict=True):
            n = int(many[k : k + len(a)].sum())
            mine = hist_at[k : k + len(a)][~spread[k : k + len(a)]]
            rows.append((block, part, "pairs", pack(back[i : i + n]), pack(sums[:, mine]), pack(lower[mine])))
            i, k = i + n, k + len(a)
        # what this partition has of histories that others have, too
        mine = np.unique(hist_at[spread])
        order, runs = by_part(_word_part(hist[mine], parts))
        rows += [(-2, p, "sum", hist[m].tobytes(), pack(sums[:, m]), pack(lower[m])) for p, i, j in runs for m in [mine[order[i:j]]]]
        return rows_table([*rows, (-1, part, "stats", _stats(total).tobytes())])

    return run


def _add_slots(table: pa.Table) -> pa.Table:
    """The parts of the histories that have their home here, added up, for the blocks that ask."""
    part = table.column("part")[0].as_py()
    rows = table.to_pylist()
    found = [r for r in rows if r["kind"] == "sum"]
    asks = [r for r in rows if r["kind"] == "ask"]
    if not asks:
        return rows_table([])
    keys, at = _vocabulary(np.concatenate([np.frombuffer(r["a"], np.uint64) for r in found]))
    sums = np.concatenate([unpack(r["b"]).reshape(CUT + 1, -1) for r in found], 1)
    sums = np.stack([np.bincount(at, x, len(keys)) for x in sums]).astype(np.int64)
    lower = np.bincount(at, np.concatenate([unpack(r["c"]) for r in found]), len(keys))
    out = []
    for r in asks:
        mine = np.searchsorted(keys, np.frombuffer(r["a"], np.uint64))
        out.append((r["block"], part, "slots", b"", pack(sums[:, mine]), pack(lower[mine])))
    return rows_table(out)


def _score(uni: Unigrams, d: np.ndarray, parts: int, id_type: pa.DataType):
    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        table = dealt(table)
        kind = np.array(answers.column("kind").to_pylist(), object) if answers.num_rows else np.zeros(0, object)
        b = _Block(table, answers.filter(pa.array(kind == "words")), uni, parts)
        got = answers.filter(pa.array(kind == "pairs"))
        got = dict(zip(got.column("part").to_pylist(), zip(*(got.column(x).to_pylist() for x in "abc"), strict=True), strict=True))
        order, runs = by_part(b.part)
        count = np.zeros(len(b.pairs), np.int64)
        n = len(b.words)
        sums, lower = np.zeros((CUT + 1, n)), np.zeros(n)
        for p, i, j in runs:
            count[order[i:j]] = unpack(got[p][0])
            own = np.unique(b.h[order[i:j]])
            own = own[b.slots[own] == 1]
            sums[:, own], lower[own] = unpack(got[p][1]).reshape(CUT + 1, -1), unpack(got[p][2])
        slots = answers.filter(pa.array(kind == "slots"))
        slots = dict(zip(slots.column("part").to_pylist(), zip(*(slots.column(x).to_pylist() for x in "bc"), strict=True), strict=True))
        order, runs = by_part(b.home[b.ask])
        for p, i, j in runs:
            own = b.ask[order[i:j]]
            sums[:, own], lower[own] = unpack(slots[p][0]).reshape(CUT + 1, -1), unpack(slots[p][1])
        # per history: the mass that its seen bigrams keep, and what is left for the others
        r = np.arange(1, CUT + 1)
        full = r @ sums[:CUT] + sums[CUT]
        kept = (d[1:] * r) @ sums[:CUT] + sums[CUT]
        keep = np.divide(kept, full, out=np.zeros(n), where=full > 0)
        tight = (full > 0) & (1 - keep < 1e-12)
        shrink = np.where(tight, full / (full + 1), 1.0)
        left = np.where(full > 0, 1 - keep * shrink, 1.0)
        rest = 1 - lower
        back = np.where(full > 0, left / np.maximum(rest, 1e-300), 1.0)
        p1 = uni.p(b.total)
        disc = np.where(count <= CUT, d[np.minimum(count, CUT)], 1.0)
        direct = disc * count / np.maximum(full[b.h], 1) * shrink[b.h]
        p = np.where(count > 0, direct, back[b.h] * p1[b.w])
        log = np.log10(p)[b.pair_at]
        base = np.log10((b.total + 1) / (uni.n + uni.v + 1))[b.at]
        starts = np.cumsum(b.sizes) - b.sizes
        add = lambda x: np.add.reduceat(x, starts)
        return pa.table({
            "id": table.column("id").cast(id_type), "held_out": pa.array(~np.array(table.column("train").to_pylist(), bool)), "n_tokens": pa.array(b.sizes), "n_known": pa.array(add((b.total > 0)[b.at].astype(np.int64))),
            "train_tokens": pa.array(np.full(len(b.sizes), uni.n)), "base_score": pa.array(add(base)), "score": pa.array(add(log)),
        })

    return run


def _global(answers: DataFrame) -> np.ndarray:
    """The stats rows (CUT + 3 numbers for each table partition) added up: one row for each task reaches the driver."""

    def add(batches):
        total = np.zeros(CUT + 3, np.int64)
        for b in batches:
            total += sum((np.frombuffer(x, np.int64) for x in b.column(0).to_pylist()), np.zeros(CUT + 3, np.int64))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["a"])

    found = answers.where("kind = 'stats'").select("a").mapInArrow(add, "a binary").collect()
    return sum((np.frombuffer(bytes(r["a"]), np.int64) for r in found), np.zeros(CUT + 3, np.int64))


def scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row."""
    parts = count(docs, text_col, block_chars)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), (~F.coalesce(F.crc32(F.col(id_col).cast("string")) % 7 == 2, F.lit(False))).alias("train"))
    by_block = deal(rows, parts, "id", "text").groupBy("block")

    words = saved(by_block.applyInArrow(_send_words(parts), ROWS).groupBy("part").applyInArrow(_add_words, ROWS))
    uni = Unigrams(_global(words))
    word_answers = words.where("kind = 'words'").select("block", "part", "kind", "a", "b", "c")

    asked = by_block.cogroup(word_answers.groupBy("block")).applyInArrow(_send_pairs(uni, parts), ROWS)
    pairs = saved(asked.groupBy("part").applyInArrow(_add_pairs(uni, parts), ROWS))
    d = discounts(_global(pairs)[2:])
    slots = pairs.where("kind IN ('sum', 'ask')").groupBy("part").applyInArrow(_add_slots, ROWS)
    answers = word_answers.unionByName(pairs.where("kind = 'pairs'").select(*word_answers.columns)).unionByName(slots.select(*word_answers.columns))

    id_type = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("id", id_type), T.StructField("held_out", T.BooleanType()), *(T.StructField(n, T.LongType()) for n in ("n_tokens", "n_known", "train_tokens")), T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())])
    out = by_block.cogroup(answers.groupBy("block")).applyInArrow(_score(uni, d, parts, to_arrow_type(id_type)), schema)
    return out.withColumnRenamed("id", id_col)

"""N-gram Jaccard join (operator 6): grouped prefix join over five-word shingles.

Two documents link if they share at least THRESHOLD of all their shingles. The
shingles of a document are ordered from rare to frequent, by a sketch of all
documents' shingle counts (a fixed 2**20 counters, and then by hash; any order is
correct, a good one is fast). Of n shingles the first n - ceil(T n) + 1 are its
prefix, and linked documents share a shingle of both prefixes.

1. Documents with the same set are one class, held by the one with the smallest
   id. Links need only be found between classes.
2. In each block, classes with the same prefix and size are one group. A group
   is sent once for each shingle of its prefix, to the shingle's partition (a very
   frequent shingle to several); group pairs that meet there are filtered by
   size and by the places of the shingle: of the pair's shingles before the first
   common one, none is common.
3. The surviving pairs expand to their members, which are verified on their whole
   sets: the texts of one side travel to the block of the other, each text once
   to a block. A block leaves out pairs that its own links connect already.
4. Where more than FEW groups share a shingle (a crowd), first only the pairs
   with the first REPS of them are verified. Then every member of a crowd that
   isn't in the crowd's main component is verified with all members of other
   components that pass the filter; components are those of the members, not of
   their groups, so no link between components is lost. A group of copies costs
   a few checks for each copy.

Null and empty texts, and rows with a null id, have no set and link with nothing
(their component is their own id). Texts of one to four words have one shingle,
the whole of it. Repeated rows each give a row; if one id has several texts, the
one whose set has the smallest hash stands for it in links. Empty tables give no
rows; other columns are ignored. Ids are whole numbers.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .batches import gram_hashes, hash_words, lower_words, mix, multipliers
from .blocks import ROWS, by_part, count, deal, dealt, keys, pack, rows_table, unpack
from .components import components
from .durable import saved

SHINGLE = 5
#: Links share at least NUMERATOR / DENOMINATOR of the union.
NUMERATOR, DENOMINATOR = 3, 4
#: The sketch has a counter for about SHARE shingles, 2**26 (64 MB) at most, in so many chunks.
SHARE, SKETCH_MOST, SKETCH_CHUNKS = 16, 26, 16
#: Groups that share a shingle are all paired up to so many; beyond it each is first paired with REPS of them.
FEW, REPS = 12, 8
#: A shingle counted some 2**HOT_BITS times or more is dealt over several partitions.
HOT_BITS = 18
#: Pairs across a crowd's components are all verified once they are at most WORK for each member, or after TURNS turns with PIVOTS.
WORK, TURNS, PIVOTS = 64, 3, 8
#: Steps of sizes, a bit more than DENOMINATOR / NUMERATOR apart.
SCALE = 1.34
BLOCK_CHARS = 8_000_000
#: Sketch rows go to partitions below zero, so they meet no other kind.
LINKS = "a long, b long"


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    h = hash_words(lower_words(text))
    if not len(h):
        return h
    if len(h) < SHINGLE:
        return mix(np.array([(h * multipliers(len(h), 77)).sum() + np.uint64(len(h))], np.uint64))
    return np.unique(gram_hashes(h, SHINGLE))


def set_hash(s: np.ndarray) -> tuple[int, int]:
    two = np.array([np.bitwise_xor.reduce(mix(s)), mix(s + np.uint64(1)).sum()], np.uint64)
    return tuple(mix(two + np.uint64(len(s))).tolist())


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if DENOMINATOR * len(a) < NUMERATOR * len(b):
        return False
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    both = int((b[at] == a).sum())
    return DENOMINATOR * both >= NUMERATOR * (len(a) + len(b) - both) and both > 0


def prefix_size(n: int) -> int:
    return n - -(-NUMERATOR * n // DENOMINATOR) + 1


class Docs:
    """A block's documents by id: the text that stands for an id, and the rows."""

    def __init__(self, table: pa.Table):
        self.ids, self.texts = table.column("id").to_pylist(), table.column("text").to_pylist()

    def sets(self):
        """(row, id, set) of every row."""
        for i, (d, t) in enumerate(zip(self.ids, self.texts, strict=True)):
            yield i, d, shingles(t)

    def find(self, wanted: set[int]) -> dict[int, str]:
        """The text of each wanted id."""
        out: dict[int, str] = {}
        for d, t in zip(self.ids, self.texts, strict=True):
            if d in wanted and t and t != out.get(d):
                if d in out:
                    t = min((out[d], t), key=lambda x: set_hash(s) if len(s := shingles(x)) else (1 << 64, 0))
                out[d] = t
        return out


def _block(table: pa.Table) -> int:
    return table.column("block")[0].as_py()


def _send_sets(parts: int, bits: int):
    """Class keys of a block's documents, and its shingle counts."""

    def run(table: pa.Table) -> pa.Table:
        block, best, own = _block(table), {}, []
        counters = []
        for _, d, s in Docs(dealt(table)).sets():
            k = set_hash(s) if len(s) else (0, 0)
            own.append((0 if d is None else d, d is not None, len(s), *k))
            if d is not None and len(s):
                best[d] = min(best.get(d, k), k)
                counters.append((s >> np.uint64(64 - bits)).astype(np.int64))
        low: dict[tuple[int, int], int] = {}
        for d, k in best.items():
            low[k] = min(low.get(k, d), d)
        key = np.array(sorted(low), np.uint64).reshape(-1, 2)
        ids = np.array([low[k] for k in sorted(low)], np.int64)
        order, runs = by_part((key[:, 0] % np.uint64(parts)).astype(np.int64)) if len(key) else (ids, [])
        rows = [(block, p, "class", key[order[i:j]].tobytes(), pack(ids[order[i:j]])) for p, i, j in runs]
        ids, known, n, one, two = zip(*own, strict=True)
        rows.append((block, block, "docs", *(pack(np.array(x, np.int64)) for x in (ids, known, n)), np.array([one, two], np.uint64).T.tobytes()))
        at, many = np.unique(np.concatenate(counters) if counters else np.zeros(0, np.int64), return_counts=True)
        cut = np.searchsorted(at, np.arange(SKETCH_CHUNKS + 1) * ((1 << bits) // SKETCH_CHUNKS))
        rows += [(block, -1 - c, "sketch", pack(np.diff(at[i:j], prepend=c * ((1 << bits) // SKETCH_CHUNKS))), pack(many[i:j])) for c, (i, j) in enumerate(zip(cut, cut[1:], strict=False)) if j > i]
        return rows_table(rows)

    return run


def _meet_sets(bits: int):
    return lambda table: _met_sets(table, bits)


def _met_sets(table: pa.Table, bits: int) -> pa.Table:
    part = table.column("part")[0].as_py()
    if part < 0:
        total = np.zeros((1 << bits) // SKETCH_CHUNKS, np.int64)
        for a, b in zip(table.column("a").to_pylist(), table.column("b").to_pylist(), strict=True):
            total[np.cumsum(unpack(a))] += unpack(b)
        # only the order of magnitude counts
        return rows_table([(-1, part, "sketch", np.ceil(np.log2(total + 1) * 4).astype(np.uint8).tobytes())])
    kind = table.column("kind").to_pylist()
    rows = [(x["block"], part, "docs", x["a"], x["b"], x["c"], x["d"]) for x in table.to_pylist() if x["kind"] == "docs"]
    table = table.filter(pa.array([k == "class" for k in kind]))
    a = table.column("a").to_pylist()
    if not a:
        return rows_table(rows)
    key = [np.frombuffer(x, np.uint64).reshape(-1, 2) for x in a]
    at = np.unique(np.concatenate(key), axis=0, return_inverse=True)[1].reshape(-1)
    low = np.full(int(at.max()) + 1, np.iinfo(np.int64).max)
    np.minimum.at(low, at, np.concatenate([unpack(x) for x in table.column("b").to_pylist()]))
    i = 0
    for b, k in zip(table.column("block").to_pylist(), key, strict=True):
        rows.append((b, part, "class", k.tobytes(), pack(low[at[i : i + len(k)]])))
        i += len(k)
    return rows_table(rows)


def _holders(answers: pa.Table) -> dict[tuple[int, int], int]:
    out = {}
    for k, a, b in zip(*(answers.column(x).to_pylist() for x in ("kind", "a", "b")), strict=True):
        if k != "class":
            continue
        out.update(zip(map(tuple, np.frombuffer(a, np.uint64).reshape(-1, 2).tolist()), unpack(b).tolist(), strict=True))
    return out


class Parts:
    """Disjoint sets of ids, kept by union."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = self.up.get(y, y)
            x = y
        return x

    def join(self, x: int, y: int) -> None:
        self.up[self.root(x)] = self.root(y)

    def split(self, ids) -> dict[int, list[int]]:
        """The ids by their set."""
        out: dict[int, list[int]] = {}
        for x in ids:
            out.setdefault(self.root(x), []).append(x)
        return out

    def meet(self, left, right, sets_l, sets_r) -> list[tuple[int, int]]:
        """Links that connect what links of ``left`` with ``right``; ids already connected aren't compared."""
        out = []
        right = self.split(right)
        for a in self.split(left).values():
            for b in right.values():
                if self.root(a[0]) != self.root(b[0]):
                    hit = next(((x, y) for x in a for y in b if linked(sets_l[x], sets_r[y])), None)
                    if hit:
                        out.append(hit)
                        self.join(*hit)
        return out


def _send_prefixes(levels: np.ndarray, parts: int, bits: int):
    """Prefix shingles of the groups of a block's classes, and links and members inside groups."""

    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return rows_table([])
        block, holder = _block(table), _holders(answers)
        groups: dict[tuple, list[tuple[int, np.ndarray]]] = {}
        prefixes: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}
        done = set()
        for _, d, s in Docs(dealt(table)).sets():
            if d is None or not len(s) or (k := set_hash(s)) in done or holder.get(k) != d:
                continue
            done.add(k)
            lv = levels[(s >> np.uint64(64 - bits)).astype(np.int64)]
            at = np.argsort(lv, kind="stable")[: prefix_size(len(s))]
            g = (len(s), *set_hash(s[at]))
            groups.setdefault(g, []).append((d, s))
            prefixes[g] = s[at], lv[at]
        rows, first, members, inside = [], [], [], []
        for g, docs in groups.items():
            docs.sort(key=lambda x: x[0])
            first.append(docs[0][0])
            if len(docs) > 1:
                sets, own = dict(docs), Parts()
                for i, (d, _) in enumerate(docs):
                    inside += own.meet([d], (e for e, _ in docs[:i]), sets, sets)
                members += [(docs[0][0], d, own.root(d)) for d, _ in docs]
        if members:
            m = np.array(members, np.int64)
            rows.append((block, block, "members", pack(m[:, 0]), pack(m[:, 1]), pack(m[:, 2])))
        if inside:
            m = np.array(inside, np.int64)
            rows.append((block, block, "links", pack(m[:, 0]), pack(m[:, 1])))
        if groups:
            pres = [x for x, _ in prefixes.values()]
            n = np.fromiter(map(len, pres), np.int64, len(pres))
            tok, lv = np.concatenate(pres), np.concatenate([x for _, x in prefixes.values()])
            ids, size = np.repeat(np.array(first, np.int64), n), np.repeat(np.array([g[0] for g in groups], np.int64), n)
            pos = np.arange(len(tok)) - np.repeat(np.cumsum(n) - n, n)
            # very frequent shingles are dealt by id as well, so that no partition holds all documents of one
            salts = (1 << np.maximum(lv.astype(np.int64) // 4 - HOT_BITS, 0)).astype(np.uint64)
            part = (mix(tok) + mix(ids.astype(np.uint64)) % salts) % np.uint64(parts)
            order, runs = by_part(part.astype(np.int64))
            rows += [(block, p, "prefix", tok[o].tobytes(), pack(ids[o]), pack(size[o]), pack(pos[o]), pack((salts[o] > 1).astype(np.int64))) for p, i, j in runs for o in [order[i:j]]]
        return rows_table(rows)

    return run


def _fits(n1, p1, n2, p2):
    """Whether two sets of these sizes can link if the first shingle that they share is at places p1 and p2 of their orders."""
    need = -(-NUMERATOR * (n1 + n2) // (NUMERATOR + DENOMINATOR))
    return np.minimum(n1 - p1, n2 - p2) >= need


MET = "kind string, b1 long, b2 long, d1 long, d2 long, run long, a binary, b binary, c binary"
PAIRS = "b1 long, b2 long, d1 long, d2 long"
CROWDS = "run long, d1 long, size long, pos long"


def _meet_prefixes(table: pa.Table) -> pa.Table:
    """Pairs of groups to verify, and the members of crowded shingles."""
    tok = np.concatenate([keys(x) for x in table.column("a").to_pylist()])
    ids, size, pos, hot = (np.concatenate([unpack(x) for x in table.column(c).to_pylist()]) for c in "bcde")
    many = [len(x) // 8 for x in table.column("a").to_pylist()]
    block = np.repeat(np.array(table.column("block").to_pylist(), np.int64), many)
    order = np.lexsort((ids, tok))
    tok, ids, size, pos, block, hot = tok[order], ids[order], size[order], pos[order], block[order], hot[order]
    start = np.flatnonzero(np.r_[True, tok[1:] != tok[:-1]])
    n = np.diff(np.r_[start, len(tok)])
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

    def add(a: np.ndarray, b: np.ndarray) -> None:
        ok = _fits(size[a], pos[a], size[b], pos[b])
        left.append(a[ok])
        right.append(b[ok])

    crowded = (n > FEW) | ((hot[start] > 0) & (n > 0))
    for k in range(2, FEW + 1):
        s = start[(n == k) & ~crowded]
        for i in range(k) if len(s) else ():
            for j in range(i):
                add(s + j, s + i)
    crowd, crowd_n = start[crowded], n[crowded]
    for r in range(REPS):
        some = crowd_n > r + 1
        at, rest = crowd[some], crowd_n[some] - r - 1
        add(np.repeat(at + r, rest), np.repeat(at + r, rest) + 1 + np.arange(rest.sum()) - np.repeat(np.cumsum(rest) - rest, rest))
    a, b = np.concatenate(left), np.concatenate(right)
    _, one = np.unique(mix(ids[a].astype(np.uint64)) * np.uint64(3) + mix(ids[b].astype(np.uint64) + np.uint64(1)), return_index=True)
    a, b = a[one], b[one]
    # crowds with the same members are one, at the lowest place that each has in any of them; those of a dealt shingle go by the shingle
    runs: dict[int, list] = {}
    for s, k in zip(crowd.tolist(), crowd_n.tolist(), strict=True):
        key = int(mix(tok[s : s + 1])[0]) if hot[s] else int(mix(mix(ids[s : s + k].astype(np.uint64)) * np.uint64(5)).sum() ^ np.uint64(k))
        if key in runs:
            runs[key][2] = np.minimum(runs[key][2], pos[s : s + k])
        else:
            runs[key] = [ids[s : s + k], size[s : s + k], pos[s : s + k]]
    m, none = len(runs), len(a)
    blank, zero = pa.nulls(none, pa.binary()), np.zeros(m, np.int64)
    return pa.table({
        "kind": pa.array(["pair"] * none + ["crowd"] * m, pa.string()),
        **{name: pa.array(np.r_[x, zero].astype(np.int64)) for name, x in (("b1", block[a]), ("b2", block[b]), ("d1", ids[a]), ("d2", ids[b]))},
        "run": pa.array(np.r_[np.zeros(none, np.int64), np.array(list(runs), np.uint64).view(np.int64)]),
        **{name: pa.chunked_array([blank, pa.array([pack(x[i]) for x in runs.values()], pa.binary())]) for i, name in enumerate("abc")},
    })


def _ask(table: pa.Table) -> pa.Table:
    """Pairs of two blocks, packed, for both of them."""
    b1, b2 = table.column("b1")[0].as_py(), table.column("b2")[0].as_py()
    one = np.unique(np.stack([table.column("d1").to_numpy(), table.column("d2").to_numpy()], 1), axis=0)
    d1, d2 = one[:, 0], one[:, 1]
    return rows_table([(b1, b2, "send", pack(np.unique(d1))), (b2, b1, "check", pack(d1), pack(d2))])


def _members(answers: pa.Table) -> tuple[dict[int, list[int]], dict[int, int]]:
    """The members of groups by the first, and the first member that links inside the group connect each with."""
    out: dict[int, list[int]] = {}
    root: dict[int, int] = {}
    for k, a, b, c in zip(*(answers.column(x).to_pylist() for x in ("kind", "a", "b", "c")), strict=True):
        if k == "members":
            for g, d, r in zip(unpack(a).tolist(), unpack(b).tolist(), unpack(c).tolist(), strict=True):
                out.setdefault(g, []).append(d)
                root[d] = r
    return out, root


def _send_texts(table: pa.Table, asked: pa.Table) -> pa.Table:
    """The texts that other blocks asked for, of all members of the groups."""
    wanted = [(p, unpack(a).tolist()) for p, k, a in zip(*(asked.column(x).to_pylist() for x in ("part", "kind", "a")), strict=True) if k == "send"]
    if not table.num_rows or not wanted:
        return rows_table([])
    (group, root), rows = _members(asked), []
    texts = Docs(dealt(table)).find({d for _, gs in wanted for g in gs for d in group.get(g, [g])})
    coded = {d: t.encode("utf-8", "surrogatepass") for d, t in texts.items()}
    del texts
    for to, gs in wanted:
        ids = [(g, d, root.get(d, d)) for g in gs for d in group.get(g, [g])]
        raw = [coded[d] for _, d, _ in ids]
        m = np.array(ids, np.int64)
        blob = zstandard.ZstdCompressor(level=3).compress(b"".join(raw))
        rows.append((to, _block(table), "texts", pack(m[:, 0]), pack(m[:, 1]), pack(np.array([len(x) for x in raw], np.int64)), blob, pack(m[:, 2])))
    return rows_table(rows)


def _verify(table: pa.Table, asked: pa.Table) -> pa.Table:
    """Links among the members of the pairs asked for."""
    found: list[tuple[int, int]] = []
    cols = ("part", "kind", "a", "b", "c", "d", "e")
    rows = list(zip(*(asked.column(x).to_pylist() for x in cols), strict=True))
    check = {p: (unpack(a).tolist(), unpack(b).tolist()) for p, k, a, b, *_ in rows if k == "check"}
    if table.num_rows and check:
        (group, root), known = _members(asked), Parts()
        mine = Docs(dealt(table)).find({d for _, gs in check.values() for g in gs for d in group.get(g, [g])})
        own = {d: shingles(t) for d, t in mine.items()}
        for d in own:
            known.join(d, root.get(d, d))
        for p, k, a, b, c, d, e in rows:
            if k != "texts" or p not in check:
                continue
            raw = zstandard.ZstdDecompressor().decompress(d)
            ends = np.cumsum(unpack(c)).tolist()
            far: dict[int, list[int]] = {}
            sets: dict[int, np.ndarray] = {}
            for g, m, r, s, t in zip(unpack(a).tolist(), unpack(b).tolist(), unpack(e).tolist(), [0, *ends], ends, strict=False):
                far.setdefault(g, []).append(m)
                sets[m] = shingles(raw[s:t].decode("utf-8", "surrogatepass"))
                known.join(m, r)
            for g, h in zip(*check[p], strict=True):
                found += known.meet(far[g], group.get(h, [h]), sets, own)
    return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})


def _unpack_links(batches):
    for b in batches:
        t = pa.Table.from_batches([b])
        for a, c in zip(t.column("a").to_pylist(), t.column("b").to_pylist(), strict=True):
            yield pa.RecordBatch.from_arrays([pa.array(unpack(a), pa.int64()), pa.array(unpack(c), pa.int64())], names=["a", "b"])


def _members_of(batches):
    """The members of packed crowds, a row each."""
    for b in batches:
        t = pa.Table.from_batches([b])
        for run, *packed in zip(*(t.column(x).to_pylist() for x in ("run", "a", "b", "c")), strict=True):
            ids, size, pos = map(unpack, packed)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), run)), pa.array(ids), pa.array(size), pa.array(pos)], names=["run", "d1", "size", "pos"])


def _across(links: DataFrame, crowds: DataFrame, inside: DataFrame, parts: int, verified) -> DataFrame:
    """``links`` and the links between components that share a crowd.

    Rows of crowds are (run, d1, size, pos) by group; ``inside`` has (d1, id) of
    the members of groups. Each member is judged by its own component. A member
    outside its crowd's main component is paired with the members of other
    components that it can link with by size and place, all of them. While those
    pairs may be many (WORK for each member), first PIVOTS of the main component
    are tried on all members outside it, which makes main components grow.
    """
    members = saved(crowds.withColumnRenamed("d1", "id").unionByName(crowds.join(inside, "d1").select("run", "id", "size", "pos")).groupBy("run", "id").agg(F.min("size").alias("size"), F.min("pos").alias("pos")))
    block = F.pmod(F.xxhash64("x"), F.lit(parts))
    x = F.struct
    for turn in range(TURNS + 1):
        comp = saved(components(links))
        links = comp.select(F.col("id").alias("a"), F.col("component").alias("b")).where("a <> b")
        placed = members.join(comp, "id", "left").withColumn("c", F.coalesce("component", "id")).drop("component")
        each = placed.groupBy("run", "c").agg(F.count("*").alias("n"))
        main = each.groupBy("run").agg(F.max_by("c", x("n", "c")).alias("main"), F.sum("n").alias("total"), F.max("n").alias("top")).where("top < total")
        placed = saved(placed.join(main, "run"))
        work, rows = main.agg(F.sum((F.col("total") - F.col("top")) * F.col("total")), F.sum("total")).first()
        if not work:
            return links
        last = turn == TURNS or work <= WORK * rows
        outside = placed.where("c <> main").select("run", F.col("id").alias("x"), F.col("size").alias("n"), F.col("pos").alias("p"), "c", "main")
        others = placed.select("run", F.col("id").alias("y"), F.col("size").alias("m"), F.col("pos").alias("q"), F.col("c").alias("k"))
        if not last:
            rank = F.row_number().over(Window.partitionBy("run").orderBy(F.xxhash64("y", F.lit(turn)), "y"))
            others = placed.where("c = main").select("run", F.col("id").alias("y"), F.col("size").alias("m"), F.col("pos").alias("q"), F.col("c").alias("k")).withColumn("rank", rank).where(F.col("rank") <= PIVOTS).drop("rank")
        # sizes of linked sets are at most one step of this scale apart
        outside = outside.withColumn("step", F.explode(F.array(*(F.floor(F.log(F.col("n").cast("double")) / math.log(SCALE)) + i for i in (-1, 0, 1)))))
        others = others.withColumn("step", F.floor(F.log(F.col("m").cast("double")) / math.log(SCALE)))
        need = F.expr(f"ceil({NUMERATOR} * (n + m) / {NUMERATOR + DENOMINATOR})")
        pairs = outside.join(others, ["run", "step"]).where((F.col("c") != F.col("k")) & ((F.col("k") == F.col("main")) | (F.col("x") < F.col("y"))) & (F.least(F.expr("n - p"), F.expr("m - q")) >= need))
        pairs = saved(pairs.select(F.col("y").alias("d1"), F.col("x").alias("d2")).distinct().select(F.pmod(F.xxhash64("d1"), F.lit(parts)).alias("b1"), F.pmod(F.xxhash64("d2"), F.lit(parts)).alias("b2"), "d1", "d2"))
        links = saved(links.unionByName(verified(pairs, None)))
        if last:
            return links


def links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) that connect all linked ids, and the holder of each id's class: (id, n_shingles, holder) for every row."""
    parts = count(docs, text_col, block_chars)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    blocks = saved(deal(rows, parts, F.coalesce("id", F.xxhash64("text")))).groupBy("block")
    bits = min(SKETCH_MOST, max(10, (parts * block_chars // (6 * SHARE)).bit_length()))
    met = saved(blocks.applyInArrow(_send_sets(parts, bits), ROWS).groupBy("part").applyInArrow(_meet_sets(bits), ROWS))
    levels = np.zeros(1 << bits, np.uint8)
    size = len(levels) // SKETCH_CHUNKS
    for r in met.where("kind = 'sketch'").select("part", "a").toLocalIterator():  # 2**bits bytes in all
        levels[(-1 - r["part"]) * size : -r["part"] * size] = np.frombuffer(bytes(r["a"]), np.uint8)
    classes = met.where("kind = 'class'")

    sent = saved(blocks.cogroup(classes.groupBy("block")).applyInArrow(_send_prefixes(levels, parts, bits), ROWS))
    met_pairs = saved(sent.where("kind = 'prefix'").groupBy("part").applyInArrow(_meet_prefixes, MET))
    members = sent.where("kind = 'members'")
    found = saved(sent.where("kind = 'links'").select("a", "b").mapInArrow(_unpack_links, LINKS))

    def verified(pairs: DataFrame, members: DataFrame | None) -> DataFrame:
        asked = saved(pairs.select("b1", "b2", "d1", "d2").groupBy("b1", "b2").applyInArrow(_ask, ROWS))
        group = members if members is not None else asked.limit(0)
        texts = blocks.cogroup(asked.where("kind = 'send'").unionByName(group).groupBy("block")).applyInArrow(_send_texts, ROWS)
        return saved(blocks.cogroup(texts.unionByName(asked.where("kind = 'check'")).unionByName(group).groupBy("block")).applyInArrow(_verify, LINKS))

    pairs = met_pairs.where("kind = 'pair'").select("b1", "b2", "d1", "d2").distinct()
    found = saved(found.unionByName(verified(pairs, members)))
    crowds = met_pairs.where("kind = 'crowd'").select("run", "a", "b", "c").mapInArrow(_members_of, CROWDS)
    inside = members.select("a", "b").mapInArrow(_unpack_links, LINKS).toDF("d1", "id")
    found = _across(found, crowds, inside, parts, verified)

    def holders(answers: pa.Table) -> pa.Table:
        holder, ids, sizes, low = _holders(answers), [], [], []
        for row in answers.filter(pa.array([k == "docs" for k in answers.column("kind").to_pylist()])).to_pylist():
            key = map(tuple, np.frombuffer(row["d"], np.uint64).reshape(-1, 2).tolist())
            for d, known, n, k in zip(*(unpack(row[c]).tolist() for c in "abc"), key, strict=True):
                d = d if known else None
                ids.append(d)
                sizes.append(n)
                low.append(holder.get(k, d) if known and n else d)
        return pa.table({"id": pa.array(ids, pa.int64()), "n_shingles": pa.array(sizes, pa.int64()), "holder": pa.array(low, pa.int64())})

    return found, met.where("kind IN ('class', 'docs')").groupBy("block").applyInArrow(holders, "id long, n_shingles long, holder long")


def joined(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """id, n_shingles and component_id of every row."""
    found, held = links(docs, id_col, text_col, block_chars)
    comp = components(found).select(F.col("id").alias("holder"), "component")
    return held.join(comp, "holder", "left").select(F.col("id").alias(id_col), "n_shingles", F.coalesce("component", "holder").alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows whose id is the smallest of its component, one for each id, in their own columns; rows with a null id all stay."""
    parts = count(docs, text_col, block_chars)
    keep = joined(docs, id_col, text_col, block_chars).where(F.col("component_id") == F.col(id_col)).select(F.col(id_col).cast("long").alias("id")).distinct()
    keep = keep.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(parts)))
    schema = docs.schema
    names = [f"c{i}" for i in range(len(schema))]
    rows = docs.select(F.col(id_col).cast("long").alias("id"), *(docs[c].alias(n) for c, n in zip(docs.columns, names, strict=True)))
    arrow = to_arrow_schema(schema)

    def pick(table: pa.Table, kept: pa.Table) -> pa.Table:
        if not table.num_rows:
            return arrow.empty_table()
        mine, stays, take = dealt(table), set(kept.column("id").to_pylist()), []
        for i, d in enumerate(mine.column("id").to_pylist()):
            if d is None or d in stays:
                take.append(i)
                stays.discard(d)
        mine = mine.select(names).take(pa.array(take, pa.int64()))
        return pa.table([c.cast(t) for c, t in zip(mine.columns, arrow.types, strict=True)], schema=arrow)

    place = F.coalesce("id", F.xxhash64(names[docs.columns.index(text_col)]))
    return deal(rows, parts, place).groupBy("block").cogroup(keep.groupBy("block")).applyInArrow(pick, schema)


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ORACLE = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {SHINGLE} THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - {SHINGLE - 2}), lambda i: array_to_string(w[i : i + {SHINGLE - 1}], ' ')) END) AS g
  FROM d
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS m FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id
), l AS (
  SELECT x, y FROM shared JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * m >= 75 * (p.n + q.n - m)
), e AS (
  SELECT x, y FROM l UNION SELECT y, x FROM l
), r(doc_id, c) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.y FROM r JOIN e ON r.c = e.x
)
SELECT d.doc_id, CAST(coalesce(any_value(n), 0) AS BIGINT) AS n_shingles, min(c) AS component_id
FROM d JOIN r USING (doc_id) LEFT JOIN n USING (doc_id) GROUP BY d.doc_id
"""

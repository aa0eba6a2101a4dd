"""Quality classifier (operator 9): a generalised additive model with pairwise interactions.

Sixteen figures of a text are cut into quantile bins. Cyclic boosting visits the
features in turn, fits a shallow tree (at most LEAVES leaves) to the current
residuals over the feature's bins, and adds a small step of it to the feature's
lookup table; the strongest pairs of features then get two-dimensional tables
(one cut on each side) in the same way. A score is the logistic function of the
sum of table entries, looked up by vectorised indexing.

It is fitted on a bounded sample: at most ``sample`` labelled rows (default
SAMPLE), those with the smallest hash of their id, so it doesn't depend on
partitions. Only figures of the text are inputs.

Nulls and empty texts have the figures of an empty text and a score like any
other; labels that are null are left out; without any usable label every score
is 0.5, with one class only it is near that class. Repeated rows each give a
row, an empty table gives no rows, other columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import map_texts

SAMPLE = 20_000
BINS, ROUNDS, RATE, LEAVES, PAIRS = 32, 150, 0.15, 4, 6
THRESHOLD = 0.7

FIGURES = (
    "log_chars", "log_words", "word_length", "upper", "digit", "mark", "shout", "junk", "bar", "stop", "comma", "beyond_ascii", "distinct_words", "top_word", "distinct_lines", "words_a_line",
)

_SETS = {
    "lower": bytes(range(97, 123)), "upper": bytes(range(65, 91)), "digit": b"0123456789", "mark": bytes(c for c in range(33, 127) if not chr(c).isalnum()), "shout": b"!", "junk": b"*&%#$", "bar": b"|", "stop": b".", "comma": b",",
}


def figures(text: str | None) -> list[float]:
    if not text or not text.strip():
        return [0.0] * len(FIGURES)
    b = text.encode("utf-8", "surrogatepass")
    n = {k: len(b) - len(b.translate(None, s)) for k, s in _SETS.items()}
    ws = b.split()
    lines = [x for x in b.split(b"\n") if x.strip()]
    chars, w = len(text), max(1, len(ws))
    counts = Counter(ws)
    return [
        np.log1p(chars), np.log1p(len(ws)), chars / w, n["upper"] / (1 + n["upper"] + n["lower"]), n["digit"] / chars, n["mark"] / chars, n["shout"] / w, n["junk"] / w, n["bar"] / w, n["stop"] / w, n["comma"] / w,
        (len(b) - chars) / chars, len(counts) / w, max(counts.values(), default=0) / w, len(set(lines)) / max(1, len(lines)), np.log1p(w / max(1, len(lines))),
    ]


class Gam:
    def __init__(self, edges: list[np.ndarray], intercept: float):
        self.edges, self.intercept = edges, intercept
        self.one = [np.zeros(len(e) + 1) for e in edges]
        self.two: dict[tuple[int, int], np.ndarray] = {}

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], 1)

    def logits(self, b: np.ndarray) -> np.ndarray:
        out = np.full(len(b), self.intercept)
        for j, t in enumerate(self.one):
            out += t[b[:, j]]
        for (i, j), t in self.two.items():
            out += t[b[:, i], b[:, j]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.logits(self.bins(x)))) if len(x) else np.zeros(0)


def _gain(g, h):
    return g * g / (h + 1.0)


def _line_tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Newton steps of a tree over one feature's bins, from the sums of gradients and curvatures in each bin."""
    cuts = [0, len(g)]
    gs, hs = np.r_[0, np.cumsum(g)], np.r_[0, np.cumsum(h)]
    for _ in range(LEAVES - 1):
        best = (1e-9, None)
        for a, z in zip(cuts, cuts[1:], strict=False):
            if z - a > 1:
                m = np.arange(a + 1, z)
                win = _gain(gs[m] - gs[a], hs[m] - hs[a]) + _gain(gs[z] - gs[m], hs[z] - hs[m]) - _gain(gs[z] - gs[a], hs[z] - hs[a])
                k = int(win.argmax())
                if win[k] > best[0]:
                    best = (win[k], int(m[k]))
        if best[1] is None:
            break
        cuts = sorted([*cuts, best[1]])
    out = np.empty(len(g))
    for a, z in zip(cuts, cuts[1:], strict=False):
        out[a:z] = (gs[z] - gs[a]) / (hs[z] - hs[a] + 1.0)
    return out


def _cross_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The best cut on both sides of a two-dimensional table: its gain and the Newton steps of its four corners."""
    gs, hs = (np.pad(x.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for x in (g, h))
    corner = lambda s: (s[1:-1, 1:-1], s[1:-1, -1:] - s[1:-1, 1:-1], s[-1:, 1:-1] - s[1:-1, 1:-1], s[-1, -1] - s[1:-1, -1:] - s[-1:, 1:-1] + s[1:-1, 1:-1])
    if min(g.shape) < 2:
        return 0.0, np.zeros_like(g)
    cg, ch = corner(gs), corner(hs)
    win = sum(_gain(a, b) for a, b in zip(cg, ch, strict=True)) - _gain(gs[-1, -1], hs[-1, -1])
    i, j = np.unravel_index(win.argmax(), win.shape)
    steps = [a[i, j] / (b[i, j] + 1.0) for a, b in zip(cg, ch, strict=True)]
    out = np.empty_like(g)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = steps
    return float(win[i, j]), out


def fit(x: np.ndarray, y: np.ndarray) -> Gam:
    n, wide = len(y), x.shape[1]
    if not n:
        return Gam([np.zeros(0)] * wide, 0.0)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(wide)]
    rate = (y.sum() + 0.5) / (n + 1)
    gam = Gam(edges, float(np.log(rate / (1 - rate))))
    b = gam.bins(x)
    f = gam.logits(b)
    for _ in range(ROUNDS):
        for j in range(wide):
            p = 1 / (1 + np.exp(-f))
            size = len(gam.one[j])
            step = RATE * _line_tree(np.bincount(b[:, j], y - p, size), np.bincount(b[:, j], p * (1 - p), size))
            gam.one[j] += step
            f += step[b[:, j]]

    def table(i, j, p):
        shape = (len(gam.one[i]), len(gam.one[j]))
        at = b[:, i] * shape[1] + b[:, j]
        return (np.bincount(at, w, shape[0] * shape[1]).reshape(shape) for w in (y - p, p * (1 - p)))

    p = 1 / (1 + np.exp(-f))
    ranked = sorted(((_cross_tree(*table(i, j, p))[0], i, j) for i in range(wide) for j in range(i)), reverse=True)
    for _, i, j in ranked[:PAIRS]:
        gam.two[i, j] = np.zeros((len(gam.one[i]), len(gam.one[j])))
    for _ in range(ROUNDS // 3):
        for (i, j), t in gam.two.items():
            p = 1 / (1 + np.exp(-f))
            step = RATE * _cross_tree(*table(i, j, p))[1]
            t += step
            f += step[b[:, i], b[:, j]]
    return gam


def held_out(id_col):
    """Rows whose crc32(id as text) leaves 2 when divided by 4; they never teach. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def _figure_rows(df: DataFrame, id_col: str, text_col: str, keep: list[str]) -> DataFrame:
    return map_texts(df, text_col, keep, [T.StructField("__x", T.ArrayType(T.DoubleType()))], lambda: lambda texts: {"__x": [figures(t) for t in texts]})


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Gam:
    """The model from a bounded sample of labelled rows that aren't held out. Of different labels or texts of one id the smallest teaches."""
    usable = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    few = usable.select(F.col(id_col).alias("__id"), F.col(label_col).cast("double").alias("__y")).groupBy("__id").agg(F.min("__y").alias("__y")).orderBy(F.xxhash64("__id"), "__id").limit(sample)
    texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__t")).join(F.broadcast(few), "__id")  # `sample` rows of two numbers at most
    rows = _figure_rows(texts, "__id", "__t", ["__id", "__y"]).groupBy("__id").agg(F.min("__x").alias("__x"), F.min("__y").alias("__y")).toPandas().sort_values("__id")
    x = np.array(rows["__x"].tolist(), float).reshape(len(rows), len(FIGURES))
    return fit(x, rows["__y"].to_numpy(float))


def _scored(df: DataFrame, gam: Gam, text_col: str, keep: list[str], name: str) -> DataFrame:
    def make():
        return lambda texts: {name: gam.score(np.array([figures(t) for t in texts], float).reshape(len(texts), len(FIGURES)))}

    return map_texts(df, text_col, keep, [T.StructField(name, T.DoubleType())], make)


def score(docs: DataFrame, gam: Gam, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """id, held_out, score and predicted of every row."""
    out = _scored(docs, gam, text_col, [id_col], "score")
    return out.select(id_col, held_out(id_col).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, gam: Gam, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows that score ``threshold`` or more, in their own columns."""
    return _scored(docs, gam, text_col, docs.columns, "__score").where(F.col("__score") >= threshold).select(*docs.columns)

"""Personal data (operator 1): a linear-chain conditional random field over word shapes.

``base_spans`` finds the four plain forms by rule. A conditional random field
over word-shape features, trained on the small labelled table of ``examples``
(maximum likelihood with an L2 prior, forward-backward in numpy), adds the forms
that the rules miss: national phone numbers, spelled-out at signs, card numbers
with other separators, host-less addresses. Lines are decoded by Viterbi in
numpy batches. A span that touches a base span is left out, so base spans stay.
A span whose digits can't be of its kind (cards have 12 to 19, phones 7 to 15)
takes the other kind if they can be of that, and else isn't one.

Every line is scored by the field, with digits and at signs or without; nothing
is skipped or cut. Viterbi runs where it can find anything: for each token the
most that any personal label could gain over "none" is known from the tables,
and a line whose gains don't add up to more than nothing has no better path than
the one without labels. (Plain forms can't be without a digit or an at sign, so
only they are looked for where one is.)

Nulls and empty texts have no spans. Repeated rows each give a row, an empty
table gives no rows, other columns are ignored by ``find`` and kept by ``mask``.
"""

from __future__ import annotations

import functools
import hashlib
import random
import re
from bisect import bisect_left
from itertools import accumulate

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .batches import map_texts

KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TRIGGER = re.compile("[0-9@]")
NOT_DIGIT = re.compile("[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of the plain forms, leftmost and non-overlapping per kind, in order."""
    out: list[tuple[int, int, int]] = []
    if not text:
        return out
    at, floor = text.find("@"), 0
    while at >= 0:
        s = at
        while s > floor and text[s - 1] in LOCAL:
            s -= 1
        m = DOMAIN.match(text, at + 1) if s < at else None
        if m:
            out.append((s, 0, m.end()))
            floor = m.end()
        else:
            floor = at + 1
        at = text.find("@", floor)
    for m in IP.finditer(text):
        if all(int(p) <= 255 if len(p) < 10 else int(p.lstrip("0")[:4] or 0) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        d = NOT_DIGIT.sub("", m[0])
        if 12 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    for m in PHONE.finditer(text):
        if 9 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    out.sort()
    return out


# ---- the labelled table ---------------------------------------------------------------------------------------------

SYLLABLES = ("an", "be", "ch", "de", "en", "er", "ga", "ha", "in", "ir", "jo", "ka", "la", "mo", "na", "on", "pa", "re", "sol", "ti", "un", "ver", "wa", "za", "é", "ü", "ñ")


def examples(n: int = 600, seed: int = 7) -> list[list[tuple[str, str]]]:
    """The labelled table: ``n`` sentences as lists of (piece of text, kind or "O"), made by rule from a seed."""
    r = random.Random(seed)
    num = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 4)))
    host = lambda: f"{word()}{r.choice(['', num(1)])}.{r.choice(['example.com', 'mail.org', 'net', 'example.net'])}"
    user = lambda: r.choice([word(), f"{word()}.{word()}", f"{word()}.{num(2)}", f"{word()}{num(2)}", f"{word()}_{word()}"])

    def card():
        d = r.choice("3456") + num(14)
        d += next(c for c in "0123456789" if luhn(d + c))
        return d

    group = lambda d, s: s.join(d[i : i + 4] for i in range(0, len(d), 4))
    entity = {
        "email": lambda: r.choice([f"{user()}@{host()}", f"{user()} [at] {host()}", f"{user()} (at) {host()}", f"{user()}@{word()}", f"{user()} @ {host()}", f"{user()} at {word()} dot {r.choice(['com', 'org', 'net'])}"]),
        "ip": lambda: ".".join(str(r.randint(0, 255)) for _ in range(4)),
        "card": lambda: r.choice([card(), group(card(), " "), group(card(), "-"), group(card(), ".")]),
        "phone": lambda: r.choice([f"+{r.randint(1, 99)} ({num(3)}) {num(3)}-{num(4)}", f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}-{num(3)}-{num(4)}", f"{num(3)}.{num(3)}.{num(4)}", f"+{r.randint(1, 99)} {num(3)} {num(7)}", f"0{num(3)}/{num(7)}", f"0{num(2)} {num(4)} {num(4)}", f"0{num(4)} {num(6)}"]),
    }
    other = [
        lambda: str(r.randint(1900, 2030)), lambda: f"{r.randint(1, 31)}.{r.randint(1, 12)}.{r.randint(1990, 2030)}", lambda: f"{r.randint(1990, 2030)}-{r.randint(10, 12)}-{r.randint(10, 31)}",
        lambda: f"{r.randint(0, 23)}:{r.randint(10, 59)}", lambda: f"{r.randint(1, 9)},{num(3)}.{num(2)}", lambda: f"{r.randint(1, 9)}.{r.randint(0, 99)}", lambda: f"{r.randint(1, 9)}.{r.randint(0, 99)}.{r.randint(0, 99)}",
        lambda: f"{r.randint(1, 100)}%", lambda: num(r.randint(1, 11)), lambda: f"{word()} = \"{''.join(r.choice('0123456789abcdef') for _ in range(40))}\"", lambda: f"{num(2)}-{num(2)}", lambda: f"({r.randint(1, 99)})",
        lambda: f"{word()}{num(2)}", lambda: f"${num(3)}", lambda: f"{num(3)} {num(3)}", lambda: f"https://{host()}/{word()}/{num(3)}", lambda: f"{num(3)}-{num(1)}-{num(2)}-{num(6)}-{num(1)}", lambda: f"@ {word()}",
        lambda: f"Version {r.randint(1, 9)}.{r.randint(0, 9)}.", lambda: f"{r.randint(1, 31)}/{r.randint(1, 12)}/{r.randint(1990, 2030)}", lambda: f"{num(2)} {num(2)} {num(4)}",
        lambda: f"{word()} at {word()}", lambda: f"at {host()}", lambda: f"({word()})", lambda: f"[{word()}]", lambda: f"{word()}.{word()}", lambda: host(), lambda: f"{word()}_{word()}", lambda: " ".join(["at"] * r.randint(1, 6)), lambda: f"{word()} dot {word()}",
    ]
    rows = []
    for _ in range(n):
        row: list[tuple[str, str]] = []
        for _ in range(r.randint(1, 6)):
            row.append((" ".join((r.choice(sorted(CUES)) if r.random() < 0.1 else word().capitalize() if r.random() < 0.15 else word()) + r.choice(["", "", "", "", ",", ".", "***", "&&&", " |", "!!"]) for _ in range(r.randint(1, 5))), "O"))
            if r.random() < 0.5:
                k = r.choice(KINDS)
                row.append((entity[k]() , k))
                if r.random() < 0.3:
                    row.append((r.choice([".", ",", "***", "&&&", "###", "%%%", ")", " |"]), "+"))
            elif r.random() < 0.6:
                row.append((r.choice(other)(), "O"))
        rows.append(row)
    return rows


def spelled(row: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int, str]]]:
    """A row's text and labelled spans; a "+" piece stands without a blank before it."""
    text, spans = "", []
    for piece, kind in row:
        text += " " if text and kind != "+" else ""
        if kind not in "O+":
            spans.append((len(text), len(text) + len(piece), kind))
        text += piece
    return text, spans


# ---- features ---------------------------------------------------------------------------------------------------------

TOKEN = re.compile(r"[^\W_]+|[^\s]")
CUES = frozenset({"at", "dot", "com", "org", "net", "mail", "tel", "phone", "card"})


@functools.lru_cache(50_000)
def shape(token: str) -> str:
    """Word shape: a cue word itself; else runs of digits with their length, of letters by case, marks as they are."""
    low = token.lower()
    if low in CUES:
        return low
    if token.isdigit():
        return f"d{min(len(token), 20)}" if token.isascii() else "other"
    if len(token) == 1 and not token.isalnum():
        return token if token.isascii() else "mark"
    if token.isalpha():
        return "a" if token.islower() else "A" if token.isupper() else "Aa"
    hexish = len(token) >= 16 and all(c in "0123456789abcdef" for c in low)
    return "hex" if hexish else "a9" if token[-1].isdigit() else "9a"


def tokens(line: str) -> tuple[list[str], list[int], list[int]]:
    ts, ss, es = [], [], []
    for m in TOKEN.finditer(line):
        ts.append(m[0])
        ss.append(m.start())
        es.append(m.end())
    return ts, ss, es


def lanes(seqs: list[list[int]] | list[bytes], pad: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequences as one padded array and their lengths."""
    n = np.fromiter(map(len, seqs), np.int64, len(seqs))
    out = np.full((len(seqs), int(n.max())), pad, np.int64)
    out[np.arange(out.shape[1]) < n[:, None]] = np.fromiter((x for s in seqs for x in s), np.int64, int(n.sum()))
    return out, n


class Crf:
    """Shape tables for the token, its neighbours up to two away and adjoining pairs, and label transitions."""

    OFFSETS = (0, -1, 1, -2, 2)

    def __init__(self, shapes: list[str]):
        self.shape_id = {s: i + 2 for i, s in enumerate(shapes)}  # 0: outside the line, 1: unknown
        k, n = len(shapes) + 2, len(LABELS)
        self.k = k
        self.unary = np.zeros((len(self.OFFSETS), k, n))
        self.pair = np.zeros((2, k * k, n))
        self.move = np.zeros((n, n))
        self.begin = np.zeros(n)
        for j, b in enumerate(LABELS):
            if b[0] == "I":
                self.begin[j] = -1e4
                for i, a in enumerate(LABELS):
                    if a[2:] != b[2:]:
                        self.move[i, j] = -1e4
        self.allowed = self.move > -1e3

    def ids(self, ts: list[str]) -> list[int]:
        get = self.shape_id.get
        return [get(shape(t), 1) for t in ts]

    def neighbours(self, s: np.ndarray) -> dict[int, np.ndarray]:
        wide = np.pad(s, ((0, 0), (2, 2)))
        return {d: wide[:, 2 + d : 2 + d + s.shape[1]] for d in self.OFFSETS}

    def features(self, s: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        at = self.neighbours(s)
        return [at[d] for d in self.OFFSETS], [at[-1] * self.k + at[0], at[0] * self.k + at[1]]

    def emissions(self, s: np.ndarray) -> np.ndarray:
        one, two = self.features(s)
        return sum(w[f] for w, f in zip(self.unary, one, strict=True)) + sum(w[f] for w, f in zip(self.pair, two, strict=True))

    @functools.cached_property
    def bounds(self) -> tuple[list[np.ndarray], float, float, float]:
        """What the best personal label gains over "none": tables by feature, and at entering, leaving and staying in a span."""
        some = np.flatnonzero(np.arange(len(LABELS)) > 0)
        gain = [(w[:, 1:] - w[:, :1]).astype(np.float32) for w in (*self.unary, *self.pair)]
        none, allowed = self.move[0, 0], np.where(self.allowed, self.move, -np.inf)
        return gain, float(allowed[0, some].max() - none), float(allowed[some, 0].max() - none), float(allowed[np.ix_(some, some)].max() - none)

    def hopeful(self, lines: list[bytes]) -> np.ndarray:
        """Which lines (shapes, a byte each) could have a better path than the one without labels.

        A span of some tokens gains at most the sum of their gains and of its
        moves, and so at most the sum of all gains of its line that are above
        nothing. A span at an end of its line has no move there.
        """
        gain, enter, leave, stay = self.bounds
        n = np.fromiter(map(len, lines), np.int64, len(lines))
        ends = np.cumsum(n + 2)
        flat = np.frombuffer(b"\0\0" + b"\0\0".join(lines) + b"\0\0", np.uint8).astype(np.int32)
        at = {d: flat[2 + d : len(flat) - 2 + d] for d in self.OFFSETS}
        total = np.zeros((len(flat) - 4, len(LABELS) - 1), np.float32)
        for g, f in zip(gain, (*(at[d] for d in self.OFFSETS), at[-1] * self.k + at[0], at[0] * self.k + at[1]), strict=True):
            total += g[f]
        best = total.max(1).astype(np.float64) + stay
        first, last = ends - n - 2, ends - 3
        best[first] += max(0.0, -enter)
        best[last] += max(0.0, -leave)
        best = np.maximum(best, 0)
        best[at[0] == 0] = 0
        return np.add.reduceat(best, first) + enter + leave - stay > -1e-3

    def viterbi(self, s: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Best labels of padded sequences ``s`` of lengths ``n``."""
        e = self.emissions(s)
        rows, steps, _ = e.shape
        score, back = e[:, 0] + self.begin, np.zeros((rows, steps, len(LABELS)), np.int8)
        for t in range(1, steps):
            all_ = score[:, :, None] + self.move
            back[:, t] = all_.argmax(1)
            score = np.where((t < n)[:, None], all_.max(1) + e[:, t], score)
        out = np.zeros((rows, steps), np.int8)
        lab = score.argmax(1)
        r = np.arange(rows)
        for t in range(steps - 1, -1, -1):
            live = t < n
            out[live, t] = lab[live]
            lab = np.where(live, back[r, t, lab], lab) if t else lab
        return out

    def fit(self, s: np.ndarray, n: np.ndarray, gold: np.ndarray, rounds: int = 60, rate: float = 0.15, prior: float = 2e-4) -> None:
        """Maximum likelihood by Adam; the gradient is observed minus expected counts from forward-backward."""
        one, two = self.features(s)
        rows, steps, L = *s.shape, len(LABELS)
        live = np.arange(steps) < n[:, None]
        target = np.eye(L)[gold] * live[:, :, None]
        pairs_seen = np.zeros((L, L))
        both = live[:, 1:] & live[:, :-1]
        np.add.at(pairs_seen, (gold[:, :-1][both], gold[:, 1:][both]), 1)
        state = [(w, np.zeros_like(w), np.zeros_like(w)) for w in (self.unary, self.pair, self.move)]
        lse = lambda x, axis: (m := x.max(axis)) + np.log(np.exp(x - np.expand_dims(m, axis)).sum(axis))
        for step in range(1, rounds + 1):
            e = self.emissions(s)
            a = np.zeros((rows, steps, L))
            a[:, 0] = e[:, 0] + self.begin
            for t in range(1, steps):
                a[:, t] = np.where(live[:, t, None], lse(a[:, t - 1, :, None] + self.move, 1) + e[:, t], a[:, t - 1])
            z = lse(a[:, -1], 1)
            b = np.zeros((rows, steps, L))
            for t in range(steps - 2, -1, -1):
                b[:, t] = np.where(live[:, t + 1, None], lse(self.move + (e[:, t + 1] + b[:, t + 1])[:, None, :], 2), b[:, t + 1])
            marginal = np.exp(np.minimum(a + b - z[:, None, None], 0)) * live[:, :, None]
            miss = (target - marginal).reshape(-1, L)
            expect = np.zeros((L, L))
            for t in range(1, steps):
                p = a[:, t - 1, :, None] + self.move + (e[:, t] + b[:, t])[:, None, :] - z[:, None, None]
                expect += (np.exp(np.minimum(p, 0)) * live[:, t, None, None]).sum(0)
            g_one = np.stack([self._gather(f, miss, self.k) for f in one])
            g_two = np.stack([self._gather(f, miss, self.k**2) for f in two])
            for (w, m1, m2), g in zip(state, (g_one, g_two, (pairs_seen - expect) * self.allowed), strict=True):
                g = g / rows - prior * np.where(w > -1e3, w, 0)
                m1 += 0.1 * (g - m1)
                m2 += 0.001 * (g * g - m2)
                w += rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8) * (g != 0)

    @staticmethod
    def _gather(f: np.ndarray, miss: np.ndarray, size: int) -> np.ndarray:
        flat = f.reshape(-1)
        return np.stack([np.bincount(flat, miss[:, j], size) for j in range(miss.shape[1])], 1)


def train(rows: list[list[tuple[str, str]]]) -> Crf:
    seqs, golds, names = [], [], set()
    number = {x: i for i, x in enumerate(LABELS)}
    for row in rows:
        text, spans = spelled(row)
        ts, ss, es = tokens(text)
        gold = []
        for s, e in zip(ss, es, strict=True):
            inside = next(((a, k) for a, z, k in spans if a <= s and e <= z), None)
            gold.append(0 if inside is None else number[("B-" if inside[0] == s else "I-") + inside[1]])
        seqs.append(ts)
        golds.append(gold)
        names |= {shape(t) for t in ts}
    crf = Crf(sorted(names))
    s, n = lanes([crf.ids(ts) for ts in seqs], 0)
    crf.fit(s, n, lanes(golds, 0)[0])
    return crf


@functools.lru_cache(1)
def trained() -> Crf:
    return train(examples())


# ---- decoding ---------------------------------------------------------------------------------------------------------

#: Cells of a padded batch.
CELLS = 60_000


class Shapes(dict):
    """The shapes of a word's tokens, a byte each; short words are remembered."""

    def __init__(self, crf: Crf):
        assert crf.k < 256
        self.crf = crf

    def __missing__(self, word: str) -> bytes:
        out = bytes(self.crf.ids(TOKEN.findall(word)))
        if len(word) <= 30:
            if len(self) >= 200_000:
                self.clear()
            self[word] = out
        return out


def model_spans(crf: Crf, lines: list[str], shapes: Shapes | None = None) -> list[list[tuple[int, int, int]]]:
    """(start, kind's number, end) that the model finds in each line."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in lines]
    get = (Shapes(crf) if shapes is None else shapes).__getitem__
    coded = [b"".join(map(get, x.split())) for x in lines]
    some = [i for i, c in enumerate(coded) if c]
    if some:
        some = np.array(some)[crf.hopeful([coded[i] for i in some])].tolist()
    order = sorted(some, key=lambda i: len(coded[i]))
    at = 0
    while at < len(order):
        end = at + 1
        while end < len(order) and (end - at + 1) * len(coded[order[end]]) <= CELLS:
            end += 1
        group = order[at:end]
        s, n = lanes([coded[i] for i in group], 0)
        got = crf.viterbi(s, n)
        for row in np.flatnonzero(got.any(1)).tolist():
            i = group[row]
            _, ss, es = tokens(lines[i])
            for j in np.flatnonzero(got[row]).tolist():
                name = LABELS[got[row, j]]
                kind = KINDS.index(name[2:])
                if name[0] == "B" or not out[i]:
                    out[i].append((ss[j], kind, es[j]))
                else:
                    out[i][-1] = (out[i][-1][0], kind, es[j])
            out[i] = [(a, k, z) for a, k, z in ((a, kind_of(lines[i][a:z], k), z) for a, k, z in out[i]) if k is not None]
        at = end
    return out


#: Least and most digits of a kind.
DIGITS = {2: (12, 19), 3: (7, 15)}


def kind_of(text: str, kind: int) -> int | None:
    """The kind that a span of the model can be by its digits: its own if that may be, else phone or card, else none."""
    if kind not in DIGITS:
        return kind
    n = sum(map(str.isdigit, text))
    return next((k for k in (kind, 3, 2) if DIGITS[k][0] <= n <= DIGITS[k][1]), None)


def all_spans(crf: Crf, texts: list[str | None], shapes: Shapes | None = None) -> tuple[list[list], list[list]]:
    """Base spans, and all spans (base ones and those of the model that touch none of them), of each text."""
    base = [base_spans(t) if t and TRIGGER.search(t) else [] for t in texts]
    lines, places = [], []
    for i, t in enumerate(texts):
        at = 0
        for line in t.split("\n") if t else ():
            lines.append(line)
            places.append((i, at))
            at += len(line) + 1
    full = [list(b) for b in base]
    if lines:
        starts = [[a for a, _, _ in b] for b in base]
        reach = [list(accumulate((z for _, _, z in b), max)) for b in base]
        for (i, at), spans in zip(places, model_spans(crf, lines, shapes), strict=True):
            for s, k, e in spans:
                before = bisect_left(starts[i], e + at)  # base spans that begin before this one's end
                if not before or reach[i][before - 1] <= s + at:
                    full[i].append((s + at, k, e + at))
    return base, [sorted(f) for f in full]


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, base counts n_email, n_ip, n_card and n_phone, base_sha256 and spans (all of them) of every row."""
    fields = [*(T.StructField(f"n_{k}", T.LongType()) for k in KINDS), T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())]
    crf = trained()

    def make():
        shapes = Shapes(crf)

        def run(texts):
            base, full = all_spans(crf, texts, shapes)
            cols = {f"n_{k}": [sum(x[1] == j for x in b) for b in base] for j, k in enumerate(KINDS)}
            return cols | {"base_sha256": [hashlib.sha256(joined(b).encode()).hexdigest() for b in base], "spans": [joined(f) for f in full]}

        return run

    return map_texts(df, text_col, [id_col], fields, make)


def masked(text: str | None, spans: list[tuple[int, int, int]]) -> str | None:
    """The text with each stretch of personal data replaced by its kind in brackets."""
    if not spans:
        return text
    out, at = [], 0
    for s, k, e in spans:
        if s >= at:
            out += [text[at:s], f"[{KINDS[k]}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def mask(df: DataFrame, text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """The rows with masked texts (and their lengths, if there is such a column), in the same columns; a null text stays null."""
    crf, chars = trained(), chars_col if chars_col in df.columns else None
    fields = [T.StructField(text_col, T.StringType())] + ([T.StructField(chars, T.LongType())] if chars else [])

    def make():
        shapes = Shapes(crf)

        def run(texts):
            new = [masked(t, s) for t, s in zip(texts, all_spans(crf, texts, shapes)[1], strict=True)]
            return {text_col: new} | ({chars: [None if t is None else len(t) for t in new]} if chars else {})

        return run

    return map_texts(df, text_col, df.columns, fields, make).select(*df.columns)

"""Token counts (operator 7): rank-synchronous array merging for byte-level BPE.

A text is cut at blanks into chunks that no pre-token crosses, so a chunk's
count can be remembered. New chunks are cut into pre-tokens, and all new
pre-tokens of a batch are held as one ragged numpy array of symbol ids. In each
round every sequence applies its lowest-rank pair at all its places at once;
what survives is counted.

Nulls count as empty (0 tokens); the strings of special tokens inside a text
count as one token each, as the tokenizer's library does by default. Repeated
rows each give a row, an empty table gives no rows, other columns are ignored.
"""

from __future__ import annotations

import json
import re

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .batches import map_texts

#: The Unicode White_Space characters (fixed values).
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Byte-level pre-tokens (fixed pattern of this vocabulary), on a text without blanks but at its start.
PRE_TOKEN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
CHUNK = re.compile(rf" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
#: Remembered chunks at most; others are merged once a batch.
CACHE = 300_000


def byte_symbols() -> list[str]:
    """The printable stand-in for each byte: itself if printable Latin-1, else the next free code from 256 on."""
    out, n = [], 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out.append(chr(b))
        else:
            out.append(chr(n))
            n += 1
    return out


class Bpe:
    """Ragged-array merges of one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.base = np.array([vocab[c] for c in byte_symbols()], np.int64)
        self.width = max(vocab.values()) + 1
        keys = np.array([vocab[a] * self.width + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.rank = keys[order], order.astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.special = [t["content"] for t in spec.get("added_tokens", []) if t["content"]]
        self.cut = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.pre = regex.compile(PRE_TOKEN)
        self.seen: dict[str, int] = {}

    def merge_counts(self, tokens: list[bytes]) -> np.ndarray:
        """Surviving symbols of each (non-empty) pre-token."""
        sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        done = sizes.copy()
        sym = self.base[np.frombuffer(b"".join(tokens), np.uint8)]
        seq = np.repeat(np.arange(len(tokens)), sizes)
        none = np.int64(len(self.rank))
        while len(sym):
            key = sym[:-1] * self.width + sym[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.full(len(sym), none)
            rank[:-1] = np.where((self.keys[at] == key) & (seq[:-1] == seq[1:]), self.rank[at], none)
            starts = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
            low = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.r_[starts, len(sym)])
            done[seq[starts]] = sizes
            active = np.repeat(low < none, sizes)
            if not active.any():
                break
            hit = (rank == np.repeat(low, sizes)) & active
            # of touching places (a pair like "aa" in "aaa") every other one from the left merges
            place = np.flatnonzero(hit)
            first = np.r_[True, np.diff(place) > 1]
            run = np.flatnonzero(first)
            odd = (np.arange(len(place)) - np.repeat(run, np.diff(np.r_[run, len(place)]))) % 2 == 1
            place = place[~odd]
            sym[place] = self.made[rank[place]]
            keep = active
            keep[place + 1] = False
            sym, seq = sym[keep], seq[keep]
        return done

    def learn(self, chunks: list[str], into: dict[str, int]) -> None:
        cut = [self.pre.findall(c) for c in chunks]
        flat = list(dict.fromkeys(t for c in cut for t in c))
        counts = dict(zip(flat, self.merge_counts([t.encode("utf-8", "surrogatepass") for t in flat]).tolist(), strict=True)) if flat else {}
        for c, ts in zip(chunks, cut, strict=True):
            into[c] = sum(map(counts.__getitem__, ts))

    def counts(self, texts: list[str | None]) -> list[int]:
        extra, cut = [0] * len(texts), []
        for i, t in enumerate(texts):
            t = t or ""
            if self.cut and any(s in t for s in self.special):
                parts = self.cut.split(t)
                extra[i] = len(parts) - 1
                cut.append([c for p in parts for c in CHUNK.findall(p)])
            else:
                cut.append(CHUNK.findall(t))
        seen, fresh = self.seen, {}
        new = {c for cs in cut for c in cs if c not in seen}
        if new:
            self.learn(list(new), fresh)
        if len(seen) < CACHE:
            seen.update(fresh)
            fresh = {}
        get = (lambda c: seen.get(c) or fresh[c]) if fresh else seen.__getitem__
        return [e + sum(map(get, cs)) for e, cs in zip(extra, cut, strict=True)]


_LOADED: dict[str, Bpe] = {}


def loaded(path: str) -> Bpe:
    if path not in _LOADED:
        _LOADED[path] = Bpe(path)
    return _LOADED[path]


def token_counts(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """id, n_bytes, n_tokens and over_limit (more than ``limit`` tokens) of every row."""
    fields = [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())]

    def make():
        bpe = loaded(path)

        def run(texts):
            n = bpe.counts(texts)
            return {"n_bytes": [len(t.encode("utf-8", "surrogatepass")) if t else 0 for t in texts], "n_tokens": n, "over_limit": [x > limit for x in n]}

        return run

    return map_texts(df, text_col, [id_col], fields, make)

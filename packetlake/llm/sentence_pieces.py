"""SentencePiece encoding and decoding (operator 8): suffix-array matching.

Blanks become the meta symbol and a text is cut where a meta symbol follows
another character or an ASCII mark follows a letter; no piece of the model
crosses such a place (checked when the model is loaded), so a chunk is encoded
on its own, and the first ones met are remembered. The new
chunks of a batch are joined, their suffix array is built by prefix doubling up
to the longest piece, every piece is binary-searched for its range of
occurrences, and the resulting edges are sorted by position. Relaxing takes,
round by round and for every chunk at once, the best-scored edge that joins two
neighbouring symbols, until none is left; this is the model's own BPE order.
Characters without a piece fall back to byte pieces.

Nulls and empty texts have no ids. Decoding gives back the text, but that the
meta symbol itself reads as a blank. Repeated rows each give a row, an empty
table gives no rows, other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .batches import map_texts

META = "▁"
MARKS = re.escape("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
CHUNK = re.compile(rf"{META}*[^{META}{MARKS}]*[^\W\d_\xb2\xb3\xb9\xbc-\xbe](?=[{META}{MARKS}]|\Z)|{META}*[^{META}]+|{META}+")
CROSSING = re.compile(rf"[^{META}]{META}|[^\W\d_\xb2\xb3\xb9\xbc-\xbe][{MARKS}]")
#: Texts that common normalisations change: ligature, wide letters, blanks in a row and at the ends, tab, composed and split accents.
PROBES = ("\ufb01n \uff21\uff22 a", "  two  blanks ", "tab\tand\nline", "e\u0301 \u00e9", "The Quick-brown fox's 12,5% [x]")
#: Remembered chunks at most; others are encoded once a batch.
CACHE = 300_000
#: New chunks are matched in groups of about so many characters.
GROUP_CHARS = 400_000


class Pieces:
    """The vocabulary of a BPE model and its encoder."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.unk = sp.unk_id()
        self.bytes = {}
        for i in range(sp.get_piece_size()):
            if sp.is_byte(i):
                self.bytes[int(sp.id_to_piece(i)[3:5], 16)] = i
        self.text = {i: sp.id_to_piece(i) for i in ids}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.id_of = {p: i for i, p in self.text.items()}
        if any(CROSSING.search(p) for p in self.id_of):
            raise ValueError("a piece goes on over a blank or a mark; this model can't be cut there")
        # a higher level is a better score; equal scores share a level
        many = [i for i in ids if len(self.text[i]) > 1]
        scores = np.array([sp.get_score(i) for i in many])
        self.many = np.array(many)
        self.level = np.unique(scores, return_inverse=True)[1].astype(np.int64) + 1
        self.size = np.array([len(self.text[i]) for i in many])
        self.deep = int(self.size.max())
        # the pieces' characters as places in an alphabet; its last place stands for none
        self.alphabet = np.unique(np.concatenate([[ord(c) for c in self.text[i]] for i in many]))
        self.chars = np.full((len(many), self.deep), len(self.alphabet))
        for k, i in enumerate(many):
            self.chars[k, : self.size[k]] = np.searchsorted(self.alphabet, [ord(c) for c in self.text[i]])
        # pieces that a better-scored piece contains at its start or end merge one place at a time
        level = dict(zip((self.text[i] for i in many), self.level.tolist(), strict=True))
        careful = set()
        for p, v in level.items():
            for q in (*(p[:k] for k in range(2, len(p))), *(p[k:] for k in range(1, len(p) - 1))):
                if level.get(q, v) < v:
                    careful.add(level[q])
        self.careful = np.zeros(int(self.level.max()) + 1, bool)
        self.careful[list(careful)] = True
        #: the text of every id; None where a byte piece or a sign without text needs the slow way
        self.plain = [self.text.get(i) for i in range(sp.get_piece_size())]
        self.seen: dict[str, bytes] = {}
        # texts must be taken as they are, with one blank before: other normalisation or user-defined pieces show in these
        for probe in PROBES:
            if self.encode([probe])[0].tolist() != sp.encode(probe):
                raise ValueError("this model normalises texts or cuts them in another way")

    def edges(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, row of the piece) of every occurrence of a piece, by start then size.

        Characters become their places among the text's own, 0 beyond its end, so that
        several fit into one number: the doubling begins with as many, and the pieces
        are searched for by as many characters at a time.
        """
        n = len(code)
        kinds, sign = np.unique(code, return_inverse=True)
        bits = (len(kinds) + 1).bit_length()
        padded = np.r_[sign.reshape(-1) + 1, np.zeros(self.deep, np.int64)]

        def joined(columns) -> np.ndarray:
            out = 0
            for c in columns:
                out = out << bits | c
            return out

        h = min(63 // bits, self.deep)
        key = joined(padded[j : j + n] for j in range(h))
        order = np.argsort(key)
        rank = np.empty(n, np.int64)
        while True:
            key = key[order]
            rank[order] = np.cumsum(np.r_[1, key[1:] != key[:-1]])
            if h >= self.deep:
                break
            key = rank * (n + 2)
            key[: max(0, n - h)] += rank[h:]
            order = np.argsort(key)
            h *= 2
        # signs of the pieces' characters: 0 for those that the text doesn't have
        at = np.minimum(np.searchsorted(kinds, self.alphabet), len(kinds) - 1)
        signs = np.r_[np.where(kinds[at] == self.alphabet, at + 1, 0), 0][self.chars]
        beyond = np.arange(self.deep) >= self.size[:, None]
        live = np.flatnonzero(((signs > 0) | beyond).all(1))
        lo, hi = np.zeros(len(self.many), np.int64), np.zeros(len(self.many), np.int64)
        # stretches of the suffix array that agree so far, and the one of each piece
        stretch, own, d = np.zeros(n, np.int64), np.zeros(len(live), np.int64), 0
        while len(live):
            m = min(self.deep - d, (63 - (n.bit_length() if d else 0)) // bits)
            key = (stretch << bits * m) | joined(padded[d + j : d + j + n] for j in range(m))[order]
            least, filler = signs[live, d : d + m], beyond[live, d : d + m] * ((1 << bits) - 1)
            own = own << bits * m
            lo[live] = np.searchsorted(key, own | joined(least.T), "left")
            hi[live] = np.searchsorted(key, own | joined((least | filler).T), "right")
            d += m
            live = live[(self.size[live] > d) & (lo[live] < hi[live])]
            stretch = np.cumsum(np.r_[0, key[1:] != key[:-1]])
            own = stretch[lo[live]]
        count = hi - lo
        piece = np.repeat(np.arange(len(count)), count)
        first = np.repeat(lo - (np.cumsum(count) - count), count)
        start = order[first + np.arange(len(piece))]
        for_size, for_piece = self.deep.bit_length(), len(count).bit_length()
        both = np.sort((start << for_size | self.size[piece]) << for_piece | piece)
        return both >> for_size + for_piece, both & ((1 << for_piece) - 1)

    def encode_chunks(self, chunks: list[str], into: dict[str, bytes]) -> None:
        """The ids of each chunk as little-endian 32-bit integers."""
        sizes = np.fromiter(map(len, chunks), np.int64, len(chunks))
        starts = np.cumsum(sizes + 1) - (sizes + 1)
        n = int((sizes + 1).sum())
        code = np.frombuffer("\0".join(chunks).encode("utf-32-le", "surrogatepass") + b"\0\0\0\0", np.uint32).astype(np.int64)
        code[starts + sizes] = -1  # ends a chunk; no piece has it
        s, p = self.edges(code)
        end, level, made = s + self.size[p], self.level[p], self.many[p]
        chunk_of = np.repeat(np.arange(len(chunks)), sizes + 1)
        kinds, kind = np.unique(code, return_inverse=True)
        piece = np.array([self.id_of.get(chr(c), -1) if c >= 0 else -1 for c in kinds.tolist()], np.int64)[kind]  # of the symbol that starts here
        nxt = np.arange(1, n + 1)  # where the symbol that starts here ends
        is_start = np.ones(n + 1, bool)
        while len(s):
            mid = nxt[s]
            alive = is_start[s] & is_start[end] & (mid < end)
            s, end, level, mid, made = s[alive], end[alive], level[alive], mid[alive], made[alive]
            if not len(s):
                break
            able = np.flatnonzero(nxt[mid] == end)
            if not len(able):
                break
            c = chunk_of[s[able]]
            new = np.flatnonzero(np.r_[True, c[1:] != c[:-1]])
            best = np.maximum.reduceat(level[able], new)
            width = np.diff(np.r_[new, len(c)])
            hit = able[level[able] == np.repeat(best, width)]
            c = chunk_of[s[hit]]
            first = np.r_[True, c[1:] != c[:-1]]
            # overlapping hits: from the left, each that begins at or after the end of the last one taken
            take = first.copy()
            if not take.all():
                slow = self.careful[level[hit]]
                clash = ~first & ~slow & np.r_[False, s[hit][1:] < end[hit][:-1]]
                take |= ~slow & ~clash
                if clash.any():
                    last = -1
                    lo_hit = np.flatnonzero(np.isin(c, np.unique(c[clash])))
                    for k in lo_hit.tolist():
                        if not first[k] and s[hit[k]] < last:
                            take[k] = False
                        else:
                            take[k] = True
                            last = end[hit[k]]
            hit = hit[take]
            is_start[mid[hit]] = False
            nxt[s[hit]] = end[hit]
            piece[s[hit]] = made[hit]
            busy = np.zeros(len(chunks), bool)
            busy[c] = True
            rest = busy[chunk_of[s]]
            s, end, level, made = s[rest], end[rest], level[rest], made[rest]
        is_start[starts + sizes] = False
        cuts = np.flatnonzero(is_start[:n])
        which = np.searchsorted(cuts, starts)
        upto = np.r_[which[1:], len(cuts)]
        ids = piece[cuts]
        lost = np.zeros(len(cuts) + 1, np.int64)
        lost[1:] = np.cumsum(ids < 0)
        raw = ids.astype("<i4").tobytes()
        for t, a, z, missing in zip(chunks, which.tolist(), upto.tolist(), (lost[upto] > lost[which]).tolist(), strict=True):
            into[t] = self._with_bytes(cuts[a:z], ids[a:z], code) if missing else raw[4 * a : 4 * z]

    def _with_bytes(self, at: np.ndarray, ids: np.ndarray, code: np.ndarray) -> bytes:
        """Symbols without a piece (single characters) as byte pieces, or unknown where the model has none."""
        out: list[int] = []
        for c, i in zip(code[at].tolist(), ids.tolist(), strict=True):
            if i >= 0:
                out.append(i)
            elif self.bytes:
                out += [self.bytes[b] for b in chr(c).encode("utf-8", "surrogatepass")]
            else:
                out.append(self.unk)
        return np.array(out, "<i4").tobytes()

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text."""
        cut = [CHUNK.findall(META + t.replace(" ", META)) if t else [] for t in texts]
        seen = self.seen
        group, size, fresh = [], 0, {}
        for c in set().union(*cut).difference(seen):
            group.append(c)
            size += len(c)
            if size > GROUP_CHARS:
                self.encode_chunks(group, fresh)
                group, size = [], 0
        if group:
            self.encode_chunks(group, fresh)
        full = len(seen) >= CACHE
        seen.update(fresh)
        ids = [np.frombuffer(b"".join(map(seen.__getitem__, cs)), "<i4") for cs in cut]
        if full:  # these go again
            for c in fresh:
                del seen[c]
        return ids

    def decode(self, ids: list[int] | np.ndarray) -> str:
        """Pieces joined, byte pieces read as UTF-8, the meta symbol a blank, less the blank put at the start."""
        ids = ids.tolist() if isinstance(ids, np.ndarray) else ids
        try:
            return "".join(map(self.plain.__getitem__, ids)).replace(META, " ")[1:]
        except TypeError:
            pass  # a byte piece or control sign among them
        text, raw = [], bytearray()
        get, byte_of = self.text.get, self.byte_of
        for i in ids:
            p = get(i)
            if p is None:
                if i in byte_of:
                    raw.append(byte_of[i])
                continue
            if raw:
                text.append(raw.decode("utf-8", "replace"))
                raw.clear()
            text.append(p)
        if raw:
            text.append(raw.decode("utf-8", "replace"))
        return "".join(text).replace(META, " ")[1:]


_LOADED: dict[str, Pieces] = {}


def loaded(path: str) -> Pieces:
    if path not in _LOADED:
        _LOADED[path] = Pieces(path)
    return _LOADED[path]


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and ``ids`` (array of piece ids) of every row."""

    def make():
        pieces = loaded(path)
        return lambda texts: {"ids": pieces.encode(texts)}

    return map_texts(df, text_col, [id_col], [T.StructField("ids", T.ArrayType(T.IntegerType()))], make)


def decode(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id and ``text`` of every row; null ids give an empty text, ids that stand for no text are skipped."""

    def make():
        pieces = loaded(path)
        return lambda rows: {"text": [pieces.decode([] if r is None else r) for r in rows]}

    return map_texts(df, ids_col, [id_col], [T.StructField("text", T.StringType())], make)


def encode_digest(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """id, n_bytes, n_pieces, ids_sha256 (of the ids as little-endian 32-bit integers) and round_trip (decoding gives the text back); the ids too if asked for."""
    fields = [T.StructField("n_bytes", T.LongType()), T.StructField("n_pieces", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("round_trip", T.BooleanType())]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))

    def make():
        pieces = loaded(path)

        def run(texts):
            ids = pieces.encode(texts)
            return {
                "n_bytes": [len(t.encode("utf-8", "surrogatepass")) if t else 0 for t in texts],
                "n_pieces": [len(x) for x in ids],
                "ids_sha256": [hashlib.sha256(x.tobytes()).hexdigest() for x in ids],
                "round_trip": [pieces.decode(x) == (t or "").replace(META, " ") for x, t in zip(ids, texts, strict=True)],
                "ids": ids,
            }

        return run

    return map_texts(df, text_col, [id_col], fields, make)

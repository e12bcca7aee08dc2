"""Token ids of whole texts by the tokenizers library, encoding each distinct piece of a slice once.

Texts are cut where the tokenizer's own splitting always cuts: a "words" tokenizer drops white space,
so words are pieces; a "bytes" tokenizer attaches the last white space of a run to what follows, so
a piece starts there. Texts with white space beyond ASCII are encoded whole.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import bytehash as H

ODD_SPACE = r"[\x1c-\x1f\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200f}\x{2028}\x{2029}\x{202f}\x{205f}\x{2060}\x{3000}\x{feff}]"
#: Pieces that an encoder remembers, some 80 bytes each; beyond that it starts anew.
CACHE = 1_200_000
_encoders: dict[tuple[str, bool], Encoder] = {}


def tokenizer_path(name: str) -> str:
    """A full path stays; a bare name is looked up among the installed public tokenizer files."""
    if os.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def encoder(name: str, spaced: bool) -> Encoder:
    """The process's own encoder for a tokenizer file; spaced: white space belongs to tokens."""
    if (name, spaced) not in _encoders:
        _encoders[name, spaced] = Encoder(tokenizer_path(name), spaced)
    return _encoders[name, spaced]


class Encoder:
    def __init__(self, path: str, spaced: bool) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok, self.spaced = Tokenizer.from_file(path), spaced
        self.tok.encode_special_tokens = True
        self.clear()

    def clear(self) -> None:
        self.keys = [np.zeros(0, H.U), np.zeros(0, H.U)]  # two sorted levels: most, and recent
        self.rows = [np.zeros(0, np.int64), np.zeros(0, np.int64)]
        self.at, self.size, self.pool = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def pieces(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(starts, ends, first piece of each row and the total)."""
        if not self.spaced:
            _, s, e, first = H.words(data, off, H.SPACED)
            return s, e, first
        n = len(data)
        gap = np.ones(n + 1, dtype=bool)
        gap[:n] = (data == 32) | ((data >= 9) & (data <= 13))
        cut = np.zeros(n + 1, dtype=bool)
        cut[off] = True
        nxt = ~gap[1:] & ~cut[1:]  # the next byte is in this row and no space
        s = np.flatnonzero((gap[:n] & nxt) | cut[:n]) if n else np.zeros(0, np.int64)
        return s, np.append(s[1:], n) if n else s, np.searchsorted(s, off)

    def fresh(self, data: np.ndarray, s: np.ndarray, e: np.ndarray) -> list[np.ndarray]:
        """Ids of pieces not seen before: simple ones joined in one text, the others one by one."""
        raw = data.tobytes()
        texts = [raw[a:b].decode() for a, b in zip(s.tolist(), e.tolist(), strict=True)]
        out: list = [None] * len(texts)
        alone = [i for i, t in enumerate(texts) if self.spaced and (t[0] not in " \t\n\v\f\r" or t[-1] in " \t\n\v\f\r")]
        for i, ids in zip(alone, self.whole([texts[i] for i in alone]), strict=True):
            out[i] = np.array(ids, np.uint32)
        left = [i for i, x in enumerate(out) if x is None]
        step = 4096
        for k in range(0, len(left), step):
            part = left[k : k + step]
            sep = "" if self.spaced else " "
            text = sep.join(texts[i] for i in part)
            enc = self.tok.encode(text, add_special_tokens=False)
            ids = np.array(enc.ids, np.uint32)
            at = np.array([o[1] for o in enc.offsets], np.int64)  # ends: a token may start on the space before it
            ends = np.cumsum([len(texts[i]) + len(sep) for i in part])
            owner = np.searchsorted(ends - len(sep), at, "left")
            bound = np.searchsorted(owner, np.arange(len(part) + 1))
            for j, i in enumerate(part):
                out[i] = ids[bound[j] : bound[j + 1]]
        return out

    def look(self, u: np.ndarray) -> np.ndarray:
        """Row of each hash, -1 where unknown."""
        row = np.full(len(u), -1, np.int64)
        for keys, rows in zip(self.keys, self.rows, strict=True):
            if len(keys):
                p = np.minimum(np.searchsorted(keys, u), len(keys) - 1)
                hit = keys[p] == u
                row[hit] = rows[p[hit]]
        return row

    def learn(self, u: np.ndarray, ids: list[np.ndarray]) -> None:
        size = np.array([len(x) for x in ids], np.int64)
        rows = np.arange(len(self.at), len(self.at) + len(u))
        self.at = np.append(self.at, len(self.pool) + np.cumsum(size) - size)
        self.size = np.append(self.size, size)
        self.pool = np.concatenate([self.pool, *ids])
        level = 1
        keys, rows = np.append(self.keys[1], u), np.append(self.rows[1], rows)
        if len(keys) > 50_000 + len(self.keys[0]) // 4:
            keys, rows, level = np.append(self.keys[0], keys), np.append(self.rows[0], rows), 0
            self.keys[1], self.rows[1] = np.zeros(0, H.U), np.zeros(0, np.int64)
        o = np.argsort(keys, kind="stable")
        self.keys[level], self.rows[level] = keys[o], rows[o]

    def encode(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(uint32 ids of all rows, int64 offsets by row); null counts as empty."""
        col = col.cast(pa.string()).fill_null("")
        odd = np.flatnonzero(pc.match_substring_regex(col, ODD_SPACE).to_numpy(zero_copy_only=False))
        if len(odd):
            keep = np.ones(len(col), dtype=bool)
            keep[odd] = False
            ids, off = self.plain(pc.if_else(pa.array(keep), col, ""))
            parts = [ids[off[i] : off[i + 1]] for i in range(len(col))]
            for i, x in zip(odd.tolist(), self.whole(col.take(pa.array(odd)).to_pylist()), strict=True):
                parts[i] = np.array(x, np.uint32)
            return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])
        return self.plain(col)

    def plain(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, off = H.text_bytes(col)
        s, e, first = self.pieces(data, off)
        if not len(s):
            return np.zeros(0, np.uint32), np.zeros(len(off), np.int64)
        if len(self.at) > CACHE:
            self.clear()
        u, idx, inv = np.unique(H.span(H.prefix(data), s, e), return_index=True, return_inverse=True)
        row = self.look(u)
        new = np.flatnonzero(row < 0)
        if len(new):
            base = len(self.at)
            self.learn(u[new], self.fresh(data, s[idx[new]], e[idx[new]]))
            row[new] = np.arange(base, base + len(new))
        row = row[inv]
        size = self.size[row]
        end = np.concatenate([[0], np.cumsum(size)])
        ids = self.pool[np.repeat(self.at[row] - end[:-1], size) + np.arange(end[-1])]
        return ids, end[first]


def with_end(ids: np.ndarray, off: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same rows, each with one more id at its end."""
    return np.insert(ids, off[1:], np.uint32(end_id)), off + np.arange(len(off))

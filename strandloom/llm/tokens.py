"""Exact tokens of a word-level BPE with word ends, without the library's cost for each word.

The tokenizer splits a folded text into pieces (letters, one digit, symbols, contractions) and merges each piece by itself.
Here a slice of texts is cut into pieces by arrays over its bytes, and the pieces are looked up in a bounded memo of arrays.
Vocabulary strings proven, with the library itself, to encode alone as one token stand in the memo from the start and are
counted at once; only pieces that no one has met are merged, by the library's own model. Texts outside Latin-1, or with
anything unusual in them, are cut at ASCII white space (which no piece spans) and go to the library chunk by chunk.
"""

from __future__ import annotations

import functools
import json
import re

import numpy as np
from tokenizers import Tokenizer

#: Letters that folding and normalisation leave as they are, and the contractions of the tokenizer's pattern.
_LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(chr(c) for c in range(0xDF, 0x100) if c != 0xF7)
_SHORT, _LONG = "stmd", ("re", "ve", "ll")
#: Pieces of a word that the memo knows before it starts anew; a full memo takes about 130 MB.
MEMO = 1_200_000
_LONGEST = 32
_BITS = 21
_ASCII_SPACE = re.compile("[ \t\n\r\f\v]+")


def _byte_letters() -> dict[int, str]:
    """The printable letter that byte-level tokenizers give each byte: itself if printable in Latin-1, else the next from U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return {b: chr(b if b in plain else next(rest)) for b in range(256)}


def _classes() -> np.ndarray:
    """Of each Latin-1 byte of a folded text: 0 space, 1 letter, 2 digit, 3 symbol, 9 not for the short path."""
    out = np.full(256, 9, np.uint8)
    out[0x21:0x7F] = 3
    out[[ord(c) for c in _LETTERS]] = 1
    out[0x30:0x3A] = 2
    out[[0x20, *range(9, 14)]] = 0
    return out


@functools.lru_cache(maxsize=4)
def library(path: str) -> Tokenizer:
    """The tokenizer of a file, without truncation and padding."""
    out = Tokenizer.from_file(path)
    out.no_truncation()
    out.no_padding()
    return out


@functools.lru_cache(maxsize=4)
def proven_whole(path: str) -> dict[str, int]:
    """Offline proof: the vocabulary strings that the library encodes, alone, as exactly their own one token.

    Only single pieces of the short path count, as only those are looked up.
    """
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    end, back, kinds = model.get("end_of_word_suffix") or "", {c: b for b, c in _byte_letters().items()}, _classes()
    strings, ids = [], []
    for token, k in model["vocab"].items():
        if token.endswith(end) and all(c in back for c in token[: len(token) - len(end)]):
            try:
                s = bytes(back[c] for c in token[: len(token) - len(end)]).decode()
                kind = {*kinds[np.frombuffer(s.encode("latin-1"), np.uint8)].tolist()}
            except UnicodeError:
                continue
            if len(s) <= _LONGEST and (kind in ({1}, {3}) or kind == {2} and len(s) == 1):
                strings.append(s)
                ids.append(k)
    found = library(path).encode_batch(strings, add_special_tokens=False)
    return {s: k for s, k, e in zip(strings, ids, found, strict=True) if e.ids == [k]}


class Pieces:
    """The memo: pieces of up to 32 Latin-1 bytes, held as four 64-bit words, to the place of their ids in a pool."""

    def __init__(self, path: str, whole: dict[str, int]):
        self.tok = library(path)
        self.merge, self.letters, self.kinds = self.tok.model.tokenize, _byte_letters(), _classes()
        self.masks = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
        self.whole = [s.encode("latin-1") for s in whole], [[k] for k in whole.values()]
        self.clear()

    def clear(self) -> None:
        self.slots = np.full(1 << _BITS, -1, np.int32)
        self.n = self.used = 0
        self.keys = np.zeros((4, 1 << 17), np.uint64)
        self.counts, self.places = np.zeros(1 << 17, np.int32), np.zeros(1 << 17, np.int64)
        self.pool = np.zeros(1 << 18, np.uint32)
        words, ids = self.whole
        buffer = b"".join(words)
        sizes = np.array([len(w) for w in words], np.int64)
        self.add(self.load(buffer + bytes(_LONGEST), np.cumsum(sizes) - sizes, sizes), ids)

    def load(self, buffer: bytes, at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The four words of each piece."""
        words = np.ndarray((len(buffer) - 7,), "<u8", buffer, strides=(1,))
        out = np.zeros((4, len(at)), np.uint64)
        out[0] = words[at] & self.masks[np.minimum(sizes, 8)]
        for k in (1, 2, 3):
            more = np.flatnonzero(sizes > 8 * k)
            out[k, more] = words[at[more] + 8 * k] & self.masks[np.minimum(sizes[more] - 8 * k, 8)]
        return out

    def home(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys[0] * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        for k, odd in ((1, 0xBF58476D1CE4E5B9), (2, 0x94D049BB133111EB), (3, 0xD6E8FEB86659FD93)):
            mixed = (mixed + keys[k]) * np.uint64(odd)
            mixed ^= mixed >> np.uint64(31)
        return (mixed >> np.uint64(64 - _BITS)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The entry of each piece, or -1."""
        slot = self.home(keys)
        out = self.slots[slot]
        left = np.flatnonzero(out >= 0)
        wrong = left[(self.keys[:, out[left]] != keys[:, left]).any(0)]
        while len(wrong):
            slot[wrong] = (slot[wrong] + 1) & ((1 << _BITS) - 1)
            found = out[wrong] = self.slots[slot[wrong]]
            wrong = wrong[found >= 0]
            if len(wrong):
                wrong = wrong[(self.keys[:, out[wrong]] != keys[:, wrong]).any(0)]
        return out

    def add(self, keys: np.ndarray, ids: list[list[int]]) -> None:
        """Adds pieces that are all different and all unknown."""
        m, sizes = len(ids), np.array([len(x) for x in ids], np.int32)
        flat = np.array([i for x in ids for i in x], np.uint32)
        while self.n + m > len(self.counts):
            self.keys = np.concatenate([self.keys, np.zeros_like(self.keys)], 1)
            self.counts, self.places = (np.concatenate([x, np.zeros_like(x)]) for x in (self.counts, self.places))
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        new = slice(self.n, self.n + m)
        self.keys[:, new], self.counts[new], self.places[new] = keys, sizes, self.used + np.cumsum(sizes) - sizes
        self.pool[self.used : self.used + len(flat)] = flat
        entry, slot = np.arange(self.n, self.n + m, dtype=np.int32), self.home(keys)
        while len(entry):  # each free slot takes the first that wants it; the others go on to the next
            free = np.flatnonzero(self.slots[slot] < 0)
            _, first = np.unique(slot[free], return_index=True)
            put = free[first]
            self.slots[slot[put]] = entry[put]
            rest = np.ones(len(entry), bool)
            rest[put] = False
            entry, slot = entry[rest], (slot[rest] + 1) & ((1 << _BITS) - 1)
        self.n, self.used = self.n + m, self.used + len(flat)

    def merged(self, piece: bytes) -> list[int]:
        if piece.isascii():  # printable ASCII stands for itself
            return [t.id for t in self.merge(piece.decode())]
        return [t.id for t in self.merge("".join(map(self.letters.__getitem__, piece.decode("latin-1").encode())))]

    def entries(self, buffer: bytes) -> tuple[np.ndarray, np.ndarray]:
        """The starts of the pieces of a folded Latin-1 buffer, in order, and their entries (below -1: the number -2-k of an id of extra)."""
        raw = np.frombuffer(buffer, np.uint8)
        kind = self.kinds[raw]
        edge = np.empty(len(raw), bool)
        edge[0] = True
        np.not_equal(kind[1:], kind[:-1], out=edge[1:])
        edge |= kind == 2
        if 0x27 in buffer:
            mark = np.flatnonzero((raw[:-4] == 0x27) & edge[:-4])
            one, two = raw[mark + 1], raw[mark + 2]
            short = mark[np.isin(one, np.frombuffer(_SHORT.encode(), np.uint8))]
            long = mark[np.logical_or.reduce([(one == ord(a)) & (two == ord(b)) for a, b in _LONG])]
            for found, n in ((short, 2), (long, 3)):
                edge[found + 1] = False
                edge[found + n] = True
        bounds = np.flatnonzero(edge)
        sizes = np.diff(bounds, append=len(raw))
        piece = kind[bounds] > 0
        at, sizes = bounds[piece], sizes[piece]
        keys = self.load(buffer + bytes(_LONGEST + 8), at, np.minimum(sizes, _LONGEST))
        out = self.find(keys)
        out[sizes > _LONGEST] = -1
        missing = np.flatnonzero(out < 0)
        self.extra: list[list[int]] = []
        if len(missing):
            long = missing[sizes[missing] > _LONGEST]
            for i in long.tolist():
                self.extra.append(self.merged(buffer[at[i] : at[i] + sizes[i]]))
                out[i] = -1 - len(self.extra)
            missing = missing[sizes[missing] <= _LONGEST]
            texts = [buffer[a : a + n] for a, n in zip(at[missing].tolist(), sizes[missing].tolist(), strict=True)]
            number: dict[bytes, int] = {}
            where = np.fromiter((number.setdefault(t, len(number)) for t in texts), np.int64, len(texts))
            first = np.full(len(number), -1, np.int64)
            first[where[::-1]] = missing[::-1]
            base = self.n
            self.add(keys[:, first], [self.merged(t) for t in number])
            out[missing] = base + where
        return at, out

    def of(self, texts: list[str | None], counts: bool) -> list:
        """For each whole text, null as empty: the number of its tokens, or its ids as an array."""
        if self.n > MEMO + len(self.whole[0]):
            self.clear()
        folded: list[bytes] = []
        rows: list[int] = []
        out: list = [None] * len(texts)
        for i, text in enumerate(texts):
            try:
                if "<|" not in (text := text or ""):
                    raw = text.lower().encode("latin-1")
                    if not (self.kinds[np.frombuffer(raw, np.uint8)] == 9).any():
                        folded.append(raw)
                        rows.append(i)
                        continue
            except UnicodeEncodeError:
                pass
            ids = [k for chunk in _ASCII_SPACE.split(text) if chunk for k in self.tok.encode(chunk, add_special_tokens=False).ids]
            out[i] = len(ids) if counts else np.array(ids, np.uint32)
        if not folded:
            return out
        buffer = b" ".join(folded) + b"     "
        ends = np.cumsum([len(x) + 1 for x in folded])
        at, entry = self.entries(buffer)
        known = entry >= 0
        sizes = np.where(known, self.counts[entry], 0)
        for i in np.flatnonzero(~known).tolist():
            sizes[i] = len(self.extra[-2 - entry[i]])
        upto = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        cut = upto[np.searchsorted(at, ends)]
        if counts:
            for i, n in zip(rows, np.diff(cut, prepend=0).tolist(), strict=True):
                out[i] = n
            return out
        place = np.where(known, self.places[entry], 0) - upto[:-1]
        ids = self.pool[np.repeat(place, sizes) + np.arange(upto[-1])]
        for i in np.flatnonzero(~known).tolist():
            ids[upto[i] : upto[i + 1]] = self.extra[-2 - entry[i]]
        for i, a, b in zip(rows, [0, *cut[:-1].tolist()], cut.tolist(), strict=True):
            out[i] = ids[a:b]
        return out


_MEMOS: dict[str, Pieces] = {}


def memo(path: str, whole: dict[str, int]) -> Pieces:
    """The worker's memo for a tokenizer: it outlives tasks."""
    if path not in _MEMOS:
        _MEMOS[path] = Pieces(path, whole)
    return _MEMOS[path]

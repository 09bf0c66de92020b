"""Byte-level BPE with the tokenizers library, by pieces of text that encode alone.

The split pattern of byte-level BPE never lets a word run on over these places, and looks ahead only for
white space, so a text cut there encodes piece by piece:

- before a space that a graphic character follows,
- before "." or "," after an ASCII letter,
- before a line end after a graphic ASCII character, and after a single line end between two of them.

Pieces are hashed in blocks of texts with numpy (64 bits); the library sees each distinct piece once and
a table keeps its bytes and ids, up to a number of pieces and bytes, then starts anew. Every lookup
compares the bytes; a piece whose hash belongs to another one goes to the library by itself. A text that
holds an added token's string goes to the library whole. Files with a normalizer or another
pre-tokenizer are refused.
"""

from __future__ import annotations

import json
import os

import numpy as np

from isoreach.llm.blocks import mix, powers_at

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
TABLE_PIECES = 1 << 20
TABLE_BYTES = 64 << 20
HASH_BYTES = 1 << 20
_GRAPHIC = np.array([33 <= b <= 126 for b in range(256)])
#: Graphic ASCII, or the first byte of a two-byte letter; U+0080 to U+00BF (C2) holds white space.
_STARTS_WORD = np.array([33 <= b <= 126 or 0xC3 <= b <= 0xDF for b in range(256)])
_LETTER = np.array([65 <= b <= 90 or 97 <= b <= 122 for b in range(256)])


def piece_starts(buf: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
    """Where pieces begin in texts that lie end to end; ``text_starts`` are the starts of non-empty texts."""
    n = len(buf)
    cut = np.zeros(n, bool)
    if n > 2:
        here, prev, nxt = buf[1:-1], buf[:-2], buf[2:]
        seen = _GRAPHIC[prev]
        cut[1:-1] = (here == 32) & _STARTS_WORD[nxt] | ((here == 46) | (here == 44)) & _LETTER[prev] | (here == 10) & seen
        single = (here == 10) & seen & _GRAPHIC[nxt]
        cut[2:] |= single
        edge = text_starts[text_starts > 0]
        cut[edge - 1] = False  # what follows there belongs to the next text
        after = edge[edge + 1 < n] + 1
        bad = after[(buf[after - 1] == 10)]  # a text's first line end has nothing before it
        cut[bad] &= (buf[bad] == 32) & _STARTS_WORD[buf[np.minimum(bad + 1, n - 1)]]
    cut[text_starts] = True
    return np.flatnonzero(cut)


def piece_hashes(buf: np.ndarray, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each piece, never 0. Pieces lie end to end and cover the buffer."""
    h = size.astype(np.uint64) << np.uint64(40)
    with np.errstate(over="ignore"):
        for lo in range(0, len(buf), HASH_BYTES):  # a few bytes of memory for each byte, so some bytes at a time
            hi = min(len(buf), lo + HASH_BYTES)
            a, b = int(np.searchsorted(starts, lo, side="right")) - 1, int(np.searchsorted(starts, hi))
            edge = np.append(np.maximum(starts[a:b], lo), hi)
            pos = np.arange(hi - lo, dtype=np.int32) - np.repeat((starts[a:b] - lo).astype(np.int32), np.diff(edge))
            h[a:b] += np.add.reduceat((buf[lo:hi] + np.uint64(1)) * powers_at(pos), edge[:-1] - lo)
    h = mix(h)
    h[h == 0] = 1
    return h


def same_bytes(buf: np.ndarray, at: np.ndarray, other: np.ndarray, other_at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether buf[at : at + size] equals other[other_at : other_at + size], for each of some non-empty pieces."""
    out = np.ones(len(size), bool)
    ends = np.cumsum(size)
    k = 0
    while k < len(size):
        to = max(k + 1, int(np.searchsorted(ends, ends[k] - size[k] + HASH_BYTES, side="right")))
        differ = buf[ragged(at[k:to], size[k:to])] != other[ragged(other_at[k:to], size[k:to])]
        if differ.any():
            out[k:to] = ~np.logical_or.reduceat(differ, ends[k:to] - size[k:to] - (ends[k] - size[k]))
        k = to
    return out


class Codec:
    """One tokenizer file."""

    _held: dict[str, Codec] = {}

    @classmethod
    def of(cls, path: str) -> Codec:
        if path not in cls._held:
            cls._held[path] = cls(path)
        return cls._held[path]

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        if spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
            raise ValueError(f"{path}: only byte-level BPE without normalizer and prefix space is taken")
        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        self.added = [x["content"].encode() for x in spec["added_tokens"]]
        self.size = max(self.library.get_vocab(with_added_tokens=True).values()) + 1
        self.dtype = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        names = [self.library.id_to_token(i) or "" for i in range(self.size)]
        self.spaced = np.array([p.startswith("Ġ") for p in names])
        self.pieces = [p.encode() if p.encode() in self.added else _piece_bytes(p) for p in names]
        #: The same merges for words that need no splitting: letters of ASCII, with or without the space before.
        self.words = Tokenizer(self.library.model)
        self.words.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.table = None
        self._empty()

    def _empty(self, least: int = 0) -> None:
        """A new table with room for ``least`` pieces; slots are a power of two and at most half of them are ever used."""
        self.slots = 1 << (4 * max(TABLE_PIECES, least) - 1).bit_length()
        self.key = np.zeros(self.slots, np.uint64)  # 0: free
        self.entry = np.zeros(self.slots, np.int32)
        self.piece_len, self.piece_at = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self.bytes, self.held = np.zeros(1 << 14, np.uint8), 0
        self.at = np.zeros(1 << 12, np.int64)
        self.n = np.zeros(1 << 12, np.int32)
        self.flat = np.zeros(1 << 14, self.dtype)
        self.entries = self.filled = 0

    def piece_table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each id, where its bytes begin, how many they are; and the bytes end to end."""
        if self.table is None:
            n = np.fromiter(map(len, self.pieces), np.int64, self.size)
            self.table = np.cumsum(n) - n, n, np.frombuffer(b"".join(self.pieces), np.uint8)
        return self.table

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.dtype) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def distinct(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(order, ids end to end, their number): the ids of pieces[order[0]], pieces[order[1]] and so on.

        The library gets each piece once. Spaced words of Latin letters go to it in one text, already in
        byte stand-ins, since no split can fall within them.
        """
        plain, rest = [], []
        for i, p in enumerate(pieces):
            (plain if p[:1] == b" " and (p[1:].isalpha() or _latin_word(p[1:])) else rest).append(i)
        ids, n = np.zeros(0, self.dtype), np.zeros(0, np.int64)
        if plain:
            text = b"".join([pieces[i] for i in plain]).decode("latin-1").translate(_STAND_INS)
            ids = np.array(self.words.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype)
            at = np.flatnonzero(self.spaced[ids])
            n = np.diff(at, append=len(ids))
            if len(at) != len(plain):
                ids, n, plain, rest = ids[:0], n[:0], [], list(range(len(pieces)))
        if rest:
            more = self.whole([pieces[i].decode("utf-8", "replace") for i in rest])
            ids, n = np.concatenate([ids, *more]), np.concatenate([n, np.fromiter(map(len, more), np.int64, len(more))])
        return np.array(plain + rest, np.int64), ids, n

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Table entries by hash; -1: none."""
        found = np.full(len(h), -1, np.int32)
        todo = np.arange(len(h))
        slot = (h & np.uint64(self.slots - 1)).astype(np.int64)
        while len(todo):
            key = self.key[slot]
            hit = key == h[todo]
            found[todo[hit]] = self.entry[slot[hit]]
            on = ~hit & (key != 0)
            todo, slot = todo[on], (slot[on] + 1) & (self.slots - 1)
        return found

    def _add(self, h: np.ndarray, pieces: list[bytes], ids: np.ndarray, n: np.ndarray) -> None:
        new, more = len(h), np.frombuffer(b"".join(pieces), np.uint8)
        self.piece_len, self.piece_at, self.at, self.n = (_room(a, self.entries + new) for a in (self.piece_len, self.piece_at, self.at, self.n))
        self.flat = _room(self.flat, self.filled + int(n.sum()))
        self.bytes = _room(self.bytes, self.held + len(more))
        own = slice(self.entries, self.entries + new)
        size = np.fromiter(map(len, pieces), np.int64, new)
        self.piece_len[own], self.n[own] = size, n
        self.piece_at[own] = self.held + np.cumsum(size) - size
        self.bytes[self.held : self.held + len(more)] = more
        self.at[own] = self.filled + np.cumsum(n) - n
        self.flat[self.filled : self.filled + len(ids)] = ids
        entry = np.arange(self.entries, self.entries + new, dtype=np.int32)
        todo, slot = np.arange(new), (h & np.uint64(self.slots - 1)).astype(np.int64)
        while len(todo):
            free = self.key[slot] == 0
            self.key[slot[free]] = h[todo[free]]  # of several for one slot the last stays
            won = free & (self.key[slot] == h[todo])
            self.entry[slot[won]] = entry[todo[won]]
            todo, slot = todo[~won], (slot[~won] + 1) & (self.slots - 1)
        self.entries += new
        self.filled += int(n.sum())
        self.held += len(more)

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts end to end, their number by text), for UTF-8 texts."""
        special = [i for i, t in enumerate(texts) if any(a in t for a in self.added)]
        if special:
            held = set(special)
            ids, n = self.encode([b"" if i in held else t for i, t in enumerate(texts)])
            parts = np.split(ids, np.cumsum(n)[:-1])
            for i, x in zip(special, self.whole([texts[i].decode("utf-8", "replace") for i in special])):
                parts[i], n[i] = x, len(x)
            return np.concatenate(parts), n
        raw = b"".join(texts)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        if not raw:
            return np.zeros(0, self.dtype), np.zeros(len(texts), np.int64)
        buf = np.frombuffer(raw, np.uint8)
        begin = np.cumsum(sizes) - sizes
        starts = piece_starts(buf, begin[sizes > 0])
        size = np.diff(starts, append=len(buf))
        h = piece_hashes(buf, starts, size)
        if self.entries > TABLE_PIECES or self.held > TABLE_BYTES or self.entries + len(starts) > self.slots // 2:
            self._empty(len(starts))
        e = self._find(h)
        miss = np.flatnonzero(e < 0)
        if len(miss):
            u, first = np.unique(h[miss], return_index=True)
            at = miss[first]
            pieces = [raw[a : a + b] for a, b in zip(starts[at].tolist(), size[at].tolist())]
            order, got, k = self.distinct(pieces)
            self._add(u[order], [pieces[i] for i in order.tolist()], got, k)
            e[miss] = self._find(h[miss])
        same = self.piece_len[e] == size
        same[same] = same_bytes(buf, starts[same], self.bytes, self.piece_at[e[same]], size[same])
        n = self.n[e].astype(np.int64)
        clash = np.flatnonzero(~same)  # another piece has the hash
        if len(clash):
            words = [raw[starts[i] : starts[i] + size[i]] for i in clash.tolist()]
            known = dict(zip(d := sorted(set(words)), self.whole([w.decode("utf-8", "replace") for w in d])))
            odd = {i: known[w] for i, w in zip(clash.tolist(), words)}
            ids = np.concatenate([odd[i] if i in odd else self.flat[self.at[k] : self.at[k] + self.n[k]] for i, k in enumerate(e.tolist())])
            n[clash] = [len(odd[i]) for i in clash.tolist()]
        else:
            ids = self.flat[ragged(self.at[e], n)]
        total = np.concatenate([[0], np.cumsum(n)])
        bound = np.searchsorted(starts, np.append(begin, len(buf)))
        return ids, np.diff(total[bound])


def ragged(at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The indexes at[0] .. at[0]+n[0]-1, at[1] .. and so on."""
    if not len(n):
        return np.zeros(0, np.int64)
    ends = np.cumsum(n)
    kind = np.int32 if max(int(ends[-1]), int(at.max())) < 2**31 - 1 else np.int64
    return np.arange(int(ends[-1]), dtype=kind) + np.repeat((at - (ends - n)).astype(kind), n)


def gather(flat: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """flat[ragged(at, n)] with indexes for about HASH_BYTES elements at a time."""
    ends = np.cumsum(n)
    out = np.empty(int(ends[-1]) if len(n) else 0, flat.dtype)
    k = 0
    while k < len(n):
        base = int(ends[k] - n[k])
        to = max(k + 1, int(np.searchsorted(ends, base + HASH_BYTES, side="right")))
        out[base : int(ends[to - 1])] = flat[ragged(at[k:to], n[k:to])]
        k = to
    return out


def _room(a: np.ndarray, n: int) -> np.ndarray:
    return a if n <= len(a) else np.concatenate([a, np.zeros(max(n - len(a), len(a)), a.dtype)])


def _byte_of() -> dict[str, int]:
    """The printable stand-ins of byte-level BPE: printable Latin-1 stands for itself, other bytes for code points from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = sorted(set(range(256)).difference(shown))
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


_BYTE_OF = _byte_of()
_STAND_INS = {b: c for c, b in _BYTE_OF.items()} | {32: " Ġ"}


def _piece_bytes(piece: str) -> bytes:
    return bytes(map(_BYTE_OF.__getitem__, piece))


def _latin_word(word: bytes) -> bool:
    """Letters below U+0250 only, on whose class all Unicode versions agree."""
    text = word.decode("utf-8", "replace")
    return text.isalpha() and max(text) < "\u0250"

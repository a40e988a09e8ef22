"""Word sets of texts, for exact set similarity: hashed sequences of three words, a bitmap and locality keys.

- toks: the distinct sequences of three consecutive words, 32 bits each, sorted. Similarity is computed on them.
- bits: 1,024 bits in which the tokens of a set are marked. Tokens whose bit a union of sets lacks are surely not in it,
  which bounds the overlap from above (a row of a token-group matrix).
- keys: min-hash keys over sequences of four words; similar sets share some of them.
"""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash

WORDS = 3
#: Locality keys: BANDS of ROWS minima each. How many pairs share one at each similarity is in the README.
BANDS, ROWS = 48, 3
LONGS = 16
#: Words that are made into sets at a time.
AT_ONCE = 1 << 18
NAMES = ("n", "words", "set_hash", "toks", *(f"b{i}" for i in range(LONGS)), "keys")
DDL = "n int, words int, set_hash bigint, toks array<int>, " + ", ".join(f"b{i} bigint" for i in range(LONGS)) + ", keys array<bigint>"

_WORD = re.compile(r"[^\W_]+")
#: ASCII letters in lower case and digits; a blank for any other ASCII sign.
_PLAIN = {i: chr(i).lower() if chr(i).isalnum() else " " for i in range(128)}
_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xD6E8FEB86659FD93)
_S32, _S29 = np.uint64(32), np.uint64(29)


def words_of(text: str) -> list[str]:
    """Runs of letters and digits in lower case."""
    return text.translate(_PLAIN).split() if text.isascii() else _WORD.findall(text.lower())


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _S32)) * _Q
    x = (x ^ (x >> _S29)) * _P
    return x ^ (x >> _S32)


class _Words(dict):
    """Hash of a word, remembered up to a bound."""

    def __missing__(self, w: str) -> int:
        if len(self) > 500_000:
            self.clear()
        self[w] = h = xxhash.xxh64_intdigest(w.encode())
        return h


class Maker:
    def __init__(self, bands: int = BANDS, rows: int = ROWS) -> None:
        seeds = np.random.default_rng(20240917)
        self.bands, self.rows = bands, rows
        self.a = seeds.integers(1, 2**62, size=bands * rows, dtype=np.uint64) | np.uint64(1)
        self.salt = _mix(np.arange(1, bands + 1, dtype=np.uint64) * _P)
        self.words = _Words()

    def grams(self, text: str) -> tuple[np.ndarray, np.ndarray, int]:
        """Distinct hashes of the sequences of three words, hashes of those of four, and the number of words."""
        w = words_of(text)
        if len(w) < WORDS:
            none = np.zeros(0, dtype=np.uint64)
            return none, none, len(w)
        h = np.fromiter(map(self.words.__getitem__, w), dtype=np.uint64, count=len(w))
        two = _mix(h[:-1] * _P + h[1:])
        three = _mix(two[:-1] * _P + h[2:])
        four = _mix(three[:-1] * _P + h[3:]) if len(w) > WORDS else three
        return np.unique(three >> _S32), four, len(w)

    def keys(self, four: np.ndarray) -> np.ndarray:
        return self._mixed(self._low(four)[None, :])[0].view(np.int64)

    def _low(self, four: np.ndarray) -> np.ndarray:
        """The least product of each multiplier."""
        low = (self.a[:, None] * four[None, :4096]).min(axis=1)
        for i in range(4096, len(four), 4096):
            np.minimum(low, (self.a[:, None] * four[None, i : i + 4096]).min(axis=1), out=low)
        return low

    def _mixed(self, low: np.ndarray) -> np.ndarray:
        """Keys of rows of least products."""
        low = (low >> _S32).reshape(len(low), self.bands, self.rows)
        k = np.broadcast_to(self.salt, low.shape[:2])
        for r in range(self.rows):
            k = _mix(k * _P + low[:, :, r])
        return k

    def _sets(self, words: list[list[str]]) -> tuple[np.ndarray, ...]:
        """n, set hashes, tokens, bits and keys of texts, given as words: grams() and keys() of many texts at a time."""
        count = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        h = np.fromiter(map(self.words.__getitem__, chain.from_iterable(words)), dtype=np.uint64, count=int(count.sum()))
        doc = np.repeat(np.arange(len(words)), count)
        two = _mix(h[:-1] * _P + h[1:])
        three = _mix(two[:-1] * _P + h[2:])
        four = _mix(three[:-1] * _P + h[3:])
        own = doc[2:] == doc[:-2]  # sequences that lie within a text
        tok = np.unique((doc[2:][own].astype(np.uint64) << _S32) | (three[own] >> _S32))
        of = (tok >> _S32).astype(np.int64)
        n = np.bincount(of, minlength=len(words))
        toks = tok.astype(np.uint32)
        bits = np.zeros((len(words), LONGS * 64), dtype=np.uint8)
        bits[of, toks & np.uint32(LONGS * 64 - 1)] = 1
        ends, start = np.cumsum(n), np.cumsum(count) - count
        some = np.flatnonzero(n)
        hashes = np.zeros(len(words), dtype=np.int64)
        low = np.empty((len(some), len(self.a)), dtype=np.uint64)
        for k, i in enumerate(some.tolist()):
            hashes[i] = xxhash.xxh64_intdigest(toks[ends[i] - n[i] : ends[i]].tobytes()) - (1 << 63)
            at, many = int(start[i]), int(count[i])
            low[k] = self._low(four[at : at + many - WORDS] if many > WORDS else three[at : at + 1])
        longs = np.packbits(bits, axis=1).view(np.int64).reshape(len(words), LONGS)
        return n, hashes, toks.view(np.int32), longs, self._mixed(low).view(np.int64).reshape(-1)

    def arrays(self, texts: list[str], skip: np.ndarray) -> list[pa.Array]:
        """Columns NAMES; empty sets for texts of fewer than three words and for skipped ones."""
        count, made, held, size = np.zeros(len(texts), dtype=np.int32), [self._sets([])], [], 0
        for i, t in enumerate(texts):
            held.append([] if skip[i] or not t else words_of(t))
            count[i] = len(held[-1])
            size += len(held[-1])
            if size >= AT_ONCE:
                made.append(self._sets(held))
                held, size = [], 0
        made.append(self._sets(held))
        n, hashes, flat, longs, kflat = (np.concatenate(x) for x in zip(*made))
        ends = lambda sizes: pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32))
        return [
            pa.array(n.astype(np.int32)),
            pa.array(count),
            pa.array(hashes),
            pa.ListArray.from_arrays(ends(n), pa.array(flat)),
            *(pa.array(np.ascontiguousarray(longs[:, i])) for i in range(LONGS)),
            pa.ListArray.from_arrays(ends((n > 0) * self.bands), pa.array(kflat)),
        ]

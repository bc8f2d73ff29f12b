"""Word and shingle hashes of whole batches of texts with numpy: no Python work for each word."""

from __future__ import annotations

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_PLAIN = np.zeros(256, bool)
_PLAIN[[*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result depends on every bit of x."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
#: A value for each byte, so that no two bytes differ by a simple number.
_VALUES = mixed(np.arange(1, 257, dtype=np.uint64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[:1] = 1
    if n > 1:
        out[1:] = base
        np.multiply.accumulate(out, out=out)
    return out


class Words:
    """The words of a batch of texts, one after another: starts and ends are byte positions in data, and those of text i
    come before stops[i]. With marks=False, ASCII punctuation separates words as white space does.

    The hash of a run of bytes is a polynomial modulo 2**64, read off prefix sums over the batch.
    """

    def __init__(self, texts: list[str | bytes | None], lower: bool = True, marks: bool = True, table: np.ndarray | None = None):
        raw = [t if isinstance(t, bytes) else (t or "").encode("utf-8", "surrogatepass") for t in texts]
        self.data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
        self.text_ends = np.cumsum(np.fromiter((len(r) + 1 for r in raw), np.int64, len(raw)))
        seen = self.data if table is None else table[self.data]
        space = (_SPACE if marks else _PLAIN)[seen]
        edge = np.flatnonzero(np.diff(space.view(np.int8), prepend=1))
        self.starts, self.ends = edge[::2], edge[1::2]
        self.stops = np.searchsorted(self.starts, self.text_ends)
        seen = LOWER[seen] if lower else seen
        with np.errstate(over="ignore"):
            self._sums = np.empty(len(seen) + 1, np.uint64)
            self._sums[0] = 0
            np.cumsum(_VALUES[seen] * _powers(_BASE, len(seen)), out=self._sums[1:])
            self._back = _powers(_INVERSE, len(seen) + 1)[self.starts]

    def hashes(self, first: int | None = None) -> np.ndarray:
        """Of each word, or of its first so many bytes (of the whole of shorter ones)."""
        ends = self.ends if first is None else np.minimum(self.ends, self.starts + first)
        with np.errstate(over="ignore"):
            return mixed((self._sums[ends] - self._sums[self.starts]) * self._back)


def word_hashes(texts: list[str | bytes | None], lower: bool = True, marks: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, stops): hashes of the words of all texts one after another; words of text i come before stops[i]."""
    w = Words(texts, lower, marks)
    return w.hashes(), w.stops


def shingle_sets(texts: list[str | bytes | None], k: int) -> list[np.ndarray]:
    """The sorted distinct hashes of the k-word shingles of each text; of the whole sequence where it has fewer words."""
    words, ends = word_hashes(texts)
    with np.errstate(over="ignore"):
        rolled = np.zeros(max(0, len(words) - k + 1), np.uint64)
        for j in range(k):
            rolled = mixed(rolled * _BASE + words[j : len(words) - k + 1 + j])
    out, start = [], 0
    for end in ends:
        if end - start >= k:
            out.append(np.unique(rolled[start : end - k + 1]))
        elif end > start:
            with np.errstate(over="ignore"):
                h = np.uint64(end - start)
                for w in words[start:end]:
                    h = mixed(np.asarray([h * _BASE + w]))[0]
            out.append(np.asarray([h], np.uint64))
        else:
            out.append(np.empty(0, np.uint64))
        start = end
    return out

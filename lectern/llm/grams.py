"""Character n-grams of words, hashed in numpy, and sums of word features over texts."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np

#: Runs of letters; the few numerals that \w holds besides digits count as letters here.
WORD = re.compile(r"[^\W\d_]+")
BLANK = ord(" ")
#: Words whose features a Python worker keeps at hand; results don't depend on it.
CACHED = 120_000
#: New words whose n-grams are looked at together.
TOGETHER = 4096


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))  # stops at the first letter


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: multiply and shift until every bit depends on every other."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def gram_hashes(words: list[str], orders: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(owner, hash) of each n-gram of each word with a mark at both ends, ordered by owner within an order of n-grams.

    The words stand in one line with blanks between; a window with a blank inside spans two words and isn't one.
    """
    codes = np.frombuffer(f" {' '.join(words)} ".encode("utf-32-le"), "<u4")
    blank = codes == BLANK
    seen = np.concatenate([[0], np.cumsum(blank)])
    owners, hashes = [], []
    for n in orders:
        m = len(codes) - n + 1
        if m <= 0:
            continue
        h = np.full(m, n, np.uint64)
        for i in range(n):
            h = h * np.uint64(0x9E3779B97F4A7C15) + codes[i : i + m].astype(np.uint64)
        inside = seen[n - 1 : n - 1 + m] - seen[1 : 1 + m] if n > 2 else (blank[:m] & blank[1 : 1 + m]).astype(int)
        at = np.nonzero(inside == 0)[0]
        owners.append(seen[1:][at] - 1)
        hashes.append(mixed(h[at]))
    return np.concatenate(owners), np.concatenate(hashes)


class TextSums:
    """Sums of word features over texts: features(words) gives one row of numbers for each of some distinct words."""

    def __init__(self, features: Callable[[list[str]], np.ndarray]):
        self.features, self.index, self.rows = features, {}, None

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """For each text: the sum of its words' rows, and the number of its words."""
        lists = [words_of(t) for t in texts]
        flat = [w for x in lists for w in x]
        counts = np.fromiter(map(len, lists), np.int64, len(lists))
        if len(self.index) > CACHED:
            self.index, self.rows = {}, None
        new = sorted(set(flat).difference(self.index))
        if new or self.rows is None:
            got = [self.features(new[i : i + TOGETHER]) for i in range(0, len(new), TOGETHER)] or [self.features([])]
            self.rows = np.concatenate(got if self.rows is None else [self.rows, *got])
            self.index.update(zip(new, range(len(self.index), len(self.index) + len(new))))
        at = np.fromiter(map(self.index.__getitem__, flat), np.int64, len(flat))
        sums = np.zeros((len(lists), self.rows.shape[1]), self.rows.dtype if self.rows.dtype.kind == "f" else np.int64)
        some = np.nonzero(counts)[0]
        if len(some):
            starts = np.concatenate([[0], np.cumsum(counts[some])[:-1]])
            sums[some] = np.add.reduceat(self.rows[at], starts, axis=0, dtype=sums.dtype)
        return sums, counts

"""Words and shingle sets of whole texts as 64-bit hashes."""

from __future__ import annotations

import numpy as np
import xxhash

MOST_CACHED = 300_000  #: words that a worker remembers; the cache only spares work
MIX = np.uint64(0x9E3779B97F4A7C15)


class Words(dict):
    """Hash of each word seen by this worker."""

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def hashes(self, words: list[bytes]) -> np.ndarray:
        if len(self) > MOST_CACHED:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


WORDS = Words()


def split(text: str | None) -> list[bytes]:
    """Maximal runs without space and the controls 9-13, as UTF-8."""
    return text.encode().split() if text else []


def rolling(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every ``n`` consecutive word hashes (fewer than n: none); built from runs of powers of two."""
    if len(h) < n:
        return h[:0]
    run, size, total, done = h, 1, None, 0
    while True:
        if n & size:  # append this run to what is joined so far
            part = run[done:] if done else run
            keep = len(h) - done - size + 1
            part = part[:keep]
            total = part if total is None else total[:keep] * (MIX ** np.uint64(size)) + part
            done += size
        size *= 2
        if size > n:
            return finish(total)
        run = run[:len(run) - size // 2] * (MIX ** np.uint64(size // 2)) + run[size // 2:]


def finish(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_set(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles of the text, A-Z lower-cased; with fewer words the whole sequence is one shingle."""
    h = WORDS.hashes(text.encode().lower().split()) if text else np.zeros(0, dtype=np.uint64)
    if not len(h):
        return h
    if len(h) < n:
        return rolling(h, len(h)) ^ np.uint64(len(h))
    return np.unique(rolling(h, n))

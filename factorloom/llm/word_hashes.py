"""64-bit hashes of all words of many texts by running sums over their bytes.

A word's bytes stand for fixed random numbers, equal for both cases of A-Z; their polynomials in two
bases, modulo 2^64, are differences of running sums over a stretch of bytes and are mixed with the
word's length. No word is cut out, so new words cost no more than known ones and nothing is
remembered. Stretches end at white space and are of bounded size; a longer word is summed in parts."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from factorloom.llm.common import mix

#: Bytes of a stretch.
STRETCH = 1 << 17
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


@lru_cache(2)
def _tables(stretch: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """Which bytes belong to words, and for each base the numbers of bytes, its powers and those of its
    inverse."""
    in_word = np.ones(256, bool)
    in_word[[0x20, *range(0x09, 0x0E)]] = False  # the bytes at which bytes.split() splits
    lanes = []
    for base in _BASES:
        numbers = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(base))
        numbers[65:91] = numbers[97:123]
        powers = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(stretch, x, np.uint64)])) for x in (base, pow(base, -1, 1 << 64))]
        lanes.append((numbers, *powers))
    return in_word, lanes


class WordHashes:
    """Hashes of words, which are runs of other bytes than ASCII white space."""

    def __init__(self, stretch: int = STRETCH):
        self.stretch = stretch
        self.in_word, self.lanes = _tables(stretch)

    def _mixed(self, sums: list[np.ndarray], lengths: np.ndarray) -> np.ndarray:
        return mix(mix(sums[0]) + sums[1] + lengths.astype(np.uint64))

    def _long(self, word: np.ndarray) -> np.ndarray:
        """The hash of one word that is longer than a stretch."""
        sums = []
        for base, (numbers, powers, _) in zip(_BASES, self.lanes, strict=True):
            total = 0
            for at in range(0, len(word), self.stretch):
                part = numbers[word[at : at + self.stretch]]
                total += int((part * powers[: len(part)]).sum()) * pow(base, at, 1 << 64)
            sums.append(np.array([total % (1 << 64)], np.uint64))
        return self._mixed(sums, np.array([len(word)]))

    def of_texts(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The hashes of the texts' words, in order, and how many words each text has."""
        raw = np.frombuffer(b" ".join(texts), np.uint8)
        hashes, starts, at = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], 0
        while at < len(raw):
            word = self.in_word[raw[at : at + self.stretch]]
            if at + self.stretch < len(raw):
                ends = np.flatnonzero(~word)
                if not len(ends):
                    end = at + self.stretch
                    while end < len(raw) and self.in_word[raw[end]]:
                        inside = self.in_word[raw[end : end + self.stretch]]
                        end += len(inside) if inside.all() else int(inside.argmin())
                    hashes.append(self._long(raw[at:end]))
                    starts.append(np.array([at]))
                    at = end
                    continue
                word = word[: ends[-1] + 1]
            edges = np.flatnonzero(np.diff(word, prepend=False, append=False))
            first, last = edges[::2], edges[1::2]
            part, sums = raw[at : at + len(word)], []
            for numbers, powers, inverses in self.lanes:
                running = np.zeros(len(word) + 1, np.uint64)
                np.cumsum(numbers[part] * powers[: len(word)], out=running[1:])
                sums.append((running[last] - running[first]) * inverses[first])
            hashes.append(self._mixed(sums, last - first))
            starts.append(first + at)
            at += len(word)
        begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
        return np.concatenate(hashes), np.diff(np.searchsorted(np.concatenate(starts), begins))

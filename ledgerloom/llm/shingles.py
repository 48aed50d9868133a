"""Sets of five-word shingles as sorted 64-bit hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Words of a shingle; bytes of text hashed in one pass.
WORDS = 5
CHUNK_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_STEP = np.uint64(0xD1342543DE82EF95)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


class Powers:
    """Powers of the base and of its inverse modulo 2^64, grown as texts need them."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = max(n, CHUNK_BYTES + 1)
            self.up, self.down = _powers(_BASE, size), _powers(_INVERSE, size)
        return self.up[:n], self.down[:n]


def _powers(base: int, size: int) -> np.ndarray:
    out = np.ones(size, np.uint64)
    done = 1
    while done < size:
        n = min(done, size - done)
        out[done : done + n] = out[:n] * np.uint64(pow(base, done, 1 << 64))
        done += n
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that polynomial structure doesn't reach the order of hashes."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _chunks(texts: list[str | None]) -> Iterator[list[bytes]]:
    group, size = [], 0
    for t in texts:
        raw = t.encode().lower() if t else b""
        group.append(raw)
        size += len(raw)
        if size >= CHUNK_BYTES:
            yield group
            group, size = [], 0
    if group:
        yield group


def word_hashes(raws: list[bytes], powers: Powers) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in order, a byte that hashes each word's last three bytes, and the bounds of
    the texts among the words."""
    data = np.frombuffer(b" " + b" ".join(raws) + b" ", np.uint8)
    up, down = powers.upto(len(data) + 1)
    prefix = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=prefix[1:])
    space = _SPACE[data]
    starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
    begin = 1 + np.concatenate([[0], np.cumsum([len(r) + 1 for r in raws])])
    bounds = np.searchsorted(starts, begin)
    words = mix((prefix[ends] - prefix[starts]) * down[starts])
    cut = np.maximum(starts, ends - 3)
    tails = (mix((prefix[ends] - prefix[cut]) * down[cut]) >> np.uint64(56)).astype(np.uint8)
    return words, tails, bounds


def shingle_sets(texts: list[str | None], powers: Powers) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text: of five words, or of all where there are fewer."""
    for raws in _chunks(texts):
        words, _, bound = word_hashes(raws, powers)
        rolled = words[: max(0, len(words) - WORDS + 1)].copy()
        for k in range(1, WORDS):
            rolled = rolled * _STEP + words[k : len(words) - WORDS + 1 + k]
        rolled = mix(rolled)
        for a, b in zip(bound, bound[1:]):
            if b - a >= WORDS:
                yield np.unique(rolled[a : b - WORDS + 1])
            elif b > a:
                h = np.uint64(b - a)
                with np.errstate(over="ignore"):
                    for w in words[a:b]:
                        h = h * _STEP + w
                    yield mix(np.array([h ^ np.uint64(0x5BF0_3635)], np.uint64))
            else:
                yield np.zeros(0, np.uint64)

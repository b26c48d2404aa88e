"""Vectorised hashes of substrings, shared by the operators on word shingles and on byte strings."""

from __future__ import annotations

import numpy as np

_RNG = np.random.default_rng(0x5EED)
#: A random 64-bit value for each byte, so that texts of few letters still spread.
BYTE_VALUES = _RNG.integers(1, 2**63, 256, dtype=np.uint64)
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 2**64))

#: A-Z to a-z; white space as the word pattern of near-duplicate search has it is left to bytes.split().
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))

_powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse modulo 2**64."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        for i, base in enumerate((BASE, BASE_INVERSE)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread all bits of 64-bit values over the whole word."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class PrefixHashes:
    """Polynomial hash of any substring of a byte buffer, from prefix sums."""

    def __init__(self, buffer: np.ndarray):
        n = len(buffer)
        up, self.down = powers(n + 1)
        self.prefix = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(BYTE_VALUES[buffer] * up[:n], out=self.prefix[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Unmixed: equal for equal substrings wherever they stand."""
        return (self.prefix[end] - self.prefix[start]) * self.down[start]


def sliced(batches, rows: int = 512):
    """Record batches in slices, so that a task holds few rows as Python objects at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def chunks(texts: list, limit: int = 1 << 20):
    """Runs of texts (as indexes) of about ``limit`` bytes; a longer text is a run of its own."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        n = len(text)
        if size and size + n > limit:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def shingle_sets(texts: list[bytes | None], words: int = 5) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's word shingles.

    Texts are UTF-8 bytes. A-Z count as a-z; words are runs of other than space and 9 to 13. A text of fewer words is
    one shingle; one without words has none.
    """
    plain = [b" ".join(t.translate(LOWER).split()) if t else b"" for t in texts]
    out: list[np.ndarray] = []
    for lo, hi in chunks(plain):
        out.extend(_shingle_sets(plain[lo:hi], words))
    return out


def _shingle_sets(plain: list[bytes], words: int) -> list[np.ndarray]:
    none = np.zeros(0, dtype=np.uint64)
    full = [i for i, t in enumerate(plain) if t]
    result = [none] * len(plain)
    if not full:
        return result
    buffer = np.frombuffer(b"\n".join(plain[i] for i in full), dtype=np.uint8)
    hashes = PrefixHashes(buffer)
    breaks = np.flatnonzero((buffer == 32) | (buffer == 10))
    starts = np.concatenate(([0], breaks + 1))
    ends = np.concatenate((breaks, [len(buffer)]))
    last = np.flatnonzero(buffer[breaks] == 10)  # the last word of each text but the final one
    first_word = np.concatenate(([0], last + 1))
    end_word = np.concatenate((last + 1, [len(starts)]))
    if len(starts) >= words:
        runs = mix(hashes.of(starts[: len(starts) - words + 1], ends[words - 1 :]))
    else:
        runs = none
    for i, a, b in zip(full, first_word.tolist(), end_word.tolist(), strict=True):
        if b - a < words:
            result[i] = mix(hashes.of(starts[a : a + 1], ends[b - 1 : b]))
        else:
            result[i] = np.unique(runs[a : b - words + 1])
    return result

"""64-bit hashes of all words of many texts, without a loop over the words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

# Bytes of text hashed at once.
PIECE_BYTES = 1 << 20

_BYTES = np.random.default_rng(20240301).integers(0, 2**64, 256, dtype=np.uint64)
_SPACE = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))
_BASE = 0x9E3779B97F4A7C15
_UNDO = pow(_BASE, -1, 2**64)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of hashes."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(29))


def _powers(base: int, count: int) -> np.ndarray:
    factors = np.full(count, base, np.uint64)
    factors[0] = 1
    return np.cumprod(factors)


class WordHasher:
    """Words are split at ASCII white space and lower-cased (A-Z).

    A word's hash is the sum of a random number per byte times a power for its place, divided by the power of the
    word's start, so it does not depend on where the word stands. Sums wrap at 64 bits.
    """

    def __init__(self):
        self.powers = self.undo = np.ones(1, np.uint64)

    def batches(self, texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For stretches of the texts, in order: the word hashes, and the first word of each text and one more."""
        piece, size = [], 0
        for text in texts:
            if piece and size + len(text) > PIECE_BYTES:
                yield self._hashes(piece)
                piece, size = [], 0
            piece.append(text)
            size += len(text) + 1
        if piece:
            yield self._hashes(piece)

    def _hashes(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        b = np.frombuffer(b"\n".join(texts).lower(), np.uint8)
        if len(self.powers) < len(b):
            self.powers, self.undo = (_powers(x, max(len(b), PIECE_BYTES)) for x in (_BASE, _UNDO))
        outside = np.ones(len(b) + 2, bool)
        outside[1:-1] = _SPACE[b]
        edges = np.flatnonzero(outside[1:] != outside[:-1])
        sums = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(_BYTES[b] * self.powers[: len(b)], out=sums[1:])
        starts, ends = edges[::2], edges[1::2]
        offsets = np.cumsum([0, *(len(t) + 1 for t in texts)])
        return mixed((sums[ends] - sums[starts]) * self.undo[starts]), np.searchsorted(starts, offsets)

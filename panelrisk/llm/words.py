"""Words of a batch of texts as arrays: vectorised splitting and hashing inside tasks."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from panelrisk.llm.common import SPACE_BYTES

_PIECE = 1 << 17
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    out = np.ones(n, np.uint64)
    out[1:] = base
    return np.multiply.accumulate(out)


_UP = _powers(_BASE, _PIECE + 1)
_DOWN = _powers(pow(_BASE, -1, 1 << 64), _PIECE + 1)
_VALUES = np.random.default_rng(20_240_601).integers(1, _MASK, 256, np.uint64, endpoint=True)

_SPACE = np.zeros(256, bool)
_SPACE[list(SPACE_BYTES)] = True
_NOT_TOKEN = np.ones(256, bool)
_NOT_TOKEN[[*b"0123456789_abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", *range(128, 256)]] = False


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


@dataclass
class Words:
    """The words of ``n`` texts: byte spans in ``raw``, hashes, and the first word of each text."""

    raw: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owner(self) -> np.ndarray:
        """The number of the text that each word is from."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(hashes of every k consecutive words of one text, their first words' numbers)."""
        n = len(self.hashes) - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        h = np.zeros(n, np.uint64)
        for j in range(k):
            h = h * np.uint64(_BASE) + self.hashes[j:j + n]
        last = np.repeat(self.first[1:], self.counts)[:n]
        at = np.flatnonzero(np.arange(n) + k <= last)
        return mix(h[at]), at


def split(texts: list[str | None], tokens: bool = False) -> Words:
    """The words of each text: runs without ASCII white space, or, as tokens, runs of ASCII letters and
    digits, ``_`` and anything beyond ASCII, after lower-casing.  A null text has none."""
    data = [(t.lower() if tokens else t).encode("utf-8", "replace") if t else b"" for t in texts]
    return split_bytes(data, _NOT_TOKEN if tokens else _SPACE)


def split_bytes(data: list[bytes], gaps: np.ndarray) -> Words:
    """The runs of bytes of each text that ``gaps``, by byte, does not mark; a line feed must be marked."""
    raw = np.frombuffer(b"\n".join([*data, b""]), np.uint8)  # a separator after each text
    gap = gaps[raw]
    edge = np.diff(gap.view(np.int8), prepend=np.int8(1))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    ends = ends[:len(starts)]
    limits = np.cumsum([0, *[len(d) + 1 for d in data]])
    return Words(raw, starts, ends, span_hashes(raw, starts, ends), np.searchsorted(starts, limits))


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray = _VALUES) -> np.ndarray:
    """A hash of each span of bytes; ``values`` are 256 random numbers."""
    hashes = np.empty(len(starts), np.uint64)
    a = 0
    while a < len(starts):
        # as many words as fit a piece; a longer word goes alone, in pieces of its own
        base = starts[a]
        b = int(np.searchsorted(ends, base + _PIECE, "right"))
        if b == a:
            hashes[a] = _long_word(raw[base:ends[a]], values)
            a += 1
            continue
        piece = raw[base:ends[b - 1]]
        sums = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(values[piece] * _UP[:len(piece)], out=sums[1:])
        s, e = starts[a:b] - base, ends[a:b] - base
        hashes[a:b] = (sums[e] - sums[s]) * _DOWN[s]
        a = b
    lengths = (ends - starts).astype(np.uint64)
    return mix(hashes + lengths * np.uint64(0xD6E8FEB86659FD93))


def _long_word(raw: np.ndarray, values: np.ndarray) -> np.uint64:
    """The same polynomial over a word longer than a piece."""
    total, scale = np.uint64(0), np.uint64(1)
    with np.errstate(over="ignore"):
        for i in range(0, len(raw), _PIECE):
            part = raw[i:i + _PIECE]
            total += scale * np.sum(values[part] * _UP[:len(part)], dtype=np.uint64)
            scale *= _UP[_PIECE]
    return total

"""Elias-Fano code of a non-decreasing sequence, with select.

Each of ``n`` values up to ``u`` is split: its ``floor(log2(u / n))`` low bits are
stored as they are, the high parts as a bit vector in which the i-th one stands at
position ``high + i``. Together that is at most two bits per value more than the
low bits. Positions of every 64th one are sampled, so a select skips to the sample
and scans a few words, and no table of 64-bit offsets is needed.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np

SAMPLE = 64
_HEAD = "<IQBII"  # values, largest value, low bits, bytes of the low part, of the high part


def _pack_low(values: np.ndarray, bits: int) -> bytes:
    if not bits:
        return b""
    planes = (values[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(planes.astype(np.uint8).ravel(), bitorder="little").tobytes()


def encode(values) -> bytes:
    """The code of a non-decreasing sequence of integers of 0 or more."""
    values = np.asarray(values, np.uint64)
    if not len(values):
        return struct.pack(_HEAD, 0, 0, 0, 0, 0)
    if np.any(values[1:] < values[:-1]):
        raise ValueError("values must not decrease")
    last = int(values[-1])
    bits = max(0, (last // len(values)).bit_length() - 1)
    ones = (values >> np.uint64(bits)) + np.arange(len(values), dtype=np.uint64)
    high = np.zeros(int(ones[-1]) // 64 + 1, np.uint64)
    np.bitwise_or.at(high, (ones // 64).astype(np.int64), np.uint64(1) << (ones % np.uint64(64)))
    low = _pack_low(values, bits)
    samples = ones[::SAMPLE].astype("<u4")
    return (struct.pack(_HEAD, len(values), last, bits, len(low), high.nbytes) + low + high.astype("<u8").tobytes()
            + samples.tobytes())


@dataclass
class EliasFano:
    """Reader of a code; ``len`` gives the number of values."""

    code: bytes

    def __post_init__(self) -> None:
        self.size, self.last, self.bits, n_low, n_high = struct.unpack_from(_HEAD, self.code)
        at = struct.calcsize(_HEAD)
        self._low = np.frombuffer(self.code, np.uint8, n_low, at)
        self._high = np.frombuffer(self.code, "<u8", n_high // 8, at + n_low)
        self._samples = np.frombuffer(self.code, "<u4", -(-self.size // SAMPLE), at + n_low + n_high)

    def __len__(self) -> int:
        return self.size

    def select(self, i: int) -> int:
        """The i-th value, counted from 0."""
        if not 0 <= i < self.size:
            raise IndexError(i)
        at = int(self._samples[i // SAMPLE])
        word, left = at // 64, i % SAMPLE
        bits = int(self._high[word]) >> (at % 64) << (at % 64)  # the sampled one and what follows
        while (found := bits.bit_count()) <= left:
            left -= found
            word += 1
            bits = int(self._high[word])
        for _ in range(left):
            bits &= bits - 1
        high = 64 * word + (bits & -bits).bit_length() - 1 - i
        return (high << self.bits) | self._low_part(i)

    def _low_part(self, i: int) -> int:
        first, end = i * self.bits, (i + 1) * self.bits
        piece = int.from_bytes(self._low[first // 8:(end + 7) // 8].tobytes(), "little")
        return piece >> (first % 8) & ((1 << self.bits) - 1)

    def values(self) -> np.ndarray:
        """All values at once."""
        if not self.size:
            return np.empty(0, np.uint64)
        ones = np.flatnonzero(np.unpackbits(self._high.view(np.uint8), bitorder="little"))[: self.size]
        high = ones.astype(np.uint64) - np.arange(self.size, dtype=np.uint64)
        if not self.bits:
            return high
        planes = np.unpackbits(self._low, bitorder="little")[: self.size * self.bits].reshape(self.size, self.bits)
        low = (planes.astype(np.uint64) << np.arange(self.bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
        return (high << np.uint64(self.bits)) | low

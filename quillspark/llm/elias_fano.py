"""Elias-Fano coded monotone sequences over memory-mapped arrays, searched in bulk with numpy."""

from __future__ import annotations

import os
import tempfile

import numpy as np

_STEP = 1 << 18


def _pack_bits(values: np.ndarray, width: int) -> np.ndarray:
    """``width``-bit integers as bytes, little-endian bits, with 8 spare bytes for unaligned reads."""
    if not width:
        return np.zeros(8, np.uint8)
    shifts = np.arange(width, dtype=np.uint64)
    parts = [np.packbits(((values[a:a + _STEP, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel(),
                         bitorder="little") for a in range(0, len(values), _STEP)]
    return np.concatenate([*parts, np.zeros(8, np.uint8)])


def encode(values: np.ndarray) -> dict[str, np.ndarray]:
    """Arrays of a non-decreasing uint64 sequence: low bits packed, high bits in unary, a rank directory."""
    values = np.asarray(values, np.uint64)
    n = len(values)
    top = int(values[-1]) if n else 0
    width = max(0, min(56, (top // max(n, 1)).bit_length() - 1)) if n else 0
    high = (values >> np.uint64(width)).astype(np.int64)
    size = n + (int(high[-1]) if n else 0) + 1
    words = -(-size // 64) + 1
    bits = np.zeros(words * 64, np.uint8)
    bits[high + np.arange(n)] = 1
    ones = np.concatenate([[0], np.cumsum(bits.reshape(-1, 64).sum(axis=1, dtype=np.int64))])
    return {"low": _pack_bits(values & np.uint64((1 << width) - 1), width),
            "high": np.packbits(bits, bitorder="little"), "ones": ones, "meta": np.array([n, width], np.int64)}


class EliasFano:
    """Reader over the arrays of :func:`encode` (usually memory-mapped)."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.n, self.width = (int(x) for x in arrays["meta"])
        self.high, self.ones = arrays["high"].reshape(-1, 8), arrays["ones"]
        low = arrays["low"]
        self.low_bytes = np.ndarray((max(len(low) - 7, 1),), "<u8", low.data, strides=(1,))
        self.zeros = np.arange(len(self.ones), dtype=np.int64) * 64 - self.ones

    def _low(self, i: np.ndarray) -> np.ndarray:
        at = i * self.width
        return (self.low_bytes[at >> 3] >> (at & 7).astype(np.uint64)) & np.uint64((1 << self.width) - 1)

    def _select(self, j: np.ndarray, ones: bool) -> np.ndarray:
        """Position of the j-th (from 0) one or zero in the high bits."""
        directory = self.ones if ones else self.zeros
        out = np.empty(len(j), np.int64)
        for a in range(0, len(j), _STEP):
            x = j[a:a + _STEP]
            word = np.searchsorted(directory, x, side="right") - 1
            bits = np.unpackbits(self.high[word], axis=1, bitorder="little")
            if not ones:
                bits ^= 1
            upto = np.cumsum(bits, axis=1, dtype=np.uint8)
            out[a:a + _STEP] = word * 64 + (upto <= (x - directory[word])[:, None]).sum(axis=1)
        return out

    def get(self, i: np.ndarray) -> np.ndarray:
        high = self._select(i, True) - i
        return (high.astype(np.uint64) << np.uint64(self.width)) | self._low(i)

    def successor(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the first element >= x, and whether it equals x."""
        x = np.asarray(x, np.uint64)
        if not self.n:
            return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
        last = int(self.get(np.array([self.n - 1]))[0])
        inside = x <= np.uint64(last)
        y = np.where(inside, x, np.uint64(last))
        high = (y >> np.uint64(self.width)).astype(np.int64)
        lo = np.where(high > 0, self._select(np.maximum(high - 1, 0), False) - (high - 1), 0)
        end = self._select(high, False) - high
        hi, want = end.copy(), y & np.uint64((1 << self.width) - 1)
        while True:
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                break
            mid = (lo[open_] + hi[open_]) >> 1
            less = self._low(mid) < want[open_]
            lo[open_[less]] = mid[less] + 1
            hi[open_[~less]] = mid[~less]
        same = inside & (lo < end)
        same[same] = self._low(lo[same]) == want[same]
        return np.where(inside, lo, self.n), same


class MappedArrays:
    """Named arrays written to one scratch file of the task and read back memory-mapped.

    The file lives as long as the object: it is this task's own scratch, never read by another.
    """

    def __init__(self, arrays: dict[str, np.ndarray]):
        fd, self.path = tempfile.mkstemp(prefix="trie-", suffix=".bin")
        at = {}
        with os.fdopen(fd, "wb") as f:
            for name, a in arrays.items():
                f.write(b"\0" * (-f.tell() % 8))
                at[name] = (f.tell(), a.dtype, len(a))
                f.write(np.ascontiguousarray(a).tobytes())
            f.write(b"\0" * 8)
        raw = np.memmap(self.path, np.uint8, "r")
        self.arrays = {k: raw[o:o + n * d.itemsize].view(d) for k, (o, d, n) in at.items()}

    def __enter__(self) -> dict[str, np.ndarray]:
        return self.arrays

    def __exit__(self, *exc) -> None:
        os.unlink(self.path)

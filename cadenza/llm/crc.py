"""CRC-32C (Castagnoli) of many byte strings at once with numpy; the checksum is linear, so blocks combine."""

from __future__ import annotations

import numpy as np

_POLY = 0x82F63B78  # fixed value: the reflected Castagnoli polynomial
_BLOCK = 64


def _byte_table() -> np.ndarray:
    crc = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        crc = np.where(crc & 1, (crc >> 1) ^ np.uint32(_POLY), crc >> 1).astype(np.uint32)
    return crc


_TABLE = _byte_table()


def _apply(tables: np.ndarray, x: np.ndarray) -> np.ndarray:
    return tables[0][x & 255] ^ tables[1][(x >> 8) & 255] ^ tables[2][(x >> 16) & 255] ^ tables[3][x >> 24]


def _doublings(n: int) -> list[np.ndarray]:
    """For k < n the operator that appends 2**k zero bytes, as four tables of 256."""
    values = np.arange(256, dtype=np.uint32)
    step = np.stack([_TABLE[v & 255] ^ (v >> 8) for v in (values, values << 8, values << 16, values << 24)])
    out = [step]
    for _ in range(n - 1):
        out.append(np.stack([_apply(out[-1], row) for row in out[-1]]))
    return out


_ZEROS = _doublings(40)


def _shift(x: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    """Each checksum after so many zero bytes more."""
    k = 0
    while (todo := zeros >> k).any():
        hit = (todo & 1).astype(bool)
        x = x.copy()
        x[hit] = _apply(_ZEROS[k], x[hit])
        k += 1
    return x


def crc32c_many(items: list[bytes]) -> np.ndarray:
    """The CRC-32C of every item, as unsigned 32-bit integers."""
    if not items:
        return np.empty(0, np.uint32)
    sizes = np.array([len(x) for x in items], np.int64)
    blocks = np.maximum(1, -(-sizes // _BLOCK))
    padded = b"".join(x.rjust(int(n) * _BLOCK, b"\0") for x, n in zip(items, blocks))
    rows = np.frombuffer(padded, np.uint8).reshape(-1, _BLOCK)
    crc = np.zeros(len(rows), np.uint32)
    for k in range(_BLOCK):
        crc = _TABLE[(crc ^ rows[:, k]) & 255] ^ (crc >> 8)
    first = np.cumsum(blocks) - blocks
    after = np.repeat(first + blocks, blocks) - 1 - np.arange(len(rows))
    crc = np.bitwise_xor.reduceat(_shift(crc, after * _BLOCK), first)
    return crc ^ _shift(np.full(len(items), 0xFFFFFFFF, np.uint32), sizes) ^ np.uint32(0xFFFFFFFF)


def masked(crc: np.ndarray) -> np.ndarray:
    """The rotated and offset form that is stored, so that checksums of checksummed data stay strong."""
    return (((crc >> 15) | (crc << 17)) + np.uint32(0xA282EAD8)).astype("<u4")

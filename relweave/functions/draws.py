"""Uniform draws of walkers by MD5, many at a time."""

from __future__ import annotations

import hashlib
import math

import numpy as np

_ADDED = [int(abs(math.sin(i + 1)) * 2**32) & 0xFFFFFFFF for i in range(64)]
_TURNED = [r for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for r in four * 4]
_STATE = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
#: Messages that are hashed together, so that what is between stays in the cache, and the most bytes of one.
CHUNK, MESSAGE = 16_384, 55


def _fractions(words: list[np.ndarray], size: int) -> np.ndarray:
    """The first 12 hexadecimal digits of the MD5 of messages of ``size`` bytes, as fractions; ``words`` hold message and padding."""
    n = len(words[0])
    a, b, c, d = (np.full(n, x, "u4") for x in _STATE)
    f, t = np.empty(n, "u4"), np.empty(n, "u4")
    for i in range(64):
        if i < 16:
            g = i
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif i < 32:
            g = (5 * i + 1) % 16
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif i < 48:
            g = (3 * i + 5) % 16
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            g = 7 * i % 16
            np.invert(d, out=f)
            f |= b
            f ^= c
        f += a
        if g < len(words):
            f += words[g]
        f += np.uint32((_ADDED[i] + (8 * size if g == 14 else 0)) & 0xFFFFFFFF)
        np.left_shift(f, np.uint32(_TURNED[i]), out=t)
        f >>= np.uint32(32 - _TURNED[i])
        f |= t
        f += b
        a, b, c, d, f = d, f, b, c, a
    a, b = a + np.uint32(_STATE[0]), b + np.uint32(_STATE[1])
    high, low = a.byteswap().astype("i8"), b.byteswap().astype("i8") >> 16
    return ((high << 16) | low) / 16**12


def _one(message: str) -> float:
    return int(hashlib.md5(message.encode()).hexdigest()[:12], 16) / 16**12


def draws(starts: list, walkers: list[int], length: int, restart: float, seed: int) -> np.ndarray:
    """For each walker and each step from 1 the draw of its edge, the MD5 of seed-start-walker-step-0, or NaN if it restarts,
    which the MD5 of seed-start-walker-step-1 decides."""
    out = np.full((len(starts), length - 1), np.nan)
    names = [f"{seed}-{s}-{w}".encode() for s, w in zip(starts, walkers)]
    sizes = np.array([len(x) for x in names], "i8")
    for size in np.unique(sizes).tolist():
        mine = np.flatnonzero(sizes == size)
        low = 1
        while low < length:
            steps = np.arange(low, min(length, 10 * low))
            low *= 10
            ends = [f"-{k}-1".encode() for k in steps]
            whole = size + len(ends[0])
            if whole > MESSAGE:
                for i in mine.tolist():
                    name = names[i].decode()
                    for k in steps.tolist():
                        if _one(f"{name}-{k}-1") >= restart:
                            out[i, k - 1] = _one(f"{name}-{k}-0")
                continue
            tails = np.frombuffer(b"".join(ends), "u1").reshape(len(steps), -1)
            used, last = whole // 4 + 1, whole - 1
            for at in range(0, len(mine), max(1, CHUNK // len(steps))):
                some = mine[at : at + max(1, CHUNK // len(steps))]
                text = np.zeros((len(some), len(steps), 4 * used), "u1")
                text[:, :, :size] = np.frombuffer(b"".join(names[i] for i in some.tolist()), "u1").reshape(len(some), 1, size)
                text[:, :, size:whole] = tails
                text[:, :, whole] = 0x80
                words = [np.ascontiguousarray(w) for w in text.reshape(-1, 4 * used).view("<u4").T]
                on = _fractions(words, whole) >= restart
                words = [w[on] for w in words]
                words[last // 4] ^= np.uint32(1 << 8 * (last % 4))  # from 1 to 0
                u = np.full(len(on), np.nan)
                u[on] = _fractions(words, whole)
                out[np.ix_(some, steps - 1)] = u.reshape(len(some), -1)
    return out

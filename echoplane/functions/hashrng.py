"""Random numbers from digests of a key and a counter.

Number i of a key is the first 13 hexadecimal digits of MD5("key|i") over 2**52. It is the same in
every process, on every version of every library, and in SQL, so what is drawn with it can be
drawn again by a task that is run anew, and checked by an independent statement."""

from __future__ import annotations

import hashlib
import math

import numpy as np


#: Numbers from which on a digest of all at once is faster, and how many are made at a time.
MANY, AT_ONCE = 512, 8192
_SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_TURNS = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]


def _heads(head: bytes, first: int, n: int, digits: int) -> np.ndarray:
    """The first 52 bits of MD5(head + number) for n numbers from first on, all of so many digits; one block of
    64 bytes each, so head and number have 55 bytes at most."""
    size = len(head) + digits
    block = np.zeros((64, n), np.uint8)
    block[: len(head)] = np.frombuffer(head, np.uint8)[:, None]
    at = np.arange(first, first + n)
    for k in range(digits):
        block[size - 1 - k] = at % 10 + 48
        at = at // 10
    block[size] = 128
    block[56], block[57] = 8 * size % 256, 8 * size // 256
    word = [sum(block[4 * w + k].astype(np.uint32) << np.uint32(8 * k) for k in range(4)) for w in range(16)]
    start = [np.uint32(v) for v in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
    a, b, c, d = (np.full(n, v) for v in start)
    for i in range(64):
        if i < 16:
            f, g = d ^ (b & (c ^ d)), i
        elif i < 32:
            f, g = c ^ (d & (b ^ c)), (5 * i + 1) % 16
        elif i < 48:
            f, g = b ^ c ^ d, (3 * i + 5) % 16
        else:
            f, g = c ^ (b | ~d), 7 * i % 16
        f += a
        f += word[g]
        f += np.uint32(_SINES[i])
        t = _TURNS[i // 16][i % 4]
        turned = f << np.uint32(t)
        turned |= f >> np.uint32(32 - t)
        turned += b
        a, d, c, b = d, c, b, turned
    return ((a + start[0]).byteswap().astype(np.uint64) << np.uint64(20)) | ((b + start[1]).byteswap().astype(np.uint64) >> np.uint64(12))


def _numbers(head: bytes, first: int, n: int) -> np.ndarray:
    out, at = np.empty(n), first
    while at < first + n:
        digits = len(str(at))
        to = min(first + n, at + AT_ONCE, 10**digits)
        out[at - first : to - first] = _heads(head, at, to - at, digits)
        at = to
    return out / 2**52


class HashRng:
    """The part of numpy's generator interface that the kernels use."""

    def __init__(self, *key):
        self.key = "|".join(str(k.item() if isinstance(k, np.generic) else k) for k in key)
        self.i = 0

    def random(self, size=None):
        n = 1 if size is None else math.prod(size) if isinstance(size, tuple) else int(size)
        head, md5 = self.key.encode() + b"|", hashlib.md5
        if n >= MANY and len(head) + len(str(self.i + n)) <= 55:
            out = _numbers(head, self.i, n)
        else:
            out = np.array([int(md5(head + str(k).encode()).hexdigest()[:13], 16) for k in range(self.i, self.i + n)], float) / 2**52
        self.i += n
        return float(out[0]) if size is None else out.reshape(size)

    def uniform(self, low=0.0, high=1.0, size=None):
        return low + (high - low) * self.random(size)

    def integers(self, n, size=None):
        u = self.random(size)
        return int(u * n) if size is None else (u * n).astype(np.int64)

    def permutation(self, x):
        x = np.arange(x) if isinstance(x, int) else np.asarray(x)
        return x[np.argsort(self.random(len(x)), kind="stable")]

    def standard_normal(self, size=None):
        """By Box and Muller, two numbers for each."""
        n = 1 if size is None else math.prod(size) if isinstance(size, tuple) else int(size)
        u = self.random(2 * n).reshape(n, 2)
        out = np.sqrt(-2 * np.log(1 - u[:, 0])) * np.cos(2 * np.pi * u[:, 1])
        return float(out[0]) if size is None else out.reshape(size)

    def normal(self, loc=0.0, scale=1.0, size=None):
        return loc + scale * self.standard_normal(size)

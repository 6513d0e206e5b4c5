"""Many draws for each row: a 32-bit hash that numpy, Spark and SQL compute alike.

A row has two 32-bit words, from the MD5 of ``seed:key``; draw ``i`` mixes them
with ``i`` by multiplications and shifts (the finaliser of MurmurHash3, twice).
"""

import hashlib

import numpy as np
from pyspark.sql import functions as F

#: fixed values of the mixer: two odd multipliers, and the odd step from draw to draw
FIRST, SECOND, STEP = 0x85EBCA6B, 0xC2B2AE35, 0x9E3779B1


def words(seed, key):
    """Columns ``x1``, ``x2`` (long, below 2^32) of a key column."""
    text = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    return [F.conv(F.substring(text, at, 8), 16, 10).cast("bigint").alias(name) for name, at in (("x1", 1), ("x2", 9))]


def words_of(seed, keys):
    """The same two words of each of ``keys``, as arrays."""
    md5, start = hashlib.md5, f"{seed}:".encode()
    made = b"".join([md5(start + b"%d" % k).digest() for k in keys])
    both = np.frombuffer(made, ">u4").astype(np.uint32).reshape(-1, 4)
    return both[:, 0].copy(), both[:, 1].copy()


def _mix(x):
    x ^= x >> np.uint32(16)
    x *= np.uint32(FIRST)
    x ^= x >> np.uint32(13)
    x *= np.uint32(SECOND)
    x ^= x >> np.uint32(16)
    return x


def mixed(i, x1, x2):
    """Draw ``i`` of each row, uniform below 2^32, as an array of 32-bit numbers."""
    x = x1.astype(np.uint32) ^ np.uint32(i * STEP & 0xFFFFFFFF)
    return _mix(_mix(x) + x2.astype(np.uint32))


def permuted(numbers, n, seed):
    """A bijection of 0 .. n - 1, the same for every task: where each of ``numbers`` goes.

    Four Feistel rounds over the two halves of the bits; numbers that end up
    at ``n`` or above go on until they are below.
    """
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    out = numbers.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        low, high = out[todo] & mask, out[todo] >> np.uint64(half)
        for k in range(1, 5):
            word = mixed(k, low, np.full(len(low), seed)).astype(np.uint64) & mask
            high, low = low, high ^ word
        out[todo] = high << np.uint64(half) | low
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)

"""First words of MD5 sums of many short texts at once, for workers: the hash that SQL repeats, without a text per row.

A text is a prefix (seed and resample) and a tail (an index or a key). Tails of one length are laid out as 32-bit words once,
and each prefix only adds its own bytes to them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from typing import Any

#: Texts of one pass, whose words stay in a core's cache.
CHUNK = 32768


def _table() -> tuple[list[int], list[int], list[int]]:
    """Constants, shifts and word numbers of MD5's steps."""
    from math import sin

    k = [int(abs(sin(i + 1)) * 2**32) for i in range(64)]
    s = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]
    g = [(i, (5 * i + 1) % 16, (3 * i + 5) % 16, (7 * i) % 16)[i // 16] for i in range(64)]
    return k, [s[i // 16][i % 4] for i in range(64)], g


K, S, G = _table()


def _first_word(words: Sequence[Any], n: int) -> Any:
    """The first four bytes of the digests, big-endian, of n one-block messages: 16 words, each a number or an array."""
    import numpy as np

    u32 = np.uint32
    a, b, c, d = (np.full(n, v, u32) for v in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476))
    t, u = np.empty(n, u32), np.empty(n, u32)
    for i in range(61):  # the steps after it don't change the first word
        if i < 16:
            np.bitwise_xor(c, d, out=t)
            np.bitwise_and(t, b, out=t)
            np.bitwise_xor(t, d, out=t)
        elif i < 32:
            np.bitwise_xor(b, c, out=t)
            np.bitwise_and(t, d, out=t)
            np.bitwise_xor(t, c, out=t)
        elif i < 48:
            np.bitwise_xor(b, c, out=t)
            np.bitwise_xor(t, d, out=t)
        else:
            np.invert(d, out=t)
            np.bitwise_or(t, b, out=t)
            np.bitwise_xor(t, c, out=t)
        np.add(t, a, out=t)
        w = words[G[i]]
        if isinstance(w, int):
            np.add(t, u32((K[i] + w) & 0xFFFFFFFF), out=t)
        else:
            np.add(t, w, out=t)
            np.add(t, u32(K[i]), out=t)
        np.right_shift(t, u32(32 - S[i]), out=u)
        np.left_shift(t, u32(S[i]), out=t)
        np.bitwise_or(t, u, out=t)
        np.add(t, b, out=t)
        a, b, c, d, t = d, t, b, c, a
    np.add(b, u32(0x67452301), out=b)
    return b.byteswap()


def first_words(prefixes: Sequence[bytes], tails: Any) -> Iterator[Any]:
    """For each prefix, the first 32 bits of md5(prefix + tail) of all tails: a matrix of bytes, one row per tail."""
    import numpy as np

    n, length = tails.shape
    laid: dict[int, Any] = {}
    for prefix in prefixes:
        total, at = len(prefix) + length, len(prefix) % 4
        if total > 55:  # more than one block
            yield np.array([int.from_bytes(hashlib.md5(prefix + t.tobytes()).digest()[:4], "big") for t in tails], np.uint32)
            continue
        if at not in laid:
            row = np.zeros((n, (at + length) // 4 * 4 + 4), np.uint8)
            row[:, at : at + length] = tails
            row[:, at + length] = 0x80
            laid[at] = np.ascontiguousarray(row.view("<u4").T)
        base, head = len(prefix) // 4, int.from_bytes(prefix[len(prefix) - at :], "little") if at else 0
        words: list[Any] = [0] * 16
        words[:base] = [int.from_bytes(prefix[4 * i : 4 * i + 4], "little") for i in range(base)]
        words[base : base + len(laid[at])] = list(laid[at])
        if head:
            words[base] = words[base] | np.uint32(head)
        words[14] = total * 8
        yield _first_word(words, n)


def digits(start: int, stop: int) -> Iterator[Any]:
    """The decimal digits of start..stop - 1 as matrices of bytes, of at most CHUNK numbers of one length each."""
    import numpy as np

    while start < stop:
        length = len(str(start))
        end = min(stop, start + CHUNK, 10**length)
        rest, out = np.arange(start, end, dtype=np.uint64 if end >> 32 else np.uint32), np.empty((end - start, length), np.uint8)
        for k in range(length - 1, -1, -1):
            out[:, k] = rest % 10 + 48
            rest //= 10
        yield out
        start = end

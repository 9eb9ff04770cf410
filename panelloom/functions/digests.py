"""MD5 of many short texts at once, a word of all of them at a time."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

_SINES = np.floor(np.abs(np.sin(np.arange(1, 65))) * 2**32).astype(np.uint32)
_TURNS = np.repeat([[7, 12, 17, 22], [5, 9, 14, 20], [4, 11, 16, 23], [6, 10, 15, 21]], 4, axis=0).ravel().astype(np.uint32)
_BACK = np.uint32(32) - _TURNS
_START = np.array([0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476], np.uint32)
#: Texts that are worked on at once, as many as stay near the processor.
STRIP = 16_384
#: Bytes of a text that one round of the method takes.
ONE_BLOCK = 55


def _strip(words: np.ndarray) -> np.ndarray:
    """Four words a column, of texts of one block each."""
    a, b, c, d = (np.full(words.shape[1], s, np.uint32) for s in _START)
    f, t = np.empty_like(a), np.empty_like(a)
    for i in range(64):
        if i < 16:
            np.bitwise_xor(c, d, out=f)
            np.bitwise_and(f, b, out=f)
            np.bitwise_xor(f, d, out=f)
            at = i
        elif i < 32:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_and(f, d, out=f)
            np.bitwise_xor(f, c, out=f)
            at = (5 * i + 1) % 16
        elif i < 48:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_xor(f, d, out=f)
            at = (3 * i + 5) % 16
        else:
            np.bitwise_not(d, out=f)
            np.bitwise_or(f, b, out=f)
            np.bitwise_xor(f, c, out=f)
            at = 7 * i % 16
        np.add(f, a, out=f)
        np.add(f, words[at], out=f)
        np.add(f, _SINES[i : i + 1], out=f)
        np.left_shift(f, _TURNS[i : i + 1], out=t)
        np.right_shift(f, _BACK[i : i + 1], out=f)
        np.bitwise_or(f, t, out=f)
        np.add(f, b, out=f)
        a, d, c, b, f = d, c, b, f, a
    return np.stack([a, b, c, d]) + _START[:, None]


def digests(prefixes: list[bytes], texts: list[bytes]) -> Iterator[np.ndarray]:
    """For each prefix the digests of all texts that begin with it: two numbers a text, in the order of the digests."""
    longest = max(map(len, texts), default=0)
    if longest + max(map(len, prefixes), default=0) > ONE_BLOCK:
        for prefix in prefixes:
            yield np.frombuffer(b"".join([hashlib.md5(prefix + t, usedforsecurity=False).digest() for t in texts]), ">u8").reshape(-1, 2).astype(np.uint64)
        return
    n, width, words = len(texts), None, None
    length = np.fromiter(map(len, texts), int, n)
    own = np.array(texts, f"S{max(longest, 1)}").view(np.uint8).reshape(n, max(longest, 1))
    for prefix in prefixes:
        if len(prefix) != width:
            width = len(prefix)
            padded = np.zeros((n, 64), np.uint8)
            padded[:, width : width + own.shape[1]] = own
            padded[np.arange(n), width + length] = 0x80
            padded[:, 56:64] = ((length + width) * 8).astype("<u8")[:, None].view(np.uint8)
            words = np.ascontiguousarray(padded.view("<u4").T).astype(np.uint32)
        head = -(-width // 4)
        padded[:, :width] = np.frombuffer(prefix, np.uint8)
        words[:head] = padded[:, : 4 * head].copy().view("<u4").T
        out = np.empty((4, n), np.uint32)
        for at in range(0, n, STRIP):
            out[:, at : at + STRIP] = _strip(words[:, at : at + STRIP])
        turned = out.byteswap().astype(np.uint64) if np.little_endian else out.astype(np.uint64)
        yield np.stack([turned[0] << np.uint64(32) | turned[1], turned[2] << np.uint64(32) | turned[3]], axis=1)

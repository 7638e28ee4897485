"""Reproducible draws: the same keys give the same number in every engine and run."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def code(*parts: Column) -> Column:
    """Hex digest of the parts joined by '|'."""
    return F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))


def draw(digest: Column, digits: int = 15) -> Column:
    """Non-negative integer from the first hex digits."""
    return F.conv(F.substring(digest, 1, digits), 16, 10).cast("bigint")


_TURNS = np.repeat([[7, 12, 17, 22], [5, 9, 14, 20], [4, 11, 16, 23], [6, 10, 15, 21]], 4, axis=0).ravel()
_SINES = np.floor(np.abs(np.sin(np.arange(1, 65))) * 2.0**32).astype(np.uint32)
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
_BLOCK, _TILE = 55, 8192  # bytes of a text in a single block, texts digested at once


def digests(blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """MD5 of padded single blocks (n x 64 bytes) as two numbers that order like the digest."""
    words = np.ascontiguousarray(blocks.view("<u4").T)
    a, b, c, d = (np.full(words.shape[1], x, np.uint32) for x in _START)
    for i in range(64):
        kind = i // 16
        if kind == 0:
            f, g = d ^ (b & (c ^ d)), i
        elif kind == 1:
            f, g = c ^ (d & (b ^ c)), (5 * i + 1) % 16
        elif kind == 2:
            f, g = b ^ c ^ d, (3 * i + 5) % 16
        else:
            f, g = c ^ (b | ~d), 7 * i % 16
        f += a
        f += words[g]
        f += _SINES[i]
        turn = np.uint32(_TURNS[i])
        turned = f << turn
        turned |= f >> np.uint32(32 - turn)
        turned += b
        a, d, c, b = d, c, b, turned
    a, b, c, d = (np.uint32(x) + y for x, y in zip(_START, (a, b, c, d)))
    high, low = (x.byteswap().astype(np.uint64) << np.uint64(32) | y.byteswap() for x, y in ((a, b), (c, d)))
    return high, low


def codes(start: str, groups: np.ndarray, owner: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``code`` of ``start``, the id of a row's group and the row's own id, as two numbers that order like the digest."""
    heads = [f"{start}{g}|".encode() for g in groups.tolist()]
    widest = max(map(len, heads), default=0)
    if widest + 20 > _BLOCK or len(ids) and ids.min() < 0:
        whole = [hashlib.md5(heads[o] + str(i).encode()).digest() for o, i in zip(owner.tolist(), ids.tolist())]
        both = np.frombuffer(b"".join(whole), ">u8").astype(np.uint64).reshape(-1, 2)
        return both[:, 0].copy(), both[:, 1].copy()
    texts = np.array(heads, dtype=f"S{widest}").view(np.uint8).reshape(-1, widest) if heads else np.zeros((0, 1), np.uint8)
    width = np.array([len(h) for h in heads], np.int64)[owner]
    digits = np.searchsorted(10 ** np.arange(1, 19), ids, side="right") + 1
    first, second = np.empty((2, len(ids)), np.uint64)
    shape = width * 32 + digits
    for each in np.unique(shape):
        p, q = int(each) // 32, int(each) % 32
        whole = np.flatnonzero(shape == each)
        blocks = np.zeros((min(len(whole), _TILE), 64), np.uint8)
        blocks[:, p + q] = 0x80
        blocks[:, 56], blocks[:, 57] = 8 * (p + q) % 256, 8 * (p + q) // 256
        for low in range(0, len(whole), _TILE):
            at = whole[low : low + _TILE]
            block = blocks[: len(at)]
            block[:, :p] = texts[owner[at], :p]
            rest = ids[at] if q > 9 else ids[at].astype(np.uint32)
            for place in range(p + q - 1, p - 1, -1):
                left = rest // 10
                block[:, place] = rest - left * 10 + 48
                rest = left
            first[at], second[at] = digests(block)
    return first, second

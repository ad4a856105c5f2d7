"""Tokens of many texts at once, hashed in numpy without a Python object for each.

Equal tokens have equal hashes. Different ones may share a hash, by chance or by design of the text: what decides
anything must compare the tokens themselves, or a digest of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

BASE = 0xC6A4A7935BD1E995  # odd, so that it has an inverse modulo 2**64
INVERSE = pow(BASE, -1, 1 << 64)
CHUNK_BYTES = 1 << 20
BLOCK = 1 << 18  # bytes that are hashed at once

SPACES = np.zeros(256, dtype=np.int8)
SPACES[[9, 10, 11, 12, 13, 32]] = 1
#: 0 for the six ASCII spaces, 1 for all else.
BY_SPACE = (1 - SPACES).astype(np.int8)
#: 0 for spaces, 1 for ASCII letters, digits and all beyond ASCII, 2 for other signs.
BY_KIND = np.array([0 if SPACES[b] else 1 if b >= 128 or chr(b).isalnum() else 2 for b in range(256)], dtype=np.int8)


def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, base, dtype=np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


POWERS, INVERSES = _powers(BASE, BLOCK + 1), _powers(INVERSE, BLOCK + 1)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64 over all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def chunks(texts: list[bytes], size: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs [i, j) of texts of about ``size`` bytes, one text at least."""
    i, now = 0, 0
    for j, t in enumerate(texts):
        if j > i and now + len(t) > size:
            yield i, j
            i, now = j, 0
        now += len(t) + 1
    if i < len(texts):
        yield i, len(texts)


def blocks(line: bytes, kinds: np.ndarray = BY_SPACE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hash, first byte) of each token that ends in one more ``BLOCK`` of bytes, block by block: maximal runs of one kind other than 0.

    A token that goes on beyond a block is carried over, so memory depends on the block alone.
    """
    every = np.frombuffer(line, dtype=np.uint8)
    last, since, begin, value, power = 0, 0, 0, 0, 1  # of the token that reached the end of the block before: kind, start, hash so far, next power
    for lo in range(0, len(every), BLOCK):
        block = every[lo : lo + BLOCK]
        kind = kinds[block]
        edge = np.concatenate([[0], np.flatnonzero(kind[1:] != kind[:-1]) + 1, [len(block)]])
        starts, ends = edge[:-1], edge[1:]
        total = np.zeros(len(block) + 1, dtype=np.uint64)
        np.cumsum((block.astype(np.uint64) + np.uint64(1)) * POWERS[: len(block)], dtype=np.uint64, out=total[1:])
        of = (total[ends] - total[starts]) * INVERSES[starts]
        what, at = kind[starts], starts + lo
        if last and what[0] == last:  # the first run goes on with the carried token
            of[0] = np.uint64((value + int(of[0]) * power) % (1 << 64))
            at[0], begin = since, power
        else:
            begin = 1
            if last:
                of, what, at = np.append(np.uint64(value), of), np.append(np.int8(last), what), np.append(since, at)
        last, since, value = int(what[-1]), int(at[-1]), int(of[-1])
        power = int(POWERS[ends[-1] - starts[-1]]) * (begin if len(starts) == 1 else 1) % (1 << 64)
        whole = np.flatnonzero(what[:-1])
        yield mix(of[whole]), at[whole]
    if last:
        yield mix(np.array([value], dtype=np.uint64)), np.array([since])


def tokenize(texts: list[bytes], kinds: np.ndarray = BY_SPACE) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each token, first token of each text and the end): maximal runs of one kind other than 0."""
    bounds = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    line = texts[0] if len(texts) == 1 else b" ".join(texts)
    values, counts = [], np.zeros(len(texts), dtype=np.int64)
    for value, at in blocks(line, kinds):
        values.append(value)
        counts += np.bincount(np.searchsorted(bounds, at, side="right"), minlength=len(texts))
    return np.concatenate(values) if values else np.zeros(0, np.uint64), np.concatenate([[0], np.cumsum(counts)])

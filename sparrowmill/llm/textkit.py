"""Vectorised text work inside tasks: words, word hashes and shingles of many texts at once.

Words are runs of bytes other than ASCII white space. Hashes are 64-bit and the same on every machine.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_STEP = U(0x9E3779B97F4A7C15)
_ODD = [U(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x ^ (x >> U(30))
    x = x * _ODD[0]
    x = x ^ (x >> U(27))
    x = x * _ODD[1]
    return x ^ (x >> U(31))


def pack(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one buffer, a space after each, and where each starts (one more at the end)."""
    buffer = np.frombuffer(b" ".join(texts) + b" " if texts else b"", np.uint8)
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=starts[1:])
    return buffer, starts


_POWERS = {"n": 0}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_STEP to the powers 0..n-1 and their inverses, modulo 2^64."""
    if _POWERS["n"] < n:
        size = max(n, 1 << 16)
        up = np.full(size, _STEP, U)
        up[0] = 1
        down = np.full(size, U(pow(int(_STEP), -1, 1 << 64)), U)
        down[0] = 1
        _POWERS.update(n=size, up=np.multiply.accumulate(up), down=np.multiply.accumulate(down))
    return _POWERS["up"][:n], _POWERS["down"][:n]


def words(buffer: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every word: its text's index, its hash, its length in bytes."""
    if not len(buffer):
        return np.zeros(0, np.int64), np.zeros(0, U), np.zeros(0, np.int64)
    space = _SPACE[buffer]
    edge = np.flatnonzero(np.diff(space.astype(np.int8), prepend=1))  # the buffer ends with a space
    begin, end = edge[0::2], edge[1::2]
    up, down = _powers(len(buffer) + 1)
    sums = np.zeros(len(buffer) + 1, U)
    np.cumsum((buffer.astype(U) + U(1)) * up[:-1], out=sums[1:])
    h = mix((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(U))
    return np.searchsorted(starts, begin, side="right") - 1, h, end - begin


def shingles(owner: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of every n consecutive words of a text; a text with fewer words has one shingle of them all."""
    if not len(h):
        return owner, h
    if n == 1:
        return owner, mix(h)
    m = len(h) - n + 1
    out_o, out_h = np.zeros(0, owner.dtype), np.zeros(0, U)
    if m > 0:
        acc = np.zeros(m, U)
        for j in range(n):
            acc = mix(acc + h[j : j + m] * _ODD[j % 5] + U(j))
        whole = owner[:m] == owner[n - 1 :]
        out_o, out_h = owner[:m][whole], acc[whole]
    ids, first, count = np.unique(owner, return_index=True, return_counts=True)
    few = count < n
    if few.any():
        small = np.array([int(mix(np.array([np.bitwise_xor.reduce(mix(h[a : a + c] + U(7) * np.arange(1, c + 1, dtype=U)))], U))[0]) for a, c in zip(first[few], count[few], strict=True)], U)
        out_o, out_h = np.concatenate([out_o, ids[few]]), np.concatenate([out_h, small])
    return out_o, out_h


def batches(rows, size, most: int):
    """Lists of rows whose sizes add up to about `most`; a larger row stands alone."""
    held, total = [], 0
    for r in rows:
        n = size(r)
        if held and total + n > most:
            yield held
            held, total = [], 0
        held.append(r)
        total += n
    if held:
        yield held


def slices(b, rows: int = 256):
    """Parts of an Arrow batch, so that Python never holds all its texts."""
    for at in range(0, b.num_rows, rows):
        yield b.slice(at, rows)


def arrow_rows(record_batches, *columns: str):
    """Tuples of the columns of Arrow batches."""
    for b in record_batches:
        for part in slices(b):
            yield from zip(*[part.column(c).to_pylist() for c in columns], strict=True)

"""Vectorised word and shingle hashes of UTF-8 texts."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

SPAN = 5
#: Bytes of text that are hashed at once: some 40 times that in a worker.
_CHUNK = 1 << 18
_U = np.uint64
_TABLE = np.random.default_rng(20250101).integers(0, 2**63, 256, dtype=_U) * _U(2) + _U(1)
_BASE = 0x9E3779B97F4A7C15
_ROLES = np.random.default_rng(20250102).integers(0, 2**63, 16, dtype=_U) * _U(2) + _U(1)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_WORD = np.ones(256, np.int8)
_WORD[[9, 10, 11, 12, 13, 32]] = 0
_powers: list[np.ndarray] = [np.ones(1, _U), np.ones(1, _U)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64 bits."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 2 * _CHUNK)
        for i, base in enumerate((_BASE, pow(_BASE, -1, 2**64))):
            table = np.full(size, base, _U)
            table[0] = 1
            _powers[i] = np.multiply.accumulate(table)
    return _powers


def _words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and first bytes of the words of one buffer, A-Z lower-cased."""
    a = _FOLD[np.frombuffer(data, np.uint8)]
    edge = np.diff(_WORD[a], prepend=np.int8(0), append=np.int8(0))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = _power_tables(len(a))
    sums = np.zeros(len(a) + 1, _U)
    np.cumsum(_TABLE[a] * up[: len(a)], out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(_U)), start


def word_hashes(texts: Iterable[bytes | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For chunks of whole texts: the hashes of their words in a row, and the number of words of each text."""

    def small(batch: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        hashes, start = _words(b" ".join(batch))
        ends = np.cumsum([len(b) + 1 for b in batch])
        return hashes, np.diff(np.searchsorted(start, ends), prepend=0)

    batch: list[bytes] = []
    held = 0
    for text in texts:
        text = text or b""
        if batch and held + len(text) > _CHUNK:
            yield small(batch)
            batch, held = [], 0
        if len(text) > _CHUNK:  # in pieces that end at white space, so memory stays bounded
            parts, at = [], 0
            while at < len(text):
                to = min(at + _CHUNK, len(text))
                while to < len(text) and _WORD[text[to]]:
                    to += 1
                parts.append(_words(text[at:to])[0])
                at = to
            hashes = np.concatenate(parts)
            yield hashes, np.array([len(hashes)])
        else:
            batch.append(text)
            held += len(text) + 1
    if batch:
        yield small(batch)


def shingle_sets(texts: Iterable[bytes | None], span: int = SPAN) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text. A text of fewer words is one shingle; one without words has none."""
    for hashes, counts in word_hashes(texts):
        rows = len(hashes) - span + 1
        if rows > 0:
            x = hashes[:rows] * _ROLES[0]
            for j in range(1, span):
                x = mix(x) + hashes[j : rows + j] * _ROLES[j]
            x = mix(x)
        at = 0
        for n in counts.tolist():
            if n >= span:
                s = np.sort(x[at : at + n - span + 1])
                yield s[np.append(True, s[1:] != s[:-1])]
            elif n:
                y = np.full(1, n, _U)
                for j in range(n):
                    y = mix(y) + hashes[at + j : at + j + 1] * _ROLES[8 + j % 8]
                yield mix(y)
            else:
                yield np.empty(0, _U)
            at += n

"""Word shingle sets of whole texts as sorted 64-bit hashes, in numpy."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

_PIECE = 1 << 20  # bytes hashed at once
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_rng = np.random.default_rng(20240229)  # fixed: hashes must agree between workers
_VALUE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_VALUE[ord("A") : ord("Z") + 1] = _VALUE[ord("a") : ord("z") + 1]  # A-Z are lower-cased
_BASE = np.uint64(0x9E3779B97F4A7C15 | 5)
_MIX = [np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if len(_powers.get("up", ())) < n:
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        size = max(n, 1 << 16)
        _powers["up"] = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, _BASE)], dtype=np.uint64)
        _powers["down"] = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, inverse)], dtype=np.uint64)
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def _words(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(hashes, starts)`` of the words of one stretch of bytes."""
    edge = np.diff(np.r_[False, ~_SEPARATOR[raw], False].astype(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = _power(len(raw) + 1)
    total = np.r_[np.uint64(0), np.cumsum(_VALUE[raw] * up[: len(raw)], dtype=np.uint64)]
    length = (end - start).astype(np.uint64)
    return mix((total[end] - total[start]) * down[start] + length * _MIX[1]), start


def _stretches(texts: list[bytes]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """Texts joined by blanks up to about ``_PIECE`` bytes, or parts of one long text cut at blanks."""
    group: list[int] = []
    size = 0
    for i, t in enumerate(texts):
        if group and size + len(t) > _PIECE:
            yield _joined(texts, group)
            group, size = [], 0
        if len(t) <= _PIECE:
            group.append(i)
            size += len(t) + 1
            continue
        at, raw = 0, np.frombuffer(t, np.uint8)
        while at < len(t):
            end = min(len(t), at + _PIECE)
            if end < len(t):
                gaps = np.flatnonzero(_SEPARATOR[raw[at:end]])
                if len(gaps):
                    end = at + int(gaps[-1]) + 1
                else:  # one word longer than a piece
                    rest = np.flatnonzero(_SEPARATOR[raw[end:]])
                    end = end + int(rest[0]) if len(rest) else len(t)
            yield [i], np.array([0]), raw[at:end]
            at = end
    if group:
        yield _joined(texts, group)


def _joined(texts, group):
    starts = np.cumsum([0, *(len(texts[i]) + 1 for i in group[:-1])])
    return group, starts, np.frombuffer(b" ".join(texts[i] for i in group), np.uint8)


def word_hashes(texts: list[bytes]) -> list[np.ndarray]:
    found: list[list[np.ndarray]] = [[] for _ in texts]
    with np.errstate(over="ignore"):
        for group, starts, raw in _stretches(texts):
            hashes, at = _words(raw)
            cut = np.searchsorted(at, starts[1:])
            for i, part in zip(group, np.split(hashes, cut), strict=True):
                found[i].append(part)
    return [p[0] if len(p) == 1 else np.concatenate(p) if p else np.zeros(0, np.uint64) for p in found]


def shingle_sets(texts: list[str | None], k: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its ``k``-word shingles.

    Fewer than ``k`` words: the whole sequence is the one shingle; no word or null: an empty array.
    """
    out = []
    with np.errstate(over="ignore"):
        for w in word_hashes([b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]):
            n = min(k, len(w))
            if not n:
                out.append(w)
                continue
            h = np.zeros(len(w) - n + 1, np.uint64)
            for i in range(n):
                h = mix(h * _BASE + w[i : len(w) - n + 1 + i])
            out.append(np.unique(h * np.uint64(2 * k + 1) + np.uint64(n)))
    return out


def digest(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()

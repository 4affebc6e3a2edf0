"""Vectorised word hashing: words of many texts as 64-bit hashes in a few numpy passes over their bytes.

A word's hash is a polynomial over a table of random byte values, taken from one running sum by position, then mixed.
Two different words agree with probability about 2**-64.
"""

from __future__ import annotations

import numpy as np

from corpusloom.llm.common import groups_by_bytes

U = np.uint64
_rng = np.random.default_rng(20240229)
_table = _rng.integers(0, 2**64, 256, dtype=U)
_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
_P = U(0x9E3779B97F4A7C15)
_PI = U(pow(int(_P), -1, 2**64))
_pow = np.ones(0, U)
_inv = np.ones(0, U)
STEP = 1 << 20

#: Bytes of words: everything but ASCII white space (space and 9 to 13) ...
SPACED = np.ones(256, bool)
SPACED[[32, *range(9, 14)]] = False
#: ... or digits, lower-case letters and every byte above 127.
ALPHANUMERIC = np.zeros(256, bool)
ALPHANUMERIC[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """Finish a hash (the splitmix64 finaliser)."""
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


def _powers(n: int) -> None:
    global _pow, _inv
    if len(_pow) < n:
        size = max(n, STEP + (1 << 16))
        steps = np.full(size, _P, U)
        steps[0] = 1
        back = np.full(size, _PI, U)
        back[0] = 1
        _pow, _inv = np.multiply.accumulate(steps), np.multiply.accumulate(back)


def _chunk(data: bytes, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, last three bytes as a number) of each word of a chunk that ends with a separator."""
    b = _lower[np.frombuffer(data, np.uint8)]
    _powers(len(b))
    flags = np.zeros(len(b) + 1, np.int8)
    flags[1:] = word[b]
    edges = np.flatnonzero(flags[1:] != flags[:-1])
    starts, ends = edges[0::2], edges[1::2]
    c = np.zeros(len(b) + 1, U)
    np.cumsum(_table[b] * _pow[: len(b)], out=c[1:])
    h = (c[ends] - c[starts]) * _inv[starts]
    size = ends - starts
    tail = b[ends - 1].astype(np.uint32)
    for k in (2, 3):
        tail = (tail << np.uint32(8)) | np.where(size >= k, b[np.maximum(ends - k, 0)], 0).astype(np.uint32)
    return mix(h ^ (size.astype(U) * U(0xD6E8FEB86659FD93))), starts, tail


def word_hashes(texts: list[bytes], word: np.ndarray = SPACED) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word in order, words of each text); A-Z count as a-z."""
    return words_and_tails(texts, word)[:2]


def words_and_tails(texts: list[bytes], word: np.ndarray = SPACED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``word_hashes``, and the last three bytes of each word as a number."""
    hashes, counts, tails = [np.zeros(0, U)], np.zeros(len(texts), np.int64), [np.zeros(0, np.uint32)]
    for a, b in groups_by_bytes(texts, STEP):
        if b - a == 1 and len(texts[a]) > 4 * STEP:
            for piece in _cut(texts[a], word):
                h, _, tail = _chunk(piece + b"\n", word)
                hashes.append(h)
                tails.append(tail)
                counts[a] += len(h)
            continue
        h, starts, tail = _chunk(b"\n".join(texts[a:b]) + b"\n", word)
        hashes.append(h)
        tails.append(tail)
        bounds = np.cumsum([0] + [len(t) + 1 for t in texts[a:b]])
        counts[a:b] = np.diff(np.searchsorted(starts, bounds))
    return np.concatenate(hashes), counts, np.concatenate(tails)


def _cut(text: bytes, word: np.ndarray):
    """A very long text in pieces that end before a separator."""
    at = 0
    while at < len(text):
        end = at + STEP
        while end < len(text) and word[_lower[text[end]]]:
            end += 1
        yield text[at:end]
        at = end


def shingles(h: np.ndarray, counts: np.ndarray, k: int = 5) -> list[np.ndarray]:
    """Sorted distinct k-word shingle hashes of each text; a text of fewer words has its whole sequence as one."""
    starts = np.concatenate([[0], np.cumsum(counts)])
    run = np.zeros(max(0, len(h) - k + 1), U)
    for j in range(k if len(run) else 0):
        run = run * U(0xD1342543DE82EF95) + h[j : len(h) - k + 1 + j]
        run ^= run >> U(29)
    run = mix(run)
    out = []
    for s, n in zip(starts[:-1].tolist(), counts.tolist(), strict=True):
        if n >= k:
            out.append(np.unique(run[s : s + n - k + 1]))
        elif n:
            one = np.array([n], U)
            for j in range(n):
                one = one * U(0xA0761D6478BD642F) + h[s + j : s + j + 1]
                one ^= one >> U(32)
            out.append(mix(one))
        else:
            out.append(np.zeros(0, U))
    return out

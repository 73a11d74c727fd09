"""Shingle sets and SuperMinHash signatures, vectorised for a batch of texts (numpy, inside tasks)."""

from __future__ import annotations

import numpy as np
import xxhash

SHINGLE_WORDS = 5
KEPT_WORDS = 500_000
#: Elements whose partial permutations are in memory at once.
GROUP_ELEMENTS = 1 << 15

_U = np.uint64
_GOLD = _U(0x9E3779B97F4A7C15)
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93,
                 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=_U)
EMPTY = np.iinfo(np.uint64).max


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (splitmix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class WordHashes(dict):
    """64-bit hash of a word's bytes; remembers a bounded number of words."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) >= KEPT_WORDS:
            self.clear()
        self[word] = h
        return h


def shingle_set(text: bytes, hashes: WordHashes, size: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams; fewer words make one shingle, none make an empty set.

    ``bytes.lower`` folds A-Z alone and ``bytes.split`` splits at ASCII white space alone.
    """
    words = text.lower().split()
    h = np.fromiter(map(hashes.__getitem__, words), dtype=_U, count=len(words))
    if not len(h):
        return h
    if len(h) < size:
        return mix((h * _ODD[:len(h)]).sum(keepdims=True, dtype=_U) + _U(len(h)))
    n = len(h) - size + 1
    acc = h[:n] * _ODD[0]
    for k in range(1, size):
        acc += h[k:k + n] * _ODD[k]
    return np.unique(mix(acc))


def _step(j: int) -> np.uint64:
    return _U(0x9E3779B97F4A7C15 * (j + 1) & 0xFFFFFFFFFFFFFFFF)


def set_hash(elements: np.ndarray) -> int:
    """Signed 64-bit hash of a set."""
    total = mix(elements + _GOLD).sum(keepdims=True, dtype=_U) + _step(len(elements))
    return int(mix(total).view(np.int64)[0])


def signatures(sets: list[np.ndarray], m: int) -> np.ndarray:
    """SuperMinHash signatures (len(sets) x m, uint64); an empty set keeps EMPTY.

    At level j each element visits the j-th place of its own random permutation
    of the m positions with the value j + r, r in [0, 1), stored as (j, 52 bits).
    Values of a level are above those of all levels before, so a document whose
    positions are all taken after a level stops early.
    """
    out = np.full((len(sets), m), EMPTY, dtype=_U)
    order = np.argsort([len(s) for s in sets], kind="stable")
    group: list[int] = []
    held = 0
    for d in order:
        if len(sets[d]):
            group.append(d)
            held += len(sets[d])
        if held >= GROUP_ELEMENTS:
            out[group] = _group(sets, group, m)
            group, held = [], 0
    if group:
        out[group] = _group(sets, group, m)
    return out


def _group(sets: list[np.ndarray], group: list[int], m: int) -> np.ndarray:
    sig = np.full(len(group) * m, EMPTY, dtype=_U)
    el = np.concatenate([sets[d] for d in group])
    doc = np.repeat(np.arange(len(group)), [len(sets[d]) for d in group])
    perm = None
    for j in range(m):
        rnd = mix(el + _step(j))
        k = j + ((rnd & _U(0xFFFFFFFF)) * _U(m - j) >> _U(32)).astype(np.intp)
        if perm is None:
            place = k
        else:
            rows = np.arange(len(el))
            place = perm[rows, k]
            perm[rows, k] = perm[:, j]
            perm[:, j] = place
        np.minimum.at(sig, doc * m + place, (_U(j) << _U(52)) | (rnd >> _U(12)))
        open_docs = (sig.reshape(-1, m) == EMPTY).any(axis=1)
        if not open_docs.any():
            break
        stay = open_docs[doc]
        if perm is None:
            el, doc, k = el[stay], doc[stay], k[stay]
            perm = np.tile(np.arange(m, dtype=np.uint16), (len(el), 1))
            perm[np.arange(len(el)), k] = 0
            perm[:, 0] = k
        elif not stay.all():
            el, doc, perm = el[stay], doc[stay], perm[stay]
    return sig.reshape(-1, m)


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One signed 64-bit key per document and band (the band's number is part of the key)."""
    v = sig[:, :bands * rows].reshape(len(sig), bands, rows)
    acc = (v * _ODD[:rows]).sum(axis=2, dtype=_U) + np.array([_step(b) for b in range(bands)], dtype=_U)
    return mix(acc).view(np.int64)


def two_bit_sketch(sig: np.ndarray) -> np.ndarray:
    """Two bits of every signature value, packed into signed 64-bit integers (len(sig) x m / 32)."""
    bits = (sig & _U(3)).reshape(len(sig), -1, 32) << np.arange(0, 64, 2, dtype=_U)
    return np.bitwise_or.reduce(bits, axis=2).view(np.int64)


def most_differences(m: int, similarity: float, deviations: float = 4.5) -> int:
    """Differing two-bit values that a pair of this similarity exceeds with a probability below 1e-5."""
    p = (1 - similarity) * 0.75
    return int(m * p + deviations * (m * p * (1 - p)) ** 0.5)

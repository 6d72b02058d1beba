"""Whole texts as numpy arrays: words, word hashes, shingle sets, SuperMinHash.

Everything here works on blocks of texts of about half a megabyte (or one longer text), so
memory is bounded by the longest text and not by the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 19
#: Elements whose permutations are held at once, a byte for each place.
SKETCH_ROWS = 1 << 18
_U = np.uint64
_GOLD = _U(0x9E3779B97F4A7C15)
_BASE = _U(0x2545F4914F6CDD1D)
_BASE_INV = _U(pow(int(_BASE), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit words in which each bit of the input moves every bit of the output."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def stream(seed: int, n: int) -> np.ndarray:
    """The first n words of the pseudo-random stream of a seed."""
    return mix(_U(seed) + _GOLD * np.arange(1, n + 1, dtype=np.uint64))


_BYTE = stream(11, 256)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_PLACE = stream(23, 64) | _U(1)


def blocks(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, bytes, offsets) of each block of an Arrow string array; null is empty."""
    texts = texts.fill_null("") if texts.null_count else texts
    wide = pa.types.is_large_string(texts.type)
    at = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(at, at[i] + BLOCK_BYTES, "right")) - 1)
        yield i, j - i, data[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, start byte, end byte) of each maximal run of bytes that are not white space."""
    solid = ~_SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    first[at] = True
    before = np.zeros(len(data), bool)
    before[1:] = solid[:-1]
    after = np.zeros(len(data), bool)
    after[:-1] = solid[1:]
    start = np.flatnonzero(solid & (~before | first[:-1]))
    end = np.flatnonzero(solid & (~after | first[1:])) + 1
    return np.searchsorted(at, start, "right") - 1, start, end


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each word, by prefix sums of a polynomial over all bytes."""
    if not len(start):
        return np.zeros(0, np.uint64)
    power = np.full(len(data), _BASE)
    power[0] = 1
    np.multiply.accumulate(power, out=power)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[_LOWER[data] if lower else data] * power, out=sums[1:])
    shift = np.full(len(data), _BASE_INV)
    shift[0] = 1
    np.multiply.accumulate(shift, out=shift)
    return mix((sums[end] - sums[start]) * shift[start] + (end - start).astype(np.uint64))


def shingles(doc: np.ndarray, hashes: np.ndarray, n_docs: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of each k-word shingle in text order; a shorter text is one shingle."""
    n = len(hashes)
    total = np.zeros(max(0, n - k + 1), np.uint64)
    for j in range(k):
        total += hashes[j : n - k + 1 + j] * _PLACE[j]
    whole = doc[: len(total)] == doc[k - 1 :] if n >= k else np.zeros(0, bool)
    docs, got = doc[: len(total)][whole], mix(total[whole] + _U(k))
    count = np.bincount(doc, minlength=n_docs)
    if ((count > 0) & (count < k)).any():
        short = np.flatnonzero(count[doc] < k)
        place = short - np.searchsorted(doc, doc[short])
        sums = np.zeros(n_docs, np.uint64)
        np.add.at(sums, doc[short], hashes[short] * _PLACE[place])
        few = np.flatnonzero((count > 0) & (count < k))
        docs = np.concatenate([docs, few])
        got = np.concatenate([got, mix(sums[few] + count[few].astype(np.uint64))])
    return docs, got


def as_sets(docs: np.ndarray, got: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same, sorted and without repeats in a document."""
    order = np.lexsort((got, docs))
    docs, got = docs[order], got[order]
    new = np.ones(len(docs), bool)
    new[1:] = (docs[1:] != docs[:-1]) | (got[1:] != got[:-1])
    return docs[new], got[new]


def shingle_sets(texts: pa.Array, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, document, shingle hash) of each block, as sets."""
    for first, n, data, at in blocks(texts):
        doc, start, end = words(data, at)
        yield first, n, *as_sets(*shingles(doc, word_hashes(data, start, end), n, k))


def super_min_hash(docs: np.ndarray, elements: np.ndarray, n_docs: int, m: int) -> np.ndarray:
    """SuperMinHash signatures, n_docs x m, of sets given as (document, element hash).

    Each element walks its own random permutation of the m places (a Fisher-Yates shuffle
    made step by step); in step j it offers the value j + r, r in [0, 1), to its j-th place.
    The ranks of one element are therefore correlated over places: it holds each integer
    part once. Up to SKETCH_ROWS elements take step j together; a document stops as soon as
    each place has a value below j, as later steps only offer larger ones. Values are kept as
    integers, j in the upper 16 bits and r in the lower 48. Without elements: all ones.
    """
    sig = np.full(n_docs * m, ~_U(0))
    for at in range(0, len(docs), SKETCH_ROWS):  # later elements stop all the earlier
        _offer(sig, docs[at : at + SKETCH_ROWS], elements[at : at + SKETCH_ROWS], n_docs, m)
    return sig.reshape(n_docs, m)


def _offer(sig: np.ndarray, docs: np.ndarray, elements: np.ndarray, n_docs: int, m: int) -> None:
    """Lower the signatures to what the elements offer. Step j offers j or more, so a document whose values are all lower is done."""
    place = np.broadcast_to(np.arange(m, dtype=np.uint8 if m <= 256 else np.uint16), (len(docs), m)).copy()
    seed = mix(elements ^ _U(0x5851F42D4C957F2D))
    live = np.arange(len(docs))
    for j in range(m):
        if j:
            open_ = (sig.reshape(n_docs, m) >> _U(48)).max(axis=1) >= _U(j)
            live = live[open_[docs[live]]]
        if not len(live):
            break
        x = mix(seed[live] + _U(int(_GOLD) * (j + 1) & 0xFFFFFFFFFFFFFFFF))
        k = j + ((x & _U(0xFFFF)) * _U(m - j) >> _U(16)).astype(np.int64)
        slot = place[live, k]
        place[live, k] = place[live, j]
        place[live, j] = slot
        np.minimum.at(sig, docs[live] * m + slot, (_U(j) << _U(48)) | (x >> _U(16)))


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """n x bands keys; equal only if the band's rows are (but for chance)."""
    total = np.zeros((len(sig), bands), np.uint64)
    parts = sig[:, : bands * rows].reshape(len(sig), bands, rows)
    for j in range(rows):
        total += mix(parts[:, :, j] + _U(j)) * _PLACE[j]
    return mix(total + _GOLD * np.arange(1, bands + 1, dtype=np.uint64))


def set_digests(docs: np.ndarray, got: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit digests of each set."""
    one, two = np.zeros(n_docs, np.uint64), np.zeros(n_docs, np.uint64)
    if len(got):
        starts = np.flatnonzero(np.r_[True, docs[1:] != docs[:-1]])
        one[docs[starts]] = np.add.reduceat(mix(got + _U(0xA5A5)), starts)
        two[docs[starts]] = np.add.reduceat(mix(got ^ _U(0xC3C3C3C3C3C3C3C3)), starts)
    return one, two


def overlaps(a: list[pa.Array], k: int) -> tuple[np.ndarray, np.ndarray]:
    """(size of the intersection, of the union) of the shingle sets of two text arrays, row by row."""
    n = len(a[0])
    rows, got = [], []
    for texts in a:
        parts = [(docs + first, h) for first, _, docs, h in shingle_sets(texts, k)]
        rows.append(np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.int64))
        got.append(np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, np.uint64))
    all_rows, all_got = np.concatenate(rows), np.concatenate(got)
    order = np.lexsort((all_got, all_rows))
    all_rows, all_got = all_rows[order], all_got[order]
    twice = (all_rows[1:] == all_rows[:-1]) & (all_got[1:] == all_got[:-1]) if len(all_rows) else np.zeros(0, bool)
    both = np.bincount(all_rows[1:][twice], minlength=n) if len(all_rows) else np.zeros(n, np.int64)
    return both, np.bincount(all_rows, minlength=n) - both

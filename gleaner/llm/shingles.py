"""Hashed word shingles of whole Arrow batches, without a Python step per word.

A batch's texts are lower-cased (A-Z) and cut at white space by Arrow, and its distinct
words get 64-bit keyed BLAKE2 hashes; shingles combine the hashes of neighbouring words.
No two words collide by construction, as they can with a polynomial; two different
shingles of one pair of documents share a value with a chance of about n^2 / 2^65.  Where
sets have to be compared exactly, :func:`exact_sets` proves for its texts that no two
words and no two shingles share a value, and takes the shingles themselves if they do.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
KEY = b"word shingles"
#: Hashes of recent words that a worker keeps.
CACHE_WORDS = 300_000
_KNOWN: dict[bytes, int] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def pieces(column: pa.Array, most: int = 1 << 20) -> Iterator[pa.Array]:
    """Runs of rows of at most ``most`` bytes, or one longer row; null is empty."""
    col = pc.fill_null(column, "")
    ends = np.cumsum(pc.binary_length(col).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(col):
        to = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right"))
        to = min(max(to, at + 1), len(col))
        yield col.slice(at, to - at)
        at = to


def word_lists(texts: pa.Array) -> pa.Array:
    """Words of every text, A-Z lower-cased; empty pieces beside white space at the ends are still there."""
    return pc.ascii_split_whitespace(pc.ascii_lower(texts))


def _hash(word: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(word, digest_size=8, key=KEY).digest(), "little")


def words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words, index of each word among them, first word of each text with the end)."""
    lists = word_lists(texts)
    flat = lists.flatten()
    full = pc.not_equal(flat, "")
    offsets = lists.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    offsets = offsets - offsets[0]
    before = np.concatenate(([0], np.cumsum(full.to_numpy(zero_copy_only=False))))
    coded = flat.filter(full).dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), before[offsets]


def hashes(distinct: pa.Array) -> np.ndarray:
    """64-bit hashes of distinct words."""
    if not len(distinct):
        return np.empty(0, U)
    raw = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(distinct)], pa.int32()), distinct), " ")[0].as_py().encode().split(b" ")
    if len(_KNOWN) > CACHE_WORDS:
        _KNOWN.clear()
    out = list(map(_KNOWN.get, raw))
    for i, h in enumerate(out):
        if h is None:
            out[i] = _KNOWN[raw[i]] = _hash(raw[i])
    return np.array(out, U)


def _factors(width: int) -> list:
    return [U(pow(0xA0761D6478BD642F, k + 1, 1 << 64) | 1) for k in range(width)]


def _combined(h: np.ndarray, width: int) -> np.ndarray:
    m = len(h) - width + 1
    whole = np.zeros(max(m, 0), U)
    for k, f in enumerate(_factors(width)):
        if m > 0:
            whole += h[k : k + m] * f
    return mix(whole)


def _short(h: np.ndarray, width: int) -> np.ndarray:
    """The one shingle of a text with fewer words."""
    value = U(len(h))
    for x, f in zip(h, _factors(width), strict=False):
        value = value + x * f
    return mix(np.array([value ^ U(0x5851F42D4C957F2D)], U))


def shingle_sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes (uint64) of every row, in order."""
    for texts in pieces(column):
        distinct, at, first = words(texts)
        h = hashes(distinct)[at]
        whole = _combined(h, width)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= width:
                s = np.sort(whole[a : b - width + 1])
                yield s[np.concatenate(([True], s[1:] != s[:-1]))]
            elif b > a:
                yield _short(h[a:b], width)
            else:
                yield np.empty(0, U)


def digests(texts: pa.Array) -> list[bytes | None]:
    """128-bit BLAKE2 digests of the sequences of words of texts; None without words."""
    lists = word_lists(texts)
    joined = pc.utf8_trim(pc.binary_join(lists, " "), " ").cast(pa.large_string())
    offsets = np.frombuffer(joined.buffers()[1], np.int64)[joined.offset : joined.offset + len(joined) + 1].tolist()
    data = memoryview(joined.buffers()[2] or b"")
    return [hashlib.blake2b(data[a:b], digest_size=16).digest() if b > a else None for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def exact_sets(texts: pa.Array, width: int) -> list[np.ndarray] | list[frozenset]:
    """Sets of shingles of texts that are compared with each other: arrays of distinct values, of which two are equal only if their shingles are.

    The values are hashes.  That they differ wherever words or shingles differ is checked on
    these texts; the sets of the shingles themselves are returned if it is not so.
    """
    distinct, at, first = words(texts)
    own = hashes(distinct)
    h = own[at]
    starts, sizes = first[:-1], np.diff(first)
    long = np.flatnonzero(sizes >= width)
    k = sizes[long] - width + 1
    place = np.repeat(starts[long] - (np.cumsum(k) - k), k) + np.arange(k.sum()) if len(long) else np.empty(0, np.int64)
    whole = _combined(h, width)
    values = whole[place]
    order = np.argsort(values, kind="stable")
    v, p = values[order], place[order]
    same = np.flatnonzero(v[1:] == v[:-1])
    clear = len(np.unique(own)) == len(own) and all((at[p[same] + j] == at[p[same + 1] + j]).all() for j in range(width))
    brief = {i: _short(h[starts[i] : starts[i] + sizes[i]], width) for i in np.flatnonzero((sizes > 0) & (sizes < width)).tolist()}
    named = {tuple(at[starts[i] : starts[i] + sizes[i]].tolist()): int(x[0]) for i, x in brief.items()}
    clear = clear and len(set(named.values())) == len(named) and not np.isin(np.array(list(named.values()), U), v).any()
    if not clear:
        seqs = [at[a:b].tolist() for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
        return [frozenset(tuple(q[i : i + width]) for i in range(len(q) - width + 1)) if len(q) >= width else frozenset([tuple(q)] if q else []) for q in seqs]
    out = []
    for i, (a, n) in enumerate(zip(starts.tolist(), sizes.tolist(), strict=True)):
        if n >= width:
            s = np.sort(whole[a : a + n - width + 1])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        else:
            out.append(brief.get(i, np.empty(0, U)))
    return out

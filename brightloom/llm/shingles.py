"""Word shingles of whole texts as 64-bit hashes, in numpy on Arrow batches."""

from __future__ import annotations

import ctypes
import gc
import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash

U64 = np.uint64
_MUL = U64(0x9E3779B97F4A7C15)
_SHORT = 0x5851F42D4C957F2D


def release() -> None:
    """Give freed memory back at the end of a task, for Python workers live on and share an executor's memory."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers (the finaliser of splitmix64)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class WordHashes(dict):
    """word -> 64-bit hash; forgets all when it holds ``most`` words, so that its memory is bounded."""

    def __init__(self, most: int = 150_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def words(text: bytes | None) -> list[bytes]:
    """A-Z lowered, then the runs without blanks (0x20, 0x09-0x0D)."""
    return text.lower().split() if text else []


def as_binary(column: pa.Array) -> pa.Array:
    return column.cast(pa.binary()) if pa.types.is_string(column.type) else column.cast(pa.large_binary())


def pieces(texts: list[bytes | None], most_bytes: int = 2_000_000, most_texts: int = 500) -> Iterator[tuple[int, int]]:
    """Runs of at most so many texts, of about so many bytes, one text at least."""
    at = held = 0
    for k, t in enumerate(texts):
        held += len(t) if t else 0
        if held >= most_bytes or k - at + 1 >= most_texts:
            yield at, k + 1
            at, held = k + 1, 0
    if at < len(texts):
        yield at, len(texts)


def shingle_sets(texts: list[bytes | None], size: int, cache: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text, sorted, one after another, and where each text's begin.

    A text of fewer words than ``size`` has its whole sequence as its one shingle, a text without words has none."""
    split = [words(t) for t in texts]
    lens = np.array([len(w) for w in split], dtype=np.int64)
    flat = np.fromiter(map(cache.__getitem__, chain.from_iterable(split)), dtype=U64, count=int(lens.sum()))
    n = len(flat) - size + 1
    grams = np.zeros(max(n, 0), dtype=U64)
    if n > 0:
        for j in range(size):
            grams *= _MUL
            grams += flat[j : j + n]
        grams = mix(grams)
    out, at = [], 0
    for k in lens.tolist():
        if k >= size:
            out.append(np.unique(grams[at : at + k - size + 1]))
        elif k:
            acc = U64(_SHORT + k)
            with np.errstate(over="ignore"):
                for x in flat[at : at + k]:
                    acc = mix(np.array([acc * _MUL + x], dtype=U64))[0]
            out.append(np.array([acc], dtype=U64))
        else:
            out.append(np.zeros(0, dtype=U64))
        at += k
    starts = np.zeros(len(out) + 1, dtype=np.int64)
    np.cumsum([len(x) for x in out], out=starts[1:])
    return (np.concatenate(out) if out else np.zeros(0, dtype=U64)), starts


def set_name(values: np.ndarray) -> bytes:
    """128 bits that name a set of shingles."""
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()

"""What the operators share: tables in the shared folder, slices of Arrow batches, words and hashes."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ..storage import drop, new_path, shared_dir, stored

__all__ = ["drop", "encoded", "gram_hashes", "mixed", "new_path", "shared_dir", "slices", "stored", "word_hash"]


def slices(batch: pa.RecordBatch, column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose column has about limit bytes together, one row at least."""
    if not batch.num_rows:
        return
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        before = sizes[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(sizes, before + limit, "right")))
        yield batch.slice(at, end - at)
        at = end


def encoded(column: pa.Array) -> list[bytes | None]:
    """Texts as UTF-8."""
    return column.cast(pa.binary()).to_pylist()


def word_hash(word: bytes) -> int:
    return int.from_bytes(blake2b(word, digest_size=8).digest(), "little")


class WordHash(dict):
    """64-bit hash by word, kept for up to limit words: some 15 MB of short ones."""

    def __init__(self, limit: int = 1 << 16) -> None:
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        value = word_hash(word)
        if len(word) <= 64:  # a long word is rare, and only its hash is small
            if len(self) >= self.limit:
                self.clear()
            self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64; its constants are fixed values)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash for each n consecutive word hashes; empty if there are fewer."""
    count = len(words) - n + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(count, np.uint64)
    for i in range(n):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += words[i : i + count]
    return mixed(out)

"""Words of many texts at once, as numpy arrays over the UTF-8 bytes of an Arrow batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

CHUNK = 1 << 20
BASE = 0x9E3779B97F4A7C15  # odd
_rng = np.random.default_rng(20240229)
_TABLE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_MIX = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: list[np.ndarray] = []

#: Bytes that end a word: ASCII whitespace only, or all ASCII but letters and digits.
SPACES = np.zeros(256, bool)
SPACES[[32, *range(9, 14)]] = True
MARKS = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit words over all bits (the finaliser of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, 2 * CHUNK)
        with np.errstate(over="ignore"):
            up = np.cumprod(np.full(size, BASE, np.uint64))
            down = np.cumprod(np.full(size, pow(BASE, -1, 2**64), np.uint64))
        _powers[:] = [up, down]
    return _powers[0], _powers[1]


class Chunk:
    """Some texts: raw bytes, and for each word its text, start, end and hash.

    first[i]:first[i + 1] are the words of text i. Words never reach over texts. Hashes are of A-Z
    lower-cased bytes, polynomial modulo 2**64 and then mixed; spans() hashes any byte spans.
    """

    def __init__(self, raw: np.ndarray, at: np.ndarray, ends: np.ndarray):
        self.raw, self.at = raw, at.astype(np.int64)
        self.n = len(at) - 1
        word = ~ends[raw] if len(raw) else np.zeros(0, bool)
        before, after = np.empty_like(word), np.empty_like(word)
        before[1:], after[:-1] = word[:-1], word[1:]
        edges = self.at[(self.at < len(raw))]
        before[edges] = False
        edges = self.at[(self.at > 0)] - 1
        after[edges] = False
        self.start = np.flatnonzero(word & ~before)
        self.end = np.flatnonzero(word & ~after) + 1
        self.first = np.searchsorted(self.start, self.at)
        up, down = _power(len(raw) + 1)
        self.down = down
        self.sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_TABLE[_FOLD[raw]] * up[: len(raw)], out=self.sums[1:])

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])

    def hashes(self) -> np.ndarray:
        return self.spans(self.start, self.end)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.n), np.diff(self.first))

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash, text) of all runs of k words; a text with 1 to k - 1 words gives one run of all."""
        h, counts = self.hashes(), np.diff(self.first)
        if len(h) < k:
            runs = np.zeros(0, np.uint64)
            owner = np.zeros(0, np.int64)
        else:
            m = len(h) - k + 1
            runs = h[:m] * _MIX[0]
            for j in range(1, k):
                runs = runs + h[j : j + m] * _MIX[j]
            text = self.text_of_word()
            same = text[:m] == text[k - 1 :]
            runs, owner = mix(runs[same]), text[:m][same]
        short = np.flatnonzero((counts > 0) & (counts < k))
        if len(short):
            place = np.zeros(0, np.int64)
            part = h * _MIX[np.minimum(np.arange(len(h)) - np.repeat(self.first[:-1], counts), k - 1)] if len(h) else h
            total = np.concatenate([[np.uint64(0)], np.cumsum(part)])
            place = total[self.first[short + 1]] - total[self.first[short]] + _MIX[k + counts[short]]
            runs, owner = np.concatenate([runs, mix(place)]), np.concatenate([owner, short])
        return runs, owner


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and where each text starts (and the last one ends). Nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if offsets is not None and len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


def chunks(column: pa.Array | pa.ChunkedArray, ends: np.ndarray, most: int = CHUNK) -> Iterator[tuple[int, Chunk]]:
    """(index of the first text, Chunk) over a column; a chunk has about `most` bytes, or one longer text."""
    raw, at = text_bytes(column)
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield i, Chunk(raw[at[i] : at[j]], at[i : j + 1] - at[i], ends)
        i = j


def append_columns(df: DataFrame, make: Callable[[pa.RecordBatch], list[pa.Array]], fields: list[T.StructField], keep: list[str]) -> DataFrame:
    """df's `keep` columns and the new `fields`, computed by Arrow batches in one pass. A kept column of a new field's name (in any case) is replaced."""
    new_names = {f.name.lower() for f in fields}
    keep = [c for c in keep if c.lower() not in new_names]
    schema = T.StructType([df.schema[c] for c in keep] + fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = make(batch)
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in keep], *new], names=schema.names)

    return df.mapInArrow(run, schema)

"""Shared helpers: table access, bounded Arrow slices, word splitting; scratch tables and joins are the library's."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lineage import clear_scratch, discard, materialize, scratch_dir, skew_join  # noqa: F401  used by the operators

#: Bytes of text handled at once by a Python worker.
SLICE_BYTES = 2 << 20
#: The same for work on arrays of eight bytes for each byte of text, so that they stay in the processor's cache.
ARRAY_BYTES = 1 << 18
#: Entries kept in a per-worker word cache before it is emptied.
CACHE_WORDS = 250_000
#: Longer words aren't kept, so the entries bound the bytes of a cache.
CACHE_LENGTH = 64

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Each name, lengthened by underscores until df has no such column."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def crc_mod(column: str, modulus: int):
    """crc32 of the id written as text, modulo; null ids count as the empty string."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each piece holds about `limit` bytes of text, or a single row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(size, dtype=np.int64) // limit
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for start, end in zip(cuts, cuts[1:]):
            if end > start:
                yield batch.slice(start, end - start)


def utf8_list(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8 bytes; a null text is empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


class Words:
    """Words of a slice of texts, as flat arrays.

    A word is a maximal run of bytes other than space and the control characters 9 to 13, which is what
    bytes.split() yields; `doc` has the text's number for each word.
    """

    def __init__(self, texts: list[bytes]):
        self.lists = [t.split() for t in texts]
        self.counts = np.fromiter(map(len, self.lists), np.int64, len(texts))
        self.starts = np.concatenate([[0], np.cumsum(self.counts)])
        self.doc = np.repeat(np.arange(len(texts)), self.counts)

    @property
    def total(self) -> int:
        return int(self.starts[-1])

    def flat(self) -> Iterator[bytes]:
        for words in self.lists:
            yield from words


class BoundedCache(dict):
    """A dict that computes what it lacks and is emptied between slices once it is full."""

    def __init__(self, compute, most: int = CACHE_WORDS):
        super().__init__()
        self.compute, self.most = compute, most

    def __missing__(self, key):
        value = self.compute(key)
        if len(key) <= CACHE_LENGTH and len(self) < 4 * self.most:
            self[key] = value
        return value

    def trim(self) -> None:
        if len(self) > self.most:
            self.clear()


_blank = np.zeros(256, bool)
_blank[[32, 9, 10, 11, 12, 13]] = True
POWERS = np.cumprod(np.full(1024, 0x9E3779B97F4A7C15, np.uint64), dtype=np.uint64)
_giant = [np.ones(1, np.uint64)]


def powers(place: np.ndarray) -> np.ndarray:
    """Powers of an odd number, one for each place; those of places from 1024 on are products of two."""
    low = POWERS[place & 1023]
    most = int(place.max(initial=0)) >> 10
    if not most:
        return low
    if len(_giant[0]) <= most:
        _giant[0] = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(2 * most, POWERS[1023], np.uint64), dtype=np.uint64)])
    return low * _giant[0][place >> 10]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class ByteWords:
    """Words of a slice of texts as positions in one byte array; a newline stands behind every text."""

    def __init__(self, texts: list[bytes]):
        self.data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8) if texts else np.zeros(0, np.uint8)
        blank = _blank[self.data]
        edge = np.flatnonzero(np.diff(np.concatenate([[True], blank]).astype(np.int8)))
        self.starts, self.ends = edge[0::2], edge[1::2]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        self.text_starts = np.concatenate([[0], np.cumsum(sizes)])[: len(texts)]
        self.doc = np.searchsorted(self.text_starts, self.starts, "right") - 1

    def hashes(self, values: np.ndarray) -> np.ndarray:
        """Polynomial hash of each word's bytes, given as a 64-bit value for each byte of the array; 0 is skipped."""
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        some = values != 0
        kept = np.cumsum(some)
        lengths = np.diff(np.concatenate([self.starts, [len(values)]]))
        before = np.repeat(kept[self.starts] - some[self.starts], lengths)
        place = kept[self.starts[0] :] - before
        values = values[self.starts[0] :] * powers(place)
        return mix(np.add.reduceat(values, self.starts - self.starts[0]))

    def any(self, flags: np.ndarray) -> np.ndarray:
        """Whether a word has a flagged byte."""
        return np.add.reduceat(flags, self.starts, dtype=np.int64) > 0 if len(self.starts) else np.zeros(0, bool)

"""Packing by Karmarkar-Karp multiway differencing.

A document's ids (byte-level BPE, then id 0) are cut into pieces of `SIZE` and a rest. A full piece is a sequence.
The rest is cut at multiples of `CUT`, and these pieces are gathered, in the order a task meets them, into groups of `GROUP`; each group is divided into k windows
by multiway differencing: every rest starts as a partial partition with one used window, and the two partial
partitions of the largest imbalance are merged with their windows in opposite order until one is left. k begins at
the least that capacity allows and rises until no window exceeds SIZE. The work is one pass over the documents
without a shuffle; sequence ids carry the task's number.

Ids equal those of the tokenizers library. Texts are cut before each space that a visible character follows, which
is a border of the tokenizer's own splitting; ids of cut words are cached. A text with the special string goes to
the library as a whole.

Defined cases: null and empty texts consist of id 0; repeated rows are packed each; null ids stay null; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import heapq
import json
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model.tokenizers import byte_of_char
from .common import BoundedCache, slices, table

SIZE = 1024
GROUP = 1024
#: Rests are cut at multiples of it, as small pieces balance better.
CUT = 256
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_border = re.compile(r" (?=\S)")
_END = (0).to_bytes(4, "little")


class _NotPlain(Exception):
    """A text in which a space isn't followed by a visible character."""


def fast_words(path: str):
    """A quicker encoder of the same vocabulary for single words, or None if the file's merges aren't in id order."""
    import public_tokenizers
    import tiktoken

    with open(path) as file:
        spec = json.load(file)
    model, chars = spec["model"], byte_of_char()
    ids = {tuple(m.split(" ") if isinstance(m, str) else m): model["vocab"].get("".join(m.split(" ") if isinstance(m, str) else m)) for m in model.get("merges", ())}
    plain = model.get("type", "BPE") == "BPE" and (spec.get("pre_tokenizer") or {}).get("type") == "ByteLevel" and not spec["pre_tokenizer"].get("add_prefix_space") and not spec.get("normalizer")
    order = list(ids.values())
    if not plain or None in order or order != sorted(order):
        return None
    ranks = {bytes(chars[c] for c in token): i for token, i in model["vocab"].items() if all(c in chars for c in token) and len(token.encode()) and token not in {t["content"] for t in spec.get("added_tokens", ())}}
    return tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


class Encoder:
    """Ids of whole texts as little-endian 32-bit bytes."""

    def __init__(self, path: str):
        with open(path) as file:
            added = [t["content"] for t in json.load(file).get("added_tokens", ())]
        self.path, self._library = path, None
        self.special = re.compile("|".join(map(re.escape, added))) if added else None
        self.fast = fast_words(path)
        self.words = BoundedCache(self._word, 400_000)

    @property
    def library(self):
        """The tokenizers library, for texts that hold a special string."""
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
        return self._library

    def _ids(self, text: str) -> bytes:
        ids = self.fast(text) if self.fast else self.library.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def _word(self, word: str) -> bytes:
        """Ids of a space and the word behind it."""
        if not word or word[0].isspace():
            raise _NotPlain
        return self._ids(" " + word)

    def encode(self, text: str) -> bytes:
        if self.special and self.special.search(text):
            ids = self.library.encode(text, add_special_tokens=False).ids
            return struct.pack(f"<{len(ids)}I", *ids)
        first, *rest = text.split(" ")
        try:
            return self._ids(first) + b"".join(map(self.words.__getitem__, rest))
        except _NotPlain:
            first, *rest = _border.split(text)
            return self._ids(first) + b"".join(map(self.words.__getitem__, rest))


def differencing(sizes: np.ndarray, k: int) -> np.ndarray:
    """Window (0 to k-1) of each item by Karmarkar-Karp differencing in k ways."""
    n = len(sizes)
    if k == 1:
        return np.zeros(n, np.int64)
    sums: dict[int, np.ndarray] = {}
    slots: dict[int, np.ndarray] = {}
    heap = []
    for i, s in enumerate(sizes.tolist()):
        row = np.zeros(k, np.int64)
        row[0] = s
        sums[i] = row
        heap.append((-s, i))
    heapq.heapify(heap)
    merges: list[tuple[int, int, np.ndarray, np.ndarray]] = []
    last = n
    while len(heap) > 1:
        (_, a), (_, b) = heapq.heappop(heap), heapq.heappop(heap)
        total = sums.pop(a) + sums.pop(b)[::-1]  # both descend; opposite order
        order = np.argsort(-total, kind="stable")
        total = total[order]
        sums[last] = total - total[-1]
        merges.append((a, b, order, k - 1 - order))
        heapq.heappush(heap, (-int(total[0] - total[-1]), last))
        last += 1
    where: dict[int, np.ndarray] = {heap[0][1]: np.arange(k)}
    window = np.zeros(n, np.int64)
    for node in range(len(merges) - 1, -1, -1):
        a, b, order_a, order_b = merges[node]
        mine = where.pop(n + node)
        for child, order in ((a, order_a), (b, order_b)):
            at = np.empty(k, np.int64)
            at[order] = mine
            if child < n:
                window[child] = at[0]
            else:
                where[child] = at
    if n == 1:
        window[0] = 0
    return window


def windows(sizes: np.ndarray, capacity: int = SIZE) -> np.ndarray:
    """Window of each item so that none exceeds capacity; the number of windows rises as needed."""
    total = int(sizes.sum())
    k = max(1, -(-total // capacity))
    while True:
        found = differencing(sizes, k)
        most = int(np.bincount(found, sizes, k).max())
        if most <= capacity:
            return found
        # the spread about the mean tells how far k has to rise at least
        k = max(k + 1, min(int(total / (capacity - (most - total / k) / 2)), k + k // 50))


def _pack(path: str, group: int):
    def run(batches):
        encoder, task, sequences = Encoder(path), TaskContext.get().partitionId(), 0
        rests: list[list] = []

        def table_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*rows)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        def next_id() -> int:
            nonlocal sequences
            sequences += 1
            return (task << 40) | (sequences - 1)

        def flush():
            found = windows(np.array([r[2] for r in rests], np.int64))
            used: dict[int, list[int]] = {}
            rows = []
            for rest, w in zip(rests, found.tolist()):
                state = used.setdefault(w, [next_id(), 0] if w not in used else [])
                rows.append([*rest, state[0], state[1]])
                state[1] += rest[2]
            rests.clear()
            return table_of(rows)

        for part in slices(batches):
            texts = [t or "" for t in part.column("text").to_pylist()]
            encoder.words.trim()
            rows = []
            for doc, text in zip(part.column("doc_id").to_pylist(), texts):
                ids = encoder.encode(text) + _END
                total = len(ids) // 4
                for start in range(0, total, SIZE):
                    piece = ids[4 * start : 4 * (start + SIZE)]
                    row = [doc, start, len(piece) // 4, zlib.crc32(piece), total]
                    if row[2] == SIZE:
                        rows.append([*row, next_id(), 0])
                    else:
                        for at in range(0, row[2], CUT):
                            part_ids = piece[4 * at : 4 * (at + CUT)]
                            rests.append([doc, start + at, len(part_ids) // 4, zlib.crc32(part_ids), total])
                if len(rests) >= group:
                    yield flush()
            if rows:
                yield table_of(rows)
        if rests:
            yield flush()

    return run


def pack(docs: DataFrame, tokenizer_path: str, group: int = GROUP) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of each piece."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_pack(tokenizer_path, group), SCHEMA)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), default_path())

"""Interchange files of a sparse index (magic SLAT, version 1): a tree of splits over leaves of sparse vectors.

The engine itself keeps indexes as Parquet; these files are for exchange. One file is one tree and is read by one task;
many files are read in parallel. `spark.dataSource.register(IndexFileSource)`, then
`spark.read.format("slat").option("payload", "string").load(path)` gives leaf, dims, e, payload.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from glob import glob
from io import BytesIO
from typing import BinaryIO

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Fixed values of the format.
MAGIC, VERSION = b"SLAT", 1
LEAF, BRANCH = 0, 1
BELOW, ABOVE = 1, 2
#: Vectors in a leaf, unless they can't be told apart by a split.
LEAF_SIZE = 16

#: Dimensions in all, entries (dimension, value) by ascending dimension, payload.
Vector = tuple[int, list[tuple[int, int]], "str | int"]


@dataclass
class Leaf:
    vectors: list[Vector] = field(default_factory=list)


@dataclass
class Branch:
    dimension: int
    value: int
    below: Leaf | Branch | None
    above: Leaf | Branch | None


def build(vectors: list[Vector], leaf_size: int = LEAF_SIZE) -> Leaf | Branch:
    """Split on the dimension of most variance (exact; the smallest of equals) at its upper median, absent values being 0.

    A split that leaves a side empty isn't made, so the leaf may hold more than leaf_size.
    """
    if len(vectors) <= leaf_size:
        return Leaf(vectors)
    sums: dict[int, list[int]] = {}
    for _, entries, _ in vectors:
        for d, v in entries:
            both = sums.setdefault(d, [0, 0])
            both[0] += v
            both[1] += v * v
    if not sums:
        return Leaf(vectors)
    dimension = min(sums, key=lambda d: (sums[d][0] ** 2 - len(vectors) * sums[d][1], d))
    values = [dict(entries).get(dimension, 0) for _, entries, _ in vectors]
    pivot = sorted(values)[len(values) // 2]
    sides = [[x for x, v in zip(vectors, values) if (v < pivot) is below] for below in (True, False)]
    if not all(sides):
        return Leaf(vectors)
    return Branch(dimension, pivot, *(build(side, leaf_size) for side in sides))


def _write(out: BinaryIO, node: Leaf | Branch) -> None:
    if isinstance(node, Branch):
        children = [(bit, child) for bit, child in ((BELOW, node.below), (ABOVE, node.above)) if child is not None]
        out.write(struct.pack("<BHqB", BRANCH, node.dimension, node.value, sum(bit for bit, _ in children)))
        for _, child in children:
            _write(out, child)
        return
    out.write(struct.pack("<Bi", LEAF, len(node.vectors)))
    for dims, entries, payload in node.vectors:
        out.write(struct.pack("<ii", dims, len(entries)))
        out.write(b"".join(struct.pack("<Hq", d, v) for d, v in entries))
        if isinstance(payload, int):
            out.write(struct.pack("<i", payload))
        else:
            text = payload.encode()
            size = len(text)
            while size > 127:  # seven bits a byte, the lowest first
                out.write(bytes([size & 127 | 128]))
                size >>= 7
            out.write(bytes([size]) + text)


def encode(root: Leaf | Branch) -> bytes:
    """The file of a tree; equal trees give equal bytes."""
    out = BytesIO(MAGIC + struct.pack("<H", VERSION))
    out.seek(0, 2)
    _write(out, root)
    return out.getvalue()


def _take(file: BinaryIO, layout: str) -> tuple:
    size = struct.calcsize("<" + layout)
    data = file.read(size)
    if len(data) < size:
        raise ValueError("the index file ends early")
    return struct.unpack("<" + layout, data)


def _payload(file: BinaryIO, kind: str) -> str | int:
    if kind == "int32":
        return _take(file, "i")[0]
    size = shift = 0
    more = True
    while more:
        (byte,) = _take(file, "B")
        size |= (byte & 127) << shift
        shift, more = shift + 7, byte > 127
    return _take(file, f"{size}s")[0].decode()


def _read(file: BinaryIO, kind: str) -> Leaf | Branch:
    (tag,) = _take(file, "B")
    if tag == BRANCH:
        dimension, value, mask = _take(file, "HqB")
        return Branch(dimension, value, *(_read(file, kind) if mask & bit else None for bit in (BELOW, ABOVE)))
    if tag != LEAF:
        raise ValueError(f"unknown node {tag}")
    leaf = Leaf()
    for _ in range(_take(file, "i")[0]):
        dims, n = _take(file, "ii")
        leaf.vectors.append((dims, [_take(file, "Hq") for _ in range(n)], _payload(file, kind)))
    return leaf


def decode(file: BinaryIO, kind: str = "string") -> Leaf | Branch:
    """The tree of a file; kind of the payloads is string or int32."""
    if _take(file, "4s")[0] != MAGIC:
        raise ValueError("not an index file")
    if (version := _take(file, "H")[0]) != VERSION:
        raise ValueError(f"index file of version {version}")
    return _read(file, kind)


def leaves(node: Leaf | Branch | None) -> Iterator[Leaf]:
    """All leaves, those below a split first."""
    if isinstance(node, Branch):
        yield from leaves(node.below)
        yield from leaves(node.above)
    elif node:
        yield node


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, path: str, kind: str):
        self.path, self.kind = path, kind

    def partitions(self):
        return [_File(p) for p in sorted(glob(self.path))] or [InputPartition(0)]

    def read(self, partition):
        if isinstance(partition, _File):
            with open(partition.path, "rb") as file:
                for i, leaf in enumerate(leaves(decode(file, self.kind))):
                    for dims, entries, payload in leaf.vectors:
                        yield partition.path, i, dims, entries, payload


class IndexFileSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "slat"

    def schema(self) -> str:
        payload = "int" if self.options.get("payload", "string") == "int32" else "string"
        return f"file string, leaf int, dims int, e array<struct<d: int, v: long>>, payload {payload}"

    def reader(self, schema):
        return _Reader(self.options["path"], self.options.get("payload", "string"))

"""An index of cells for exact search in integer vectors (id, e: entries (d, v)).

Each row belongs to the nearest of a bounded sample of pivots. A cell knows its number of rows and their largest
distance from the pivot, so a query bounds its k-th distance from these few numbers and visits only cells that can
hold something nearer (triangle inequality). Cells and the queries that visit them are cut into bounded blocks that
meet in an equi-join; within a block, rows whose distance from the pivot differs too much are skipped, the others are
compared in floating point (L2: by a product of matrices, with a bound on its error), and what that can't decide is
settled in whole numbers. So results are exact, in the order of (distance, id).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .lineage import materialize

#: Most rows and queries of a block; of vectors with more than 64 dimensions fewer queries.
ROWS, QUERIES = 8192, 16384
#: Most queries of a block of plain pairs, and of a tile within a block.
ASKED, TILE = 1024, 128
#: Distances in floating point are off by less than this part of themselves.
SLACK = 1e-9
METRICS = ("l2", "l1")


def dense_rows(entries: pa.ListArray, dims: int) -> np.ndarray:
    """Entry lists as a matrix of 64-bit integers."""
    entries = entries.combine_chunks() if isinstance(entries, pa.ChunkedArray) else entries
    out = np.zeros((len(entries), dims), np.int64)
    sizes = np.nan_to_num(entries.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    flat = entries.flatten()
    if len(flat):
        out[np.repeat(np.arange(len(entries)), sizes), flat.field("d").to_numpy(zero_copy_only=False)] = flat.field("v").to_numpy(zero_copy_only=False)
    return out


def distances(rows: np.ndarray, point: np.ndarray, metric: str) -> np.ndarray:
    """Distances in floating point: of L2, the root."""
    gap = np.abs((rows - point).astype(np.float64))
    return np.sqrt((gap * gap).sum(-1)) if metric == "l2" else gap.sum(-1)


def exact(row: np.ndarray, point: np.ndarray, metric: str) -> int:
    """Squared L2 or L1 in whole numbers."""
    gap = [int(a) - int(b) for a, b in zip(row.tolist(), point.tolist())]
    return sum(g * g for g in gap) if metric == "l2" else sum(map(abs, gap))


def exact_rows(a: np.ndarray, b: np.ndarray, metric: str) -> list[int]:
    """Squared L2 or L1 of equal rows of two matrices, in whole numbers: sums of 32-bit halves don't wrap."""
    out, half = [], np.uint64(32)
    low = np.uint64(0xFFFFFFFF)
    for i in range(0, len(a), 4096):
        x, y = a[i : i + 4096], b[i : i + 4096]
        with np.errstate(over="ignore"):
            gap = np.where(x >= y, x.astype(np.uint64) - y.astype(np.uint64), y.astype(np.uint64) - x.astype(np.uint64))
        hi, lo = gap >> half, gap & low
        parts = [(0, lo), (32, hi)] if metric == "l1" else [(0, lo * lo), (33, hi * lo), (64, hi * hi)]
        sums = [(shift, (v & low).sum(1).tolist(), (v >> half).sum(1).tolist()) for shift, v in parts]
        out += [sum((p + (q << 32)) << shift for shift, p, q in each) for each in zip(*([(shift, p, q) for p, q in zip(ps, qs)] for shift, ps, qs in sums))]
    return out


def _candidates(x: np.ndarray, points: np.ndarray, k: int | None, bound: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of points and rows of all pairs that may be within the points' bounds and, with k, among the k nearest rows."""
    if metric == "l1":
        found = []
        for i, point in enumerate(points):
            d = distances(x, point, metric)
            cut = bound[i] if k is None or k >= len(d) else min(bound[i], np.partition(d, k - 1)[k - 1] * (1 + SLACK) + SLACK)
            found.append(np.flatnonzero(d <= cut))
        return np.repeat(np.arange(len(points)), [len(f) for f in found]), np.concatenate(found) if found else np.zeros(0, np.int64)
    rows, own = x.astype(np.float64), points.astype(np.float64)
    off = 8 * (x.shape[1] + 16) * np.finfo(np.float64).eps  # error of a squared distance as a part of both squared lengths
    size, length = (rows * rows).sum(1), (own * own).sum(1)
    low = own @ (-2 * rows.T)
    low += size * (1 - off)
    low += (length * (1 - off))[:, None]
    cut = bound * bound * (1 + 4 * SLACK)
    if k is not None and k < len(x):  # the k-th of the least of several groups of rows is no less than the k-th of all
        groups = min(len(x) // max(1, len(x) // max(64, 2 * k)), len(x))
        width = len(x) // groups
        head = low[:, : groups * width].reshape(len(points), groups, width)
        best = head.argmin(2)
        least = np.take_along_axis(head, best[:, :, None], 2)[:, :, 0] + 2 * off * (size[best + np.arange(groups) * width] + length[:, None])
        cut = np.minimum(cut, np.partition(least, k - 1, 1)[:, k - 1]) if k <= groups else cut
    return np.nonzero(low <= cut[:, None])


def _pack(df: DataFrame, dims: int) -> DataFrame:
    """id and x: the vector of e as 64-bit integers."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("id"), as_bytes(dense_rows(batch.column("e"), dims))], ["id", "x"])

    return df.select("id", "e").mapInArrow(packed, f"id {df.schema['id'].dataType.simpleString()}, x binary")


def as_bytes(x: np.ndarray) -> pa.Array:
    cuts = np.arange(len(x) + 1, dtype=np.int32) * (x.shape[1] * 8)
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(cuts), pa.py_buffer(np.ascontiguousarray(x, np.int64))])


def from_bytes(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    if not len(column):
        return np.zeros((0, dims), np.int64)
    return np.concatenate([np.frombuffer(c.buffers()[2], np.uint8)[c.offset * dims * 8 : (c.offset + len(c)) * dims * 8].view(np.int64).reshape(-1, dims) for c in column.chunks if len(c)])


@dataclass
class Index:
    """rows: cell, block, id, x; pivots and, for each cell, its number of rows and its radius by metric: bounded."""

    rows: DataFrame
    dims: int
    pivots: np.ndarray
    counts: np.ndarray
    radii: dict[str, np.ndarray]


def build(corpus: DataFrame, dims: int, cells: int = 64, sample: DataFrame | None = None) -> Index:
    """Index rows (id, e) of a corpus by at most `cells` cells.

    sample: the rows (e) of the pivots, where whoever asks can find them without computing all rows; any will do.
    """
    if sample is None:
        ids = [r["id"] for r in corpus.select("id").orderBy(F.xxhash64("id"), "id").limit(cells).collect()]
        sample = corpus.filter(F.col("id").isin(ids)).select("e").limit(cells)
    sample = sample.select("e").toArrow()
    pivots = dense_rows(sample.column("e"), dims) if sample.num_rows else np.zeros((1, dims), np.int64)
    centers = pivots.astype(np.float64)
    half = (centers * centers).sum(1) / 2

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = dense_rows(batch.column("e"), dims)
            cell = (half - x.astype(np.float64) @ centers.T).argmin(1)
            far = [pa.array(distances(x, pivots[cell], m)) for m in METRICS]
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), batch.column("id"), as_bytes(x), *far], ["cell", "id", "x", "r_l2", "r_l1"])

    kind = corpus.schema["id"].dataType.simpleString()
    placed = materialize(corpus.select("id", "e").mapInArrow(assign, f"cell int, id {kind}, x binary, r_l2 double, r_l1 double"), "cells")
    counts, radii = np.zeros(len(pivots), np.int64), {m: np.zeros(len(pivots)) for m in METRICS}
    for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("r_l2").alias("l2"), F.max("r_l1").alias("l1")).collect():  # a row for each cell
        counts[r["cell"]] = r["n"]
        for m in METRICS:
            radii[m][r["cell"]] = r[m]
    blocks = F.array(*(F.lit(int(max(1, -(-n // ROWS)))) for n in counts))
    return Index(placed.withColumn("block", F.pmod(F.xxhash64("id"), F.element_at(blocks, F.col("cell") + 1)).cast("int")), dims, pivots, counts, radii)


def _visits(index: Index, queries: DataFrame, metric: str, k: int | None, reach: float | None) -> DataFrame:
    """cell, id, x, near (distance from the pivot), bound: the cells that each query has to visit."""
    dims, pivots, counts, radii = index.dims, index.pivots, index.counts, index.radii[metric]

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = dense_rows(batch.column("e"), dims)
            near = np.stack([distances(x, p, metric) for p in pivots], 1)
            if k is None:
                bound = np.full(len(x), reach)
            else:  # the k-th distance is at most that to the far side of the nearest cells with k rows
                side = near + radii
                order = np.argsort(side, 1)
                enough = (np.cumsum(counts[order], 1) >= min(k, int(counts.sum()))).argmax(1)
                bound = side[np.arange(len(x)), order[np.arange(len(x)), enough]]
            bound = bound * (1 + SLACK) + SLACK
            row, cell = np.nonzero((near - radii <= bound[:, None]) & (counts > 0))
            for i in range(0, len(row), 1 << 15):  # a query may visit every cell
                r, c = row[i : i + (1 << 15)], cell[i : i + (1 << 15)]
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32)), batch.column("id").take(pa.array(r)), as_bytes(x[r]), pa.array(near[r, c]), pa.array(bound[r])], ["cell", "id", "x", "near", "bound"])

    kind = queries.schema["id"].dataType.simpleString()
    return materialize(queries.select("id", "e").mapInArrow(visits, f"cell int, id {kind}, x binary, near double, bound double"), "visits")


def _found(index: Index, queries: DataFrame, metric: str, k: int | None, most: int | None) -> DataFrame:
    """q, id, dist: of each block the pairs within `most`, or else the k nearest of each query."""
    reach = None if most is None else (float(most) ** 0.5 if metric == "l2" else float(most))
    visits = _visits(index, queries, metric, k, reach)
    n = {r["cell"]: r["n"] for r in visits.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # a row for each cell
    most_asked = max(1, QUERIES * 64 // max(index.dims, 64))
    slices = F.element_at(F.array(*(F.lit(-(-n.get(c, 0) // most_asked)) for c in range(len(index.pivots)))), F.col("cell") + 1)
    blocks = F.element_at(F.array(*(F.lit(int(max(1, -(-m // ROWS)))) for m in index.counts)), F.col("cell") + 1)
    asked = visits.withColumn("slice", F.pmod(F.xxhash64("id"), slices).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1)))
    held = index.rows.select("cell", "block", "id", "x", F.col(f"r_{metric}").alias("r")).filter(slices > 0)
    held = held.withColumn("slice", F.explode(F.sequence(F.lit(0), slices - 1)))
    return _cogroup(asked, held, ("cell", "block", "slice"), *_comparing(queries, index.rows, index.dims, metric, k, most))


def _comparing(queries: DataFrame, corpus: DataFrame, dims: int, metric: str, k: int | None, most: int | None):
    """compare(asking, rows) of one block, and its schema: q, id, dist of the pairs within `most` or the k nearest.

    Both have id and x. Asking tables may have near and bound, rows r: distances from a common pivot.
    """
    names = ["q", "id", "dist"]
    types = [queries.schema["id"].dataType.simpleString(), corpus.schema["id"].dataType.simpleString(), "decimal(38,0)"]

    def compare(asking: pa.Table, rows: pa.Table) -> pa.Table:
        if not asking.num_rows or not rows.num_rows:
            return pa.table([asking.column("id").slice(0, 0), rows.column("id").slice(0, 0), pa.array([], pa.decimal128(38, 0))], names)
        rows = rows.sort_by("id")
        x = from_bytes(rows.column("x"), dims)
        pruned = "r" in rows.column_names
        r = rows.column("r").to_numpy() if pruned else np.zeros(len(x))
        place = np.arange(len(x))
        if k is not None:  # of equal rows only the k first can be among the nearest
            _, kind, count = np.unique(x.view(np.dtype((np.void, dims * 8))).ravel(), return_inverse=True, return_counts=True)
            together = np.argsort(kind, kind="stable")
            nth = np.empty(len(x), np.int64)
            nth[together] = np.arange(len(x)) - np.repeat(np.cumsum(count) - count, count)
            place = np.flatnonzero(nth < k)
        place = place[np.argsort(r[place], kind="stable")]
        x, r = x[place], r[place]
        points = from_bytes(asking.column("x"), dims)
        near, bound = (asking.column(c).to_numpy() if pruned else np.full(len(points), v) for c, v in (("near", 0.0), ("bound", np.inf)))
        turn = np.argsort(near, kind="stable")
        asker, at, dist = [], [], []
        for i in range(0, len(turn), TILE):
            own = turn[i : i + TILE]
            a, b = (0, len(x)) if not pruned else (np.searchsorted(r, (near[own] - bound[own] - SLACK * near[own]).min(), "left"), np.searchsorted(r, (near[own] + bound[own] + SLACK * near[own]).max(), "right"))
            if a == b:
                continue
            q, j = _candidates(x[a:b], points[own], k, bound[own], metric)
            j = j + a
            far = exact_rows(x[j], points[own[q]], metric) if len(j) < 1 << 16 else [d for c in range(0, len(j), 1 << 16) for d in exact_rows(x[j[c : c + (1 << 16)]], points[own[q[c : c + (1 << 16)]]], metric)]
            fit = sorted(zip(q.tolist(), far, place[j].tolist())) if k is not None else [t for t in zip(q.tolist(), far, place[j].tolist()) if t[1] <= most]
            if k is not None:
                first = np.searchsorted(np.array([t[0] for t in fit]), np.arange(len(own)))
                fit = [t for n, t in enumerate(fit) if n - first[t[0]] < k]
            asker += [int(own[t[0]]) for t in fit]
            dist += [Decimal(t[1]) for t in fit]
            at += [t[2] for t in fit]
        take = lambda table, chosen: table.column("id").take(pa.array(chosen, pa.int64()))
        return pa.table([take(asking, asker), take(rows, at), pa.array(dist, pa.decimal128(38, 0))], names)

    return compare, ", ".join(f"{n} {t}" for n, t in zip(names, types))


def _cogroup(left: DataFrame, right: DataFrame, keys: tuple[str, ...], compare, schema: str) -> DataFrame:
    """compare of the groups of equal keys that both sides have; renamed, as both sides may come from one table."""
    a, b = (df.select(*(F.col(c).alias(c) for c in (*keys, *(c for c in df.columns if c not in keys)))) for df in (left, right))

    def both(x: pa.Table, y: pa.Table) -> pa.Table:
        if x.num_rows and y.num_rows:
            return compare(x, y)
        return compare(a_empty, b_empty)

    a_empty, b_empty = (df.limit(0).toArrow() for df in (a, b))
    return a.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInArrow(both, schema)


def knn(index: Index, queries: DataFrame, k: int, metric: str = "l2") -> DataFrame:
    """(q, rank, id, dist): the k nearest, by distance and id; nothing for k of 0 or less."""
    return _ranked(_found(index, queries, metric, max(k, 1), None), k)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("q").orderBy("dist", "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= max(k, 0)).select("q", "rank", "id", "dist")


def true_knn(corpus: DataFrame, queries: DataFrame, dims: int, k: int, metric: str = "l2") -> DataFrame:
    """(q, rank, id, dist) as of knn, but without an index: every query meets every row, in blocks of bounded size."""
    asked, rows = materialize(_pack(queries, dims), "asked"), materialize(_pack(corpus, dims), "rows")
    return _ranked(pairs(asked, rows, *_comparing(asked, rows, dims, metric, max(k, 1), None), asked=max(1, QUERIES * 64 // max(dims, 64))), k)


def radius(index: Index, queries: DataFrame, most: int, metric: str = "l2") -> DataFrame:
    """Pairs within a distance (L2: squared), inclusive."""
    return _found(index, queries, metric, None, most)


def pairs(queries: DataFrame, corpus: DataFrame, compare, schema: str, rows: int = ROWS, asked: int = ASKED) -> DataFrame:
    """compare(queries, rows) of all blocks of a stated query set and a corpus (Arrow tables with their columns), for statistics that need every pair."""
    blocks, slices = max(1, -(-corpus.count() // rows)), max(1, -(-queries.count() // asked))
    deal = lambda df, n, name: df.withColumn(name, F.pmod(F.xxhash64("id"), F.lit(n)).cast("int"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = deal(queries, slices, "slice").withColumn("block", every(blocks))
    right = deal(corpus, blocks, "block").withColumn("slice", every(slices))
    keys = ("block", "slice")
    return _cogroup(left, right, keys, compare, schema)

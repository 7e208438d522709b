"""The vector index and the cells against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from orthant.functions import geometry as g
from orthant.operators import index, lineage, motion, spatial, vectors

VECTORS = "id long, e array<struct<d: int, v: bigint>>"


def entries(row):
    return [(d, int(v)) for d, v in enumerate(row) if v]


@pytest.mark.parametrize("metric", ["l2", "l1"])
def test_index_is_exact(spark, monkeypatch, metric):
    monkeypatch.setattr(index, "ROWS", 40)
    monkeypatch.setattr(index, "QUERIES", 7)
    r = random.Random(3)
    centers = [[r.randint(-(10**9), 10**9) for _ in range(5)] for _ in range(4)]
    rows = [[c + r.randint(-9, 9) * 10 ** r.randint(0, 7) for c in r.choice(centers)] for _ in range(300)]
    rows += [rows[0]] * 120 + [[0] * 5] * 3 + [[r.choice([2**61, -(2**61)]) if d == 2 else 0 for d in range(5)] for _ in range(2)]  # ties, a hot point, empty and wide vectors
    df = spark.createDataFrame([(i, entries(x)) for i, x in enumerate(rows)], VECTORS)
    asked = [i for i in range(len(rows)) if i % 11 == 0 and abs(rows[i][2]) < 2**60]
    built = index.build(df.filter("id < 423"), 5, cells=6)
    far = lambda a, b: sum((x - y) ** 2 if metric == "l2" else abs(x - y) for x, y in zip(a, b))
    truth = {q: sorted((far(rows[q], x), i) for i, x in enumerate(rows[:423])) for q in asked}
    got = {}
    for x in index.knn(built, df.filter("id % 11 = 0 AND id < 423"), 9, metric).collect():
        got.setdefault(x.q, {})[x.rank] = (int(x.dist), x.id)
    assert {q: [v[k] for k in sorted(v)] for q, v in got.items()} == {q: v[:9] for q, v in truth.items()}
    most = truth[0][150][0]
    near = {(x.q, x.id, int(x.dist)) for x in index.radius(built, df.filter("id % 11 = 0 AND id < 423"), most, metric).collect()}
    assert near == {(q, i, d) for q, v in truth.items() for d, i in v if d <= most}
    assert index.knn(built, df.filter("id = 0"), 0).count() == 0 and index.knn(built, df.filter("id = 0"), 1000).count() == 423
    assert index.knn(index.build(df.limit(0), 5), df.filter("id = 0"), 3).count() == 0


def brute_depths(positions, counts, capacity):
    out = []
    code = lambda p, d: tuple((c + g.HALF) >> (63 - d) for c in p)
    for p in positions:
        deepest = 0
        for d in range(1, 64):
            if sum(n for q, n in zip(positions, counts) if code(q, d) == code(p, d)) > capacity:
                deepest = d
        out.append(min(63, deepest + 1))
    return out


@pytest.mark.parametrize("capacity", [1, 3, 16])
def test_cells_of_hot_and_dense_points(spark, capacity):
    r = random.Random(4)
    points = [(r.randint(-(2**40), 2**40), r.randint(0, 50), -r.randint(0, 2**61)) for _ in range(60)]
    points += [(r.randint(0, 15), r.randint(0, 15), r.randint(0, 15)) for _ in range(120)] + [(5, 5, 5)] * 200 + [(g.HALF - 1,) * 3, (-g.HALF,) * 3]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(points)], "guid long, pos struct<x: bigint, y: bigint, z: bigint>")
    counts = {}
    for p in points:
        counts[p] = counts.get(p, 0) + 1
    want = dict(zip(counts, brute_depths(list(counts), list(counts.values()), capacity)))
    rows = spatial.assign_cells(df, capacity).collect()
    assert len(rows) == len(points) and all(r.cell_depth == want[tuple(r.pos)] for r in rows)
    assert spatial.assign_cells(df.limit(0), capacity).count() == 0
    order = [tuple(r.pos) for r in spatial.morton_order(df).coalesce(1).collect()]
    key = lambda p: [tuple((c + g.HALF) >> b & 1 for c in p) for b in range(62, -1, -1)]
    assert sorted(map(key, order)) == sorted(map(key, points))


def test_random_take_is_steady(spark):
    df = spark.range(100)
    taken, left = spatial.random_take(df, 7, "id", 5)
    again, _ = spatial.random_take(df.repartition(3), 7, "id", 5)
    ids = {r.id for r in taken.collect()}
    assert len(ids) == 7 and ids == {r.id for r in again.collect()} and {r.id for r in left.collect()} == set(range(100)) - ids
    assert ids != {r.id for r in spatial.random_take(df, 7, "id", 6)[0].collect()}


def test_custom_motion_removes(spark):
    rows = [(1, (0, 0, 0), (100, 0, 0), True, 0), (2, (5, 0, 0), (-100, 0, 0), True, 0), (3, (5, 0, 0), (-100, 0, 0), False, 0)]
    point = "struct<x: bigint, y: bigint, z: bigint>"
    df = spark.createDataFrame(rows, f"guid long, pos {point}, vel struct<x: int, y: int, z: int>, registered boolean, last_ms long")
    out = motion.step(df, 10, lambda pos, vel, elapsed: ({a: g.wide(pos[a]) + 2 * vel[a] for a in g.AXES}, vel["x"] < 0))
    assert sorted((r.guid, r.pos.x) for r in out.collect()) == [(1, 200), (3, 5)]


def test_skew_join_and_scratch(spark):
    rows = spark.range(5000).select(F.when(F.col("id") < 3000, 1).otherwise(F.col("id") % 40).alias("k"), "id")
    keyed = rows.groupBy("k").agg(F.count("*").alias("n"))
    assert lineage.skew_join(rows, keyed, ["k"], "n", 5000).count() == 5000
    df = lineage.materialize(spark.range(5), "test")
    lineage.discard(df)
    with pytest.raises(Exception):
        df.count()


def test_identity_report_compares_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(index, "ROWS", 40)
    monkeypatch.setattr(index, "QUERIES", 7)
    monkeypatch.setattr(vectors, "pair_distances", None)  # a join of all pairs
    r = random.Random(7)
    rows = [[r.uniform(-1, 1) for _ in range(4)] for _ in range(150)]
    rows += [rows[3]] * 90  # copies: many more ties than k
    whole = [[int(float(np.float32(x)) * 10**9) if abs(np.float32(x)) >= np.float32(0.05) else 0 for x in row] for row in rows]
    asked = range(0, len(rows), 20)
    want = {q: sorted((sum((a - b) ** 2 for a, b in zip(whole[q], x)), i) for i, x in enumerate(whole))[:5] for q in asked}
    vecs = spark.createDataFrame(list(enumerate(rows)), "id long, vec array<float>")
    e = vecs.select("id", vectors.quantize(F.col("vec"), zero=0.05).alias("e"))
    got = {}
    for x in index.true_knn(e, e.filter("id % 20 = 0"), 4, 5).collect():
        got.setdefault(x.q, {})[x.rank] = (int(x.dist), x.id)
    assert {q: [v[k] for k in sorted(v)] for q, v in got.items()} == want
    for row in vectors.identity_report(vecs, F.col("id") % 20 == 0, 5, 4, [(0.0, None), (0.05, 2)]).collect():
        assert (row.corpus, row.realized, row.confidence, row.least, row.most) == (240, 4, 100, 100, 100)


def test_exact_rows_do_not_wrap():
    r = random.Random(8)
    a, b = (np.array([[r.choice([-(2**62), 2**62 - 1, r.randint(-(2**62), 2**62 - 1), 0, -1]) for _ in range(70)] for _ in range(50)]) for _ in range(2))
    for metric in index.METRICS:
        assert index.exact_rows(a, b, metric) == [index.exact(x, y, metric) for x, y in zip(a, b)]


def test_exact_kernels():
    a, b = np.array([2**61, -5, 3]), np.array([-(2**61), 7, 3])
    assert index.exact(a, b, "l2") == 2**124 + 144 and index.exact(a, b, "l1") == 2**62 + 12

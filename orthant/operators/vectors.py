"""Sparse integer vectors (id, e: array of struct<d, v>) and dense float vectors (id, vec).

Distances are exact: integers in DECIMAL(38). Every top-k is ordered by (distance, id).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import index
from .lineage import materialize

SCALE = 1_000_000_000


def quantize(vec: Column, scale: int = SCALE, zero: float = 0.01, budget: int | None = None) -> Column:
    """Entries (d, v) in order of d: values below the threshold (as float32) go, v = trunc(value * scale), zeros go.

    budget keeps the entries of the largest |v|, ties to the smaller d.
    """
    with_dims = F.transform(vec, lambda x, i: F.struct(i.alias("d"), x.alias("f")))
    kept = F.filter(with_dims, lambda e: F.abs(e["f"]) >= F.lit(zero).cast("float"))
    whole = F.filter(F.transform(kept, lambda e: F.struct(e["d"].alias("d"), (e["f"].cast("double") * F.lit(float(scale))).cast("long").alias("v"))), lambda e: e["v"] != 0)
    if budget is None:
        return whole
    ranked = F.array_sort(F.transform(whole, lambda e: F.struct((-F.abs(e["v"])).alias("k"), e["d"].alias("d"), e["v"].alias("v"))))
    return F.array_sort(F.transform(F.slice(ranked, 1, budget), lambda e: F.struct(e["d"].alias("d"), e["v"].alias("v"))))


def quantize_dense(vec: Column, scale: int = SCALE, zero: float = 0.01) -> Column:
    """The same rule for a dense array: values below the threshold (as float32) are 0, others trunc(value * scale)."""
    return F.transform(vec, lambda x: F.when(F.abs(x) >= F.lit(zero).cast("float"), (x.cast("double") * F.lit(float(scale))).cast("long")).otherwise(F.lit(0).cast("long")))


def dequantize(e: Column, dims: int, scale: int = SCALE) -> Column:
    """Dense float array; missing dimensions are 0."""
    m = F.map_from_entries(e)
    return F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda d: (F.coalesce(m[d], F.lit(0)).cast("double") / scale).cast("float"))


def value_at(e: Column, d) -> Column:
    return F.coalesce(F.map_from_entries(e)[d], F.lit(0)).cast("long")


def dense(e: Column, dims: int) -> Column:
    """Dense bigint array of an entry array."""
    m = F.map_from_entries(e)
    return F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda d: F.coalesce(m[d], F.lit(0).cast("long")))


def l2(a: Column, b: Column) -> Column:
    """Squared L2 of dense bigint arrays."""
    squares = F.zip_with(a, b, lambda x, y: ((x - y).cast("decimal(19,0)") * (x - y).cast("decimal(19,0)")).cast("decimal(38,0)"))
    return F.aggregate(squares, F.lit(0).cast("decimal(38,0)"), lambda s, x: (s + x).cast("decimal(38,0)"))


def l1(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0).cast("decimal(38,0)"), lambda s, x: (s + x).cast("decimal(38,0)"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


METRICS = {"l2": l2, "l1": l1}


def pair_distances(queries: DataFrame, corpus: DataFrame, dims: int, metric: str = "l2") -> DataFrame:
    """(q, id, dist) of all queries against all rows of the corpus; both have id and e.

    The plain definition, for small tables; knn and radius go by the index, and the truth of a report by index.true_knn.
    """
    q = queries.select(F.col("id").alias("q"), dense(F.col("e"), dims).alias("qv"))
    c = corpus.select("id", dense(F.col("e"), dims).alias("cv"))
    return c.join(q, F.lit(True)).select("q", "id", METRICS[metric](F.col("qv"), F.col("cv")).alias("dist"))


def knn(queries: DataFrame, corpus: DataFrame | index.Index, k: int, dims: int, metric: str = "l2") -> DataFrame:
    """(q, rank, id, dist): the k nearest, by distance and id; nothing for k of 0 or less. A corpus may be indexed beforehand."""
    return index.knn(_indexed(corpus, dims), queries, k, metric)


def radius(queries: DataFrame, corpus: DataFrame | index.Index, most: int, dims: int, metric: str = "l2") -> DataFrame:
    """Pairs (q, id, dist) within a distance (L2: squared), inclusive."""
    return index.radius(_indexed(corpus, dims), queries, most, metric)


def _indexed(corpus: DataFrame | index.Index, dims: int) -> index.Index:
    return corpus if isinstance(corpus, index.Index) else index.build(corpus, dims)


def recall(truth: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """q, recall: hits over min(k, size of the truth); both have q and id."""
    hits = found.join(truth.select("q", "id"), ["q", "id"], "left_semi").groupBy("q").agg(F.count("*").alias("hits"))
    sizes = truth.groupBy("q").agg(F.count("*").alias("n"))
    return sizes.join(hits, "q", "left").select("q", (F.coalesce("hits", F.lit(0)) / F.least(F.col("n"), F.lit(k))).alias("recall"))


def recall_report(per_query: DataFrame) -> DataFrame:
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return per_query.agg(zero(F.avg("recall")).alias("mean"), zero(F.min("recall")).alias("least"), zero(F.max("recall")).alias("most"), F.count("*").alias("queries"))


def sparsity_report(df: DataFrame) -> DataFrame:
    """Entry counts: least, most, mean, population deviation, and the seven-bucket histogram."""
    edges = (("b0", 0, 0), ("b1_4", 1, 4), ("b5_8", 5, 8), ("b9_16", 9, 16), ("b17_32", 17, 32), ("b33_64", 33, 64), ("b65", 65, 1 << 30))
    n = df.select(F.size("e").alias("n"))
    return n.agg(F.min("n").alias("least"), F.max("n").alias("most"), F.avg("n").alias("mean"), F.stddev_pop("n").alias("deviation"), *(F.sum(F.col("n").between(a, b).cast("long")).alias(name) for name, a, b in edges))


def dimension_stats(df: DataFrame, dims: int) -> DataFrame:
    """By dimension: entries, n * sum(v^2) - sum(v)^2 over all rows (absent: 0), and the upper median with zeros.

    The median comes from value counts and a running sum over them, so no dimension's rows meet in one task.
    """
    total = df.agg(F.count("*").alias("n"))
    entries = df.select(F.explode("e").alias("x")).select(F.col("x.d").alias("d"), F.col("x.v").alias("v"))
    big = lambda c: c.cast("decimal(38,0)")
    sums = entries.groupBy("d").agg(F.count("*").alias("entries"), F.sum(big(F.col("v"))).alias("s"), F.sum((F.col("v").cast("decimal(19,0)") * F.col("v").cast("decimal(19,0)")).cast("decimal(38,0)")).alias("ss"))
    values = entries.groupBy("d", "v").agg(F.count("*").alias("c"))
    zeros = sums.join(total, F.lit(True)).select("d", F.lit(0).cast("long").alias("v"), (F.col("n") - F.col("entries")).alias("c"))
    all_values = values.unionByName(zeros).filter("c > 0")
    running = all_values.withColumn("upto", F.sum("c").over(Window.partitionBy("d").orderBy("v"))).join(total, F.lit(True))
    median = running.filter(F.col("upto") > F.floor(F.col("n") / 2)).groupBy("d").agg(F.min("v").alias("median"))
    return sums.join(median, "d").join(total, F.lit(True)).select("d", "entries", big(F.col("n") * F.col("ss") - F.col("s") * F.col("s")).alias("spread"), "median")


def active_dims(df: DataFrame, n: int = 10) -> DataFrame:
    """d, rows of the n dimensions that most rows have an entry in, ties to the smaller."""
    return df.select(F.explode("e").alias("x")).groupBy(F.col("x.d").alias("d")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "d").limit(n)


def sparse_l2(a: Column, b: Column) -> Column:
    """Squared L2 of entry arrays, over the dimensions that either has."""
    return _sparse(a, b, lambda g: (g.cast("decimal(19,0)") * g.cast("decimal(19,0)")).cast("decimal(38,0)"))


def sparse_l1(a: Column, b: Column) -> Column:
    return _sparse(a, b, lambda g: F.abs(g).cast("decimal(38,0)"))


def _sparse(a: Column, b: Column, of) -> Column:
    zero = F.lit(0).cast("long")
    gaps = F.map_values(F.map_zip_with(F.map_from_entries(a), F.map_from_entries(b), lambda k, x, y: F.coalesce(x, zero) - F.coalesce(y, zero)))
    return F.aggregate(gaps, F.lit(0).cast("decimal(38,0)"), lambda s, g: (s + of(g)).cast("decimal(38,0)"))


def split_choice(stats: DataFrame) -> DataFrame:
    """The dimension of the largest spread (ties: the least) and its median: one split of a KD build."""
    return stats.orderBy(F.desc("spread"), "d").limit(1).select("d", "median")


def float_variances(df: DataFrame) -> DataFrame:
    """d, variance (population) of dense float vectors."""
    return df.select(F.posexplode("vec").alias("d", "x")).groupBy("d").agg(F.var_pop(F.col("x").cast("double")).alias("variance"))


def effective_rank(variances: DataFrame, share: float = 0.9) -> DataFrame:
    """The fewest dimensions, largest first, that hold the share of the variance. One row a dimension comes in."""
    order = Window.orderBy(F.desc("variance"), "d")
    cumulative = variances.withColumn("r", F.row_number().over(order)).withColumn("s", F.sum("variance").over(order)).withColumn("t", F.sum("variance").over(Window.partitionBy()))
    return cumulative.filter(F.col("s") >= share * F.col("t") - 1e-12).agg(F.min("r").alias("effective_rank"))


def project(df: DataFrame, dims: list[int], half: float = 50.0) -> DataFrame:
    """id and one coordinate for each dimension, scaled so that the column's range is [-half, half]."""
    cols = df.select("id", *(F.col("vec")[d].cast("double").alias(f"c{i}") for i, d in enumerate(dims)))
    ends = cols.agg(*(f(f"c{i}").alias(f"{n}{i}") for i in range(len(dims)) for n, f in (("lo", F.min), ("hi", F.max))))
    size = lambda i: F.when(F.col(f"hi{i}") - F.col(f"lo{i}") < 1e-8, 1.0).otherwise(F.col(f"hi{i}") - F.col(f"lo{i}"))
    return cols.join(ends, F.lit(True)).select("id", *(((F.col(f"c{i}") - F.col(f"lo{i}")) / size(i) * (2 * half) - half).alias(f"p{i}") for i in range(len(dims))))


def float_distances(df: DataFrame, anchor: Column) -> DataFrame:
    """id, dist of all other rows to the anchor row."""
    a = df.filter(anchor).select(F.col("id").alias("a_id"), F.col("vec").alias("a_vec"))
    delta = F.zip_with("vec", "a_vec", lambda x, y: x.cast("double") - y.cast("double"))
    return df.join(a, F.col("id") != F.col("a_id")).select("id", F.sqrt(F.aggregate(delta, F.lit(0.0), lambda s, x: s + x * x)).alias("dist"))


def adaptive_cluster(df: DataFrame, anchor: Column, k: int = 8, factor: float = 2.0, most: int = 50) -> DataFrame:
    """Rows within factor times the mean distance of the k nearest to the anchor; the nearest `most` of them."""
    d = float_distances(df, anchor)
    reach = d.orderBy("dist", "id").limit(k).agg((F.avg("dist") * factor).alias("reach"))
    return d.join(reach, F.col("dist") <= F.col("reach")).select("id", "dist").orderBy("dist", "id").limit(most)


def analogy(df: DataFrame, a: Column, b: Column, most: int = 20) -> DataFrame:
    """Rows that lie from A as B does: cosine to B - A above 0.5 and a projection within half of |B - A|."""
    first, second = (df.filter(c).select(F.col("id").alias(f"{n}_id"), F.col("vec").alias(f"{n}_vec")) for n, c in (("a", a), ("b", b)))
    sub = lambda x, y: F.zip_with(x, y, lambda p, q: p.cast("double") - q.cast("double"))
    ends = first.join(second, F.lit(True)).withColumn("dir", sub("b_vec", "a_vec")).withColumn("len", norm(F.col("dir"))).filter("len >= 1e-8")
    rows = df.join(ends, (F.col("id") != F.col("a_id")) & (F.col("id") != F.col("b_id"))).withColumn("delta", sub("vec", "a_vec"))
    rows = rows.withColumn("along", dot(F.col("delta"), F.col("dir")) / F.col("len")).withColumn("cosine", F.col("along") / F.greatest(norm(F.col("delta")), F.lit(1e-12)))
    gap = F.abs(F.col("along") - F.col("len"))
    return rows.filter((F.col("cosine") > 0.5) & (gap < 0.5 * F.col("len"))).select("id", gap.alias("gap")).orderBy(F.round("gap", 9), "id").limit(most)


def retrieve_and_rescore(queries: DataFrame, corpus: DataFrame, k: int, dims: int) -> DataFrame:
    """q, rank, id, score: k nearest by quantised L2, then ordered by exact dot product. Both have id, vec and e."""
    near = knn(queries, corpus.select("id", "e"), k, dims).select("q", "id")
    both = near.join(corpus.select("id", "vec"), "id").join(queries.select(F.col("id").alias("q"), F.col("vec").alias("qvec")), "q")
    scored = both.withColumn("score", dot(F.col("vec"), F.col("qvec")))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc(F.round("score", 9)), "id"))).select("q", "rank", "id", "score")


def movement(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """keys, order, moved: L2 distance of each state of a trace to the one before; a trace is the rows of equal keys."""
    before = F.lag("vec").over(Window.partitionBy(*keys).orderBy(order))
    rows = df.withColumn("before", before).filter("before IS NOT NULL")
    return rows.select(*keys, order, norm(F.zip_with("vec", "before", lambda x, y: x.cast("double") - y.cast("double"))).alias("moved"))


def cosines(queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """decile, n, total, least, most of the cosines of all queries with all other rows; both have id and vec.

    The decile is that of the cosine rounded to 9 places, cut towards zero, from -9 to 9. Every pair counts, so blocks of
    queries meet blocks of rows, and each pair of blocks yields its histogram.
    """

    def unit(table: pa.Table) -> np.ndarray:
        x = np.stack(table.column("vec").to_numpy()).astype(np.float64)
        return x / np.sqrt((x * x).sum(1))[:, None]

    def compare(asking: pa.Table, rows: pa.Table) -> pa.Table:
        if not asking.num_rows or not rows.num_rows:
            return pa.table({"decile": pa.array([], pa.int32()), "n": pa.array([], pa.int64()), "total": pa.array([], pa.float64()), "least": pa.array([], pa.float64()), "most": pa.array([], pa.float64())})
        c = np.round(unit(asking) @ unit(rows).T, 9)
        other = asking.column("id").to_numpy()[:, None] != rows.column("id").to_numpy()[None, :]
        c = c[other]
        decile = np.clip(np.trunc(c * 10), -9, 9).astype(np.int32)
        kinds, where = np.unique(decile, return_inverse=True)
        each = [c[where == i] for i in range(len(kinds))]
        return pa.table({"decile": kinds, "n": pa.array([len(x) for x in each], pa.int64()), "total": [float(x.sum()) for x in each], "least": [float(x.min()) for x in each], "most": [float(x.max()) for x in each]})

    found = index.pairs(queries.select("id", "vec"), corpus.select("id", "vec"), compare, "decile int, n long, total double, least double, most double")
    return found.groupBy("decile").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("least").alias("least"), F.max("most").alias("most"))


def cosine_summary(histogram: DataFrame) -> DataFrame:
    """mean, least, most and pairs of a histogram of cosines."""
    return histogram.agg((F.sum("total") / F.sum("n")).alias("mean"), F.min("least").alias("least"), F.max("most").alias("most"), F.sum("n").alias("pairs"))


def separation(pairs: DataFrame, dims: int) -> DataFrame:
    """similar, dissimilar, ratio, wins, pairs: mean squared distances of paired entries a-b and c-d, and how often the first is the smaller."""
    d = lambda x, y: l2(dense(F.col(x), dims), dense(F.col(y), dims))
    both = pairs.select(d("a", "b").alias("near"), d("c", "d").alias("far"))
    mean = lambda c: F.sum(c).cast("double") / F.count("*")
    out = both.agg(mean("near").alias("similar"), mean("far").alias("dissimilar"), F.sum((F.col("near") < F.col("far")).cast("long")).alias("wins"), F.count("*").alias("pairs"))
    return out.select("similar", "dissimilar", F.when(F.col("similar") > 0, F.col("dissimilar") / F.col("similar")).otherwise(0.0).alias("ratio"), "wins", "pairs")


def identity_report(vecs: DataFrame, queries: Column, k: int, dims: int, settings: list[tuple[float, int | None]]) -> DataFrame:
    """zero, budget, corpus, mean_nnz, realized, confidence, least, most: recall of the index, in per cent, for each (zero threshold, sparsity budget).

    vecs: id, vec. The truth is a comparison of the chosen queries with all rows, in blocks. The quantised rows are computed once.
    """
    out = None
    for zero, budget in settings:
        rows = materialize(vecs.select("id", quantize(F.col("vec"), zero=zero, budget=budget).alias("e")), "quantised")
        asked = rows.filter(queries)
        truth = materialize(index.true_knn(rows, asked, dims, k).select("q", "id"), "truth")
        hits = recall_report(recall(truth, knn(asked, rows, k, dims), k))
        sizes = rows.agg(F.count("*").alias("corpus"), F.avg(F.size("e")).alias("mean_nnz"))
        seen = rows.select(F.explode("e").alias("x")).agg(F.count_distinct("x.d").alias("realized"))
        one = sizes.join(seen, F.lit(True)).join(hits, F.lit(True)).select(
            F.lit(zero).cast("double").alias("zero"), F.lit(budget).cast("int").alias("budget"), "corpus", "mean_nnz", "realized", *((F.col(a) * 100).alias(b) for a, b in (("mean", "confidence"), ("least", "least"), ("most", "most")))
        )
        out = one if out is None else out.unionByName(one)
    return out


def top_variance_dims(variances: DataFrame, n: int = 3) -> DataFrame:
    """d, variance of the n dimensions of the largest variance, largest first, ties to the smaller dimension."""
    return variances.orderBy(F.desc("variance"), "d").limit(n)


def argmax_dot(queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """q, id, score: the row of the largest dot product with each query, the first of equals; both have id and vec."""
    def compare(asking: pa.Table, rows: pa.Table) -> pa.Table:
        if not asking.num_rows or not rows.num_rows:
            return pa.table([asking.column("id").slice(0, 0), rows.column("id").slice(0, 0), pa.array([], pa.float64())], ["q", "id", "score"])
        rows = rows.sort_by("id")
        a, b = (np.stack(t.column("vec").to_numpy()).astype(np.float64) for t in (asking, rows))
        score = np.round(a @ b.T, 9)
        best = score.argmax(1)
        return pa.table([asking.column("id"), rows.column("id").take(pa.array(best)), pa.array(score[np.arange(len(a)), best])], ["q", "id", "score"])

    kind = lambda df: df.schema["id"].dataType.simpleString()
    found = index.pairs(queries.select("id", "vec"), corpus.select("id", "vec"), compare, f"q {kind(queries)}, id {kind(corpus)}, score double")
    best = found.groupBy("q").agg(F.min_by(F.struct("id", "score"), F.struct(-F.col("score"), F.col("id"))).alias("b"))
    return best.select("q", "b.id", "b.score")


def hue(key: Column) -> Column:
    """Golden-angle hue of a number, in degrees."""
    return F.pmod(key.cast("decimal(20,0)") * F.lit(137.508).cast("decimal(9,3)"), F.lit(360)).cast("double")


def magnitude_key(vec: Column) -> Column:
    """Length over 10, at most 1."""
    return F.least(norm(vec) / 10, F.lit(1.0))


def letter_hue(label: Column) -> Column:
    """Hue by the first character: letters around the circle, digits 60, others 0; null for an empty label."""
    first = F.lower(F.substring(label, 1, 1))
    return F.when(F.length(label) == 0, F.lit(None).cast("double")).when(first.rlike("^[a-z]$"), (F.ascii(first) - 97) * (360.0 / 26)).when(first.rlike("^[0-9]$"), 60.0).otherwise(0.0)


def find_token(tokens: DataFrame, text: str) -> DataFrame:
    """id, token of the first token that equals a text, or else of the first that contains it, in any case. tokens: id, token."""
    asked = text.strip().lower()
    lower = F.lower("token")
    found = tokens.filter(F.contains(lower, F.lit(asked))) if asked else tokens.limit(0)
    return found.orderBy((lower != asked).cast("int"), "id").limit(1).select("id", "token")


def greedy_tokens(prompts: DataFrame, tokens: list[str], most: int = 50) -> DataFrame:
    """prompts (id, text) with ids: the longest token at each place, in any case.

    A place without a token is skipped, and reading ends after more than `most` tokens. Of tokens alike the first counts.
    """
    plain: dict[int, dict[str, int]] = {}
    for i, token in enumerate(tokens):
        if token:
            plain.setdefault(len(token), {}).setdefault(token.lower(), i)
    sizes = sorted(plain, reverse=True)

    def read(text: str) -> list[int]:
        text, out, at = text.strip().lower(), [], 0
        while at < len(text) and len(out) <= most:
            size = next((n for n in sizes if text[at : at + n] in plain[n]), None) if at < len(text) else None
            if size is None:
                at += 1
                continue
            out.append(plain[size][text[at : at + size]])
            at += size
        return out

    def rows(batches):
        for batch in batches:
            found = pa.array([read(x or "") for x in batch.column("text").to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), found], ["id", "ids"])

    return prompts.select("id", "text").mapInArrow(rows, f"id {prompts.schema['id'].dataType.simpleString()}, ids array<int>")


# Dense integer vectors (arrays of bigint): exact algebra.
def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def scale_up(a: Column, factor: Column) -> Column:
    return F.transform(a, lambda x: x * factor)


def scale_down(a: Column, divisor: Column) -> Column:
    """Quotients cut towards zero."""
    return F.transform(a, lambda x: ((x - F.when(x < 0, -F.pmod(-x, F.abs(divisor))).otherwise(F.pmod(x, F.abs(divisor)))) / divisor).cast("long"))


def midpoints(a: Column, b: Column) -> Column:
    """Floors of the means, without overflow."""
    return F.zip_with(a, b, lambda x, y: x.bitwiseAND(y) + F.shiftright(x.bitwiseXOR(y), 1))


def exact_dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: (x.cast("decimal(19,0)") * y.cast("decimal(19,0)")).cast("decimal(38,0)"))
    return F.aggregate(products, F.lit(0).cast("decimal(38,0)"), lambda s, x: (s + x).cast("decimal(38,0)"))


def sum_abs(a: Column) -> Column:
    return F.aggregate(F.transform(a, F.abs), F.lit(0).cast("decimal(38,0)"), lambda s, x: (s + x).cast("decimal(38,0)"))


def meets_hypersphere(low: Column, high: Column, center: Column, square: Column) -> Column:
    """Whether a closed box meets a sphere of the given squared radius: the centre clamped to it is near enough."""
    clamped = F.zip_with(F.zip_with(low, center, lambda a, c: F.greatest(a, c)), high, lambda c, b: F.least(c, b))
    return l2(center, clamped) <= square


def halves(low: Column, high: Column, d: int) -> tuple[tuple[Column, Column], tuple[Column, Column]]:
    """The boxes below and from the middle of a dimension on."""
    middle = F.zip_with(low, high, lambda x, y: x.bitwiseAND(y) + F.shiftright(x.bitwiseXOR(y), 1))
    put = lambda into: F.transform(F.arrays_zip(into.alias("x"), middle.alias("m")), lambda z, i: F.when(i == d, z["m"]).otherwise(z["x"]))
    return (low, put(high)), (put(low), high)


def in_region(e: Column, low: dict[int, int], high: dict[int, int]) -> Column:
    """Closed box over some dimensions (the others are free)."""
    fit = F.lit(True)
    for d in low:
        fit = fit & value_at(e, d).between(low[d], high[d])
    return fit

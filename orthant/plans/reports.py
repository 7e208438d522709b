"""Queries of reports, vector algebra, text indexes, model blocks and signals."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ..functions import signal
from ..model import embedding, fixed_point
from ..model.tokenizers import WordPieces
from ..operators import documents, lineage, vectors
from ..sources import model_file, points, stores
from .registry import query, table


def dense(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))


@query("WITH v AS (SELECT i - 1 AS d, var_pop(CAST(embedding[i] AS DOUBLE)) AS variance FROM embeddings, range(1, 65) r(i) GROUP BY 1) SELECT CAST(d AS INT) AS d, round(variance, 9) AS variance FROM v ORDER BY v.variance DESC, d LIMIT 3")
def top_variance_dims(spark, d):
    return vectors.top_variance_dims(vectors.float_variances(dense(spark, d))).select("d", F.round("variance", 9).alias("variance"))


@query("""WITH s AS (SELECT a.vec_id AS q, b.vec_id AS id, round(list_sum([CAST(a.embedding[i] AS DOUBLE) * CAST(b.embedding[i] AS DOUBLE) for i in range(1, 65)]), 9) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0 AND b.vec_id % 100 <> 0),
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS k FROM s) SELECT q, id, round(score, 7) AS score FROM r WHERE k = 1""")
def argmax_dot(spark, d):
    e = dense(spark, d)
    return vectors.argmax_dot(e.filter("id % 100 = 0"), e.filter("id % 100 <> 0")).select("q", "id", F.round("score", 7).alias("score"))


WHOLE = "iv AS (SELECT vec_id AS id, [CAST(trunc(CAST(x AS DOUBLE) * 1000000) AS BIGINT) for x in embedding] AS v FROM embeddings), ab AS (SELECT a.id, a.v AS a, b.v AS b FROM iv a JOIN iv b ON b.id = a.id + 1)"


def pairs(spark, d):
    """Whole-number vectors beside the one of the next id."""
    v = dense(spark, d).select("id", F.transform("vec", lambda x: (x.cast("double") * 1e6).cast("long")).alias("v"))
    return v.select("id", F.col("v").alias("a")).join(v.select((F.col("id") - 1).alias("id"), F.col("v").alias("b")), "id")


@query(f"""WITH {WHOLE}, n AS (SELECT *, unnest(range(1, 65)) AS i FROM ab) SELECT id, CAST(i - 1 AS INT) AS d, a[i] + b[i] AS added, a[i] - b[i] AS taken, a[i] * 7 AS times, CAST(trunc(a[i] / 7.0) AS BIGINT) AS parts, CAST(floor((a[i] + b[i]) / 2.0) AS BIGINT) AS middle FROM n""")
def dense_algebra(spark, d):
    a, b = F.col("a"), F.col("b")
    zipped = F.arrays_zip(vectors.add(a, b).alias("added"), vectors.subtract(a, b).alias("taken"), vectors.scale_up(a, F.lit(7)).alias("times"), vectors.scale_down(a, F.lit(7)).alias("parts"), vectors.midpoints(a, b).alias("middle"))
    return pairs(spark, d).select("id", F.posexplode(zipped).alias("d", "x")).select("id", "d", *(F.col(f"x.{c}").alias(c) for c in ("added", "taken", "times", "parts", "middle")))


@query(f"WITH {WHOLE} SELECT id, CAST(list_sum([CAST(a[i] AS HUGEINT) * b[i] for i in range(1, 65)]) AS VARCHAR) AS dot, CAST(list_sum([abs(x) for x in a]) AS VARCHAR) AS size FROM ab")
def dense_products(spark, d):
    return pairs(spark, d).select("id", vectors.exact_dot(F.col("a"), F.col("b")).cast("string").alias("dot"), vectors.sum_abs(F.col("a")).cast("string").alias("size"))


@query(f"""WITH {WHOLE}, x AS (SELECT id, a AS c, [least(p, q) for p, q in list_zip(a, b)] AS unused, [b[i] - 100000 for i in range(1, 65)] AS low, [b[i] + 100000 for i in range(1, 65)] AS high FROM ab)
SELECT id, list_sum([CAST(c[i] - greatest(low[i], least(high[i], c[i])) AS HUGEINT) * (c[i] - greatest(low[i], least(high[i], c[i]))) for i in range(1, 65)]) <= 600000000000 AS meets,
c[4] <= CAST(floor((low[4] + high[4]) / 2.0) AS BIGINT) AS below FROM x""".replace(" [least(p, q) for p, q in list_zip(a, b)] AS unused,", ""))
def box_meets_sphere(spark, d):
    low, high, c = (F.transform("b", lambda x: x - 100000), F.transform("b", lambda x: x + 100000), F.col("a"))
    (_, half), _ = vectors.halves(low, high, 3)
    meets = vectors.meets_hypersphere(low, high, c, F.lit(600_000_000_000).cast("decimal(38,0)"))
    return pairs(spark, d).select("id", meets.alias("meets"), (c[3] <= half[3]).alias("below"))


SPARSE = "z AS (SELECT vec_id AS id, i - 1 AS d, CAST(trunc(CAST(embedding[i] AS DOUBLE) * 1000000000) AS BIGINT) AS v FROM embeddings, range(1, 65) r(i) WHERE abs(embedding[i]) >= CAST({0} AS FLOAT)), s AS (SELECT * FROM z WHERE v <> 0)"


@query(f"WITH {SPARSE.format('0.1')}, u AS (SELECT id, d, v AS a, 0 AS b FROM s UNION ALL SELECT id - 1, d, 0, v FROM s), g AS (SELECT id, d, sum(a) - sum(b) AS g FROM u WHERE id IN (SELECT vec_id FROM embeddings) AND id + 1 IN (SELECT vec_id FROM embeddings) GROUP BY 1, 2) SELECT id, CAST(sum(CAST(g AS HUGEINT) * CAST(g AS HUGEINT)) AS VARCHAR) AS l2, CAST(sum(abs(CAST(g AS HUGEINT))) AS VARCHAR) AS l1 FROM g GROUP BY id")
def sparse_distances(spark, d):
    e = dense(spark, d).select("id", vectors.quantize(F.col("vec"), zero=0.1).alias("e"))
    both = e.select("id", F.col("e").alias("a")).join(e.select((F.col("id") - 1).alias("id"), F.col("e").alias("b")), "id").filter(F.size("a") + F.size("b") > 0)
    return both.select("id", vectors.sparse_l2(F.col("a"), F.col("b")).cast("string").alias("l2"), vectors.sparse_l1(F.col("a"), F.col("b")).cast("string").alias("l1"))


@query(f"WITH {SPARSE.format('0.1')} SELECT CAST(d AS INT) AS d, count(*) AS rows FROM s GROUP BY d ORDER BY rows DESC, d LIMIT 10")
def active_dims(spark, d):
    return vectors.active_dims(dense(spark, d).select("id", vectors.quantize(F.col("vec"), zero=0.1).alias("e")))


@query(f"""WITH {SPARSE.format('0.01')}, f AS (SELECT e.vec_id AS id, r.d, coalesce(v, 0) AS v FROM embeddings e CROSS JOIN range(64) r(d) LEFT JOIN s ON s.id = e.vec_id AND s.d = r.d),
g AS (SELECT a.id, sum(CASE WHEN b.id = a.id + 1 THEN CAST(a.v - b.v AS HUGEINT) * (a.v - b.v) END) AS near, sum(CASE WHEN b.id = a.id + 2 THEN CAST(a.v - b.v AS HUGEINT) * (a.v - b.v) END) AS far FROM f a JOIN f b ON b.d = a.d AND b.id IN (a.id + 1, a.id + 2) WHERE a.id % 100 = 0 GROUP BY a.id HAVING count(DISTINCT b.id) = 2)
SELECT round(CAST(sum(near) AS DOUBLE) / count(*) / 1e18, 9) AS similar, round(CAST(sum(far) AS DOUBLE) / count(*) / 1e18, 9) AS dissimilar, round((CAST(sum(far) AS DOUBLE) / count(*)) / (CAST(sum(near) AS DOUBLE) / count(*)), 9) AS ratio, CAST(sum(CASE WHEN near < far THEN 1 ELSE 0 END) AS BIGINT) AS wins, count(*) AS pairs FROM g""")
def separation(spark, d):
    e = dense(spark, d).select("id", vectors.quantize(F.col("vec")).alias("e"))
    shifted = lambda k, name: e.select((F.col("id") - k).alias("id"), F.col("e").alias(name))
    both = e.filter("id % 100 = 0").select("id", F.col("e").alias("a"), F.col("e").alias("c")).join(shifted(1, "b"), "id").join(shifted(2, "d"), "id")
    found = vectors.separation(both, 64)
    return found.select(*(F.round(F.col(c) / 1e18, 9).alias(c) for c in ("similar", "dissimilar")), F.round("ratio", 9).alias("ratio"), "wins", "pairs")


def _identity(zero: str, budget: str) -> str:
    ranked = f"(SELECT *, row_number() OVER (PARTITION BY id ORDER BY abs(v) DESC, d) AS k FROM (SELECT vec_id AS id, i - 1 AS d, CAST(trunc(CAST(embedding[i] AS DOUBLE) * 1000000000) AS BIGINT) AS v FROM embeddings, range(1, 65) r(i) WHERE abs(embedding[i]) >= CAST({zero} AS FLOAT)) WHERE v <> 0)"
    return f"SELECT CAST({zero} AS DOUBLE) AS zero, CAST({budget} AS INT) AS budget, (SELECT count(*) FROM embeddings) AS corpus, round(count(*) / (SELECT count(*) FROM embeddings), 9) AS mean_nnz, count(DISTINCT d) AS realized, CAST(100 AS DOUBLE) AS confidence, CAST(100 AS DOUBLE) AS least, CAST(100 AS DOUBLE) AS most FROM {ranked} WHERE k <= coalesce({budget}, 64)"


@query(" UNION ALL ".join(_identity(z, b) for z, b in (("0.0", "NULL"), ("0.05", "NULL"), ("0.01", "8"))))
def identity_report(spark, d):
    found = vectors.identity_report(dense(spark, d), F.col("id") % 100 == 0, 5, 64, [(0.0, None), (0.05, None), (0.01, 8)])
    return found.withColumn("mean_nnz", F.round("mean_nnz", 9))


@query("SELECT o_orderkey, o_totalprice, contains(lower(o_orderpriority), 'urgent') AS compatible FROM orders ORDER BY compatible DESC, o_totalprice DESC, o_orderkey LIMIT 20")
def rank_results(spark, d):
    o = table(spark, d, "orders")
    return documents.rank_results(o, 20, "o_orderpriority", "o_totalprice", "Urgent").select("o_orderkey", "o_totalprice", "compatible")


@query("WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT event_type, value AS at FROM r WHERE k = CAST(floor(n * 0.99) AS BIGINT)")
def p99(spark, d):
    return documents.value_at(table(spark, d, "events"), ["event_type"], "value", 0.99)


@query("SELECT n_nationkey AS id, n_name AS token FROM nation WHERE contains(lower(n_name), 'an') ORDER BY CASE WHEN lower(n_name) = 'an' THEN 0 ELSE 1 END, n_nationkey LIMIT 1")
def find_token(spark, d):
    return vectors.find_token(table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("token")), " An ")


TOKENS = ["", "the", "t", "h", "e", "▁the", "and", "an", "a", "tion", "ing", " ", "er", "en", "der", "ch", "sch", "li", "lic", "license", "o", "n", "r", "s", "i"]


@query()
def greedy_tokens(spark, d):
    found = vectors.greedy_tokens(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), TOKENS)
    return found.select("id", F.posexplode("ids").alias("place", "token"))


PIECES = ["[UNK]", "[CLS]", "[SEP]", "the", "and", "an", "##d", "##the", "th", "##e", "##er", "##tion", "##ing", "t", "##t", "##h", "##a", "##n", "a", "e", "i", "o", ".", ",", "##i", "##o", "##r", "##s", "##l", "s", "r", "l"]


@query()
def word_pieces(spark, d):
    pieces = PIECES

    def rows(batches):
        tokenizer = WordPieces({p: i for i, p in enumerate(pieces)})
        for batch in batches:
            found = pa.array([tokenizer.encode(t or "") for t in batch.column("text").to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), found], ["doc_id", "ids"])

    return table(spark, d, "documents").select("doc_id", "text").mapInArrow(rows, "doc_id long, ids array<int>").select("doc_id", F.posexplode("ids").alias("place", "piece"))


@query("SELECT p_partkey, CAST(j AS INT) AS j, 0.5 * CAST((p_partkey * (j + 1)) % 256 - 128 AS DOUBLE) AS q8, 0.5 * CAST((CASE WHEN j < 16 THEN ((p_partkey + (j // 1)) % 256) END) AS DOUBLE) AS unused FROM part, range(32) r(j)".replace(", 0.5 * CAST((CASE WHEN j < 16 THEN ((p_partkey + (j // 1)) % 256) END) AS DOUBLE) AS unused", ""))
def dequantise_blocks(spark, d):
    def rows(batches):
        for batch in batches:
            keys = batch.column("p_partkey").to_numpy()
            body = ((keys[:, None] * np.arange(1, 33)) % 256 - 128).astype(np.int8)
            blocks = np.concatenate([np.full((len(keys), 1), 0.5, "<f2").view(np.uint8), body.view(np.uint8)], 1)
            values = model_file.dequantise("Q8_0", blocks.tobytes()).astype(float)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(keys, 32)), pa.array(np.tile(np.arange(32, dtype=np.int32), len(keys))), pa.array(values)], ["p_partkey", "j", "q8"])

    return table(spark, d, "part").select("p_partkey").mapInArrow(rows, "p_partkey long, j int, q8 double")


HASHED = """w AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(text, '[ \\n\\r\\t.,(){}\\[\\];:<>=/*+!?"''\\\\-]'), lambda w: w <> '')) AS w FROM documents),
h AS (SELECT doc_id, list_reduce(list_prepend(CAST(5381 AS BIGINT), [CAST(unicode(c) AS BIGINT) for c in string_split(w, '')]), lambda a, x: xor(a * 33, x) & 4294967295) AS h FROM w),
e AS (SELECT doc_id AS id, abs(CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END) % 64 AS d, count(*) AS v FROM h GROUP BY 1, 2)"""


@query(f"""WITH {HASHED}, f AS (SELECT doc_id AS id, r.d, coalesce(v, 0) AS v FROM documents CROSS JOIN range(64) r(d) LEFT JOIN e ON e.id = doc_id AND e.d = r.d),
l AS (SELECT a.id AS q, b.id, sum((a.v - b.v) * (a.v - b.v)) AS dist FROM f a JOIN f b USING (d) WHERE a.id % 100 = 0 GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY dist, id) AS rank FROM l)
SELECT q, rank, id, CAST(dist * CAST(1000000000000000000 AS HUGEINT) AS VARCHAR) AS dist FROM k WHERE rank <= 3""")
def text_index(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    source = embedding.HashSource(64)
    built = embedding.build_index(docs, source)
    found = vectors.knn(embedding.embedded(docs.filter("id % 100 = 0"), source), built, 3, 64)
    return found.select("q", F.col("rank").cast("long").alias("rank"), "id", F.col("dist").cast("string").alias("dist"))


@query("WITH e AS (SELECT event_id AS i, value, count(*) OVER () AS n, min(event_id) OVER () AS i0 FROM events) SELECT ((i - i0 + 1) * 200 + n - 1) // n - 1 AS point, max(abs(value)) AS value FROM e GROUP BY 1")
def downsample(spark, d):
    events = table(spark, d, "events")
    first = events.agg(F.min("event_id").alias("first"))
    rows = events.join(first, F.lit(True)).select(F.lit("all").alias("series"), (F.col("event_id") - F.col("first")).alias("i"), "value")
    return signal.downsample(rows, 200).select("point", "value")


@query("SELECT c_custkey, CASE WHEN c_custkey % 30 < 10 THEN 'high-energy' WHEN c_custkey % 30 < 20 THEN 'moderate-energy' ELSE 'soft, ambient' END || ', ' || CASE WHEN c_custkey % 200 > 140 THEN 'fast-tempo' WHEN c_custkey % 200 > 100 THEN 'mid-tempo' WHEN c_custkey % 200 > 60 THEN 'relaxed-tempo' ELSE 'very slow' END || ' (' || c_custkey % 200 || ' BPM), ' || CASE WHEN c_custkey > 3000 THEN 'bright, trebly' WHEN c_custkey > 1500 THEN 'balanced spectrum' ELSE 'dark, bassy' END AS vibe FROM customer")
def vibes(spark, d):
    c = F.col("c_custkey")
    return table(spark, d, "customer").select("c_custkey", signal.vibe(-(c % 30).cast("double") - 0.5, (c % 200).cast("double"), c.cast("double")).alias("vibe"))


def scratch(spark, label: str) -> str:
    return f"{lineage.scratch_dir(spark)}/orthant-{label}-{uuid.uuid4().hex}"


@query("SELECT l_orderkey AS x, l_partkey AS y, -l_suppkey AS z FROM lineitem")
def point_files(spark, d):
    path = scratch(spark, "points")
    lines = F.concat_ws(", ", *(F.col(c).cast("string") for c in ("l_orderkey", "l_partkey")), (-F.col("l_suppkey")).cast("string"))
    table(spark, d, "lineitem").select(F.explode(F.array(F.lit("# x, y, z"), lines)).alias("value")).write.text(path)
    return points.read_points(spark, path).select("x", "y", "z")


@query("SELECT embedding[1] AS x, embedding[2] AS y, embedding[64] AS z FROM embeddings")
def embedding_rows(spark, d):
    path = scratch(spark, "rows")
    table(spark, d, "embeddings").select(F.array_join(F.transform("embedding", lambda x: x.cast("string")), ", ").alias("value")).write.text(path)
    return points.read_embeddings(spark, path).select(F.col("vec")[0].alias("x"), F.col("vec")[1].alias("y"), F.col("vec")[63].alias("z"))


@query("SELECT o_orderkey AS key, CASE WHEN o_orderkey % 3 = 0 THEN 2 ELSE 1 END AS version, o_custkey + CASE WHEN o_orderkey % 3 = 0 THEN 1000 ELSE 0 END AS value FROM orders WHERE o_orderkey % 5 <> 0")
def record_store(spark, d):
    path, o = scratch(spark, "store"), table(spark, d, "orders")
    record = lambda version, more, gone: (F.col("o_orderkey").alias("key"), F.lit(version).alias("version"), gone.alias("deleted"), (F.col("o_custkey") + more).alias("value"))
    stores.append_records(o.select(*record(1, 0, F.lit(False))), path)
    stores.append_records(o.filter("o_orderkey % 3 = 0").select(*record(2, 1000, F.lit(False))), path)
    stores.append_records(o.filter("o_orderkey % 5 = 0").select(*record(3, 0, F.lit(True))), path)
    return stores.read_records(spark, path, "key long, version int, deleted boolean, value long").select("key", "version", "value")


@query(f"WITH {SPARSE.format('0.01')} SELECT id, CAST(d AS INT) AS d, v FROM s")
def saved_index(spark, d):
    path = scratch(spark, "index")
    stores.save_index(dense(spark, d).select("id", vectors.quantize(F.col("vec")).alias("e")), path)
    return stores.load_index(spark, path).select("id", F.explode("e").alias("x")).select("id", "x.d", "x.v")


@query("SELECT o_orderkey, CAST(floor(sqrt(CAST(o_orderkey * 12345 + 7 AS DOUBLE))) AS BIGINT) AS root FROM orders")
def integer_roots(spark, d):
    def rows(batches):
        for batch in batches:
            keys = batch.column("o_orderkey").to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column("o_orderkey"), pa.array([fixed_point.isqrt(k * 12345 + 7) for k in keys], pa.int64())], ["o_orderkey", "root"])

    return table(spark, d, "orders").select("o_orderkey").mapInArrow(rows, "o_orderkey long, root long")

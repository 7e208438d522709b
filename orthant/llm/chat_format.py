"""Chat formatting: cumulative snapshots of a conversation are collapsed before it is rendered.

Logs often hold a conversation many times, each time with a few turns more. Every turn gets a hash of its place,
role and text; the running sums of two such hashes are the rolling hashes of the conversation's prefixes. A
conversation whose last prefix hash is an inner prefix hash of another one is dropped by an anti-join, and of
conversations that are alike throughout the one of the least id stays. The others are rendered, a row for each
`BLOCK` turns, so that no row grows with the longest conversation (most have one row).

Only DataFrame functions are used. Turns are dealt out by ranges, and places within a conversation come from two levels
(within its part of a range, then over its parts), so neither a conversation that holds much of the table nor one whose
turns all have one number is sorted in one task; prefix hashes are made distinct with partial aggregation before the
anti-join, so a common opening isn't a hot key; very long conversations meet their verdict in a broadcast join.

Defined cases: repeated rows count once; turns of the same number are ordered by role and text; a null turn comes
before the others; a null role is rendered as "user" and a null text as empty, and both are compared as such; rows
without a conversation id are dropped; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, skew_join, table

BLOCK = 256
#: ChatML markers.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _running(rows: DataFrame, order: list, values: dict, totals: tuple[str, ...] = ()) -> DataFrame:
    """Running sums over a conversation: within (conv_id, part), plus the sums of its earlier parts; n_<value>: the whole sum of those in totals."""
    inner = Window.partitionBy("conv_id", "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    within = rows.select("*", *(F.sum(v).over(inner).alias(f"in_{n}") for n, v in values.items()))
    parts = rows.groupBy("conv_id", "part").agg(*(F.sum(v).alias(f"sum_{n}") for n, v in values.items()))
    conversation = Window.partitionBy("conv_id")
    earlier = conversation.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = (F.coalesce(F.sum(f"sum_{n}").over(earlier), F.lit(0)).alias(f"base_{n}") for n in values)
    bases = parts.select("conv_id", "part", *sums, *(F.sum(f"sum_{n}").over(conversation).alias(f"n_{n}") for n in totals))
    joined = within.join(bases, ["conv_id", "part"])
    return joined.select(*rows.columns, *((F.col(f"in_{n}") + F.col(f"base_{n}")).alias(n) for n in values), *(f"n_{n}" for n in totals))


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, part, turn, role, text, place (from 1), n_place, h1, h2: distinct turns with their rolling prefix hashes.

    The distinct turns are dealt out by ranges of (conversation, turn, role, text), and a part is what one range has of a
    conversation; it is written down, so parts stay as they are whatever executors are lost.
    """
    spark = conversations.sparkSession
    plain = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    rows = materialize(plain.distinct(), "turns")
    ranges = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), F.col("conv_id"), *order)
    parted = materialize(ranges.withColumn("part", F.spark_partition_id()), "parts")
    placed = _running(parted, order, {"place": F.lit(1)}, ("place",))
    digest = lambda salt: F.xxhash64(F.lit(salt), "place", "role", "text").cast("decimal(20,0)")
    return _running(placed, ["place"], {"h1": digest(1), "h2": digest(2)})


def maximal(placed: DataFrame) -> DataFrame:
    """conv_id, n_turns of the conversations that no longer one begins with; one of those that are alike."""
    marked = placed.select("conv_id", "place", F.col("n_place").alias("n_turns"), "h1", "h2")
    whole = marked.filter("place = n_turns").groupBy("place", "h1", "h2").agg(F.min("conv_id").alias("conv_id"))
    inner = marked.filter("place < n_turns").select("place", "h1", "h2").distinct()
    return whole.join(inner, ["place", "h1", "h2"], "left_anti").select("conv_id", F.col("place").alias("n_turns"))


def render(placed: DataFrame, kept: DataFrame) -> DataFrame:
    """conv_id, block, n_turns, first_turn, text: the kept conversations in ChatML, BLOCK turns a row."""
    one = F.concat(F.lit(OPEN), "role", F.lit("\n"), "text", F.lit(CLOSE + "\n"))
    pieces = skew_join(placed.select("conv_id", "place", one.alias("piece")), kept, ["conv_id"], "n_turns", placed.count())
    pieces = pieces.withColumn("block", F.floor((F.col("place") - 1) / BLOCK))
    rows = pieces.groupBy("conv_id", "block").agg(F.max("n_turns").alias("n_turns"), F.sort_array(F.collect_list(F.struct("place", "piece"))).alias("x"))
    return rows.select("conv_id", "block", "n_turns", F.col("x")[0]["place"].alias("first_turn"), F.array_join("x.piece", "").alias("text"))


def format_chats(conversations: DataFrame) -> DataFrame:
    placed = materialize(turns(conversations), "placed")
    return render(placed, materialize(maximal(placed), "maximal"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(table(spark, sf_dir, "conversations"))


SQL = f"""
WITH d AS (
  SELECT DISTINCT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, 'user') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place FROM d),
q AS (
  SELECT conv_id, place, list(role || chr(10) || text) OVER (PARTITION BY conv_id ORDER BY place) AS prefix,
    count(*) OVER (PARTITION BY conv_id) AS n_turns FROM p),
whole AS (SELECT prefix, min(conv_id) AS conv_id, min(n_turns) AS n_turns FROM q WHERE place = n_turns GROUP BY prefix),
kept AS (SELECT * FROM whole w WHERE NOT EXISTS (SELECT 1 FROM q WHERE q.place < q.n_turns AND q.prefix = w.prefix))
SELECT p.conv_id, (place - 1) // {BLOCK} AS block, kept.n_turns, min(place) AS first_turn,
  string_agg('{OPEN}' || role || chr(10) || text || '{CLOSE}' || chr(10), '' ORDER BY place) AS text
FROM p JOIN kept USING (conv_id) GROUP BY p.conv_id, (place - 1) // {BLOCK}, kept.n_turns
"""

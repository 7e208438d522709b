"""Quality rules with thresholds taken from mergeable quantile sketches per language and source.

Every document gets the base signals of its whole text. The documents that pass the base rules are
summarised in log-linear histograms (one for each language, source and metric): a value below 128 has a
bucket of its own, a larger one shares the bucket of its six leading bits, so a quantile is off by at most
1/64. Bucket counts add, so sketches of sources merge to those of a language, and these to the corpus's.
Fences of quartile plus a multiple of the interquartile range replace fixed cutoffs; a group of fewer than
`min_group` documents takes those of its language, or else of the corpus.

Defined cases: null text counts as empty (zero words, base_failed); null language or source form a group of
their own (as the empty string); repeated rows are judged each; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, slices, table, utf8_list

SYMBOLS = b"#*$%&|<>"
BLANKS = b" \t\n\v\f\r"
CONTINUATION = bytes(range(0x80, 0xC0))
CAPITALS = bytes(range(0x41, 0x5B))
SIGNALS = "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_capitals long"
SALTS = 16

#: metric: integer expression; smallest interquartile range that counts.
METRICS = {
    "symbols": ("div_1000(n_symbols, n_words)", 20),
    "dup_lines": ("div_1000(n_dup_lines, n_lines)", 60),
    "repeats": ("div_1000(n_repeat_words, n_words)", 60),
    "capitals": ("div_1000(n_capitals, word_chars)", 60),
    "word_length": ("div_1000(word_chars, n_words)", 600),
}


def _repeat_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window found twice or more."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    found, covered, total = Counter(windows), 0, 0
    for i, window in enumerate(windows):
        if found[window] > 1:
            total += i + 3 - max(i, covered)
            covered = i + 3
    return total


def _signals(batches):
    for part in slices(batches):
        rows = []
        for text in utf8_list(part.column("text")):
            words, seen, dup, lines = text.split(), set(), 0, 0
            for line in text.split(b"\n"):
                if line.strip():
                    lines += 1
                    dup += line in seen
                    seen.add(line)
            rows.append((
                len(words), len(text.translate(None, CONTINUATION + BLANKS)), len(text) - len(text.translate(None, SYMBOLS)),
                dup, _repeat_words(words), lines, len(text) - len(text.translate(None, CAPITALS)),
            ))
        columns = [pa.array(x, pa.int64()) for x in zip(*rows)]
        names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals"]
        yield pa.RecordBatch.from_arrays([*(part.column(x) for x in ("doc_id", "lang", "source")), *columns], ["doc_id", "lang", "source", *names])


def signals(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source (null: empty) and the base signals of each whole text."""
    plain = docs.select(F.col("doc_id").cast("long"), "text", *(F.coalesce(F.col(x), F.lit("")).alias(x) for x in ("lang", "source")))
    return plain.mapInArrow(_signals, SIGNALS)


def _metrics() -> list:
    out = []
    for name, (call, _) in METRICS.items():
        top, bottom = call[len("div_1000(") : -1].split(", ")
        out.append(F.expr(f"CASE WHEN {bottom} > 0 THEN (1000 * {top}) div {bottom} ELSE 0L END").alias(name))
    return out


#: The bucket of v and the least value of bucket b.
BUCKET = "CASE WHEN v < 128 THEN v ELSE 64L * (length(bin(v)) - 7) + shiftright(v, length(bin(v)) - 7) END"
LEAST = "CASE WHEN b < 128 THEN b ELSE shiftleft(b % 64 + 64, CAST(b div 64 - 1 AS INT)) END"


def sketches(measured: DataFrame) -> DataFrame:
    """lang, source, metric, b, n: the histogram of each group; adding n merges groups."""
    pairs = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in METRICS))).alias("x")
    return measured.select("lang", "source", pairs).select("lang", "source", "x.metric", F.col("x.v").alias("v")).withColumn("b", F.expr(BUCKET)).groupBy("lang", "source", "metric", "b").agg(F.count("*").alias("n"))


def quartiles(sketch: DataFrame, *keys: str) -> DataFrame:
    """Lower and upper quartile by key and metric: the bucket that holds rank floor(q (n - 1))."""
    merged = sketch.groupBy(*keys, "metric", "b").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*keys, "metric")
    ranked = merged.withColumn("upto", F.sum("n").over(group.orderBy("b"))).withColumn("total", F.sum("n").over(group))
    at = lambda q: F.min(F.when(F.col("upto") > F.expr(f"((total - 1) * {q}) div 4"), F.expr(LEAST)))
    return ranked.groupBy(*keys, "metric").agg(at(1).alias("q1"), at(3).alias("q3"), F.max("total").alias("total"))


def fences(sketch: DataFrame, min_group: int, width: int) -> DataFrame:
    """One row for each language and source: low and high limits by metric."""
    own, by_lang, overall = quartiles(sketch, "lang", "source"), quartiles(sketch, "lang"), quartiles(sketch)
    named = lambda df, tag: df.select(*[c for c in ("lang", "source", "metric") if c in df.columns], *(F.col(c).alias(f"{tag}_{c}") for c in ("q1", "q3", "total")))
    joined = named(own, "a").join(named(by_lang, "b"), ["lang", "metric"]).join(named(overall, "c"), "metric")
    pick = lambda c: F.when(F.col("a_total") >= min_group, F.col(f"a_{c}")).when(F.col("b_total") >= min_group, F.col(f"b_{c}")).otherwise(F.col(f"c_{c}"))
    limits = joined.select("lang", "source", "metric", pick("q1").alias("q1"), pick("q3").alias("q3"))
    columns = []
    for name, (_, least) in METRICS.items():
        spread = F.greatest(F.col("q3") - F.col("q1"), F.lit(least).cast("long"))
        columns.append(F.max(F.when(F.col("metric") == name, F.col("q3") + width * spread)).alias(f"{name}_high"))
        if name == "word_length":
            columns.append(F.max(F.when(F.col("metric") == name, F.col("q1") - width * spread)).alias(f"{name}_low"))
    return limits.groupBy("lang", "source").agg(*columns)


def quality_rules(docs: DataFrame, min_group: int = 100, width: int = 3) -> DataFrame:
    """Base signals, base_failed, kept and the metrics with their limits, one row for each row of docs."""
    measured = materialize(signals(docs), "signals").select("*", *_metrics())
    measured = measured.withColumn("base_failed", F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words"))
    limits = fences(sketches(measured.filter(~F.col("base_failed"))), min_group, width)
    salted = limits.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = measured.withColumn("salt", F.pmod(F.xxhash64("doc_id", "n_words", "word_chars"), F.lit(SALTS)).cast("int"))
    judged = rows.join(salted, ["lang", "source", "salt"], "left").drop("salt")
    fits = F.col("word_length") >= F.col("word_length_low")
    for name in METRICS:
        fits = fits & (F.col(name) <= F.col(f"{name}_high"))
    return judged.withColumn("kept", ~F.col("base_failed") & F.coalesce(fits, F.lit(False)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", *METRICS)

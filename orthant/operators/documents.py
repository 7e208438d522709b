"""Documents (doc, text): chunk relevance, context, ingest; preference weights; catalog operators."""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as t


# Style words that preference signals are read from.
SIGNAL_TERMS = (
    "anime", "realistic", "painterly", "cinematic", "wide", "close-up", "bold", "dark", "bright", "saturated", "desaturated", "detailed", "minimal", "dramatic", "soft", "hard", "warm", "cool",
    "purple", "amber", "copper", "blue", "motion", "still", "crowds", "solo", "scale contrast", "geometric", "organic", "kubrick", "easley", "moebius", "studio khara", "concept art", "paperback",
    "poster", "portrait", "landscape", "16:9", "3:2", "1:1", "high detail", "low detail", "sharp", "blurry",
)


def relevance(docs: DataFrame, query: str, k: int = 3, size: int = 300) -> DataFrame:
    """doc, chunk_no, chunk (trimmed), score of the k best chunks: chunk overlap plus 0.3 of the document's; both must be above 0.

    Each text is read once, its words only until the keywords are full. A batch of documents yields its best k chunks
    and those that come within rounding of them; ties go by document and place.
    """
    asked = plain_words(query)
    n, kind = len(asked), docs.schema["doc"].dataType.simpleString()

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for i, value in enumerate(batch.column("text")):
                text = value.as_py() or ""
                if of_doc := hits(t.first_keywords(text), asked):
                    for no, chunk in enumerate(t.chunk_list(text, size)):
                        if own := hits(set(t.word_list(chunk)), asked):
                            found.append((own / n + 0.3 * (of_doc / n), i, no, chunk))
            if len(found) > k > 0:
                least = heapq.nlargest(k, (f[0] for f in found))[-1] - 2e-9
                found = [f for f in found if f[0] >= least]
            score, row, no, chunk = zip(*found) if found else ((),) * 4
            columns = [batch.column("doc").take(pa.array(row, pa.int64())), pa.array(no, pa.int32()), pa.array(chunk, pa.string()), pa.array(score, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc", "chunk_no", "chunk", "score"])

    best = docs.select("doc", "text").mapInArrow(scored, f"doc {kind}, chunk_no int, chunk string, score double")
    return best.select("doc", "chunk_no", F.trim("chunk", F.lit(" \t\n\r\x0b\f")).alias("chunk"), F.round("score", 9).alias("score")).orderBy(F.desc("score"), "doc", "chunk_no").limit(k)


def hits(found: set[str], asked: list[str]) -> int:
    """How many of the words asked for were found; repeated ones count each time."""
    return sum(w in found for w in asked)


def plain_words(text: str) -> list[str]:
    return [w for w in re.split("[^a-zA-Z0-9']+", text.lower()) if w]


def context(best: DataFrame, max_tokens: int = 400) -> str:
    """The leading chunks of a relevance result (a few rows) that fit 4 * max_tokens characters, joined by spaces; the first that doesn't fit ends it."""
    parts, used = [], 0
    for row in best.orderBy(F.desc("score"), "doc", "chunk_no").select("chunk").collect():
        if used + len(row["chunk"]) > 4 * max_tokens:
            break
        parts.append(row["chunk"])
        used += len(row["chunk"])
    return " ".join(parts)


def ingest(spark: SparkSession, folder: str, index: DataFrame | None, now: Column | None = None) -> DataFrame:
    """The index of a folder's text files: file_name, role, summary, keywords, indexed_utc, content.

    Unchanged files keep their entries, unknown or changed ones are read and described anew, and entries of files that
    are gone are left out. Nothing is read but what has changed.
    """
    names = F.element_at(F.split("path", "/"), -1)
    files = spark.read.format("binaryFile").load(folder).filter(F.lower("path").rlike(r"\.(txt|md)$"))
    listed = files.select(names.alias("file_name"), F.col("modificationTime").alias("mtime"))
    old = index if index is not None else spark.createDataFrame([], INDEX)
    todo = stale(listed, old).select("file_name")
    text = files.select(names.alias("file_name"), F.decode("content", "UTF-8").alias("content")).join(todo, "file_name", "left_semi")
    new = text.select("file_name", t.role(F.col("file_name")).alias("role"), F.substring("content", 1, 500).alias("summary"), t.keywords(F.col("content")).alias("keywords"), (now if now is not None else F.current_timestamp()).alias("indexed_utc"), "content")
    return upsert(prune(old, listed), new, "file_name")


INDEX = "file_name string, role string, summary string, keywords array<string>, indexed_utc timestamp, content string"


def stale(files: DataFrame, index: DataFrame) -> DataFrame:
    """Files to index again: unknown ones, or changed since. files: file_name, mtime; index: file_name, indexed_utc."""
    known = index.select("file_name", "indexed_utc")
    return files.join(known, "file_name", "left").filter(F.col("indexed_utc").isNull() | (F.col("indexed_utc") < F.col("mtime"))).drop("indexed_utc")


def prune(index: DataFrame, files: DataFrame) -> DataFrame:
    return index.join(files.select("file_name").distinct(), "file_name", "left_semi")


def preference_weights(signals: DataFrame, terms: list[str]) -> DataFrame:
    """term, weight: the sum of sign * strength of the signals whose text holds the term. signals: text, sign, strength.

    Terms are matched in the scan, and each signal yields its terms only, so the sums pre-aggregate.
    """
    lower = F.lower("text")
    found = F.filter(F.array(*map(F.lit, terms)), lambda term: F.contains(lower, term))
    return signals.select(F.explode(found).alias("term"), (F.col("sign") * F.col("strength")).alias("w")).groupBy("term").agg(F.sum("w").alias("weight"))


def signal_weights(signals: DataFrame) -> DataFrame:
    """term, weight over the fixed terms and the presets. signals: text, sign, strength, preset.

    A preset other than "none" of a positive signal gains half its strength under `preset:<name>`.
    """
    presets = signals.filter("sign > 0 AND preset <> 'none'").select(F.concat(F.lit("preset:"), "preset").alias("term"), (F.col("strength") * 0.5).alias("w"))
    return preference_weights(signals, list(SIGNAL_TERMS)).unionByName(presets.groupBy("term").agg(F.sum("w").alias("weight")))


def top_preferences(weights: DataFrame, n: int = 5) -> DataFrame:
    """side (like or dislike), place, term, weight: the n strongest of each side; presets are left out."""
    plain = weights.filter(~F.col("term").startswith("preset:") & (F.col("weight") != 0))
    sides = plain.withColumn("side", F.when(F.col("weight") > 0, "like").otherwise("dislike"))
    place = F.row_number().over(Window.partitionBy("side").orderBy(F.desc(F.abs("weight")), "term"))
    return sides.withColumn("place", place).filter(F.col("place") <= n).select("side", "place", "term", "weight")


def suggested_preset(weights: DataFrame) -> DataFrame:
    """preset: that of the largest weight above 0, or "none"."""
    best = weights.filter(F.col("term").startswith("preset:") & (F.col("weight") > 0)).agg(F.min_by("term", F.struct(-F.col("weight"), F.col("term"))).alias("term"))
    return best.select(F.coalesce(F.substring("term", 8, 1 << 20), F.lit("none")).alias("preset"))


def adjust_prompt(prompt: str, weights: dict[str, float], signals: int) -> str:
    """A prompt with up to three liked terms added and two disliked ones taken out, given three signals or more; presets are no terms."""
    if signals < 3:
        return prompt
    terms = [(w, x) for w, x in weights.items() if not w.startswith("preset:")]
    liked = [w for w, x in sorted(terms, key=lambda i: (-i[1], i[0])) if x > 1.5 and w.lower() not in prompt.lower()][:3]
    hated = [w for w, x in sorted(terms, key=lambda i: (i[1], i[0])) if x < -1.5 and w.lower() in prompt.lower()][:2]
    changed = ", ".join([prompt, *liked])
    for w in hated:
        changed = re.sub(re.escape(w), "", changed, flags=re.I).strip()
    changed = re.sub(r",\s*,", ",", changed)
    return re.sub(r"\s{2,}", " ", changed).strip().rstrip(",")


def rank_results(results: DataFrame, n: int, model: str = "base_model", downloads: str = "downloads", family: str = "sdxl") -> DataFrame:
    """The n first search results: those of a model family (by name, in any case) before others, then by downloads, both descending."""
    fits = F.contains(F.lower(model), F.lit(family.lower()))
    return results.withColumn("compatible", F.coalesce(fits, F.lit(False))).orderBy(F.desc("compatible"), F.desc(downloads)).limit(n)


def value_at(df: DataFrame, keys: list[str], value: str, share: float) -> DataFrame:
    """keys and at: the value at place int(n * share), from 0, in ascending order, as for a p99. By counts of values, so no key's rows meet in one task."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("c"))
    group = Window.partitionBy(*keys)
    running = counts.withColumn("upto", F.sum("c").over(group.orderBy(value))).withColumn("n", F.sum("c").over(group))
    return running.filter(F.col("upto") > F.least(F.floor(F.col("n") * share), F.col("n") - 1)).groupBy(*keys).agg(F.min(value).alias("at"))


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key (keyed store: upsert keeps the newest)."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__n = 1").drop("__n")


def expire(df: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """Rows that aren't deleted, or were no more than `hours` ago."""
    return df.filter(F.col("deleted_utc").isNull() | (F.col("deleted_utc") >= now - F.expr(f"INTERVAL {hours} HOURS")))


def migrate_deleted(df: DataFrame, now: Column) -> DataFrame:
    """Rows with the old mark of deletion (legacy_deleted) and no time of it are deleted as of now."""
    return df.withColumn("deleted_utc", F.when(F.col("legacy_deleted") & F.col("deleted_utc").isNull(), now).otherwise(F.col("deleted_utc")))


def visible(df: DataFrame) -> DataFrame:
    """Rows of a catalog that aren't deleted, by prompt."""
    return df.filter(F.col("deleted_utc").isNull()).orderBy("prompt")


def stack(df: DataFrame, prompt: int) -> DataFrame:
    """A prompt's visible rows, newest first."""
    return df.filter((F.col("prompt") == prompt) & F.col("deleted_utc").isNull()).orderBy(F.desc("generated_utc"))


def catalog_counts(df: DataFrame) -> DataFrame:
    """visible, unseen and saved: numbers of rows that aren't deleted."""
    there = F.col("deleted_utc").isNull()
    count = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    return df.agg(count(there).alias("visible"), count(there & ~F.col("seen")).alias("unseen"), count(there & F.col("saved")).alias("saved"))


def upsert(base: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return base.join(new.select(key), key, "left_anti").unionByName(new)


def prompts(lines: DataFrame) -> DataFrame:
    """file, number, title, series, scene, style, lora, lora_weight, body of the prompts in files' lines (file, n, line).

    A line `SERIES word: name` heads a series, `PROMPT nn - "title"` a prompt; a prompt belongs to the nearest series
    above it, and its body ends at the next header or at `PRODUCTION NOTES`. A line `LORA: name:weight` is taken out of
    the body. The last of several paragraphs is the style, the others are the scene. Each file is handled by itself.
    """
    dash = r"\p{Pd}"
    series = F.regexp_extract("line", r"^SERIES\s+\w+:\s+(.+)$", 1)
    head = rf'PROMPT\s+(\d+)\s*{dash}\s*"([^"]+)"'
    number, title = F.regexp_extract("line", head, 1), F.regexp_extract("line", head, 2)
    order = Window.partitionBy("file").orderBy("n")
    ends = F.col("line").contains("SERIES ") | F.col("line").contains("PRODUCTION NOTES")
    rows = lines.withColumn("number", F.when(number != "", number.cast("int"))).withColumn("title", F.when(title != "", F.trim(title))).withColumn("own", F.when(series != "", F.trim(series)))
    rows = rows.withColumn("series", F.last("own", True).over(order)).withColumn("block", F.sum((F.col("number").isNotNull() | ends).cast("int")).over(order)).withColumn("ends", ends)
    heads = rows.filter("number IS NOT NULL").select("file", "block", "number", "title", "series")
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n")
    body = rows.filter("number IS NULL AND NOT ends").groupBy("file", "block").agg(text.alias("body"))
    blank = F.lit(" \t\n\r\x0b\f")
    lora = r"(?im)^LORA:\s*(.+?)(?::(\d+(?:\.\d+)?))?\s*$"
    both = heads.join(body, ["file", "block"], "left").withColumn("body", F.trim(F.coalesce("body", F.lit("")), blank))
    both = both.withColumn("lora", F.nullif(F.trim(F.regexp_extract("body", lora, 1)), F.lit(""))).withColumn("weight", F.regexp_extract("body", lora, 2))
    both = both.withColumn("lora_weight", F.when(F.col("weight") != "", F.col("weight").cast("double")).otherwise(0.8))
    cut = F.regexp_replace("body", r"(?im)\s*^LORA:[^\n]*\s*", "\n\n")
    both = both.withColumn("body", F.trim(F.when(F.col("lora").isNotNull(), cut).otherwise(F.col("body")), blank))
    parts = F.filter(F.transform(F.split("body", t.BREAK), lambda p: F.trim(p, blank)), lambda p: p != "")
    both = both.withColumn("parts", parts)
    several = F.size("parts") >= 2
    scene = F.when(several, F.array_join(F.slice("parts", 1, F.greatest(F.size("parts") - 1, F.lit(1))), "\n\n")).otherwise(F.col("body"))
    style = F.when(several, F.element_at("parts", -1)).otherwise("")
    return both.select("file", "number", "title", F.coalesce("series", F.lit("")).alias("series"), scene.alias("scene"), style.alias("style"), "lora", "lora_weight", "body")

"""Index and keyed-store persistence on Parquet and JSON, and parsing of embedding responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.documents import latest


def save_index(vectors: DataFrame, path: str) -> None:
    """A sparse corpus (id, e, ...) for reuse, in order of id ranges."""
    vectors.repartitionByRange("id").sortWithinPartitions("id").write.mode("overwrite").parquet(path)


def load_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def append_records(records: DataFrame, path: str) -> None:
    """One more version of the given keys; deletions have deleted = true. Records: key, version, deleted, ..."""
    records.write.mode("append").json(path)


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The newest version of each key that isn't deleted."""
    return latest(spark.read.schema(schema).json(path), ["key"], [F.desc("version")]).filter("NOT coalesce(deleted, false)")


def parse_embedding(body: Column) -> Column:
    """The vector of an embedding service's response: `embeddings[0]`, or `embedding` in the older form."""
    parsed = F.from_json(body, "embeddings array<array<float>>, embedding array<float>")
    return F.coalesce(parsed["embeddings"][0], parsed["embedding"])


def read_config(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON file with comments."""
    return spark.read.schema(schema).option("multiLine", True).option("allowComments", True).json(path)


MUSIC = "instruments map<string, array<string>>, tempoMarkings array<struct<label: string, bpmHint: int>>, composers array<string>, artists array<string>, genres array<string>, keys array<string>, scales array<string>, moodPresets array<string>"


def instruments(config: DataFrame, family: str | None = None) -> DataFrame:
    """family, instrument of a music configuration, of one family or of all."""
    rows = config.select(F.explode("instruments").alias("family", "list")).select("family", F.explode("list").alias("instrument"))
    return rows if family is None else rows.filter(F.col("family") == family)


def tempo_markings(config: DataFrame) -> DataFrame:
    """label, bpm_hint."""
    return config.select(F.explode("tempoMarkings").alias("t")).select("t.label", F.col("t.bpmHint").alias("bpm_hint"))


def scan_new(spark: SparkSession, glob: str, known: DataFrame) -> DataFrame:
    """Files that match and aren't known yet: path, modified, size. known: path."""
    files = spark.read.format("binaryFile").load(glob).select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size"))
    return files.join(known.select("path"), "path", "left_anti")

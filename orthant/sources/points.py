"""Point files: x,y,z with optional size or colour, and frame files with a leading frame number.

A line is data if it begins with a digit or a minus sign. Tokens are separated by commas, spaces or tabs and must
be whole numbers, 3 to 8 of them and as many on each line. A file is a frame file if its first column is at least 0,
never falls, has repeats, and is at most 8 times the number of lines.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SCHEMA = "file string, frame int, x long, y long, z long, r int, g int, b int, size int"


_RUN = "file string, block long, part long, n long, least int, most int, low long, high long, start long, last long, fell boolean, again boolean"


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per batch and block of a file, in order of the lines: what their first numbers and widths say about its shape."""
    names = [c.split()[0] for c in _RUN.split(", ")]
    for part, batch in enumerate(batches):
        if not batch.num_rows:
            continue
        files, blocks = batch.column("file").dictionary_encode(), batch.column("block").to_numpy()
        code = files.indices.to_numpy()
        first, width = batch.column("first").to_numpy(), batch.column("width").to_numpy()
        cuts = [0, *(np.flatnonzero((np.diff(code) != 0) | (np.diff(blocks) != 0)) + 1).tolist(), len(code)]
        rows = []
        for a, b in zip(cuts, cuts[1:]):
            v, w = first[a:b], width[a:b]
            rows.append((files.dictionary[code[a]].as_py(), int(blocks[a]), part, b - a, int(w.min()), int(w.max()), int(v.min()), int(v.max()), int(v[0]), int(v[-1]), bool((v[1:] < v[:-1]).any()), bool((v[1:] == v[:-1]).any())))
        kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
        yield pa.RecordBatch.from_arrays([pa.array(c, kinds[k.split()[1]]) for c, k in zip(zip(*rows), _RUN.split(", "))], names)


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """All points of the files at path; a corrupt file raises when the result is computed.

    Lines are read in order, block by block, and each batch of them yields one row about the shape of its file; only
    these rows are put in order by file, so no file's lines meet in one task. The files' shapes go to all tasks.
    """
    text = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    data = text.withColumn("value", F.regexp_replace(F.trim("value"), "^﻿", "")).filter(F.col("value").rlike("^[0-9-]"))
    rows = data.withColumn("t", F.filter(F.split("value", "[, \t]+"), lambda x: x != ""))
    whole = F.forall("t", lambda x: x.rlike("^-?[0-9]+$"))
    rows = rows.withColumn("v", F.when(whole, F.transform("t", lambda x: x.cast("long"))).otherwise(F.raise_error(F.concat(F.lit("corrupt line: "), "value"))))
    runs = rows.select("file", "block", F.col("v")[0].alias("first"), F.size("v").alias("width")).mapInArrow(_runs, _RUN)
    before = F.lag("last").over(Window.partitionBy("file").orderBy("block", "part"))
    shape = runs.withColumn("before", before).groupBy("file").agg(
        F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"), F.min("low").alias("low"), F.max("high").alias("high"),
        F.bool_or(F.col("fell") | F.coalesce(F.col("start") < F.col("before"), F.lit(False))).alias("fell"),
        F.bool_or(F.col("again") | F.coalesce(F.col("start") == F.col("before"), F.lit(False))).alias("again"),  # a column that never falls repeats in lines next to each other
    )
    framed = (F.col("low") >= 0) & ~F.col("fell") & F.col("again") & (F.col("high") <= 8 * F.col("n")) & F.col("most").isin(4, 5, 7, 8)
    even = (F.col("least") == F.col("most")) & F.col("most").between(3, 8) & (framed | F.col("most").isin(3, 4, 6, 7))
    shape = shape.withColumn("framed", F.when(even, framed).otherwise(F.raise_error(F.concat(F.lit("uneven or unknown columns: "), "file"))))
    both = rows.drop("block").join(F.broadcast(shape.select("file", "framed", F.col("most").alias("width"))), "file")
    first = F.when(F.col("framed"), 1).otherwise(0)
    at = lambda i: F.try_element_at("v", first + F.lit(i + 1))
    left = F.col("width") - first
    colour = lambda i: F.when(left >= 6, F.when(at(i).between(0, 255), at(i)).otherwise(F.raise_error(F.lit("colour out of range"))))
    size = F.when(left == 4, at(3)).when(left == 7, at(6))
    out = both.select("file", F.when(F.col("framed"), F.col("v")[0]).alias("frame"), at(0).alias("x"), at(1).alias("y"), at(2).alias("z"), colour(3).alias("r"), colour(4).alias("g"), colour(5).alias("b"), size.alias("size"))
    return out.select(*(F.col(c.split()[0]).cast(c.split()[1]) for c in SCHEMA.split(", ")))


def load_scene(spark: SparkSession, path: str, base: DataFrame | None = None, register: bool = True) -> DataFrame:
    """Moving objects (guid, pos, vel, registered, last_ms) at the points of static files, inserted into base; frame files give none."""
    from ..operators import spatial

    rows = read_points(spark, path).filter("frame IS NULL")
    axes = [F.col(a).cast("long").alias(a) for a in ("x", "y", "z")]
    still = F.struct(*(F.lit(0).cast("int").alias(a) for a in ("x", "y", "z")))
    new = rows.select(F.xxhash64("file", "x", "y", "z", F.monotonically_increasing_id()).alias("guid"), F.struct(*axes).alias("pos"), still.alias("vel"), F.lit(register).alias("registered"), F.lit(0).cast("long").alias("last_ms"))
    return spatial.insert(base if base is not None else new.limit(0), new)


def read_embeddings(spark: SparkSession, path: str) -> DataFrame:
    """Headerless float rows: id and vec; a cell that is no number is 0."""
    rows = spark.read.text(path).withColumn("id", F.monotonically_increasing_id())
    return rows.filter(F.trim("value") != "").select("id", F.transform(F.split("value", ","), lambda x: F.coalesce(F.trim(x).try_cast("float"), F.lit(0).cast("float"))).alias("vec"))

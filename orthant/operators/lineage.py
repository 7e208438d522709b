"""Cutting lineage with tables on shared storage, and joins that spare hot keys."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}
_tables: dict[str, set[str]] = {}
#: A key is hot if it has more than this part of all rows, so there are at most so many hot keys.
HOT_PART = 1024


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder in spark.checkpoint.dir; a temporary one only where that is unset and Spark runs in one process."""
    context = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if shared:
        return shared
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context.applicationId not in _own:
        _own[context.applicationId] = tempfile.mkdtemp(prefix="orthant-scratch-")
    return _own[context.applicationId]


def materialize(df: DataFrame, label: str) -> DataFrame:
    """df written to the shared folder as Parquet and read back, so it survives the loss of any executor."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/orthant-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _tables.setdefault(spark.sparkContext.applicationId, set()).add(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete scratch tables that nothing reads any more."""
    for df in tables:
        path = getattr(df, "scratch_path", None)
        if path:
            _delete(df.sparkSession, path)


def clear_scratch(spark: SparkSession) -> None:
    """Delete all scratch tables of this application: to be called once the results that read them are written."""
    for path in list(_tables.get(spark.sparkContext.applicationId, ())):
        _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    _tables.get(spark.sparkContext.applicationId, set()).discard(path)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def skew_join(rows: DataFrame, keyed: DataFrame, keys: list[str], count: str, total: int, how: str | None = None) -> DataFrame:
    """Inner join of rows with keyed, which has one row for each key, and in `count` the key's number of rows.

    Keys with more than a `HOT_PART`-th of `total` rows (no fewer than all rows divided by a small constant) are joined by
    broadcast, and there are so few of them whatever the data; only the others are shuffled, so no task gets a hot key.
    how: a join hint for these, where the plan shall be the same at every size.
    """
    hot = keyed.filter(F.col(count) * HOT_PART > total)
    rest = keyed.filter(F.col(count) * HOT_PART <= total)
    rest = rest.hint(how) if how else rest
    cold = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(rest, keys)
    return rows.join(F.broadcast(hot), keys).unionByName(cold)

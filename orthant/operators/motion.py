"""Moving objects: guid, pos, vel (struct of ints), registered, last_ms. Velocity is in units a millisecond."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry as g


def linear(pos: Column, vel: Column, elapsed: Column) -> tuple[dict[str, Column], Column]:
    """Where an object goes by its velocity, and whether it goes for good: never."""
    return {a: g.wide(pos[a]) + vel[a].cast("decimal(10,0)") * elapsed.cast("decimal(10,0)") for a in g.AXES}, F.lit(False)


def step(df: DataFrame, now_ms: int, motion=linear) -> DataFrame:
    """All registered objects advanced to now_ms, in one projection.

    motion(pos, vel, elapsed) gives the target's coordinates (wide decimals) and whether the object is removed. An object
    that would leave the universe stays where it is, but its clock goes on; a removed one is left out.
    """
    elapsed = F.lit(now_ms) - F.col("last_ms")
    v = g.effective_velocity(F.col("vel"))
    moving = F.col("registered") & (elapsed > 0) & ((v["x"] != 0) | (v["y"] != 0) | (v["z"] != 0))
    target, gone = motion(F.col("pos"), v, elapsed)
    inside = None
    for a in g.AXES:
        part = (target[a] >= -g.HALF) & (target[a] < g.HALF)
        inside = part if inside is None else inside & part
    goal = F.struct(*(F.when(inside, target[a]).cast("long").alias(a) for a in g.AXES))
    clock = F.when(moving, F.lit(now_ms).cast(df.schema["last_ms"].dataType)).otherwise(F.col("last_ms"))
    new = {"pos": F.when(moving & inside, goal).otherwise(F.col("pos")), "last_ms": clock}
    return df.filter(~(moving & gone)).select(*((new[c] if c in new else F.col(f"`{c}`")).alias(c) for c in df.columns))


def set_velocity(df: DataFrame, changes: DataFrame) -> DataFrame:
    """Objects with the velocities of changes (guid, v), thresholds applied."""
    joined = df.join(changes.select("guid", F.col("v").alias("__v")), "guid", "left")
    return joined.withColumn("vel", g.effective_velocity(F.coalesce("__v", "vel"))).drop("__v")


def report(before: DataFrame, after: DataFrame) -> DataFrame:
    """moved, unmoved, missing and stationary counts of two snapshots."""
    b = before.select("guid", F.col("pos").alias("p0"), F.col("vel").alias("v0"))
    joined = b.join(after.select("guid", F.col("pos").alias("p1")), "guid", "left")
    still = (F.col("v0")["x"] == 0) & (F.col("v0")["y"] == 0) & (F.col("v0")["z"] == 0)
    count = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    return joined.agg(
        F.count("*").alias("objects"), count(F.col("p1") != F.col("p0")).alias("moved"), count((F.col("p1") == F.col("p0")) & ~still).alias("unmoved"),
        count(F.col("p1").isNull()).alias("missing"), count(still).alias("stationary"),
    )


def monitor(snapshots: DataFrame, k: int) -> DataFrame:
    """check, moved, failed, closest: of each check, the objects elsewhere than at their last sound check, those without a velocity, and the guids of the k nearest to the origin.

    snapshots: check, guid, pos, vel. The first check of an object counts as no move.
    """
    still = (F.col("vel")["x"] == 0) & (F.col("vel")["y"] == 0) & (F.col("vel")["z"] == 0)
    before = F.last(F.when(~still, F.col("pos")), True).over(Window.partitionBy("guid").orderBy("check").rowsBetween(Window.unboundedPreceding, -1))
    seen = snapshots.select("check", "guid", "pos", still.alias("still"), before.alias("before"))
    moved = ~F.col("still") & (F.col("pos") != F.col("before"))
    counts = seen.groupBy("check").agg(F.sum(moved.cast("long")).alias("moved"), F.sum(F.col("still").cast("long")).alias("failed"))
    place = F.row_number().over(Window.partitionBy("check").orderBy(g.dist2(F.col("pos"), g.point(0, 0, 0)), "guid"))
    near = snapshots.select("check", "guid", place.alias("place")).filter(F.col("place") <= k)
    nearest = near.groupBy("check").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "guid"))), lambda x: x["guid"]).alias("closest"))
    return counts.join(nearest, "check").select("check", F.coalesce("moved", F.lit(0)).alias("moved"), "failed", "closest")

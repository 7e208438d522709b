"""Images as points: a pixel of every sampled row and column, centred on the origin, with its colour."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

SCHEMA = "file string, x long, y long, z long, r int, g int, b int"
#: Pixels handed on at once.
BATCH = 1 << 18


def image_points(spark: SparkSession, path: str, sample: int = 1, spacing: float = 1.0, skip_transparent: bool = True) -> DataFrame:
    """Points of the images at path; rounding is to even, y points up, a sample below 1 counts as 1.

    Files that aren't images give no rows.
    """
    step = max(sample, 1)

    def pixels(batches):
        for batch in batches:
            for row in batch.to_pylist():
                height, width, channels = row["height"], row["width"], row["nChannels"]
                data = np.frombuffer(row["data"], np.uint8).reshape(height, width, channels)
                rows = step * max(1, BATCH // width)
                for first in range(0, height, rows):
                    last = min(height, first + rows)
                    y, x = (a.ravel() for a in np.meshgrid(np.arange(first, last, step), np.arange(0, width, step), indexing="ij"))
                    colour = data[y, x]
                    if skip_transparent and channels == 4:
                        seen = colour[:, 3] > 0
                        y, x, colour = y[seen], x[seen], colour[seen]
                    b, g, r = (colour[:, min(i, channels - 1)].astype(np.int32) for i in range(3))
                    at = lambda v: np.rint(v * spacing).astype(np.int64)
                    columns = [pa.array([row["origin"]] * len(x)), at(x - (width - 1) / 2), at((height - 1) / 2 - y), np.zeros(len(x), np.int64), r, g, b]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f) for c, f in zip(columns, TYPES)], names=NAMES)

    images = spark.read.format("image").option("dropInvalid", True).load(path).select("image.*")
    return images.select("origin", "height", "width", "nChannels", "data").mapInArrow(pixels, SCHEMA)


NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
TYPES = [{"string": pa.string(), "long": pa.int64(), "int": pa.int32()}[c.split()[1]] for c in SCHEMA.split(", ")]

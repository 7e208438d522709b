"""Signals as rows (series, i, value): envelopes, onsets, autocorrelation, and whole-file audio features."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def rms_envelope(df: DataFrame, width: int) -> DataFrame:
    """series, frame, rms, db (-96 for silence)."""
    rms = F.sqrt(F.avg(F.col("value") * F.col("value")))
    out = df.groupBy("series", F.floor(F.col("i") / width).alias("frame")).agg(rms.alias("rms"))
    return out.withColumn("db", F.when(F.col("rms") > 0, 20 * F.log10("rms")).otherwise(-96.0))


def peaks(df: DataFrame, width: int) -> DataFrame:
    return df.groupBy("series", F.floor(F.col("i") / width).alias("frame")).agg(F.max(F.abs("value")).alias("peak"))


def onsets(envelope: DataFrame) -> DataFrame:
    """Rise of the envelope to the next frame, or 0."""
    after = F.lead("rms").over(Window.partitionBy("series").orderBy("frame"))
    return envelope.withColumn("after", after).filter("after IS NOT NULL").select("series", "frame", F.greatest(F.col("after") - F.col("rms"), F.lit(0.0)).alias("onset"))


def autocorrelation(rows: DataFrame, value: str, least: int, most: int) -> DataFrame:
    """series, lag, r: sums of products with the row lag frames later, by an equi-join for each lag in range."""
    a = rows.select("series", "frame", F.col(value).alias("a"), F.explode(F.sequence(F.lit(least), F.lit(most))).alias("lag"))
    b = rows.select("series", F.col("frame").alias("later"), F.col(value).alias("b"))
    return a.withColumn("later", F.col("frame") + F.col("lag")).join(b, ["series", "later"]).groupBy("series", "lag").agg(F.sum(F.col("a") * F.col("b")).alias("r"))


def mono(df: DataFrame) -> DataFrame:
    """series, i, value: mean of the channels. df: series, i, channel, value."""
    return df.groupBy("series", "i").agg(F.avg("value").alias("value"))


def downsample(df: DataFrame, points: int = 2000) -> DataFrame:
    """series, point, value: the largest absolute value in each of `points` equal stretches; a shorter series as it is. i counts from 0 without gaps."""
    sizes = df.groupBy("series").agg(F.count("*").alias("n"))
    rows = df.join(sizes, "series")
    point = F.when(F.col("n") <= points, F.col("i")).otherwise(F.ceil((F.col("i") + 1) * points / F.col("n")) - 1).cast("long")
    loud = rows.groupBy("series", "n", point.alias("point")).agg(F.max(F.abs("value")).alias("loud"), F.max("value").alias("value"))
    return loud.select("series", "point", F.when(F.col("n") <= points, F.col("value")).otherwise(F.col("loud")).alias("value"))


ENVELOPE, FRAME, HOP, BANDS = 2048, 2048, 4096, 64


def _window(n: int) -> np.ndarray:
    return np.hanning(n) if n > 1 else np.ones(n)


def band_energies(samples: np.ndarray) -> np.ndarray:
    """A row for each HOP samples: mean magnitude of the Hann-windowed frame there in BANDS equal bands."""
    frames = len(samples) // HOP
    if not frames:
        return np.zeros((0, BANDS))
    padded = np.concatenate([samples, np.zeros(FRAME)])
    cut = np.stack([padded[f * HOP : f * HOP + FRAME] for f in range(frames)])
    return np.abs(np.fft.rfft(cut * _window(FRAME), axis=1))[:, : FRAME // 2].reshape(frames, BANDS, -1).mean(2)


def decibels(x: float) -> float:
    return 20 * float(np.log10(x)) if x > 0 else -96.0


def tempo(envelope: np.ndarray, rate: int) -> float:
    """Beats a minute, 50 to 200, by autocorrelation of the rises of an envelope in decibels; 120 if it is too short."""
    if len(envelope) < 4:
        return 120.0
    onset = np.maximum(np.diff(envelope), 0)
    frames = rate / ENVELOPE
    least, most = int(frames * 60 / 200), min(int(frames * 60 / 50), len(onset) // 2)
    best, lag = 0.0, least
    for k in range(least, most + 1):
        r = float(onset[: len(onset) - k] @ onset[k:])
        if r > best:
            best, lag = r, k
    return float(np.clip(60 * frames / lag, 50, 200)) if lag else 200.0


def centroid(samples: np.ndarray, rate: int) -> float:
    """Mean frequency of the first 8192 samples by magnitude, without the constant part; 1000 for silence."""
    n = min(4 * FRAME, len(samples))
    size = np.abs(np.fft.rfft(samples[:n] * _window(n)))[1 : n // 2] if n else np.zeros(0)
    total = float(size.sum())
    return float((np.arange(1, n // 2) * rate / n * size).sum() / total) if total > 0 else 1000.0


def audio_features(samples: np.ndarray, rate: int) -> dict[str, float]:
    """bpm, peak_db, rms_db, centroid of a file's mono samples."""
    whole = samples[: len(samples) // ENVELOPE * ENVELOPE].reshape(-1, ENVELOPE)
    envelope = np.array([decibels(x) for x in np.sqrt((whole**2).mean(1))]) if len(whole) else np.zeros(0)
    rms = float(np.sqrt(np.mean(samples**2))) if len(samples) else 0.0
    return {"bpm": tempo(envelope, rate), "peak_db": decibels(float(np.abs(samples).max()) if len(samples) else 0.0), "rms_db": decibels(rms), "centroid": centroid(samples, rate)}


def vibe(rms_db: Column, bpm: Column, centroid_hz: Column) -> Column:
    """Energy, tempo and brightness in words."""
    energy = F.when(rms_db > -10, "high-energy").when(rms_db > -20, "moderate-energy").otherwise("soft, ambient")
    pace = F.when(bpm > 140, "fast-tempo").when(bpm > 100, "mid-tempo").when(bpm > 60, "relaxed-tempo").otherwise("very slow")
    light = F.when(centroid_hz > 3000, "bright, trebly").when(centroid_hz > 1500, "balanced spectrum").otherwise("dark, bassy")
    return F.format_string("%s, %s (%.0f BPM), %s", energy, pace, bpm, light)

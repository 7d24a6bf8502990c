"""Frames and shifts: projections, centring, chunks, agreement."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def project(frames: DataFrame, over: str, keep: list[str]) -> DataFrame:
    """Mean, greatest and median over a dimension."""
    return frames.groupBy(*keep).agg(F.round(F.avg("v"), 6).alias("mean"), F.max("v").alias("max"), F.median("v").alias("median"), F.count(over).alias("n"))


def nyquist_ratio(planes: DataFrame) -> DataFrame:
    """(z, ratio) of planes(z, y, x, v): power at the fastest change from row to row against the median power of the upper half of the band without it.

    Null with fewer than four frequencies, or where that median is 0. A plane is a group.
    """

    def one(f: pd.DataFrame) -> pd.DataFrame:
        a = np.zeros((int(f["y"].max()) + 1, int(f["x"].max()) + 1))
        a[f["y"], f["x"]] = f["v"]
        power = (np.abs(np.fft.rfft(a, axis=0)) ** 2).mean(1)
        band = float(np.median(power[len(power) // 2 : -1])) if len(power) >= 4 else 0.0
        return pd.DataFrame({"z": f["z"].iloc[:1], "ratio": [round(float(power[-1]) / band, 6) if band > 0 else None]})

    return planes.groupBy("z").applyInPandas(one, f"z {planes.schema['z'].dataType.simpleString()}, ratio double")


def overall_median(df: DataFrame, column: str) -> float | None:
    """The median of a column: rows are dealt out by range and sorted there, and only those in the middle are looked at."""
    ranged = df.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("v"))
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = ranged.repartitionByRange(n, "v").sortWithinPartitions("v").select("v", F.spark_partition_id().alias("part"), at.alias("at")).checkpoint()
    sizes = placed.groupBy("part").count().orderBy("part").collect()  # a row a partition
    total = sum(r["count"] for r in sizes)
    if not total:
        return None
    found = []
    for k in {(total - 1) // 2, total // 2}:
        for part, size in sizes:
            if k < size:
                found.append(placed.where((F.col("part") == part) & (F.col("at") == k)).first()["v"])
                break
            k -= size
    return sum(found) / len(found)


def centred(shifts: DataFrame) -> DataFrame:
    """rs minus the median of its time point, and minus the median of all."""
    by_t = shifts.groupBy("t").agg(F.median("rs").alias("mt"))
    overall = F.lit(overall_median(shifts, "rs")).cast("double")
    return shifts.join(by_t, "t").select("z", "t", F.round(F.col("rs") - F.col("mt"), 6).alias("by_time"), F.round(F.col("rs") - overall, 6).alias("overall"))


def agreement(a: DataFrame, b: DataFrame, keys: list[str], by: str) -> DataFrame:
    """Pearson's r and the RMSE over the truth's range, of a(keys, v) as truth and b(keys, v)."""
    j = a.join(b.withColumnRenamed("v", "w"), keys)
    e = F.col("v") - F.col("w")
    out = j.groupBy(by).agg(F.corr("v", "w").alias("r"), F.sqrt(F.avg(e * e)).alias("rmse"), (F.max("v") - F.min("v")).alias("span"))
    return out.select(by, F.round("r", 6).alias("pearson_r"), F.round(F.col("rmse") / F.nullif(F.col("span"), F.lit(0)), 6).alias("nrmse"))


def sharpness(image: DataFrame, by: str) -> DataFrame:
    """Mean squared forward differences over the squared mean, on the common interior."""
    px = image.select(by, "y", "x", "v")
    down, right = px.select(by, (F.col("y") - 1).alias("y"), "x", F.col("v").alias("vd")), px.select(by, "y", (F.col("x") - 1).alias("x"), F.col("v").alias("vr"))
    g = px.join(down, [by, "y", "x"]).join(right, [by, "y", "x"]).groupBy(by).agg(F.avg((F.col("vd") - F.col("v")) ** 2 + (F.col("vr") - F.col("v")) ** 2).alias("g"))
    return g.join(px.groupBy(by).agg(F.avg("v").alias("m")), by).select(by, F.round(F.try_divide("g", F.col("m") * F.col("m")), 6).alias("sharpness"))


def differences(shifts: DataFrame) -> DataFrame:
    """First difference of rs along t within a plane; none for the first."""
    w = Window.partitionBy("z").orderBy("t")
    return shifts.select("z", "t", F.round(F.col("rs") - F.lag("rs").over(w), 6).alias("step")).where("step is not null")

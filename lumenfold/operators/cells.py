"""Cell seeds: scores, classes, threshold sweeps."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.functions.numeric import sigmoid


#: What a number of directions scores, and the thresholds of the present detector.
SHOLL = {0: 0.05, 1: 0.20, 2: 0.40}
STRONG, WEAK, BLOB_MIN, RPROM_MIN, DIRS_MIN = 0.40, 0.26, 0.20, 1.0, 3
AREA, ECC_MAX, SOL_MIN = (6, 200), 0.92, 0.50


def _kind(score: Column, blob_min: Column, weak: Column, rprom_min: Column) -> Column:
    """Seeds without a blob or with a ragged local component are process peaks; strong ones also need directions and thickness."""
    sound = F.col("lc_area").between(*AREA) & (F.col("lc_ecc") < ECC_MAX) & (F.col("lc_sol") > SOL_MIN) & (F.col("blob") >= blob_min)
    strong = (score >= STRONG) & (F.col("n_dirs") >= DIRS_MIN) & (F.col("rprom") >= rprom_min)
    return F.when(~sound, "process_peak").when(strong, "strong").when(score >= weak, "weak").otherwise("process_peak")


def scored_seeds(seeds: DataFrame) -> DataFrame:
    """Seeds with score and type."""
    sholl = F.lit(1.0)
    for n, worth in sorted(SHOLL.items(), reverse=True):
        sholl = F.when(F.col("n_dirs") <= n, worth).otherwise(sholl)
    score = 0.25 * F.col("compact") + 0.20 * F.col("blob") + 0.20 * sigmoid(F.col("rprom")) + 0.15 * sholl - 0.20 * F.col("tube")
    scored = seeds.withColumn("score", F.round(score, 9))
    return scored.withColumn("type", _kind(F.col("score"), F.lit(BLOB_MIN), F.lit(WEAK), F.lit(RPROM_MIN)))


def sweep(scored: DataFrame, blob_min: list[float], weak: list[float], rprom_min: list[float]) -> DataFrame:
    """(blob_min, weak, rprom_min, n_strong, n_weak): all scored seeds classified anew under every setting of a small fixed grid, in one pass."""
    grid = F.array(*[F.struct(F.lit(b).alias("blob_min"), F.lit(w).alias("weak"), F.lit(r).alias("rprom_min")) for b, w, r in product(blob_min, weak, rprom_min)])
    tried = scored.withColumn("s", F.explode(grid))
    kind = _kind(F.col("score"), F.col("s.blob_min"), F.col("s.weak"), F.col("s.rprom_min"))
    return tried.groupBy("s.blob_min", "s.weak", "s.rprom_min").agg(F.count_if(kind == "strong").alias("n_strong"), F.count_if(kind == "weak").alias("n_weak"))

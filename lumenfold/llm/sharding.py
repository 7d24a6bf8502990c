"""Reproducible global shuffle: a keyed Feistel permutation of row numbers gives every row's shard and slot by arithmetic.

The law is `rows`: with row number p(r) after the permutation, shard = p mod n and slot = p div n, so shard counts differ by
at most one, slots are gapless from 0, and `place` computes the shard and slot of any row without the table.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.llm.common import numbered, table

ROUNDS = 6


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser with full avalanche (splitmix constants)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permute(numbers: np.ndarray, n: int, seed: int) -> np.ndarray:
    """The seeded permutation of 0..n-1 at the given numbers.

    A balanced Feistel network permutes the least power of four not under n; a value outside 0..n-1 walks on along its cycle
    until it falls inside, which ends since the cycle comes back to where it began.
    """
    half = max(1, ((max(n, 1) - 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    keys = _mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ np.uint64(seed & (2**64 - 1)))
    out = numbers.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        x = out[todo]
        left, right = x >> shift, x & mask
        for k in keys:
            left, right = right, left ^ (_mix(right + k) & mask)
        out[todo] = x = (left << shift) | right
        todo = todo[x >= np.uint64(n)]
    return out.astype(np.int64)


def place(row_no: int, n_rows: int, n_shards: int, seed: int) -> tuple[int, int]:
    """Shard and slot of one row."""
    p = int(permute(np.array([row_no]), n_rows, seed)[0])
    return p % n_shards, p // n_shards


def shard(df: DataFrame, order: list[str], n_shards: int, seed: int = 2024) -> DataFrame:
    """df (its columns, any nulls in them) with shard int and slot long by the law `rows`.

    Row numbers follow `order` (nulls first); rows equal in it are interchangeable. An empty table gives no rows. Columns of
    df named shard or slot are replaced, any others are kept.
    """
    df = df.drop("shard", "slot")
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row")
    by = [f"_by{i}" for i in range(len(order))]
    rows = numbered(df.select(row, *[F.col(f"`{c}`").alias(b) for c, b in zip(order, by, strict=True)]), by)
    n = rows.count()

    @F.pandas_udf("long")
    def permuted(numbers: pd.Series) -> pd.Series:
        return pd.Series(permute(numbers.to_numpy(), n, seed))

    placed = rows.select("_row", permuted("row_no").alias("_p"))
    return placed.select("_row.*", (F.col("_p") % n_shards).cast("int").alias("shard"), F.expr(f"_p div {n_shards}").alias("slot"))


def op3_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards. A null text has no bytes: size 8, text_crc32 0. Rows are numbered by doc_id, then digest and size."""
    text = F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")
    slim = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    return shard(slim, ["doc_id", "text_crc32", "size"], 24).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))

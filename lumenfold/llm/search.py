"""Exact top-k inner-product search by a vector-approximation file.

Every vector has an approximation, written as a table of its own: a byte for the cell of each component, on marks that are quantiles of a
bounded sample between the exact least and greatest values of all. Only that table is scanned: cells give bounds of every inner product, each task keeps
of a query's vectors those whose upper bound reaches its kth lower bound, and the kth lower bound of all tasks cuts them again. Exact vectors
are then fetched by number in the order of their upper bounds: the first few of each query, then those whose bound still reaches the
kth exact score, so that the result is certain.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenfold.llm.common import scratch_dir, table, written

#: Queries that one scan of the approximations takes: with 64 components 8 MB, sent to every executor.
WAVE = 16_384
#: Queries and vectors whose bounds are in memory at once: 4 matrices of 8 * 1024 * 2048 bytes.
BLOCK, CHUNK = 1024, 2048
#: Bounds that a task of the scan holds before it sends them off.
HELD = 1 << 20
#: Vectors, at most, that the marks between cells are fitted on; the outermost marks are exact.
SAMPLE = 10_000
CELLS = 256


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vectors(vec_id, embedding) as (vec_id, v array<double>), v = floor(scale * x), x as double: whole numbers of any size.

    Vectors that are null, or hold a null or non-finite component, are left out; so are null ids and those with a
    component whose product with scale no double holds. An empty vector stays.
    """
    scaled = F.transform("embedding", lambda x: x.cast("double") * scale)
    sound = F.forall("s", lambda y: y.isNotNull() & ~F.isnan(y) & (F.abs(y) != float("inf")))
    whole = F.transform("s", lambda y: F.when(F.abs(y) < float(1 << 53), F.floor(y).cast("double")).otherwise(y))  # from 2**53 on doubles are whole
    rows = vectors.where(F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), scaled.alias("s"))
    return rows.where(F.col("s").isNotNull() & sound).select("vec_id", whole.alias("v"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), dim)


def marks(vectors: DataFrame, dim: int, cells: int = CELLS) -> tuple[np.ndarray, np.ndarray]:
    """(low, high), each [cells, dim]: the least and greatest value that a component in a cell can have."""

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high = np.full(dim, np.inf), np.full(dim, -np.inf)
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch["v"], dim)
                low, high = np.minimum(low, x.min(0)), np.maximum(high, x.max(0))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim, dtype="int32")), pa.array(low), pa.array(high)], ["at", "low", "high"])

    found = vectors.select("v").mapInArrow(ends, "at int, low double, high double").groupBy("at").agg(F.min("low").alias("low"), F.max("high").alias("high")).orderBy("at").toArrow()  # a row a component
    low, high = found["low"].to_numpy(), found["high"].to_numpy()
    sample = _matrix(vectors.orderBy(F.xxhash64("vec_id", F.lit(3)), "vec_id").limit(SAMPLE).select("v").toArrow()["v"].combine_chunks(), dim)
    inner = np.quantile(sample, np.arange(1, cells) / cells, axis=0, method="nearest")
    edges = np.vstack([low, np.clip(inner, low, high), high])
    return edges[:-1], edges[1:]


def approximated(vectors: DataFrame, low: np.ndarray) -> DataFrame:
    """vectors(no, vec_id, v) as (no, vec_id, code binary): the approximation file. A value on a mark is in the cell that begins there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dim = low.shape[1]
        for batch in batches:
            x = _matrix(batch["v"], dim)
            codes = np.empty(x.shape, "uint8")
            for i in range(dim):
                codes[:, i] = np.searchsorted(low[1:, i], x[:, i], side="right")
            code = pa.FixedSizeBinaryArray.from_buffers(pa.binary(dim), len(x), [None, pa.py_buffer(codes.tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([batch["no"], batch["vec_id"], code], ["no", "vec_id", "code"])

    return vectors.select("no", "vec_id", "v").mapInArrow(run, "no long, vec_id long, code binary")


def bounds(queries: np.ndarray, low: np.ndarray, high: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the inner products of queries and the vectors with these codes, wide enough for the rounding of doubles.

    Like scores they are held to the range of a long. Where a product is too large for a double, nothing is known: they are the ends of that range.
    """
    at = np.arange(codes.shape[1])
    a, b = low[codes, at], high[codes, at]
    with np.errstate(over="ignore", invalid="ignore"):
        centre = queries @ (a / 2 + b / 2).T
        spread = np.abs(queries) @ (b / 2 - a / 2 + np.maximum(np.abs(a), np.abs(b)) * (codes.shape[1] + 4) * 2.0**-51).T
        lower, upper = centre - spread, centre + spread
    known = np.isfinite(lower) & np.isfinite(upper)
    end = 2.0**63
    return np.clip(np.where(known, lower, -end), -end, end), np.clip(np.where(known, upper, end), -end, end)


def _scan(sent, k: int):
    """Of each query the vectors of this task whose upper bound reaches its kth lower bound.

    What is held is cut by the bounds as they rise, and sent off where there is still too much of it: a task's memory doesn't grow with its vectors.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, qno, low, high = sent.value
        best = np.full((len(q), k), -np.inf)
        found: list[tuple[np.ndarray, ...]] = []
        held = 0

        def left() -> list[np.ndarray]:
            at, no, lower, upper = (np.concatenate(c) for c in zip(*found, strict=True))
            keep = upper >= best.min(1)[at]
            return [at[keep], no[keep], lower[keep], upper[keep]]

        def sent_off(at: np.ndarray, *rest: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (qno[at], *rest)], ["q", "no", "lower", "upper"])

        for batch in batches:
            codes = np.frombuffer(b"".join(batch["code"].to_pylist()), "uint8").reshape(batch.num_rows, q.shape[1])
            no = batch["no"].to_numpy()
            for a in range(0, len(no), CHUNK):
                for b in range(0, len(q), BLOCK):
                    lower, upper = bounds(q[b : b + BLOCK], low, high, codes[a : a + CHUNK])
                    both = np.hstack([best[b : b + BLOCK], lower])
                    best[b : b + BLOCK] = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
                    i, j = np.nonzero(upper >= best[b : b + BLOCK].min(1)[:, None])
                    found.append((b + i, no[a + j], lower[i, j], upper[i, j]))
                    held += len(i)
                    if held > HELD:
                        found = [tuple(left())]
                        held = len(found[0][0])
                        if held > HELD // 2:
                            yield sent_off(*found[0])
                            found, held = [], 0
        if found:
            yield sent_off(*left())

    return scan


def scores(pairs: DataFrame) -> DataFrame:
    """pairs(q, no, upper, w, v) as (q, no, score long): exact inner products, held to the range of a long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            dim = len(batch["w"][0])
            a, b = _matrix(batch["w"], dim), _matrix(batch["v"], dim)
            out = np.zeros(len(a), "int64")
            small = dim * np.abs(a).max(1, initial=0) * np.abs(b).max(1, initial=0) < 2.0**53  # each partial sum is a whole number that a double holds
            out[small] = np.einsum("ij,ij->i", a[small], b[small]).astype("int64")
            for i in np.flatnonzero(~small).tolist():
                out[i] = max(-(1 << 63), min((1 << 63) - 1, sum(int(x) * int(y) for x, y in zip(a[i].tolist(), b[i].tolist(), strict=True))))
            yield pa.RecordBatch.from_arrays([batch["q"], batch["no"], pa.array(out)], ["q", "no", "score"])

    return pairs.select("q", "no", "w", "v").mapInArrow(run, "q long, no long, score long")


def candidates(vectors: DataFrame, queries: DataFrame, dim: int, k: int) -> DataFrame:
    """(q, no, upper, place) for queries(q, v) and vectors(no, vec_id, v), all of `dim` components: what the approximations leave, by upper bound.

    Queries go out in waves of a fixed size, each of which scans the approximations once and writes what it finds.
    """
    spark = vectors.sparkSession
    low, high = marks(vectors, dim)
    file = written(approximated(vectors, low), "approximations")
    n = queries.count()
    waves = -(-n // WAVE)
    dealt = f"{scratch_dir(spark)}/lumenfold-{uuid.uuid4().hex}/waves"
    queries.withColumn("wave", F.pmod(F.xxhash64("q"), F.lit(waves)).cast("int")).repartition("wave").write.partitionBy("wave").parquet(dealt)
    base = f"{scratch_dir(spark)}/lumenfold-{uuid.uuid4().hex}/candidates"
    for w in range(waves):
        rows = spark.read.schema("q long, v array<double>, wave int").parquet(dealt).where(F.col("wave") == w).select("q", "v").toArrow()  # about WAVE queries
        sent = spark.sparkContext.broadcast((_matrix(rows["v"].combine_chunks(), dim), rows["q"].to_numpy(), low, high))
        file.mapInArrow(_scan(sent, k), "q long, no long, lower double, upper double").write.parquet(f"{base}/wave={w}")
        sent.unpersist()
    found = spark.read.schema("q long, no long, lower double, upper double, wave int").parquet(base)
    by_lower = Window.partitionBy("q").orderBy(F.col("lower").desc())  # a few rows from each task
    cut = F.max(F.when(F.col("r") == k, F.col("lower"))).over(Window.partitionBy("q"))
    left = found.withColumn("r", F.row_number().over(by_lower)).withColumn("cut", cut).where(F.col("cut").isNull() | (F.col("upper") >= F.col("cut")))
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.col("upper").desc(), "no"))
    return written(left.withColumn("place", place).select("q", "no", "upper", "place"), "candidates")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank int, vec_id, score long): for each of queries(vec_id, v), which are rows of vectors(vec_id, v), its k best other rows, ties to smaller ids.

    A query meets vectors of its own length only, and every row but its own: rows that share its id or its vector, too. Fewer than k other rows give
    fewer rows; empty tables give none. Queries that share an id have their own k rows each. Of equal vectors only the k + 1 least ids are
    searched: no other can be among a query's k best. Scores beyond a long are held to its range before they are ranked.
    """
    spark = vectors.sparkSession
    own = written(queries.groupBy("vec_id", "v").count().withColumn("q", F.monotonically_increasing_id()), "queries")
    dims = [r["dim"] for r in own.select(F.size("v").alias("dim")).distinct().orderBy("dim").collect()]  # a row for each length of vectors
    if not dims:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    least = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    once = vectors.groupBy("v", "vec_id").count().withColumn("r", least).where(F.col("r") <= k + 1)
    once = written(once.select(F.monotonically_increasing_id().alias("no"), "vec_id", "v", "count"), "vectors")
    parts = []
    for dim in dims:
        here, asked = once.where(F.size("v") == dim), own.where(F.size("v") == dim).select("q", "v")
        if not dim:  # empty vectors are equal, and their product is 0
            parts.append(written(asked.join(here.select("v", "no"), "v").select("q", "no", F.lit(0).cast("long").alias("score")), "scores"))
            continue
        found = candidates(here.select("no", "vec_id", "v"), asked, dim, k + 1)  # one may be the query itself
        exact = lambda c, here=here, asked=asked: written(scores(c.join(here.select("no", "v"), "no").join(asked.select("q", F.col("v").alias("w")), "q")), "scores")
        first = exact(found.where(F.col("place") <= 2 * k))
        nth = F.row_number().over(Window.partitionBy("q").orderBy(F.col("score").desc(), "no"))
        sure = first.withColumn("r", nth).where(F.col("r") == k + 1).select("q", "score")
        more = found.where(F.col("place") > 2 * k).join(sure, "q").where(F.col("upper") >= F.col("score"))
        parts += [first, exact(more.select("q", "no"))]
    counted = reduce(DataFrame.unionByName, parts).join(once.select("no", "vec_id", "count", F.xxhash64("v").alias("vector")), "no")
    counted = counted.join(own.select("q", F.col("vec_id").alias("query_id"), F.col("count").alias("asked"), F.xxhash64("v").alias("own")), "q")
    itself = (F.col("vec_id") == F.col("query_id")) & (F.col("vector") == F.col("own"))
    copies = F.least(F.col("count") - itself.cast("long"), F.lit(k))
    each = counted.withColumn("copies", copies).where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    best = Window.partitionBy("q").orderBy(F.col("score").desc(), "vec_id")
    ranked = each.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.withColumn("ask", F.explode(F.sequence(F.lit(1).cast("long"), "asked"))).select("query_id", "rank", "vec_id", "score")


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best of all vectors for every vector whose id is divisible by 50."""
    vectors = written(quantised(table(spark, sf_dir, "embeddings").select("vec_id", "embedding")), "quantised")
    return top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0))


OP8_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.row, q.vec_id AS query_id, c.vec_id, CASE WHEN len(q.v) = 0 THEN 0 ELSE list_inner_product(q.v, c.v) END::BIGINT AS score
  FROM v q JOIN v c ON q.row <> c.row AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0
), r AS (
  SELECT query_id, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s
)
SELECT * FROM r WHERE rank <= 5
"""

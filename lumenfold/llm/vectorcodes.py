"""Product quantisation of vectors with whole-number codebooks; nearest entries by Orchard's search.

A codebook is small and of fixed size; vectors are read once a round, and each task sends a count and sums for each entry. Every
entry has the list of all entries by their distance from it. A search goes down the list of its best entry so far, jumps to the list of an
entry that is nearer, never works out a distance twice, and stops where the list is further away than twice its best distance: by the triangle
inequality nothing behind can be nearer, or as near. A batch of parts searches in step, each with its own list and place.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.llm.common import table, written

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Vectors that are coded together; components from `WIDE` on are worked on as Python integers, of which no sum overflows.
BLOCK, WIDE = 4096, 1 << 24
#: Components and errors are held to what a long has.
LONG = (1 << 63) - 1
#: Labels up to which their sums are broadcast; beyond, they are joined by shuffle.
FEW_LABELS = 10_000


def _whole(vectors: list[np.ndarray], scale: int) -> np.ndarray:
    """floor(scale * x) of equally long vectors: int64, or Python integers if one of them is large."""
    with np.errstate(over="ignore"):
        y = np.floor(np.stack(vectors).astype("float64") * scale)
    if not len(y) or np.abs(y).max(initial=0) < WIDE:
        return y.astype("int64")
    return np.array([[max(-LONG, min(LONG, int(v))) if np.isfinite(v) else (LONG if v > 0 else -LONG) for v in row] for row in y.tolist()], dtype=object)


def sound_vectors(rows: DataFrame) -> DataFrame:
    """rows(vec_id, embedding, label) whose vector is neither null nor empty nor holds a null or non-finite component."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return rows.where((F.size("embedding") > 0) & finite).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "label")


def neighbour_lists(entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """entries[k, d] as (lists, distances)[k, k]: of each entry all entries by squared distance, ties by index, itself first."""
    apart = ((entries[:, None] - entries[None]) ** 2).sum(2)
    lists = np.array([sorted(range(len(entries)), key=lambda e, i=i: (apart[i, e], e != i, e)) for i in range(len(entries))], dtype="int64").reshape(len(entries), len(entries))
    return lists, np.take_along_axis(apart, lists, 1)


def nearest(values: np.ndarray, entries: np.ndarray, lists: np.ndarray, distances: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Orchard's search of values[n, d]: (index of the nearest entry, squared distance, distances worked out); ties to the lower index.

    Squared distances are compared: twice the distance is four times its square. An entry at exactly twice the distance may tie, so it is still seen.
    """
    n, k = len(values), len(entries)
    best = np.zeros(n, "int64")
    least = ((values - entries[0]) ** 2).sum(1)
    seen = np.zeros((n, k), bool)
    seen[:, 0] = True
    place, live, done = np.ones(n, "int64"), np.arange(n if k > 1 else 0), n
    while len(live):
        now = place[live]
        far = distances[best[live], np.minimum(now, k - 1)] > 4 * least[live]
        live = live[~((now >= k) | far.astype(bool))]
        other = lists[best[live], place[live]]
        place[live] += 1
        new = ~seen[live, other]
        at, other = live[new], other[new]
        seen[at, other] = True
        found = ((values[at] - entries[other]) ** 2).sum(1)
        done += len(at)
        nearer = ((found < least[at]) | ((found == least[at]) & (other < best[at]))).astype(bool)
        at = at[nearer]
        best[at], least[at], place[at] = other[nearer], found[nearer], 1
    return best, least, done


def _searched(books: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    return [(e, *neighbour_lists(e)) for e in books]


def _blocks(batches: Iterator[pa.RecordBatch], scale: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for a in range(0, batch.num_rows, BLOCK):
            part = batch.slice(a, BLOCK)
            yield part, _whole([v.values.to_numpy() for v in part["embedding"]], scale)


def _coded(x: np.ndarray, searched: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Codes [n, parts] and squared distances [n, parts] of vectors."""
    found = []
    for v, (entries, lists, distances) in zip(np.split(x, len(searched), axis=1), searched, strict=True):
        wide = v.dtype == object or entries.dtype == object
        v, entries = (v.astype(object), entries.astype(object)) if wide else (v, entries)
        found.append(nearest(v, entries, lists, distances.astype(object) if wide else distances)[:2])
    return np.stack([c for c, _ in found], 1), np.stack([d for _, d in found], 1)


def _narrowed(entries: list[list[int]]) -> np.ndarray:
    large = max((abs(c) for e in entries for c in e), default=0) >= WIDE
    return np.array(entries, dtype=object if large else "int64")


def codebooks(vectors: DataFrame, dim: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> list[np.ndarray]:
    """A codebook [entries, dim / parts] for each part position of vectors(vec_id, embedding), all of `dim` components, dim a multiple of parts.

    Entries begin as the parts of the vectors with the smallest ids (null is the greatest, equal ids go by their components); fewer vectors give
    fewer entries. A round gives each part to its nearest entry, then an entry is the componentwise floor of the mean of its parts; an
    entry without parts stays. Sums are exact.
    """
    spark, width = vectors.sparkSession, dim // parts
    first = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).select("embedding").collect()
    start = _whole([np.array(r["embedding"]) for r in first], scale)
    books = [_narrowed([[int(c) for c in e] for e in p]) for p in np.split(start, parts, axis=1)]
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(_searched(books))  # a fixed number of entries

        def sums(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            searched = sent.value
            counts, total = np.zeros((parts, entries), "int64"), np.zeros((parts, entries, width), dtype=object)
            for _, x in _blocks(batches, scale):
                codes, _ = _coded(x, searched)
                for p, v in enumerate(np.split(x, parts, axis=1)):
                    counts[p] += np.bincount(codes[:, p], minlength=entries)
                    block = np.zeros((entries, width), v.dtype)
                    np.add.at(block, codes[:, p], v)
                    total[p] += block
            p, e = np.nonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(p, "int32"), pa.array(e, "int32"), pa.array(counts[p, e]), pa.array([[str(int(c)) for c in s] for s in total[p, e]], pa.list_(pa.string()))], ["p", "e", "n", "s"])

        each = vectors.select("embedding").mapInArrow(sums, "p int, e int, n long, s array<string>")
        added = [F.sum(F.get("s", F.lit(i)).cast("decimal(38,0)")).alias(f"s{i}") for i in range(width)]
        books = [b.tolist() for b in books]
        for r in each.groupBy("p", "e").agg(F.sum("n").alias("n"), *added).collect():  # parts * entries rows
            books[r["p"]][r["e"]] = [int(r[f"s{i}"]) // r["n"] for i in range(width)]
        books = [_narrowed(b) for b in books]
        sent.unpersist()
    return books


def encoded(vectors: DataFrame, books: list[np.ndarray], scale: int = SCALE) -> DataFrame:
    """vectors(vec_id, embedding, label) as (vec_id, label, code string, error long): two hex digits a part, squared distances summed up."""
    sent = vectors.sparkSession.sparkContext.broadcast(_searched(books))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in _blocks(batches, scale):
            codes, apart = _coded(x, sent.value)
            error = [min(LONG, int(e)) for e in apart.sum(1).tolist()]
            yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["label"], pa.array([bytes(c).hex() for c in codes.astype("uint8")], pa.string()), pa.array(error, "int64")], ["vec_id", "label", "code", "error"])

    label = vectors.schema["label"].dataType.simpleString()
    return vectors.select("vec_id", "embedding", "label").mapInArrow(run, f"vec_id long, label {label}, code string, error long")


def decoded(code: str, books: list[np.ndarray]) -> list[int]:
    """The whole numbers that a code stands for."""
    return [int(c) for p, b in enumerate(books) for c in b[int(code[2 * p : 2 * p + 2], 16)]]


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all entries' decimal components by part, entry, place."""
    return hashlib.sha256(",".join(str(int(c)) for b in books for e in b for c in e).encode()).hexdigest()


def compressed(rows: DataFrame, parts: int = PARTS) -> tuple[DataFrame, list[np.ndarray]]:
    """rows(vec_id, embedding, label) as (vec_id, code, error, label_error), and the codebooks. label_error: errors summed over equal labels (nulls together).

    Vectors that are null, empty or hold a null or non-finite component are left out; so are those that haven't as many components as the sound
    vector with the smallest id has, or not a multiple of `parts`. Rows that repeat are coded each; a null id stays null. An empty table gives no rows.
    """
    sound = sound_vectors(rows)
    first = sound.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").select(F.size("embedding").alias("n")).first()
    dim = first["n"] if first and first["n"] % parts == 0 else 0
    kept = written(sound.where(F.size("embedding") == dim), "vectors")
    books = codebooks(kept, dim, parts) if dim else [np.empty((0, 0), "int64")] * parts
    codes = written(encoded(kept, books), "codes")
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LONG)).cast("long").alias("label_error")
    totals = codes.groupBy(F.col("label").alias("_label")).agg(total)
    if totals.count() <= FEW_LABELS:
        totals = F.broadcast(totals)
    joined = codes.join(totals, F.col("label").eqNullSafe(F.col("_label")))
    return joined.select("vec_id", "code", "error", "label_error"), books


def op11_orchard_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings in 8 parts of a codebook of 16."""
    found, books = compressed(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    return found.withColumn("codebooks_sha256", F.lit(digest(books)))


def _sql() -> str:
    """The rounds written out; distances and means are whole numbers."""
    steps = [
        """x AS (SELECT vec_id, label, list_transform(embedding, lambda c: floor(4096 * c::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0)""",
        "part AS (SELECT vec_id, p, v[8 * p + 1:8 * p + 8] AS v FROM x, range(8) r(p))",
        "book0 AS (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, v FROM part QUALIFY e < 16)",
    ]
    near = "SELECT vec_id, part.p, part.v, min(struct_pack(d := list_sum(list_transform(list_zip(part.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, e := e)) AS best FROM part JOIN book{0} b ON part.p = b.p GROUP BY ALL"
    for i in range(ROUNDS):
        mean = ", ".join(f"CAST(floor(sum(v[{c}]) / count(*)) AS BIGINT)" for c in range(1, 9))
        steps.append(f"near{i} AS MATERIALIZED ({near.format(i)})")
        steps.append(f"book{i + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.v, b.v) AS v FROM book{i} b LEFT JOIN (SELECT p, best.e AS e, [{mean}] AS v FROM near{i} GROUP BY ALL) m ON b.p = m.p AND b.e = m.e)")
    steps.append(f"last AS MATERIALIZED ({near.format(ROUNDS)})")
    steps.append("code AS (SELECT vec_id, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, sum(best.d)::BIGINT AS error FROM last GROUP BY vec_id)")
    steps.append(f"hash AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS h FROM book{ROUNDS})")
    return "WITH " + ",\n".join(steps) + "\nSELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, h AS codebooks_sha256 FROM code JOIN x USING (vec_id), hash"


OP11_SQL = _sql()

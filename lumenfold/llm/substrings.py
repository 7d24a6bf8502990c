"""Substring deduplication: Rabin-Karp hashes of every window of words, counted in Spark; repeated windows merge into maximal removal intervals.

Documents are dealt out by range of their order into parts, written once in buckets of the part. A part's distinct window hashes go to the
hash range they fall in, eight bytes each; there the windows that an earlier part has too are found, and one bit a window goes back to
its part, where the repeats within the part are known already. A passage that thousands of documents share reaches a hash range once
for each part, whatever the number of its copies there; texts themselves are shuffled once.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.llm.common import clustered, table, written

WINDOW = 20
#: Bytes of text in a part and windows in a hash range, on average. A text is never split over parts.
PART_BYTES, RANGE_WINDOWS = 20 << 20, 1 << 20
#: Bytes of text whose words are in memory as objects at once.
SLICE_BYTES = 1 << 20
#: Hash ranges as powers of two, at least and at most.
LEAST_BITS, MOST_BITS = 8, 16
#: Any odd numbers: the bases of the two polynomials; keys of the words' digests.
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
KEYS = ("window-hash-no-1", "window-hash-no-2")

_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_U = np.uint64


def _slices(raw: bytes) -> Iterator[bytes]:
    """raw, cut at white space into slices of about SLICE_BYTES."""
    at = 0
    while at < len(raw):
        found = _SPACE.search(raw, at + SLICE_BYTES)
        end = found.start() if found else len(raw)
        yield raw[at:end]
        at = end


def word_digests(texts: list[str | None]) -> tuple[np.ndarray, list[np.ndarray]]:
    """The number of words of each text, and two independent 64-bit digests of all words in their order."""
    counts, held, size = np.zeros(len(texts), "int64"), [], 0
    digests: tuple[list[np.ndarray], ...] = ([], [])

    def take() -> None:
        words = np.array(held, dtype=object)
        for out, key in zip(digests, KEYS, strict=True):
            out.append(pd.util.hash_array(words, hash_key=key, categorize=False))

    for i, text in enumerate(texts):
        for part in _slices((text or "").encode()):
            words = part.split()  # at ASCII white space
            counts[i] += len(words)
            held += words
            size += len(part)
            if size >= SLICE_BYTES:
                take()
                held, size = [], 0
    if held:
        take()
    return counts, [np.concatenate(d) if d else np.empty(0, _U) for d in digests]


def polynomials(words: np.ndarray, k: int, base: int) -> np.ndarray:
    """Rabin-Karp hashes of all runs of k words: sum of digest times base to the falling powers, modulo 2 ** 64.

    A run of 2m is two runs of m, one of m + 1 a run and a word, so that k takes about log2(k) passes.
    """
    if len(words) < k:
        return np.empty(0, _U)
    out, m = words, 1
    for bit in bin(k)[3:]:
        out, m = out[:-m] * _U(pow(base, m, 1 << 64)) + out[m:], 2 * m
        if bit == "1":
            out, m = out[:-1] * _U(base) + words[m:], m + 1
    return out


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser with full avalanche (splitmix constants)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Windows:
    """The windows of some texts, sorted by hash: `at` their first words (counted through all texts), `new` where another hash begins,
    `range` and `key` of each distinct hash. A hash has 64 + bits bits, of which the range is the first `bits`."""

    def __init__(self, texts: list[str | None], k: int, bits: int):
        self.counts, (a, b) = word_digests(texts)
        ends = np.cumsum(self.counts)
        first, second = _mix(polynomials(a, k, BASES[0])), polynomials(b, k, BASES[1])
        del a, b
        inside = np.zeros(len(first), bool)
        for lo, hi in zip((ends - self.counts).tolist(), ends.tolist(), strict=True):
            inside[lo : max(lo, hi - k + 1)] = True  # no window crosses the end of a text
        at = np.flatnonzero(inside)
        first, second = first[at], second[at]
        key = (first << _U(bits)) | (_mix(second) & _U((1 << bits) - 1))
        place = (first >> _U(64 - bits)).astype("uint16")
        order = np.lexsort((key, place))  # stable: of equal hashes the first window comes first
        key, place, self.at = key[order], place[order], at[order]
        self.new = np.r_[True, (key[1:] != key[:-1]) | (place[1:] != place[:-1])] if len(key) else np.zeros(0, bool)
        self.key, self.range = key[self.new], place[self.new]


def parted(docs: DataFrame, part_bytes: int = PART_BYTES) -> tuple[DataFrame, int]:
    """docs(doc_id, text) as (part int, at long, doc_id, text), bucketed by part, and the power of two of hash ranges.

    Parts follow each other by doc_id (null last), then digest of the text; rows equal in both are interchangeable.
    """
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / part_bytes))
    bits = min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(max(4 * n, total / 6 / RANGE_WINDOWS)))))
    order = [F.col("doc_id").asc_nulls_last(), F.col("_digest").asc(), F.col("_tie").asc()]
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("_digest"), F.monotonically_increasing_id().alias("_tie"))
    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ranged = keyed.repartitionByRange(n, *order).sortWithinPartitions(*order).select(F.spark_partition_id().alias("part"), at.alias("at"), "doc_id", "text")
    return clustered(ranged, "part", n, "parts"), bits


def repeats(docs: DataFrame, window: int = WINDOW, part_bytes: int = PART_BYTES) -> DataFrame:
    """docs(doc_id long, text) as (doc_id, n_words long, n_removed long, spans array<struct<start long, end long>>, kept string), a row for each row.

    A span is a maximal run of words, counted from 0, end not included, that windows cover whose words also start earlier: in a row with a
    smaller doc_id (null is the greatest; rows of one doc_id go by a digest of their text) or sooner in the same text. Windows are judged
    on the input. `kept` is what is left, words joined by one space. A null or empty text has no words; texts under `window` words
    have no windows and stay. Windows count as equal if both their hashes are: 72 bits or more, with the number of hash ranges.
    """
    parts, bits = parted(docs.select("doc_id", "text"), part_bytes)

    def sent(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("at")
        part = rows["part"][0].as_py()
        found = Windows(rows["text"].to_pylist(), window, bits)
        starts = np.flatnonzero(np.r_[True, found.range[1:] != found.range[:-1]]) if len(found.range) else np.empty(0, "int64")
        ends = np.r_[starts, len(found.range)].astype("int32") * 8
        keys = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends.astype("int32").tobytes()), pa.py_buffer(found.key.astype("<u8").tobytes())])
        return pa.table({"range": pa.array(found.range[starts].astype("int32")), "part": pa.array(np.full(len(starts), part, "int32")), "keys": keys})

    def met(rows: pa.Table) -> pa.Table:
        """Of each part's keys in this range a bit: an earlier part has it."""
        parts_of, place = rows["part"].to_numpy(), rows["range"][0].as_py()
        keys = [np.frombuffer(k.as_buffer(), "<u8") for k in rows["keys"]]
        flat, sizes = np.concatenate(keys), np.array([len(k) for k in keys])
        owner = np.repeat(parts_of, sizes)
        order = np.lexsort((owner, flat))
        later = np.zeros(len(flat), bool)
        later[order[1:]] = flat[order[1:]] == flat[order[:-1]]
        bits_of = [np.packbits(x).tobytes() if x.any() else None for x in np.split(later, np.cumsum(sizes)[:-1])]
        some = [i for i, x in enumerate(bits_of) if x is not None]
        return pa.table({"part": pa.array(parts_of[some], "int32"), "range": pa.array(np.full(len(some), place, "int32")), "later": pa.array([bits_of[i] for i in some], pa.binary())})

    def removed(rows: pa.Table, replies: pa.Table) -> pa.Table:
        rows = rows.sort_by("at")
        texts = rows["text"]
        found = Windows(texts.to_pylist(), window, bits)
        later = np.zeros(len(found.key), bool)
        for place, packed in zip(replies["range"].to_pylist(), replies["later"].to_pylist(), strict=True):
            lo, hi = np.searchsorted(found.range, [place, place + 1])
            later[lo:hi] = np.unpackbits(np.frombuffer(packed, "uint8"), count=hi - lo)
        again = ~found.new
        again[found.new] = later
        edge = np.zeros(int(found.counts.sum()) + 1, "int32")
        starts = found.at[again]
        edge[starts] += 1  # no two windows begin or end at one word
        edge[starts + window] -= 1
        gone = np.cumsum(edge[:-1]) > 0
        n_removed, spans, kept, at = [], [], [], 0
        for text, n in zip(texts, found.counts.tolist(), strict=True):
            mask = gone[at : at + n]
            at += n
            turns = np.flatnonzero(np.diff(np.r_[False, mask, False])).tolist()
            spans.append([{"start": a, "end": b} for a, b in zip(turns[::2], turns[1::2], strict=True)])
            n_removed.append(int(mask.sum()))
            left, i = [], 0
            for part in _slices((text.as_py() or "").encode()):
                words = part.split()
                left += itertools.compress(words, (~mask[i : i + len(words)]).tolist()) if turns else words
                i += len(words)
            kept.append(b" ".join(left).decode())
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.table({"doc_id": rows["doc_id"].cast(pa.int64()), "n_words": pa.array(found.counts, "int64"), "n_removed": pa.array(n_removed, "int64"), "spans": pa.array(spans, span), "kept": pa.array(kept, pa.string())})

    keys = parts.groupBy("part").applyInArrow(lambda rows: sent(rows), "range int, part int, keys binary")
    replies = written(keys.groupBy("range").applyInArrow(lambda rows: met(rows), "part int, range int, later binary"), "replies")
    both = parts.groupBy("part").cogroup(replies.groupBy("part"))
    return both.applyInArrow(lambda rows, found: removed(rows, found), "doc_id long, n_words long, n_removed long, spans array<struct<start: bigint, end: bigint>>, kept string")


def op13_repeated_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the passages of 20 words and more that an earlier document, or the same one, has already."""
    found = repeats(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP13_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents
), s AS (
  SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS words FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d)
), again AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY words ORDER BY doc_id, i) AS place FROM s) WHERE place > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM again
), word AS (
  SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM d
), kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS words FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(words, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

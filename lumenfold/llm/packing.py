"""Best-fit packing by linear grouping.

Only the histogram of piece lengths (at most `capacity` numbers) reaches the driver. There, large lengths are put in groups of equal
cardinality and rounded up to the largest of their group; configurations of the few rounded sizes are optimised (column
generation with a knapsack for each step); the actual lengths take the places of the rounded ones; and small
pieces go, from the longest on, to the fullest sequence that still has room. The plan is a list of intervals "pieces number
a to b of length l go to sequences s, s + 1, ..., at offset o"; the executors number the pieces of each length and look their places up.
"""

from __future__ import annotations

import base64
import re
import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenfold.llm.common import table, written

CAPACITY = 2048
END_ID = 0
#: The added tokens of byte_bpe_50k.json.
ADDED = {"<|endoftext|>": 50256}
#: Runs of white space, or of anything else, from this length on go to `tokenizers`: the other implementation recurses along them.
LONG_RUN = 10_000
#: (groups, bound of large as a part of the capacity) that are tried in this order.
CHOICES = ((4, 0.4), (6, 0.3), (3, 0.45), (5, 0.4), (8, 0.4), (12, 0.45), (24, 0.4), (48, 0.4))


def encoding(ranks_path: str | None = None) -> tiktoken.Encoding:
    """The ids of byte_bpe_50k.json. Its vocabulary is read as ranks: that implementation gives the same ids in a fifth of the time."""
    import public_tokenizers

    with open(ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@cache
def exact_tokenizer(json_path: str | None = None):
    """The tokenizer of byte_bpe_50k.json itself, with which added tokens are ordinary text."""
    import public_tokenizers
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(json_path or public_tokenizers.path("byte_bpe_50k.json"))
    found.encode_special_tokens = True
    return found


def tokenised(docs: DataFrame, ranks_path: str | None = None, capacity: int = CAPACITY, added: dict[str, int] | None = None, json_path: str | None = None) -> DataFrame:
    """docs(doc_id, text) as pieces (doc_id, piece int, start long, length long, ids_crc32 long).

    A document is its text's ids and the end id; a null or empty text is the end id alone. One of more than `capacity` ids is cut
    into pieces of `capacity`, of which the first takes what is over. Where a text holds one of the tokens `added`, it has that one id, as
    `tokenizers` has it by default with ADDED; without them such a token is text like any other (encode_special_tokens). Texts with a run of
    LONG_RUN signs without or of nothing but white space are encoded by `tokenizers`, to the same ids, since the faster implementation fails on them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fast = encoding(ranks_path).encode_ordinary
        runs = re.compile(rf"\s{{{LONG_RUN},}}|\S{{{LONG_RUN},}}")
        cut = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None

        def plain(text: str) -> list[int]:
            if len(text) >= LONG_RUN and runs.search(text):
                return exact_tokenizer(json_path).encode(text, add_special_tokens=False).ids
            return fast(text)

        def encode(text: str) -> list[int]:
            if cut is None or not cut.search(text):
                return plain(text)
            return [i for part in cut.split(text) for i in ([added[part]] if part in added else plain(part))]

        for batch in batches:
            doc, piece, start, length, crc = [], [], [], [], []
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                ids = encode(text.as_py() or "")
                ids.append(END_ID)
                n, raw = len(ids), np.array(ids, "<u4").tobytes()
                cuts = [0, *range(n % capacity or capacity, n, capacity), n]
                for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    doc.append(doc_id), piece.append(i), start.append(a), length.append(b - a), crc.append(zlib.crc32(raw[4 * a : 4 * b]))
            yield pa.RecordBatch.from_arrays([pa.array(doc, "int64"), pa.array(piece, "int32"), *(pa.array(c, "int64") for c in (start, length, crc))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def group_up(counts: dict[int, int], groups: int) -> list[list[tuple[int, int]]]:
    """Lengths with their counts in groups of nearly equal cardinality, longest first. A length isn't split over groups."""
    total, out, held = sum(counts.values()), [], 0
    for length in sorted(counts, reverse=True):
        if not out or held >= total / groups:
            out.append([])
            held = 0
        out[-1].append((length, counts[length]))
        held += counts[length]
    return out


def configurations(sizes: list[int], demand: list[int], capacity: int, steps: int = 400) -> list[tuple[np.ndarray, int]]:
    """Configurations (how many pieces of each size) and how often to use each, at most as often as the demand allows.

    The linear program "fewest sequences that meet the demand" by column generation: a knapsack over the capacity finds the configuration
    of greatest value at the current prices. Counts are rounded down; the rest is left to best fit.
    """
    k = len(sizes)
    basis = np.diag([capacity // s for s in sizes]).astype(float)
    want = np.array(demand, float)
    for _ in range(steps):
        prices = np.linalg.solve(basis.T, np.ones(k))
        value, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        for c in range(1, capacity + 1):
            value[c] = value[c - 1]
            for i, s in enumerate(sizes):
                if s <= c and value[c - s] + prices[i] > value[c] + 1e-12:
                    value[c], last[c] = value[c - s] + prices[i], i
        if value[capacity] <= 1 + 1e-9:
            break
        column, c = np.zeros(k), capacity
        while c > 0:
            if last[c] < 0:
                c -= 1
            else:
                column[last[c]] += 1
                c -= sizes[last[c]]
        amounts, change = np.linalg.solve(basis, want), np.linalg.solve(basis, column)
        ratios = np.where(change > 1e-9, amounts / np.maximum(change, 1e-9), np.inf)
        out = int(np.argmin(ratios))
        if not np.isfinite(ratios[out]):
            break
        basis[:, out] = column
    amounts = np.linalg.solve(basis, want)
    left, used = np.array(demand), []
    for j in np.argsort(-amounts):
        column = basis[:, j].astype(int)
        most = int(min(left[i] // column[i] for i in np.flatnonzero(column)))
        times = min(max(0, int(amounts[j] + 1e-9)), most)
        if times:
            left = left - times * column
            used.append((column, times))
    return used


def plan_with(histogram: dict[int, int], capacity: int, groups: int, large: float) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Places for a histogram {length: count}: rows (length, from, to, sequence, offset) and the number of sequences.

    Pieces number from..to-1 of that length go to sequence, sequence + 1, ... at that offset. Lengths are 1 to capacity. Those
    over large * capacity are grouped; what no whole number of configurations holds goes to best fit with the small ones.
    """
    histogram = {int(k): int(v) for k, v in histogram.items() if v > 0}
    given: dict[int, int] = defaultdict(int)  # pieces of a length that have a place
    rows: list[tuple[int, int, int, int, int]] = []
    sequences = 0
    runs: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room left: runs (first sequence, how many)
    rooms: list[int] = []  # a sorted list of the rooms in use

    def put(length: int, count: int, first: int, offset: int) -> None:
        rows.append((length, given[length], given[length] + count, first, offset))
        given[length] += count

    big = {k: v for k, v in histogram.items() if k > large * capacity and k < capacity}
    if histogram.get(capacity):
        put(capacity, histogram[capacity], sequences, 0)
        sequences += histogram[capacity]
    left = dict(big)
    if big:
        grouped = group_up(big, groups)
        queue = [[[length, n] for length, n in g] for g in grouped]  # longest first
        for column, times in configurations([g[0][0] for g in grouped], [sum(n for _, n in g) for g in grouped], capacity):
            places = [int(i) for i in np.flatnonzero(column) for _ in range(int(column[i]))]
            # each place of the configuration takes its own stretch of the group, so a run ends where a length ends
            stretches = []
            for i in places:
                need, own = times, []
                while need:
                    head = queue[i][0]
                    n = min(need, head[1])
                    own.append([head[0], n])
                    head[1] -= n
                    need -= n
                    if not head[1]:
                        queue[i].pop(0)
                stretches.append(own)
            done = 0
            while done < times:
                n, offset = min(s[0][1] for s in stretches), 0
                for s in stretches:
                    put(s[0][0], n, sequences + done, offset)
                    left[s[0][0]] -= n
                    offset += s[0][0]
                    s[0][1] -= n
                    if not s[0][1]:
                        s.pop(0)
                runs[capacity - offset].append((sequences + done, n))
                done += n
            sequences += times
    rooms = sorted(r for r in runs if r)
    rest = {**{k: v for k, v in histogram.items() if k <= large * capacity and k < capacity}, **{k: v for k, v in left.items() if v}}
    for length in sorted(rest, reverse=True):  # best fit, longest first
        todo = rest[length]
        while todo:
            at = bisect_left(rooms, length)
            if at == len(rooms):  # a new sequence, then as full of this length as it gets
                each = capacity // length
                full, over = divmod(todo, each)
                for number, held in ((full, each), (1 if over else 0, over)):
                    if number:
                        for j in range(held):
                            put(length, number, sequences, j * length)
                        room = capacity - held * length
                        if room:
                            if not runs[room]:
                                insort(rooms, room)
                            runs[room].append((sequences, number))
                        sequences += number
                todo = 0
                break
            room = rooms[at]
            first, n = runs[room].pop()
            if not runs[room]:
                rooms.pop(at)
            each = room // length  # the same sequence stays the fullest with room, so it takes more of them
            if todo >= each:
                n_used, held = min(n, todo // each), each
            else:
                n_used, held = 1, todo
            if n > n_used:
                if not runs[room]:
                    insort(rooms, room)
                runs[room].append((first + n_used, n - n_used))
            for j in range(held):
                put(length, n_used, first, capacity - room + j * length)
            todo -= n_used * held
            new = room - held * length
            if new:
                if not runs[new]:
                    insort(rooms, new)
                runs[new].append((first, n_used))
    return rows, sequences


def plan(histogram: dict[int, int], capacity: int = CAPACITY, choices: tuple[tuple[int, float], ...] = CHOICES) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """The best of the plans with these numbers of groups and bounds of large; at once one that has as few sequences as the tokens need."""
    least = -(-sum(k * v for k, v in histogram.items()) // capacity)
    best = None
    for groups, large in choices:
        found = plan_with(histogram, capacity, groups, large)
        if best is None or found[1] < best[1]:
            best = found
        if best[1] == least:
            break
    return best


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces(doc_id, piece, start, length, ids_crc32) with sequence_id long and offset long. An empty table gives no rows."""
    spark = pieces.sparkSession
    part = F.spark_partition_id()
    fixed = written(pieces.withColumn("part", part), "pieces")
    counts = fixed.groupBy("length", "part").count()
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}  # at most `capacity` rows
    if not histogram:
        return spark.createDataFrame([], "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    rows, _ = plan(histogram, capacity)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("at"))
    own = Window.partitionBy("part", "length").orderBy("doc_id", "piece", "ids_crc32")
    numbered = fixed.withColumn("own", F.row_number().over(own) - 1).join(starts, ["part", "length"])
    places = np.array(sorted(rows), "int64")
    wide = np.int64(1) << np.int64(44)  # more pieces of one length than that don't occur
    sent = spark.sparkContext.broadcast((places[:, 0] * wide + places[:, 1], places))

    def look_up(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, rows = sent.value
        for f in frames:
            number = f.pop("number").to_numpy()
            row = rows[np.searchsorted(keys, f["length"].to_numpy() * wide + number, side="right") - 1]
            yield f.assign(sequence_id=row[:, 3] + number - row[:, 1], offset=row[:, 4])

    numbered = numbered.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("own") + F.col("at")).cast("long").alias("number"))
    return numbered.mapInPandas(look_up, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op6_packed_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    return pack(tokenised(table(spark, sf_dir, "documents"), added=ADDED))

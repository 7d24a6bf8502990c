"""Near duplicates by BagMinHash over the multiset of word shingles, banding, and verification of the multiset overlap.

Weights are whole numbers: how often a text has a shingle. Of each shingle's weight axis, cut into intervals (0,1], (1,2], (2,4], (4,8] ...,
every interval has its own Poisson process of points; a point is a time, one of the signature's components and a place on the axis, and
counts where the place is under the weight. A component is the least time of its points, so two texts agree in one with the
probability of their weighted Jaccard similarity. Points are made in the order of time and only up to the largest component.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.llm.common import table, written

WORDS, SIMILARITY = 5, 0.8
#: 32 bands of 6: of pairs at 0.8, one in 16,000 shares no band; of pairs at 0.3, one in 43 shares one.
BANDS, ROWS = 32, 6
#: Bytes of text that are hashed together.
BATCH_BYTES = 4 << 20
#: Counters of the sketch that orders shingles by frequency, as a power of two.
COUNTER_BITS = 20
#: Rows of slim tables (links, pairs, roots) that one task takes.
ROWS_A_TASK = 200_000
#: Pairs of a bucket's members under different roots, for each member on average: from where on leaders come first, from where on dense buckets
#: are dealt anew, and how many are compared at once in the end (a pair shares many of its keys, so it counts many times).
PAIRS_LED, PAIRS, PAIRS_DEALT = 4, 16, 256
#: Keys of a node before a row's own that the row carries, at most: a pair is compared at its first common key, not at each.
BEFORE = 32
#: A further round of leaders comes only where the last one left at most this share of the pairs.
LEADERS_GAIN = 0.25

_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser with full avalanche (splitmix constants)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.r_[_U(1), np.full(n, _U(0x9E3779B97F4A7C15) | _U(1))].astype(_U), dtype=_U)


def shingles(texts: pa.Array, k: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text's place, shingle digest, how often), sorted by both: of each text the runs of k words (one of all its words if it has fewer).

    Words are what lies between ASCII white space, as written. A word's digest is a polynomial of its bytes, a shingle's one of its words' digests.
    """
    texts = pa.concat_arrays([texts.cast(pa.large_binary()).fill_null(b"")])
    at = np.frombuffer(texts.buffers()[1], "int64")[texts.offset : texts.offset + len(texts) + 1]
    lo, hi = (int(at[0]), int(at[-1])) if len(at) else (0, 0)
    data = np.frombuffer(texts.buffers()[2] or b"", "uint8")[lo:hi]
    empty = (np.empty(0, "int64"), np.empty(0, _U), np.empty(0, "int64"))
    if not len(data):
        return empty
    bounds = at - lo
    inner = ~((data == 32) | ((data >= 9) & (data <= 13)))
    cut = np.zeros(len(data) + 1, bool)
    cut[bounds] = True  # texts meet here
    before = np.r_[False, inner[:-1]]
    start = np.flatnonzero(inner & (~before | cut[:-1]))
    if not len(start):
        return empty
    after = np.r_[inner[1:], False]
    end = np.flatnonzero(inner & (~after | cut[1:])) + 1
    with np.errstate(over="ignore"):
        # mixed bytes times falling powers; differences of sums, brought to a common power by the inverse of the odd base
        n = end - start
        longest = int(n.max())
        word = np.zeros(len(start), _U)
        if longest <= 64:
            for i in range(longest):  # Horner, a place in all words at a time
                live = np.flatnonzero(n > i)
                word[live] = (word[live] + data[start[live] + i].astype(_U) + _U(1)) * _U(0x100000001B3)
        else:
            short = n <= 64
            for i in range(int(n[short].max(initial=0))):
                live = np.flatnonzero(short & (n > i))
                word[live] = (word[live] + data[start[live] + i].astype(_U) + _U(1)) * _U(0x100000001B3)
            for j in np.flatnonzero(~short):
                m = int(n[j])
                p = np.full(m, _U(0x100000001B3))
                word[j] = ((data[start[j] : end[j]].astype(_U) + _U(1)) * np.cumprod(p, dtype=_U)[::-1]).sum(dtype=_U)
        word = _mix(word + n.astype(_U))
        text = np.searchsorted(bounds, start, side="right") - 1
        words = np.bincount(text, minlength=len(bounds) - 1)
        first = np.cumsum(words) - words
        digest, held = np.zeros(len(word), _U), np.ones(len(word), bool)
        for i in range(k):
            moved = np.zeros(len(word), _U)
            moved[: len(word) - i] = word[i:]
            inside = np.zeros(len(word), bool)
            inside[: len(word) - i] = text[i:] == text[: len(word) - i]
            few = words[text] < k
            held &= inside | (few & (np.arange(len(word)) == first[text]))
            digest = digest * _U(0xD6E8FEB86659FD93) + np.where(inside, moved, _U(0)) + _U(1)
        digest = _mix(digest)[held]
        text = text[held]
    order = np.lexsort((digest, text))
    text, digest = text[order], digest[order]
    new = np.flatnonzero(np.r_[True, (digest[1:] != digest[:-1]) | (text[1:] != text[:-1])])
    return text[new], digest[new], np.diff(np.r_[new, len(text)])


def bag_min_hash(text: np.ndarray, element: np.ndarray, weight: np.ndarray, n_texts: int, size: int) -> np.ndarray:
    """Signatures [n_texts, size] of times, from weighted elements (weights: whole numbers from 1); a text without any has infinite times."""
    least = np.full(n_texts * size, np.inf)
    depth = np.ceil(np.log2(np.maximum(weight, 1))).astype("int64")  # intervals 0..depth reach the weight
    owner = np.repeat(np.arange(len(weight)), depth + 1)
    level = np.arange(len(owner)) - np.repeat(np.cumsum(depth + 1) - depth - 1, depth + 1)
    begin = np.where(level == 0, 0, 1 << np.maximum(level - 1, 0))
    width = np.maximum(begin, 1)
    with np.errstate(over="ignore", divide="ignore"):
        seed = _mix(element[owner] + level.astype(_U) * _U(0x9E3779B97F4A7C15))
        base, top, time = text[owner] * size, weight[owner], np.zeros(len(owner))
        step = _U(0)
        while len(seed):
            step += _U(1)
            draw = _mix(seed + step * _U(0xD1B54A32D192ED03))
            time = time - np.log((draw >> _U(11)).astype("float64") * 2.0**-53 + 2.0**-54) / (size * width)
            more = _mix(draw + _U(0x8CB92BA72F3D8DD7))
            where = begin + ((more >> _U(20)) % width.astype(_U)).astype("int64")
            hit = where < top
            np.minimum.at(least, base[hit] + ((more & _U(0xFFFFF)) % _U(size)).astype("int64")[hit], time[hit])
            limit = least.reshape(n_texts, size).max(1)
            live = np.flatnonzero(time < limit[base // size])
            seed, base, top, time, begin, width = (x[live] for x in (seed, base, top, time, begin, width))
    return least.reshape(n_texts, size)


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Cuts texts into runs of about BATCH_BYTES, at least a text each."""
    sizes = np.cumsum(np.r_[0, [len(t.as_buffer()) if t.is_valid else 0 for t in texts]])
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(sizes, sizes[a] + BATCH_BYTES, side="right")) - 1)
        yield a, b
        a = b


def signed(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """docs(doc_id, digest, text) as (doc_id, digest, n long, keys array<long>): n shingles and a key for each band (none without words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = _mix(np.arange(1, bands + 1, dtype=_U) * _U(0xA24BAED4963EE407))
        for batch in batches:
            texts = batch["text"]
            for a, b in _slices(texts):
                text, element, weight = shingles(texts.slice(a, b - a))
                total = np.bincount(text, weights=weight, minlength=b - a).astype("int64")
                times = bag_min_hash(text, element, weight, b - a, bands * rows).view(_U).reshape(b - a, bands, rows)
                keys = np.broadcast_to(salt, (b - a, bands))
                with np.errstate(over="ignore"):
                    for i in range(rows):
                        keys = _mix(keys * _U(0x9FB21C651E98DF25) + times[:, :, i])
                offsets = np.r_[0, np.cumsum((total > 0) * bands)].astype("int32")
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[total > 0].reshape(-1).view("int64")))
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([part["doc_id"], part["digest"], pa.array(total), lists], ["doc_id", "digest", "n", "keys"])

    return docs.select("doc_id", "digest", "text").mapInArrow(run, "doc_id long, digest string, n long, keys array<long>")


def _occurrences(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text, item): an item for each occurrence of a shingle; the i-th of one shingle is the same item in every text."""
    text, element, weight = shingles(texts)
    place = np.arange(int(weight.sum())) - np.repeat(np.cumsum(weight) - weight, weight)
    with np.errstate(over="ignore"):
        return np.repeat(text, weight), _mix(np.repeat(element, weight) + place.astype(_U) * _U(0x9E3779B97F4A7C15))


def rare_keys(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """docs(node, root, text) as (key, node, root, n, i, prior): of each text's n shingle occurrences the rarest n - ceil(similarity * n) + 1, as keys; i counts rarer
    ones, of which prior holds the last BEFORE.

    Exact: in one order of all occurrences, two texts of at least that similarity share one of these. The order is by frequency, which keeps
    passages that many texts share out of the keys. Frequencies come from a sketch of 2 ** COUNTER_BITS counters, whatever the input;
    where counters are shared, only the order is another.
    """
    shift = _U(64 - COUNTER_BITS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << COUNTER_BITS, "int64")
        for batch in batches:
            for a, b in _slices(batch["text"]):
                _, item = _occurrences(batch["text"].slice(a, b - a))
                total += np.bincount((item >> shift).astype("int64"), minlength=1 << COUNTER_BITS)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype("int32")), pa.array(total[used])], ["counter", "c"])

    counted = docs.select("text").mapInArrow(count, "counter int, c long").groupBy("counter").agg(F.sum("c").alias("c")).toArrow()  # bounded by the sketch
    often = np.zeros(1 << COUNTER_BITS, "int64")
    often[counted["counter"].to_numpy()] = counted["c"].to_numpy()
    sent = docs.sparkSession.sparkContext.broadcast(often)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, root = (batch[c].to_numpy(zero_copy_only=False) for c in ("node", "root"))
            for a, b in _slices(batch["text"]):
                text, item = _occurrences(batch["text"].slice(a, b - a))
                order = np.lexsort((item, sent.value[(item >> shift).astype("int64")], text))
                text, item = text[order], item[order]
                n = np.bincount(text, minlength=b - a)
                rank = np.arange(len(text)) - (np.cumsum(n) - n)[text]
                first = rank <= (n - np.ceil(similarity * n - 1e-9).astype("int64"))[text]
                text, item, rank = text[first], item[first].view("int64"), rank[first]
                held = np.minimum(rank, BEFORE)
                offsets = np.r_[0, np.cumsum(held)]
                prior = item[np.arange(offsets[-1]) - np.repeat(offsets[:-1] - np.arange(len(item)) + held, held)]
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype("int32")), pa.array(prior))
                yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(node[a:b][text]), pa.array(root[a:b][text]), pa.array(n[text]), pa.array(rank), lists], ["key", "node", "root", "n", "i", "prior"])

    return docs.select("node", "root", "text").mapInArrow(choose, "key long, node long, root long, n long, i long, prior array<long>")


def overlaps(pairs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """pairs(a, b, text_a, text_b) as (a, b) of those whose shingle multisets have a weighted Jaccard similarity of at least that."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                both = []
                for side in ("text_a", "text_b"):
                    text, element, weight = shingles(part[side])
                    both.append((text, element, weight))
                m = part.num_rows
                total = sum(np.bincount(t, weights=w, minlength=m) for t, _, w in both)
                text, element = (np.concatenate([b[i] for b in both]) for i in (0, 1))
                weight = np.concatenate([b[2] for b in both])
                order = np.lexsort((element, text))
                text, element, weight = text[order], element[order], weight[order]
                same = np.flatnonzero((text[1:] == text[:-1]) & (element[1:] == element[:-1]))
                shared = np.bincount(text[same], weights=np.minimum(weight[same], weight[same + 1]), minlength=m)
                good.append(shared >= similarity * (total - shared) - 1e-9)
            mask = pa.array(np.concatenate(good) if good else np.empty(0, bool))
            yield pa.RecordBatch.from_arrays([batch["a"].filter(mask), batch["b"].filter(mask)], ["a", "b"])

    return pairs.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def _small(df: DataFrame, rows: int) -> DataFrame:
    """df in no more partitions than its rows need; rows is an upper bound of what a shuffle left."""
    return df.coalesce(1 + rows // ROWS_A_TASK)


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node of each node's component, for edges(a, b).

    Rounds of two steps until nothing changes: every node takes the least root among itself and its neighbours, then its root's root. Each
    round is written to the shared folder, in as many partitions as the number of edges asks for.
    """
    both = written(edges.select("a", "b").union(edges.select("b", "a")), "edges")
    n = both.count()
    state = written(_small(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("root")), n), "roots")
    while True:
        near = both.join(state, both["b"] == state["node"]).groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        new = state.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        up = state.select(F.col("node").alias("root"), F.col("root").alias("above"))
        new = written(_small(new.join(up, "root").select("node", "old", "above"), n), "roots").withColumnRenamed("above", "root")
        if new.where("old <> root").isEmpty():
            return new.select("node", "root")
        state = new.select("node", "root")


def _moved(rows: DataFrame, m: DataFrame) -> DataFrame:
    """rows(root, ...) with each root replaced by what m(node, root) says of it, if it says anything."""
    to = m.where("node <> root").select(F.col("node").alias("root"), F.col("root").alias("_to"))
    return rows.join(to, "root", "left").withColumn("root", F.coalesce("_to", "root")).drop("_to")


def _composed(roots: DataFrame, m: DataFrame) -> DataFrame:
    """roots(node, root) followed by m(node, root), which holds roots only."""
    return _moved(roots, m).select("node", "root").unionByName(m.select("node", "root").join(roots.select("node"), "node", "left_anti"))


def _digest() -> Column:
    return F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256)


def _classes(docs: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame]:
    """Of docs(doc_id, text), ids not null: (doc_id, digest) of every row, and (digest, class_id, class_digest) of every text: the least doc_id of
    the class, and which of its texts has it (the least, if several do)."""
    rows = written(signed(docs.select("doc_id", "text", _digest().alias("digest"))), "signatures")
    # rows of one digest have the same shingles, so any of their keys will do; a node's number is fixed once the table is written
    least = rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.first("n").alias("n"), F.first("keys").alias("keys"))
    nodes = written(least.withColumn("node", F.monotonically_increasing_id()), "nodes")
    mine = nodes.select("node", "n", F.explode("keys").alias("key"))
    lead = mine.groupBy("key").agg(F.count("*").alias("c"), F.min(F.struct("node", "n")).alias("l")).where("c > 1")
    held = written(mine.join(lead.select("key", F.col("l.node").alias("node0"), F.col("l.n").alias("n0")), "key").withColumn("i", F.lit(0).cast("long")), "buckets")
    met = nodes.select("node", "digest", F.col("first").alias("doc_id")).join(held.select("node").distinct(), "node", "left_semi")
    texts = docs.select("doc_id", "text").join(met, "doc_id").where(_digest() == F.col("digest")).dropDuplicates(["node"])
    texts = written(texts.select("node", "text"), "texts")  # a text for each node that shares a bucket

    def verified(pairs: DataFrame) -> DataFrame:
        a = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
        b = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
        return written(_small(overlaps(pairs.join(b, "b").join(a, "a"), similarity), 400 * pairs.count()), "links")

    fit = (F.least("n", "n0") >= similarity * F.greatest("n", "n0") - 1e-9) & (F.col("node") > F.col("node0"))
    pairs = written(held.where(fit).groupBy(F.col("node").alias("b")).agg(F.min("node0").alias("a")).select("a", "b"), "pairs")
    tried = [pairs]
    roots = components(verified(pairs))
    # two texts share at most what either has from their first common key on; with bands (i is 0) that bounds the sizes
    share = similarity / (1 + similarity)
    size = F.least(F.col("n") - F.col("i"), F.col("n0") - F.col("i0")) >= share * (F.col("n") + F.col("n0")) - 1e-9
    # of two rows that pass, the smaller one would pass with its like, so each pair has such a row, and buckets without any are closed
    able = F.col("n") - F.col("i") >= share * 2 * F.col("n") - 1e-9

    def still_open(at: DataFrame) -> DataFrame:
        """Of rows(key, node, n, i, root) those of buckets with pairs left; what is closed stays closed, so rounds work on ever fewer rows."""
        per = at.groupBy("key", "root").agg(F.count_if(able).cast("double").alias("x"), F.count("*").cast("double").alias("c"), F.min(F.when(able, F.col("n"))).alias("least")).groupBy("key")
        x, c, xc, xx = F.sum("x"), F.sum("c"), F.sum(F.col("x") * F.col("c")), F.sum(F.col("x") * F.col("x"))
        # pairs under different roots, one of them able; a row whose bound fails even with the smallest able one has no partner
        left = per.agg((x * c - xc - (x * x - xx) / 2).alias("p"), c.alias("c"), F.min("least").alias("_least")).where("p > 0")
        rows = at.drop("p").join(left.select("key", (F.col("p") / F.col("c")).alias("p"), "_least"), "key")
        return written(rows.where(able | (F.col("n") - F.col("i") >= share * (F.col("n") + F.col("_least")) - 1e-9)).drop("_least"), "open")

    def join_up(found: DataFrame, members: int) -> DataFrame | None:
        """Compares the pairs found(node, root, node0, root0) that weren't before; gives the map of roots that links between them join."""
        nonlocal roots
        old = reduce(DataFrame.unionByName, tried)
        sides = F.when(F.col("node") < F.col("node0"), F.struct(F.col("node").alias("a"), F.col("root").alias("ra"), F.col("node0").alias("b"), F.col("root0").alias("rb")))
        sides = sides.otherwise(F.struct(F.col("node0").alias("a"), F.col("root0").alias("ra"), F.col("node").alias("b"), F.col("root").alias("rb")))
        found = found.select(sides.alias("s")).select("s.*").groupBy("a", "b").agg(F.first("ra").alias("ra"), F.first("rb").alias("rb"))
        found = written(_small(found.join(old, ["a", "b"], "left_anti"), 20 * members), "pairs")
        if found.isEmpty():
            return None
        tried.append(found.select("a", "b"))
        if len(tried) > 8:
            tried[:] = [written(reduce(DataFrame.unionByName, tried), "pairs")]
        links = found.join(verified(found.select("a", "b")), ["a", "b"]).select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct()
        m = components(links)  # links between what earlier links have joined
        roots = written(_composed(roots, m), "roots")
        return m

    def rooted(rows: DataFrame) -> DataFrame:
        """rows(node, ...) with the present roots, by node: a join by root would put all members of a large class in one task."""
        return rows.drop("root").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))

    at = rooted(held.select("key", "node", "n", "i"))
    turn, dealt, before = 0, False, math.inf
    while True:
        now = still_open(at)
        members, left = now.agg(F.count("*"), F.sum("p")).first()
        if not members:
            break
        dense = left > PAIRS * members
        if left > PAIRS_LED * members and left <= LEADERS_GAIN * before:  # two more leaders a bucket: the least and the greatest by a hash that changes from round to round
            turn, before = turn + 1, left
            mixed = F.struct(F.xxhash64("node", F.lit(turn)).alias("h"), "node", "n", "root", "i")
            best = now.where(able).groupBy("key").agg(F.array(F.min(mixed), F.max(mixed)).alias("l")).select("key", F.explode("l").alias("l"))
            other = best.select("key", F.col("l.node").alias("node0"), F.col("l.n").alias("n0"), F.col("l.i").alias("i0"), F.col("l.root").alias("root0"))
            m = join_up(now.join(other, "key").where(size & (F.col("root") != F.col("root0"))), members)
            at = now if m is None else rooted(now)
            continue
        if dense and not dealt:
            met = now.groupBy("node").agg(F.first("root").alias("root"))
            at, dealt, before = written(rare_keys(met.join(texts, "node"), similarity), "buckets"), True, math.inf
            continue
        # all that are left, in slices by the smaller row, so that each has about as many pairs as may be compared at once
        slices = math.ceil(left / (PAIRS_DEALT * members))
        if not dealt:  # of a band's key, the keys of earlier bands
            keys = nodes.select("node", "keys")
            now = now.join(keys, "node").withColumn("prior", F.slice("keys", 1, F.array_position("keys", F.col("key")).cast("int") - 1)).drop("keys")
            now = written(now, "open") if slices > 1 else now
        for k in range(slices):
            # members of one root with members of another, by equi-joins: pairs within a root never come up
            small = now.where(able & (F.pmod(F.xxhash64("node"), F.lit(slices)) == k)).select("key", *[F.col(c).alias(f"{c}0") for c in ("root", "node", "n", "i", "prior")])
            two = small.select("key", "root0").distinct().join(now.select("key", "root").distinct(), "key").where("root <> root0")
            # where two share an earlier key they meet there: its bucket is open, too, and the bounds are wider
            meet = size & (F.struct("n0", "node0") < F.struct(F.col("n"), F.col("node"))) & ~F.arrays_overlap("prior", "prior0")
            m = join_up(small.join(two, ["key", "root0"]).join(now, ["key", "root"]).where(meet), members)
            if m is not None and k + 1 < slices:
                now = still_open(rooted(now))
        break
    named = nodes.select("node", "digest", "first").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = written(named, "named")
    least = named.groupBy("root").agg(F.min(F.struct("first", "digest")).alias("l")).select("root", F.col("l.first").alias("class_id"), F.col("l.digest").alias("class_digest"))
    return rows.select("doc_id", "digest"), named.join(least, "root").select("digest", "class_id", "class_digest")


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """docs(doc_id, text) as (doc_id, class_id), a row for each: class_id is the least doc_id of the class.

    A class holds rows that links join: equal texts (null and empty ones are equal), and texts whose multisets of five-word shingles have a weighted
    Jaccard similarity of at least `similarity`. Texts of fewer than five words have one shingle of all their words. Rows with a null
    doc_id have a null class_id and link nothing; rows that share a doc_id go by their texts. Other columns don't matter; an empty table gives no rows.

    Equal texts are one node. Each node is first compared with the least of the nodes that lead its band buckets; then every
    pair of nodes that share a bucket and that links don't join yet is compared, too, so no candidate is left out. While those would be many,
    rounds of two more leaders a bucket come first: copies join one component, so pairs within a large group never all come up. Once such a
    round leaves over a quarter of the pairs (texts around one common passage fill a bucket without being near copies), the nodes of such buckets
    are dealt anew by their rarest shingles (`rare_keys`, exact) and have such rounds again; the rest is compared in a fixed number of
    slices. Buckets in which the positional bound rejects all pairs are closed without a comparison.
    """
    rows, classes = _classes(docs.select("doc_id", "text").where("doc_id is not null"), similarity)
    known = rows.join(classes, "digest").select("doc_id", "class_id")
    return known.union(docs.where("doc_id is null").select("doc_id", F.lit(None).cast("long").alias("class_id")))


def op5_bag_min_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their classes."""
    return near_duplicates(table(spark, sf_dir, "documents"))


def keep_first(docs: DataFrame) -> DataFrame:
    """Of each class the row with the least doc_id, with all columns of docs whatever their names.

    Of rows that share that doc_id one with the class's text stays (of equal rows one); rows of another class stay or go by that class. Rows
    with a null doc_id stay.
    """
    _, classes = _classes(docs.select("doc_id", "text").where("doc_id is not null"), SIMILARITY)
    kept = classes.where(F.col("digest") == F.col("class_digest")).select(F.col("class_id").alias("doc_id"), "digest")
    full = docs.select("doc_id", _digest().alias("digest"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    stay = full.join(kept, ["doc_id", "digest"]).dropDuplicates(["doc_id", "digest"])
    return stay.unionByName(full.where("doc_id is null")).select("_row.*")

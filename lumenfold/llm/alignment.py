"""Alignment of two tokenizers by merge-path partitioning, and how often their tokens meet in the corpus.

Token ends of both tokenizers are byte offsets in ascending order. Binary searches along diagonals cut their merge into pieces of equal work
that don't depend on each other, however tokens are spread over documents; each piece finds the ends both sides have, and groups that
reach over pieces are stitched by the number of common ends before them. Documents are stored once, as their distinct id pairs, in
buckets of the part of the corpus they belong to. A part asks for its pairs' counts by A id, so that all pairs of an A id meet in one place,
and gets them back in the order it asked in; pairs of documents are never shuffled one by one.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.llm.common import clustered, table, written
from lumenfold.llm.packing import LONG_RUN, encoding, exact_tokenizer

#: Ends (of both sides together) that a piece of the merge has.
PIECE = 1 << 16
#: Bytes of text that are aligned together, and that a part of the corpus has about. A text is never split over them.
SLICE_BYTES, PART_BYTES = 2 << 20, 64 << 20
#: Chunks of text whose tokens a worker keeps, and how many tokens in all.
KEPT_CHUNKS, KEPT_TOKENS = 400_000, 4_000_000
#: Links of a group from which on its ids are made distinct before they are paired; links that are made at once.
WIDE_GROUP, BLOCK = 4096, 1 << 21

#: Both tokenizers part a text before a space that follows a sign other than white space (a last space stays with what it follows).
_CUT = re.compile(r"(?<=\S)(?= .)", re.DOTALL)
_RUNS = re.compile(rf"\s{{{LONG_RUN},}}|\S{{{LONG_RUN},}}")


@cache
def piece_model(model_path: str | None = None):
    """The sentencepiece model, the bytes of its pieces, and whether no piece goes on after a space that follows something else."""
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path or public_tokenizers.path("piece_bpe_32k.model"))
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    raw = [bytes([int(p[3:5], 16)]) if re.fullmatch(r"<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in pieces]
    return model, raw, not any(re.search("[^▁]▁", p) for p in pieces)


class _Chunks(dict):
    """Numbers of chunks; a chunk that is met for the first time is encoded by both tokenizers."""

    def __init__(self, ranks_path: str | None, json_path: str | None, model_path: str | None):
        super().__init__()
        self.fast, self.json_path = encoding(ranks_path), json_path
        self.model, self.b_bytes, self.cut = piece_model(model_path)
        self.a_bytes = [self.fast.decode_single_token_bytes(i) for i in range(self.fast.n_vocab)]
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.a, self.b, self.a_sizes, self.b_sizes, self.sound = [], [], [], [], []

    def __missing__(self, chunk: str) -> int:
        """A chunk begins with a space; the piece model adds it itself."""
        if len(chunk) >= LONG_RUN and _RUNS.search(chunk):
            a = exact_tokenizer(self.json_path).encode(chunk, add_special_tokens=False).ids
        else:
            a = self.fast.encode_ordinary(chunk)
        b = self.model.encode(chunk[1:], num_threads=1)
        raw = chunk.encode()
        self.sound.append(b"".join(map(self.a_bytes.__getitem__, a)) == raw and b"".join(map(self.b_bytes.__getitem__, b)) == raw)
        self.a += a
        self.b += b
        self.a_sizes.append(len(a))
        self.b_sizes.append(len(b))
        self[chunk] = place = len(self)
        return place

    def of(self, text: str) -> list[int]:
        return list(map(self.__getitem__, _CUT.split(f" {text}") if self.cut else [f" {text}"]))


def _gathered(flat: list[int], sizes: list[int], chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of chunks one after the other, and how many each has."""
    values, n = np.array(flat, "int64"), np.array(sizes, "int64")
    starts, n = (np.cumsum(n) - n)[chunks], n[chunks]
    return values[np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(n.sum())], n


def diagonals(a: np.ndarray, b: np.ndarray, piece: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the merge of two ascending arrays is cut: (places in a, places in b), their sums multiples of `piece`, and both ends.

    On each diagonal a binary search finds how many of its elements come from a; of equal elements that of a comes first.
    """
    total = len(a) + len(b)
    at = np.r_[np.arange(0, total, piece), total]
    low, high = np.maximum(0, at - len(b)), np.minimum(at, len(a))
    while (low < high).any():
        mid = (low + high) // 2
        open_ = low < high
        more = np.zeros(len(at), bool)
        more[open_] = a[mid[open_]] <= b[at[open_] - 1 - mid[open_]]
        low, high = np.where(open_ & more, mid + 1, low), np.where(open_ & ~more, mid, high)
    return low, at - low


def groups(a: np.ndarray, b: np.ndarray, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray, int]:
    """For token ends a and b, each ascending, the group of every token of a and of b, and the number of groups.

    Each piece gives the ends that both sides have in it. An end whose two tokens fall into neighbouring pieces is found where they meet, and a
    group that is open at a piece's end goes on in the next: its number is the number of common ends before.
    """
    i, j = diagonals(a, b, piece)
    of_a, of_b, before = np.empty(len(a), "int64"), np.empty(len(b), "int64"), 0
    for i0, i1, j0, j1 in zip(i[:-1].tolist(), i[1:].tolist(), j[:-1].tolist(), j[1:].tolist(), strict=True):
        left, right = a[i0:i1], b[j0:j1]
        place = np.searchsorted(right, left)
        common = left[(place < len(right)) & (right[np.minimum(place, len(right) - 1)] == left)] if len(right) else left[:0]
        if i0 and len(right) and right[0] == a[i0 - 1]:  # the end's other token is the last of the piece before
            common = np.r_[right[:1], common]
        of_a[i0:i1] = before + np.searchsorted(common, left)
        of_b[j0:j1] = before + np.searchsorted(common, right)
        before += len(common)
    return of_a, of_b, before


class Aligned:
    """Some texts aligned: ids and groups of all their tokens, `docs` the text of each group, and sizes by text. A text that is null or empty, or
    whose tokens' bytes aren't those of a space and the text, has no tokens."""

    def __init__(self, texts: list[str | None], chunks: _Chunks):
        numbers = [chunks.of(t) if t else [] for t in texts]
        sound = chunks.sound
        numbers = [n if all(map(sound.__getitem__, n)) else [] for n in numbers]
        flat = np.array([x for n in numbers for x in n], "int64")
        text = np.repeat(np.arange(len(texts)), [len(n) for n in numbers])
        self.a, n_a = _gathered(chunks.a, chunks.a_sizes, flat)
        self.b, n_b = _gathered(chunks.b, chunks.b_sizes, flat)
        a_sizes, b_sizes = (np.array(list(map(len, raw)), "int64") for raw in (chunks.a_bytes, chunks.b_bytes))
        self.of_a, self.of_b, n = groups(np.cumsum(a_sizes[self.a]), np.cumsum(b_sizes[self.b]))
        self.n_a, self.n_b = (np.bincount(text, x, len(texts)).astype("int64") for x in (n_a, n_b))
        self.a_of, self.b_of = np.bincount(self.of_a, minlength=n), np.bincount(self.of_b, minlength=n)  # tokens of each group
        self.docs = np.repeat(np.arange(len(texts)), self.n_a)[np.cumsum(self.a_of) - 1]
        self.n_groups = np.bincount(self.docs, minlength=len(texts))
        links = np.cumsum(np.r_[0, self.a_of * self.b_of])
        ends = np.cumsum(self.n_groups)
        self.n_links = links[ends] - links[ends - self.n_groups]

    def pairs(self, n_b_ids: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, pair, times), sorted: how often each text links an A id and a B id; pair = A id * n_b_ids + B id."""
        a_start, b_start, links = np.cumsum(self.a_of) - self.a_of, np.cumsum(self.b_of) - self.b_of, self.a_of * self.b_of
        found: list[tuple[np.ndarray, np.ndarray]] = []

        def add(keys: np.ndarray, times: np.ndarray) -> None:
            order = np.argsort(keys, kind="stable")
            keys, total = keys[order], np.r_[0, np.cumsum(times[order])]
            new = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, "int64")
            found.append((keys[new], total[np.r_[new[1:], len(keys)]] - total[new] if len(keys) else total[:0]))

        plain = np.flatnonzero(links <= WIDE_GROUP)
        cuts = np.searchsorted(np.cumsum(links[plain]), np.arange(BLOCK, int(links[plain].sum()) + BLOCK, BLOCK))
        for g in np.split(plain, cuts):
            if len(g):
                n = links[g]
                r = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                g = np.repeat(g, n)
                x, y = np.divmod(r, self.b_of[g])
                keys = (self.docs[g] << 32) | (self.a[a_start[g] + x] * n_b_ids + self.b[b_start[g] + y])
                add(keys, np.ones(len(keys), "int64"))
        for g in np.flatnonzero(links > WIDE_GROUP).tolist():
            x, m = np.unique(self.a[a_start[g] : a_start[g] + self.a_of[g]], return_counts=True)
            y, n = np.unique(self.b[b_start[g] : b_start[g] + self.b_of[g]], return_counts=True)
            add(((self.docs[g] << 32) | (x[:, None] * n_b_ids + y[None])).ravel(), (m[:, None] * n[None]).ravel())
        if len(found) != 1:
            add(*(np.concatenate([f[i] for f in found]) if found else np.empty(0, "int64") for i in (0, 1)))
        keys, times = found[-1]
        return keys >> 32, keys & 0xFFFFFFFF, times

    def written_out(self, names: tuple[list[bytes], list[bytes]]) -> list[bytes]:
        """Each text's groups as `a1,a2|b1;a3|b2,b3`. names: what `spelled` gives."""
        last_a = np.r_[self.of_a[1:] != self.of_a[:-1], True] if len(self.a) else np.zeros(0, bool)
        last_b = np.r_[self.of_b[1:] != self.of_b[:-1], True] if len(self.b) else np.zeros(0, bool)
        kind = last_b.astype("int64")
        ends = np.cumsum(self.n_b)[self.n_b > 0] - 1
        kind[ends] = 2
        code = np.empty(len(self.a) + len(self.b), "int64")
        code[np.arange(len(self.a)) + (np.cumsum(self.b_of) - self.b_of)[self.of_a]] = self.a * 2 + last_a
        code[np.arange(len(self.b)) + np.cumsum(self.a_of)[self.of_b]] = len(names[0]) + self.b * 3 + kind
        both, out, at = names[0] + names[1], [], 0
        for n in (self.n_a + self.n_b).tolist():
            out.append(b"".join(map(both.__getitem__, code[at : at + n].tolist())))
            at += n
        return out


def spelled(n_a_ids: int, n_b_ids: int) -> tuple[list[bytes], list[bytes]]:
    """Ids as decimals with what may follow them: of A , or | of B , or ; or nothing."""
    return [b"%d%s" % (i, s) for i in range(n_a_ids) for s in (b",", b"|")], [b"%d%s" % (i, s) for i in range(n_b_ids) for s in (b",", b";", b"")]


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    sizes = np.array([len(t.as_buffer()) if t.is_valid else 0 for t in batch["text"]] if batch.num_rows else [], "int64")
    cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // SLICE_BYTES, prepend=0))
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
        if b > a:
            yield batch.slice(a, b - a)


def alignments(docs: DataFrame, ranks_path: str | None = None, json_path: str | None = None, model_path: str | None = None) -> DataFrame:
    """docs(doc_id long, text) as (doc_id, n_a, n_b, n_groups, n_links, groups string), groups as `a1,a2|b1;a3|b2,b3`; a row for each row.

    A null or empty text, and one whose bytes the tokens don't give back, has no tokens: zeros and ''.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = _Chunks(ranks_path, json_path, model_path)
        names = spelled(len(chunks.a_bytes), len(chunks.b_bytes))
        for batch in batches:
            for part in _slices(batch):
                x = Aligned(part["text"].to_pylist(), chunks)
                counts = [pa.array(n, "int64") for n in (x.n_a, x.n_b, x.n_groups, x.n_links)]
                yield pa.RecordBatch.from_arrays([part["doc_id"], *counts, pa.array([g.decode() for g in x.written_out(names)], pa.string())], ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups"])
                if len(chunks) > KEPT_CHUNKS or len(chunks.a) > KEPT_TOKENS:
                    chunks.forget()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string")


def linked(docs: DataFrame, ranks_path: str | None = None, json_path: str | None = None, model_path: str | None = None) -> DataFrame:
    """docs(doc_id long, text) as (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum long, groups_sha256 string), a row for each row.

    Links are the pairs of an A and a B token of one group. An id pair counts the rows of docs that hold it linked; n_best are the links
    whose count is the highest of their A id (ties too), count_sum adds the counts of all links. Rows that repeat count each. An empty table
    gives no rows; other columns don't matter.
    """
    spark = docs.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n_ids = len(piece_model(model_path)[1])
    counted = ["n_a", "n_b", "n_groups", "n_links"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = _Chunks(ranks_path, json_path, model_path)
        names = spelled(len(chunks.a_bytes), len(chunks.b_bytes))
        done = 0
        for batch in batches:
            for part in _slices(batch):
                x = Aligned(part["text"].to_pylist(), chunks)
                text, pair, times = x.pairs(n_ids)
                offsets = pa.array(np.searchsorted(text, np.arange(part.num_rows + 1)), "int32")
                digests = [hashlib.sha256(g).hexdigest() if g else "" for g in x.written_out(names)]
                home = (part["_task"].to_numpy().astype("int64") << 20) + done // PART_BYTES
                lists = [pa.ListArray.from_arrays(offsets, pa.array(pair, "int32")), pa.ListArray.from_arrays(offsets, pa.array(times, "int64"))]
                yield pa.RecordBatch.from_arrays([pa.array(home), part["doc_id"], *(pa.array(getattr(x, c), "int64") for c in counted), pa.array(digests, pa.string()), *lists], ["part", "doc_id", *counted, "groups_sha256", "pairs", "times"])
                done += part["text"].nbytes
                if len(chunks) > KEPT_CHUNKS or len(chunks.a) > KEPT_TOKENS:
                    chunks.forget()

    rows = docs.select("doc_id", "text", F.spark_partition_id().alias("_task")).mapInArrow(run, "part long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<int>, times array<long>")
    stored = clustered(rows, "part", buckets, "aligned")
    places = max(256, 4 * buckets)  # that A ids are dealt to

    def flat(rows: pa.Table, column: str) -> np.ndarray:
        return rows[column].combine_chunks().flatten().to_numpy().astype("int64")

    def order(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of each of these distinct pairs, and their order by place, then pair: in it they are asked for and answered."""
        place = (pairs // n_ids * 40503 & 0xFFFF) % places
        return place, np.lexsort((pairs, place))

    def asked(rows: pa.Table) -> pa.Table:
        pairs, n = np.unique(flat(rows, "pairs"), return_counts=True)
        place, by = order(pairs)
        place, pairs, n = place[by], pairs[by], n[by]
        cuts = np.flatnonzero(np.r_[True, place[1:] != place[:-1], True]) if len(place) else np.zeros(1, "int64")
        each = list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))
        cut = lambda x: pa.array([x[a:b].astype("<u4").tobytes() for a, b in each], pa.binary())
        return pa.table({"place": pa.array(place[cuts[:-1]], "int32"), "part": pa.array(np.full(len(each), rows["part"][0].as_py()), "int64"), "pairs": cut(pairs), "n": cut(n)})

    def answered(rows: pa.Table) -> pa.Table:
        pairs, n = ([np.frombuffer(x.as_buffer(), "<u4") for x in rows[c]] for c in ("pairs", "n"))
        known, which = np.unique(np.concatenate(pairs), return_inverse=True)
        total = np.zeros(len(known), "int64")
        np.add.at(total, which, np.concatenate(n))
        a_id = known // n_ids
        first = np.flatnonzero(np.r_[True, a_id[1:] != a_id[:-1]])
        best = total == np.repeat(np.maximum.reduceat(total, first), np.diff(np.r_[first, len(known)]))
        signed = np.where(best, -total, total)  # below 0: the highest of its A id
        cuts = np.cumsum([len(p) for p in pairs])[:-1]
        return pa.table({"part": rows["part"], "place": rows["place"], "counts": pa.array([x.astype("<i8").tobytes() for x in np.split(signed[which], cuts)], pa.binary())})

    def finished(rows: pa.Table, answers: pa.Table) -> pa.Table:
        pairs, which = np.unique(flat(rows, "pairs"), return_inverse=True)
        _, by = order(pairs)
        answers = answers.sort_by("place")
        signed = np.empty(len(pairs), "int64")
        signed[by] = np.concatenate([np.frombuffer(x.as_buffer(), "<i8") for x in answers["counts"]] or [np.empty(0, "int64")])
        of_link, times = signed[which], flat(rows, "times")
        ends = np.cumsum(rows["pairs"].combine_chunks().value_lengths().to_numpy())
        add = lambda x: np.diff(np.r_[0, np.cumsum(x)][np.r_[0, ends]])
        sums = {"n_best": pa.array(add(np.where(of_link < 0, times, 0)), "int64"), "count_sum": pa.array(add(np.abs(of_link) * times), "int64")}
        return pa.table({"doc_id": rows["doc_id"], **{c: rows[c] for c in counted}, **sums, "groups_sha256": rows["groups_sha256"]})

    requests = stored.select("part", "pairs").groupBy("part").applyInArrow(lambda rows: asked(rows), "place int, part long, pairs binary, n binary")
    answers = written(requests.groupBy("place").applyInArrow(lambda rows: answered(rows), "part long, place int, counts binary"), "answers")
    both = stored.groupBy("part").cogroup(answers.groupBy("part"))
    return both.applyInArrow(lambda rows, found: finished(rows, found), "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def op12_aligned_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: byte_bpe_50k.json (A) against piece_bpe_32k.model (B)."""
    return linked(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text"))

"""Toxicity with noisy-channel deobfuscation.

A character trigram model of all documents and a channel model of leetspeak, spacing and repetition restore what a
written token was meant to be: a Viterbi search over the lattice of readings. Restored words and their beginnings are the features of a sparse
logistic model learned from labels; its weights score every whole text. When texts are scored, only what could be read as a feature with a weight is
searched: signs that can stand for each other are folded together, and a token or run whose folded form holds no such feature has no reading with one.
"""

from __future__ import annotations

import itertools
import math
import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenfold.llm.common import crc_of_id, table, training_sample, written

#: Labelled documents that a model is fitted on, at most.
MAX_TRAINING_ROWS = 8_000
THRESHOLD = 0.7
#: Characters of the language model; whatever else there is counts as OTHER. Index 0 is the edge of a word.
LETTERS = "abcdefghijklmnopqrstuvwxyzäöüßáéíóúñèêàçâîôûù"
OTHER = len(LETTERS) + 1
SIZE = OTHER + 1
#: What leetspeak writes for letters.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "li", "+": "t", "€": "e", "(": "c"}
#: Characters that spacing puts between letters.
GAPS = " .-_*~·/\\,'’"
#: Letters of other scripts that look like Latin ones.
ALIKE = dict(zip("асеһіјкмнорѕтухвԁɡαεικνορτυχ", "acehijkmhopstyxbdgaeiknoptux", strict=True))
#: Costs of the channel, as negative natural logarithms: a letter as it is, for another sign, written once more, a gap.
AS_IS, LEET_COST, AGAIN_COST, GAP_COST, KEPT_SIGN = 0.05, 1.5, 1.0, 0.7, 9.0
#: Cost of reading a star as some letter.
STAR_COST = 2.5
#: Tokens whose features each Python worker keeps, and how long they are at most.
KEPT_TOKENS, KEPT_LENGTH = 200_000, 64

_SIGNS = re.escape("".join(LEET) + ".-_*~·")
#: What is searched for a disguise: while no features are known, if it could be read as one, and if it could be read as a whole word.
_FIRST, _DISGUISED, _WIDER = re.compile(rf"[{_SIGNS}]|(.)\1\1"), re.compile(rf"[{_SIGNS}]|(.)\1"), re.compile(r"[/\\,'’]|[^\x00-\x7F]")
_DECOR = re.compile(r"([^\w\s])\1{2,}")
_STAR = re.compile(r"[^\W\d_]\*{1,2}[^\W\d_]")
_AGAIN = re.compile(r"(.)\1+")
_ENDS = ".,;:!?\"'()[]{}…«»“”"
#: Letters, at most, of the parts that a spaced word is put together from.
SHORT = 3


def plain_letter(sign: str) -> str:
    """The letter without its accents that a sign is, or looks like; the sign itself if it is none."""
    return ALIKE.get(sign) or unicodedata.normalize("NFD", sign)[0]


def _folding() -> dict[int, str | None]:
    """A sign for all signs that can be read as each other; None for gaps."""
    table: dict[int, str | None] = {ord(c): None for c in GAPS}
    table |= {ord(c): letters[0] for c, letters in LEET.items()}
    table |= {i: plain_letter(chr(i)) for i in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]} | {ord(c): x for c, x in ALIKE.items()}
    one = lambda x: "i" if x in ("l", "|", "!", "1") else x  # noqa: E731  read as i and as l
    return {k: one(v) for k, v in table.items()} | {ord(c): "i" for c in "l|!1"}


_FOLDED = _folding()


def folded(text: str) -> str:
    """Texts of which one can be read as the other have the same form (but for stars): signs folded, gaps dropped, repeated signs once."""
    return _AGAIN.sub(r"\1", text.lower().translate(_FOLDED))


def trigram_counts(docs: DataFrame) -> DataFrame:
    """(gram int, n long) of the character trigrams within words of all texts: at most SIZE ** 3 rows. Each task adds up its own first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.full(0x110000, OTHER, "uint8")
        for i, c in enumerate(LETTERS):
            place[ord(c)] = place[ord(c.upper()) if len(c.upper()) == 1 else ord(c)] = i + 1
        for c in " \t\n\r\x0b\x0c.,;:!?\"'()":
            place[ord(c)] = 0
        total = np.zeros(SIZE**3, "int64")
        for batch in batches:
            for text in batch["text"]:
                raw = np.frombuffer(f"  {text.as_py() or ''} ".encode("utf-32-le", "surrogatepass"), "uint32")
                x = place[raw].astype("int32")
                if len(x) > 3:
                    gram = (x[:-2] * SIZE + x[1:-1]) * SIZE + x[2:]
                    total += np.bincount(gram, minlength=SIZE**3)
        grams = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(grams.astype("int32")), pa.array(total[grams])], ["gram", "n"])

    return docs.select("text").mapInArrow(count, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def language_model(docs: DataFrame) -> np.ndarray:
    """cost[a, b, c] = -log P(c | a, b), with add-half smoothing, from all documents."""
    counts = np.full(SIZE**3, 0.5)
    for r in trigram_counts(docs).collect():  # at most SIZE ** 3 rows
        counts[r["gram"]] += r["n"]
    counts = counts.reshape(SIZE, SIZE, SIZE)
    return (-np.log(counts / counts.sum(2, keepdims=True))).astype("float32")


class Channel:
    """Restores tokens under a language model."""

    def __init__(self, costs: np.ndarray):
        self.costs = costs.tolist()
        self.place = {c: i + 1 for i, c in enumerate(LETTERS)}

    def restore(self, token: str, breaks: bool = False, stars: bool = False) -> str:
        """The likeliest reading of a token, in lower case: each sign is read as a letter, as the last letter once more, or as a gap.

        A gap, with `breaks` every sign, may also end a word; words are parted by a space. With `stars` a star may be any letter. The search keeps the best way to each pair of
        last letters, so it takes time in proportion to the token.
        """
        at, costs = self.place.get, self.costs
        # a way is its cost and its signs, as links from the last one back
        states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        for sign in token.lower():
            new: dict[tuple[int, int], tuple[float, tuple | None]] = {}

            def offer(key: tuple[int, int], cost: float, way: tuple | None, new=new) -> None:
                if key not in new or cost < new[key][0]:
                    new[key] = (cost, way)

            gap = sign in GAPS
            readings = [(sign, AS_IS if sign.isalpha() else KEPT_SIGN)] + [(c, LEET_COST) for c in LEET.get(sign, "")]
            if stars and sign == "*":
                readings += [(c, STAR_COST) for c in LETTERS[:26]]
            elif sign > "\x7f" and (base := plain_letter(sign)) != sign:
                readings.append((base, LEET_COST))
            for (a, b), (cost, way) in states.items():
                for letter, price in readings:
                    c = at(letter, OTHER)
                    offer((b, c), cost + price + costs[a][b][c], (way, letter))
                    if way and way[1] == letter:
                        offer((a, b), cost + price + AGAIN_COST, way)
                if gap:
                    offer((a, b), cost + GAP_COST, way)
            if breaks or gap:
                for (a, b), (cost, way) in list(new.items()):
                    if b:
                        offer((b, 0), cost + costs[a][b][0], (way, " "))
            states = new
        ends = [(cost + (costs[a][b][0] if b else 0.0), way) for (a, b), (cost, way) in states.items()]
        way, signs = min(ends, key=lambda e: e[0])[1], []
        while way:
            way, sign = way
            signs.append(sign)
        return "".join(reversed(signs)).strip()


class Reader:
    """Features of whole texts, of all or of those with a weight; those of frequent tokens are kept.

    Features are words as written and as restored, and of each the first 4 to 8 letters. A word may be spread over a run of parts of at most SHORT
    letters, whatever white space or punctuation is between them: letters that stand alone are put together, other parts if what they spell is
    read as a whole word with a weight.
    """

    def __init__(self, costs: np.ndarray, weights: dict[str, float] | None = None):
        self.channel, self.weights = Channel(costs), weights
        self.kept: dict[str, tuple[str, ...]] = {}
        either = lambda forms: re.compile("|".join(map(re.escape, sorted(forms))) if forms else "(?!)")
        self.possible = either({folded(f[1:]) for f in weights or {}})
        self.possible_words = either({folded(f[1:]) for f in weights or {} if f[0] == "="})
        self.heads = {f[1:5] for f in weights or {}}
        self.words = sorted({f[1:] for f in weights or {} if f[0] == "=" and len(f) > 4})

    def restored(self, token: str) -> set[str]:
        """The words of a token that may be disguised, as restored; those that it takes other scripts, accents or punctuation to read, if they are known."""
        if self.weights is None:
            return set(self.channel.restore(token).split()) if _FIRST.search(token) else set()
        if token.count("*") < 3 and _STAR.search(token):
            return set(self.channel.restore(token, stars=True).split())
        if _DISGUISED.search(token) and self.possible.search(folded(token)):
            return set(self.channel.restore(token).split())
        if _WIDER.search(token) and self.possible_words.search(folded(token)):
            return {w for w in self.channel.restore(token).split() if f"={w}" in self.weights}
        return set()

    def words_of(self, token: str) -> set[str]:
        """The word as written and, where it may be disguised, the words as restored."""
        plain = token.isalpha()
        bare = token if plain else _DECOR.sub("", token).strip(_ENDS)
        words = {bare} if bare else set()
        for form in {bare} if plain else {bare, token.lstrip(_ENDS.replace("!", "")).rstrip(_ENDS)}:  # signs that were taken for decoration may be letters
            words |= self.restored(form)
        return words

    def of(self, token: str) -> tuple[str, ...]:
        found = self.kept.get(token)
        if found is None:
            words = self.words_of(token)
            if self.weights is not None:
                words = [w for w in words if w[:4] in self.heads]
            found = tuple({f for w in words for f in (f"={w}", *(f"^{w[:n]}" for n in range(4, 9) if len(w) >= n))}) if words else ()
            if found and self.weights is not None:
                found = tuple(f for f in found if f in self.weights)
            if len(self.kept) < KEPT_TOKENS and len(token) <= KEPT_LENGTH:
                self.kept[token] = found
        return found

    def spread(self, tokens: list[str]) -> set[str]:
        """Words that are spread over runs of short parts."""
        runs, run = [], []
        for token in tokens:
            if (n := len(token)) <= SHORT + 3:
                if token.isalpha() or (n == 1 and token in LEET):
                    part = token
                else:
                    part = token if n == 1 and token.isalnum() else token.strip(_ENDS + GAPS)
                    if not part:
                        continue  # punctuation between parts
                    n = len(part)
                if n <= SHORT:
                    run.append(part)
                    continue
            if len(run) > 1:
                runs.append(run)
            run = []
        if len(run) > 1:
            runs.append(run)
        found = set()
        for run in runs:
            for single, parts in itertools.groupby(run, key=lambda p: len(p) == 1):
                letters = "".join(parts) if single else ""
                if len(letters) > 2:
                    whole = self.channel.restore(letters)
                    found.update({letters, whole, *self.channel.restore(letters, breaks=True).split()}, (w for w in self.words if w in whole))
        if self.weights is not None and runs:
            spelled = [folded("".join(r)) for r in runs]
            text, ends = "\n".join(spelled), list(itertools.accumulate(len(x) + 1 for x in spelled))
            for at in sorted({bisect_right(ends, m.start()) for m in self.possible_words.finditer(text)}):
                found.update(w for w in self.channel.restore(" ".join(runs[at])).split() if f"={w}" in self.weights)
        return found

    def tokens(self, text: str) -> set[str]:
        """The distinct tokens of a text, and the words that are spread over several."""
        tokens = text.lower().split()
        return {*tokens, *self.spread(tokens)}

    def features(self, text: str) -> tuple[list[str], float]:
        """The features of all distinct tokens, and the square root of their number: what features weigh is divided by it, so that a
        few chance words in a long text count for little, and a few in a short text for much."""
        tokens = self.tokens(text)
        return list(itertools.chain.from_iterable(map(self.of, tokens))), math.sqrt(max(1, len(tokens)))


def featured(rows: DataFrame, costs: np.ndarray) -> DataFrame:
    """rows(label, text) as (label, root double, features array<string>)."""
    sent = rows.sparkSession.sparkContext.broadcast(costs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(sent.value)
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                found = [reader.features(t.as_py() or "") for t in part["text"]]
                yield pa.RecordBatch.from_arrays([part["label"], pa.array([r for _, r in found], "float64"), pa.array([sorted(f) for f, _ in found], pa.list_(pa.string()))], ["label", "root", "features"])

    return rows.select("label", "text").mapInArrow(run, "label double, root double, features array<string>")


def fit(train: DataFrame, least: int = 4, lift: float = 4.0, strength: float = 2e-5, share: float = 0.15, sure_lift: float = 60.0) -> tuple[dict[str, float], dict[str, float], float]:
    """Weights of features, what sure ones say by themselves, and the intercept, from train(label, root, features).

    Candidates occur in at least `least` texts of label 1 and are `lift` times as frequent there (half a text is added to those of label 0); a lasso
    logistic regression over them keeps few. Sure ones are in at least `share` of the texts of label 1 and `sure_lift` times as frequent there; each says
    what share of the texts that have it (and one more) has label 1. With labels of one kind or none there are no weights and the intercept is the share of 1.
    """
    n, ones = train.agg(F.count("label"), F.sum("label")).first()
    if not n or ones in (0, n):
        known = min(max((ones or 0) / n if n else 0.0, 1e-3), 1 - 1e-3)
        return {}, {}, math.log(known / (1 - known))
    by = train.select("label", F.explode(F.array_distinct("features")).alias("f")).groupBy("f").agg(F.sum("label").alias("bad"), F.sum(1 - F.col("label")).alias("good"))
    ratio = (F.col("bad") / ones) / ((F.col("good") + 0.5) / (n - ones))
    is_sure = (F.col("bad") >= share * ones) & (ratio >= sure_lift)
    known = F.when(is_sure, F.col("bad") / (F.col("bad") + F.col("good") + 1))
    found = by.where((F.col("bad") >= least) & (ratio >= lift)).select("f", known.alias("known")).orderBy("f").collect()  # bounded by the sample
    names, sure = [r["f"] for r in found], {r["f"]: r["known"] for r in found if r["known"]}
    if not names:
        return {}, {}, math.log(ones / (n - ones))
    place = train.sparkSession.sparkContext.broadcast({f: i for i, f in enumerate(names)})

    @F.udf(VectorUDT())
    def vector(features: list[str], root: float) -> SparseVector:  # of the bounded sample only
        at = place.value
        counts = Counter(at[f] for f in features if f in at)
        return SparseVector(len(at), sorted((i, n / root) for i, n in counts.items()))

    rows = written(train.select("label", vector("features", "root").alias("x")), "vectors")
    model = LogisticRegression(featuresCol="x", elasticNetParam=1.0, regParam=strength, maxIter=80, standardization=False).fit(rows)
    return {f: float(w) for f, w in zip(names, model.coefficients.toArray(), strict=True) if w}, sure, float(model.intercept)


def score_texts(rows: DataFrame, costs: np.ndarray, weights: dict[str, float], sure: dict[str, float], intercept: float) -> DataFrame:
    """rows(doc_id, text, ...) with score double: the logistic of the intercept and the weights of the features the text has, or what a sure one says
    if that is more."""
    sent = rows.sparkSession.sparkContext.broadcast((costs, weights, sure, intercept))
    schema = T.StructType([*rows.schema.fields, T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        costs, weights, sure, base = sent.value
        reader = Reader(costs, {f: 0.0 for f in sure} | weights)
        for batch in batches:
            scores = []
            for text in batch["text"]:
                found, root = reader.features(text.as_py() or "")
                z = base + math.fsum(weights.get(f, 0.0) for f in found) / root
                scores.append(max(1 / (1 + math.exp(-max(-60.0, min(60.0, z)))), *(sure[f] for f in found if f in sure), 0.0))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, "float64")], [*batch.schema.names, "score"])

    return rows.mapInArrow(run, schema)


def scored(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAINING_ROWS) -> DataFrame:
    """docs with score double, of the whole text; learns from labels(doc_id, toxic) outside the held-out fold (crc32 of the id mod 3 is 1).

    A null or empty text has no features and scores as the intercept says; rows that repeat are scored each; an empty table gives no rows. A
    column of docs named score is replaced. Without labels every score is low.
    """
    docs = docs.drop("score")
    costs = language_model(docs)
    sample = training_sample(labels, "toxic", 3, 1, max_rows)
    train = written(featured(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id"), costs), "features")  # at most max_rows labels
    return score_texts(docs, costs, *fit(train))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that score under THRESHOLD, with all their columns whatever their names."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    return scored(docs.select("doc_id", "text", row), labels).where(F.col("score") < THRESHOLD).select("_row.*")


def op10_deobfuscated_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, scored from labels of two thirds of the labelled ones."""
    found = scored(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", (crc_of_id("doc_id") % 3 == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))

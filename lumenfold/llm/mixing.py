"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions of documents."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.llm.common import WORD, numbered, table, written

#: Most rows that one group of the sampling step holds on average.
GROUP_ROWS = 8192


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_fill(sources: DataFrame, max_epochs: int = 3) -> DataFrame:
    """sources(source_size long, weight, ...) with target double: all sizes dealt out by weight, none above max_epochs times its size.

    Each round one distributed sum gives the level (what is left, by unit of weight); sources above their cap at that level
    are clamped, and their excess raises the level. Ends when none is above. A source without words has target 0.
    """
    cap = F.col("source_size") * max_epochs
    level = 0.0
    while True:
        full = (F.col("weight") * level > cap) | (F.col("source_size") == 0)
        total, used, weight = sources.agg(F.sum("source_size"), F.sum(F.when(full, cap)), F.sum(F.when(~full, F.col("weight")))).first()
        if not weight:
            break
        new = ((total or 0) - (used or 0)) / weight
        if new <= level:
            break
        level = new
    return sources.withColumn("target", F.least(cap.cast("double"), F.col("weight") * F.lit(float(level))))


def _choose(group: pd.DataFrame) -> pd.DataFrame:
    """How many of the n equal documents of each row get one repetition more: from the largest on, a document of size s is taken if what is owed so
    far and its own share reach u * s, u its seeded uniform number. No more is taken than documents that follow can make up for; where they can't
    take what is left over, the nearest number is."""
    group = group.sort_values(["size", "u", "doc_id", "digest"], ascending=[False, True, True, True], kind="stable")
    s, n, f, u = (group[c].to_numpy("float64") for c in ("size", "n", "fraction", "u"))
    share, room = f * s * n, np.where(f > 0, s * n, 0.0)
    later_share = share[::-1].cumsum()[::-1] - share
    later_room = room[::-1].cumsum()[::-1] - room - later_share  # what later ones can take over their own share
    owed, more = 0.0, np.zeros(len(group), "int64")
    for i, (size, count, frac, draw, own, less, most) in enumerate(zip(s.tolist(), n.tolist(), f.tolist(), u.tolist(), share.tolist(), later_share.tolist(), later_room.tolist(), strict=True)):
        if not frac:
            continue
        if not size:
            more[i] = math.floor(frac * count + draw)
            continue
        owed += own
        k = min(count, max(0.0, math.floor(owed / size - draw) + 1))
        if k * size - owed > less:
            k = min(count, max(0.0, math.floor(owed / size)))
        if owed - k * size > most:
            k = min(count, max(0.0, math.floor(owed / size + 0.5)))
        owed -= k * size
        more[i] = int(k)
    return group.assign(more=more)[["source", "doc_id", "size", "digest", "n", "source_size", "target", "whole", "more"]]


#: Rows that are equal in these are equal for the mix.
KEY = ["source", "doc_id", "size", "digest"]


def _joined(rows: DataFrame, other: DataFrame) -> DataFrame:
    """Rows with what other has for their key, nulls equal."""
    other = other.withColumnsRenamed({c: f"_{c}" for c in KEY})
    return rows.join(other, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in KEY]).drop(*[f"_{c}" for c in KEY])


def repeated(rows: DataFrame, weights: tuple[float, ...] = (1, 2, 3), max_epochs: int = 3, seed: int = 11) -> DataFrame:
    """rows(source, doc_id, size, digest, ...) with source_size long, target double, repeats long.

    Equal keys are counted first and chosen for together, so that a key with a large share of the rows is one row of the choice. If some of its rows are
    repeated once more than others, these rows are numbered by range, and the first ones of each key get it.
    """
    keys = written(rows.groupBy(*KEY).agg(F.count("*").alias("n")), "keys")
    sums = keys.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.count("*").alias("keys"))
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("at") % len(weights) + 1).cast("int"))
    sources = written(numbered(sums.withColumn("last", F.col("source").isNull()), ["last", "source"], "at").withColumn("weight", turn), "sources")
    filled = water_fill(sources, max_epochs)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    filled = filled.withColumn("ratio", F.least(ratio, F.lit(float(max_epochs)))).select(F.col("source").alias("_source"), "source_size", "target", "keys", F.floor("ratio").alias("whole"), (F.col("ratio") - F.floor("ratio")).alias("fraction"))
    if filled.count() <= 10_000:  # else a shuffled join
        filled = F.broadcast(filled)
    uniform = F.shiftrightunsigned(F.xxhash64("doc_id", "size", "digest", F.lit(seed)), 11) / F.lit(float(1 << 53))
    part = F.pmod(F.xxhash64("doc_id", "size", "digest", F.lit(seed + 1)), F.ceil(F.col("keys") / GROUP_ROWS))
    dealt = keys.join(filled, F.col("source").eqNullSafe(F.col("_source"))).select(*KEY, "n", "source_size", "target", "whole", "fraction", uniform.alias("u"), part.alias("_part"), F.col("source").alias("_source"))
    schema = f"source string, doc_id long, size long, digest {rows.schema['digest'].dataType.simpleString()}, n long, source_size long, target double, whole long, more long"
    chosen = written(dealt.groupBy("_source", "_part").applyInPandas(lambda g: _choose(g), schema), "chosen")
    some = chosen.where("0 < more AND more < n")
    out = _joined(rows, chosen.where("more = 0 OR more = n")).withColumn("repeats", F.col("whole") + (F.col("more") > 0).cast("long"))
    kept = [*rows.columns, "source_size", "target", "repeats"]
    if some.isEmpty():
        return out.select(*kept)
    placed = numbered(_joined(rows, some), KEY, "_no")
    first = placed.groupBy(*KEY).agg(F.min("_no").alias("_first"))
    rest = _joined(placed, first).withColumn("repeats", F.col("whole") + (F.col("_no") - F.col("_first") < F.col("more")).cast("long"))
    return out.select(*kept).unionByName(rest.select(*kept))


def mix(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), max_epochs: int = 3, seed: int = 11) -> DataFrame:
    """docs(doc_id, source, size long) as (doc_id, size, source_size, target, repeats long), a row for each row.

    Sources by code point (null last) get the weights in turn. With ratio target / source_size, every document is repeated
    floor(ratio) times, and once more for a seeded choice that makes up the fraction. Ratios are at most max_epochs, so
    no document exceeds them. The choice depends on sources, ids and sizes only, not on the layout of the table; of rows equal in them some may be
    repeated once more than others. Documents without words get what their source gets, of 0 words. An empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", F.coalesce("size", F.lit(0)).cast("long").alias("size"), F.lit(0).cast("long").alias("digest"))
    found = repeated(written(rows, "sizes"), weights, max_epochs, seed)
    return found.select("doc_id", "size", "source_size", "target", "repeats")


def op9_mixed_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, sizes in words, mixed to weights 1, 2, 3 in turn with at most 3 epochs."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", word_count("text").alias("size"))
    return mix(docs).select("doc_id", "size", "source_size", "target", (F.col("repeats") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """docs with each row as often as the mix takes it, with all columns whatever their names. Rows count as equal if source, id and text are."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    digest = F.coalesce(F.xxhash64("text"), F.lit(0))
    rows = repeated(docs.select("source", F.col("doc_id").cast("long").alias("doc_id"), word_count("text").alias("size"), digest.alias("digest"), row))
    return rows.where("repeats > 0").select("_row", F.explode(F.sequence(F.lit(1).cast("long"), "repeats"))).select("_row.*")

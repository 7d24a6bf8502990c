"""Statistics of whole texts as Spark columns (no Python on the executors)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.common import WORD

#: What lies between words.
SPACE = r"[\x20\x09-\x0D]+"
#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
#: The ratios that models see, none of which grows with a text's length.
RATIOS = ["mean_word", "symbol_rate", "dup_line_rate", "repeat_rate", "distinct_rate", "letter_rate", "upper_rate", "digit_rate", "stop_rate", "line_words"]


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (all long) and the RATIOS (double), for any text, also null
    (as an empty one: counts 0, ratios 0). Columns of docs with such names are replaced."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *RATIOS]
    keep = [c for c in docs.columns if c not in names]
    t = F.coalesce(F.col(text), F.lit(""))
    bare = F.btrim(t, F.lit(" \t\n\x0b\f\r"))
    words = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE))
    # what is neither a-z nor white space is little, and holds all that is counted sign by sign
    first = docs.select(*keep, t.alias("_t"), words.alias("_w"), F.regexp_replace(t, r"[a-z\x20\x09-\x0D]+", "").alias("_few"))
    lines = F.filter(F.split("_t", "\n"), lambda x: x.rlike(WORD))
    few = lambda signs: F.length("_few") - F.length(F.translate("_few", signs, ""))
    second = first.select(
        *keep, "_w",
        F.transform("_w", lambda x: F.xxhash64(x)).alias("_h"),
        F.length(F.array_join("_w", "")).alias("word_chars"),
        few(SYMBOLS).alias("n_symbols"),
        F.length(F.regexp_replace("_few", r"\p{L}+", "")).alias("_rest"),
        few("0123456789").alias("_digits"),
        few("ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("_upper"),
        lines.alias("_l"),
    )
    third = second.select(
        *keep, "word_chars", "n_symbols", "_rest", "_digits", "_upper", F.size("_w").alias("n_words"), F.size("_l").alias("_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).alias("n_dup_lines"), F.size(F.array_distinct("_h")).alias("_distinct"),
        F.size(F.filter("_w", lambda x: F.length(x) <= 3)).alias("_short"),
        F.when(F.size("_h") >= 3, F.slice(F.transform("_h", lambda x, i: F.xxhash64(x, F.get("_h", i + 1), F.get("_h", i + 2))), F.lit(1), F.greatest(F.size("_h") - 2, F.lit(0)))).otherwise(F.array().cast("array<bigint>")).alias("_win"),
    )
    keys = F.when(F.size(F.array_distinct("_win")) < F.size("_win"), F.sort_array(F.transform("_win", lambda x, i: F.struct(x.alias("d"), i.alias("p")))))
    fourth = third.select("*", keys.alias("_keys"))
    # neighbours with equal digests repeat; their places, in order, cover 3 words each, or up to the next place
    same = lambda k, other: F.coalesce(k["d"] == other["d"], F.lit(False))
    twice = F.filter("_keys", lambda k, j: same(k, F.get("_keys", j + 1)) | same(k, F.get("_keys", j - 1)))
    fifth = fourth.select("*", F.sort_array(F.transform(twice, lambda k: k["p"].cast("long"))).alias("_at"))
    covered = F.aggregate(F.transform("_at", lambda p, j: F.least(F.lit(3).cast("long"), F.coalesce(F.get("_at", j + 1) - p, F.lit(3).cast("long")))), F.lit(0).cast("long"), lambda a, x: a + x)
    sixth = fifth.select(*keep, *[F.col(c).cast("long").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines")], F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"), "_rest", "_digits", "_upper", "_lines", "_distinct", "_short")
    rate = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))
    return sixth.select(
        *keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        rate("word_chars", "n_words").alias("mean_word"), rate("n_symbols", "word_chars").alias("symbol_rate"), rate("n_dup_lines", "_lines").alias("dup_line_rate"),
        rate("n_repeat_words", "n_words").alias("repeat_rate"), rate("_distinct", "n_words").alias("distinct_rate"),
        F.coalesce(F.try_divide((F.col("word_chars") - F.col("_rest")).cast("double"), F.col("word_chars").cast("double")), F.lit(0.0)).alias("letter_rate"),
        rate("_upper", "word_chars").alias("upper_rate"), rate("_digits", "word_chars").alias("digit_rate"), rate("_short", "n_words").alias("stop_rate"), rate("n_words", "_lines").alias("line_words"),
    )

"""Group statistics: the animal is the unit, regions collapse to its medians first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sample_medians(rows: DataFrame, unit: str, values: list[str], counted: str) -> DataFrame:
    return rows.groupBy(unit).agg(*[F.median(v).alias(v) for v in values], F.count(counted).alias("n_roi"))


def long_form(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    return df.unpivot(keys, values, "metric", "value")


def compare(rows: DataFrame, group: str, a: str, b: str) -> DataFrame:
    """(metric, median_a, median_b, hedges_g, cohens_d) of rows(group, metric, value): one pass of conditional sums."""
    v = lambda g: F.when(F.col(group) == g, F.col("value"))
    stats = rows.groupBy("metric").agg(*[f(v(g)).alias(f"{n}{s}") for s, g in (("a", a), ("b", b)) for n, f in (("n", F.count), ("mean", F.avg), ("med", F.median), ("var", F.var_samp))])
    pooled = F.sqrt(((F.col("na") - 1) * F.col("vara") + (F.col("nb") - 1) * F.col("varb")) / F.nullif(F.col("na") + F.col("nb") - 2, F.lit(0)))
    d = (F.col("meana") - F.col("meanb")) / F.nullif(pooled, F.lit(0.0))
    j = 1 - 3 / (4 * (F.col("na") + F.col("nb")) - 9)
    return stats.select("metric", F.col("meda").alias("median_a"), F.col("medb").alias("median_b"), (j * d).alias("hedges_g"), d.alias("cohens_d"))


def average_rank(value: str, by: list[str]) -> Column:
    """Rank with ties at their mean."""
    order = Window.partitionBy(*by).orderBy(value)
    return F.rank().over(order) + (F.count("*").over(Window.partitionBy(*by, value)) - 1) / 2


def spearman(rows: DataFrame, x: str, y: str, by: str) -> DataFrame:
    ranked = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(by, average_rank(x, [by]).alias("rx"), average_rank(y, [by]).alias("ry"))
    return ranked.groupBy(by).agg(F.when(F.count("*") >= 3, F.corr("rx", "ry")).alias("rho"), F.count("*").alias("n"))


def benjamini_hochberg(rows: DataFrame, p: str, family: str) -> DataFrame:
    """rows with q: the running least of p m / i from the largest p on, at most 1; null p has null q."""
    up, down = Window.partitionBy(family).orderBy(F.col(p)), Window.partitionBy(family).orderBy(F.col(p).desc())
    tested = rows.where(F.col(p).isNotNull())
    i, m = F.rank().over(up) + F.count("*").over(Window.partitionBy(family, p)) - 1, F.count("*").over(Window.partitionBy(family))
    return tested.withColumn("_r", F.col(p) * m / i).withColumn("q", F.least(F.lit(1.0), F.min("_r").over(down))).drop("_r")


def replicate_screen(rows: DataFrame, metric: str, condition: str, value: str, control: str) -> DataFrame:
    """CLEAN where all replicates of the condition lie on one side of the control mean and spread less than they differ from it, same-side where they
    only do the former; with the difference in percent. Without replicates of both, or with a control mean of 0, neither is known."""
    c, h = F.when(F.col(condition) == control, F.col(value)), F.when(F.col(condition) != control, F.col(value))
    s = rows.groupBy(metric).agg(F.avg(c).alias("wt"), F.avg(h).alias("het"), F.min(h).alias("lo"), F.max(h).alias("hi"))
    side, gap = (F.col("lo") > F.col("wt")) | (F.col("hi") < F.col("wt")), F.abs(F.col("het") - F.col("wt"))
    known = F.col("wt").isNotNull() & F.col("het").isNotNull() & (F.col("wt") != 0)
    verdict = F.when(~known, "n/a").when(side & (F.col("hi") - F.col("lo") < gap) & (gap > 0), "CLEAN").when(side, "same-side").otherwise("disagree")
    pct = F.when(known, F.round(F.try_divide(100 * (F.col("het") - F.col("wt")), F.col("wt")), 1))
    return s.select(metric, F.round("wt", 6).alias("wt"), F.round("het", 6).alias("het"), pct.alias("pct"), verdict.alias("verdict"))


def otsu(hist: DataFrame, by: str) -> DataFrame:
    """(by, threshold) of hist(by, v, n): the value that separates the histogram with the greatest between-class variance, the least on ties."""
    w = Window.partitionBy(by).orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    total = Window.partitionBy(by)
    c = hist.select(by, "v", F.sum("n").over(w).alias("w0"), F.sum(F.col("n") * F.col("v")).over(w).alias("s0"), F.sum("n").over(total).alias("w"), F.sum(F.col("n") * F.col("v")).over(total).alias("s")).where("w0 < w")
    m0, m1 = F.col("s0") / F.col("w0"), (F.col("s") - F.col("s0")) / (F.col("w") - F.col("w0"))
    between = F.round(F.col("w0") * (F.col("w") - F.col("w0")) * (m0 - m1) * (m0 - m1), 3)
    return c.groupBy(by).agg(F.min_by("v", F.struct(-between, F.col("v"))).alias("threshold"))


def noise_floor(rows: DataFrame, by: str, value: str, quantile: float = 0.7) -> DataFrame:
    """1.4826 times the median absolute deviation of the values strictly below a percentile, at least 1e-6."""
    cut = rows.groupBy(by).agg(F.percentile(value, quantile).alias("cut"))
    low = rows.join(F.broadcast(cut), by).where(F.col(value) < F.col("cut"))
    med = low.groupBy(by).agg(F.median(value).alias("med"))
    return low.join(F.broadcast(med), by).groupBy(by).agg(F.greatest(F.lit(1e-6), 1.4826 * F.median(F.abs(F.col(value) - F.col("med")))).alias("sigma"))


def permutation_p(rows: DataFrame, unit: str, group: str, a: str, rounds: int, seed: int) -> DataFrame:
    """(metric, p): two-sided permutation test of the difference of means, for rows(unit, group, metric, value) with a row for each unit and metric.

    In a round as many units of a metric as it has in group a are drawn, those with the least digests of unit and round; p = (hits + 1) / (rounds + 1),
    where a hit differs at least as much as the groups do, but for 1e-12. Digests make the draw the same in any layout of the table. Units
    without a value don't count; a metric with fewer than two units on a side has no p.

    Sums are taken by the digests' first eight bits; only units of the bucket in which a draw ends are put in order.
    """
    valued = rows.where(F.col("value").isNotNull())
    diff = lambda cond: F.avg(F.when(cond, F.col("value"))) - F.avg(F.when(~cond, F.col("value")))
    sides = [F.count_if(F.col(group) == a).alias("na"), F.count_if(F.col(group) != a).alias("nb")]
    seen = valued.groupBy("metric").agg(diff(F.col(group) == a).alias("d"), *sides)
    units = valued.groupBy(unit).agg(F.collect_list(F.struct("metric", F.col("value").cast("double").alias("value"))).alias("of")).checkpoint()
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.col("r"), F.col(unit)).cast("binary"))
    dealt = units.select(unit, "of", F.explode(F.sequence(F.lit(1), F.lit(rounds))).alias("r")).withColumn("digest", digest)
    dealt = dealt.select(unit, "r", "digest", F.substring("digest", 1, 2).alias("bucket"), F.explode("of").alias("m")).select("*", "m.metric", "m.value").drop("m")
    run = dealt.groupBy("metric", "r", "bucket").agg(F.count("*").alias("n"), F.sum("value").alias("s"))
    run = run.withColumn("upto", F.sum("n").over(Window.partitionBy("metric", "r").orderBy("bucket"))).join(seen.select("metric", "na"), "metric").checkpoint()
    first, last = F.col("upto") <= F.col("na"), F.col("upto") - F.col("n") >= F.col("na")
    cut = run.where(~first & ~last).select("metric", "r", "bucket", (F.col("na") - F.col("upto") + F.col("n")).alias("more"))  # at most one a metric and round
    place = F.row_number().over(Window.partitionBy("metric", "r").orderBy("digest", unit))
    among = dealt.join(F.broadcast(cut), ["metric", "r", "bucket"]).withColumn("first", place <= F.col("more"))
    side = lambda a, b, n, s: [F.when(c, v).alias(k) for c, x in ((a, "a"), (b, "b")) for v, k in ((n, f"n{x}"), (s, f"s{x}"))]
    sums = run.select("metric", "r", *side(first, last, F.col("n"), F.col("s"))).union(among.select("metric", "r", *side(F.col("first"), ~F.col("first"), F.lit(1).cast("long"), F.col("value"))))
    e = F.sum("sa") / F.sum("na") - F.sum("sb") / F.sum("nb")
    tried = sums.groupBy("metric", "r").agg(e.alias("e")).join(seen.select("metric", "d"), "metric")
    hits = tried.groupBy("metric").agg(F.count_if(F.abs("e") >= F.abs("d") - 1e-12).alias("hits"))
    p = F.when((F.col("na") >= 2) & (F.col("nb") >= 2), (F.col("hits") + 1) / (rounds + 1))
    return seen.join(hits, "metric").select("metric", p.alias("p"))


def two_samples(rows: DataFrame, group: str, a: str) -> DataFrame:
    """(metric, u, z, ks): Mann-Whitney's U of group a with its normal score (ties corrected), and the Kolmogorov-Smirnov distance.

    Values are counted first, so ranks and distributions are running sums over different values.
    """
    c = rows.groupBy("metric", "value").agg(F.count_if(F.col(group) == a).alias("a"), F.count_if(F.col(group) != a).alias("b"))
    up = Window.partitionBy("metric").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    run = c.select("*", F.sum("a").over(up).alias("ca"), F.sum("b").over(up).alias("cb"), (F.col("a") + F.col("b")).alias("t"))
    total = c.groupBy("metric").agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))
    rank = F.col("ca") + F.col("cb") - (F.col("t") - 1) / 2
    far = F.abs(F.col("ca") / F.col("na") - F.col("cb") / F.col("nb"))
    s = run.join(total, "metric").groupBy("metric").agg(F.first("na").alias("na"), F.first("nb").alias("nb"), F.sum(rank * F.col("a")).alias("r"), F.max(far).alias("ks"), F.sum(F.col("t").cast("double") * F.col("t") * F.col("t") - F.col("t")).alias("ties"))
    n, ab = F.col("na") + F.col("nb"), F.col("na").cast("double") * F.col("nb")
    u = F.col("r") - F.col("na").cast("double") * (F.col("na") + 1) / 2
    sd = F.sqrt(ab / 12 * (n + 1 - F.col("ties") / (n * (n - 1))))
    return s.select("metric", u.alias("u"), F.round((u - ab / 2) / sd, 6).alias("z"), F.round("ks", 6).alias("ks"))


def knot_percentile(rows: DataFrame, by: str, value: str, p: float) -> DataFrame:
    """(by, p): the percentile with knots at 100 (i - 0.5) / n, held to the least and greatest value."""
    w = Window.partitionBy(by)
    r = rows.select(by, F.col(value).alias("v"), F.row_number().over(w.orderBy(value)).alias("i"), F.count("*").over(w).alias("n"))
    at = F.greatest(F.lit(1.0), F.least(F.col("n").cast("double"), p / 100 * F.col("n") + 0.5))
    share = F.greatest(F.lit(0.0), 1 - F.abs(F.col("i") - at))
    return r.groupBy(by).agg(F.round(F.sum(F.col("v") * share), 6).alias("p"))


def standard_scores(rows: DataFrame, columns: list[str], keep: list[str]) -> DataFrame:
    """rows(keep, columns) with each column's z over all rows, by one row of sums."""
    s = rows.agg(*[f(c).alias(f"{n}{i}") for i, c in enumerate(columns) for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    return rows.join(F.broadcast(s)).select(*keep, *[((F.col(c) - F.col(f"m{i}")) / (F.col(f"s{i}") + 1e-9)).alias(c) for i, c in enumerate(columns)])

"""Correlations, tests and calibration."""

from __future__ import annotations

from math import erfc, exp, lgamma, log, sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from labelscan.operators.match import fits
from labelscan.operators.order import running

#: Distinct values that one task ranks; more are ranked by ranges.
RANKED = 1 << 16


def pearson(df: DataFrame, x: str, y: str) -> DataFrame:
    """(n, r) over the rows that have both values."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    return both.agg(F.count(F.lit(1)).alias("n"), F.corr(x, y).alias("r"))


def incomplete_beta(x: float, a: float, b: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(1 - x, b, a)
    tiny = 1e-300
    c, d = 1.0, 1 / ((1 - (a + b) * x / (a + 1)) or tiny)
    found = d
    for m in range(1, 1000):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + step * d) or tiny)
            c = (1 + step / c) or tiny
            found *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return exp(a * log(x) + b * log(1 - x) + lgamma(a + b) - lgamma(a) - lgamma(b)) / a * found


def correlation_p(n: int, r: float | None) -> float:
    """Two-sided p of a correlation, by Student's t with n - 2 degrees of freedom."""
    if r is None or n < 3:
        return 1.0
    t2 = r * r * (n - 2) / max(1 - r * r, 1e-300)
    return incomplete_beta((n - 2) / (n - 2 + t2), (n - 2) / 2, 0.5)


def average_ranks(df: DataFrame, columns: list[str]) -> DataFrame:
    """df plus rank_<column>, average ranks on ties, and ties_<column>, the number of rows with that value.

    Equal values are counted, and counts are summed up in the values' order: in one task for up to RANKED distinct
    values, which are counted first, and by ranges of values beyond.
    """
    for c in columns:
        counts = df.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
        few = fits(counts, RANKED)
        if few:
            counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(W.orderBy("_v").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        else:
            counts = running(counts, "_v", "_n")
        ranks = counts.select("_v", (F.col("_before") + (F.col("_n") + 1) / 2).alias(f"rank_{c}"), F.col("_n").alias(f"ties_{c}"))
        df = df.join(F.broadcast(ranks) if few else ranks, F.col(c) == F.col("_v"), "left").drop("_v")
    return df


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    ranked = average_ranks(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()), [x, y])
    return ranked.agg(F.count(F.lit(1)).alias("n"), F.corr(f"rank_{x}", f"rank_{y}").alias("r"))


def mann_whitney(df: DataFrame, group: str, x: str) -> DataFrame:
    """(n1, n0, u, ties, z) of group 1 against group 0: ties is the sum of t**3 - t over the values' counts, z has tie and continuity corrections."""
    ranked = average_ranks(df.where(F.col(x).isNotNull() & F.col(group).isin(0, 1)), [x])
    n1, n0 = F.count_if(F.col(group) == 1), F.count_if(F.col(group) == 0)
    total = F.sum(F.when(F.col(group) == 1, F.col(f"rank_{x}")))
    ties = F.coalesce(F.sum(F.col(f"ties_{x}").cast("double") * F.col(f"ties_{x}") - 1), F.lit(0.0))
    sums = ranked.agg(n1.alias("n1"), n0.alias("n0"), (total - n1 * (n1 + 1) / 2).alias("u"), ties.alias("ties"))
    a, b, n = F.col("n1").cast("double"), F.col("n0").cast("double"), (F.col("n1") + F.col("n0")).cast("double")
    spread = F.sqrt(a * b / 12 * (n + 1 - F.col("ties") / (n * (n - 1))))
    return sums.withColumn("z", F.when(spread > 0, (F.col("u") - a * b / 2 - 0.5) / spread))


def mann_whitney_p(n1: int, n0: int, u: float, ties: float = 0.0, exact: int = 8) -> float:
    """One-sided p that group 1 is the larger: exact without ties if a group has at most `exact` rows, else by the normal law with tie and continuity corrections."""
    if not n1 or not n0:
        return 1.0
    if not ties and min(n1, n0) <= exact:
        ways = [1] + [0] * (n1 * n0)  # of each u: the coefficients of a Gaussian binomial
        for i in range(1, min(n1, n0) + 1):
            for j in range(n1 * n0, max(n1, n0) + i - 1, -1):
                ways[j] -= ways[j - max(n1, n0) - i]
            for j in range(i, n1 * n0 + 1):
                ways[j] += ways[j - i]
        return sum(ways[int(u) :]) / sum(ways)
    n = n1 + n0
    spread = sqrt(n1 * n0 / 12 * (n + 1 - ties / (n * (n - 1))))
    return 0.5 * erfc((u - n1 * n0 / 2 - 0.5) / spread / sqrt(2)) if spread else 1.0


def brier_auc(scores: DataFrame, p: str, y: str) -> DataFrame:
    """(n, brier, naive_brier, auc)."""
    base = scores.agg(F.count(F.lit(1)).alias("n"), F.avg(F.pow(F.col(p) - F.col(y), 2)).alias("brier"), F.avg(y).alias("m"))
    u = mann_whitney(scores, y, p).select((F.col("u") / (F.col("n1") * F.col("n0"))).alias("auc"))
    return base.join(F.broadcast(u)).select("n", "brier", (F.col("m") * (1 - F.col("m"))).alias("naive_brier"), "auc")


def calibration(scores: DataFrame, p: str, y: str, edges: tuple[float, ...] = (0.0, 0.4, 0.7, 1.01)) -> DataFrame:
    """(bin, n, mean_p, mean_y), bins closed below."""
    label = F.lit(None).cast("string")
    for a, b in reversed(list(zip(edges, edges[1:], strict=False))):
        label = F.when((F.col(p) >= a) & (F.col(p) < b), f"{a}-{b}").otherwise(label)
    return scores.groupBy(label.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_p"), F.avg(y).alias("mean_y"))


def cutoff_means(df: DataFrame, score: str, metric: str, cuts: list[float]) -> DataFrame:
    """(cut, below, above): mean of the metric on either side of each cut, in one pass."""
    each = df.select(score, metric, F.explode(F.array(*map(F.lit, cuts))).alias("cut"))
    side = lambda c: F.avg(F.when(c, F.col(metric)))
    return each.groupBy("cut").agg(side(F.col(score) < F.col("cut")).alias("below"), side(F.col(score) >= F.col("cut")).alias("above"))


def decide(r: Column, p: Column, separation_p: Column) -> Column:
    return F.when((r < -0.2) & (p < 0.05) & (separation_p < 0.05), "use").otherwise("do not use")

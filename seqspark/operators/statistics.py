"""Grouped statistics as chains of aggregates."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import special
from .windows import average_rank


def position_entropy(df: DataFrame, by: list[str], seq: str, base: float = 2.0) -> DataFrame:
    """(by, pos, entropy): Shannon entropy of the symbols at each 1-based place."""
    chars = F.filter(F.split(F.col(seq), "", -1), lambda c: c != "")
    rows = df.select(*by, F.posexplode(chars).alias("pos", "ch"))
    n = rows.groupBy(*by, (F.col("pos") + 1).cast("long").alias("pos"), "ch").agg(F.count(F.lit(1)).alias("n"))
    # One pass over the symbol counts: -sum(p log p) = log(total) - sum(n log n) / total.
    return n.groupBy(*by, "pos").agg(((F.ln(F.sum("n")) - F.sum(F.col("n") * F.ln("n")) / F.sum("n")) / F.ln(F.lit(base))).alias("entropy"))


def mad_outliers(df: DataFrame, by: list[str], value: str, threshold: float = 2.0) -> DataFrame:
    """df with the median, the median absolute deviation and whether 0.6745 * |x - median| / MAD exceeds the threshold.

    With a deviation of 0 every other value is an outlier. Two aggregates of medians, joined to the rows by group."""
    mid = df.groupBy(*by).agg(F.median(value).alias("mid"))
    rows = df.join(mid, by)
    mad = rows.groupBy(*by).agg(F.median(F.abs(F.col(value) - F.col("mid"))).alias("mad"))
    gap = F.abs(F.col(value) - F.col("mid"))
    return rows.join(mad, by).withColumn("outlier", F.when(F.col("mad") > 0, 0.6745 * gap / F.col("mad") > threshold).otherwise(gap > 0))


def least_squares(df: DataFrame, by: list[str], x: str, y: str, slope: float | None = None) -> DataFrame:
    """(by, slope, intercept): free line, or the best intercept for a fixed slope."""
    if slope is None:
        return df.groupBy(*by).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))
    return df.groupBy(*by).agg(F.lit(slope).alias("slope"), F.avg(F.col(y) - slope * F.col(x)).alias("intercept"))


def spearman(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    ranked = df.withColumn("_x", average_rank(x, by)).withColumn("_y", average_rank(y, by))
    return ranked.groupBy(*by).agg(F.corr("_x", "_y").alias("spearman"))


def kendall(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Kendall's tau-b from counts of distinct value pairs: equal pairs are joined once, so ties cost nothing."""
    n = df.groupBy(*by, F.col(x).alias("x"), F.col(y).alias("y")).agg(F.count(F.lit(1)).alias("n"))
    a, b = n.select(*by, F.col("x").alias("x1"), F.col("y").alias("y1"), F.col("n").alias("n1")), n.select(*by, F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("n").alias("n2"))
    both = a.join(b, by) if by else a.crossJoin(b)
    s = F.signum(F.col("x1") - F.col("x2")) * F.signum(F.col("y1") - F.col("y2"))
    score = both.groupBy(*by).agg((F.sum(s * F.col("n1") * F.col("n2")) / 2).alias("score"))
    ties = lambda c, name: n.groupBy(*by, c).agg(F.sum("n").alias("t")).groupBy(*by).agg(F.sum(F.col("t") * (F.col("t") - 1) / 2).alias(name), F.sum("t").alias(f"n_{name}"))
    out = score.join(ties("x", "tx"), by).join(ties("y", "ty"), by)
    pairs = F.col("n_tx") * (F.col("n_tx") - 1) / 2
    return out.select(*by, (F.col("score") / F.sqrt((pairs - F.col("tx")) * (pairs - F.col("ty")))).alias("kendall"))


def variance_ratio(df: DataFrame, by: list[str], x: str, y: str, log_normal: bool = False) -> DataFrame:
    """F statistic of population variances; for log-normal data of exp(var(ln))."""
    v = (lambda c: F.exp(F.var_pop(F.ln(c)))) if log_normal else F.var_pop
    return df.groupBy(*by).agg((v(x) / v(y)).alias("f"), F.count(x).alias("n_x"), F.count(y).alias("n_y"))


def welch(df: DataFrame, by: list[str], group: Column, value: str) -> DataFrame:
    """Welch's t and degrees of freedom between rows where group is true and where it is false; nulls are left out."""
    g = lambda f, yes: f(F.when(group if yes else ~group, F.col(value)))
    s = df.groupBy(*by).agg(*[g(f, yes).alias(f"{name}{int(yes)}") for yes in (True, False) for name, f in (("m", F.avg), ("v", F.var_samp), ("n", F.count))])
    a, b = F.col("v1") / F.col("n1"), F.col("v0") / F.col("n0")
    return s.select(*by, ((F.col("m1") - F.col("m0")) / F.sqrt(a + b)).alias("t"), ((a + b) * (a + b) / (a * a / (F.col("n1") - 1) + b * b / (F.col("n0") - 1))).alias("df"))


def with_tails(df: DataFrame, statistic: str, d1: str, d2: str | None = None) -> DataFrame:
    """Adds p: the tail of F with d1 and d2, or the two-sided tail of t with d1 degrees of freedom. One row a group."""
    if d2:

        @F.pandas_udf("double")
        def tail(s: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
            return pd.Series([None if pd.isna([x, y, z]).any() else special.f_tail(x, y, z) for x, y, z in zip(s, a, b, strict=True)], dtype="float64")

        return df.withColumn("p", tail(statistic, F.col(d1).cast("double"), F.col(d2).cast("double")))

    @F.pandas_udf("double")
    def tail(s: pd.Series, a: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna([x, y]).any() else special.t_tail(x, y) for x, y in zip(s, a, strict=True)], dtype="float64")

    return df.withColumn("p", tail(statistic, F.col(d1).cast("double")))


def bin_index(x: Column, low: float, high: float, n: int) -> Column:
    """Half-open bins of equal width, the last closed; null outside."""
    width = (high - low) / n
    return F.when((x >= low) & (x < high), F.floor((x - low) / width)).when(x == high, n - 1).cast("long")


def histogram(df: DataFrame, value: Column, low: float, high: float, n: int) -> DataFrame:
    """(bin, n, share), all n bins; share is of the rows that fall into bins."""
    counts = df.select(bin_index(value, low, high, n).alias("bin")).where("bin IS NOT NULL").groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    every = df.sparkSession.range(n).withColumnRenamed("id", "bin")
    full = every.join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))
    return full.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def empirical_cdf(df: DataFrame, value: str, edges: list[float]) -> DataFrame:
    """(edge, share): share of the rows at most each edge."""
    row = df.agg(*[F.avg((F.col(value) <= e).cast("double")).alias(f"e{i}") for i, e in enumerate(edges)])
    return row.select(F.inline(F.array(*[F.struct(F.lit(float(e)).alias("edge"), F.col(f"e{i}").alias("share")) for i, e in enumerate(edges)])))


def roc(df: DataFrame, score: str, outcome: Column, thresholds: int = 50) -> DataFrame:
    """(auc, n_points): area under the curve of rates at even thresholds from 0.9 * min to 1.1 * max of the score, by trapezoids;
    points with the same false positive rate count once, and both ends are added. One pass counts all thresholds."""
    ends = df.agg(F.min(score).alias("a"), F.max(score).alias("b")).first()
    low, high = 0.9 * ends["a"], 1.1 * ends["b"]
    cuts = [low + (high - low) * i / (thresholds - 1) for i in range(thresholds)]
    yes, no = outcome, ~outcome
    hits = [F.sum(((F.col(score) >= c) & w).cast("long")).alias(f"{k}{i}") for i, c in enumerate(cuts) for k, w in (("t", yes), ("f", no))]
    row = df.agg(*hits, F.sum(yes.cast("long")).alias("p"), F.sum(no.cast("long")).alias("q")).first()
    points: dict[float, float] = {}
    for i in range(thresholds):
        points.setdefault(row[f"f{i}"] / row["q"], row[f"t{i}"] / row["p"])
    points.setdefault(0.0, 0.0)
    points.setdefault(1.0, 1.0)
    line = sorted(points.items())
    auc = sum((x2 - x1) * (y1 + y2) / 2 for (x1, y1), (x2, y2) in zip(line, line[1:], strict=False))
    return df.sparkSession.createDataFrame([(auc, len(line))], "auc double, n_points long")


def divergence(p: Column, q: Column) -> Column:
    """Kullback-Leibler divergence of two columns of weights, each brought to sum 1; an aggregate."""
    a, b = F.sum(p), F.sum(q)
    return F.sum(F.when(p > 0, p * F.ln(p / q)).otherwise(0.0)) / a - F.ln(a / b)


def confusion_scores(df: DataFrame, truth: Column, guess: Column) -> DataFrame:
    """F1, Matthews correlation, kappa and the cube root of their product, from one pass."""
    c = lambda a, b: F.sum((a & b).cast("double"))
    k = df.agg(c(truth, guess).alias("tp"), c(~truth, guess).alias("fp"), c(truth, ~guess).alias("fn"), c(~truth, ~guess).alias("tn"))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    chance = ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / (n * n)
    out = k.select(
        (2 * tp / (2 * tp + fp + fn)).alias("f1"),
        ((tp * tn - fp * fn) / F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))).alias("mcc"),
        (((tp + tn) / n - chance) / (1 - chance)).alias("kappa"),
    )
    product = F.col("f1") * F.col("mcc") * F.col("kappa")
    return out.withColumn("fmk", F.signum(product) * F.pow(F.abs(product), F.lit(1 / 3)))


def subgroup_report(df: DataFrame, group: str, x: str, y: str, folds: tuple[float, ...] = (2.0, 5.0, 10.0)) -> DataFrame:
    """One row for each group and one, ALL, for all rows: line fit, R2, RMSE, share of rows within each fold of the line.

    Every row is sent once for its group and once for ALL; partial aggregates fold both before the shuffle."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.explode(F.array(F.col(group).cast("string"), F.lit("ALL"))).alias("subgroup"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    fit = rows.groupBy("subgroup").agg(F.count(F.lit(1)).alias("n"), F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"), F.regr_r2("y", "x").alias("r2"))
    # The fit is copied so that the rows of a large group meet it in many tasks.
    copies = fit.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(63))))
    scored = rows.withColumn("_copy", F.pmod(F.xxhash64("x", "y"), F.lit(64)).cast("int")).join(copies, ["subgroup", "_copy"]).withColumn("guess", F.col("slope") * F.col("x") + F.col("intercept"))
    ratio = F.greatest(F.col("guess") / F.col("y"), F.col("y") / F.col("guess"))
    within = [F.avg(((F.col("guess") > 0) & (F.col("y") > 0) & (ratio <= f)).cast("double")).alias(f"within_{f:g}") for f in folds]
    more = scored.groupBy("subgroup").agg(F.sqrt(F.avg(F.pow(F.col("guess") - F.col("y"), F.lit(2.0)))).alias("rmse"), *within)
    return fit.join(more, "subgroup")


def summed(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)

"""Intervals and paired tests.  Resampling draws come from hashes, so results repeat anywhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import draw

Z95 = 1.959963984540054
REPS = 1000


def wilson(successes: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """Score interval of a proportion, clamped to [0, 1]; null without trials."""
    p, zz = successes / n, z * z
    centre = (p + zz / (2 * n)) / (1 + zz / n)
    half = z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n)) / (1 + zz / n)
    return F.when(n > 0, F.greatest(F.lit(0.0), centre - half)), F.when(n > 0, F.least(F.lit(1.0), centre + half))


def transitions(pairs: DataFrame, a: str = "a", b: str = "b", by: list[str] | None = None) -> DataFrame:
    """both, only_a, only_b, neither over rows with both outcomes."""
    x, y = F.col(a).cast("boolean"), F.col(b).cast("boolean")
    done = pairs.filter(x.isNotNull() & y.isNotNull())
    return (done.groupBy(*by) if by else done.groupBy()).agg(F.count_if(x & y).alias("both"), F.count_if(x & ~y).alias("only_a"), F.count_if(~x & y).alias("only_b"), F.count_if(~x & ~y).alias("neither"))


def mcnemar(b: Column, c: Column) -> Column:
    """Exact two-sided p of the discordant counts, null where there are none.

    The binomial tail is summed in units of its last term, which is its largest and whose log is kept, so nothing overflows.
    """
    n, k = b + c, F.least(b, c)
    tail = F.aggregate(
        F.when(k > 0, F.sequence(F.lit(1).cast("bigint"), k.cast("bigint"))).otherwise(F.array().cast("array<bigint>")),
        F.struct(F.lit(0.0).alias("log"), F.lit(1.0).alias("sum")),
        lambda s, i: F.struct((s["log"] + F.log((n - i + 1) / i)).alias("log"), (1.0 + s["sum"] * i / (n - i + 1)).alias("sum")),
        lambda s: s["log"] + F.log(s["sum"]),
    )
    return F.when(n > 0, F.least(F.lit(1.0), 2 * F.exp(tail - n * F.log(F.lit(2.0)))))


def resampled_means(values: DataFrame, value: str, *, reps: int = REPS, seed: int = 42) -> DataFrame:
    """rep, mean: bootstrap means of a metric vector (key, value).

    Draw i of repetition b takes the row at position hash(b, i, seed) mod n.  Positions are given once,
    by a row number in key order; the vector is one metric of a query set, so its window is small.
    """
    at = values.filter(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("v"), (F.row_number().over(Window.orderBy("key")) - 1).alias("at"))
    n = at.count()
    if not n:
        return values.sparkSession.createDataFrame([], "rep bigint, mean double")
    draws = values.sparkSession.range(reps * n).select(F.expr(f"id div {n}").alias("rep"), F.expr(f"id % {n}").alias("i"))
    draws = draws.select("rep", (draw(seed, F.col("rep"), F.col("i")) % n).alias("at"))
    return draws.join(at, "at").groupBy("rep").agg(F.avg("v").alias("mean"))


def bootstrap_ci(values: DataFrame, value: str = "value", *, reps: int = REPS, alpha: float = 0.05, seed: int = 42) -> DataFrame:
    """mean, lo, hi: percentile interval with the order statistics int(alpha/2 B) and int((1 - alpha/2) B) - 1."""
    means = resampled_means(values, value, reps=reps, seed=seed).withColumn("r", F.row_number().over(Window.orderBy("mean", "rep")) - 1)
    lo, hi = int(alpha / 2 * reps), int((1 - alpha / 2) * reps) - 1
    seen = values.agg(F.avg(value).alias("mean"), F.count(value).alias("n"))
    return seen.crossJoin(means.agg(F.max(F.when(F.col("r") == lo, F.col("mean"))).alias("lo"), F.max(F.when(F.col("r") == hi, F.col("mean"))).alias("hi")))  # one row each


def paired_bootstrap(pairs: DataFrame, *, reps: int = REPS, alpha: float = 0.05, seed: int = 42) -> DataFrame:
    """diff (mean a - b by key), lo, hi, and p: twice the share of means of the other sign or zero, at most 1."""
    d = pairs.select("key", (F.col("a").cast("double") - F.col("b").cast("double")).alias("value"))
    ci = bootstrap_ci(d, reps=reps, alpha=alpha, seed=seed).withColumnRenamed("mean", "diff")
    means = resampled_means(d, "value", reps=reps, seed=seed)
    other = F.when(F.col("diff") > 0, F.col("mean") <= 0).when(F.col("diff") < 0, F.col("mean") >= 0).otherwise(F.col("mean") != 0)
    share = means.crossJoin(ci.select("diff")).agg((F.count_if(other) / F.lit(reps)).alias("share"))  # one row of ci
    return ci.crossJoin(share).select("n", "diff", "lo", "hi", F.least(F.lit(1.0), 2 * F.col("share")).alias("p"))

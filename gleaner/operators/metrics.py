"""Ranking and outcome metrics as grouped aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def rank_of_gold(ranked: DataFrame, gold: DataFrame) -> DataFrame:
    """query_id, rank: the best rank of any relevant document, null if none is ranked; every query of ``gold``."""
    hit = ranked.join(gold.select("query_id", "doc_id").distinct(), ["query_id", "doc_id"]).groupBy("query_id").agg(F.min("rank").alias("rank"))
    return gold.select("query_id").distinct().join(hit, "query_id", "left")


def ranking_metrics(ranks: DataFrame, ks: tuple[int, ...] = (1, 5, 10), by: list[str] | None = None) -> DataFrame:
    """n, p_at_1, mrr, and recall and ndcg at each k; a single relevant document has ndcg 1 / log2(rank + 1)."""
    r = F.col("rank")
    mean = lambda c, name: F.avg(F.coalesce(c, F.lit(0.0))).alias(name)
    aggs = [F.count("*").alias("n"), mean(F.when(r <= max(ks), 1 / r), "mrr")]
    for k in ks:
        aggs += [mean(F.when(r <= k, 1.0), f"recall_{k}"), mean(F.when(r <= k, 1 / F.log2(r + 1)), f"ndcg_{k}")]
    return (ranks.groupBy(*by) if by else ranks.groupBy()).agg(*aggs)


def failure_mode(rank: Column, numeric: Column) -> Column:
    """retrieval_miss without a first hit; else whether parameters must be extracted."""
    return F.when(rank.isNull() | (rank > 1), "retrieval_miss").when(numeric, "param_extraction_needed").otherwise("success")


def downstream(rows: DataFrame, by: list[str]) -> DataFrame:
    """Means of outcomes per query over all rows and over schema hits; ready means coverage and type match of 0.8."""
    hit = F.col("schema_hit") == 1
    ready = ((F.col("param_coverage") >= 0.8) & (F.col("type_match") >= 0.8)).cast("double")
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.avg("schema_hit").alias("schema_r1"),
        F.avg("param_coverage").alias("coverage"),
        F.avg(F.when(hit, F.col("param_coverage"))).alias("coverage_hits"),
        F.avg(F.when(~hit, F.col("param_coverage"))).alias("coverage_misses"),
        F.avg("type_match").alias("type_match"),
        F.avg(ready).alias("ready"),
    )


def threshold_grid(rows: DataFrame, coverages: tuple[float, ...] = (0.8, 0.9, 1.0), matches: tuple[float, ...] = (0.8, 0.9, 1.0)) -> DataFrame:
    """Ready counts at every pair of inclusive thresholds, in one pass over the rows."""
    cells = F.array(*[F.struct(F.lit(c).alias("t_cov"), F.lit(m).alias("t_type"), ((F.col("param_coverage") >= c) & (F.col("type_match") >= m)).alias("ok")) for c in coverages for m in matches])
    return rows.select(F.explode(cells).alias("c")).groupBy("c.t_cov", "c.t_type").agg(F.count_if("c.ok").alias("n_ready"), F.count("*").alias("n"))


def nearest_rank(df: DataFrame, value: str, qs: dict[str, float], by: list[str]) -> DataFrame:
    """Order statistics sorted[int(q n)] without interpolation, with count, mean and population deviation."""
    w = Window.partitionBy(*by)
    x = df.filter(F.col(value).isNotNull()).select(*by, F.col(value).alias("v"), F.row_number().over(w.orderBy(value)).alias("at"), F.count("*").over(w).alias("n"))
    picks = [F.max(F.when(F.col("at") == F.least(F.floor(F.lit(q) * F.col("n")) + 1, F.col("n")), F.col("v"))).alias(name) for name, q in qs.items()]
    return x.groupBy(*by).agg(F.max("n").alias("n"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), *picks, F.max("v").alias("max"))


def votes(rows: DataFrame, by: str, answer: str, pos: str) -> DataFrame:
    """``by`` and its most frequent non-null answer; ties by first position."""
    counts = rows.filter(F.col(answer).isNotNull()).groupBy(by, answer).agg(F.count("*").alias("n"), F.min(pos).alias("first"))
    return counts.groupBy(by).agg(F.max_by(answer, F.struct(F.col("n"), -F.col("first"))).alias("majority"), F.max("n").alias("votes"))


def pass_at_k(rows: DataFrame, by: str, correct: Column, pos: str, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """Whether one of the first k attempts is right."""
    return rows.groupBy(by).agg(*[F.coalesce(F.bool_or(correct & (F.col(pos) < k)), F.lit(False)).alias(f"pass_{k}") for k in ks])


def evaluable_rates(rows: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    """Rates over measured rows only: ``m`` is null where it was not measured; its state says why."""
    packed = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics])
    return (
        rows.select(*by, F.explode(packed).alias("x"))
        .groupBy(*by, "x.metric")
        .agg(F.count("x.v").alias("n_evaluable"), F.avg("x.v").alias("rate"))
        .withColumn("state", F.when(F.col("n_evaluable") == 0, "NOT_APPLICABLE").otherwise("MEASURED"))
    )

"""Poisson bootstrap of ratios: every task sums all replicates of its rows, so rows are never multiplied by their number.

A row enters replicate b with a weight drawn from a Poisson distribution of mean 1, which
depends on the row's key, b and a seed only.  Resampling n of n rows gives the same weights as n
grows, without knowing n and without looking rows up.  A task holds two sums for each
replicate; the sums of tasks are added, and only replicates go to the interval.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REPS = 10_000
#: Rows whose weights are drawn at once.
TOGETHER = 200
#: A prime below 2^31: squares of residues fit in 64 bits, here and in SQL.
PRIME = 2_147_483_647
ROUNDS = ((48_271, 11), (69_621, 1_013), (39_373, 7_919))
#: Shares of the weights 0, 1, 2, ... of a Poisson distribution of mean 1, added up.
STEPS = tuple(math.fsum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(9))


def weights(keys: np.ndarray, reps: int, seed: int) -> np.ndarray:
    """Weights (rows x reps) of rows with the given integer keys."""
    x = ((keys.astype(np.int64) % PRIME * 1_000_003 % PRIME)[:, None] + np.arange(reps, dtype=np.int64) * 7_919 + seed) % PRIME
    for a, c in ROUNDS:
        x = (x * x % PRIME + a * x + c) % PRIME
    return np.searchsorted(np.array(STEPS) * PRIME, x, "right").astype(np.float64)


def weight_sql(key: str, rep: str, seed: int) -> str:
    """The same weight as DuckDB SQL."""
    x = f"(((({key}) % {PRIME}) * 1000003 % {PRIME}) + {rep} * 7919 + {seed}) % {PRIME}"
    rounds = [f"r0 AS (SELECT *, ({x})::BIGINT AS x FROM rows)"]
    for i, (a, c) in enumerate(ROUNDS, 1):
        rounds.append(f"r{i} AS (SELECT * EXCLUDE x, (x * x % {PRIME} + {a} * x + {c}) % {PRIME} AS x FROM r{i - 1})")
    steps = " + ".join(f"(x >= {s!r}::DOUBLE * {PRIME})::INT" for s in STEPS)
    return ", ".join([*rounds, f"weighted AS (SELECT * EXCLUDE x, {steps} AS w FROM r{len(ROUNDS)})"])


def replicates(rows: DataFrame, num: str, den: str, *, key: str = "key", reps: int = REPS, seed: int = 42, by: list[str] | None = None) -> DataFrame:
    """by, rep, num, den: weighted sums of every replicate.  Rows with a null key, numerator or denominator are left out.

    Keys are whole numbers; rows with one key get the same weights.  A task holds two sums for each replicate and
    group that it meets, so groups are meant to be few, such as languages or systems.
    """
    by = by or []
    x = rows.select(*by, F.col(key).cast("long").alias("__k"), F.col(num).cast("double").alias("__n"), F.col(den).cast("double").alias("__d")).filter("__k is not null and __n is not null and __d is not null")
    fields = ", ".join([*[f"`{b}` {x.schema[b].dataType.simpleString()}" for b in by], "nums array<double>", "dens array<double>"])

    def run(batches):
        held: dict[tuple, np.ndarray] = {}
        for batch in batches:
            keys, n, d = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("__k", "__n", "__d"))
            groups = list(zip(*[batch.column(b).to_pylist() for b in by], strict=True)) if by else [()] * len(batch)
            numbers = {g: i for i, g in enumerate(dict.fromkeys(groups))}
            of = np.array([numbers[g] for g in groups], np.int64)
            for g, i in numbers.items():
                at = np.flatnonzero(of == i)
                sums = held.setdefault(g, np.zeros((2, reps)))
                for lo in range(0, len(at), TOGETHER):
                    some = at[lo : lo + TOGETHER]
                    sums += np.stack([n[some], d[some]]) @ weights(keys[some], reps, seed)
        groups = list(held)
        if groups:
            columns = [pa.array([g[i] for g in groups], x_types[i]) for i in range(len(by))]
            yield pa.RecordBatch.from_arrays([*columns, *[pa.array([held[g][k].tolist() for g in groups], pa.list_(pa.float64())) for k in (0, 1)]], names=[*by, "nums", "dens"])

    from pyspark.sql.pandas.types import to_arrow_type

    x_types = [to_arrow_type(x.schema[b].dataType) for b in by]
    sums = x.mapInArrow(run, fields).select(*by, F.posexplode(F.arrays_zip("nums", "dens")).alias("rep", "s"))
    return sums.groupBy(*by, "rep").agg(F.sum("s.nums").alias("num"), F.sum("s.dens").alias("den"))


def ratio_interval(rows: DataFrame, num: str, den: str, *, key: str = "key", reps: int = REPS, alpha: float = 0.05, seed: int = 42, by: list[str] | None = None) -> DataFrame:
    """by, n, ratio, lo, hi: ratio of sums with its percentile interval; a replicate without a denominator counts as 0."""
    by = by or []
    r = replicates(rows, num, den, key=key, reps=reps, seed=seed, by=by)
    ends = F.percentile(F.when(F.col("den") > 0, F.col("num") / F.col("den")).otherwise(0.0), F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2)))
    interval = (r.groupBy(*by) if by else r.groupBy()).agg(ends.alias("e")).select(*by, F.col("e")[0].alias("lo"), F.col("e")[1].alias("hi"))
    known = rows.filter(F.col(key).isNotNull() & F.col(num).isNotNull() & F.col(den).isNotNull())
    whole = (known.groupBy(*by) if by else known.groupBy()).agg(F.count("*").alias("n"), F.sum(F.col(num).cast("double")).alias("__n"), F.sum(F.col(den).cast("double")).alias("__d"))
    whole = whole.select(*by, "n", F.when(F.col("__d") > 0, F.col("__n") / F.col("__d")).otherwise(0.0).alias("ratio"))
    return whole.join(interval, by) if by else whole.crossJoin(interval)  # one row each

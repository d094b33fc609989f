"""Cross-system comparison: keyed pairing, ambiguous runs, failure taxonomy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Native failure categories and their bucket.
FAILURES = {
    "A. SUCCESS_NO_CORRECTION": "none",
    "B. SUCCESS_AFTER_CORRECTION": "none",
    "C. MODEL_PARSE_FAILURE": "parse_failure",
    "D. AMPL_RENDER_FAILURE": "generation_failure",
    "E. AMPL_PARSE_FAILURE": "parse_failure",
    "F. SOLVER_INFEASIBLE": "infeasible",
    "G. SOLVER_UNBOUNDED": "unbounded",
    "H. SOLVER_RUNTIME_ERROR": "execution_failure",
    "I. CORRECTION_EXHAUSTED": "execution_failure",
    "J. DATA_FAILURE": "unsupported_input",
    "K. ENVIRONMENT_FAILURE": "unavailable_artifact",
    "L. OTHER_MODEL_FAILURE": "generation_failure",
    "empty_prompt": "unsupported_input",
    "generation_timeout": "timeout",
    "generation_error": "generation_failure",
    "transformers_backend_unavailable": "unavailable_artifact",
    "vllm_backend_unavailable": "unavailable_artifact",
    "checkpoint_unavailable": "unavailable_artifact",
    "python_syntax_failure": "static_invalid",
    "static_validation_failure": "static_invalid",
    "execution_failure": "execution_failure",
    "execution_timeout": "timeout",
    "copt_api_failure": "execution_failure",
    "infeasible_model": "infeasible",
    "unbounded_model": "unbounded",
    "output_out_of_expectation": "evaluation_ambiguous",
    "missing_problem_id": "unsupported_input",
    "missing_or_empty_problem_text": "unsupported_input",
    "invalid_json": "unsupported_input",
    "blank_line": "unsupported_input",
    "record_not_object": "unsupported_input",
}


def failure_bucket(category: Column) -> Column:
    """Bucket of a native category by its name, else by the first name it begins with; "none" without one, ambiguous if unknown."""
    named = F.create_map(*[F.lit(x) for kv in FAILURES.items() for x in kv])
    begins = F.coalesce(*[F.when(category.startswith(name), F.lit(bucket)) for name, bucket in FAILURES.items()], F.lit("evaluation_ambiguous"))
    return F.when(category.isNull() | (category == ""), F.lit("none")).otherwise(F.coalesce(F.try_element_at(named, category), begins))


def pair(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """key, a, b, side: both systems by key; side says who has the key."""
    x, y = a.select(key, F.col(value).alias("a"), F.lit(True).alias("__a")), b.select(key, F.col(value).alias("b"), F.lit(True).alias("__b"))
    j = x.join(y, key, "full_outer")
    return j.select(key, "a", "b", F.when(F.col("__a") & F.col("__b"), "both").when(F.col("__a"), "only_a").otherwise("only_b").alias("side"))


def ambiguous_runs(rows: DataFrame, by: list[str], run: list[str]) -> DataFrame:
    """Keys with rows of more than one run."""
    return rows.groupBy(*by).agg(F.count_distinct(F.struct(*run)).alias("n_runs")).filter("n_runs > 1")


def margin_over_others(rows: DataFrame, by: str, value: str) -> DataFrame:
    """``rows`` with the largest value of the other rows of their group, from the top two of the group."""
    w = Window.partitionBy(by).orderBy(F.col(value).desc())
    top = rows.select(by, value, F.row_number().over(w).alias("r")).filter("r <= 2").groupBy(by).agg(F.max(F.when(F.col("r") == 1, F.col(value))).alias("m1"), F.max(F.when(F.col("r") == 2, F.col(value))).alias("m2"), F.count("*").alias("k"))
    ties = rows.groupBy(by, value).agg(F.count("*").alias("same"))
    j = rows.join(top, by).join(ties, [by, value])
    return j.withColumn("other", F.when((F.col(value) == F.col("m1")) & (F.col("same") == 1), F.col("m2")).otherwise(F.col("m1"))).drop("m1", "m2", "k", "same")


def value_join(values: DataFrame, gold: DataFrame, by: str, tolerance: float = 1e-9) -> DataFrame:
    """Gold rows with the first mention within ``tolerance`` of their value, null where there is none.

    Values are bucketed by a cell twice the tolerance wide, and the neighbours' cells are probed, so it stays an equi-join.
    """
    cell = lambda c: F.floor(c / (2 * tolerance))
    v = values.withColumn("__cell", F.explode(F.array(*[cell(F.col("value")) + k for k in (-1, 0, 1)])))
    g = gold.withColumn("__cell", cell(F.col("gold")))
    near = g.join(v, [by, "__cell"]).filter(F.abs(F.col("value") - F.col("gold")) < tolerance).groupBy(by, "slot").agg(F.min_by("value", "pos").alias("value"), F.min("pos").alias("pos"))
    return gold.join(near, [by, "slot"], "left")

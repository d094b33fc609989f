"""Sinks: keyed upserts of result tables, resumable runs, rendered reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import versions


def upsert_table(new: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """Merge ``new`` into the table of versions at ``path`` by key; readers see the old version or the new one."""
    t = versions.Table(new.sparkSession, path)
    versions.upsert(t, new, keys)
    return t.read()


def write_csv(df: DataFrame, path: str, order: list[str]) -> None:
    df.orderBy(*order).write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def markdown(df: DataFrame, order: list[str], digits: int = 4) -> str:
    """A table as Markdown, all rows in order; they come to the driver by partitions, since the report is one string."""
    cell = lambda v: "" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(cell(v) for v in r) + " |" for r in df.orderBy(*order).toLocalIterator()])


def formulation_markdown(problems: DataFrame) -> DataFrame:
    """id, rendered: variables, objective and constraints of every problem as Markdown, natively."""
    f = F.col("formulation")
    none = F.array().cast("array<string>")
    variables = F.transform(f["variables"], lambda v: F.concat(F.lit("- `"), F.coalesce(v["symbol"], F.lit("")), F.lit("`")))
    constraints = F.transform(f["constraints"], lambda c: F.concat(F.lit("- "), F.coalesce(c["expression"], F.lit(""))))
    head = F.concat(F.lit("## "), F.coalesce("name", F.lit("")))
    goal = F.concat_ws(" ", F.initcap(f["objective"]["sense"]), f["objective"]["expression"])
    parts = F.concat(F.array(head, F.lit("### Variables")), F.coalesce(variables, none), F.array(F.lit("### Objective"), goal, F.lit("### Constraints")), F.coalesce(constraints, none))
    return problems.select("id", F.array_join(parts, "\n").alias("rendered"))

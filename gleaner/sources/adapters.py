"""Dataset adapters: declarative mappings from source fields to one internal example."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Adapter:
    """Source fields by target, in order of preference (dots reach into structs), and what the dataset offers."""

    name: str
    id: tuple[str, ...] = ("id",)
    query: tuple[str, ...] = ("nl_query", "query")
    schema: tuple[str, ...] = ("schema_id",)
    gold: tuple[str, ...] = ("scalar_gold_params",)
    formulation: tuple[str, ...] = ("formulation_text",)
    has: dict[str, bool] = field(default_factory=dict)


def _caps(query=True, gold=True, formulation=True, schema=True):
    return {"has_query": query, "has_gold": gold, "has_formulation": formulation, "has_schema": schema}


#: The registry; sources without natural language or figures say so in ``has``.
ADAPTERS: dict[str, Adapter] = {
    a.name: a
    for a in (
        Adapter("nlp4lp", query=("query", "description"), schema=("relevant_doc_id", "id"), has=_caps()),
        Adapter("nl4opt", query=("query",), has=_caps()),
        Adapter("cardinal_nl4opt", query=("query",), schema=("relevant_doc_id",), has=_caps()),
        Adapter("structuredor", query=("query",), has=_caps()),
        Adapter("industryor", schema=("domain",), has=_caps()),
        Adapter("mamo", schema=("problem_type",), has=_caps()),
        Adapter("optimus", schema=("problem_type",), has=_caps()),
        Adapter("optmath", schema=("problem_type",), formulation=("target_model",), has=_caps()),
        Adapter("complexor", schema=("problem_family",), formulation=("model_mzn",), has=_caps(gold=False)),
        Adapter("text2zinc", id=("input.metadata.identifier", "id"), query=("input.description",), schema=("input.metadata.domain",), formulation=("model_mzn",), has=_caps(gold=False)),
        Adapter("cp_bench", query=(), schema=(), formulation=("model",), has=_caps(query=False, gold=False, schema=False)),
        Adapter("gurobi_modeling_examples", query=("description",), schema=("name",), has=_caps(gold=False)),
        Adapter("gurobi_optimods", query=("description",), schema=("name",), has=_caps(gold=False)),
        Adapter("gams_models", query=("description",), schema=("name",), has=_caps(gold=False)),
        Adapter("miplib", query=(), schema=("name",), has=_caps(query=False, gold=False)),
        Adapter("or_library", query=("description",), schema=("name",), has=_caps(gold=False)),
        Adapter("pyomo_examples", query=("description",), schema=("name",), formulation=("code",), has=_caps(gold=False)),
    )
}


def _there(schema, path: str) -> bool:
    for part in path.split("."):
        if not hasattr(schema, "fieldNames") or part not in schema.fieldNames():
            return False
        schema = schema[part].dataType
    return True


def internal(df: DataFrame, name: str, split: str = "test") -> DataFrame:
    """dataset, split, id, query, schema_id, gold (map), formulation of a source's rows; what a source lacks is null."""
    if name not in ADAPTERS:
        raise ValueError(f"unknown dataset {name!r}; one of {sorted(ADAPTERS)}")
    a = ADAPTERS[name]

    def pick(paths: tuple[str, ...], kind: str = "string") -> Column:
        found = [F.col(p).cast(kind) for p in paths if _there(df.schema, p)]
        return F.coalesce(*found) if found else F.lit(None).cast(kind)

    return df.select(F.lit(name).alias("dataset"), F.lit(split).alias("split"), pick(a.id).alias("id"), F.trim(pick(a.query)).alias("query"), pick(a.schema).alias("schema_id"), pick(a.gold, "map<string,double>").alias("gold"), pick(a.formulation).alias("formulation"))


def capabilities(spark) -> DataFrame:
    """dataset and what it offers."""
    return spark.createDataFrame([(a.name, *a.has.values()) for a in ADAPTERS.values()], "dataset string, has_query boolean, has_gold boolean, has_formulation boolean, has_schema boolean")


def coverage(examples: DataFrame) -> DataFrame:
    """dataset, n, shares of examples with a query, a gold value and a formulation."""
    have = lambda c: F.avg(c.cast("int"))
    return examples.groupBy("dataset").agg(F.count("*").alias("n"), have(F.coalesce(F.length("query") > 0, F.lit(False))).alias("with_query"), have(F.coalesce(F.size("gold") > 0, F.lit(False))).alias("with_gold"), have(F.col("formulation").isNotNull()).alias("with_formulation"))

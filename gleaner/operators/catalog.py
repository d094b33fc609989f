"""Catalog maintenance: verification, audits, merges and keyed upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SENSES = ("minimize", "maximize")


def searchable_text(name: Column, aliases: Column, description: Column) -> Column:
    """Name, aliases and description without empty parts, joined by spaces."""
    parts = F.concat(F.array(name), F.coalesce(aliases, F.array().cast("array<string>")), F.array(description))
    return F.array_join(F.filter(parts, lambda p: p.isNotNull() & (p != "")), " ")


def _issues(*pairs: tuple[Column, Column | str]) -> Column:
    made = F.array(*[F.when(bad, text if isinstance(text, Column) else F.lit(text)) for bad, text in pairs])
    return F.filter(made, lambda x: x.isNotNull())


def complete(formulation: Column, strict: bool = True) -> Column:
    """Variables, objective and constraints present; ``strict`` also wants constraints that are not empty."""
    f = formulation
    has = f.isNotNull() & (F.coalesce(F.size(f["variables"]), F.lit(0)) > 0) & f["objective"].isNotNull()
    return has & ((F.coalesce(F.size(f["constraints"]), F.lit(0)) > 0) if strict else f["constraints"].isNotNull())


def schema_errors() -> Column:
    """Errors of the top fields of a catalog entry."""
    blank = lambda c: F.col(c).isNull() | (F.trim(c) == "")
    return _issues((blank("id"), "missing id"), (blank("name"), "missing name"), (blank("description"), "missing description"), (F.col("formulation").isNull(), "missing formulation"))


def structure_errors() -> Column:
    """Errors of a formulation's parts."""
    f = F.col("formulation")
    return _issues(
        (F.coalesce(F.size(f["variables"]), F.lit(0)) <= 0, "variables must be a non-empty list"),
        (f["objective"].isNull(), "missing objective"),
        (f["objective"].isNotNull() & f["objective"]["sense"].isNull(), "objective without sense"),
        (f["objective"].isNotNull() & f["objective"]["expression"].isNull(), "objective without expression"),
        (f["constraints"].isNull(), "constraints must be a list"),
    )


def consistency_errors() -> Column:
    """Errors inside the parts: unknown sense, blank expressions, empty and repeated symbols, by index."""
    f = F.col("formulation")
    symbols = F.transform(f["variables"], lambda v: F.coalesce(F.trim(v["symbol"]), F.lit("")))
    empty = F.filter(F.transform(symbols, lambda s, i: F.when(s == "", F.concat(F.lit("empty symbol at "), i.cast("string")))), lambda x: x.isNotNull())
    repeated = F.filter(F.transform(symbols, lambda s, i: F.when((s != "") & (F.array_position(symbols, s) <= i), F.concat(F.lit("duplicate symbol "), s, F.lit(" at "), i.cast("string")))), lambda x: x.isNotNull())
    blank = F.filter(F.transform(f["constraints"], lambda c, i: F.when(F.coalesce(F.trim(c["expression"]), F.lit("")) == "", F.concat(F.lit("empty constraint at "), i.cast("string")))), lambda x: x.isNotNull())
    head = _issues((~F.lower(F.coalesce(f["objective"]["sense"], F.lit(""))).isin(*SENSES), "unknown sense"), (F.coalesce(F.trim(f["objective"]["expression"]), F.lit("")) == "", "empty objective"))
    none = F.array().cast("array<string>")
    return F.concat(head, F.coalesce(empty, none), F.coalesce(repeated, none), F.coalesce(blank, none))


def verify(problems: DataFrame) -> DataFrame:
    """id and the three error lists."""
    return problems.select("id", schema_errors().alias("schema_errors"), structure_errors().alias("structure_errors"), consistency_errors().alias("consistency_errors"))


def audit(base: DataFrame, extended: DataFrame) -> DataFrame:
    """severity, code, n: missing or stale catalogs, empty and incomplete entries."""
    n = base.agg(F.count("*").alias("n_base"), F.count_if(~complete(F.col("formulation"), strict=False)).alias("bad"))
    m = extended.agg(F.count("*").alias("n_ext"), F.count_if(~complete(F.col("formulation"), strict=False)).alias("bad_ext"))
    one = n.crossJoin(m)  # one row each
    rows = F.array(
        F.when(F.col("n_base") == 0, F.struct(F.lit("error").alias("severity"), F.lit("missing_base").alias("code"), F.lit(1).cast("long").alias("n"))),
        F.when(F.col("n_ext") < F.col("n_base"), F.struct(F.lit("warning").alias("severity"), F.lit("stale_extended").alias("code"), (F.col("n_base") - F.col("n_ext")).alias("n"))),
        F.when(F.col("bad_ext") > 0, F.struct(F.lit("info").alias("severity"), F.lit("incomplete").alias("code"), F.col("bad_ext").alias("n"))),
    )
    return one.select(F.explode(F.filter(rows, lambda r: r.isNotNull())).alias("r")).select("r.*")


def merge(sources: list[DataFrame], key: str = "id", *, last_wins: bool = False) -> DataFrame:
    """Union of sources, one row per key: that of the first source, or of the last."""
    tagged = [s.withColumn("__p", F.lit(-i if last_wins else i)) for i, s in enumerate(sources)]
    whole = tagged[0]
    for t in tagged[1:]:
        whole = whole.unionByName(t, allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy("__p", *[F.col(c) for c in whole.columns if c not in (key, "__p") and not whole.schema[c].dataType.simpleString().startswith("map")])
    return whole.filter(F.col(key).isNotNull()).withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r", "__p")


def fill_missing(base: DataFrame, found: DataFrame, key: str = "id") -> DataFrame:
    """``base`` with null fields filled from ``found``."""
    f = found.select(F.col(key), *[F.col(c).alias(f"__{c}") for c in found.columns if c != key])
    j = base.join(f, key, "left")
    return j.select(*[F.coalesce(c, f"__{c}").alias(c) if f"__{c}" in j.columns else F.col(c) for c in base.columns])


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``new`` rows, and the ``old`` ones whose keys are not in ``new``."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def resume(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows of ``todo`` not yet in ``done``."""
    return todo.join(done.select(key), key, "left_anti")


def problem_class(variables: Column) -> Column:
    """LP, ILP or MILP by the variables' domains; null without variables."""
    whole = lambda v: F.lower(F.coalesce(v["domain"], F.lit(""))).rlike("int|bin")
    return F.when(F.size(variables) <= 0, None).when(F.forall(variables, whole), "ILP").when(F.exists(variables, whole), "MILP").otherwise("LP")

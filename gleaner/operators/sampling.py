"""Splits, samples and training-row builders, all by hashes of keys."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T


def stratified_split(rows: DataFrame, key: str, stratum: str, *, train: float = 0.7, dev: float = 0.15, seed: int = 42) -> DataFrame:
    """``rows`` with split: per stratum the first floor(n train) and next floor(n dev) keys in hash order, the rest test; null keys leave."""
    w = Window.partitionBy(stratum)
    x = rows.filter(F.col(key).isNotNull()).withColumn("__h", T.draw(seed, F.col(key)))
    x = x.withColumn("__r", F.row_number().over(w.orderBy("__h", key))).withColumn("__n", F.count("*").over(w))
    a, b = F.floor(F.col("__n") * train), F.floor(F.col("__n") * dev)
    return x.withColumn("split", F.when(F.col("__r") <= a, "train").when(F.col("__r") <= a + b, "dev").otherwise("test")).drop("__h", "__r", "__n")


def leaks(split: DataFrame, content: str) -> DataFrame:
    """content values that stand in more than one split, with the splits' number."""
    return split.groupBy(content).agg(F.count_distinct("split").alias("n_splits")).filter("n_splits > 1")


def seeded_sample(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows, least hashes first."""
    return rows.withColumn("__h", T.draw(seed, F.col(key))).orderBy("__h", key).limit(n).drop("__h")


def diverse_selection(rows: DataFrame, key: str, slices: list[str], per_slice: int) -> DataFrame:
    """At most ``per_slice`` rows of every combination of slices, least keys first."""
    w = Window.partitionBy(*slices).orderBy(key)
    return rows.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= per_slice).drop("__r")


def synthetic_queries(names: DataFrame, templates: list[str], *, cap: int, seed: int = 42) -> DataFrame:
    """id, query: names put into templates (``{}``), duplicates dropped, the first ``cap`` per id in hash order."""
    made = names.select("id", F.explode(F.array(*[F.replace(F.lit(t), F.lit("{}"), F.col("name")) for t in templates])).alias("query")).distinct()
    w = Window.partitionBy("id").orderBy(T.draw(seed, F.col("id"), F.col("query")), "query")
    return made.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= cap).drop("__r")


def ranker_rows(slots: DataFrame, mentions: DataFrame, group: str) -> DataFrame:
    """Every slot with every mention of its group, with type, cue and overlap features."""
    # words and cues are read once per slot and once per mention, not once per pair
    cue = {"total": r"\b(total|budget|available|capacity|limit)\b", "unit": r"\b(per|each|per unit|per item)\b"}

    def read(df: DataFrame, text: str, mark: str) -> DataFrame:
        has = [F.coalesce(F.lower(text).rlike(p), F.lit(False)).alias(f"__{mark}_{k}") for k, p in cue.items()]
        return df.select("*", F.array_distinct(T.words(F.col(text))).alias(f"__{mark}_words"), *has)

    j = read(slots, "slot_name", "s").join(read(mentions, "context", "m"), group)
    slot, kind = F.col("slot_type"), F.col("kind")
    match = (
        F.when(slot.isNull() | (kind == "unknown"), 0).when(slot == kind, 1).when((slot == "currency") & kind.isin("int", "float"), 0).when((slot == "percent") & (kind != "percent"), -1).when(slot.isin("int", "float") & kind.isin("int", "float"), 1).otherwise(0)
    )
    either = lambda k: (F.col(f"__s_{k}") | F.col(f"__m_{k}")).cast("int")
    return (
        j.withColumn("feat_type_match", match)
        .withColumn("feat_total_like", either("total"))
        .withColumn("feat_per_unit_like", either("unit"))
        .withColumn("feat_overlap", F.least(F.lit(5), F.size(F.array_intersect("__s_words", "__m_words"))))
        .drop(*[f"__{m}_{k}" for m in "sm" for k in ("words", *cue)])
    )


def rule_score(cue: str | None = None):
    """2 type + 1.5 cue + 0.5 overlap, less 3 for a contrary cue."""
    c = F.col(cue) if cue else F.lit(0)
    return 2.0 * F.col("feat_type_match") + 1.5 * c + 0.5 * F.col("feat_overlap") - F.when(c == -1, 3.0).otherwise(0.0)


def best_per_slot(groups: DataFrame, kinds: DataFrame, slot: str, mention: Callable[[Column], Column]) -> DataFrame:
    """``groups`` and, for every slot, the columns of its best-scored kind and mention_id, ties by mention_id.

    ``kinds``: slot, score and more for every slot with every kind of mention, a small table.  Mentions of one kind score
    alike, so the one of the least id stands for them: ``mention`` makes its id of the kind and the group's columns.  No
    row moves, and pairs are never rows.
    """
    packed = kinds.groupBy(slot).agg(F.collect_list(F.struct(*kinds.columns)).alias("__k"))
    best = F.array_min(F.transform("__k", lambda k: F.struct((-F.round(k["score"], 9)).alias("o"), mention(k).alias("mention_id"), k.alias("k"))))
    x = groups.crossJoin(F.broadcast(packed)).select(*groups.columns, best.alias("__b"))  # a row a slot
    return x.select(*groups.columns, "__b.mention_id", "__b.k.*")


def pair_quality(groups: DataFrame) -> DataFrame:
    """One row: rows, label balance, groups without a positive or with several, duplicate rows; ``groups``: n, pos, dup of each."""
    return groups.agg(F.sum("n").alias("n_rows"), F.sum("pos").alias("n_positive"), F.count("*").alias("n_groups"), F.count_if(F.col("pos") == 0).alias("groups_without"), F.count_if(F.col("pos") > 1).alias("groups_with_several"), F.sum("dup").alias("n_duplicates"))


def feature_separation(rows: DataFrame, features: list[str], label: str, n: str) -> DataFrame:
    """feature, mean over positives and negatives, and their difference; ``n``: how many rows a row stands for."""
    packed = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("v")) for f in features])
    x = rows.select(F.col(label).alias("y"), F.col(n).alias("n"), F.explode(packed).alias("x"))
    mean = lambda y: F.sum(F.when(F.col("y") == y, F.col("x.v") * F.col("n"))) / F.sum(F.when((F.col("y") == y) & F.col("x.v").isNotNull(), F.col("n")))
    g = x.groupBy("x.feature").agg(mean(1).alias("mean_pos"), mean(0).alias("mean_neg"))
    return g.withColumn("separation", F.col("mean_pos") - F.col("mean_neg"))

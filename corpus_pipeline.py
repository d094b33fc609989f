"""Corpus pipeline: quality rules, near-duplicate join, decontamination, secret scan, tokens.

``STAGES`` are functions of (spark, docs, sf_dir); each works on all rows that its
predecessor kept, and is written as Parquet before the next one reads it.  All but the
last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm import op4_bpe, op5_jaccard, op6_secrets, op7_decontaminate, op9_quality, store


NEAR = {"width": 5, "num": 4, "den": 5}


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return op9_quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of the join: that of the least doc_id.

    Documents link from a Jaccard similarity of 4/5 over five-word shingles on; op5's own
    query has other values.  Rows with a null doc_id link with nothing and stay.  A doc_id
    that repeats stands for as many documents as it has texts, each judged by its own text and
    behind all doc_ids that do not repeat; of its rows with the same text one stays.
    """
    names = [f"`{c}`" for c in docs.columns]
    real = docs.filter("doc_id is not null")
    repeated = real.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id")
    once, out = real, docs.filter("doc_id is null")
    texts = real.select("doc_id", "text")
    if not repeated.isEmpty():
        last = real.agg(F.max("doc_id")).first()[0]
        several = texts.join(repeated, "doc_id", "left_semi").distinct().orderBy("doc_id", "text")
        several = store.table(several.withColumn("id", F.monotonically_increasing_id() + F.lit(last + 1)), "pipeline-repeated")
        once = real.join(repeated, "doc_id", "left_anti")
        texts = once.select("doc_id", "text").unionByName(several.select(F.col("id").alias("doc_id"), "text"))
    found = op5_jaccard.links(texts, **NEAR)
    first = store.table(found.filter("doc_id = component_id").select("doc_id"), "pipeline-first")
    out = out.unionByName(once.join(first, "doc_id", "left_semi").select(*names))
    if once is not real:
        kept = several.join(first, several["id"] == first["doc_id"], "left_semi").select("doc_id", "text")
        same = real.join(repeated, "doc_id", "left_semi").join(kept.select(F.col("doc_id").alias("__d"), F.col("text").alias("__t")), (F.col("doc_id") == F.col("__d")) & F.col("text").eqNullSafe(F.col("__t")), "left_semi")
        rest = F.struct(*[F.col(c) for c in names])
        one = same.groupBy(F.col("doc_id").alias("__d"), F.col("text").alias("__t")).agg(F.min_by(rest, F.to_json(rest)).alias("__r"))
        out = out.unionByName(one.select(*[F.col("__r")[c].alias(c) for c in docs.columns]))
    return out


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window."""
    bench = store.read(spark, sf_dir, "benchmark")
    return op7_decontaminate.clean(docs, bench)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark."""
    return op6_secrets.redact(docs, op6_secrets.train(op6_secrets.labelled_sample(spark)))


def bpe_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, ids and n_tokens of every document."""
    return op4_bpe.encode(docs, keep=["doc_id", "lang", "source"]).withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("bpe_tokens", bpe_tokens),
]

#: Components, added secret spans and token ids have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = store.read(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES:
        docs = store.table(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            store.drop(before)
        before = docs
    return docs

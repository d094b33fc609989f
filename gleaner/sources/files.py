"""Readers of query, catalog, gold and result files, with explicit schemas and tolerant modes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVAL = "query_id string, problem_id string, problem_index string, query string, relevant_doc_id string, doc_id string"
CATALOG = "id string, doc_id string, text string, description string, name string, aliases array<string>"
GOLD = "id string, parameters string, problem_info string, solution string"


def eval_queries(spark: SparkSession, path: str) -> DataFrame:
    """query_id, query (trimmed), relevant_doc_id of a JSON-lines file; malformed lines and rows without a query leave."""
    raw = spark.read.schema(EVAL).option("mode", "DROPMALFORMED").json(path)
    q = raw.select(F.coalesce("query_id", "problem_id", "problem_index").alias("query_id"), F.trim("query").alias("query"), F.coalesce("relevant_doc_id", "doc_id", "problem_id").alias("relevant_doc_id"))
    return q.filter(F.col("query").isNotNull())


def catalog(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, text of a JSON-lines catalog; rows without an id leave."""
    raw = spark.read.schema(CATALOG).option("mode", "DROPMALFORMED").json(path)
    return raw.select(F.coalesce("doc_id", "id").alias("doc_id"), F.coalesce("text", "description", F.lit("")).alias("text")).filter("doc_id is not null")


def guarded_catalog(spark: SparkSession, base: str, extended: str, schema: str) -> DataFrame:
    """The extended catalog (a JSON array), or the base one where the extended one is missing or has fewer rows."""
    read = lambda p: spark.read.schema(schema).option("multiLine", True).json(p)
    try:
        more = read(extended)
        return more if more.count() >= read(base).count() else read(base)
    except Exception as e:  # a path that is not there
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return read(base)


def gold(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, slot, value: scalar parameters of gold records, whose maps are JSON texts; what does not parse is left out."""
    raw = spark.read.schema(GOLD).option("mode", "DROPMALFORMED").json(path)
    m = raw.select(F.col("id").alias("doc_id"), F.from_json("parameters", "map<string,string>").alias("m"))
    return m.select("doc_id", F.explode("m").alias("slot", "raw")).select("doc_id", "slot", F.expr("try_cast(raw as double)").alias("value")).filter("value is not null")


def results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of CSV files with a header, with the file's name; unreadable rows leave."""
    return spark.read.schema(schema).option("header", True).option("mode", "DROPMALFORMED").csv(path).withColumn("file", F.regexp_extract(F.input_file_name(), r"([^/]+)\.csv", 1))


def texts(spark: SparkSession, path: str) -> DataFrame:
    """path, text of whole files, one row each."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))

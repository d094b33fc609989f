"""Operator 8: language of pages by Bayesian fusion of four kinds of evidence.

- the text: character trigram likelihoods per language, trained on documents of known
  language and tempered by ``TEMPER``, for the trigrams of a text are no independent
  witnesses;
- the language that the markup declares: its rate per language;
- the address suffix (last label of the host) and the host: a prior smoothed
  hierarchically, host towards its domain, domain towards its suffix, suffix towards all
  pages, each with a Dirichlet prior of ``PRIOR`` pages.  A page does not take part in its
  own prior: its share is taken out of every level.

All rates come from grouped sums of the pages' text likelihoods as responsibilities, so
every page counts, and counts are made before the shuffle.

Defined results.  Null or empty html: the text says nothing and the other evidence
decides.  Null url: no host, domain or suffix evidence beyond that of other such pages.
Undeclared languages are a value of their own.  Of languages with one probability the
first by name is taken.  Repeated rows count and are returned each.  Without training
documents every language is null.  Extra columns are ignored.

Scale.  Hosts, domains and suffixes are summed in tasks first, so a host with a third of
all pages sends one row per task; their tables are joined back by key, where Spark splits a
skewed host.  The trigram table has ``TRIGRAMS`` rows per language, and training takes
about ``TRAIN_ROWS`` documents of every language, those whose hash is below its bound.
"""

from __future__ import annotations

import html as _html
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import store

TRAIN_ROWS, TRIGRAMS = 2_000, 8_000
TEMPER, PRIOR = 0.2, 5.0
_GAP = re.compile(r"[\W\d_]+")
_RAW = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style)\b[^>]*>.*?(?:</\1\s*>|\Z)", re.S | re.I)
_TAG = re.compile(r"<[^>]*>")


def trigrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Codes of a text's letter trigrams, words with a space at both ends, and their counts."""
    c = np.frombuffer(f" {_GAP.sub(' ', text.lower()).strip()} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    if len(c) < 3:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    g = (c[:-2] << 42) | (c[1:-1] << 21) | c[2:]
    return np.unique(g[c[1:-1] != 32], return_counts=True)


def train(docs: DataFrame, most: int = TRAIN_ROWS) -> tuple[list[str], dict[int, list[float]]]:
    """Languages, and the log-likelihoods of trigrams in each; -1 holds those of unseen ones.

    Fitted on about ``most`` documents of every language, chosen by a hash of the row; equal rows are one.
    """
    known = docs.filter("lang is not null and text is not null").select("text", "lang", F.xxhash64("doc_id", "text").alias("h"))
    sizes = docs.filter("lang is not null and text is not null").groupBy("lang").agg(F.count("*").alias("rows"))  # a row a language
    part = known.join(F.broadcast(sizes), "lang").filter(F.pmod("h", F.lit(1 << 31)) < F.least(F.lit(1.0), most / F.col("rows")) * float(1 << 31))

    def run(batches):
        for batch in batches:
            seen: dict[str, Counter] = {}
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                g, n = trigrams(text or "")
                seen.setdefault(lang, Counter()).update(dict(zip(g.tolist(), n.tolist(), strict=True)))
            rows = [(lang, g, n) for lang, c in seen.items() for g, n in c.items()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [[]] * 3, [pa.string(), pa.int64(), pa.int64()], strict=True)], names=["lang", "g", "n"])

    sample = part.dropDuplicates(["lang", "h"])
    counts = sample.select("text", "lang").mapInArrow(run, "lang string, g long, n long").groupBy("lang", "g").agg(F.sum("n").alias("n"))
    by: dict[str, dict[int, int]] = {}
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "g")  # tasks keep their first TRIGRAMS of a language before the shuffle
    for r in counts.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= TRIGRAMS).collect():
        by.setdefault(r["lang"], {})[r["g"]] = r["n"]
    langs = sorted(by)
    grams = {g for c in by.values() for g in c}
    total = {lang: sum(by[lang].values()) for lang in langs}
    size = len(grams) + 1
    like = {g: [math.log((by[lang].get(g, 0) + 0.5) / (total[lang] + 0.5 * size)) for lang in langs] for g in grams}
    like[-1] = [math.log(0.5 / (total[lang] + 0.5 * size)) for lang in langs]
    return langs, like


def evidence(pages: DataFrame, langs: list[str], like: dict[int, list[float]]) -> DataFrame:
    """page_id, url, host, domain, suffix, declared and text (log-likelihoods by language, tempered, best 0)."""
    shared = pages.sparkSession.sparkContext.broadcast(like)  # at most TRIGRAMS rows a language
    k = len(langs)
    url = F.coalesce(F.col("url"), F.lit(""))
    host = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    labels = F.split(host, r"\.")
    base = pages.select(
        "page_id",
        "url",
        host.alias("host"),
        F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), F.lit(2)), ".").alias("domain"),
        F.element_at(labels, -1).alias("suffix"),
        F.lower(F.regexp_extract(F.coalesce("html", F.lit("")), r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([a-zA-Z]{2,3})", 1)).alias("declared"),
        F.coalesce("html", F.lit("")).alias("html"),
    )
    schema = base.drop("html").schema.add("text", T.ArrayType(T.DoubleType()))

    def run(batches):
        codes = np.array(sorted(shared.value), np.int64)  # the unseen come first
        table = np.array([shared.value[g] for g in codes.tolist()]).reshape(len(codes), k)
        for batch in batches:
            out = []
            for at in range(0, len(batch), 200):
                for page in batch.column("html").slice(at, 200).to_pylist():
                    g, n = trigrams(_html.unescape(_TAG.sub(" ", _RAW.sub(" ", page))))
                    if not len(g) or not k:
                        out.append([0.0] * k)
                        continue
                    i = np.minimum(np.searchsorted(codes, g), len(codes) - 1)
                    sums = TEMPER * (n @ table[np.where(codes[i] == g, i, 0)])
                    out.append((sums - sums.max()).tolist())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in schema.names[:-1]], pa.array(out, pa.list_(pa.float64()))], names=schema.names)

    return base.mapInArrow(run, schema)


def _share(text: Column, k: int) -> list[Column]:
    """Responsibilities of the languages by text alone."""
    e = [F.exp(F.element_at(text, i + 1)) for i in range(k)]
    whole = sum(e[1:], e[0])
    return [F.round(x / whole, 6).cast("decimal(20,6)") for x in e]  # decimal sums do not depend on their order


def fuse(found: DataFrame, langs: list[str]) -> DataFrame:
    """page_id, url, declared, host, lang and its probability."""
    k = len(langs)
    if not k:
        return found.select("page_id", "url", "declared", "host", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("probability"))
    share = found.select("host", "domain", "suffix", "declared", *[s.alias(f"s{i}") for i, s in enumerate(_share(F.col("text"), k))])
    totals = lambda df, by, p: df.groupBy(*by).agg(*[F.sum(f"s{i}").alias(f"{p}{i}") for i in range(k)])
    hosts = store.table(totals(share, ["host", "domain", "suffix"], "s"), "op8-hosts")
    top = hosts.agg(*[F.sum(f"s{i}") for i in range(k)]).first()
    whole = [float(x or 0) for x in top]
    level = hosts.select("host", "domain", "suffix", *[F.col(f"s{i}").alias(f"h{i}") for i in range(k)])
    level = level.join(totals(hosts, ["domain", "suffix"], "d"), ["domain", "suffix"]).join(totals(hosts, ["suffix"], "t"), "suffix")
    said = totals(share, ["declared"], "c")
    own = _share(F.col("text"), k)
    j = found.select("page_id", "url", "declared", "host", "domain", "suffix", "text", *[o.alias(f"o{i}") for i, o in enumerate(own)])
    j = j.join(level, ["host", "domain", "suffix"]).join(said, "declared")
    # all pages, the suffix, the domain, the host: each level leans on the one above it, and none knows the page itself
    prior = [(F.lit(whole[i]) - F.col(f"o{i}") + 1) / (sum(whole) - 1 + k) for i in range(k)]
    for p in "tdh":
        rest = [(F.col(f"{p}{i}") - F.col(f"o{i}")).cast("double") for i in range(k)]
        n = sum(rest[1:], rest[0])
        j = j.select("*", *[((rest[i] + PRIOR * prior[i]) / (n + PRIOR)).alias(f"p{p}{i}") for i in range(k)])
        prior = [F.col(f"p{p}{i}") for i in range(k)]
    logs = [F.element_at("text", i + 1) + F.log(prior[i]) + F.log((F.col(f"c{i}").cast("double") + 1) / (whole[i] + 1)) for i in range(k)]
    j = j.select("page_id", "url", "declared", "host", F.array(*logs).alias("logs"))
    best = F.array_max("logs")
    names = F.array(*[F.lit(x) for x in langs])
    weight = F.aggregate("logs", F.lit(0.0), lambda s, x: s + F.exp(x - best))
    return j.select("page_id", "url", "declared", "host", F.element_at(names, F.array_position("logs", best).cast("int")).alias("lang"), F.round(1 / weight, 6).alias("probability"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    langs, like = train(store.read(spark, sf_dir, "documents"))
    return fuse(store.table(evidence(store.read(spark, sf_dir, "pages"), langs, like), "op8-evidence"), langs)

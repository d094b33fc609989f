"""Queries over documents as the catalog and benchmark items as the queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import metrics as M
from ..operators import names as N
from ..operators import retrieval as R
from ..session import table


def _inputs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, d, "documents").select("doc_id", "text")
    queries = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return R.spread(docs), queries


def relevant(docs: DataFrame, queries: DataFrame, width: int = 6) -> DataFrame:
    """query_id, doc_id where the document contains the whole query.

    Candidates share the query's words 2 to ``width`` + 1 in a row, found by an equi-join of word windows;
    containment is then checked on the candidates only.  Queries too short for a window are found by
    their rarest grams.
    """
    w = F.split(F.col("query"), " ")
    asked = queries.withColumn("k", F.xxhash64(F.array_join(F.slice(w, 2, width), " ")))
    long = asked.filter(F.size(w) >= width + 2)
    d = docs.select("doc_id", F.split("text", " ").alias("d"))  # kept as a column: the windows below read it once
    d = d.select("doc_id", "d", F.size("d").alias("n")).filter(F.col("n") >= width)
    windows = F.transform(F.sequence(F.lit(1), F.col("n") - (width - 1)), lambda i: F.xxhash64(F.concat_ws(" ", *[F.element_at("d", i + j) for j in range(width)])))
    pairs = d.select("doc_id", F.explode(windows).alias("k")).join(long.select("k", "query_id", "query"), "k").select("doc_id", "query_id", "query").distinct()
    found = pairs.join(docs, "doc_id").filter(F.contains("text", F.col("query"))).select("query_id", "doc_id")
    short = queries.filter(F.size(w) < width + 2)
    if short.isEmpty():
        return found
    held = N.containing(short, docs, "query", "text").join(docs, "text").join(short.withColumnRenamed("query", "needle"), "needle").select("query_id", "doc_id")
    blank = docs.join(F.broadcast(short.filter("query = ''").groupBy().agg(F.collect_list("query_id").alias("ids"))), F.col("text").isNotNull()).select(F.explode("ids").alias("query_id"), "doc_id")  # an empty query is in every text
    return found.unionByName(held).unionByName(blank).distinct()


def tfidf_topk(spark, d):
    return R.tfidf(*_inputs(spark, d)).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


def tfidf_top1(spark, d):
    return R.tfidf(*_inputs(spark, d), k=1).select("query_id", "doc_id", F.round("score", 6).alias("score"))


def bm25_topk(spark, d):
    return R.bm25(*_inputs(spark, d)).select("query_id", "doc_id", F.round("score", 5).alias("score"), "rank")


def rrf_hybrid(spark, d):
    docs, queries = _inputs(spark, d)
    return R.reciprocal_rank_fusion(R.bm25(docs, queries), R.tfidf(docs, queries), pool=10).select("query_id", "doc_id", F.round("score", 8).alias("score"), "rank")


def retrieval_metrics(spark, d):
    docs, queries = _inputs(spark, d)
    ranks = M.rank_of_gold(R.tfidf(docs, queries), relevant(docs, queries))
    m = M.ranking_metrics(ranks)
    return m.select("n", *[F.round(c, 6).alias(c) for c in m.columns if c != "n"])


def failure_modes(spark, d):
    docs, queries = _inputs(spark, d)
    ranks = M.rank_of_gold(R.tfidf(docs, queries), relevant(docs, queries)).join(queries, "query_id")
    return ranks.select(M.failure_mode(F.col("rank"), T.has_number(F.col("query"))).alias("mode")).groupBy("mode").agg(F.count("*").alias("n"))


def sanitize_ablation(spark, d):
    docs, queries = _inputs(spark, d)
    gold = relevant(docs, queries)
    kinds = {"baseline": F.col("query"), "no_numbers": T.without_numbers(F.col("query")), "stopword_stripped": T.without_stop_words(F.col("query")), "both": T.without_stop_words(T.without_numbers(F.col("query")))}
    # all variants are ranked in one plan: a query's id carries its variant
    packed = queries.select(F.explode(F.array(*[F.struct(F.concat_ws("|", F.lit(k), F.col("query_id").cast("string")).alias("query_id"), v.alias("query")) for k, v in kinds.items()])).alias("x")).select("x.*")
    ranked = R.tfidf(docs, packed, k=10)
    ranked = ranked.select(F.substring_index("query_id", "|", 1).alias("variant"), F.substring_index("query_id", "|", -1).cast("bigint").alias("query_id"), "doc_id", "rank")
    hit = ranked.join(gold, ["query_id", "doc_id"]).groupBy("variant", "query_id").agg(F.min("rank").alias("rank"))
    asked = gold.select("query_id").distinct().crossJoin(spark.createDataFrame([(k,) for k in kinds], "variant string"))  # four variants
    return M.ranking_metrics(asked.join(hit, ["variant", "query_id"], "left"), (1, 10), ["variant"]).select("variant", "n", F.round("recall_1", 6).alias("recall_1"), F.round("mrr", 6).alias("mrr"))


def score_margin(spark, d):
    ranked = R.tfidf(*_inputs(spark, d), k=2)
    return R.margin(ranked).select("query_id", F.round("margin", 6).alias("margin"), "ambiguous")


def minmax_norm(spark, d):
    return R.min_max(R.tfidf(*_inputs(spark, d), k=5)).select("query_id", "doc_id", F.round("scaled", 5).alias("scaled"))


def slot_entropy(spark, d):
    return R.entropy(R.tfidf(*_inputs(spark, d), k=5)).select("query_id", "n", F.round("entropy", 5).alias("entropy"))


def lexical_rerank(spark, d):
    docs, queries = _inputs(spark, d)
    return R.lexical_rerank(R.tfidf(docs, queries, k=5), docs, queries).select("query_id", "doc_id", F.round("score", 5).alias("score"), "rank")


def overlap_stats(spark, d):
    docs, queries = _inputs(spark, d)
    pair = R.tfidf(docs, queries, k=1).join(docs, "doc_id").join(queries, "query_id")
    a, b = T.overlap_tokens(F.col("query")), T.overlap_tokens(F.col("text"))
    return pair.select("query_id", F.round(T.overlap_ratio(a, b), 6).alias("overlap"), F.round(T.jaccard(a, b), 6).alias("jaccard"))


def overlap_buckets(spark, d):
    s = overlap_stats(spark, d).withColumn("bucket", F.when(F.col("jaccard") < 0.05, "low").when(F.col("jaccard") < 0.15, "mid").otherwise("high"))
    return s.groupBy("bucket").agg(F.count("*").alias("n"), F.round(F.avg("overlap"), 6).alias("mean_overlap"), F.min("overlap").alias("min_overlap"), F.max("overlap").alias("max_overlap"))


def length_num_strata(spark, d):
    docs = table(spark, d, "documents")
    n_tok = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    x = docs.select("lang", T.length_bucket(n_tok).alias("length_bucket"), T.count_bucket(F.size(T.numbers(F.col("text")))).alias("count_bucket"))
    return x.groupBy("lang", "length_bucket", "count_bucket").agg(F.count("*").alias("n"))


def dense_topk(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", "embedding")
    q = v.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return R.dense(v, q, k=5).select("query_id", "doc_id", F.round("score", 5).alias("score"))


def knn_label_precision(spark, d):
    e = table(spark, d, "embeddings")
    q = e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    near = R.dense(e.select("vec_id", "embedding"), q, k=6).filter("query_id <> doc_id")
    a, b = e.select(F.col("vec_id").alias("query_id"), F.col("label").alias("want")), e.select(F.col("vec_id").alias("doc_id"), "label")
    return near.join(b, "doc_id").join(a, "query_id").groupBy("want").agg(F.count("*").alias("n"), F.round(F.avg((F.col("label") == F.col("want")).cast("double")), 6).alias("precision"))


def short_query_expansion(spark, d):
    q = table(spark, d, "part").select("p_partkey", F.col("p_name").alias("q"))
    return q.select("p_partkey", T.expand_short_query(F.col("q")).alias("expanded"))


def lsa_topk(spark, d):
    return R.lsa(*_inputs(spark, d), k=5).select("query_id", "doc_id", F.round("score", 4).alias("score"), "rank")


_TFIDF = r"""
tok AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), lambda x: length(x) >= 2) AS w FROM documents),
post AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM tok) GROUP BY ALL),
idf AS (SELECT term, ln((1 + (SELECT count(*) FROM documents)) / (1 + count(*))) + 1 AS idf FROM post GROUP BY term),
raw AS (SELECT doc_id, term, tf * idf AS w FROM post JOIN idf USING (term)),
dn AS (SELECT doc_id, sqrt(sum(w * w)) AS dn FROM raw GROUP BY doc_id),
qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest(list_filter(regexp_extract_all(lower(query), '[\p{L}\p{N}_]+'), lambda x: length(x) >= 2)) AS term FROM q) GROUP BY ALL),
qw AS (SELECT query_id, term, qtf * idf AS w FROM qt JOIN idf USING (term)),
qn AS (SELECT query_id, sqrt(sum(w * w)) AS qn FROM qw GROUP BY query_id),
sc AS (SELECT query_id, doc_id, sum(qw.w / qn * raw.w / dn) AS score FROM qw JOIN qn USING (query_id) JOIN raw USING (term) JOIN dn USING (doc_id) GROUP BY ALL),
tfidf AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM sc)"""
_Q = "q AS (SELECT item_id AS query_id, text AS query FROM benchmark)"
_BM25 = r"""
btok AS (SELECT doc_id, list_filter(string_split_regex(regexp_replace(lower(text), '[^a-z0-9\s]', ' ', 'g'), '\s+'), lambda x: x <> '') AS w FROM documents),
bpost AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM btok) GROUP BY ALL),
blen AS (SELECT doc_id, len(w) AS len FROM btok),
bdf AS (SELECT term, ln(((SELECT count(*) FROM documents) - count(*) + 0.5) / (count(*) + 0.5)) AS raw FROM bpost GROUP BY term),
bidf AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM bdf) ELSE raw END AS idf FROM bdf),
bq AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest(list_filter(string_split_regex(regexp_replace(lower(query), '[^a-z0-9\s]', ' ', 'g'), '\s+'), lambda x: x <> '')) AS term FROM q) GROUP BY ALL),
bsc AS (SELECT query_id, doc_id, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / (SELECT avg(len) FROM blen)))) AS score FROM bq JOIN bidf USING (term) JOIN bpost USING (term) JOIN blen USING (doc_id) GROUP BY ALL),
bm25 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM bsc)"""
_GOLD = "gold AS (SELECT DISTINCT query_id, doc_id FROM q JOIN documents ON contains(text, query))"
_RANKS = "ranks AS (SELECT g.query_id, min(rank) FILTER (WHERE rank <= 10) AS rank FROM gold g LEFT JOIN tfidf t ON g.query_id = t.query_id AND g.doc_id = t.doc_id GROUP BY g.query_id)"
_STOP = "[" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + "]"
_OVER = f"""{_Q}, {_TFIDF}, ov AS (SELECT query_id, list_distinct(regexp_extract_all(lower(query), '[a-z]+')) AS a, list_distinct(regexp_extract_all(lower(text), '[a-z]+')) AS b FROM tfidf JOIN documents USING (doc_id) JOIN q USING (query_id) WHERE rank = 1),
os AS (SELECT query_id, round(CASE WHEN len(a) > 0 THEN len(list_intersect(a, b)) / len(a) ELSE 0 END, 6) AS overlap, round(CASE WHEN len(a) + len(b) > 0 THEN len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))) ELSE 0 END, 6) AS jaccard FROM ov)"""
_NN = """unit AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
nn AS (SELECT a.vec_id AS query_id, b.vec_id AS doc_id, a.label AS want, b.label, list_cosine_similarity(a.e, b.e) AS score FROM unit a JOIN unit b ON a.vec_id % 50 = 0),
nr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM nn)"""


def _expansion_sql() -> str:
    cases = " ".join("WHEN list_has_any(t, [" + ", ".join(f"'{w}'" for w in keys) + f"]) THEN '{text}'" for keys, text in T.DOMAIN_CONTEXT)
    return rf"""WITH x AS (SELECT p_partkey, trim(p_name) AS q, regexp_extract_all(lower(p_name), '[a-z0-9]+') AS t FROM part)
SELECT p_partkey, CASE WHEN q = '' OR len(string_split_regex(q, '\s+')) > 5 THEN q ELSE q || ' ' || CASE {cases} ELSE '{T.GENERIC_CONTEXT}' END END AS expanded FROM x"""


_ABLATION = rf"""WITH base AS (SELECT item_id, text FROM benchmark),
nn AS (SELECT item_id, text, trim(regexp_replace(regexp_replace(text, '[$]?\d[\d,]*(?:\.\d+)?%?', ' ', 'g'), '\s+', ' ', 'g')) AS clean FROM base),
q AS (SELECT 'baseline|' || item_id AS query_id, text AS query FROM nn UNION ALL SELECT 'no_numbers|' || item_id, clean FROM nn
  UNION ALL SELECT 'stopword_stripped|' || item_id, array_to_string(list_filter(string_split_regex(trim(text), '\s+'), lambda w: NOT list_contains({_STOP}, lower(w))), ' ') FROM nn
  UNION ALL SELECT 'both|' || item_id, array_to_string(list_filter(string_split_regex(trim(clean), '\s+'), lambda w: NOT list_contains({_STOP}, lower(w))), ' ') FROM nn),
{_TFIDF}, gold AS (SELECT DISTINCT item_id, doc_id FROM base b JOIN documents d ON contains(d.text, b.text)),
v AS (SELECT unnest(['baseline', 'no_numbers', 'stopword_stripped', 'both']) AS variant),
r AS (SELECT variant, item_id, min(rank) FILTER (WHERE rank <= 10) AS rank FROM v CROSS JOIN gold LEFT JOIN tfidf t ON t.query_id = variant || '|' || item_id AND t.doc_id = gold.doc_id GROUP BY ALL)
SELECT variant, count(*) AS n, round(avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0 END), 6) AS recall_1, round(avg(coalesce(1 / rank, 0)), 6) AS mrr FROM r GROUP BY variant"""

QUERIES = {
    f.__name__: f
    for f in (
        tfidf_top1, tfidf_topk, bm25_topk, rrf_hybrid, retrieval_metrics, failure_modes, sanitize_ablation, score_margin, minmax_norm, slot_entropy, lexical_rerank,
        overlap_stats, overlap_buckets, length_num_strata, dense_topk, knn_label_precision, short_query_expansion, lsa_topk,
    )
}

_M = ", ".join(f"round(avg(CASE WHEN rank <= {k} THEN 1.0 ELSE 0 END), 6) AS recall_{k}, round(avg(CASE WHEN rank <= {k} THEN 1 / log2(rank + 1) ELSE 0 END), 6) AS ndcg_{k}" for k in (1, 5, 10))
ORACLES = {
    "tfidf_top1": f"WITH {_Q}, {_TFIDF} SELECT query_id, doc_id, round(score, 6) AS score FROM tfidf WHERE rank = 1",
    "tfidf_topk": f"WITH {_Q}, {_TFIDF} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM tfidf WHERE rank <= 10",
    "bm25_topk": f"WITH {_Q}, {_BM25} SELECT query_id, doc_id, round(score, 5) AS score, rank FROM bm25 WHERE rank <= 10",
    "rrf_hybrid": f"""WITH {_Q}, {_TFIDF}, {_BM25},
f AS (SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(a.rank, 11) AS ra, coalesce(b.rank, 11) AS rb
  FROM (SELECT * FROM bm25 WHERE rank <= 10) a FULL JOIN (SELECT * FROM tfidf WHERE rank <= 10) b ON a.query_id = b.query_id AND a.doc_id = b.doc_id),
g AS (SELECT *, 1 / (60 + ra) + 1 / (60 + rb) AS score FROM f), h AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, rb, doc_id) AS rank FROM g)
SELECT query_id, doc_id, round(score, 8) AS score, rank FROM h WHERE rank <= 10""",
    "retrieval_metrics": f"WITH {_Q}, {_TFIDF}, {_GOLD}, {_RANKS} SELECT count(*) AS n, round(avg(coalesce(1 / rank, 0)), 6) AS mrr, {_M} FROM ranks",
    "failure_modes": rf"WITH {_Q}, {_TFIDF}, {_GOLD}, {_RANKS} SELECT CASE WHEN rank IS NULL OR rank > 1 THEN 'retrieval_miss' WHEN regexp_matches(query, '\b\d+(?:\.\d+)?\b') THEN 'param_extraction_needed' ELSE 'success' END AS mode, count(*) AS n FROM ranks JOIN q USING (query_id) GROUP BY 1",
    "sanitize_ablation": _ABLATION,
    "score_margin": f"WITH {_Q}, {_TFIDF}, m AS (SELECT query_id, max(score) FILTER (WHERE rank = 1) - max(score) FILTER (WHERE rank = 2) AS margin FROM tfidf WHERE rank <= 2 GROUP BY query_id) SELECT query_id, round(margin, 6) AS margin, coalesce(margin < 0.05, false) AS ambiguous FROM m",
    "minmax_norm": f"WITH {_Q}, {_TFIDF}, m AS (SELECT *, min(score) OVER w AS lo, max(score) OVER w AS hi FROM tfidf WHERE rank <= 5 WINDOW w AS (PARTITION BY query_id)) SELECT query_id, doc_id, round(CASE WHEN hi - lo <= 1e-12 THEN 1.0 ELSE (score - lo) / (hi - lo) END, 5) AS scaled FROM m",
    "slot_entropy": f"WITH {_Q}, {_TFIDF}, m AS (SELECT query_id, score / sum(score) OVER (PARTITION BY query_id) AS p FROM tfidf WHERE rank <= 5) SELECT query_id, count(*) AS n, round(CASE WHEN count(*) > 1 THEN sum(CASE WHEN p > 0 THEN -p * ln(p) ELSE 0 END) / ln(count(*)) ELSE 0 END, 5) AS entropy FROM m GROUP BY query_id",
    "lexical_rerank": f"""WITH {_Q}, {_TFIDF}, m AS (SELECT *, min(score) OVER w AS lo, max(score) OVER w AS hi FROM tfidf WHERE rank <= 5 WINDOW w AS (PARTITION BY query_id)),
x AS (SELECT m.query_id, m.doc_id, CASE WHEN hi - lo <= 1e-12 THEN 1.0 ELSE (score - lo) / (hi - lo) END AS scaled, list_distinct(regexp_extract_all(lower(query), '[a-z0-9]+')) AS a, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS b FROM m JOIN documents USING (doc_id) JOIN q USING (query_id)),
y AS (SELECT query_id, doc_id, 0.7 * scaled + 0.3 * CASE WHEN len(a) > 0 THEN len(list_intersect(a, b)) / len(a) ELSE 0 END AS score FROM x)
SELECT query_id, doc_id, round(score, 5) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM y""",
    "overlap_stats": f"WITH {_OVER} SELECT * FROM os",
    "overlap_buckets": f"WITH {_OVER} SELECT CASE WHEN jaccard < 0.05 THEN 'low' WHEN jaccard < 0.15 THEN 'mid' ELSE 'high' END AS bucket, count(*) AS n, round(avg(overlap), 6) AS mean_overlap, min(overlap) AS min_overlap, max(overlap) AS max_overlap FROM os GROUP BY 1",
    "length_num_strata": r"""WITH x AS (SELECT lang, len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')) AS n, len(regexp_extract_all(text, '[$]?\d[\d,]*(?:\.\d+)?%?')) AS c FROM documents)
SELECT lang, CASE WHEN n <= 25 THEN '0-25' WHEN n <= 50 THEN '26-50' WHEN n <= 100 THEN '51-100' WHEN n <= 150 THEN '101-150' ELSE '151+' END AS length_bucket,
  CASE WHEN c <= 0 THEN '0' WHEN c <= 2 THEN '1-2' WHEN c <= 5 THEN '3-5' WHEN c <= 10 THEN '6-10' ELSE '11+' END AS count_bucket, count(*) AS n FROM x GROUP BY ALL""",
    "dense_topk": f"WITH {_NN} SELECT query_id, doc_id, round(score, 5) AS score FROM nr WHERE rank <= 5",
    "knn_label_precision": f"WITH {_NN} SELECT want, count(*) AS n, round(avg((label = want)::INT), 6) AS precision FROM nr WHERE rank <= 6 AND query_id <> doc_id GROUP BY want",
    "short_query_expansion": _expansion_sql(),
}

"""Retrieval: an inverted index as a postings table, and rankers as joins on terms.

Queries never meet documents in a cross product: a query's terms join the postings, so
only pairs that share a term exist.  Terms that no query has are dropped before their
postings meet queries; document frequencies come from each document's distinct terms, so
tasks add them up before the shuffle, and lengths are those of the token arrays.  Norms need
all terms of a document.

What moves.  :func:`spread` deals texts by document once; postings, norms and scores of a document
are then made where it lies.  The idf of all terms and the terms of the queries are written
as small tables first, so that their sizes are known when the joins are planned: below Spark's
threshold they are broadcast, and postings do not move; above it postings are shuffled once by term.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..session import parts, saved, scratch

K1, B, EPSILON = 1.5, 0.75, 0.25
RRF = 60


def spread(docs: DataFrame, by: str = "doc_id") -> DataFrame:
    """``docs`` dealt by document over all cores: what is grouped by document afterwards does not move again."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return docs.repartition(cores if docs.rdd.getNumPartitions() < cores else parts(docs.sparkSession), by)


def postings(docs: DataFrame, tokens: Column, doc: str = "doc_id") -> DataFrame:
    """doc_id, term, tf."""
    return docs.select(F.col(doc).alias("doc_id"), F.explode(tokens).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))


def query_terms(queries: DataFrame, tokens: Column, query: str = "query_id") -> DataFrame:
    """query_id, term, qtf (how often the query has the term)."""
    return postings(queries, tokens, query).select(F.col("doc_id").alias("query_id"), "term", F.col("tf").alias("qtf"))


def frequencies(docs: DataFrame, tokens: Column) -> DataFrame:
    """term, df: documents that have the term."""
    return docs.select(F.explode(F.array_distinct(tokens)).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def asked_postings(docs: DataFrame, tokens: Column, asked: DataFrame) -> DataFrame:
    """doc_id, len, term, tf of the terms that queries have; ``asked``: query_id, term, qtf."""
    words = docs.select("doc_id", tokens.alias("w")).select("doc_id", F.size("w").alias("len"), F.explode("w").alias("term"))
    return words.join(asked.select("term").distinct(), "term", "left_semi").groupBy("doc_id", "len", "term").agg(F.count("*").alias("tf"))


def top_k(scored: DataFrame, k: int, by: str = "query_id", doc: str = "doc_id", digits: int | None = 9) -> DataFrame:
    """The best ``k`` per query with their rank; ties by document, so plans never disagree."""
    if k <= 0:
        return scored.limit(0).withColumn("rank", F.lit(0))
    score = F.round("score", digits) if digits is not None else F.col("score")
    w = Window.partitionBy(by).orderBy(score.desc(), F.col(doc))
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def bm25(docs: DataFrame, queries: DataFrame, *, k: int = 10, k1: float = K1, b: float = B, epsilon: float = EPSILON) -> DataFrame:
    """query_id, doc_id, score, rank. ``docs``: doc_id, text; ``queries``: query_id, query.

    idf is ln((N - df + 0.5) / (df + 0.5)); a negative one becomes epsilon times the mean idf of all terms.
    """
    tokens = T.bm25_tokens(F.col("text"))
    asked = query_terms(queries, T.bm25_tokens(F.col("query")))
    all_docs = docs.select(F.size(tokens).alias("len")).agg(F.count("*").alias("n_docs"), F.avg("len").alias("avg_len"))
    df = saved(frequencies(docs, tokens).crossJoin(F.broadcast(all_docs)), "bm25-df")  # one row
    idf = df.withColumn("raw", F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    mean = idf.agg(F.avg("raw").alias("mean_idf"))
    idf = idf.crossJoin(F.broadcast(mean)).select("term", "avg_len", F.when(F.col("raw") < 0, epsilon * F.col("mean_idf")).otherwise(F.col("raw")).alias("idf"))  # one row
    asked = saved(asked.join(idf, "term"), "bm25-asked")
    hit = asked_postings(docs, tokens, asked).join(asked, "term")
    tf = F.col("tf")
    part = F.col("qtf") * F.col("idf") * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    return top_k(hit.groupBy("query_id", "doc_id").agg(F.sum(part).alias("score")), k)


def tfidf_weights(docs: DataFrame, tokens: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(doc_id, term, weight of unit length), (term, idf) with idf = ln((1 + N) / (1 + df)) + 1."""
    post = postings(docs, T.tfidf_tokens(F.col("text")) if tokens is None else tokens)
    idf = post.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(docs.agg(F.count("*").alias("n_docs"))))  # one row
    idf = idf.select("term", (F.log((1 + F.col("n_docs")) / (1 + F.col("df"))) + 1).alias("idf"))
    raw = post.join(idf, "term").select("doc_id", "term", (F.col("tf") * F.col("idf")).alias("w"))
    norm = raw.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norm, "doc_id").select("doc_id", "term", (F.col("w") / F.col("norm")).alias("weight")), idf


def tfidf(docs: DataFrame, queries: DataFrame, *, k: int = 10) -> DataFrame:
    """query_id, doc_id, score (cosine), rank."""
    tokens = T.tfidf_tokens(F.col("text"))
    n_docs = docs.count()
    idf_of = lambda df: F.log((1 + F.lit(n_docs)) / (1 + df)) + 1
    idf = saved(postings(docs, tokens).groupBy("term").agg(F.count("*").alias("df")).select("term", "df", idf_of(F.col("df")).alias("idf")), "tfidf-idf")
    asked = query_terms(queries, T.tfidf_tokens(F.col("query"))).join(idf, "term").select("query_id", "term", (F.col("qtf") * F.col("idf")).alias("w"))
    norm = asked.groupBy("query_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("qn"))
    asked = saved(asked.join(norm, "query_id").select("query_id", "term", (F.col("w") / F.col("qn")).alias("qw")), "tfidf-asked")
    # a document's norm needs all of its terms, its scores only those that queries have: one pass gives both;
    # terms of one document, most of all terms, have one idf and are not looked up
    w = F.col("tf") * F.coalesce("idf", idf_of(F.lit(1)))
    known = asked.select("term").distinct().withColumn("__asked", F.lit(True))
    idf = saved(idf.join(known, "term", "left").filter(F.col("__asked") | (F.col("df") > 1)).drop("df"), "tfidf-terms")
    raw = postings(docs, tokens).join(idf, "term", "left").select("doc_id", "term", w.alias("w"), "__asked")
    per = raw.filter("doc_id is not null").groupBy("doc_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), F.collect_list(F.when(F.col("__asked"), F.struct("term", "w"))).alias("x"))
    hit = per.select("doc_id", "norm", F.explode("x").alias("x")).select("doc_id", F.col("x.term").alias("term"), (F.col("x.w") / F.col("norm")).alias("weight")).join(asked, "term")
    return top_k(hit.groupBy("query_id", "doc_id").agg(F.sum(F.col("qw") * F.col("weight")).alias("score")), k)


def reciprocal_rank_fusion(first: DataFrame, second: DataFrame, *, pool: int, k: int = 10, c: int = RRF) -> DataFrame:
    """Two rankings as one: 1/(c + rank) summed; who is missing in one ranks behind its pool; ties by the second rank."""
    a = first.select("query_id", "doc_id", F.col("rank").alias("ra"))
    b = second.select("query_id", "doc_id", F.col("rank").alias("rb"))
    j = a.join(b, ["query_id", "doc_id"], "full_outer").fillna(pool + 1, ["ra", "rb"])
    j = j.withColumn("score", 1 / (c + F.col("ra")) + 1 / (c + F.col("rb")))
    w = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "rb", "doc_id")
    return j.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "doc_id", "score", "rank")


def dense(vectors: DataFrame, queries: DataFrame, *, k: int = 10, block: int = 20_000) -> DataFrame:
    """Cosine top-k of query vectors over all vectors, as products of blocks.

    ``vectors``: vec_id, embedding; ``queries``: query_id, embedding; of one length.  Both sides are cut into blocks of
    about ``block`` rows; every pair of blocks is one product in one task, which gives on its ``k`` best of
    each query, so neither side is sent whole to a task and scores of pairs are never rows.  Rows with a null id or vector,
    null components or a norm of zero match nothing.
    """
    norm = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, y: s + y.cast("double") * y.cast("double")))

    def blocks(df: DataFrame, id_: str) -> tuple[DataFrame, int]:
        x = df.select(id_, F.transform("embedding", lambda y: y.cast("double")).alias("v")).filter(F.col(id_).isNotNull()).withColumn("n", norm(F.col("v"))).filter("n > 0")
        n = max(1, -(-df.count() // block))
        # the norm is bound to a variable, as a column inside the lambda would be worked out for each component
        unit = F.element_at(F.transform(F.array("n"), lambda n: F.transform("v", lambda y: y / n)), 1)
        return x.select(id_, unit.alias("v"), F.pmod(F.xxhash64(id_), F.lit(n)).cast("int").alias("__b")), n

    (v, n_v), (q, n_q) = blocks(vectors, "vec_id"), blocks(queries, "query_id")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = q.select("query_id", "v", F.col("__b").alias("__q"), every(n_v).alias("__v"))
    right = v.select("vec_id", "v", every(n_q).alias("__q"), F.col("__b").alias("__v"))

    def product(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(asked) and len(held):
            ids, m = held["vec_id"].to_numpy(), np.stack(held["v"].to_numpy())
            take = min(k, len(ids))
            for at in range(0, len(asked), 256):  # so that the scores of a product stay small
                part = asked.iloc[at : at + 256]
                scores = np.stack(part["v"].to_numpy()) @ m.T
                rounded = np.round(scores, 9)
                least = np.partition(rounded, len(ids) - take, axis=1)[:, len(ids) - take]
                for i, query in enumerate(part["query_id"].to_numpy()):
                    near = np.flatnonzero(rounded[i] >= least[i])
                    near = near[np.lexsort((ids[near], -rounded[i][near]))][:take]
                    out.append(pd.DataFrame({"query_id": query, "doc_id": ids[near], "score": scores[i][near]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "doc_id": [], "score": []})

    if k <= 0:
        return top_k(left.select("query_id", F.lit(None).cast(vectors.schema["vec_id"].dataType).alias("doc_id"), F.lit(0.0).alias("score")), k)
    kinds = f"query_id {queries.schema['query_id'].dataType.simpleString()}, doc_id {vectors.schema['vec_id'].dataType.simpleString()}, score double"
    best = left.groupBy("__q", "__v").cogroup(right.groupBy("__q", "__v")).applyInPandas(product, kinds)
    return top_k(best, k)


def margin(ranked: DataFrame, least: float = 0.05) -> DataFrame:
    """query_id, margin between the first two scores (null with fewer), ambiguous where it is below ``least``."""
    first = lambda r: F.max(F.when(F.col("rank") == r, F.col("score")))
    return ranked.groupBy("query_id").agg((first(1) - first(2)).alias("margin")).withColumn("ambiguous", F.coalesce(F.col("margin") < least, F.lit(False)))


def min_max(ranked: DataFrame) -> DataFrame:
    """Scores scaled to [0, 1] inside each query; a span of 1e-12 or less gives 1."""
    w = Window.partitionBy("query_id")
    lo, hi = F.min("score").over(w), F.max("score").over(w)
    return ranked.withColumn("scaled", F.when(hi - lo <= 1e-12, F.lit(1.0)).otherwise((F.col("score") - lo) / (hi - lo)))


def entropy(ranked: DataFrame) -> DataFrame:
    """query_id, n, entropy of the scores' shares over ln n: 0 for one candidate."""
    w = Window.partitionBy("query_id")
    p = F.col("score") / F.sum("score").over(w)
    part = ranked.withColumn("p", p).groupBy("query_id").agg(F.count("*").alias("n"), F.sum(F.when(F.col("p") > 0, -F.col("p") * F.log("p")).otherwise(0.0)).alias("h"))
    return part.select("query_id", "n", F.when(F.col("n") > 1, F.col("h") / F.log(F.col("n").cast("double"))).otherwise(F.lit(0.0)).alias("entropy"))


def lexical_rerank(ranked: DataFrame, docs: DataFrame, queries: DataFrame, *, share: float = 0.7) -> DataFrame:
    """``share`` of the scaled score and the rest of the tokens' overlap; new rank."""
    q = queries.select("query_id", T.rerank_tokens(F.col("query")).alias("qt"))
    d = docs.select("doc_id", "text")
    j = min_max(ranked).join(d, "doc_id").join(q, "query_id")
    mixed = share * F.col("scaled") + (1 - share) * T.overlap_ratio(F.col("qt"), T.rerank_tokens(F.col("text")))
    return top_k(j.select("query_id", "doc_id", mixed.alias("score")), 1 << 30)


#: Extension point: a ranker maps (docs, queries, k) to query_id, doc_id, score, rank.
RANKERS = {"bm25": lambda d, q, k: bm25(d, q, k=k), "tfidf": lambda d, q, k: tfidf(d, q, k=k)}


def ranker(name: str):
    if name not in RANKERS:
        raise ValueError(f"unknown ranker {name!r}; one of {sorted(RANKERS)}")
    return RANKERS[name]


def grams(words: Column) -> Column:
    """Words and pairs of neighbouring words."""
    n = F.greatest(F.size(words) - 1, F.lit(0))
    return F.concat(words, F.zip_with(F.slice(words, F.lit(1), n), F.slice(words, F.lit(2), n), lambda a, b: F.concat_ws(" ", a, b)))


def lsa(docs: DataFrame, queries: DataFrame, *, k: int = 10, rank: int = 256, blocks: int = 32, more: int = 10, rounds: int = 5) -> DataFrame:
    """Latent semantic ranking: truncated SVD of the tf-idf matrix A of all words and word pairs, ranked by cosine.

    Subspace iteration on A A' from a start drawn by doc_id; ``doc_id`` is an integer.  Terms of one document
    add only to the diagonal.  The others are dealt to ``blocks``, or as many as there are cores if that is fewer, since
    the subspace moves once for each: a task multiplies its block's columns with all rows of the subspace and back, so
    terms are never sent out.  Terms are told by 64-bit hashes.  Only matrices of ``rank`` + ``more`` rows
    and columns reach the driver.  With A = U S V', a query's place q V is (q A') U / S, whose first factor is
    a join on terms.  A task holds the subspace's rows of all documents.
    """
    import numpy as np
    import pyarrow as pa
    spark, top, made = docs.sparkSession, scratch(docs.sparkSession, "lsa"), []
    blocks = min(blocks, spark.sparkContext.defaultParallelism)

    def keep(df):
        """``df`` as a Parquet table: lineage ends here."""
        made.append(f"{top}/{len(made)}")
        df.write.parquet(made[-1])
        return spark.read.schema(df.schema).parquet(made[-1])

    def drop(*paths):
        for x in paths:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(x)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

    n = docs.count()
    split = docs.select("doc_id", T.tfidf_tokens(F.col("text")).alias("w"))
    hashed = lambda w: F.transform(grams(w), lambda t: F.xxhash64(t))
    post = keep(postings(split, hashed(F.col("w"))).withColumnRenamed("term", "t"))
    idf = keep(post.groupBy("t").agg(F.count("*").alias("df")).select("t", "df", (F.log((1 + F.lit(n)) / (1 + F.col("df"))) + 1).alias("idf")))
    cells = keep(post.join(idf, "t").filter("doc_id is not null").select("doc_id", "t", (F.col("tf") * F.col("idf")).alias("w"), "df"))
    square = F.col("w") * F.col("w")
    alone = keep(cells.groupBy("doc_id").agg(F.sqrt(F.sum(square)).alias("norm"), (F.coalesce(F.sum(F.when(F.col("df") == 1, square)), F.lit(0.0)) / F.sum(square)).alias("own")))
    shared = keep(cells.filter("df > 1").join(alone, "doc_id").select(F.pmod("t", F.lit(blocks)).cast("int").alias("block"), "t", "doc_id", (F.col("w") / F.col("norm")).alias("weight")))
    none = dense(docs.select(F.col("doc_id").alias("vec_id"), F.array().cast("array<double>").alias("embedding")).limit(0), queries.select("query_id", F.array().cast("array<double>").alias("embedding")).limit(0), k=k)
    rank = min(rank, n - 1, idf.count())
    width = min(max(rank, 1) + more, n)
    if cells.isEmpty():
        drop(top)
        return none
    rank = max(rank, 1)

    # rows of the subspace move as bytes: Spark copies them whole, where it would turn an array over number by number
    def rows(column):
        return np.frombuffer(b"".join(column.to_pylist())).reshape(len(column), -1) if len(column) else np.zeros((0, width))

    def packed(m):
        m = np.ascontiguousarray(m, np.float64)
        return pa.array([x.tobytes() for x in m], pa.binary())

    def lists(m):
        m = np.ascontiguousarray(m, np.float64)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * m.shape[1], pa.int32()), pa.array(m.ravel()))

    def start(batches):
        for b in batches:
            m = [np.random.default_rng(i & (1 << 63) - 1).standard_normal(width) for i in b.column("doc_id").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("own"), packed(np.array(m).reshape(-1, width))], names=["doc_id", "own", "q"])

    def product(left, right):
        out = ["doc_id", "y"]
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.binary())], names=out)
        ids = right.column("doc_id").to_numpy()
        q, order = rows(right.column("q")), np.argsort(ids)
        t = left.column("t").to_numpy()
        by = np.argsort(t, kind="stable")
        t, w, at = t[by], left.column("weight").to_numpy()[by], order[np.searchsorted(ids[order], left.column("doc_id").to_numpy()[by])]
        ends = np.concatenate((np.flatnonzero(t[1:] != t[:-1]) + 1, [len(t)])).tolist()
        y, a = np.zeros_like(q), 0
        for b in ends:  # a term at once: the rows of its documents, which are distinct, stay in the cache on both ways
            d, v = at[a:b], w[a:b]
            y[d] += np.multiply.outer(v, v @ q.take(d, 0))
            a = b
        hit = np.unique(at)
        return pa.table([pa.array(ids[hit]), packed(y[hit])], names=out)

    def added(batches):
        sums: dict = {}
        for b in batches:
            for i, y in zip(b.column("doc_id").to_pylist(), rows(b.column("y")), strict=True):
                if i in sums:
                    sums[i] += y
                else:
                    sums[i] = y.copy()
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), packed(list(sums.values()))], names=["doc_id", "y"])

    def closed(batches):
        for b in batches:
            q, own = rows(b.column("q")), b.column("own").to_numpy(zero_copy_only=False)
            y = rows(b.column("y").fill_null(bytes(8 * width)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("own"), b.column("q"), packed(y + q * own[:, None])], names=["doc_id", "own", "q", "y"])

    def times(q):
        """doc_id, own, q, y = A A' q."""
        far = q.select("doc_id", "q", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
        part = shared.groupBy("block").cogroup(far.groupBy("block")).applyInArrow(product, "doc_id long, y binary")
        y = part.repartition("doc_id").mapInArrow(added, "doc_id long, y binary")
        return q.join(y, "doc_id", "left").select("doc_id", "own", "q", "y").mapInArrow(closed, "doc_id long, own double, q binary, y binary")

    def cross(df, a, b):
        """The matrix a' b, of fixed size."""

        def run(batches):
            g = np.zeros((width, width))
            for x in batches:
                g += rows(x.column(a)).T @ rows(x.column(b))
            yield pa.RecordBatch.from_arrays([pa.array([g.tobytes()], pa.binary())], names=["g"])

        return sum(np.frombuffer(r["g"]).reshape(width, width) for r in df.mapInArrow(run, "g binary").collect())

    def turned(df, a, m, name="q"):
        """``df`` with ``a`` times m, columns that m lacks being 0."""
        full = np.zeros((width, width))
        full[:, : m.shape[1]] = m

        def run(batches):
            for x in batches:
                yield pa.RecordBatch.from_arrays([x.column("doc_id"), x.column("own"), packed(rows(x.column(a)) @ full)], names=["doc_id", "own", name])

        return df.mapInArrow(run, f"doc_id long, own double, {name} binary")

    def orthogonal(df, a):
        e, v = np.linalg.eigh(cross(df, a, a))
        ok = e > e[-1] * 1e-13
        return turned(df, a, v[:, ok] / np.sqrt(e[ok]))

    q = keep(alone.select("doc_id", "own").mapInArrow(start, "doc_id long, own double, q binary"))
    q = keep(orthogonal(q, "q"))
    for _ in range(rounds):
        q = keep(orthogonal(keep(times(q)), "y"))
        drop(*made[-4:-2])  # what the last round read is not needed again
    y = keep(times(q))
    e, v = np.linalg.eigh(cross(y, "q", "y"))
    e, v = e[::-1][:rank], v[:, ::-1][:, :rank]
    e, v = e[e > e[0] * 1e-10], v[:, e > e[0] * 1e-10]
    s, u = np.sqrt(e), keep(turned(y, "q", v, "u"))
    size = len(s)

    asked = query_terms(queries.select("query_id", T.tfidf_tokens(F.col("query")).alias("w")), hashed(F.col("w"))).withColumnRenamed("term", "t").join(idf, "t").select("query_id", "t", (F.col("qtf") * F.col("idf")).alias("qw"))
    met = asked.join(cells, "t").groupBy("doc_id", "query_id").agg(F.sum(F.col("qw") * F.col("w")).alias("s")).join(alone, "doc_id").select("doc_id", "query_id", (F.col("s") / F.col("norm")).alias("s"))
    met = met.groupBy("doc_id").agg(F.collect_list("query_id").alias("ids"), F.collect_list("s").alias("s")).join(u, "doc_id")

    def folded(batches):
        sums: dict = {}
        for b in batches:
            for ids, c, x in zip(b.column("ids").to_pylist(), b.column("s").to_pylist(), rows(b.column("u")), strict=True):
                for i, v in zip(ids, c, strict=True):
                    sums[i] = sums.get(i, 0.0) + v * x[:size]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), id_type), lists(np.array(list(sums.values())).reshape(-1, size))], names=["query_id", "x"])

    id_type = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[queries.schema["query_id"].dataType.simpleString()]
    part = met.select("ids", "s", "u").mapInArrow(folded, f"query_id {queries.schema['query_id'].dataType.simpleString()}, x array<double>")
    place = part.select("query_id", F.posexplode("x").alias("i", "v")).groupBy("query_id", "i").agg(F.sum("v").alias("v")).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("i", "v"))).alias("x"))
    scale = F.array(*[F.lit(float(x)) for x in s])
    place = place.select("query_id", F.zip_with("x", scale, lambda a, b: a["v"] / b).alias("embedding"))

    def scaled(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), lists(rows(b.column("u"))[:, :size] * s)], names=["vec_id", "embedding"])

    here = u.select("doc_id", "u").mapInArrow(scaled, "vec_id long, embedding array<double>")
    found = keep(dense(here, place, k=k))
    drop(*made[:-1])
    return found

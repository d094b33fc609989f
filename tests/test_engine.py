"""Operators of the engine against hand-computed values, invariants and DuckDB on small tables."""

import itertools
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from gleaner import plans
from gleaner.functions import mentions as X
from gleaner.functions import text as T
from gleaner.operators import assign as G
from gleaner.operators import catalog as C
from gleaner.operators import compare, metrics, retrieval, sampling, stats
from gleaner.sources import adapters, files, parsers
from gleaner.streaming import logs

DATA = "/root/testdata/sf0.001"


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_text_scalars(spark):
    assert one(spark, T.bm25_tokens(F.lit("A-b, C2  d!"))) == ["a", "b", "c2", "d"]
    assert one(spark, T.tfidf_tokens(F.lit("Über a bc_d 1"))) == ["über", "bc_d"]
    assert one(spark, F.array_join(T.identifier_words(F.lit("TotalCO2Limit_max3")), " ")) == "total co 2 limit max 3"
    assert one(spark, T.numbers(F.lit("$1,200.50 and 5% of 3"))) == ["$1,200.50", "5%", "3"]
    for name, kind in (("TaxRate", "percent"), ("RateMachine1", "float"), ("NumTypes", "int"), ("TotalBudget", "currency"), ("feet", "currency"), ("NumberOfWorkers", "int"), ("MaxCapacity", "float")):
        assert one(spark, T.slot_type(F.lit(name))) == kind, name
    assert one(spark, T.expand_short_query(F.lit("TSP ILP"))) == "TSP ILP traveling salesman problem TSP tour shortest circuit optimization"
    assert one(spark, T.expand_short_query(F.lit("  "))) == ""
    assert one(spark, T.expand_short_query(F.lit("one two three four five six"))) == "one two three four five six"
    assert one(spark, T.relative_error(F.lit(0.5), F.lit(0.1))) == pytest.approx(0.4)


def test_mentions(spark):
    get = lambda q: [(m["value"], m["kind"]) for m in one(spark, X.mentions_of(F.lit(q).cast("string"), masked=True))]
    assert get("a budget of $1,500 and 20% margin") == [(1500.0, "currency"), (0.2, "percent")]
    assert get("two hundred fifty items") == [(250.0, "int")]
    assert get("twenty-five percent of them") == [(0.25, "percent")]
    assert get("three thousand five hundred units") == [(3500.0, "int")]
    assert get("one half of the <num> units, twice as many") == [(1.0, "int"), (0.5, "percent"), (None, "unknown"), (2.0, "percent")]
    assert get("CO2 of x3y and 5000. or (7)") == [(5000.0, "int")]  # a token is a number as a whole or not at all
    assert get("two million three hundred thousand and five, thousand") == [(2_300_000.0, "int"), (5000.0, "int")]
    assert get("zero hundred or hundred") == [(100.0, "int"), (100.0, "int")] and get("nineteen ninety-nine") == [(118.0, "int")]
    assert get("0.3 rate, 5 percent, five per cent, double-sided") == [(0.3, "percent"), (0.05, "percent"), (0.05, "percent")]
    assert one(spark, X.mentions_of(F.lit("<num> units")))  == []
    assert get(None) == get("") == []
    lists = lambda q: [tuple(x) for x in one(spark, X.enumeration_counts(F.lit(q)))]
    assert lists("apples, bananas, and grapes or phones and laptops") == [(3, "apples, bananas, and grapes"), (2, "phones and laptops")]
    assert lists("10 apples, 20 pears, and 80 plums; labor hours, and total budget") == [(3, "10 apples, 20 pears, and 80 plums")]


def test_retrieval_contract(spark):
    docs = spark.createDataFrame([(1, "knapsack packing items weight"), (2, "vehicle routing depot"), (3, "blending diet mix")], "doc_id long, text string")
    q = spark.createDataFrame([(7, "packing a knapsack"), (8, "depot routing"), (9, "unseen words")], "query_id long, query string")
    for name in ("bm25", "tfidf"):
        best = {r.query_id: r.doc_id for r in retrieval.ranker(name)(docs, q, 1).collect()}
        assert best == {7: 1, 8: 2}
        assert retrieval.ranker(name)(docs, q, 0).count() == 0
        assert retrieval.ranker(name)(docs.limit(0), q, 3).count() == 0
    with pytest.raises(ValueError):
        retrieval.ranker("none")


def test_ranking_metrics(spark):
    ranks = spark.createDataFrame([(1, 1), (2, 2), (3, 3), (4, None)], "query_id long, rank int")
    m = metrics.ranking_metrics(ranks).first()
    assert m.mrr == pytest.approx((1 + 1 / 2 + 1 / 3) / 4) and m.recall_1 == 0.25 and m.recall_5 == 0.75 and m.ndcg_5 == pytest.approx((1 + 1 / 1.584962500721156 + 0.5) / 4)


def test_statistics_known_answers(spark):
    for s, n, lo, hi in ((13, 18, 0.491269, 0.875004), (18, 18, 0.824115, 1.0), (8, 11, 0.434350, 0.902541)):
        a, b = stats.wilson(F.lit(s), F.lit(n), 1.96)
        assert one(spark, a) == pytest.approx(lo, abs=1e-6) and one(spark, b) == pytest.approx(hi, abs=1e-6)
    for b, c, p in ((4, 2, 0.6875), (1, 5, 0.21875), (0, 8, 0.0078125), (15, 3, 0.0075)):
        assert one(spark, stats.mcnemar(F.lit(b), F.lit(c))) == pytest.approx(p, abs=5e-5)
    assert one(spark, stats.mcnemar(F.lit(0), F.lit(0))) is None
    v = spark.createDataFrame([(i, float(i % 2)) for i in range(40)], "key long, value double")
    r = stats.bootstrap_ci(v).first()
    assert r.lo <= r["mean"] <= r.hi and r == stats.bootstrap_ci(v.repartition(3)).first()
    same = spark.createDataFrame([(i, 1, 1) for i in range(9)], "key long, a int, b int")
    assert stats.paired_bootstrap(same, reps=20).first().p == 0.0


def test_split_is_disjoint_and_stable(spark):
    rows = spark.createDataFrame([(i, f"s{i % 3}") for i in range(100)] + [(None, "s1"), (900, None)], "id long, source string")
    a = {r.id: r.split for r in sampling.stratified_split(rows, "id", "source").collect()}
    assert len(a) == 101 and a == {r.id: r.split for r in sampling.stratified_split(rows.repartition(7), "id", "source").collect()}
    assert a[900] == "test" and set(a.values()) == {"train", "dev", "test"}
    assert a != {r.id: r.split for r in sampling.stratified_split(rows, "id", "source", seed=1).collect()}


def total(scores, a):
    return sum(scores[i][j] for i, j in a.items())


def test_assignment_kernels_are_exact():
    random.seed(3)
    for _ in range(150):
        n, m = random.randint(0, 5), random.randint(1, 5)
        s = [[random.choice([G.IMPOSSIBLE, -1.0, 0.0, random.uniform(0, 5)]) for _ in range(m)] for _ in range(n)]
        best = max((sum(max(0.0, s[i][j]) for i, j in enumerate(p) if j is not None) for p in itertools.product([*range(m), None], repeat=n) if len([j for j in p if j is not None]) == len({j for j in p if j is not None})), default=0.0)
        for kernel in (G.hungarian, G.bitmask):
            a = kernel(s)
            assert len(set(a.values())) == len(a) and total(s, a) == pytest.approx(best)
        assert total(s, G.greedy_best_first(s)) <= best + 1e-9
        b = G.beam(s)
        assert len(set(b.values())) == len(b)


def test_typed_greedy_and_modes(spark):
    slots = [{"slot_name": "TotalBudget", "slot_type": "currency", "words": ["total", "budget"]}, {"slot_name": "DiscountRate", "slot_type": "percent", "words": ["discount", "rate"]}]
    found = [{"raw": "5%", "value": 0.05, "kind": "percent"}, {"raw": "$900", "value": 900.0, "kind": "currency"}]
    assert G.typed_greedy(slots, found) == {0: 1, 1: 0} and G.typed_greedy(slots, []) == {} and G.typed_greedy([], found) == {}
    low = [{"words": ["min", "load"]}, {"words": ["max", "load"]}]
    assert G.swap_bounds(low, [{"value": 9}, {"value": 2}], {0: 0, 1: 1}) == {0: 1, 1: 0}
    df = spark.createDataFrame([(1, slots, found), (2, slots, []), (3, [], found)], "query_id long, slots array<struct<slot_name:string,slot_type:string,words:array<string>>>, mentions array<struct<raw:string,value:double,kind:string>>")
    got = {(r.mode, r.slot_name): r.value for r in G.assign(df).collect()}
    assert all(got[m, "TotalBudget"] == 900.0 for m in G.MODES if m != "untyped")
    with pytest.raises(ValueError):
        G.assign(df, ["none"])


def test_catalog(spark):
    schema = "id string, name string, description string, formulation struct<variables:array<struct<symbol:string,domain:string>>,objective:struct<sense:string,expression:string>,constraints:array<struct<expression:string>>>"
    rows = [("a", "A", "d", ([("x", "int"), ("x", "int"), ("", "real")], ("min", " "), [("",)])), ("b", "", "d", None), ("c", "C", "d", ([("x", "real")], ("maximize", "x"), []))]
    got = {r.id: r for r in C.verify(spark.createDataFrame(rows, schema)).collect()}
    assert got["a"].consistency_errors == ["unknown sense", "empty objective", "empty symbol at 2", "duplicate symbol x at 1", "empty constraint at 0"]
    assert got["b"].schema_errors == ["missing name", "missing formulation"] and got["c"].structure_errors == []
    df = spark.createDataFrame(rows, schema)
    assert {r.id: r.k for r in df.select("id", C.complete(F.col("formulation")).alias("k")).collect()} == {"a": True, "b": False, "c": False}
    a, b = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string"), spark.createDataFrame([(2, "B"), (3, "c")], "id int, v string")
    assert sorted(map(tuple, C.merge([a, b]).collect())) == [(1, "a"), (2, "b"), (3, "c")]
    assert sorted(map(tuple, C.merge([a, b], last_wins=True).collect())) == [(1, "a"), (2, "B"), (3, "c")]
    assert sorted(map(tuple, C.upsert(a, b, ["id"]).collect())) == [(1, "a"), (2, "B"), (3, "c")]
    assert [r.id for r in C.resume(a, b, "id").collect()] == [1]


def test_compare(spark):
    rows = spark.createDataFrame([(1, 5.0), (1, 3.0), (1, 5.0), (2, 4.0)], "g int, v double")
    assert sorted(((r.g, r.v, r.other) for r in compare.margin_over_others(rows, "g", "v").collect()), key=repr) == [(1, 3.0, 5.0), (1, 5.0, 5.0), (1, 5.0, 5.0), (2, 4.0, None)]


def test_adapters_and_files(spark, tmp_path):
    p = tmp_path / "q.jsonl"
    p.write_text("\n".join([json.dumps({"problem_id": "p1", "query": " hi "}), "{broken", json.dumps({"query_id": "q2", "query": "x", "relevant_doc_id": "d"}), ""]))
    got = sorted((r.query_id, r.query, r.relevant_doc_id) for r in files.eval_queries(spark, str(p)).collect())
    assert got == [("p1", "hi", "p1"), ("q2", "x", "d")]
    df = spark.createDataFrame([("1", ("text here", ("k", "s", "dom")), "m")], "id string, input struct<description:string,metadata:struct<identifier:string,source:string,domain:string>>, model_mzn string")
    r = adapters.internal(df, "text2zinc").first()
    assert (r.id, r.query, r.schema_id, r.formulation, r.gold) == ("k", "text here", "dom", "m", None)
    assert len(adapters.ADAPTERS) == 17 and adapters.capabilities(spark).count() == 17
    with pytest.raises(ValueError):
        adapters.internal(df, "none")


def test_parsers(spark):
    m = parsers.mps("NAME t\nROWS\n N obj\n L c1\n G c2\n E c3\nCOLUMNS\n    x c1 1\n    M1 'MARKER' 'INTORG'\n    y c1 1\n    z c2 1\n    M2 'MARKER' 'INTEND'\nBOUNDS\n UP b y 1\n BV b x\nENDATA\n")
    assert m == {"name": "t", "n_variables": 3, "n_constraints": 3, "n_integer": 2, "n_binary": 1, "n_less": 1, "n_greater": 1, "n_equal": 1}
    nb = parsers.notebook(json.dumps({"cells": [{"cell_type": "markdown", "source": ["# T\n\n", "A paragraph that is certainly longer than forty characters.\n\n$$x+y$$"]}, {"cell_type": "code", "source": "x=1"}]}))
    assert nb == {"n_code": 1, "formulas": ["x+y"], "paragraphs": ["A paragraph that is certainly longer than forty characters."]}
    assert parsers.notebook("not json")["n_code"] == 0
    r = parsers.rst("Title\n=====\n\nFirst words\nhere.\n\n.. math::\n\n   a + b\n")
    assert r == {"title": "Title", "description": "First words here.", "math": ["a + b"]}


def test_stream_counts_match_batch(spark, tmp_path):
    src, out = tmp_path / "log", tmp_path / "out"
    src.mkdir()
    line = lambda q: json.dumps({"ts": "2024-01-01T00:00:00Z", "query": q, "top_k": 3, "results": [{"id": "a", "name": "A", "score": 0.5}]})
    (src / "1.jsonl").write_text("\n".join([line("x"), line(" "), "{bad", line("Y")]))
    logs.upsert_batches(logs.read_log(spark, str(src), stream=True), str(out), str(tmp_path / "cp")).awaitTermination()
    (src / "2.jsonl").write_text("\n".join([line("x"), line("y")]))
    logs.upsert_batches(logs.read_log(spark, str(src), stream=True), str(out), str(tmp_path / "cp")).awaitTermination()
    got = {r["query"]: r["n"] for r in logs.current(spark, str(out)).collect()}
    assert got == {"x": 2, "y": 2} == {r["query"]: r["n"] for r in logs.query_counts(logs.read_log(spark, str(src))).collect()}
    assert logs.returned_counts(logs.read_log(spark, str(src))).first().n == 4


@pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables are not here")
@pytest.mark.parametrize("name", ["tfidf_top1", "bm25_topk", "rrf_hybrid", "retrieval_metrics", "bottleneck_flags", "dist_stats", "mcnemar_by_source", "ranker_eval", "margin_over_others", "untyped_greedy"])
def test_queries_against_duckdb(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    df = plans.queries()[name](spark, DATA)
    r = con.execute(plans.oracle_sql()[name])
    names = [x[0] for x in r.description]
    norm = lambda row: tuple(round(float(v), 5) if isinstance(v, (int, float)) and not isinstance(v, bool) else v for v in row)
    assert sorted(map(repr, (norm(x[c] for c in names) for x in df.collect()))) == sorted(repr(norm(x)) for x in r.fetchall())


def test_mcnemar_of_large_counts(spark):
    from math import comb

    for b, c in ((700, 650), (5000, 5200), (3, 4000), (0, 1), (2000, 2000)):
        n, k = b + c, min(b, c)
        tail = sum(comb(n, i) for i in range(k + 1))
        exact = min(1.0, 2 * (tail * 10**30 // 2**n) / 10**30)
        assert one(spark, stats.mcnemar(F.lit(b), F.lit(c))) == pytest.approx(exact, abs=1e-9)


def test_retrieval_moves_texts_once(spark):
    """Postings, norms and scores are made where a document lies: no exchange by document but the first."""
    from gleaner.operators import retrieval as R

    docs = R.spread(spark.createDataFrame([(i, f"w{i % 3} w{i % 5} common t{i}") for i in range(40)], "doc_id long, text string"))
    queries = spark.createDataFrame([(1, "w1 common common"), (2, "t7 w2"), (3, "nowhere")], "query_id long, query string")
    for ranked in (R.tfidf(docs, queries), R.bm25(docs, queries)):
        plan = ranked._jdf.queryExecution().executedPlan().toString()
        assert [x for x in plan.splitlines() if "Exchange hashpartitioning(doc_id" in x and "REPARTITION" not in x] == []
        assert {q for q, *_ in ranked.select("query_id").collect()} == {1, 2}
    one = R.tfidf(docs, queries, k=1).filter("query_id = 2").first()
    assert one["doc_id"] == 7  # a term of one document counts


def test_mentions_that_score_alike_are_scored_once(spark):
    from gleaner.operators import linking as L

    rows = [(q, f"m{i % 2}", float(v), k, ["number", "least"]) for q in (1, 2) for i, (v, k) in enumerate([(3, "int"), (7, "int"), (7, "int"), (60, "int"), (99, "int"), (20, "int"), (5, "float")][: 7 - q])]
    m = spark.createDataFrame(rows, "query_id long, mention_id string, value double, kind string, context array<string>")
    kinds = L.alike(m, ["query_id"])
    assert kinds.agg(F.sum("n")).first()[0] == len(rows) and kinds.count() < len(rows)
    slots = spark.createDataFrame([(q, s) for q in (1, 2) for s in ("NumberOfItems", "MinDemand")], "query_id long, slot_name string")
    every = L.ambiguity(L.links(m, slots), ["query_id", "slot_name"]).orderBy("query_id", "slot_name").collect()
    once = L.ambiguity(L.links(kinds.select("query_id", "n", "k.*"), slots), ["query_id", "slot_name"], "n").orderBy("query_id", "slot_name").collect()
    assert len(every) == 4 and [(r.n, r.ambiguous) for r in every] == [(r.n, r.ambiguous) for r in once]
    assert [x for r in every for x in (r.margin, r.entropy)] == pytest.approx([x for r in once for x in (r.margin, r.entropy)])

"""Registered queries use every row of their tables, against brute force on small ones."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest

from gleaner import plans
from gleaner.functions import roles as R
from gleaner.operators import assign as G
from gleaner.operators import retrieval
from gleaner.plans import roles, searches

#: Order 1 has more than two lines, order 2 none of the first two, order 3 a repeated line number.
LINES = [(1, n, 10 * n, 100.0 * n + 1, float(7 * n), n / 100) for n in range(1, 8)] + [(2, 4, 5, 50.0, 8.0, 0.04), (2, 6, 6, 60.0, 3.0, 0.06)] + [(3, 1, 1, 20.0, 2.0, 0.02), (3, 1, 2, 30.0, 60.0, 0.03)]
LINE = "l_orderkey long, l_linenumber int, l_partkey long, l_extendedprice double, l_quantity double, l_discount double"
TYPES = {"UnitPrice": "currency", "NumberOfItems": "int", "DiscountRate": "percent", "TotalWeight": "float"}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("lines"))
    spark.createDataFrame(LINES, LINE).write.parquet(f"{d}/lineitem.parquet")
    spark.createDataFrame([(1,), (2,), (3,)], "o_orderkey long").write.parquet(f"{d}/orders.parquet")
    return d


def run(spark, d, name):
    return plans.queries()[name](spark, d).collect()


def _groups():
    by = collections.defaultdict(list)
    for k, n, part, price, quantity, discount in sorted(LINES):
        by[k] += [{"raw": f"${price}", "value": price, "kind": "currency"}, {"raw": str(quantity), "value": quantity, "kind": "int"}, {"raw": str(discount), "value": discount, "kind": "percent"}]
    return by


@pytest.mark.parametrize("mode", ["untyped", "typed"])
def test_greedy_sees_all_lines(spark, folder, mode):
    slots = [{"slot_name": n, "slot_type": t} for n, t in TYPES.items()]
    kernel = G.untyped if mode == "untyped" else G.typed_greedy
    want = {(k, slots[i]["slot_name"], m[j]["value"]) for k, m in _groups().items() for i, j in kernel(slots, m).items()}
    assert {tuple(r) for r in run(spark, folder, f"{mode}_greedy")} == want
    assert {k for k, _, _ in want} == {1, 2, 3}


def test_modes_see_all_lines(spark, folder):
    words = {"UnitPrice": ["unit", "price"], "NumberOfItems": ["number", "of", "items"], "DiscountRate": ["discount", "rate"], "TotalWeight": ["total", "weight"]}
    slots = [{"slot_name": n, "slot_type": t, "words": words[n]} for n, t in TYPES.items()]
    want = collections.defaultdict(list)
    for m in _groups().values():
        for mode, kernel in G.MODES.items():
            for i, j in kernel(slots, m).items():
                want[mode, slots[i]["slot_name"]].append(m[j]["value"])
    got = {(r["mode"], r.slot_name): (r.n, r.total) for r in run(spark, folder, "grounding_modes")}
    assert got == {k: (len(v), pytest.approx(sum(v), abs=0.01)) for k, v in want.items()}
    assert got["typed", "UnitPrice"] == (3, 701.0 + 60.0 + 30.0)


def test_link_scores_see_all_lines(spark, folder):
    assert {r.n for r in run(spark, folder, "link_scores")} == {len(LINES)}
    assert sum(r.n for r in run(spark, folder, "slot_ambiguity") if r.slot_name == "MaxUnitPrice") == 3


def test_pairs_see_all_lines(spark, folder):
    assert {(r.slot_name, r.kind, r.n) for r in run(spark, folder, "mention_slot_features")} == {(s, k, len(LINES)) for s in ("UnitPrice", "TotalQuantity", "DiscountRate") for k in ("currency", "int", "percent")}
    # the first line number of each order wins; only orders 1 and 3 have line 1
    assert {(r.slot_name, r.mention_id): (r.n, r.n_right) for r in run(spark, folder, "rule_argmax")}["UnitPrice", "p4"] == (1, 0)
    (r,) = run(spark, folder, "ranker_eval")
    assert r.n == 3 and r.exact_rate == pytest.approx(2 / 3, abs=1e-6) and r.slot_accuracy == pytest.approx(2 / 3, abs=1e-6)
    (r,) = run(spark, folder, "pair_quality")
    # 3 slots x 3 mentions a line; line 1 of order 1 and twice of order 3 are right
    assert (r.n_rows, r.n_positive, r.n_groups, r.groups_without, r.groups_with_several, r.n_duplicates) == (9 * len(LINES), 9, 9, 3, 3, 9)
    by = {r.feature: r for r in run(spark, folder, "feature_separation")}
    assert by["feat_type_match"].mean_pos == 1.0 and math.isfinite(by["feat_type_match"].mean_neg)


def test_every_order_is_an_mps_file(spark, tmp_path):
    rows = [(k, n, 1, 1.0, float(k % 50 + n), 0.0) for k in (1, 50, 51, 400, 123456) for n in (1, 2, 3)]
    spark.createDataFrame(rows, LINE).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = run(spark, str(tmp_path), "mps_parse")
    assert sorted(int(r.path) for r in got) == [1, 50, 51, 400, 123456]
    assert {r.n_variables for r in got} == {3}


def test_catalog_and_comparison_see_all_rows(spark, tmp_path):
    """Ids beyond every former bound, and multiples of 3, 5 and 10, count."""
    d = str(tmp_path)
    order = [(k, c, s, p, t) for k, c, s, p, t in ((1, 1, "F", "1-URGENT", 10.0), (6000, 2, "F", "1-URGENT", 30.0), (7000, 3, "P", "5-LOW", 8.0), (990000, 4, "O", "5-LOW", 4.0))]
    spark.createDataFrame(order, "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string, o_totalprice double").write.parquet(f"{d}/orders.parquet")
    spark.createDataFrame([(1, "F", 2.0), (6000, "F", 4.0), (6000, "O", 7.0)], "l_orderkey long, l_linestatus string, l_extendedprice double").write.parquet(f"{d}/lineitem.parquet")
    spark.createDataFrame([(c, f"c{c}") for c in (1, 2, 3, 4, 5)], "c_custkey long, c_name string").write.parquet(f"{d}/customer.parquet")
    part = [(0, "a b", 1.0, 9), (10, "c", 1.0, 9), (20, "d", 1.0, 3), (21, "e", 0.0, 9), (22, None, 1.0, 9), (23, "f", None, 9), (24, "g", 1.0, None)]
    spark.createDataFrame(part, "p_partkey long, p_name string, p_retailprice double, p_size int").write.parquet(f"{d}/part.parquet")
    spark.createDataFrame([(i, lang) for i, lang in ((0, "en"), (3, "en"), (5, "de"), (7, None))], "doc_id long, lang string").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(3, 1), (5, 1), (15, 0)], "doc_id long, quality int").write.parquet(f"{d}/labels.parquet")
    got = lambda name: {tuple(r) for r in run(spark, d, name)}
    assert got("summary_upsert") == {("F", "1-URGENT", 2, 3.0), ("O", "1-URGENT", 1, 7.0), ("P", "5-LOW", 1, 8.0), ("O", "5-LOW", 1, 4.0)}
    assert got("resume_remaining") == {(3, "c3"), (4, "c4"), (5, "c5")}
    assert got("catalog_audit") == {("warning", "stale_extended", 4), ("info", "incomplete", 1)}
    assert got("pair_systems") == {("both", 2, 1, 2), ("only_a", 2, 1, None), ("only_b", 1, None, 0)}


def test_bootstraps_draw_a_thousand_times(spark, tmp_path):
    d = str(tmp_path)
    rows = [(i, int(i % 3 > 0), int(i % 2 == 0)) for i in range(30)]
    spark.createDataFrame(rows, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    draw = lambda b, i: int(hashlib.md5(f"42-{b}-{i}".encode()).hexdigest()[:8], 16) % 30

    def means(v):
        return sorted(sum(v[draw(b, i)] for i in range(30)) / 30 for b in range(1000))

    a, x = [r[1] for r in rows], [r[1] - r[2] for r in rows]
    (r,) = run(spark, d, "bootstrap_ci")
    m = means(a)
    assert tuple(r) == (30, *[pytest.approx(v, abs=1e-6) for v in (sum(a) / 30, m[25], m[974])])
    (r,) = run(spark, d, "paired_bootstrap")
    m = means(x)
    p = 2 * sum(v <= 0 for v in m) / 1000
    assert tuple(r) == (30, *[pytest.approx(v, abs=1e-6) for v in (sum(x) / 30, m[25], m[974], p)])
    assert 0 < p < 1


@pytest.mark.parametrize(("rank", "rounds"), [(256, 1), (5, 8)])
def test_lsa_equals_a_full_decomposition(spark, rank, rounds):
    """All words and pairs of words count: 700 distinct words, of which a query has rare ones only."""
    rng = random.Random(3)
    topics = [[f"w{rng.randrange(700)}" for _ in range(60)] for _ in range(5)]
    texts = [" ".join(w if rng.random() < 0.8 else f"w{rng.randrange(700)}" for w in topics[i % 5]) for i in range(40)]
    texts[7] += " rarest of all"
    texts[9] = " ".join(reversed(texts[8].split()))  # the same words, other pairs
    asked = [texts[7][-14:], " ".join(texts[8].split()[5:12]), texts[20][:30]]
    got = {(r.query_id, r.doc_id): r.score for r in retrieval.lsa(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(list(enumerate(asked)), "query_id long, query string"), k=40, rank=rank, blocks=3, rounds=rounds).collect()}

    def terms(t):
        w = t.split()
        return collections.Counter(w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)])

    tf = [terms(t) for t in texts]
    names = sorted(set().union(*tf))
    idf = np.array([math.log(41 / (1 + sum(n in c for c in tf))) + 1 for n in names])
    m = np.array([[c[n] for n in names] for c in tf]) * idf
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    v = np.linalg.svd(m, full_matrices=False)[2][: min(rank, 39)].T
    q = np.array([[terms(t)[n] for n in names] for t in asked]) * idf @ v
    d = m @ v
    want = (q / np.linalg.norm(q, axis=1, keepdims=True)) @ (d / np.linalg.norm(d, axis=1, keepdims=True)).T
    assert len(got) == want.size
    assert max(abs(got[i, j] - want[i, j]) for i, j in got) < 1e-4
    assert max(range(40), key=lambda j: got[0, j]) == 7 or rank == 5


def test_kernels_run_once_for_queries_of_the_same_kinds():
    ran = []

    @G.remembered
    def kernel(scores):
        ran.append(scores)
        return {0: 0}

    slots = [{"slot_name": "TotalBudget", "slot_type": "currency", "words": ["total", "budget"]}]
    for value in range(50):
        first = kernel(G.type_scores(slots, [{"raw": str(value), "value": float(value), "kind": "currency"}]))
        assert first == {0: 0}
        first[0] = 9  # a caller's change stays its own
    kernel(G.type_scores(slots, [{"raw": "7", "value": 7.0, "kind": "int"}, {"raw": "8", "value": 8.0, "kind": "percent"}]))
    assert len(ran) == 2


@pytest.mark.parametrize("name", ["mention_slot_features", "rule_argmax", "ranker_eval", "pair_quality", "feature_separation"])
def test_pairs_are_made_where_their_order_lies(spark, folder, name):
    """Orders are never broadcast, and one exchange of two numbers a line is all that moves before rows are added up."""
    x = plans.queries()[name](spark, folder)
    plan = x._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Window" not in plan
    assert not [line for line in plan.splitlines() if "Exchange hashpartitioning(o_orderkey" in line and "mention_id" in line]


@pytest.fixture(scope="module")
def parallel(spark, tmp_path_factory):
    """Lines with a supplier, as the statements read them."""
    d = str(tmp_path_factory.mktemp("parallel"))
    spark.createDataFrame([(*x, x[2] % 4) for x in LINES], f"{LINE}, l_suppkey long").write.parquet(f"{d}/lineitem.parquet")
    return d


def _sent(df):
    return [line.strip() for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "BroadcastHashJoin" in line]


@pytest.mark.parametrize("name", ["mention_clauses", "clause_alignment"])
def test_words_of_clauses_are_not_sent_out(spark, parallel, name):
    """Clauses, their words and the table of cues grow with the lines; their files are small beside their rows."""
    assert _sent(plans.queries()[name](spark, parallel)) == []


@pytest.mark.parametrize("part", [roles, searches])
def test_slots_are_constants_beside_mentions(spark, parallel, part):
    """No statement's id and slots are made as rows and sent out: the few slots are, and all mentions meet all of them."""
    x = part._scored(spark, parallel)
    plan = x._jdf.queryExecution().executedPlan().toString()
    assert _sent(x) == [] and plan.count("BroadcastExchange") == 1
    mentions = len(R.role_mentions(roles.statements(spark, parallel), "text", ["id"], counts=False).select("id", "mention_id").collect())
    rows = [(r.id, r.mention_id, r.slot_name) for r in x.select("id", "mention_id", "slot_name").collect()]
    assert len(rows) == len(set(rows)) == mentions * len(part.COMPATIBLE_SLOTS if part is roles else part.SLOTS)


def test_states_of_the_beam_are_not_sent_out(spark, parallel):
    assert _sent(plans.queries()["pairwise_beam"](spark, parallel)) == []


def test_numbers_of_a_text_do_not_move_again(spark, parallel):
    """Only lines, texts and the table of cues move: no exchange has a number's words, and a text is cut behind its own."""
    plan = plans.queries()["quantity_families"](spark, parallel)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 3 and "BroadcastExchange" not in plan


def test_best_line_is_least_as_text(spark, tmp_path):
    """Ids tie as text, so p10 is before p2; a repeated order and a repeated line count as often as they stand."""
    lines = [(1, 2, 1, 1.0, 1.0, 0.0), (1, 10, 1, 1.0, 1.0, 0.0), (1, 10, 1, 1.0, 1.0, 0.0), (2, 21, 1, 1.0, 1.0, 0.0), (3, 1, 1, 1.0, 1.0, 0.0)]
    spark.createDataFrame(lines, LINE).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1,), (2,), (2,), (4,)], "o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    got = {(r.slot_name, r.mention_id): (r.n, r.n_right) for r in run(spark, str(tmp_path), "rule_argmax")}
    assert got == {(s, f"{m}{k}"): (1, right) for s, m in (("UnitPrice", "p"), ("TotalQuantity", "q"), ("DiscountRate", "d")) for k, right in ((10, 0), (21, 1))}
    (r,) = run(spark, str(tmp_path), "pair_quality")
    assert (r.n_rows, r.n_positive, r.n_groups, r.groups_without, r.groups_with_several, r.n_duplicates) == (45, 6, 6, 3, 3, 18)


def test_typed_greedy_is_a_fold_in_the_row(spark, folder):
    """The lines move once, as their columns, and no window sorts the mentions; null values and equal mentions as in the kernel."""
    plan = plans.queries()["typed_greedy"](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("Exchange") == 1
    rng = random.Random(3)
    slots = [{"slot_name": n, "slot_type": t} for n, t in TYPES.items()]
    mentions = lambda: [{"raw": rng.choice(["", "a", "b"]), "value": rng.choice([None, 0.5, 1.0, 7.0, -7.0]), "kind": rng.choice(["int", "percent", "currency", "float"])} for _ in range(rng.randrange(7))]
    rows = [(k, slots[: rng.randrange(5)], mentions()) for k in range(60)]
    df = spark.createDataFrame(rows, "query_id long, slots array<struct<slot_name:string,slot_type:string>>, mentions array<struct<raw:string,value:double,kind:string>>")
    want = [(k, s[i]["slot_name"], m[j]["value"]) for k, s, m in rows for i, j in G.typed_greedy(s, m).items()]
    assert sorted((tuple(r) for r in G.by_type(df).collect()), key=str) == sorted(want, key=str)


def test_rows_of_the_subspace_move_as_bytes(spark, monkeypatch):
    """Every iteration moves the subspace; numbers of arrays are turned over one by one, bytes are copied."""
    kinds, plain = [], type(spark.range(0)).mapInArrow
    monkeypatch.setattr(type(spark.range(0)), "mapInArrow", lambda self, f, schema, *a, **b: kinds.append(schema) or plain(self, f, schema, *a, **b))
    texts = spark.createDataFrame([(i, f"red fox number{i} ran home") for i in range(6)], "doc_id long, text string")
    got = retrieval.lsa(texts, texts.limit(2).toDF("query_id", "query"), k=1, rank=3, blocks=50, rounds=1).collect()
    assert sorted(r.query_id for r in got) == [0, 1] and all(r.score > 0 for r in got)
    assert sum("q binary" in k or "y binary" in k for k in kinds) > 3 and not any("q array" in k or "y array" in k for k in kinds)


def test_norms_are_worked_out_once_a_vector(spark):
    """A norm inside the lambda over components would be work with the square of the length."""
    v = spark.createDataFrame([(i, [1.0, float(i), 2.0]) for i in range(5)], "vec_id long, embedding array<double>")
    plan = retrieval.dense(v, v.toDF("query_id", "embedding"), k=2)._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate(" in plan and not re.search(r"/ SQRT\(", plan, re.IGNORECASE)

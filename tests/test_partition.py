"""Partition of constraints against plain loops that compare everything; block products of vectors against all pairs."""

import math
import random
import re

import numpy as np
import pytest

from gleaner.operators import partition as P
from gleaner.operators import retrieval as R

WORDS = ("labor hours machine cost budget dollars workers supply demand water flour sugar profit limit truck".split())


def _weights(texts):
    docs = [re.findall(r"\b\w\w+\b", (t or "").lower()) for t in texts]
    df = {w: sum(w in d for d in docs) for d in docs for w in d}
    out = []
    for d in docs:
        v = {w: d.count(w) * (math.log((1 + len(docs)) / (1 + df[w])) + 1) for w in set(d)}
        norm = math.sqrt(sum(x * x for x in v.values())) or 1.0
        top = sorted(v, key=lambda w: (-round(v[w], P.DIGITS), w))[: P.TOP]
        out.append(({w: x / norm for w, x in v.items()}, set(top)))
    return out


def _sets(rows, variables):
    keys = [k for _, k in _weights([t for _, t in rows] + variables)]
    c, v = keys[: len(rows)], keys[len(rows) :]
    groups = [({i}, {j for j, y in enumerate(v) if len(x & y) >= P.SHARED}) for (i, _), x in zip(rows, c, strict=True)]
    for _ in rows:
        for g in list(groups):
            near = [h for h in groups if h is not g and h[1] & g[1]]
            if g in groups and near:
                groups = [h for h in groups if h is not g and h not in near] + [(g[0].union(*(h[0] for h in near)), g[1].union(*(h[1] for h in near)))]
    return sorted(sorted(g[0]) for g in groups)


def _similar(rows, layer):
    w, out = _weights([t for _, t in rows]), {}
    of = P.WEIGHTS[layer]
    for i, (a, _) in enumerate(rows):
        for j in range(i + 1, len(rows)):
            cosine = min(1.0, sum(x * w[j][0].get(t, 0.0) for t, x in w[i][0].items()))
            out[a, rows[j][0]] = (of["adjacency"] / (1 + j - i) + of["keyword"] * min(1.0, len(w[i][1] & w[j][1]) / P.TOP) + of["vector"] * cosine) / sum(of.values())
    return out


def _clusters(ids, dist, cut):
    groups = [[i] for i in sorted(ids)]
    while len(groups) > 1:
        d, a, b = min((round(sum(dist[min(i, j), max(i, j)] for i in x for j in y) / (len(x) * len(y)), P.DIGITS), x[0], y[0]) for x in groups for y in groups if x[0] < y[0])
        if d > round(cut, P.DIGITS):
            break
        x, y = (next(g for g in groups if g[0] == k) for k in (a, b))
        groups = [g for g in groups if g is not x and g is not y] + [sorted(x + y)]
    return sorted(groups)


def _tree(rows, variables):
    sets, out = _sets(rows, variables), {}
    gap = lambda s: 1 / (s + P.EPSILON) - 1 / (1 + P.EPSILON)

    def cut(own, path, layer, depth):
        s = _similar(own, layer)
        groups = [[i for i, _ in own]]
        if len(own) > P.FEW and round(sum(s.values()) / len(s), P.DIGITS) < P.ALIKE:
            groups = _clusters([i for i, _ in own], {k: gap(x) for k, x in s.items()}, gap(P.ALIKE))
        if len(groups) == 1:
            out.update({i: (path, depth) for i, _ in own})
        else:
            for g in groups:
                cut([r for r in own if r[0] in g], f"{path}/{g[0]}", "default", depth + 1)

    if len(sets) == 1:
        cut(rows, "", "root", 0)
    else:
        for g in sets:
            cut([r for r in rows if r[0] in g], f"/{g[0]}", "default", 1)
    return out


@pytest.fixture(scope="module")
def problems():
    rng = random.Random(3)
    text = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    out = {}
    for g in range(25):
        rows = [(i * 3 + 1, rng.choice((None, "")) if rng.random() < 0.08 else text(rng.randrange(1, 6))) for i in range(rng.randrange(1, 12))]
        if rows[1:] and g % 3 == 0:
            rows[1] = (rows[1][0], rows[0][1])  # a tie
        out[g] = (rows, [text(rng.randrange(1, 3)) for _ in range(rng.randrange(0, 4))])
    return out


@pytest.fixture(scope="module")
def tables(spark, problems):
    c = spark.createDataFrame([(g, i, t) for g, (rows, _) in problems.items() for i, t in rows], "id long, idx int, text string")
    v = spark.createDataFrame([(g, str(k), t) for g, (_, vs) in problems.items() for k, t in enumerate(vs)], "id long, name string, text string")
    return c, v


def test_independent_sets_equal_plain_components(problems, tables):
    got = {}
    for r in P.independent_sets(*tables, "id").collect():
        got.setdefault(r["id"], {}).setdefault(r["set"], []).append(r["idx"])
    assert all(min(x) == k for g in got.values() for k, x in g.items())
    assert {g: sorted(sorted(x) for x in s.values()) for g, s in got.items()} == {g: _sets(*p) for g, p in problems.items()}


def test_mutual_merges_equal_merging_the_nearest_pair(spark):
    rng = random.Random(9)
    groups = {g: {(a, b): rng.choice((0.1, 0.2, 0.25, rng.random())) for a in range(8) for b in range(a + 1, 8)} for g in range(12)}
    df = spark.createDataFrame([(g, a, b, d) for g, x in groups.items() for (a, b), d in x.items()], "g int, a long, b long, distance double")
    for cut in (0.0, 0.22, 5.0):
        got = {}
        for r in P.average_linkage(df, ["g"], cut).collect():
            got.setdefault(r["g"], {}).setdefault(r["cluster"], []).append(r["idx"])
        assert {g: sorted(sorted(c) for c in x.values()) for g, x in got.items()} == {g: _clusters(range(8), x, cut) for g, x in groups.items()}


def test_tree_equals_plain_recursion(problems, tables):
    got = {(r["id"], r["idx"]): (r["path"], r["depth"]) for r in P.tree(*tables, "id").collect()}
    want = {(g, i): x for g, p in problems.items() for i, x in _tree(*p).items()}
    assert got == want and max(d for _, d in want.values()) >= 2


def test_odd_constraints(spark, tables):
    c, v = tables
    assert P.tree(c.limit(0), v.limit(0), "id").collect() == []
    rows = [(1, None, "hours"), (1, 2, "labor hours"), (1, 2, "labor hours"), (1, 5, None), (None, 1, "labor")]
    df = spark.createDataFrame(rows, "id long, idx int, text string")
    for x in (v.limit(0), spark.createDataFrame([(1, None, "labor"), (1, "a", None)], "id long, name string, text string")):
        assert sorted((r["id"], r["idx"], r["set"]) for r in P.independent_sets(df, x, "id").collect()) == [(1, 2, 2), (1, 5, 5)]


def test_block_products_equal_all_pairs(spark):
    rng = np.random.default_rng(4)
    m = [[float(x) for x in row] for row in rng.normal(size=(90, 6)).astype("float32")]
    m[7], m[8], m[50] = m[3], m[3], [0.0] * 6
    rows = [*enumerate(m), (None, m[0]), (91, None)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    q = v.filter("vec_id % 9 = 3").withColumnRenamed("vec_id", "query_id")
    unit = {i: np.array(x) / np.linalg.norm(x) for i, x in enumerate(m) if any(x)}
    want = []
    for i in range(3, 90, 9):
        best = sorted(((-round(float(unit[i] @ y), 9), j) for j, y in unit.items()))[:4]
        want += [(i, j, r + 1) for r, (_, j) in enumerate(best)]
    for block in (1000, 13):
        assert sorted((r["query_id"], r["doc_id"], r["rank"]) for r in R.dense(v, q, k=4, block=block).collect()) == sorted(want)
    assert R.dense(v.limit(0), q, k=4).collect() == [] == R.dense(v, q, k=0).collect()


def test_small_problems_stay_in_their_rows(problems, tables, monkeypatch):
    """Keywords, ties, labels, pairs and clusters are written for problems of more than ``most`` rows only, and give the same."""
    names, keep = [], P.saved
    monkeypatch.setattr(P, "saved", lambda df, name: names.append(name) or keep(df, name))
    row = lambda df: {tuple(r) for r in df.collect()}
    sets, tree = row(P.independent_sets(*tables, "id")), row(P.tree(*tables, "id"))
    assert set(names) == {"large", "nodes"}
    assert row(P.independent_sets(*tables, "id", most=4)) == sets and "labels" in names
    assert row(P.tree(*tables, "id", most=4)) == tree and "linkage" in names
    assert {len(x) > 4 for x, _ in problems.values()} == {True, False}

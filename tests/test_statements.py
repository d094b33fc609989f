"""Roles of mentions, clauses, intervals, names, ratio bootstrap and tables of versions."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.functions import number_roles as NR
from gleaner.functions import roles as R
from gleaner.functions import text as T
from gleaner.operators import assign as G
from gleaner.operators import bootstrap as B
from gleaner.operators import clauses as C
from gleaner.operators import compatibility as CO
from gleaner.operators import families as FA
from gleaner.operators import intervals as I
from gleaner.operators import names as N
from gleaner.sources import sinks, versions


def roles(spark, texts, **k):
    rows = R.role_mentions(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), "text", ["id"], **k).collect()
    out = [[] for _ in texts]
    for r in sorted(rows, key=lambda r: (r.id, r.mention_id)):
        out[r.id].append(r)
    return out


BOUNDS = [
    ("at least 10 hours", "lower_inclusive", ["min"]), ("no fewer than 50 units", "lower_inclusive", ["min"]), ("not fewer than 10", "lower_inclusive", ["min"]), ("greater than or equal to 8 items", "lower_inclusive", ["min"]),
    ("greater than or equal 8", "lower_inclusive", ["min"]), ("at a minimum 5", "lower_inclusive", ["min"]), ("more than 10 workers", "lower_exclusive", ["min"]), ("greater than 5 units", "lower_exclusive", ["min"]),
    ("at most 20 hours", "upper_inclusive", ["max"]), ("no more than 30 kg", "upper_inclusive", ["max"]), ("less than or equal to 12", "upper_inclusive", ["max"]), ("less than or equal 12", "upper_inclusive", ["max"]),
    ("no greater than 15", "upper_inclusive", ["max"]), ("not greater than 7", "upper_inclusive", ["max"]), ("at a maximum 100", "upper_inclusive", ["max"]), ("fewer than 8 machines", "upper_exclusive", ["max"]),
    ("use less than 30 kg of material", "upper_exclusive", ["max"]), ("not less than 3", "lower_inclusive", ["min"]), ("profit is 20 dollars per unit", "unknown", []), ("At most 40% of workers can be assigned.", "upper_inclusive", ["max"]),
    ("At least half of the budget must be invested.", "lower_inclusive", ["min"]),
]


def test_bounds_of_mentions(spark):
    for (text, bound, tags), found in zip(BOUNDS, roles(spark, [b[0] for b in BOUNDS]), strict=True):
        assert (found[0].bound_role, found[0].operator_tags) == (bound, tags), text


def test_ranges_barriers_and_derived_counts(spark):
    texts = [
        "The acceptable range is between 5 and 12.", "Allocate from 3 to 8 workers.", "5 to 12 or from 1 to 2 to 3, up to 4 to 6", "Make at least 50 units. The profit is 20 per unit",
        "Each unit requires 2 hours. There are 2000 hours available.", "It needs 4 hours, and total budget is 5000.", "3 heating hours and 5 cooling hours", "phones and laptops in three types", None, "",
    ]
    got = roles(spark, texts)
    by = lambda i: {m.value: m.bound_role for m in got[i]}
    assert by(0) == {5.0: "range_low", 12.0: "range_high"} and by(1) == {3.0: "range_low", 8.0: "range_high"}
    assert [m.bound_role for m in got[2]][:4] == ["range_low", "range_high", "range_low", "range_high"] and got[2][4].value == 3.0 and got[2][4].bound_role == "upper_inclusive"  # by "up to" behind it, not as an end of a range
    assert got[0][0].operator_tags == ["min"] and got[0][1].operator_tags == ["max"]
    assert got[3][1].bound_role == "unknown" and got[3][1].narrow_left_tokens == ["the", "profit", "is"]  # the sentence before does not reach it
    assert [(m.is_per_unit, m.is_total_like, m.primary_role) for m in got[4]] == [(True, False, "coefficient"), (False, True, "total")]
    assert not got[5][0].is_total_like and got[5][1].is_total_like  # the clause behind the comma does not reach back
    assert got[6][0].narrow_context_tokens == ["heating", "hours", "and"] and got[6][0].is_time_like
    assert [(m.value, m.primary_role, m.position) for m in got[7]] == [(3.0, "count", 4), (2.0, "count", None)] and "derived_count" in got[7][1].role_tags
    assert got[8] == got[9] == []
    assert roles(spark, ["phones and laptops"], counts=False) == [[]] and roles(spark, ["<num> units"], masked=True)[0][0].type_bucket == "unknown"


def test_clauses_and_placed_mentions(spark):
    texts = [(1, "Feed A has 10 protein, while Feed B has 7. Nothing but 3 remain; Wood costs 5 whereas x"), (2, "a clause 4"), (3, None), (4, " ; ")]
    df = spark.createDataFrame(texts, "id long, text string")
    found = C.clauses(df, "text", "id")
    rows = {(r.id, r.clause_idx): r for r in found.collect()}
    assert [rows[1, k].text for k in range(5)] == ["Feed A has 10 protein,", "while Feed B has 7.", "Nothing but 3 remain;", "Wood costs 5", "whereas x"]
    assert rows[1, 0].entities == ["A", "Feed"] and rows[1, 0].measures == ["protein"] and (rows[1, 1].start, rows[1, 1].end) == (5, 10)
    assert {k for k in rows if k[0] != 1} == {(2, 0), (4, 0)}
    m = R.role_mentions(df, "text", ["id"], counts=False)
    inside = I.contained(m.select("id", "mention_id", "position"), found.select("id", "clause_idx", "start", "end"), ["id"], "position", width=3)
    assert sorted((r.id, r.mention_id, r.clause_idx) for r in inside.collect()) == [(1, 0, 0), (1, 1, 1), (1, 2, 2), (1, 3, 3), (2, 0, 0)]
    placed = C.by_words(m, found, "id")
    # the last mention has two words to its left in either clause: the first of them
    assert sorted((r.id, r.mention_id, r.clause_idx) for r in placed.collect()) == [(1, 0, 0), (1, 1, 1), (1, 2, 2), (1, 3, 2), (2, 0, 0)]
    slots = spark.createDataFrame([(1, "ProteinFeedB", ["proteinfeedb", "protein", "feed", "b"]), (2, "X", ["x"])], "id long, slot_name string, words array<string>")
    got = {(r.id, r.mention_id): tuple(r[3:]) for r in C.alignment(placed, found, slots, "id").select("id", "mention_id", "slot_name", "clause_entity_overlap", "clause_measure_overlap", "cross_clause_entity_penalty").collect()}
    assert got[1, 0] == (1, 1, 1) and got[1, 1] == (2, 0, 0) and got[1, 3] == (0, 0, 2) and got[2, 0] == (0, 0, 0)


def test_points_in_intervals_or_the_nearest(spark):
    rng = random.Random(3)
    inter = [(g, k, a, a + rng.randrange(0, 40)) for g in range(5) for k, a in enumerate(rng.sample(range(0, 400), 6))]
    points = [(g, i, rng.randrange(-20, 440)) for g in range(6) for i in range(40)]
    want = []
    for g, i, at in points:
        own = [(k, s, e) for h, k, s, e in inter if h == g and s < e]
        held = [k for k, s, e in own if s <= at < e]
        near = sorted((s - at if s > at else at - e + 1, s > at, k) for k, s, e in own)
        want += [(g, i, k) for k in held] if held else [(g, i, near[0][0] if near else None)]
    p = spark.createDataFrame(points, "g int, i int, at int")
    q = spark.createDataFrame(inter, "g int, k int, start int, end int")
    got = I.contained(p, q, ["g"], "at", width=7).collect()
    assert len(got) == len(want)
    spans = {(g, k): (s, e) for g, k, s, e in inter}
    have = []
    for r in got:
        if r.k is None:
            have.append((r.g, r.i, None))
        else:
            s, e = spans[r.g, r.k]
            have.append((r.g, r.i, r.k) if s <= r["at"] < e else (r.g, r.i, s - r["at"] if s > r["at"] else r["at"] - e + 1))
    assert sorted(have, key=repr) == sorted(want, key=repr)


def test_names_that_contain_each_other(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abÄ") for _ in range(rng.randrange(0, 9)))
    names, catalog = [word() for _ in range(80)] + [None, " A ", "%_"], [(word(), i) for i in range(60)] + [("a%_b", 60), (None, 61)]
    clean = lambda x: (x or "").strip().lower()
    want = {n: min((o for c, o in catalog if clean(n) and (clean(n) in clean(c) or clean(c) in clean(n))), default=None) for n in names}
    n, c = spark.createDataFrame([(x,) for x in names], "name string"), spark.createDataFrame(catalog, "title string, o int")
    assert {r.name: r.o for r in N.first_match(n, c, "name", "title", "o").collect()} == want
    got = N.containing(n, c, "name", "title")
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString() and "Cartesian" not in got._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r) for r in got.collect()} == {(a, b) for a in names for b, _ in catalog if a and b is not None and a in b}
    assert N.containing(n.limit(0), c, "name", "title").collect() == []


def test_ratio_bootstrap(spark):
    rng = np.random.default_rng(1)
    rows = [(i, float(a), float(a + b), "x" if i % 3 else None) for i, (a, b) in enumerate(zip(rng.integers(0, 5, 300), rng.integers(0, 9, 300), strict=True))]
    df = spark.createDataFrame([*rows, (None, 1.0, 1.0, "x"), (5, None, 1.0, "x")], "key long, num double, den double, g string")
    w = B.weights(np.arange(300), 2000, 7)
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02 and abs(np.corrcoef(w[0], w[1])[0, 1]) < 0.08 and abs(np.corrcoef(w[:, 0], w[:, 1])[0, 1]) < 0.2
    n, d = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    lo, hi = np.percentile((n @ w) / (d @ w), [2.5, 97.5])
    r = B.ratio_interval(df.repartition(5), "num", "den", reps=2000, seed=7).first()
    assert (r.n, r.ratio) == (300, pytest.approx(n.sum() / d.sum())) and (r.lo, r.hi) == (pytest.approx(lo), pytest.approx(hi))
    p = n.sum() / d.sum()
    half = 1.96 * np.sqrt(((n - p * d) ** 2).sum()) / d.sum()
    assert r.hi - r.lo == pytest.approx(2 * half, rel=0.15)
    assert {x.g: x.n for x in B.ratio_interval(df, "num", "den", reps=50, by=["g"]).collect()} == {"x": 200}
    assert B.ratio_interval(df.limit(0), "num", "den", reps=10).first().n == 0


# tables of versions: stopped at every step


class Stop(Exception):
    pass


def _rows(spark, rows):
    return spark.createDataFrame(rows, "k long, v string")


def _read(t):
    df = t.read()
    return sorted(map(tuple, df.collect())) if df is not None else None


STEPS = ("write_data", "commit", "_rename", "clean")


@pytest.mark.parametrize("step", STEPS)
@pytest.mark.parametrize("late", [False, True])
def test_an_upsert_stopped_at_any_step_leaves_a_whole_version(spark, tmp_path, monkeypatch, step, late):
    t = versions.Table(spark, f"{tmp_path}/t")
    versions.upsert(t, _rows(spark, [(1, "a"), (2, "b")]), ["k"])
    before, after = [(1, "a"), (2, "b")], [(1, "a"), (2, "c"), (3, "d")]
    real = getattr(versions.Table, step)

    def stopped(self, *a, **k):
        if late:
            real(self, *a, **k)
        raise Stop

    with monkeypatch.context() as m:
        m.setattr(versions.Table, step, stopped)
        with pytest.raises(Stop):
            versions.upsert(t, _rows(spark, [(2, "c"), (3, "d")]), ["k"])
    done = step == "clean" or (step in ("commit", "_rename") and late)
    assert _read(t) == (after if done else before)
    versions.upsert(t, _rows(spark, [(2, "c"), (3, "d")]), ["k"])
    assert _read(t) == after
    assert len(t._names("data")) <= versions.KEEP and not [n for n in t._names("manifest") if n.startswith(".")]


def test_of_two_writers_one_wins(spark, tmp_path):
    t = versions.Table(spark, f"{tmp_path}/t")
    a, b = (t.write_data(_rows(spark, [(i, "x")])) for i in (1, 2))
    assert t.commit([a], after=0) == 1
    with pytest.raises(versions.Conflict):
        t.commit([b], after=0)
    assert _read(t) == [(1, "x")]


@pytest.mark.parametrize("step", ("write_data", "commit", "clean"))
def test_a_stopped_run_goes_on_behind_its_last_commit(spark, tmp_path, monkeypatch, step):
    todo, t, calls = spark.range(100).withColumnRenamed("id", "k"), versions.Table(spark, f"{tmp_path}/t"), []

    def work(df):
        calls.append(1)
        return df.select("k", F.lit("done").alias("v"))

    real, left = getattr(versions.Table, step), [2]

    def stopped(self, *a, **k):
        left[0] -= 1
        if left[0] < 0:
            raise Stop
        return real(self, *a, **k)

    with monkeypatch.context() as m:
        m.setattr(versions.Table, step, stopped)
        with pytest.raises(Stop):
            versions.run_parts(todo, "k", work, t, parts=4)
    first = len(calls)
    out = versions.run_parts(todo, "k", work, t, parts=4)
    assert sorted(r.k for r in out.collect()) == list(range(100)) and len(calls) - first == (1 if step == "clean" else 2)
    versions.run_parts(todo, "k", work, t, parts=4)
    assert len(calls) - first <= 2
    with pytest.raises(ValueError):
        versions.run_parts(todo, "k", work, t, parts=5)


def test_a_batch_counts_once(spark, tmp_path):
    t = versions.Table(spark, f"{tmp_path}/t")
    batch = lambda rows: spark.createDataFrame(rows, "query string, n long")
    assert versions.add_batch(t, batch([("a", 1), ("b", 2)]), 0, ["query"], ["n"])
    assert versions.add_batch(t, batch([("a", 5)]), 1, ["query"], ["n"]) and not versions.add_batch(t, batch([("a", 5)]), 1, ["query"], ["n"])
    assert _read(t) == [("a", 6), ("b", 2)]


def test_sinks_keep_every_row(spark, tmp_path):
    df = spark.range(2500).select(F.col("id").alias("k"), (F.col("id") / 4).alias("v"))
    lines = sinks.markdown(df, ["k"], digits=2).split("\n")
    assert len(lines) == 2502 and lines[0] == "| k | v |" and lines[2] == "| 0 | 0.00 |" and lines[-1] == "| 2499 | 624.75 |"
    got = sinks.upsert_table(_rows(spark, [(1, "a")]), f"{tmp_path}/u", ["k"])
    assert sinks.upsert_table(_rows(spark, [(1, "b"), (2, "c")]), f"{tmp_path}/u", ["k"]).count() == 2 and got.count() == 1  # the version read before is still there
    sinks.write_csv(df, f"{tmp_path}/c", ["k"])
    sinks.write_json(df, f"{tmp_path}/j")
    assert spark.read.option("header", True).csv(f"{tmp_path}/c").count() == spark.read.json(f"{tmp_path}/j").count() == 2500


# numbers, their families, hard statements


def _numbers(spark, texts):
    rows = NR.number_roles(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), "text", ["id"]).collect()
    out = [{} for _ in texts]
    for r in rows:
        out[r.id][r.value] = r
    return out


def test_number_roles(spark):
    got = _numbers(spark, ["She gained 5 more apples", "He spent 7 coins", "10 dollars per hour", "at least 5 units", "no fewer than 10 units", "at most 8 hours", "no more than 100 kg", "It is between 5 and 10, from 1,5 to x",
                           "maximize the profit of 50 dollars", "In 2023 it rained", "He has 3 apples and received them", None, "five hundred, 1,5 and -2.5 x3"])
    assert {"gained", "more"} <= set(got[0][5.0].operator_cues) and "spent" in got[1][7.0].operator_cues and "per" in got[2][10.0].operator_cues
    assert [got[3][5.0].bound_role, got[4][10.0].bound_role, got[5][8.0].bound_role, got[6][100.0].bound_role] == ["lower", "lower", "upper", "upper"]
    assert [got[7][v].range_partner for v in (5.0, 10.0, 15.0)] == [True, True, False]
    assert got[8][50.0].relevance == "role_required" and got[8][50.0].direction == "max_like" and got[9][2023.0].relevance == "role_irrelevant" and got[10][3.0].relevance == "role_optional"
    assert got[11] == {} and set(got[12]) == {5.0, 100.0, 15.0, -2.5}


def _families_by_definition(positions, bounds, nouns, words):
    """The pairs in order, written out without shortcuts."""
    of, n, paired = {}, 0, set()
    for i in range(len(bounds)):
        best, most = None, 0
        if bounds[i] == "lower":
            for j in range(len(bounds)):
                if bounds[j] == "upper" and j not in paired and len(nouns[i] & nouns[j]) > most:
                    best, most = j, len(nouns[i] & nouns[j])
        if best is not None:
            of[i] = of[best] = n
            paired.add(best)
            n += 1
    for i in range(len(bounds)):
        for j in range(i + 1, len(bounds)):
            if abs(positions[i] - positions[j]) <= 10 and words[i] & words[j] and not (i in of and j in of and of[i] == of[j]):
                f = of[i] if i in of else of[j] if j in of else n
                n += f == n
                of[i] = of[j] = f
    return [of.get(i) for i in range(len(bounds))]


def test_quantity_families(spark):
    rng = random.Random(6)
    sets = lambda n: [set(rng.sample("abcdef", rng.randrange(0, 3))) for _ in range(n)]
    for _ in range(300):
        n = rng.randrange(0, 12)
        x = (sorted(rng.sample(range(60), n)), [rng.choice(("lower", "upper", "none")) for _ in range(n)], sets(n), sets(n))
        assert FA.family_ids(*x) == _families_by_definition(*x)
    texts = ["at least 10 hours of labor are needed and then there are many other things to say before at most 20 hours of labor", None, "3 apples", "2 red apples then 3 red pears"]
    df = NR.number_roles(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), "text", ["id"])
    got = {(r.id, r.mention_id): r.family for r in FA.quantity_families(df, "id").collect()}
    assert got[0, 0] == got[0, 1] == 0 and got[2, 0] is None and got[3, 0] == got[3, 1] == 0 and len(got) == 5
    assert FA.quantity_families(df.limit(0), "id").collect() == []


def test_bottlenecks(spark):
    texts = ["Dr. Smith buys 3 items", "at least 5 and at most 9", "1,000 1000 2 3", "a total of 5 per unit", "20% of 5000", "20% of 5000%", None, "total per"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {r.id: tuple(r[1:]) for r in df.select("id", *T.bottlenecks(F.col("text")).values()).collect()}
    assert [got[i].index(True) if True in got[i] else None for i in range(8)] == [0, 1, 2, 3, 4, None, None, None]
    assert all(sum(got[i]) == (1 if i < 5 else 0) for i in range(8))


# compatibility of pairs


def _pair(a, b):
    """The rules of two filled slots, written out."""
    w, out = CO.WEIGHTS, 0.0
    if a["mention_id"] == b["mention_id"]:
        return w["duplicate"]
    for x, y in ((a, b), (b, a)):
        if x["is_min"] and y["is_max"] and x["value"] is not None and y["value"] is not None and not (y is a and a["is_min"] and b["is_max"]):
            out += w["ordered"] if x["value"] <= y["value"] else w["inverted"]
    for t, c in ((a, b), (b, a)):
        if t["is_total"] and c["is_coefficient"] and not (t is b and a["is_total"] and b["is_coefficient"]):
            if t["is_total_like"] != c["is_total_like"] or t["is_per_unit"] != c["is_per_unit"]:
                out += w["distinct"]
            elif t["type_bucket"] == c["type_bucket"]:
                out += w["same_type"]
            big, small = (a, b) if a["is_total"] else (b, a)
            if big["value"] is not None and small["value"] is not None:
                out += w["total_larger"] * (big["value"] > small["value"]) + w["total_smaller"] * (big["value"] < small["value"])
    pct = [x["type_bucket"] == "percent" for x in (a, b)]
    if a["is_percent"] != b["is_percent"]:
        out += w["percent_apart"] * (pct == [a["is_percent"], b["is_percent"]])
    elif a["is_percent"] and not any(pct):
        out += w["percent_missed"]
    goal = [x["fragment_type"] == "objective" for x in (a, b)]
    bound = [x["fragment_type"] in ("constraint", "bound") for x in (a, b)]
    if (a["is_objective"] and b["is_bound"]) or (a["is_bound"] and b["is_objective"]):
        out += w["objective_and_bound"] * ((a["is_objective"] and goal[0] and b["is_bound"] and bound[1]) or (a["is_bound"] and bound[0] and b["is_objective"] and goal[1]))
    elif a["is_objective"] and b["is_objective"] and all(goal):
        out += w["two_objectives"]
    return out


def _groups(n, slots, seed):
    rng = random.Random(seed)
    rows = []
    for g in range(n):
        s = [{k: rng.random() < 0.4 for k in CO.SLOT} for _ in range(slots)]
        m = [{"mention_id": i, "value": rng.choice((None, 1.0, 2.0, 50.0)), "type_bucket": rng.choice(("percent", "int", "currency")), "fragment_type": rng.choice(("objective", "constraint", "bound", "")), "is_per_unit": rng.random() < 0.5, "is_total_like": rng.random() < 0.5} for i in range(rng.randrange(1, 5))]
        rows += [{"id": g, "slot_pos": j, "slot_name": f"s{j}", "score": rng.choice((-2.0, -0.5, 0.25, 1.0, 3.5)), **a, **b} for j, a in enumerate(s) for b in m]
    return rows


FIELDS = "id long, slot_pos int, slot_name string, score double, " + ", ".join(f"{k} boolean" for k in CO.SLOT) + ", mention_id int, value double, type_bucket string, fragment_type string, is_per_unit boolean, is_total_like boolean"


def _total(chosen, pairwise=True):
    return sum(c["score"] for c in chosen) + (sum(_pair(b, a) for a, b in itertools.combinations(chosen, 2)) if pairwise else 0.0)


def test_pair_scores(spark):
    rows = [r for r in _groups(150, 2, 1) if r["mention_id"] == r["slot_pos"] or (r["mention_id"] == 0 and r["id"] % 9 == 0)]
    df = spark.createDataFrame([tuple(r[f.split()[0]] for f in FIELDS.split(", ")) for r in rows], FIELDS)
    got = sorted((r.id, r.slot_a, r.slot_b, r.score) for r in CO.pairs(df, "id").collect())
    want = sorted((a["id"], a["slot_name"], b["slot_name"], _pair(a, b)) for a in rows for b in rows if a["id"] == b["id"] and a["slot_pos"] < b["slot_pos"])
    assert got == want and len({x[3] for x in want}) > 8


def test_beam_is_exhaustive_when_wide_and_never_better(spark):
    rows = _groups(40, 3, 2)
    df = spark.createDataFrame([tuple(r[f.split()[0]] for f in FIELDS.split(", ")) for r in rows], FIELDS)
    for width, pairwise in ((1000, True), (1000, False), (2, True)):
        found = {}
        for r in CO.beam(df, "id", 3, width=width, pairwise=pairwise).collect():
            found.setdefault(r.id, []).append(r)
        for g in range(40):
            own = [r for r in rows if r["id"] == g]
            options = [[None, *[r for r in own if r["slot_pos"] == j and r["score"] > CO.PRUNE]] for j in range(3)]
            best = max(_total([c for c in pick if c], pairwise) for pick in itertools.product(*options) if len({c["mention_id"] for c in pick if c}) == sum(c is not None for c in pick))
            chosen = sorted(found.get(g, []), key=lambda r: r.slot_pos)
            total = _total([next(r for r in own if r["slot_pos"] == c.slot_pos and r["mention_id"] == c.mention_id) for c in chosen], pairwise)
            assert all(c.total == pytest.approx(total) for c in chosen)
            assert total == pytest.approx(best) if width > 2 else total <= best + 1e-9
    assert CO.beam(df.limit(0), "id", 3).collect() == []


def test_simple_assignments_as_rows_equal_their_kernels(spark):
    rng = random.Random(8)
    groups = []
    for g in range(60):
        slots = [(f"s{j}", rng.choice(("percent", "int", "currency", "float")), ["w"]) for j in range(rng.randrange(0, 5))]
        found = [(rng.choice(("1", "2", "x")), rng.choice((None, 0.5, 1.0, -1.0, 2.5, 7.0)), rng.choice(("percent", "int", "currency", "float", "unknown"))) for _ in range(rng.randrange(0, 6))]
        groups.append((g, slots, found))
    df = spark.createDataFrame(groups, "query_id long, slots array<struct<slot_name:string,slot_type:string,words:array<string>>>, mentions array<struct<raw:string,value:double,kind:string>>")
    want = {m: sorted((tuple(r) for r in G.assign(df, [m]).select("query_id", "slot_name", "value").collect()), key=repr) for m in ("untyped", "typed")}
    plain = lambda x: sorted((tuple(r) for r in x.collect()), key=repr)
    nan = lambda rows: [(a, b, None if c is not None and c != c else c) for a, b, c in rows]
    assert nan(plain(G.by_rank(df))) == nan(want["untyped"]) and nan(plain(G.by_type(df, 4))) == nan(want["typed"])


def test_cues_are_looked_for_once_for_texts_that_differ_in_digits(spark, monkeypatch):
    from gleaner.functions import roles

    made, whole = [], roles.saved
    monkeypatch.setattr(roles, "saved", lambda df, name: made.append(whole(df, name)) or made[-1])
    texts = [(1, "At least 12 units of 5% at $3.50, and each needs 1,200 hours."), (2, "At least 7 units of 90% at $11.25, and each needs 3,4 hours."), (3, "no mention here"), (4, None), (5, "HALF of them; twenty-one more")]
    rows = spark.createDataFrame(texts, "id long, text string")
    got = {(r.id, r.mention_id): r for r in roles.role_mentions(rows, "text", ["id"], counts=False).collect()}
    assert len(made) == 1 and made[0].select("__shape").distinct().count() == 2
    assert [got[1, k].value for k in range(4)] == [12.0, 0.05, 3.5, 1200.0] and [got[2, k].value for k in range(4)] == [7.0, 0.9, 11.25, 34.0]
    assert not {i for i, _ in got} & {3, 4} and got[5, 0].value == 0.5 and got[5, 1].value == 21.0
    # a text on its own, where its shape is itself, has the same mentions
    for r in roles.role_mentions(rows.filter("id <= 2"), "text", ["id"], counts=True).collect():
        if r.position is not None:
            assert r == got[r.id, r.mention_id]


def test_numbers_share_cues_where_only_digits_differ(spark, monkeypatch):
    """Cues are looked for once in each shape; lengths of words, values, years and ranges are each text's own."""
    kept, save = [], NR.saved
    monkeypatch.setattr(NR, "saved", lambda df, name: kept.append(save(df, name)) or kept[-1])
    texts = ["Pay $5 between 5 and 9 cost x1", "Pay $45 between 50 and 1990 cost x22", "PAY $45 between 50 and 90 cost x22", ""]
    rows = NR.number_roles(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), "text", ["id"]).collect()
    got = {(r.id, r.mention_id): (r.surface, r.value, r.position, r.range_partner, r.quantity_words, r.nouns, r.relevance) for r in rows}
    assert kept[0].select("__key").distinct().count() == 1  # the empty text has no number
    assert got[0, 0] == ("5", 5.0, 3, True, ["pay", "$5", "between", "cost", "x1"], ["between", "cost", "pay"], "role_required")
    assert got[1, 1] == ("1990", 1990.0, 5, True, ["pay", "$45", "between", "cost", "x22"], ["$45", "between", "cost", "x22"], "role_required")
    assert got[2, 1][:2] == ("90", 90.0) and len(got) == 6


def test_families_take_texts_by_batches(spark):
    """No task is called once for each text; texts of one batch keep apart, a null id is a text too."""
    df = NR.number_roles(spark.createDataFrame([(k, "at least 3 red cars, at most 9 red cars and 4 blue boats") for k in [*range(40), None]], "id long, text string"), "text", ["id"])
    x = FA.quantity_families(df, "id")
    plan = x._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroups" not in plan and "MapInArrow" in plan
    by = {}
    for r in x.collect():
        by.setdefault(r.id, {})[r.mention_id] = r.family
    assert len(by) == 41 and len({tuple(sorted(v.items())) for v in by.values()}) == 1 and by[None][0] == by[None][1] == 0

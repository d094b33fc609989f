"""Operators 11 to 13 against brute force, on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import itertools
import math
import random

import numpy as np
import pyarrow as pa
import pytest

from gleaner.llm import op11_align, op12_caps, op13_audit

# 11: alignment

ODD = [None, "", " ", "  ", "x ", " x", "  a  b\tc\n d ", "ﬁ x² <unk> <s> </s> <|endoftext|> <0x41>", "a▁b", "▁ b", "中文 字 🙂🙂 ǅ é", "\x00x \x1f y", "a b c　d", "word\n\nnext  two   three    four", "it's we'll  don't 123 4567 8,9", "same words same words same words"]


def _odd_texts(n=120):
    rng = random.Random(1)
    signs = [" ", "  ", "\n", "\t", "a", "b", "the", "ñ", "é", "字", ".", "'s", " ", "12"]
    return [*ODD, *["".join(rng.choice(signs) for _ in range(rng.randrange(60))) for _ in range(n)]]


def test_alignment_equals_comparing_all_tokens(spark, monkeypatch):
    rows = [(i, t) for i, t in enumerate(_odd_texts())]
    rows += [rows[6], (None, "hello world")]
    want = sorted(map(repr, op11_align.brute_force(rows)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(repr(tuple(r)[:8]) for r in op11_align.align(df).collect()) == want
    extra = df.withColumn("n", df.doc_id).withColumn("block", df.doc_id).withColumn("pairs", df.doc_id).repartition(3)
    assert sorted(repr(tuple(r)[:8]) for r in op11_align.align(extra).collect()) == want
    assert op11_align.align(df.limit(0)).collect() == []


def test_blocks_and_forgotten_stretches_change_nothing(monkeypatch):
    t = op11_align.Tokenizers(op11_align.vocabulary_path(op11_align.A_FILE), op11_align.vocabulary_path(op11_align.B_FILE))
    texts = [x for x in _odd_texts(60) if x]
    names = ["block", "doc_id", *op11_align._COUNTS, "groups_sha256", *op11_align._LISTS]

    def run(size):
        known, out = op11_align.Stretches(t), []
        for at in range(0, len(texts), size):
            block = op11_align.Block(at)
            for i, x in enumerate(texts[at : at + size]):
                ps = op11_align._CUT.split(x)
                known.add(list({p: None for p in ps if p not in known.at}))
                block.add(at + i, ps, known)
            for b in block.rows(known, names, pa.int64()):
                out += [tuple(r[c] for c in ("doc_id", *op11_align._COUNTS, "groups_sha256")) for r in b.to_pylist() if r["n_a"] is not None]
            known.clear()
        return out

    assert run(1) == run(7) == run(len(texts))


def test_a_long_text_is_cut_and_counted_whole(spark):
    long = " ".join(f"w{i % 977}" for i in range(20_000)) + " " + "z" * 5000
    t = op11_align.Tokenizers(op11_align.vocabulary_path(op11_align.A_FILE), op11_align.vocabulary_path(op11_align.B_FILE))
    a, b = t.encode(long)
    _, _, shared, ends, links = op11_align.aligned(t, a, b)
    r = op11_align.align(spark.createDataFrame([(1, long)], "doc_id long, text string")).first()
    assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.count_sum) == (len(a), len(b), len(shared), len(ends), len(links))


# 12: near vectors


def _near(x, cosine, rng):
    z = rng.standard_normal(len(x))
    z -= (z @ x) / (x @ x) * x
    z *= math.sqrt(float(x @ x)) / math.sqrt(float(z @ z))
    return cosine * x + math.sqrt(1 - cosine * cosine) * z


def _rows(v):
    return [(i, None if x is None else [None if c is None else float(c) for c in x]) for i, x in enumerate(v)]


SCHEMA = "vec_id long, embedding array<double>"


def test_near_vectors_equal_all_pairs(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((60, 24))
    vecs = list(base)
    for x in base[:20]:
        vecs += [_near(x, c, rng) for c in (0.999, 0.96, 0.94)]
    hot = base[30]
    vecs += [_near(hot, 0.993, rng) for _ in range(90)]  # a group in a ball
    vecs += [_near(hot, c, rng) for c in np.linspace(0.90, 0.99, 40)]  # around its border
    vecs += [base[5]] * 7 + [base[5] * 2.5]
    vecs += [None, [], [0.0] * 24, [*base[1][:-1], None], [*base[1][:-1], math.nan], [*base[1][:-1], math.inf], list(base[2][:5]), list(base[2][:5] * 1.001)]
    rows = _rows(vecs)
    rows += [rows[0], (0, rows[1][1]), (None, rows[3][1])]
    want = sorted(map(repr, op12_caps.brute_force(rows)))
    df = spark.createDataFrame(rows, SCHEMA)
    for hub in (8, 32, 10_000):  # with small balls, with one, without any
        assert sorted(repr(tuple(r)) for r in op12_caps.near_vectors(df, hub=hub).collect()) == want
    extra = df.withColumn("key", df.vec_id).withColumn("n", df.vec_id).withColumn("hub", df.vec_id).withColumn("vec", df.vec_id)
    assert sorted(repr(tuple(r)) for r in op12_caps.near_vectors(extra).collect()) == want
    assert op12_caps.near_vectors(df.limit(0)).collect() == []


@pytest.mark.parametrize("vectors", [10_000, 1_000_000])
def test_recall_of_the_filters_at_the_limit(vectors):
    rng = np.random.default_rng(vectors)
    codes = op12_caps.Codes(vectors)
    x = rng.standard_normal((300, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = np.stack([_near(v, 0.95, rng) for v in x])
    _, a, _ = codes.decode(list(x))
    _, b, _ = codes.decode(list(y))
    found = sum(len(np.intersect1d(p, q)) > 0 for p, q in zip(a, b, strict=True))
    assert found >= 0.99 * len(x)


def test_decoding_lists_every_filter_beyond_the_threshold():
    code = op12_caps.Code(12, 5, 20, 1)
    x = np.random.default_rng(2).standard_normal((20, 12))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    top, lists = code.decode(x)
    s = code.wide // 4
    for v, best, found in zip(x, top, lists, strict=True):
        y = v @ code.turn
        every = {}
        for k in itertools.product(range(5), repeat=4):
            every[((k[0] * 5 + k[1]) * 5 + k[2]) * 5 + k[3]] = sum(float(y[i * s : (i + 1) * s] @ code.words[i][k[i]]) for i in range(4))
        limit = min(code.threshold, sorted(every.values())[-code.least])
        assert set(found.tolist()) == {f for f, p in every.items() if p >= limit - 1e-9}
        assert every[int(best)] == pytest.approx(max(every.values()))


# 13: filters


def test_swaps_visit_every_order_once():
    for k in range(1, 7):
        order, seen = list(range(k)), {tuple(range(k))}
        for i in op13_audit.swaps(k):
            order[i], order[i + 1] = order[i + 1], order[i]
            seen.add(tuple(order))
        assert len(seen) == math.factorial(k) == len(op13_audit.swaps(k)) + 1


def _audit(docs, labels):
    """The definition: every order applied to the documents."""
    marks = {}
    for i, q, t in labels:
        a, b = marks.get(i, (0, 0))
        marks[i] = (max(a, int(q == 1)), max(b, int(t == 1)))
    rows = []
    for i, text, source in docs:
        t = text or ""
        w = [x for x in t.replace("\x0b", " ").replace("\x0c", " ").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if x]
        twin = i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in docs)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t), "D": any(c in "#$%&*|" for c in t), "E": twin}
        rows.append((source or "", {k for k, v in fails.items() if v}, *(marks.get(i, (0, 0)) if i is not None else (0, 0))))
    out = []
    for part in {r[0] for r in rows}:
        own, total, made = [r for r in rows if r[0] == part], dict.fromkeys("ABCDE", 0), []
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                failing = sum(f in r[1] for r in own)
                made.append([part, "".join(order), step, len(left), len(gone), failing - len(gone), sum(r[1] == {f} for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone)])
                total[f] += len(gone)
        out += [(*m, total[m[1][m[2] - 1]]) for m in made]
    return sorted(out)


def test_audit_equals_applying_every_order(spark):
    rng = random.Random(5)
    many = " ".join(f"w{i}" for i in range(250))
    texts = [None, "", "A B", many, many, many + " #", "w " * 300, "ABC " * 260, many.upper(), "é" * 400, "\x0b".join(f"x{i}" for i in range(220)), " ".join(f"w{i % 977}" for i in range(30_000))]
    docs = [(i, rng.choice(texts), rng.choice(["s1", "s2", None, ""])) for i in range(60)]
    docs += [docs[3], (docs[4][0], many, "s1"), (None, many, "s2"), (None, "", None)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 60, 2)] + [(2, 1, 1), (None, 1, 1)]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string")
    t = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    run = lambda d: sorted(map(tuple, op13_audit.interaction(op13_audit.cells(d, t)).collect()))
    want = _audit(docs, labels)
    assert run(d) == want
    assert run(d.withColumn("part", d.doc_id).withColumn("mask", d.doc_id).withColumn("n", d.doc_id).withColumn("toxic", d.doc_id)) == want
    assert run(d.limit(0)) == []

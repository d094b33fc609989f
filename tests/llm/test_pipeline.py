"""The pipeline over small tables, stage by stage."""

import random

import corpus_pipeline
from gleaner.llm import op5_jaccard, op7_decontaminate, queries

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def _words(seed, n=40):
    return " ".join(f"w{x}" for x in random.Random(seed).choices(range(9973), k=n))


def _tables(spark, folder):
    passage = _words(500, 12)
    texts = {i: _words(i) for i in range(20)}
    texts[3] = "too short"
    texts[5] = texts[4] + " w1"
    texts[6] = texts[4]
    texts[8] = f"{_words(77)} {passage} {_words(78)}"
    texts[9] = f'{_words(9)} token = "abcdefghijklmnop" end'
    texts[10] = None
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts.items()], DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return texts


def test_pipeline_stages(spark, tmp_path):
    texts = _tables(spark, str(tmp_path))
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(out) == set(texts) - {3, 10, 5, 6, 8}
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    red = {r.doc_id: r.text for r in docs.collect()}
    assert '[SECRET]' in red[9] and "abcdefghijklmnop" not in red[9]
    kept = [(i, t) for i, t in texts.items() if i not in (3, 10)]
    first = {c for _, _, c in op5_jaccard.brute_force(kept)}
    clean = {r[0] for r in op7_decontaminate.brute_force([k for k in kept if k[0] in first], [(1, _words(500, 12))]) if not r[-1]}
    assert set(out) == clean


def test_near_duplicates_take_five_words_and_four_fifths(spark):
    base = {i: _words(1000 + 100 * i, 60) for i in range(6)}
    rows = list(base.items())
    rows.append((10, f"{base[0]} {_words(7, 6)}"))  # 3 words 58/64, 5 words 56/62: linked by both
    rows.append((11, f"{base[1]} {_words(8, 10)}"))  # 58/68 and 56/66: between the thresholds
    rows.append((12, f"{base[2]} {_words(9, 20)}"))  # 58/78 and 56/76: linked by neither
    rows += [(13, "one two three"), (14, "one two three"), (15, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)
    got = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()}
    assert got == {c for _, _, c in op5_jaccard.brute_force(rows, 5, 4, 5)} == {0, 1, 2, 3, 4, 5, 12, 13, 15}
    assert 11 in {c for _, _, c in op5_jaccard.brute_force(rows)}


def test_every_text_of_a_repeated_doc_id_is_judged_alone(spark):
    t = [_words(2000 + 100 * i, 50) for i in range(5)]
    rows = [(1, t[0]), (5, t[0]), (5, t[1]), (9, t[2]), (9, t[2]), (7, t[3]), (8, t[3]), (8, t[4]), (8, None), (8, None), (None, t[0]), (None, t[0])]
    docs = spark.createDataFrame([(i, x, "en", "s", len(x or "")) for i, x in rows], DOCS)
    keep = sorted([(1, t[0]), (5, t[1]), (9, t[2]), (7, t[3]), (8, t[4]), (8, None), (None, t[0]), (None, t[0])], key=repr)
    assert sorted(((r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()), key=repr) == keep
    extra = docs.selectExpr("*", "map('a', doc_id) as `tags`", "named_struct('x', array(text)) as `n`", "n_chars as `component_id`")
    got = corpus_pipeline.near_duplicates(spark, extra, "")
    assert got.columns == extra.columns and sorted(((r.doc_id, r.text) for r in got.collect()), key=repr) == keep
    assert corpus_pipeline.near_duplicates(spark, docs.limit(0), "").collect() == []


def test_near_links_at_four_fifths_equal_all_pairs(spark):
    rng = random.Random(11)
    rows = []
    for n in (4, 5, 6, 9, 15, 30, 60, 120, 200):
        for _ in range(4):
            t = [f"v{rng.randrange(300)}" for _ in range(n)]
            for _ in range(4):
                rows.append((len(rows), " ".join(t)))
                for _ in range(rng.choice((0, 1, 2))):
                    t[rng.randrange(n)] = f"v{rng.randrange(300)}"
    got = sorted(map(tuple, op5_jaccard.links(spark.createDataFrame(rows, "doc_id long, text string"), **corpus_pipeline.NEAR).collect()))
    assert got == sorted(op5_jaccard.brute_force(rows, 5, 4, 5))


def test_registry():
    q = queries.queries()
    for n in range(1, 14):
        assert sum(k.startswith(f"op{n}_") for k in q) == 1
    assert set(queries.oracle_sql()) <= set(q)

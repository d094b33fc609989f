r"""Operator 9 [native]: quality rules with adaptive thresholds.

Per document the operator measures words, characters in words, symbols, repeated
lines and words in repeated 5-word windows.  Fixed base rules reject very short and
very repetitive texts.  The other rules have no fixed cutoffs: for each (lang,
source), and for the wider groups lang and all documents, a mergeable quantile
sketch of every rate is built over the documents that pass the base rules, and a
document is rejected where a rate lies outside its group's fence: beyond the upper
quartile by more than ``REACH`` times the distance of the quartiles, both on a log
scale, and for the length of words below the lower one likewise.  The distance is at
least one cell of the sketch.

Rates are (count + s) / (size + t) with the small prior of ``RATES``, so that the
many documents without any symbol or repeat still have a spread: that of what their
length can show.  Fences follow the group: where a source writes tables, symbols are
ordinary there and no document goes for them.

The sketch of a rate is its histogram over cells on a log scale: a rate, as a whole
number of 2^-20, keeps its first ``BITS`` binary digits, so any quantile has a
relative error below 2^(1 - BITS).  Merging is addition, so the result depends on
neither partitions nor order.  Cells are summed before the shuffle, so a source with
a third of all rows sends at most some thousand cells per task.  A group with fewer
than ``min_group`` such documents borrows the sketch of the next wider group.
Sketches are reduced to one row of fences per group, and joined back to the documents.

Defined results.  Null or empty text: zero words, base_failed.  Null lang or source
form groups of their own.  Repeated rows count and are returned each.  Where all
documents fail the base rules, nothing else is asked of them.  An empty table gives
an empty result.  Extra columns do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store

WINDOW = 5
MIN_GROUP = 200
BITS = 10
REACH = 4
#: rate: count, size, prior count s, prior size t, whether there is a lower fence too.
RATES = {
    "word_length": ("word_chars", "n_words", 50, 10, True),
    "symbols": ("n_symbols", "word_chars", 1, 1000, False),
    "dup_lines": ("n_dup_lines", "n_lines", 1, 10, False),
    "repeats": ("n_repeat_words", "n_words", 1, 100, False),
}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")

_WS = r"[\x20\x09-\x0D]+"


def measured(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns and the measures n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words (long)."""
    t = F.coalesce(F.col(text), F.lit(""))
    a = docs.select(*keep, t.alias("__t"), F.filter(F.split(t, _WS), lambda w: w != "").alias("__w"))
    b = a.select(*keep, "__t", F.size("__w").alias("__n"), F.transform("__w", lambda w: F.xxhash64(w)).alias("__h"))
    w = F.when(
        F.col("__n") >= WINDOW,
        F.transform(F.sequence(F.lit(1), F.col("__n") - (WINDOW - 1)), lambda i: F.xxhash64(*[F.element_at("__h", i + k) for k in range(WINDOW)])),
    ).otherwise(F.array().cast("array<bigint>"))
    lines = F.filter(F.split("__t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    c = b.select(
        *keep,
        F.col("__n").cast("long").alias("n_words"),
        F.length(F.regexp_replace("__t", _WS, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("__t", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        lines.alias("__l"),
        w.alias("__v"),
    )
    d = c.select(*keep, "n_words", "word_chars", "n_symbols", F.size("__l").cast("long").alias("n_lines"), (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"), "__v", F.size("__v").alias("__m"), F.size(F.array_distinct("__v")).alias("__d"))
    # only texts with a repeated window sort their windows
    pairs = F.when(F.col("__m") > F.col("__d"), F.sort_array(F.transform("__v", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    e = d.select(*keep, "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "__m", pairs.alias("__s"))
    same = lambda i, j: F.element_at("__s", i)["h"] == F.element_at("__s", j)["h"]
    starts = F.sort_array(F.transform(F.filter("__s", lambda x, i: ((i > 0) & same(F.greatest(i, F.lit(1)), i + 1)) | ((i < F.col("__m") - 1) & same(i + 1, F.least(i + 2, F.col("__m"))))), lambda x: x["i"]))
    f = e.select(*keep, "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", starts.alias("__p"))
    gaps = F.zip_with(F.slice("__p", F.lit(2), F.size("__p")), "__p", lambda after, at: F.least(F.lit(WINDOW), F.coalesce(after - at, F.lit(WINDOW))))
    covered = F.aggregate(gaps, F.lit(0).cast("long"), lambda s, x: s + x)
    return f.select(*keep, "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def rates() -> dict[str, Column]:
    """The rates in whole numbers of 2^-20."""
    return {k: F.expr(f"shiftleft({num} + {s}L, 20) div ({den} + {t}L)") for k, (num, den, s, t, _) in RATES.items()}


def cell(rate: Column, upper: bool = False) -> Column:
    """The lower end of a rate's cell: its first ``BITS`` binary digits, the others zero; ``upper``: where the next cell begins."""
    drop = F.greatest(F.length(F.bin(rate)) - BITS, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", rate, drop) + int(upper), drop)


def sketches(m: DataFrame) -> DataFrame:
    """lang, source, rate, cell, n: the mergeable sketches of the finest groups, over what passes the base rules."""
    packed = F.array(*[F.struct(F.lit(k).alias("rate"), cell(r).alias("cell")) for k, r in rates().items()])
    return m.filter(~base_failed()).select("lang", "source", F.explode(packed).alias("x")).groupBy("lang", "source", "x.rate", "x.cell").agg(F.count("*").alias("n"))


def _fences(s: DataFrame, by: list[str]) -> DataFrame:
    """Lower and upper fence of every rate per group, from merged sketches, and the group's size."""
    merged = s.groupBy(*by, "rate", "cell").agg(F.sum("n").alias("n"))
    per = merged.groupBy(*by, "rate").agg(F.sum("n").alias("size"), F.sort_array(F.collect_list(F.struct("cell", "n"))).alias("h"))  # at most 2^(BITS - 1) cells for each doubling

    def quantile(q):
        run = F.aggregate(
            "h",
            F.struct(F.lit(0).cast("long").alias("seen"), F.lit(-1).cast("long").alias("at")),
            lambda a, x: F.struct((a["seen"] + x["n"]).alias("seen"), F.when((a["at"] < 0) & (a["seen"] + x["n"] >= F.ceil(q * F.col("size"))), x["cell"]).otherwise(a["at"]).alias("at")),
        )
        return run["at"]

    # the quartiles' outer ends, so that a group whose rates are all in one cell has a spread of one cell
    q = per.select(*by, "rate", "size", quantile(0.25).cast("double").alias("a"), quantile(0.75).alias("b"))
    q = q.withColumn("b", cell(F.col("b"), upper=True).cast("double")).withColumn("r", F.col("b") / F.col("a"))
    far = F.col("r")
    for _ in range(REACH - 1):
        far = far * F.col("r")
    one = [F.max(F.when(F.col("rate") == k, x)).alias(f"{side}_{k}") for k in RATES for side, x in (("low", F.col("a") / far), ("high", F.col("b") * far))]
    return q.groupBy(*by).agg(F.max("size").alias("size"), *one) if by else q.agg(F.max("size").alias("size"), *one)


FENCES = [f"{side}_{k}" for k in RATES for side in ("low", "high")]


def thresholds(m: DataFrame, min_group: int = MIN_GROUP) -> DataFrame:
    """One row per (lang, source) with the fences low_ and high_ of every rate, in 2^-20."""
    s = store.table(sketches(m), "op9-sketch")
    fine, lang, whole = _fences(s, ["lang", "source"]), _fences(s, ["lang"]), _fences(s, [])
    named = lambda df, p: df.select(*[F.col(c).alias(f"{p}{c}") for c in df.columns])
    j = fine.join(named(lang, "l_"), fine["lang"].eqNullSafe(F.col("l_lang")), "left").crossJoin(named(whole, "w_"))  # one row of fences over all documents
    pick = lambda k: F.when(F.col("size") >= min_group, F.col(k)).when(F.col("l_size") >= min_group, F.col(f"l_{k}")).otherwise(F.col(f"w_{k}"))
    return j.select("lang", "source", *[pick(k).alias(k) for k in FENCES])


def verdicts(m: DataFrame, limits: DataFrame) -> DataFrame:
    """``m`` with base_failed and kept."""
    t = limits.select(F.col("lang").alias("__lang"), F.col("source").alias("__source"), *[F.col(k).alias(f"__{k}") for k in FENCES])
    j = m.join(t, F.col("lang").eqNullSafe(F.col("__lang")) & F.col("source").eqNullSafe(F.col("__source")), "left")
    good = F.lit(True)
    for k, r in rates().items():
        good = good & (r <= F.col(f"__high_{k}"))
        if RATES[k][4]:
            good = good & (r >= F.col(f"__low_{k}"))
    return j.select(*[F.col(f"`{c}`") for c in m.columns], base_failed().alias("base_failed"), F.coalesce(~base_failed() & good, F.lit(False)).alias("kept"))


def quality(docs: DataFrame, *, min_group: int = MIN_GROUP) -> DataFrame:
    """doc_id, measures, base_failed and kept for every row."""
    m = store.table(measured(docs, ["doc_id", "lang", "source"]), "op9-measures")
    return verdicts(m, thresholds(m, min_group)).drop("lang", "source", "n_lines")


def keep_good(docs: DataFrame, *, min_group: int = MIN_GROUP) -> DataFrame:
    """The rows of ``docs`` that are kept, with their columns."""
    names = docs.columns
    m = store.table(measured(docs.select("*", F.col("text").alias("__text")), [f"`{c}`" for c in names], "__text"), "op9-docs")
    return verdicts(m, thresholds(m, min_group)).filter("kept").select(*[f"`{c}`" for c in names])


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(store.read(spark, sf_dir, "documents"))


#: Rows of documents with measures and verdicts; {docs} is a table.
ORACLE_CTE = r"""
q_words AS MATERIALIZED (
  SELECT *, row_number() OVER () AS rid, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM {docs}
), q_win AS MATERIALIZED (
  SELECT rid, list_transform(range(1, greatest(len(w) - 3, 1)), lambda i: array_to_string(w[i:i+4], ' ')) AS v FROM q_words
), q_pos AS (
  SELECT rid, list(p ORDER BY p) AS pos FROM (
    SELECT rid, p, count(*) OVER (PARTITION BY rid, x) AS c FROM (
      SELECT rid, unnest(v) AS x, generate_subscripts(v, 1) AS p FROM q_win WHERE len(v) <> len(list_distinct(v)))) WHERE c > 1 GROUP BY rid
), q_m AS (
  SELECT q_words.* EXCLUDE (w, l, rid), len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
    len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
    coalesce(list_sum(list_transform(range(1, len(pos) + 1), lambda i: least(5, coalesce(pos[i+1] - pos[i], 5)))), 0)::BIGINT AS n_repeat_words
  FROM q_words LEFT JOIN q_pos USING (rid)
), q_c AS (
  SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed, {rates} FROM q_m
), q_lim AS (
  SELECT q_c.*, {picked}
  FROM q_c LEFT JOIN (SELECT lang AS g1, source AS g2, count(*) AS n, {fine} FROM q_c WHERE NOT base_failed GROUP BY ALL) ON lang IS NOT DISTINCT FROM g1 AND source IS NOT DISTINCT FROM g2
  LEFT JOIN (SELECT lang AS g3, count(*) AS nl, {lang} FROM q_c WHERE NOT base_failed GROUP BY ALL) ON lang IS NOT DISTINCT FROM g3
  CROSS JOIN (SELECT {whole} FROM q_c WHERE NOT base_failed)
), q_out AS (
  SELECT *, coalesce(NOT base_failed AND {tests}, false) AS kept FROM q_lim
)"""


def _sql_parts() -> dict[str, str]:
    """Pieces of the oracle: quantiles of the rates themselves, cut to the sketch's digits afterwards."""

    def quartile(k, q, more):
        v = f"quantile_disc(v_{k}, {q})"
        drop = f"greatest(length(bin({v})) - {BITS}, 0)"
        return f"(((({v} >> {drop}) + {more}) << {drop})::DOUBLE)"

    both = lambda p: ", ".join(f"{quartile(k, q, more)} AS {p}{end}_{k}" for k in RATES for q, end, more in ((0.25, "a", 0), (0.75, "b", 1)))
    pick = ", ".join(f"CASE WHEN n >= {MIN_GROUP} THEN f{end}_{k} WHEN nl >= {MIN_GROUP} THEN l{end}_{k} ELSE w{end}_{k} END AS {end}_{k}" for k in RATES for end in "ab")
    tests = []
    for k, (*_, lower) in RATES.items():
        far = "(" + " * ".join([f"(b_{k} / a_{k})"] * REACH) + ")"
        tests.append(f"v_{k} <= b_{k} * {far}")
        if lower:
            tests.append(f"v_{k} >= a_{k} / {far}")
    own = ", ".join(f"(({num} + {s})::BIGINT << 20) // ({den} + {t}) AS v_{k}" for k, (num, den, s, t, _) in RATES.items())
    return {"rates": own, "picked": pick, "fine": both("f"), "lang": both("l"), "whole": both("w"), "tests": " AND ".join(tests)}


def oracle_cte(docs: str = "documents") -> str:
    out = ORACLE_CTE.replace("{docs}", docs)
    for name, text in _sql_parts().items():
        out = out.replace("{" + name + "}", text)
    return out


ORACLE = f"WITH {oracle_cte()}\nSELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM q_out"

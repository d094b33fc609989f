r"""Operator 13: how filters interact, over all orders in which they can be applied.

Every document gets a mask of the filters it fails; masks are counted by part (source), so
all that follows works on at most 2^k cells a part.  The k! orders are visited by single
swaps of neighbours: a swap changes what the two swapped steps remove, and nothing else,
so only these two are summed again from the cells.  What each filter removes is added up
along the walk; that sum over all orders is its Shapley value times k!.

The five filters of :data:`CONDITIONS` (words are maximal ``[^\x20\x09-\x0D]+``):

* A: fewer than 200 words
* B: 100 * distinct words < 50 * words
* C: 100 * letters ``[A-Z]`` > 2 * code points
* D: any of ``#$%&*|``
* E: the text equals that of a smaller doc_id, anywhere in the table

Texts are compared by their SHA-256, whose shuffle holds 32 bytes a text, and rows of one
text are counted by part and mask before they meet, so copies never gather in one task.

Defined results.  A null text is empty: it fails A and, beside a smaller doc_id with an
empty text, E.  A null source is the part ''.  A null doc_id fails no E and makes none
fail; its labels are unknown.  Rows that repeat a doc_id all count and do not make each
other fail E.  A doc_id labelled twice has a label if any of its rows has it.  Empty
tables give no parts.  Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store

SPACE = r"[\x20\x09-\x0D]+"


def conditions(text: Column) -> dict[str, Column]:
    """Failure conditions that a text decides alone, by letter."""
    words = F.array_remove(F.split(text, SPACE), "")
    n = F.size(words)
    return {
        "A": n < 200,
        "B": F.size(F.array_distinct(words)) * F.lit(100).cast("long") < n * F.lit(50).cast("long"),
        "C": F.regexp_count(text, F.lit("[A-Z]")) * F.lit(100).cast("long") > F.length(text) * F.lit(2).cast("long"),
        "D": text.rlike(r"[#$%&*|]"),
    }


LETTERS = "ABCDE"


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: documents by part and by the set of filters they fail."""
    text = F.coalesce("text", F.lit(""))
    mask = sum((c.cast("int") * (1 << LETTERS.index(k)) for k, c in conditions(text).items()), F.lit(0))
    told = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), mask.alias("mask"), F.unhex(F.sha2(text, 256)).alias("digest"))
    has = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)))
    marked = labels.filter("doc_id is not null").groupBy("doc_id").agg(has("quality").alias("good"), has("toxic").alias("toxic"))
    keys = ["digest", "part", "mask", "good", "toxic"]
    rows = told.join(marked, "doc_id", "left").groupBy("doc_id", *keys).agg(F.count("*").alias("n"))
    # of one text: rows of each part and mask, and how many of them have the least doc_id
    alike = rows.groupBy(*keys).agg(F.sum("n").alias("n"), F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("least"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("unnamed"))
    first = alike.groupBy("digest").agg(F.min("least.doc_id").alias("first"))
    met = alike.join(first, "digest")
    own = F.col("unnamed") + F.when(F.col("least.doc_id") == F.col("first"), F.col("least.n")).otherwise(0)
    both = F.array(F.struct(F.col("mask"), own.alias("n")), F.struct((F.col("mask") + (1 << LETTERS.index("E"))).alias("mask"), (F.col("n") - own).alias("n")))
    found = met.select("part", "good", "toxic", F.explode(both).alias("c")).select("part", "good", "toxic", "c.mask", "c.n").filter("n > 0")
    some = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(c)
    return found.groupBy("part", "mask").agg(F.sum("n").alias("n"), some("good"), some("toxic"))


def swaps(k: int) -> list[int]:
    """Places i whose neighbours i, i + 1 are swapped to visit all orders of k items."""
    if k < 2:
        return []
    inner, out, down = swaps(k - 1), [], True
    for s in [*inner, None]:  # the last item runs through every order of the others, to and fro
        run = list(range(k - 1))
        out += run[::-1] if down else run
        if s is not None:
            out.append(s + down)
        down = not down
    return out


def walk(counts: np.ndarray, letters: str = LETTERS):
    """(orders, kept, removed, good, toxic, shapley) of parts whose cells are ``counts[part, mask, (n, good, toxic)]``.

    ``orders`` is a list of orders; the arrays have axes part, order, step; ``shapley`` has axes part, letter.
    """
    k, parts = len(letters), len(counts)
    at = np.arange(1 << k)

    def removed(before: int, f: int) -> np.ndarray:
        return counts[:, (at & before == 0) & (at >> f & 1 == 1)].sum(axis=1)

    order = list(range(k))
    step = np.stack([removed((1 << i) - 1, i) for i in range(k)], axis=1)  # part, step, (n, good, toxic)
    orders, seen, total = [], [], np.zeros((parts, k), np.int64)
    for i in [None, *swaps(k)]:
        if i is not None:
            order[i], order[i + 1] = order[i + 1], order[i]
            before = sum(1 << f for f in order[:i])
            step[:, i] = removed(before, order[i])
            step[:, i + 1] = removed(before | 1 << order[i], order[i + 1])
        total[:, order] += step[:, :, 0]
        orders.append("".join(letters[f] for f in order))
        seen.append(step.copy())
    whole = np.stack(seen, axis=1)
    kept = counts[:, :, 0].sum(axis=1)[:, None, None] - np.cumsum(whole[..., 0], axis=2)
    return orders, kept, whole[..., 0], whole[..., 1], whole[..., 2], total


OUT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"
#: Parts that are walked together.
TOGETHER = 64


def interaction(cells: DataFrame) -> DataFrame:
    """One row per part, order and step from :func:`cells`."""
    k = len(LETTERS)
    lists = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # 2^k cells at most

    def run(batches):
        for whole in batches:
            for at in range(0, len(whole), TOGETHER):
                batch = whole.slice(at, TOGETHER)
                parts = batch.column("part").to_pylist()
                counts = np.zeros((len(parts), 1 << k, 3), np.int64)
                for p, found in enumerate(batch.column("cells").to_pylist()):
                    for c in found:
                        counts[p, c["mask"]] = c["n"], c["good"], c["toxic"]
                orders, kept, removed, good, toxic, shapley = walk(counts)
                at_letter = np.array([[LETTERS.index(c) for c in o] for o in orders])
                has = (np.arange(1 << k)[:, None] >> np.arange(k) & 1).astype(np.int64)
                fails = counts[:, :, 0] @ has  # part, letter
                alone = counts[:, 1 << np.arange(k), 0]
                columns = [kept, removed, fails[:, at_letter] - removed, alone[:, at_letter], good, toxic, shapley[:, at_letter]]
                m = len(orders) * k
                names = [pa.array(np.repeat(np.array(parts, object), m), pa.string()), pa.array(np.tile(np.repeat(np.array(orders, object), k), len(parts)), pa.string()), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(parts) * len(orders)))]
                yield pa.RecordBatch.from_arrays([*names, *[pa.array(c.reshape(-1)) for c in columns]], names=["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"])

    return lists.mapInArrow(run, OUT)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interaction(cells(store.read(spark, sf_dir, "documents"), store.read(spark, sf_dir, "labels")))


def _oracle() -> str:
    letters = ", ".join(f"('{c}', {1 << i})" for i, c in enumerate(LETTERS))
    names = "abcde"
    perms = ", ".join(f"l {x}" for x in names)
    differ = " and ".join(f"{x}.c <> {y}.c" for i, x in enumerate(names) for y in names[:i])
    before = " union all ".join(f"select {'||'.join(f'{x}.c' for x in names)} as o, {s + 1} as step, {names[s]}.c as f, {names[s]}.b as b, {' + '.join(['0', *[f'{x}.b' for x in names[:s]]])} as before from {perms} where {differ}" for s in range(5))
    return rf"""
with l(c, b) as (values {letters}),
steps as materialized ({before}),
t as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as text from documents),
w as (select *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as ws, min(doc_id) over (partition by text) as first from t),
g as (select doc_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as toxic from labels group by doc_id),
m as (select part, good, toxic,
  case when len(ws) < 200 then 1 else 0 end
  + case when 100 * len(list_distinct(ws)) < 50 * len(ws) then 2 else 0 end
  + case when 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) then 4 else 0 end
  + case when regexp_matches(text, '[#$%&*|]') then 8 else 0 end
  + case when doc_id > first then 16 else 0 end as mask
  from w left join g using (doc_id)),
cells as materialized (select part, mask, count(*) as n, coalesce(sum(good), 0) as good, coalesce(sum(toxic), 0) as toxic from m group by part, mask),
r as (select part, o, step, f, b,
  sum(case when mask & (before + b) = 0 then n else 0 end) as kept,
  sum(case when mask & before = 0 and mask & b > 0 then n else 0 end) as removed,
  sum(case when mask & before > 0 and mask & b > 0 then n else 0 end) as redundant,
  sum(case when mask = b then n else 0 end) as unique_fails,
  sum(case when mask & before = 0 and mask & b > 0 then good else 0 end) as good_lost,
  sum(case when mask & before = 0 and mask & b > 0 then toxic else 0 end) as toxic_lost
  from cells, steps group by part, o, step, f, b)
select part, o as filter_order, step::int as step, kept::bigint as kept, removed::bigint as removed, redundant::bigint as redundant, unique_fails::bigint as unique_fails,
  good_lost::bigint as good_lost, toxic_lost::bigint as toxic_lost, (sum(removed) over (partition by part, f))::bigint as shapley
from r
"""


ORACLE = _oracle()

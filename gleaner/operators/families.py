"""Families of numbers in a text: a lower and an upper bound of one noun, and neighbours that share a word."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tokens between two numbers that may share a word.
APART = 10


def family_ids(positions: list[int], bounds: list[str], nouns: list[set], words: list[set]) -> list[int | None]:
    """Family of each number of one text, None where it is alone.

    Lower bounds, in order, take the free upper bound with which they share most nouns, the first
    of equals.  Then pairs of numbers at most ``APART`` tokens apart that share a word are gone through in order: a
    number without a family joins the other's, and where both have one, the second moves to that of the first.
    """
    of: dict[int, int] = {}
    families, taken = 0, set()
    uppers = [k for k, b in enumerate(bounds) if b == "upper"]
    for k, b in enumerate(bounds):
        if b != "lower":
            continue
        shared = [(len(nouns[k] & nouns[u]), -u) for u in uppers if u not in taken and nouns[k] & nouns[u]]
        if shared:
            best = -max(shared)[1]
            taken.add(best)
            of[k] = of[best] = families
            families += 1
    for i, at in enumerate(positions):
        for j in range(i + 1, len(positions)):
            if positions[j] - at > APART:
                break
            if not words[i] & words[j] or (i in of and of[i] == of.get(j)):
                continue
            if i not in of and j not in of:
                of[i], families = families, families + 1
            of[i] = of[j] = of.get(i, of.get(j))
    return [of.get(k) for k in range(len(positions))]


def quantity_families(numbers: DataFrame, by: str, shape: str | None = None) -> DataFrame:
    """by, mention_id, family of every number; ``numbers`` has by, mention_id, position, bound_role, nouns, quantity_words.

    The numbers of one text are one row; a task takes such rows by batches.  ``shape``: a column that is the same in all
    numbers of a text, by which they are dealt already, so that they do not move again.
    """
    schema = numbers.select(by, "mention_id").schema.add("family", "integer")
    own = F.struct("position", "mention_id", "bound_role", "nouns", "quantity_words")
    texts = numbers.groupBy(by, *([shape] if shape else [])).agg(F.sort_array(F.collect_list(own)).alias("x"))

    def run(batches):
        for batch in batches:
            lists = batch.column("x")
            ends, flat = lists.offsets.to_pylist(), lists.values
            at, mention, bound, nouns, words = (flat.field(k).to_pylist() for k in ("position", "mention_id", "bound_role", "nouns", "quantity_words"))
            nouns, words, ids, found = [set(n) for n in nouns], [set(w) for w in words], [], []
            for i, (a, b) in enumerate(zip(ends, ends[1:], strict=False)):
                ids += family_ids(at[a:b], bound[a:b], nouns[a:b], words[a:b])
                found += [i] * (b - a)
            some = slice(ends[0], ends[-1])
            yield pa.RecordBatch.from_arrays([batch.column(by).take(pa.array(found, pa.int32())), pa.array(mention[some], pa.int32()), pa.array(ids, pa.int32())], names=schema.names)

    return texts.mapInArrow(run, schema)

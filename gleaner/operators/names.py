"""Joins of names that contain each other, by an index of their rarest grams instead of a nested loop."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of a gram.
GRAM = 4


def _grams(text: Column, n: int) -> Column:
    """Distinct parts of ``n`` characters."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(rf"(?s)(?=(.{{{n}}}))"), F.lit(1)))  # one pass, where substrings by position would each count from the start


def containing(needles: DataFrame, hay: DataFrame, needle: str, text: str, *, gram: int = GRAM) -> DataFrame:
    """Distinct (needle, text) where the text contains the needle; null and empty needles are in none.

    A needle is looked up by that gram of its own which the fewest texts have, so a common gram is
    a key only for needles that have nothing rarer; a shorter needle is its own gram.  Texts bring
    only the grams that some needle has.  Candidates are checked by ``contains``.
    """
    n = needles.select(F.col(needle).alias("needle")).filter("needle <> ''").distinct()
    h = hay.select(F.col(text).alias("text")).filter("text is not null").distinct()
    lengths = sorted(r[0] for r in n.select(F.least(F.length("needle"), F.lit(gram))).distinct().collect())  # at most ``gram`` values
    if not lengths:
        return n.join(h, F.lit(False))
    own = reduce(DataFrame.unionByName, [n.filter(F.least(F.length("needle"), F.lit(gram)) == k).select("needle", F.explode(_grams(F.col("needle"), k)).alias("g")) for k in lengths])
    held = h.select("text", F.explode(F.flatten(F.array(*[_grams(F.col("text"), k) for k in lengths]))).alias("g")).join(own.select("g").distinct(), "g", "left_semi")
    many = held.groupBy("g").agg(F.count("*").alias("n"))
    known = own.join(many, "g", "left").groupBy("needle").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "g")).alias("rarest"))
    rare = known.filter("rarest.n > 0").select("needle", F.col("rarest.g").alias("g"))
    return rare.join(held, "g").filter(F.contains("text", F.col("needle"))).select("needle", "text")


def first_match(names: DataFrame, catalog: DataFrame, name: str, by: str, order: str) -> DataFrame:
    """``name`` and ``order`` of the first catalog entry, by ``order``, whose name equals, contains or is part of it.

    Names are compared trimmed and in lower case.  A blank name matches nothing; a catalog entry with
    a blank name is part of every name.  Names without a match have a null ``order``.
    """
    clean = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    n = names.select(F.col(name), clean(F.col(name)).alias("__n")).distinct()
    c = catalog.select(clean(F.col(by)).alias("__c"), F.col(order).alias("__o")).groupBy("__c").agg(F.min("__o").alias("__o"))  # the first of equal names stands for them
    inside = containing(n, c, "__n", "__c").select(F.col("needle").alias("__n"), F.col("text").alias("__c"))
    around = containing(c, n, "__c", "__n").select(F.col("text").alias("__n"), F.col("needle").alias("__c"))
    blank = c.filter("__c = ''").select("__o")  # one row at most
    every = n.filter("__n <> ''").select("__n").distinct().crossJoin(F.broadcast(blank))
    found = inside.unionByName(around).join(c, "__c").select("__n", "__o").unionByName(every).groupBy("__n").agg(F.min("__o").alias(order))
    return n.join(found, "__n", "left").select(name, order)

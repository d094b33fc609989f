"""Roles of numbers by the cues within six tokens: operators, targets, constraints, bounds, direction, relevance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import parts, saved, unsent
from . import mentions as M

# Cues, in order, each looked for as a part of the window's text.
CUES = {
    "addition": ("gained", "received", "bought", "added", "more", "another", "increase"),
    "subtraction": ("lost", "spent", "gave away", "sold", "used", "ate", "left", "remaining", "after", "decrease", "reduce"),
    "rate": ("each", "every", "per", "for each", "daily", "weekly", "hourly"),
    "division": ("average", "total", "evenly", "divided"),
    "comparison": ("more than", "less than", "difference", "fewer than", "greater than"),
    "capacity": ("minimum", "at least", "enough", "max", "maximum"),
}
TARGET = ("maximize", "minimize", "optimal", "most", "least", "profit", "cost", "revenue")
CONSTRAINT = ("must", "require", "cannot", "limit", "exactly", "constraint")
UPWARD, DOWNWARD = ("maximize", "most", "revenue"), ("minimize", "least", "cost")
LOWER = ("at least", "no fewer than", "not fewer than", "no less than", "not less than", "greater than or equal", "minimum of", "minimum number of", "≥")
UPPER = ("at most", "no more than", "not more than", "no greater than", "less than or equal", "maximum of", "maximum number of", "≤")
# Words that are numbers beside those of ``mentions``; compounds are none here.
WRITTEN = {w: float(v) for w, v in M.SMALL.items() if "-" not in w} | {"hundred": 100.0, "thousand": 1_000.0, "million": 1_000_000.0, "half": 0.5}
# Words that name no quantity.
STOP = (
    "the", "a", "an", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did", "will", "would", "could", "should", "may", "might", "shall", "can", "to", "of",
    "in", "for", "on", "with", "at", "by", "from", "as", "into", "through", "during", "and", "but", "or", "nor", "so", "yet", "if", "then", "than", "that", "this", "these", "those", "it", "its",
    "he", "she", "they", "we", "you", "i", "me", "him", "her", "us", "them", "what", "which", "who", "how", "when", "where", "why", "not", "no", "very", "just", "also",
)
NUMBER = r"^-?\d+(?:[.,]\d+)?$"
RANGES = (r"(?i)between\s+(\d[\d.,]*)\s+and\s+(\d[\d.,]*)", r"(?i)from\s+(\d[\d.,]*)\s+to\s+(\d[\d.,]*)")
# Tokens on either side for cues and for a number's nouns; years, and numbers too large to be meant.
REACH, NOUNS = 6, 4
YEARS, HUGE = (1900, 2099), 1e9


def trimmed(token: Column) -> Column:
    return F.regexp_replace(token, r"^[.,!?;:]+|[.,!?;:]+$", "")


def _cues(text: Column, cues) -> Column:
    return F.array_compact(F.array(*[F.when(text.contains(c), c) for c in cues]))


def _number(text: Column) -> Column:
    return F.regexp_replace(text, ",", "").try_cast("double")


def ranged(text: Column) -> Column:
    """Values at either end of "between x and y" and "from x to y"; none of a pair that is not two numbers."""
    ends = []
    for p in RANGES:
        a, b = (F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(k)), _number) for k in (1, 2))
        ends.append(F.flatten(F.filter(F.zip_with(a, b, lambda x, y: F.array(x, y)), lambda xy: xy[0].isNotNull() & xy[1].isNotNull())))
    return F.concat(*ends)


def _tokens(lowered: Column) -> Column:
    return F.filter(F.split(lowered, r"\s+"), lambda x: x != "")


def _cued(shapes: DataFrame) -> DataFrame:
    """__key (digest of the shape), mention_id, position and all that does not depend on which digits the text has; ``near`` and ``close`` are positions of words."""
    written = M._table(WRITTEN)

    def found(tok):
        def at(words):
            value = lambda w, i: F.struct(w.rlike(NUMBER).alias("digits"), F.try_element_at(written, w).alias("written"), (~w.isin(*STOP)).alias("named"), i.alias("position"))

            def mentions(own):
                def spot(m, n, itself):
                    i = m["position"]
                    around = F.slice(own, F.greatest(i - n, F.lit(0)) + 1, F.least(i, F.lit(n)) + n + 1)
                    return F.transform(F.filter(around, lambda y: y["named"] & ~y["digits"] & (F.lit(itself) | (y["position"] != i))), lambda y: y["position"])

                return F.transform(
                    F.filter(own, lambda m: m["digits"] | m["written"].isNotNull()),
                    lambda m: F.struct(
                        m["position"].alias("position"), m["digits"].alias("digits"), m["written"].alias("written"), spot(m, REACH, False).alias("near"), spot(m, NOUNS, True).alias("close"),
                        F.array_join(F.slice(tok, F.greatest(m["position"] - REACH, F.lit(0)) + 1, F.least(m["position"], F.lit(REACH)) + REACH + 1), " ").alias("window"),
                    ),
                )

            return M.let(F.transform(words, value), mentions)

        return M.let(F.transform(tok, trimmed), at)

    x = shapes.select("__shape", F.posexplode(M.let(_tokens(F.col("__shape")), found)).alias("mention_id", "m")).select("__shape", "mention_id", "m.*")
    w = F.col("window")
    x = x.select("*", *[_cues(w, c).alias(f"__{k}") for k, c in CUES.items()], _cues(w, TARGET).alias("target_cues"), _cues(w, CONSTRAINT).alias("constraint_cues"))
    any_of = lambda parts: F.size(_cues(w, parts)) > 0
    has = lambda c: F.size(c) > 0
    x = x.withColumn("bound_role", F.when(any_of(LOWER), "lower").when(any_of(UPPER), "upper").otherwise("none"))
    towards = lambda words: F.arrays_overlap("target_cues", F.array(*[F.lit(c) for c in words]))
    direction = F.when(has("target_cues"), F.when(towards(UPWARD), "max_like").when(towards(DOWNWARD), "min_like").otherwise("none")).when(has("__rate"), "rate_like").otherwise("none")
    return x.select(
        F.md5("__shape").alias("__key"), "mention_id", "position", "digits", "written", "near", "close", F.concat(*[f"__{k}" for k in CUES]).alias("operator_cues"), "target_cues", "constraint_cues", "bound_role",
        direction.alias("direction"), ((F.col("bound_role") != "none") & has("target_cues")).alias("direction_sensitive"),
        (has("target_cues") | has("constraint_cues") | has("__rate")).alias("required"), (has("__addition") | has("__subtraction")).alias("optional"),
    )


def number_roles(queries: DataFrame, text: str, keep: list[str], shape: str | None = None) -> DataFrame:
    """``keep`` and one row per number: mention_id, surface, value, position and its cues.

    Columns: operator_cues, target_cues, constraint_cues, quantity_words (no stop words or numbers), nouns (distinct, within
    four tokens), bound_role, direction, range_partner, direction_sensitive, relevance.  A null text has no numbers.

    No cue or stop word has a digit, so cues are looked for once in each shape, a text with its runs of digits masked; the
    shapes' cues are written as a table under 128-bit digests, and only values and words are read in every row.
    ``shape``: the name of one more column, that digest, by which the rows are dealt.
    """
    names = [f"`{k}`" for k in keep]
    lowered = F.lower(F.coalesce(F.col(text), F.lit("")))
    rows = queries.select(*names, lowered.alias("__t"), F.regexp_replace(lowered, "[0-9]+", "0").alias("__shape"))
    cued = saved(_cued(rows.select("__shape").distinct().repartition(parts(queries.sparkSession), F.xxhash64("__shape"))), "number-cues")
    # a text moves as it is, and is cut where it lies then
    x = rows.select(*names, F.md5("__shape").alias("__key"), "__t").repartition(parts(queries.sparkSession), "__key")
    x = x.select(*names, "__key", ranged(F.col("__t")).alias("__r"), F.transform(_tokens(F.col("__t")), trimmed).alias("__w")).join(unsent(cued), "__key")
    own = F.get("__w", F.col("position"))
    x = x.withColumn("surface", own).withColumn("value", F.when(F.col("digits"), F.regexp_replace(own, ",", "").cast("double")).otherwise(F.col("written")))
    read = lambda c, n: F.filter(F.transform(c, lambda p: F.get("__w", p)), lambda y: F.length(y) >= n)
    v = F.col("value")
    relevance = F.when(F.col("required"), "role_required").when(v.between(*YEARS) | (v >= HUGE), "role_irrelevant").when(F.col("optional"), "role_optional").otherwise("role_unknown")
    return x.select(
        *names, "mention_id", "surface", "value", "position", "operator_cues", "target_cues", "constraint_cues", read("near", 2).alias("quantity_words"), F.sort_array(F.array_distinct(read("close", 3))).alias("nouns"),
        "bound_role", "direction", F.array_contains("__r", v).alias("range_partner"), "direction_sensitive", relevance.alias("relevance"), *([F.col("__key").alias(shape)] if shape else []),
    )

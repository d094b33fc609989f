r"""Numeric mentions of a query as columns: digits, number words, fractions, ratio words, counts of enumerations.

A query is an array of tokens; every rule looks at a token, its neighbours and the words
around it, so a mention is one expression over the array and nothing leaves the JVM.

Number words are read by place: the run of number words is cut at ``thousand`` and
``million``, a piece is cut at ``hundred``, and what is left are small words that add up.
A piece's parts are the digits of a number to the base 100, a multiplier without a number
before it counts once, and the pieces times their multipliers are summed.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Number words.
ONES = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen")
TENS = ("twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety")
HUNDRED, LARGE = "hundred", {"thousand": 1_000, "million": 1_000_000}
# Fraction words.
FRACTIONS = {
    "half": 1 / 2, "halves": 1 / 2, "third": 1 / 3, "thirds": 1 / 3, "quarter": 1 / 4, "quarters": 1 / 4,
    "one-half": 1 / 2, "one-third": 1 / 3, "one-quarter": 1 / 4, "two-thirds": 2 / 3, "three-quarters": 3 / 4,
}
# Words near a number that tell its kind.
MONEY_CONTEXT = ("budget", "cost", "price", "profit", "revenue", "dollar", "dollars", "$", "€", "usd", "eur")
PERCENT_CONTEXT = ("percent", "percentage", "rate", "fraction")
# Words that multiply; a group gives one mention.
RATIOS = [("RATIO_WORD:twice", r"\btwice\b|\bdouble\b(?!-)|\btwo\s+times\b", 2.0), ("RATIO_WORD:triple", r"\btriple\b(?!-)|\bthree\s+times\b", 3.0)]
# Words that are no items of an enumeration.
NOT_ITEMS = (
    "a", "an", "the", "of", "in", "on", "at", "for", "to", "is", "are", "be", "been", "was", "were", "has", "have", "had", "do", "does", "did", "with", "by", "from", "into", "through",
    "each", "per", "any", "all", "both", "either", "it", "its", "this", "that", "their", "which", "can", "could", "should", "would", "may", "might", "must", "shall", "not", "no", "also",
    "some", "more", "other", "such", "than", "if", "as", "and", "or", "but", "nor", "so", "yet", "total", "overall", "aggregate", "average", "general",
)
# Lists of nouns, and of numbers with nouns.
NOUN_LIST = r"(?i)[A-Za-z][a-zA-Z-]+(?:\s*,\s*[A-Za-z][a-zA-Z-]+)*\s*,?\s*and\s+[A-Za-z][a-zA-Z-]+"
QUANTITY = r"[$]?\d[\d,]*(?:\.\d+)?%?\s+([A-Za-z][a-zA-Z]+)"
QUANTITY_LIST = rf"(?i){QUANTITY}(?:\s*,\s*{QUANTITY})+(?:\s*,?\s*and\s+{QUANTITY})?"

SMALL = {w: i for i, w in enumerate(ONES)} | {w: 10 * i for i, w in enumerate(TENS, 2)} | {f"{t}-{o}": 10 * i + j for i, t in enumerate(TENS, 2) for j, o in enumerate(ONES[1:10], 1)}
#: Tokens on either side of a number that are its context.
REACH = 3
SCHEMA = "array<struct<raw:string,value:double,kind:string>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _table(values: dict[str, float]) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in (kv[0], float(kv[1]))])


def _among(w: Column, words) -> Column:
    return w.isin(*words)


def _any(context: Column, words) -> Column:
    return F.arrays_overlap(context, F.array(*[F.lit(x) for x in words]))


def stripped(token: Column, signs: str = r".,;:()\[\]{}\"'") -> Column:
    """Lower-cased, without punctuation at its ends."""
    return F.regexp_replace(F.lower(token), rf"^[{signs}]+|[{signs}]+$", "")


def is_number_word(w: Column) -> Column:
    return _among(w, (*SMALL, HUNDRED, *LARGE))


def word_value(run: Column) -> Column:
    """Value of an array of number words."""
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)
    times = lambda v: F.greatest(v, F.lit(1.0))
    small = lambda part: total(F.transform(F.split(F.trim(part), " "), lambda w: F.coalesce(F.try_element_at(_table(SMALL), w), F.lit(0.0))))
    piece = lambda p: let(
        F.transform(F.split(p, rf" {HUNDRED}(?= |$)"), small), lambda parts: F.aggregate(F.slice(parts, F.lit(2), F.size(parts)), F.element_at(parts, 1), lambda high, low: times(high) * 100 + low)
    )
    pieces = F.transform(F.split(F.concat(F.lit(" "), F.array_join(run, " ")), rf" (?:{'|'.join(LARGE)})(?= |$)"), piece)
    scales = F.transform(F.filter(run, lambda w: _among(w, LARGE)), lambda w: F.try_element_at(_table(LARGE), w))
    return total(F.zip_with(pieces, scales, lambda v, scale: F.when(scale.isNull(), v).otherwise(times(v) * scale)))


def _mention(raw: Column, value: Column, kind: Column) -> Column:
    return F.struct(raw.alias("raw"), value.cast("double").alias("value"), kind.alias("kind"))


def _plain_kind(value: Column) -> Column:
    return F.when(value == F.floor(value), "int").otherwise("float")


def digits_raw(token: Column) -> Column:
    """A digit token without punctuation behind it."""
    return F.regexp_replace(token, r"[.,;:()\[\]{}]+$", "")


def digits_value(raw: Column) -> Column:
    return F.regexp_replace(raw, r"[$,%]", "").cast("double")


def digit_typed(raw: Column, v: Column, percent: Column, share: Column, money: Column) -> Column:
    """:func:`digit_mention` by whether words of per cent, of shares and of money stand near."""
    signed = raw.endswith("%") | (percent & (v > 1))
    kind = F.when(signed | ((v > 0) & (v <= 1) & share), "percent").when(F.contains(raw, F.lit("$")) | money, "currency").otherwise(_plain_kind(v))
    return _mention(raw, F.when(signed, v / 100).otherwise(v), kind)


def digit_mention(token: Column, context: Column) -> Column:
    """A digit token: per cent by its sign or company, money by its sign or company, else int or float."""
    raw = digits_raw(token)
    return let(digits_value(raw), lambda v: digit_typed(raw, v, _any(context, ("percent", "percentage")), _any(context, PERCENT_CONTEXT), _any(context, MONEY_CONTEXT)))


def word_mention(raw: Column, value: Column, context: Column, after: Column) -> Column:
    """Number words; ``after`` are the clean tokens behind them."""
    first, second = F.coalesce(F.get(after, 0), F.lit("")), F.coalesce(F.get(after, 1), F.lit(""))

    def typed(v):
        percent = (first == "percent") | ((first == "per") & (second == "cent")) | (_any(context, ("percent", "percentage")) & (v > 1))
        return _mention(raw, F.when(percent & (v > 1), v / 100).otherwise(v), F.when(percent, "percent").when(_any(context, MONEY_CONTEXT), "currency").otherwise(_plain_kind(v)))

    return let(value, typed)


def mentions_of(text: Column, masked: bool = False) -> Column:
    """Mentions of a text in token order, ratio words last; ``masked``: the variant whose numbers are written ``<num>``."""
    tokens = F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda t: t != "")
    around = lambda xs, i: F.slice(xs, F.greatest(i - REACH, F.lit(0)) + 1, F.least(i, F.lit(REACH)) + REACH + 1)
    none = F.lit(None).cast("struct<raw:string,value:double,kind:string>")

    def found(parts):
        tok, clean, near, number = parts["tok"], parts["clean"], parts["near"], parts["number"]

        def at(token, i):
            context, w = around(near, i), F.element_at(clean, i + 1)
            digits = F.regexp_replace(F.regexp_replace(token, r"[,;:()\[\]{}]+$", ""), r"\.+$", "").rlike(r"^[$]?\d[\d,]*(?:\.\d+)?%?$")
            rest = F.slice(number, i + 1, F.size(number))
            length = let(F.array_position(rest, False), lambda p: F.when(p > 0, p - 1).otherwise(F.size(rest))).cast("int")
            begins = F.element_at(number, i + 1) & ((i == 0) | ~F.element_at(number, F.greatest(i, F.lit(1))))
            run = lambda xs, n: F.slice(xs, i + 1, n)
            words = let(length, lambda n: word_mention(F.array_join(run(tok, n), " "), word_value(run(clean, n)), context, F.slice(clean, i + n + 1, F.lit(2))))
            fraction = F.try_element_at(_table(FRACTIONS), w)
            out = F.when(digits, digit_mention(token, context)).when(begins, words).when(fraction.isNotNull() & ~F.element_at(number, i + 1), _mention(w, fraction, F.lit("percent")))
            return F.when(token == "<num>", _mention(F.lit("<num>"), F.lit(None), F.lit("unknown")) if masked else none).otherwise(out)

        return F.filter(F.transform(tok, at), lambda m: m.isNotNull())

    parts = let(
        tokens, lambda t: let(F.transform(t, lambda x: stripped(x)), lambda c: F.struct(t.alias("tok"), c.alias("clean"), F.transform(t, lambda x: stripped(x, r".,;:()\[\]{}")).alias("near"), F.transform(c, is_number_word).alias("number")))
    )
    ratios = [F.when(F.lower(text).rlike(p), F.array(_mention(F.lit(raw), F.lit(v), F.lit("percent")))).otherwise(F.array().cast(SCHEMA)) for raw, p, v in RATIOS]
    return F.concat(let(parts, found), *ratios)


def mentions(queries: DataFrame, text: str, keep: list[str], masked: bool = False) -> DataFrame:
    """``keep`` columns and the mentions of every row."""
    return queries.select(*keep, mentions_of(F.col(text), masked).alias("mentions"))


def enumeration_counts(text: Column) -> Column:
    """array<struct<count,span>> of lists of two to five items: nouns ("phones and laptops" is 2), then numbered nouns."""
    item = lambda w: (F.length(w) > 1) & F.replace(w, F.lit("-"), F.lit("")).rlike("^[a-z]+$") & ~_among(w, NOT_ITEMS)
    named = lambda w: item(w) & ~is_number_word(w) & ~_among(w, FRACTIONS)
    last = lambda x: stripped(F.substring_index(F.trim(x), " ", -1))
    lists = lambda pattern, items: F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0)), lambda s: F.struct(F.size(items(s)).alias("count"), s.alias("span")))
    nouns = lists(NOUN_LIST, lambda s: F.filter(F.transform(F.split(s, r"(?i)\s*,\s*|\s+and\s+"), last), named))
    numbered = lists(QUANTITY_LIST, lambda s: F.filter(F.transform(F.regexp_extract_all(s, F.lit(QUANTITY), F.lit(1)), lambda w: F.lower(w)), item))
    return F.filter(reduce(F.concat, [nouns, numbered]), lambda x: x["count"].between(2, 5))

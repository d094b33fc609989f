r"""Operator 6 [native]: secret scan by patterns and character Markov models.

Base spans are found by three patterns (``assign``, ``access``, ``hex``), each
leftmost and non-overlapping, matches below their least length dropped after they
have consumed their text.  The method then adds ``markov`` spans: a run of at least
``MIN_RUN`` characters of the token alphabet is scored with two first-order Markov
chains over characters, one trained on random strings and one on ordinary
identifiers, both from labelled samples; a run is a secret where the mean
log-likelihood ratio of its transitions reaches a limit.  The limit comes from a fifth
of the sample that does not train the chains: the ``ORDINARY`` quantile of its ordinary
strings.  Runs that overlap a base span are not added again, and base spans are never
taken away.

Spans are code points, end exclusive.  Positions come from cutting the text at its
matches: the lengths of pieces and matches, summed up, give every start, so no
Python sees a text.

Defined results.  Null text is empty: no spans, digest of the empty string.  Spans
with one start are ordered assign, access, hex, markov.  Repeated rows are each
returned; there is no shuffle, so a hot source does not matter.  Extra columns are
ignored.  A sample without one of the labels raises.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import reduce
from operator import or_
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: kind, pattern, group whose length counts, least length. A run of hex digits or of key
#: characters is one match in either case, so its least length may stand in the pattern.
KINDS = [("assign", ASSIGN, 2, 12), ("access", r"AKIA[A-Z0-9]{14,}", 0, 18), ("hex", r"(?<![0-9a-f])[0-9a-f]{16,}", 0, 16)]
#: Strings of which a text with a match has at least one, in lower case; empty: none known.
HINTS = {"assign": ("passw", "secret", "token", "api"), "access": ("akia",), "hex": ()}

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
MIN_RUN = 16
RUN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}"
#: Share of held-out ordinary strings that the limit leaves alone.
ORDINARY, FOLDS = 0.998, 5

#: Words that ordinary identifiers of the default labelled sample are made of.
IDENTIFIER_WORDS = (
    "account active address amount array base batch block buffer build cache client code column config content context count "
    "create current data date default delete device document driver email error event example field file filter first format "
    "function group handler header host image index input integer item key label language last length level limit line list "
    "local manager message method model module name node number object offset option order output page parent path payment "
    "position process product project property query queue record reference region report request response result row schema "
    "search section selected server service session size source start state status string system table target temp text time "
    "title type update upload user value vector version view width window worker"
).split()


class Model(NamedTuple):
    """Log-likelihood ratios of all transitions, row by row of the alphabet, and the least mean ratio of a secret."""

    weights: list[float]
    min_ratio: float


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def prefix_max(values: Column, chunk: int = 64) -> Column:
    """Greatest value up to each element, itself included, in time n * chunk + (n / chunk)^2."""

    def whole(a):
        top = lambda x: F.coalesce(F.array_max(x), F.lit(-(1 << 31) + 1))
        n = F.size(a)
        most = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / chunk).cast("int")), lambda c: top(F.slice(a, c * chunk + 1, F.lit(chunk))))
        return let(most, lambda b: F.transform(F.sequence(F.lit(0), n - 1), lambda i: let(F.floor(i / chunk).cast("int"), lambda c: F.greatest(top(F.slice(b, F.lit(1), c)), top(F.slice(a, c * chunk + 1, i % chunk + 1))))))

    return let(values, lambda a: F.when(F.size(a) > 0, whole(a)).otherwise(F.array().cast("array<int>")))


def apart(added: Column, base: Column) -> Column:
    """The spans of ``added`` that overlap none of ``base``; both are sorted. One pass over the merged list."""

    def alone(m):
        # ends of base spans so far, and starts of those still to come, at every place of the merged list
        ends = prefix_max(F.transform(m, lambda x: F.when(x["kind"] < len(KINDS), x["end"]).otherwise(F.lit(-1))))
        back = prefix_max(F.reverse(F.transform(m, lambda x: F.when(x["kind"] < len(KINDS), -x["start"]).otherwise(F.lit(-(1 << 31) + 1)))))
        both = F.struct(m.alias("m"), ends.alias("e"), back.alias("b"))
        return let(
            both,
            lambda t: F.filter(
                t["m"],
                lambda x, i: (x["kind"] == len(KINDS)) & (F.element_at(t["e"], i + 1) <= x["start"]) & (F.coalesce(-F.element_at(t["b"], F.size(t["m"]) - i), F.lit(0)) >= x["end"]),
            ),
        )

    return F.when((F.size(added) > 0) & (F.size(base) > 0), let(F.sort_array(F.concat(base, added)), alone)).otherwise(added)


def prefix_sums(lengths: Column, chunk: int = 64) -> Column:
    """Running sums before each element, in time n * chunk + (n / chunk)^2."""

    def whole(a):
        n = F.size(a)
        sums = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / chunk).cast("int")), lambda c: F.aggregate(F.slice(a, c * chunk + 1, F.lit(chunk)), F.lit(0), lambda s, x: s + x))
        before = F.aggregate(sums, F.array(F.lit(0)), lambda s, x: F.concat(s, F.array(F.element_at(s, -1) + x)))
        at = lambda i: F.floor(i / chunk).cast("int")
        inside = lambda i: F.aggregate(F.slice(a, at(i) * chunk + 1, i % chunk), F.lit(0), lambda s, x: s + x)
        return let(before, lambda b: F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.element_at(b, at(i) + 1) + inside(i)))

    return let(lengths, lambda a: F.when(F.size(a) > 0, whole(a)).otherwise(F.array().cast("array<int>")))


SPAN = "array<struct<start:int,kind:int,end:int>>"


def _spans(text: Column, pattern: str, group: int, least: int, kind: int, maybe: Column) -> Column:
    """Spans of the matches of ``pattern`` whose ``group`` has at least ``least`` characters; none where ``maybe`` is false."""
    p = F.lit(pattern)

    def found(m):
        pieces = F.transform(F.split(text, pattern), lambda x: F.length(x))
        sizes = F.transform(m, lambda x: F.length(x))
        steps = F.zip_with(F.slice(pieces, F.lit(1), F.size(m)), sizes, lambda a, b: a + b)
        # the start of a match is the end of it, less its own length
        starts = F.zip_with(F.zip_with(prefix_sums(steps), steps, lambda a, b: a + b), sizes, lambda e, s: F.struct((e - s).cast("int").alias("start"), F.lit(kind).alias("kind"), e.cast("int").alias("end")))
        if not group:
            return starts
        enough = F.transform(F.regexp_extract_all(text, p, F.lit(group)), lambda x: F.length(x) >= least)
        return F.transform(F.filter(F.zip_with(starts, enough, lambda s, k: F.struct(s.alias("s"), k.alias("k"))), lambda x: x["k"]), lambda x: x["s"])

    return F.when(maybe & text.rlike(pattern), let(F.regexp_extract_all(text, p, F.lit(0)), found)).otherwise(F.array().cast(SPAN))


def labelled_sample(spark: SparkSession, rows: int = 4000) -> DataFrame:
    """text, label of the default sample: random strings (1) and ordinary identifiers and numbers (0), from hashes of row numbers."""
    i = F.col("id")
    word = lambda k: F.element_at(F.split(F.lit(" ".join(IDENTIFIER_WORDS)), " "), (F.pmod(F.xxhash64(i, F.lit(k)), F.lit(len(IDENTIFIER_WORDS))) + 1).cast("int"))
    number = F.pmod(F.xxhash64(i, F.lit("n")), F.lit(1000)).cast("string")
    b64 = F.base64(F.unhex(F.sha2(i.cast("string"), 256)))
    random = F.when(i % 4 == 0, F.sha2(i.cast("string"), 256)).when(i % 4 == 1, F.upper(F.conv(F.substr(F.sha2(i.cast("string"), 256), F.lit(1), F.lit(15)), 16, 36))).otherwise(b64)
    plain = (
        F.when(i % 6 == 0, F.concat_ws("_", word(1), word(2), word(3)))
        .when(i % 6 == 1, F.concat(word(1), F.initcap(word(2)), F.initcap(word(3))))
        .when(i % 6 == 2, F.concat_ws("/", word(1), word(2), number))
        .when(i % 6 == 3, F.concat_ws("-", word(1), word(2), word(3), number))
        .when(i % 6 == 4, F.upper(F.concat_ws("_", word(1), word(2), word(3))))
        .otherwise(F.substr(F.conv(F.substr(F.sha2(i.cast("string"), 256), F.lit(1), F.lit(15)), 16, 10), F.lit(1), F.lit(16)))
    )
    base = spark.range(rows)
    return base.select(random.alias("text"), F.lit(1).alias("label")).union(base.select(plain.alias("text"), F.lit(0).alias("label")))


def _class(c: str) -> str:
    return "upper" if c.isupper() else "lower" if c.islower() else "digit" if c.isdigit() else "sign"


def _weights(sample: DataFrame, coarse_share: float) -> list[float]:
    """Log-likelihood ratios of all transitions, random over ordinary, row by row of the alphabet.

    A chain's transition mixes the one counted between the characters with the one between
    their classes, each character of a class alike: a sample has few of all words.  The counts that come to the driver are
    at most two for each pair of characters.
    """
    chars = F.filter(F.split("text", ""), lambda c: F.contains(F.lit(ALPHABET), c) & (c != ""))
    n = F.greatest(F.size("c") - 1, F.lit(0))
    pairs = sample.select("label", chars.alias("c")).select("label", F.explode(F.zip_with(F.slice("c", F.lit(1), n), F.slice("c", F.lit(2), n), lambda a, b: F.concat(a, b))).alias("pair"))
    counts = {(r["label"], r["pair"]): r["n"] for r in pairs.groupBy("label", "pair").agg(F.count("*").alias("n")).collect()}
    if {k for k, _ in counts} != {0, 1}:
        raise ValueError("the labelled sample needs texts with label 0 and with label 1")
    sizes = Counter(map(_class, ALPHABET))
    total, coarse, leaving = Counter(), Counter(), Counter()
    for (y, p), c in counts.items():
        total[y, p[0]] += c
        coarse[y, _class(p[0]), _class(p[1])] += c
        leaving[y, _class(p[0])] += c

    def log(y, a, b):
        ca, cb = _class(a), _class(b)
        wide = (coarse[y, ca, cb] + 1) / (leaving[y, ca] + len(sizes)) / sizes[cb]
        fine = counts.get((y, a + b), 0) / total[y, a] if total[y, a] else wide
        return math.log((1 - coarse_share) * fine + coarse_share * wide)

    return [round(log(1, a, b) - log(0, a, b), 4) for a in ALPHABET for b in ALPHABET]


def ratio(run: Column, weights: list[float]) -> Column:
    """Mean log-likelihood ratio of a run's transitions."""
    weights = F.split(F.lit(",".join(map(str, weights))), ",").cast("array<double>")
    k = len(ALPHABET)
    codes = F.transform(F.split(run, ""), lambda c: F.position(c, F.lit(ALPHABET)))
    known = lambda c: F.filter(c, lambda x: x > 0)
    return let(
        known(codes),
        lambda c: let(weights, lambda w: F.aggregate(F.sequence(F.lit(1), F.size(c) - 1), F.lit(0.0), lambda s, i: s + F.element_at(w, (F.element_at(c, i) - 1) * k + F.element_at(c, i + 1)))) / (F.size(c) - 1),
    )


def train(sample: DataFrame, *, coarse_share: float = 0.5, ordinary: float = ORDINARY) -> Model:
    """A model from texts with label 1 (random) and 0 (ordinary); a fifth of either, by a hash of the text, sets the limit."""
    held = F.pmod(F.xxhash64("text"), F.lit(FOLDS)) == 0
    weights = _weights(sample.filter(~held), coarse_share)
    limit = sample.filter(held & (F.col("label") == 0) & (F.length("text") >= MIN_RUN)).agg(F.percentile(ratio(F.col("text"), weights), F.lit(ordinary))).first()[0]
    return Model(weights, max(0.0, limit or 0.0))


def scan(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """``keep`` columns with base and added spans array<struct<start,kind,end>>, ordered."""
    t = F.coalesce(F.col("text"), F.lit(""))
    # a run is judged before its place is sought: few texts have any
    text = docs.select(*keep, t.alias("__t"), F.lower(t).alias("__low"))
    maybe = {k: reduce(or_, [F.contains("__low", F.lit(h)) for h in hints], F.lit(not hints)) for k, hints in HINTS.items()}
    text = text.select(*keep, "__t", *[maybe[name].alias(f"__may_{name}") for name, *_ in KINDS])
    t = F.col("__t")
    runs = F.when(t.rlike(RUN), F.regexp_extract_all(t, F.lit(RUN), F.lit(0))).otherwise(F.array().cast("array<string>"))
    a = text.select(*keep, "__t", *[_spans(t, p, g, n, k, F.col(f"__may_{name}")).alias(f"__{name}") for k, (name, p, g, n) in enumerate(KINDS)], runs.alias("__runs"))
    judged = F.transform("__runs", lambda r: ratio(r, model.weights) >= model.min_ratio)
    b = a.withColumn("__ok", judged).withColumn("base", F.sort_array(F.concat("__assign", "__access", "__hex")))
    places = F.when(F.exists("__ok", lambda k: k), F.transform(F.filter(F.zip_with(_spans(F.col("__t"), RUN, 0, MIN_RUN, len(KINDS), F.lit(True)), "__ok", lambda s, k: F.struct(s.alias("s"), k.alias("k"))), lambda x: x["k"]), lambda x: x["s"])).otherwise(F.array().cast(SPAN))
    c = b.withColumn("__m", places)
    added = apart(F.col("__m"), F.col("base"))
    return c.select(*keep, F.size("__assign").cast("long").alias("n_assign"), F.size("__access").cast("long").alias("n_access"), F.size("__hex").cast("long").alias("n_hex"), "base", F.sort_array(F.concat("base", added)).alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    names = F.array(*[F.lit(k[0]) for k in KINDS], F.lit("markov"))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, model: Model, *, mark: str = "[SECRET]") -> DataFrame:
    """The rows of ``docs`` with every span of ``text`` replaced by ``mark``; ``n_chars`` follows where present."""
    names = docs.columns
    keep = [f"`{c}`" for c in names]
    # where spans overlap, only what lies beyond the earlier ones is cut again
    s = scan(docs, model, keep)
    step = lambda a, x: F.struct(
        F.greatest(a["at"], x["end"]).alias("at"),
        F.when(x["start"] >= a["at"], F.concat(a["out"], F.substr("text", a["at"] + 1, x["start"] - a["at"]), F.lit(mark))).otherwise(a["out"]).alias("out"),
    )
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    new = F.when(F.size("spans") > 0, F.aggregate("spans", start, step, lambda a: F.concat(a["out"], F.substr("text", a["at"] + 1, F.length("text"))))).otherwise(F.col("text"))
    out = s.withColumn("__new", new)
    cols = [F.col("__new").alias("text") if c == "text" else F.length("__new").cast(docs.schema[c].dataType).alias("n_chars") if c == "n_chars" else F.col(f"`{c}`") for c in names]
    return out.select(*cols)


def secrets(docs: DataFrame, model: Model) -> DataFrame:
    """The contract's columns."""
    return scan(docs, model, ["doc_id"]).select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets(store.read(spark, sf_dir, "documents"), train(labelled_sample(spark)))

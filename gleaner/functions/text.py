r"""Text scalars as Spark columns: tokenizers, number patterns, identifiers, slot rules.

Every function maps columns to a column with built-in expressions only, so it stays in
the JVM.  Patterns use explicit classes: ``\w`` means ASCII letters in Spark, while
natural text is not ASCII, so words are ``[\p{L}\p{N}_]+``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The named number patterns. They differ on purpose and are not unified.
NUMBER_PATTERNS = {
    "mention": r"[$]?\d[\d,]*(?:\.\d+)?%?",
    "overlap": r"\b\$?\d+(?:,\d{3})*(?:\.\d+)?%?\b",
    "error": r"\b\d+(?:,\d{3})*(?:\.\d+)?%?\b",
    "dataset": r"[$]?\d+(?:,\d{3})*(?:\.\d+)?%?|\d+\.\d+",
    "corpus": r"\$?\d+(?:,\d{3})*(?:\.\d+)?%?|\d+\.\d+",
    "plain": r"\b\d+(?:\.\d+)?\b",
    "audit": r"\$?\d[\d,]*(?:\.\d+)?%?",
}

# English stop words of the sanitizers.
STOP_WORDS = (
    "a", "an", "the", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did", "will", "would", "could", "should", "may", "might", "shall", "can",
    "to", "of", "in", "on", "at", "by", "for", "from", "with", "about", "into", "through", "during", "and", "but", "or", "nor", "so", "yet", "both", "either", "neither", "not", "as", "if",
    "than", "that", "which", "who", "whom", "whose", "this", "these", "those", "it", "its", "i", "you", "he", "she", "we", "they", "all", "each", "every", "some", "any", "no", "one", "two",
    "such", "up", "out", "how", "what", "when", "where", "while", "more", "most", "other", "same", "then", "there", "their", "also", "just", "only", "over", "per", "after", "between",
    "before", "must", "least", "much",
)

# A short query has at most this many words; else the generic words are appended.
SHORT_QUERY_WORDS = 5
GENERIC_CONTEXT = "optimization problem formulation"

# Words of a short query and the context they bring, first match wins.
DOMAIN_CONTEXT: list[tuple[tuple[str, ...], str]] = [
    (("diet", "blend", "blending", "mix", "mixture", "alloy", "ingredient", "nutrient", "feed", "recipe", "composition"), "blending mix mixture ingredient nutrient composition percentage optimization"),
    (("transport", "transportation", "ship", "shipping", "route", "routing", "delivery", "logistics"), "transportation shipping route supply demand source destination network flow"),
    (("assign", "assignment", "worker", "task", "job", "employee", "schedule", "scheduling", "shift", "crew", "rostering", "pairing"), "assignment scheduling worker task job crew rostering shift optimization"),
    (("facility", "location", "depot", "warehouse", "open", "opening", "customer", "median", "hub"), "facility location opening depot warehouse customer serving optimization"),
    (("knapsack", "pack", "packing", "item", "weight", "capacity"), "knapsack packing items weight capacity maximize value binary optimization"),
    (("vehicle", "vrp", "tour", "visit"), "vehicle routing tour depot visit capacitated optimization"),
    (("cover", "covering", "set cover", "dominate"), "set cover covering subsets elements minimum optimization"),
    (("graph", "vertex", "edge", "node", "clique", "coloring", "chromatic", "independent"), "graph vertex edge node integer programming optimization"),
    (("spanning", "steiner", "mst", "arborescence", "tree"), "minimum spanning tree Steiner tree graph network connectivity optimization"),
    (("production", "produce", "product", "manufacture", "manufacturing", "factory", "output", "profit"), "production planning profit labor machine manufacturing optimization"),
    (("tsp", "salesman", "traveling", "travelling", "tour"), "traveling salesman problem TSP tour shortest circuit optimization"),
    (("flowshop", "makespan", "sequencing", "tardiness", "permutation", "jobshop"), "flow shop job shop scheduling sequencing makespan minimization integer programming"),
    (("flow", "network", "path", "shortest"), "network flow shortest path minimum cost arc optimization"),
    (("bin", "bins", "cutting", "stock", "container"), "bin packing cutting stock container size optimization"),
    (("lp", "linear", "ilp", "mip", "milp", "integer", "formulate", "formulation"), "linear program integer programming formulation optimization variables constraints"),
    (("qp", "quadratic", "socp", "convex", "nonlinear", "nlp"), "quadratic convex nonlinear programming optimization objective constraints"),
    (("portfolio", "invest", "investment", "stock", "asset", "return", "risk", "markowitz", "sharpe", "frontier"), "portfolio optimization investment return risk asset allocation Markowitz"),
    (("auction", "bid", "bidding", "procurement", "winner"), "auction combinatorial bidding winner determination procurement allocation integer programming"),
    (("match", "matching", "bipartite", "marriage", "stable", "allocation", "allocate"), "matching bipartite assignment allocation worker job optimization"),
    (("resource", "capacity", "planning", "demand", "supply", "inventory", "stock", "lot", "sizing"), "resource capacity planning demand supply inventory lot sizing optimization"),
    (("cut", "trim", "strip", "layout", "nesting", "2d", "3d", "rectangle", "sheet"), "cutting layout strip packing rectangle nesting optimization"),
]

# Parts of slot names and the scalar type they mean, in order; "$" anchors at the end.
SLOT_TYPES: list[tuple[tuple[str, ...], str]] = [
    (("percent", "percentage", "fraction", "pct", "ratio", "proportion", "share", "utilisation", "utilization", "rate$"), "percent"),
    (("num", "count", "types", "items", "ingredients", "nodes", "edges"), "int"),
    (("budget", "cost", "price", "revenue", "profit", "penalty", "investment", "income", "salary", "wage", "fee"), "currency"),
    (("number", "workers", "employee", "shifts", "batches", "rounds", "days", "weeks", "months", "trips", "persons", "patients", "tasks", "machines", "factories", "farms", "vehicles", "trucks", "buses"), "int"),
]


# Cues of statements that are hard to ground, and how many distinct numbers are several.
BOTTLENECK_PATTERNS = {
    "entity": r"\b(?:Mr|Mrs|Ms|Dr|Prof)\.?\s*[A-Z][a-z]+|\b[A-Z][a-z]{2,}(?:\s+[A-Z][a-z]{2,})+\b",
    "lower": r"(?i)\b(?:at least|minimum|min|no less than|greater than or equal|>=|≥|must be at least)\b",
    "upper": r"(?i)\b(?:at most|maximum|max|no more than|less than or equal|<=|≤|must not exceed|cannot exceed|up to)\b",
    "total": r"(?i)\b(?:total|overall|aggregate|combined|sum)\b",
    "per_unit": r"(?i)\b(?:per|each|every|unit|piece|item)\b",
    "percent": r"(?i)\b\d+(?:\.\d+)?%|\bpercent(?:age)?\b",
    "absolute": r"\$\d[\d,]*(?:\.\d+)?|\b\d{4,}\b(?!\s*%)",
}
BOTTLENECKS = ("entity_association", "lower_upper", "multi_numeric", "total_per_unit", "percent_absolute")
SEVERAL = 3


def bottlenecks(text: Column) -> dict[str, Column]:
    """Whether a statement names entities beside numbers, has both bounds, several numbers, totals beside unit values, shares beside amounts; a null text has none."""
    t = F.coalesce(text, F.lit(""))
    has = {k: t.rlike(p) for k, p in BOTTLENECK_PATTERNS.items()}
    found = numbers(t, "audit")
    distinct = F.size(F.array_distinct(F.transform(found, lambda x: F.regexp_replace(x, "[$,%]", ""))))
    some = F.size(found) > 0
    return dict(zip(BOTTLENECKS, (some & has["entity"], has["lower"] & has["upper"], distinct >= SEVERAL, some & has["total"] & has["per_unit"], has["percent"] & has["absolute"]), strict=True))


def words(text: Column) -> Column:
    """Unicode words, lower-cased."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def bm25_tokens(text: Column) -> Column:
    """Lower-cased; all but ASCII letters, digits and white space become spaces; split."""
    return F.filter(F.split(F.regexp_replace(F.lower(text), r"[^a-z0-9\s]", " "), r"\s+"), lambda t: t != "")


def tfidf_tokens(text: Column) -> Column:
    """Unicode words of two characters or more."""
    return F.filter(words(text), lambda t: F.length(t) >= 2)


def rerank_tokens(text: Column) -> Column:
    """Distinct lower-cased ASCII alphanumeric tokens."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9]+"), F.lit(0)))


def overlap_tokens(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"[a-z]+"), F.lit(0)))


def lexical_tokens(text: Column) -> Column:
    """Distinct ASCII alphanumeric tokens of two characters or more."""
    return F.filter(rerank_tokens(text), lambda t: F.length(t) > 1)


def jaccard(a: Column, b: Column) -> Column:
    """Of two distinct arrays; 0 where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def overlap_ratio(query: Column, doc: Column) -> Column:
    """Share of the query's distinct tokens that the document has; 0 without tokens."""
    return F.when(F.size(query) > 0, F.size(F.array_intersect(query, doc)) / F.size(query)).otherwise(F.lit(0.0))


def numbers(text: Column, name: str = "mention") -> Column:
    return F.regexp_extract_all(text, F.lit(NUMBER_PATTERNS[name]), F.lit(0))


def has_number(text: Column) -> Column:
    return text.rlike(NUMBER_PATTERNS["plain"])


def number_value(raw: Column) -> Column:
    """Value of a mention without its sign of money, commas and per cent."""
    return F.regexp_replace(raw, r"[$,%]", "").cast("double")


def without_numbers(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(text, NUMBER_PATTERNS["mention"], " "), r"\s+", " "))


def without_stop_words(text: Column) -> Column:
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    return F.array_join(F.filter(F.split(F.trim(text), r"\s+"), lambda w: ~F.array_contains(stop, F.lower(w))), " ")


def expand_short_query(query: Column) -> Column:
    """A query of few words with the context of its domain, or the generic one."""
    q = F.trim(query)
    found = F.array_distinct(F.regexp_extract_all(F.lower(q), F.lit(r"[a-z0-9]+"), F.lit(0)))
    context = F.coalesce(*[F.when(F.arrays_overlap(found, F.array(*[F.lit(w) for w in keys])), F.lit(text)) for keys, text in DOMAIN_CONTEXT], F.lit(GENERIC_CONTEXT))
    short = F.size(F.split(q, r"\s+")) <= SHORT_QUERY_WORDS
    return F.when((q == "") | ~short, q).otherwise(F.concat_ws(" ", q, context))


def identifier_words(name: Column) -> Column:
    """Words of a camel-case, underscored or numbered identifier, lower-cased."""
    x = name
    for pattern in (r"([a-z\d])([A-Z])", r"([A-Z]+)([A-Z][a-z])", r"([A-Za-z])(\d)", r"(\d)([A-Za-z])"):
        x = F.regexp_replace(x, pattern, "$1 $2")
    return F.filter(F.split(F.lower(F.regexp_replace(x, r"[_\W]+", " ")), " "), lambda w: w != "")


def slot_type(name: Column) -> Column:
    """percent, int, currency or float by the parts of a slot's name."""
    n = F.lower(F.coalesce(name, F.lit("")))
    out = F.lit("float")
    for parts, kind in reversed(SLOT_TYPES):
        out = F.when(n.rlike("|".join(parts)), F.lit(kind)).otherwise(out)
    return out


def type_matches(slot: Column, kind: Column) -> Column:
    """Whether a mention's kind fills a slot fully: the same kind, int for float, int or float for currency."""
    return (slot == kind) | ((slot == "float") & (kind == "int")) | ((slot == "currency") & kind.isin("int", "float"))


def types_exclude(slot: Column, kind: Column) -> Column:
    """Kinds that never fill a slot: per cent for others and others for per cent."""
    plain = ("currency", "int", "float")
    return ((slot == "percent") & kind.isin(*plain)) | (slot.isin(*plain) & (kind == "percent"))


def length_bucket(n: Column) -> Column:
    """Fixed buckets of query lengths in tokens."""
    return F.when(n <= 25, "0-25").when(n <= 50, "26-50").when(n <= 100, "51-100").when(n <= 150, "101-150").otherwise("151+")


def count_bucket(n: Column) -> Column:
    """Fixed buckets of numbers in a query."""
    return F.when(n <= 0, "0").when(n <= 2, "1-2").when(n <= 5, "3-5").when(n <= 10, "6-10").otherwise("11+")


def relative_error(got: Column, gold: Column) -> Column:
    return F.abs(got - gold) / F.greatest(F.lit(1.0), F.abs(gold))


def draw(*parts: Column | str | int) -> Column:
    """A number from 0 to 2^32 - 1 that depends on the parts only: the random source of samples and bootstraps."""
    text = F.concat_ws("-", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")

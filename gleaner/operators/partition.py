"""Partition of a problem's constraints as tables: independent sets by shared variables, then average-linkage trees.

All problems of a table are partitioned together.  Components are found by least labels that spread
until nothing changes, clusters by rounds in which all mutually nearest pairs merge at once: with
average linkage no merge brings two clusters nearer than they were, so this gives the clusters of
merging the nearest pair again and again.  The definition compares all constraints of one
group with each other; they are rows, spread by pair, and never one task's list.

Most problems are small: those of ``MOST`` rows at most are dealt by problem once, and a fold inside the
problem's row finds the same sets and merges the nearest pairs one by one, so that no keywords or pairs
move.  The rounds on tables are for the larger ones, and are left out where there are none.

Results for odd input: a null or empty text has no keywords and is a set of its own; a problem without
variables is cut by similarity alone; rows with a null problem, position or variable's name are left out; of rows that repeat a position
the least text counts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import saved

# Keywords of a text, shared ones that tie a constraint to a variable, weights of similarity, ends of the tree.
TOP, SHARED, EPSILON = 10, 1, 0.01
WEIGHTS = {"root": {"adjacency": 0.2, "keyword": 0.4, "vector": 0.4}, "default": {"adjacency": 0.3, "keyword": 0.35, "vector": 0.35}}
FEW, ALIKE = 3, 0.6
WORD = r"(?U)\b\w\w+\b"
#: Means are compared after rounding, so that the order of a sum decides nothing.
DIGITS = 9
#: A problem with so many constraints, and so many variables, at most is one row.
MOST = 32


def distance(similarity: Column, epsilon: float = EPSILON) -> Column:
    """1 / (s + e) - 1 / (1 + e): 0 for equal ones."""
    return 1 / (similarity + epsilon) - 1 / (1 + epsilon)


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def blend(layer: Column, gap: Column, shared: Column, cosine: Column, top: int) -> Column:
    """Similarity of two constraints that stand ``gap`` places apart, by the layer's weights."""
    cosine, shared = F.least(F.lit(1.0), cosine), F.least(F.lit(1.0), shared / top)
    mean = lambda v: (v["adjacency"] / (1 + gap) + v["keyword"] * shared + v["vector"] * cosine) / sum(v.values())
    return F.when(layer == "root", mean(WEIGHTS["root"])).otherwise(mean(WEIGHTS["default"]))


def let(value: Column, f) -> Column:
    """``f`` of a value that is worked out once; a column named inside a lambda may be worked out for each element."""
    return F.element_at(F.transform(F.array(value), lambda x: f(x)), 1)


def apart(df: DataFrame, by: list, of) -> DataFrame:
    """by and the fields of each struct of an array; an inner explode would work its array out once more to ask whether it is empty."""
    return df.select(*by, F.explode_outer(of).alias("__x")).filter("__x is not null").select(*by, "__x.*")


def each(n: Column) -> Column:
    return F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))


def field(of: Column, name: str) -> Column:
    return F.transform(of, lambda e: e[name])


def ranked(docs: Column, n: Column, top: int | None = None) -> Column:
    """:func:`weights` of an array of word lists, before scaling: for each its structs r, t (term), w (weight), by rank.

    With ``top`` only so many; a list that has no more terms keeps them all, whatever their weights.
    """

    def of(u, d, every):
        count = lambda among, t: F.size(among) - F.size(F.array_remove(among, t))
        w = lambda t: count(d, t) * (F.log((1 + n) / (1 + count(every, t))) + 1)
        return F.sort_array(F.transform(u, lambda t: let(w(t), lambda x: F.struct((-F.round(x, DIGITS)).alias("r"), t.alias("t"), x.alias("w")))))

    def kept(u, d, every):
        if top is None:
            return of(u, d, every)
        plain = F.transform(u, lambda t: F.struct(F.lit(0.0).alias("r"), t.alias("t"), F.lit(0.0).alias("w")))
        return F.when(F.size(u) <= top, plain).otherwise(F.slice(of(u, d, every), 1, top))

    both = F.transform(docs, lambda d: F.struct(d.alias("d"), F.array_distinct(d).alias("u")))
    return let(both, lambda x: let(F.flatten(field(x, "u")), lambda every: F.transform(x, lambda e: kept(e["u"], e["d"], every))))


def sizes(constraints: DataFrame, variables: DataFrame, by: str, most: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame] | None:
    """Constraints and variables of the problems of ``most`` rows at most, then of the others; None if there are no others."""
    many = lambda df: df.filter(F.col(by).isNotNull()).groupBy(by).agg(F.count("*").alias("n")).filter(F.col("n") > most).select(by)
    large = saved(many(constraints).unionByName(many(variables)).distinct(), "large")
    if large.isEmpty():
        return None
    return tuple(df.join(large, by, how) for how in ("left_anti", "left_semi") for df in (constraints, variables))


def rows_with_sets(constraints: DataFrame, variables: DataFrame, by: str, top: int, shared: int) -> DataFrame:
    """by, xs: a row a problem; its constraints as structs idx, text, set, by idx."""
    c = constraints.filter(F.col("idx").isNotNull() & F.col(by).isNotNull()).groupBy(by).agg(F.collect_list(F.struct(F.col("idx").cast("long").alias("idx"), "text")).alias("c"))
    v = variables.filter(F.col("name").isNotNull() & F.col(by).isNotNull()).groupBy(by).agg(F.collect_set(F.struct("name", "text")).alias("v"))
    least = lambda c, i: F.array_min(field(F.filter(c, lambda e: e["idx"] == i), "text"))
    xs = let(F.col("c"), lambda c: F.transform(F.sort_array(F.array_distinct(field(c, "idx"))), lambda i: F.struct(i.alias("idx"), least(c, i).alias("text"))))
    mine = lambda v, name: F.flatten(F.transform(F.filter(v, lambda e: e["name"] == name), lambda e: words(e["text"])))
    vs = let(F.col("v"), lambda v: F.transform(F.array_distinct(field(v, "name")), lambda name: mine(v, name)))
    none = F.array().cast("array<array<string>>")
    x = c.join(v, by, "left").select(by, xs.alias("xs"), F.coalesce(vs, none).alias("vs"), F.coalesce(F.size("v"), F.lit(0)).alias("nv"))
    x = x.withColumn("nv", F.greatest("nv", F.lit(0)))  # the size of null is -1 in some settings

    def joined(labels, own, key):
        """A variable's constraints take the least label of their sets."""
        met = F.filter(F.zip_with(labels, own, lambda at, t: F.when(F.size(F.array_intersect(t, key)) >= max(shared, 1), at)), lambda at: at.isNotNull())
        return let(met, lambda met: F.when(F.size(met) < 2, labels).otherwise(F.transform(labels, lambda at: F.when(F.array_contains(met, at), F.array_min(met)).otherwise(at))))

    def sets(xs, keys):
        own = F.slice(keys, F.lit(1), F.size(xs))
        return F.aggregate(F.slice(keys, F.size(xs) + 1, F.size(keys)), field(xs, "idx"), lambda labels, key: joined(labels, own, key))

    keys = lambda xs: F.transform(ranked(F.concat(F.transform(xs, lambda e: words(e["text"])), F.col("vs")), F.size(xs) + F.col("nv"), top), lambda r: field(r, "t"))
    with_sets = lambda xs, at: F.zip_with(xs, at, lambda e, s: F.struct(e["idx"].alias("idx"), e["text"].alias("text"), s.alias("set")))
    return x.select(by, let(F.col("xs"), lambda xs: let(keys(xs), lambda k: with_sets(xs, sets(xs, k)))).alias("xs"))


def clusters(d: Column, n: Column, cut: float) -> Column:
    """:func:`average_linkage` of one group in its row: the places of each cluster, by the least.

    ``d``: rows of distances, of which those of two places a < b are read.
    """
    between = lambda x, y: F.aggregate(x, F.lit(0.0), lambda s, i: s + F.aggregate(y, F.lit(0.0), lambda u, j: u + F.element_at(F.element_at(d, F.least(i, j)), F.greatest(i, j))))

    def pair(c, x, y):
        a, b = F.element_at(c, x), F.element_at(c, y)
        return F.struct(F.round(between(a, b) / (F.size(a) * F.size(b)), DIGITS).alias("d"), x.alias("x"), y.alias("y"))

    def merged(c, best):
        one = lambda g, k: F.when(k + 1 == best["x"], F.sort_array(F.concat(g, F.element_at(c, best["y"])))).when(k + 1 != best["y"], g)
        return F.filter(F.transform(c, lambda g, k: one(g, k)), lambda g: g.isNotNull())

    def step(at, _):
        c = at["c"]
        best = F.array_min(F.flatten(F.transform(F.sequence(F.lit(1), F.size(c) - 1), lambda x: F.transform(F.sequence(x + 1, F.size(c)), lambda y: pair(c, x, y)))))
        after = lambda best: F.when(best["d"] <= round(cut, DIGITS), F.struct(merged(c, best).alias("c"), (F.size(c) > 2).alias("on"))).otherwise(F.struct(c.alias("c"), F.lit(False).alias("on")))
        return F.when(at["on"], let(best, after)).otherwise(at)

    start = F.struct(F.transform(each(n), lambda i: F.array(i)).alias("c"), (n > 1).alias("on"))
    return F.aggregate(each(n - 1), start, step, lambda at: at["c"])


def cuts(xs: Column, layer: Column, top: int, few: int, alike: float, cut: float) -> Column:
    """The places of each of a node's children, or of all its constraints if it is a leaf."""

    def scaled(r):
        norm = F.sqrt(F.aggregate(r, F.lit(0.0), lambda s, e: s + e["w"] * e["w"]))
        return let(norm, lambda norm: F.struct(field(r, "t").alias("t"), F.transform(r, lambda e: e["w"] / norm).alias("w"), F.slice(field(r, "t"), 1, top).alias("top")))

    def similar(k, i, j):
        a, b = F.element_at(k, i), F.element_at(k, j)
        weight = lambda of, t: F.element_at(of["w"], F.array_position(of["t"], t).cast("int"))
        cosine = F.aggregate(F.array_intersect(a["t"], b["t"]), F.lit(0.0), lambda s, t: s + weight(a, t) * weight(b, t))
        return blend(layer, j - i, F.size(F.array_intersect(a["top"], b["top"])), cosine, top)

    n = F.size(xs)
    whole = F.array(each(n))
    matrix = lambda k: F.transform(each(n), lambda i: F.transform(each(n), lambda j: F.when(i < j, similar(k, i, j))))
    mean = lambda m: F.aggregate(F.flatten(m), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0))) / (n * (n - 1) / 2)
    far = lambda m: F.transform(m, lambda r: F.transform(r, lambda x: distance(x)))
    below = lambda m: F.when(F.round(mean(m), DIGITS) < alike, let(far(m), lambda d: clusters(d, n, cut))).otherwise(whole)
    k = let(F.transform(xs, lambda e: words(e["text"])), lambda docs: F.transform(ranked(docs, n), lambda r: scaled(r)))
    return F.when(n <= few, whole).otherwise(let(k, lambda k: let(matrix(k), below)))


def rows_tree(constraints: DataFrame, variables: DataFrame, by: str, top: int, shared: int, few: int, alike: float, most_depth: int) -> DataFrame:
    """:func:`tree` of problems that are a row each: a node is a row, and only nodes that are cut again are held with their texts."""
    cut = 1 / (alike + EPSILON) - 1 / (1 + EPSILON)
    node = lambda path, layer, depth, xs: F.struct(path.alias("path"), F.lit(layer).alias("layer"), F.lit(depth).alias("depth"), F.transform(xs, lambda e: F.struct(e["idx"].alias("idx"), e["text"].alias("text"))).alias("xs"))
    split = lambda xs, sets: F.transform(sets, lambda s: node(F.concat(F.lit("/"), s.cast("string")), "default", 1, F.filter(xs, lambda e: e["set"] == s)))
    roots = let(F.col("xs"), lambda xs: let(F.array_distinct(field(xs, "set")), lambda sets: F.when(F.size(sets) > 1, split(xs, sets)).otherwise(F.array(node(F.lit(""), "root", 0, xs)))))
    live = apart(rows_with_sets(constraints, variables, by, top, shared), [by], roots)
    done = []

    def child(xs, kids, g):
        own, leaf = F.transform(g, lambda i: F.element_at(xs, i)), (F.size(kids) == 1) | (F.size(g) <= few)
        path = F.when(F.size(kids) == 1, F.col("path")).otherwise(F.concat_ws("/", "path", F.element_at(xs, F.element_at(g, 1))["idx"].cast("string")))
        return F.struct(path.alias("path"), (F.col("depth") + (F.size(kids) > 1).cast("int")).alias("depth"), leaf.alias("leaf"), field(own, "idx").alias("ids"), F.when(~leaf, field(own, "text")).alias("texts"))

    for _ in range(most_depth):
        kids = let(F.col("xs"), lambda xs: let(cuts(xs, F.col("layer"), top, few, alike, cut), lambda kids: F.transform(kids, lambda g: child(xs, kids, g))))
        nodes = saved(apart(live, [by], kids), "nodes")
        done.append(nodes.filter("leaf").select(by, F.explode("ids").alias("idx"), "path", "depth"))
        live = nodes.filter("not leaf").select(by, "path", F.lit("default").alias("layer"), "depth", F.zip_with("ids", "texts", lambda i, t: F.struct(i.alias("idx"), t.alias("text"))).alias("xs"))
        if live.isEmpty():
            return reduce(DataFrame.unionByName, done)
    raise RuntimeError("the tree is deeper than most_depth")


def weights(texts: DataFrame, by: list[str], of: list[str], text: str) -> DataFrame:
    """by, of, term, weight, rank: unit-scaled tf-idf of each text among those of its ``by``; ranks by weight, then term."""
    tf = texts.select(*by, *of, F.explode(words(F.col(text))).alias("term")).groupBy(*by, *of, "term").agg(F.count("*").alias("tf"))
    n = texts.groupBy(*by).agg(F.count("*").alias("n"))
    df = tf.groupBy(*by, "term").agg(F.count("*").alias("df")).join(n, by).select(*by, "term", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    x = tf.join(df, [*by, "term"]).withColumn("w", F.col("tf") * F.col("idf"))
    own = Window.partitionBy(*by, *of)
    rank = F.row_number().over(own.orderBy(F.desc(F.round("w", DIGITS)), "term"))
    return x.select(*by, *of, "term", (F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(own))).alias("weight"), rank.alias("rank"))


def independent_sets(constraints: DataFrame, variables: DataFrame, by: str, *, top: int = TOP, shared: int = SHARED, most_rounds: int = 60, most: int = MOST) -> DataFrame:
    """by, idx, set: constraints that variables tie together, named by the least idx.

    ``constraints``: by, idx, text; ``variables``: by, name, text.  A constraint and a variable are tied by
    ``shared`` common words among the ``top`` keywords of each, weighed over all texts of the problem.
    """
    found = sizes(constraints, variables, by, most)
    c, v = found[:2] if found else (constraints, variables)
    small = apart(rows_with_sets(c, v, by, top, shared), [by], "xs").select(by, "idx", "set")
    return small.unionByName(tables_with_sets(*found[2:], by, top, shared, most_rounds)) if found else small


def tables_with_sets(constraints: DataFrame, variables: DataFrame, by: str, top: int, shared: int, most_rounds: int = 60) -> DataFrame:
    """:func:`independent_sets` by rounds: labels spread along ties until nothing changes."""
    c = constraints.filter(F.col("idx").isNotNull() & F.col(by).isNotNull()).groupBy(by, "idx").agg(F.min("text").alias("text"))
    v = variables.select(by, "name", "text").filter(F.col("name").isNotNull() & F.col(by).isNotNull()).distinct()
    both = c.select(by, F.col("idx").cast("long").alias("idx"), F.lit(None).cast("string").alias("name"), "text").unionByName(v.select(by, F.lit(None).cast("long").alias("idx"), F.col("name").cast("string").alias("name"), "text"))
    key = saved(weights(both, [by], ["idx", "name"], "text").filter(F.col("rank") <= top).select(by, "idx", "name", "term"), "keywords")
    mine, theirs = key.filter("idx is not null").drop("name"), key.filter("idx is null").drop("idx")
    ties = saved(mine.join(theirs, [by, "term"]).groupBy(by, "idx", "name").agg(F.count("*").alias("n")).filter(F.col("n") >= shared).select(by, "idx", "name"), "ties")
    label = saved(ties.select(by, "idx", F.col("idx").alias("set")).distinct(), "labels")
    before = None
    for _ in range(most_rounds):
        least = ties.join(label, [by, "idx"]).groupBy(by, "name").agg(F.min("set").alias("set"))
        near = ties.join(least, [by, "name"]).groupBy(by, "idx").agg(F.min("set").alias("set"))
        # a label's own label, so chains halve with every round
        jump = near.select(by, F.col("idx").alias("set"), F.col("set").alias("further"))
        label = saved(near.join(jump, [by, "set"], "left").select(by, "idx", F.coalesce(F.least("set", "further"), "set").alias("set")), "labels")
        now = label.agg(F.sum(F.col("set").cast("decimal(38,0)"))).first()[0]
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("sets did not settle")
    return c.select(by, F.col("idx").cast("long").alias("idx")).join(label, [by, "idx"], "left").select(by, "idx", F.coalesce("set", "idx").alias("set"))


def similarities(texts: DataFrame, by: list[str], layer: str, *, top: int = TOP) -> DataFrame:
    """by, a, b, similarity of all pairs of a group: how near they stand, common keywords, cosine of their words.

    ``texts``: by, idx, text and the column named by ``layer``, which says whose weights hold.
    """
    place = F.row_number().over(Window.partitionBy(*by).orderBy("idx"))
    x = texts.select(*by, "idx", F.col(layer).alias("__l"), place.alias("__p"))
    w = weights(texts, by, ["idx"], "text")
    a, b = (w.select(*by, "term", F.col("idx").alias(k), F.col("weight").alias(f"w{k}"), (F.col("rank") <= top).alias(f"t{k}")) for k in "ab")
    common = a.join(b, [*by, "term"]).filter("a < b").groupBy(*by, "a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("cosine"), F.sum((F.col("ta") & F.col("tb")).cast("int")).alias("shared"))
    pairs = x.select(*by, "__l", F.col("idx").alias("a"), F.col("__p").alias("pa")).join(x.select(*by, F.col("idx").alias("b"), F.col("__p").alias("pb")), by).filter("a < b")
    of = blend(F.col("__l"), F.col("pb") - F.col("pa"), F.coalesce("shared", F.lit(0)), F.coalesce("cosine", F.lit(0.0)), top)
    return pairs.join(common, [*by, "a", "b"], "left").select(*by, "a", "b", of.alias("similarity"))


def average_linkage(pairs: DataFrame, by: list[str], cut: float, most_rounds: int = 10_000) -> DataFrame:
    """by, idx, cluster (its least idx): the nearest clusters by mean distance merge while that is ``cut`` at most.

    ``pairs``: by, a, b (a < b), distance, for all pairs of a group.  Ties go to the lower ids.
    """
    member = saved(pairs.select(*by, F.explode(F.array("a", "b")).alias("idx")).distinct().withColumn("cluster", F.col("idx")), "clusters")
    p = saved(pairs.select(*by, "a", "b", F.col("distance").alias("s"), F.lit(1).cast("long").alias("m")), "linkage")
    for _ in range(most_rounds):
        x = p.withColumn("d", F.round(F.col("s") / F.col("m"), DIGITS))
        ends = x.select(*by, F.explode(F.array("a", "b")).alias("e"), F.struct("d", "a", "b").alias("x"))
        nearest = ends.groupBy(*by, "e").agg(F.min("x").alias("x"))
        # a pair that is the nearest of both its ends merges
        merge = saved(nearest.filter(F.col("x.d") <= round(cut, DIGITS)).groupBy(*by, "x").agg(F.count("*").alias("n")).filter("n = 2").select(*by, F.col("x.b").alias("old"), F.col("x.a").alias("new")), "merges")
        if merge.isEmpty():
            return member
        to = lambda k: merge.select(*by, F.col("old").alias(k), F.col("new").alias(f"new_{k}"))  # noqa: B023, E731
        moved = p.join(to("a"), [*by, "a"], "left").join(to("b"), [*by, "b"], "left").select(*by, F.coalesce("new_a", "a").alias("x"), F.coalesce("new_b", "b").alias("y"), "s", "m")
        p = saved(moved.filter("x <> y").groupBy(*by, F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.sum("s").alias("s"), F.sum("m").alias("m")), "linkage")
        member = saved(member.join(to("cluster"), [*by, "cluster"], "left").select(*by, "idx", F.coalesce("new_cluster", "cluster").alias("cluster")), "clusters")
    raise RuntimeError("clusters did not settle")


def tree(constraints: DataFrame, variables: DataFrame, by: str, *, top: int = TOP, shared: int = SHARED, few: int = FEW, alike: float = ALIKE, most_depth: int = 60, most: int = MOST) -> DataFrame:
    """by, idx, path, depth: the leaf of the partition tree that holds each constraint, named by the least idx on every level.

    The root is cut into independent sets, if there are several, every other node into clusters, until a node has ``few``
    constraints, a mean similarity of ``alike``, or no further cut.
    """
    found = sizes(constraints, variables, by, most)
    c, v = found[:2] if found else (constraints, variables)
    small = rows_tree(c, v, by, top, shared, few, alike, most_depth)
    return small.unionByName(tables_tree(*found[2:], by, top, shared, few, alike, most_depth)) if found else small


def tables_tree(constraints: DataFrame, variables: DataFrame, by: str, top: int, shared: int, few: int, alike: float, most_depth: int) -> DataFrame:
    """:func:`tree` by rounds: texts and pairs of all nodes of a level are rows."""
    c = constraints.filter(F.col("idx").isNotNull() & F.col(by).isNotNull()).groupBy(by, F.col("idx").cast("long").alias("idx")).agg(F.min("text").alias("text"))
    sets = tables_with_sets(constraints, variables, by, top, shared)
    several = sets.groupBy(by).agg((F.count_distinct("set") > 1).alias("several"))
    path = F.when(F.col("several"), F.concat(F.lit("/"), F.col("set").cast("string"))).otherwise("")
    live = saved(c.join(sets, [by, "idx"]).join(several, by).select(by, "idx", "text", path.alias("path"), F.when(F.col("several"), "default").otherwise("root").alias("layer"), F.col("several").cast("int").alias("depth")), "nodes")
    node, done = [by, "path"], []
    cut = 1 / (alike + EPSILON) - 1 / (1 + EPSILON)
    for _ in range(most_depth):
        size = live.groupBy(*node).agg(F.count("*").alias("size"))
        small = live.join(size.filter(F.col("size") <= few).select(*node), node, "left_semi")
        large = saved(live.join(size.filter(F.col("size") > few).select(*node), node, "left_semi"), "nodes")
        done.append(small.select(by, "idx", "path", "depth"))
        if large.isEmpty():
            break
        near = saved(similarities(large, node, "layer", top=top), "similarities")
        loose = near.groupBy(*node).agg(F.avg("similarity").alias("mean")).filter(F.round("mean", DIGITS) < alike).select(*node)
        label = average_linkage(near.join(loose, node, "left_semi").withColumn("distance", distance(F.col("similarity"))), node, cut)
        cuts = label.groupBy(*node).agg(F.count_distinct("cluster").alias("k")).filter("k > 1").select(*node)
        done.append(large.join(cuts, node, "left_anti").select(by, "idx", "path", "depth"))
        inner = label.join(cuts, node, "left_semi")
        live = saved(large.join(inner, [*node, "idx"]).select(by, "idx", "text", F.concat_ws("/", "path", F.col("cluster").cast("string")).alias("path"), F.lit("default").alias("layer"), (F.col("depth") + 1).alias("depth")), "nodes")
    else:
        raise RuntimeError("the tree is deeper than most_depth")
    return reduce(DataFrame.unionByName, done)

r"""Operator 12: vectors with a cosine of 0.95 or more, found by spherical-cap filters.

Filters.  A vector is turned by a fixed random rotation and cut into four blocks; each block has
B fixed random directions, and a filter is a choice of one direction in every block, so there are
B^4 of them without a table of B^4 directions.  A vector is decoded to all filters whose inner
product with it exceeds a threshold, and to its best ``least`` filters where fewer do: sums over
two blocks are sorted, and the pairs of sums beyond the threshold are read off by binary
search.  Two rotations are used (``CODES``).  Filters are as many as ``FILTERS`` times the vectors
and lists grow slowly with them, so buckets keep their size.  Vectors meet where they share a
filter; 128 sign bits dismiss those whose angle is far too large (six standard deviations
beyond the limit), and all that is left is compared in double precision.

Groups.  Equal vectors are one class.  Where many vectors have the same best filter, the
mean of these is a hub; a vector that shares a filter with a hub and lies within half the
limit's angle of it joins its ball.  Two members of a ball are linked, by the triangle
inequality, without being compared, and so are the members of two balls, or of a ball and a
vector, whose centres and radii leave no doubt.  A ball takes part as one item.  Only where
there is doubt are members compared, block by block, and only counts leave these tasks.  So
neither a class nor a tight group of near copies is ever expanded into its pairs.

Recall.  Found links are exact; a pair is missed only if it shares no filter.  Simulated at a
cosine of exactly 0.95 in 64 dimensions none of 500 pairs is, for 5e4 to 1e9 vectors; the
tests measure recall against brute force.

Defined results.  A vector that is null, zero, empty or holds a null or a non-finite component
links with nothing: n_links 0, component_id its own vec_id.  So does a row with a null
vec_id, whose component_id is null; it is kept.  Vectors of different lengths do not link.
Every row is a vector of its own, also rows that repeat a vec_id; rows with equal vectors
link.  Empty tables give no rows.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import store
from .graph import components

COSINE = 0.95
BLOCKS, CODES, FILTERS, LIST = 4, 2, 2, 16
BITS = 128
#: Vectors with the same best filter that make a hub.
HUB = 32
#: Radians by which sums of angles must be clear of the limit, far more than rounding errors.
CLEAR = 1e-6
#: Rows of a block where many items share a filter, or where members are compared.
BLOCK = 1024


class Code:
    """Filters for vectors of ``dim`` components."""

    def __init__(self, dim: int, per_block: int, expected: float, seed: int):
        self.dim, self.b, self.seed = dim, per_block, seed
        self.wide = max(2 * BLOCKS, -(-dim // BLOCKS) * BLOCKS)
        rng = np.random.default_rng([seed, dim])
        self.turn = np.linalg.qr(rng.standard_normal((self.wide, self.wide)))[0][:dim]
        words = rng.standard_normal((BLOCKS, per_block, self.wide // BLOCKS))
        self.words = words / np.linalg.norm(words, axis=2, keepdims=True)
        self.planes = rng.standard_normal((self.wide, BITS))
        share = min(0.5, expected / per_block**BLOCKS)
        self.least = max(4, round(expected * 2 / 3))
        self.threshold = NormalDist().inv_cdf(1 - share) * math.sqrt(BLOCKS / self.wide)

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Best filter and all filters of each row of unit vectors."""
        y, s = x @ self.turn, self.wide // BLOCKS
        p = [y[:, k * s : (k + 1) * s] @ self.words[k].T for k in range(BLOCKS)]
        halves = [(p[k][:, :, None] + p[k + 1][:, None, :]).reshape(len(x), -1) for k in (0, 2)]
        order = [np.argsort(-h, axis=1, kind="stable") for h in halves]
        left, right = [np.take_along_axis(h, o, 1) for h, o in zip(halves, order, strict=True)]
        k = min(self.least, left.shape[1])
        best = np.sort((left[:, :k, None] + right[:, None, :k]).reshape(len(x), -1), axis=1)[:, -k]
        limit = np.minimum(self.threshold, best)
        m, out = self.b**2, []
        for row in range(len(x)):
            a, b, t = left[row], right[row], limit[row] - 1e-12
            many = np.searchsorted(-a, b[0] - t, "right")
            n = np.searchsorted(-b, a[:many] - t, "right")
            second = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            out.append(np.repeat(order[0][row, :many], n) * m + order[1][row][second])
        return order[0][:, 0] * m + order[1][:, 0], out

    def signs(self, x: np.ndarray) -> np.ndarray:
        """128 sign bits of each row, as two 64-bit words."""
        return np.packbits(x @ self.turn @ self.planes > 0, axis=1).view(np.int64)


class Codes:
    """The codes of this job for any length of vectors; made in a task when first needed."""

    def __init__(self, vectors: int):
        self.b = max(4, math.ceil((FILTERS * max(vectors, 1)) ** (1 / BLOCKS)))
        self.expected = LIST * max(1.0, vectors / 1e5) ** 0.1
        self.made: dict = {}

    def __getstate__(self):
        return self.__dict__ | {"made": {}}

    def of(self, dim: int) -> list[Code]:
        if dim not in self.made:
            self.made[dim] = [Code(dim, self.b, self.expected, seed) for seed in range(CODES)]
        return self.made[dim]

    def decode(self, vectors: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
        """Best filter, filters and sign bits of each unit vector; filters of different lengths and codes differ."""
        top, lists, signs = np.zeros(len(vectors), np.int64), [None] * len(vectors), np.zeros((len(vectors), 2), np.int64)
        dims = np.array([len(v) for v in vectors])
        for dim in np.unique(dims):
            at = np.flatnonzero(dims == dim)
            step = max(1, 4_000_000 // self.b**2)
            for some in (at[k : k + step] for k in range(0, len(at), step)):
                x = np.stack([vectors[i] for i in some])
                found = [c.decode(x) for c in self.of(dim)]
                salt = [np.int64((dim * CODES + k) << 44) for k in range(CODES)]
                top[some] = found[0][0] ^ salt[0]
                signs[some] = self.of(dim)[0].signs(x)
                for j, i in enumerate(some):
                    lists[i] = np.concatenate([f[1][j] ^ s for f, s in zip(found, salt, strict=True)])
        return top, lists, signs


def arrays(column: pa.Array) -> list[np.ndarray]:
    """Rows of a column of lists of numbers, in double precision."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    ends = np.concatenate(([0], np.cumsum(pc.list_value_length(column).to_numpy(zero_copy_only=False)))).tolist()
    return [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def units(column: pa.Array) -> list[np.ndarray]:
    return [v / math.sqrt(v @ v) for v in arrays(column)]


def lists(parts: list[np.ndarray], kind) -> pa.ListArray:
    ends = np.concatenate(([0], np.cumsum([len(p) for p in parts], dtype=np.int64))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts) if parts else [], kind))


def keyed(rows: DataFrame) -> DataFrame:
    """vec_id, key (128-bit digest of the vector; null where it links with nothing) and vec of every row."""
    schema = rows.select("vec_id").schema.add("key", "binary").add("vec", T.ArrayType(T.DoubleType()))

    def run(batches):
        for batch in batches:
            keys = []
            for i, v in zip(batch.column("vec_id").to_pylist(), batch.column("vec"), strict=True):
                v = v.values
                x = v.to_numpy(zero_copy_only=False) if i is not None and v is not None and not v.null_count else np.zeros(1)
                n = float(x @ x) if len(x) and np.isfinite(x).all() else 0.0
                keys.append(hashlib.blake2b((x + 0.0).tobytes(), digest_size=16).digest() if 0 < n < math.inf else None)
            key = pa.array(keys, pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), key, pc.if_else(key.is_valid(), batch.column("vec"), None)], names=schema.names)

    return rows.select("vec_id", F.col("embedding").cast("array<double>").alias("vec")).mapInArrow(run, schema)


def coded(vectors: DataFrame, name: str, codes: Codes) -> DataFrame:
    """``name``, top, filters, s1, s2 of vectors (``name``, vec)."""
    schema = vectors.select(name).schema.add("top", "long").add("filters", T.ArrayType(T.LongType())).add("s1", "long").add("s2", "long")

    def run(batches):
        for batch in batches:
            top, found, signs = codes.decode(units(batch.column("vec")))
            yield pa.RecordBatch.from_arrays([batch.column(name), pa.array(top), lists(found, pa.int64()), pa.array(signs[:, 0].copy()), pa.array(signs[:, 1].copy())], names=schema.names)

    return vectors.select(name, "vec").mapInArrow(run, schema)


def hubs(classes: DataFrame, codes_of: DataFrame, codes: Codes, least: int) -> DataFrame:
    """hub, size, vec (unit), filters, s1, s2: means of at least ``least`` vectors with one best filter."""
    many = codes_of.groupBy("top").agg(F.count("*").alias("size")).filter(F.col("size") >= least)
    members = codes_of.select("key", "top").join(many, "top").join(classes.select("key", "vec"), "key").select("top", "vec")

    def sums(batches):
        for batch in batches:
            top, found = batch.column("top").to_numpy(zero_copy_only=False), units(batch.column("vec"))
            kinds, at = np.unique(np.stack([top, [len(v) for v in found]], axis=1), axis=0, return_inverse=True)
            out = [np.zeros(d) for d in kinds[:, 1]]
            for k, v in zip(at.reshape(-1).tolist(), found, strict=True):
                out[k] += v
            yield pa.RecordBatch.from_arrays([pa.array(kinds[:, 0].copy()), lists(out, pa.float64())], names=["hub", "vec"])

    parts = members.mapInArrow(sums, "hub long, vec array<double>").select("hub", F.posexplode("vec").alias("i", "x"))
    summed = parts.groupBy("hub", "i").agg(F.sum("x").alias("x")).groupBy("hub").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s.x).alias("vec"))  # one vector's components
    length = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x))
    found = summed.join(many.withColumnRenamed("top", "hub"), "hub").withColumn("vec", F.when(length > 1e-6, F.transform("vec", lambda x: x / length))).filter("vec is not null")
    found = store.table(found, "op12-means")
    return store.table(found.join(coded(found, "hub", codes).drop("top"), "hub"), "op12-hubs")


def angle(a: np.ndarray, b: np.ndarray) -> float:
    """Angle of two vectors of one length, of any norm; pi for others."""
    if len(a) != len(b):
        return math.pi
    return math.acos(min(1.0, max(-1.0, float(a @ b) / math.sqrt(float(a @ a) * float(b @ b)))))


def balls(classes: DataFrame, codes_of: DataFrame, centres: DataFrame, cosine: float) -> DataFrame:
    """key, hub, r: vectors within half the limit's angle of a hub with which they share a filter; of several, the largest."""
    half = math.acos(cosine) / 2 - CLEAR
    best = centres.select(F.explode("filters").alias("filter"), "hub", "size").groupBy("filter").agg(F.max(F.struct("size", "hub")).alias("h"))
    met = codes_of.select("key", F.explode("filters").alias("filter")).join(best, "filter").select("key", F.col("h.hub").alias("hub")).distinct()
    pairs = met.join(classes.select("key", "vec"), "key").join(centres.select("hub", "size", F.col("vec").alias("centre")), "hub")

    def run(batches):
        for batch in batches:
            r = np.array([angle(a, b) for a, b in zip(arrays(batch.column("vec")), arrays(batch.column("centre")), strict=True)])
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("key", "hub", "size")], pa.array(r, pa.float64())], names=["key", "hub", "size", "r"]).filter(pa.array(r <= half, pa.bool_()))

    near = pairs.select("key", "hub", "size", "vec", "centre").mapInArrow(run, "key binary, hub long, size long, r double")
    return near.groupBy("key").agg(F.max(F.struct("size", "hub", "r")).alias("h")).select("key", "h.hub", "h.r")


def runs(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """(rows, bounds): consecutive rows that agree in ``names`` are between two bounds, never cut by a batch's end."""
    held = None

    def bounds(t):
        new = np.zeros(len(t) - 1, bool)
        for n in names:
            v = t[n].to_numpy()
            new |= v[1:] != v[:-1]
        return np.concatenate(([0], np.flatnonzero(new) + 1, [len(t)]))

    for batch in batches:
        if not len(batch):
            continue
        t = pa.Table.from_batches([batch])
        t = t if held is None else pa.concat_tables([held, t]).combine_chunks()
        b = bounds(t)
        if len(b) > 2:
            yield t.slice(0, b[-2]), b[:-1]
        held = t.slice(b[-2])
    if held is not None:
        yield held, np.array([0, len(held)])


def candidates(entries: DataFrame, cosine: float) -> DataFrame:
    """Pairs (a, b) of items that share a filter and may be linked by their sign bits; ``entries`` has filter, item, r, s1, s2."""
    limit = math.acos(cosine)
    large = entries.groupBy("filter").agg(F.count("*").alias("g")).filter(F.col("g") > BLOCK).select("filter", F.ceil(F.col("g") / BLOCK).cast("int").alias("blocks"))
    dealt = entries.join(large, "filter", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("i", F.pmod(F.xxhash64("item"), F.col("blocks")).cast("int"))
    cells = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least("i", j).alias("lo"), F.greatest("i", j).alias("hi")))
    dealt = dealt.select("filter", "item", "r", "s1", "s2", "i", F.explode(cells).alias("c")).select("filter", F.col("c.lo").alias("lo"), F.col("c.hi").alias("hi"), "i", "item", "r", "s1", "s2")
    parts = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))

    def run(batches):
        for t, ends in runs(batches, "filter", "lo", "hi"):
            s = np.stack([t["s1"].to_numpy(), t["s2"].to_numpy()], axis=1).view(np.uint64)
            r, i, own = t["r"].to_numpy(), t["i"].to_numpy(), (t["lo"].to_numpy() == t["hi"].to_numpy())
            left, right = [], []
            for lo, hi in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                if hi - lo < 2:
                    continue
                x, y = np.triu_indices(hi - lo, 1)
                x, y = x + lo, y + lo
                if not own[lo]:
                    other = i[x] != i[y]
                    x, y = x[other], y[other]
                p = np.minimum(1.0, (limit + r[x] + r[y]) / math.pi)
                near = np.bitwise_count(s[x] ^ s[y]).sum(axis=1) <= BITS * p + 6 * np.sqrt(BITS * p * (1 - p))
                left.append(x[near])
                right.append(y[near])
            x, y = (np.concatenate(v) if v else np.empty(0, np.int64) for v in (left, right))
            a, b = (pc.take(t["item"].combine_chunks(), pa.array(v)) for v in (x, y))
            swap = pc.greater(a, b)
            yield pa.RecordBatch.from_arrays([pc.if_else(swap, b, a), pc.if_else(swap, a, b)], names=["a", "b"])

    return dealt.repartition(parts, "filter", "lo", "hi").sortWithinPartitions("filter", "lo", "hi").mapInArrow(run, "a binary, b binary").filter("a <> b").distinct()


def judged(pairs: DataFrame, items: DataFrame, cosine: float) -> DataFrame:
    """a, b, na, nb, full of pairs that are linked wholly (full) or may be in part; ``items`` has item, n, r, vec."""
    limit = math.acos(cosine)
    side = lambda s: items.select(F.col("item").alias(s), F.col("n").alias(f"n{s}"), F.col("r").alias(f"r{s}"), F.col("vec").alias(f"v{s}"))

    def run(batches):
        for batch in batches:
            ra, rb = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("ra", "rb"))
            full, some = np.zeros(len(ra), bool), np.zeros(len(ra), bool)
            for i, (x, y) in enumerate(zip(arrays(batch.column("va")), arrays(batch.column("vb")), strict=True)):
                if len(x) != len(y):
                    continue
                if ra[i] == 0 == rb[i]:
                    full[i] = float(x @ y) / math.sqrt(float(x @ x) * float(y @ y)) >= cosine
                else:
                    d = angle(x, y)
                    full[i] = d + ra[i] + rb[i] <= limit - CLEAR
                    some[i] = not full[i] and d - ra[i] - rb[i] <= limit + CLEAR
            keep = pa.array(full | some)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("a", "b", "na", "nb")], pa.array(full)], names=["a", "b", "na", "nb", "full"]).filter(keep)

    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "ra", "rb", "va", "vb").mapInArrow(run, "a binary, b binary, na long, nb long, full boolean")


def compared(open_pairs: DataFrame, members: DataFrame, cosine: float) -> DataFrame:
    """a, b, key, n: for members of two items that may be linked in part, the weight of the linked members of the other; only of members with any.

    ``members`` has item, key, w, vec and block.  A task holds one block of either item.
    """
    blocks = members.groupBy("item").agg(F.max("block").alias("most"))
    both = open_pairs.select("a", "b").join(blocks.select(F.col("item").alias("a"), F.col("most").alias("ma")), "a").join(blocks.select(F.col("item").alias("b"), F.col("most").alias("mb")), "b")
    cells = both.select("a", "b", F.explode(F.sequence(F.lit(0), F.col("ma"))).alias("i"), "mb").select("a", "b", "i", F.explode(F.sequence(F.lit(0), F.col("mb"))).alias("j"))
    cells = cells.withColumn("cell", F.xxhash64("a", "b", "i", "j"))
    side = lambda item, block, k: cells.select("cell", "a", "b", "i", "j", F.col(item).alias("item"), F.col(block).alias("block"), F.lit(k).alias("side")).join(members, ["item", "block"]).select("cell", "a", "b", "i", "j", "side", "key", "w", "vec")
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))

    def run(batches):
        for t, ends in runs(batches, "cell", "a", "b", "i", "j"):
            found, w, second = arrays(t["vec"].combine_chunks()), t["w"].to_numpy(), t["side"].to_numpy() == 1
            n = np.zeros(len(found), np.int64)
            for lo, hi in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                right = second[lo:hi]
                if right.all() or not right.any():
                    continue
                x = np.stack(found[lo:hi])
                norm = np.sqrt((x * x).sum(axis=1))
                near = (x[~right] @ x[right].T) / np.outer(norm[~right], norm[right]) >= cosine
                n[np.flatnonzero(~right) + lo] = near @ w[lo:hi][right]
                n[np.flatnonzero(right) + lo] = w[lo:hi][~right] @ near
            yield from t.select(["a", "b", "key"]).append_column("n", pa.array(n)).filter(pa.array(n > 0)).to_batches()

    rows = side("a", "i", 0).unionByName(side("b", "j", 1))
    return rows.repartition(parts, "cell").sortWithinPartitions("cell", "a", "b", "i", "j", "side", "key").mapInArrow(run, "a binary, b binary, key binary, n long")


def near_vectors(rows: DataFrame, *, cosine: float = COSINE, hub: int = HUB) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of ``rows`` (vec_id, embedding)."""
    every = keyed(rows)
    narrow = store.table(every.select("vec_id", "key"), "op12-rows")
    classes = store.table(every.filter("key is not null").groupBy("key").agg(F.min("vec_id").alias("id"), F.count("*").alias("w"), F.any_value("vec").alias("vec")), "op12-classes")
    codes = Codes(classes.count())
    codes_of = store.table(coded(classes, "key", codes), "op12-codes")

    # items: balls and single vectors
    centres = hubs(classes, codes_of, codes, hub)
    inside = store.table(balls(classes, codes_of, centres, cosine), "op12-balls")
    named = inside.groupBy("hub").agg(F.min("key").alias("item"), F.max("r").alias("r"))
    item_of = classes.select("key", "id", "w").join(inside.select("key", "hub"), "key", "left").join(named.drop("r"), "hub", "left").select("key", "id", "w", "hub", F.coalesce("item", "key").alias("item"))
    item_of = store.table(item_of, "op12-members")
    weights = item_of.groupBy("item").agg(F.sum("w").alias("n"), F.min("id").alias("id"), F.min("hub").alias("hub"))
    single = weights.filter("hub is null").join(classes.select(F.col("key").alias("item"), "vec"), "item").select("item", "n", "id", F.lit(0.0).alias("r"), "vec")
    items = single.unionByName(weights.filter("hub is not null").join(named.select("hub", "r"), "hub").join(centres.select("hub", "vec"), "hub").select("item", "n", "id", "r", "vec"))
    items = store.table(items, "op12-items")

    # pairs of items
    alone = item_of.filter("hub is null").select("key", "item").join(codes_of, "key").select(F.explode("filters").alias("filter"), "item", F.lit(0.0).alias("r"), "s1", "s2")
    grouped = item_of.filter("hub is not null").select("key", "hub", "item").join(codes_of.select("key", "filters"), "key").select(F.explode("filters").alias("filter"), "hub", "item").distinct()
    grouped = grouped.join(named.select("hub", "r"), "hub").join(centres.select("hub", "s1", "s2"), "hub").select("filter", "item", "r", "s1", "s2")
    pairs = store.table(candidates(alone.unionByName(grouped), cosine), "op12-pairs")
    told = store.table(judged(pairs, items, cosine), "op12-judged")
    whole, part = told.filter("full"), told.filter("not full")
    blocks = weights.filter("hub is not null").join(item_of.groupBy("item").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "item").select("item", "blocks")
    members = item_of.join(blocks, "item", "left").select("item", "key", "w", F.pmod(F.xxhash64("key"), F.coalesce("blocks", F.lit(1))).cast("int").alias("block")).join(classes.select("key", "vec"), "key")
    found = store.table(compared(part, members, cosine), "op12-compared")

    # links of a class: its copies, the rest of its ball, items linked wholly, members of others
    by_item = whole.select(F.col("a").alias("item"), F.col("nb").alias("n")).unionByName(whole.select(F.col("b").alias("item"), F.col("na").alias("n"))).groupBy("item").agg(F.sum("n").alias("more"))
    by_key = found.groupBy("key").agg(F.sum("n").alias("own"))
    edges = whole.select("a", "b").unionByName(found.select("a", "b")).distinct()
    comp = store.table(components(edges), "op12-components")
    placed = items.select("item", "id", "n").join(comp.withColumnRenamed("node", "item"), "item", "left").withColumn("component", F.coalesce("component", "item"))
    least = placed.groupBy("component").agg(F.min("id").alias("component_id"))
    of_item = placed.join(least, "component").join(by_item, "item", "left").select("item", "component_id", (F.col("n") + F.coalesce("more", F.lit(0))).alias("n"))
    of_key = item_of.select("key", "item").join(of_item, "item").join(by_key, "key", "left").select("key", "component_id", (F.col("n") - 1 + F.coalesce("own", F.lit(0))).alias("n_links"))
    out = narrow.join(of_key, "key", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    out = out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
    return out


def op12_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(store.read(spark, sf_dir, "embeddings"))


def brute_force(rows: list[tuple], cosine: float = COSINE) -> list[tuple]:
    """Reference for tests: all pairs of all rows (vec_id, embedding)."""
    def usable(v):
        return v is not None and len(v) > 0 and all(c is not None and math.isfinite(c) for c in v) and any(c != 0 for c in v)

    fit = [np.array(v, np.float64) if i is not None and usable(v) else None for i, v in rows]
    n, parent = [0] * len(rows), list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, x in enumerate(fit):
        for j, y in enumerate(fit[:i]):
            if x is not None and y is not None and len(x) == len(y) and float(x @ y) / math.sqrt(float(x @ x) * float(y @ y)) >= cosine:
                n[i] += 1
                n[j] += 1
                parent[root(i)] = root(j)
    least: dict = {}
    for i, (v, _) in enumerate(rows):
        if v is not None:
            least[root(i)] = min(v, least.get(root(i), v))
    return [(v, n[i], None if v is None else least[root(i)], v is None or v == least[root(i)]) for i, (v, _) in enumerate(rows)]

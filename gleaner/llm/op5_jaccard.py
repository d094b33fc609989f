"""Operator 5: exact n-gram Jaccard join by a partitioned universe.

A document is the set of its distinct word shingles.  Two sets link where their
Jaccard similarity is at least ``num / den`` (9/10).  Sets linked with a larger set
of size s differ from it in at most H = floor(2 s (den - num) / (den + num)) shingles.

Candidates.  Sizes are cut into bands; the band of the larger set of a pair gives H
for its upper end.  Shingles are hashed into m = H + 1 segments, so two linked sets
agree in one segment at least.  A document is indexed under its segments in its own
band, and in the next bands that a set similar to it can belong to.  A segment with
fewer than ``LEAST`` shingles is costly as a key: many unrelated documents share
it.  It is left out, and for z such segments left out the one-deletion neighbourhoods of
z segments with more than ``LEAST`` shingles are indexed too, of the first ones, so no key stands for fewer than
``LEAST``.  No linked pair is lost: take that of its two sets whose neighbourhoods end
first, and let z be its number.  Were the pair to share no key, its z left-out segments might agree, its
others would differ in one shingle at least, and those z with neighbourhoods in two, which makes
(m - z) + z = m > H.  A set without so many large segments leaves nothing out and has all
neighbourhoods.

Verification.  Texts with equal sequences of words, told by 128-bit BLAKE2 digests, are one
class and take part once; every other link is compared on the texts themselves, where
hashes stand for shingles only after a check that no two of these texts' shingles share
one.  In a key's bucket, members are compared with the bucket's least member; classes joined by
these links are components.  Buckets that then still hold several components have all
their other pairs across components compared, and the links found join the components
finally.  So every pair that could join two components has been compared exactly, and
pairs inside a component need not be.  Before two texts are fetched, parity sketches are
compared: bit h(t) mod B of a sketch is the parity of the set's shingles t that fall on
it, so the number of bits in which two sketches differ is never more than the number of
shingles in which the sets differ, and a pair beyond H is dismissed rightly.

Large buckets.  Across components, members meet in cells of at most two blocks of
``BLOCK`` members, so no task holds a bucket, whatever its size; dismissed pairs are never
rows, and those found leave the task as they come.

Defined results.  Null, empty or blank text: an empty set, linked with nothing,
component_id its own doc_id.  Rows with one doc_id are one node: their links are
pooled, also where their texts differ and belong to different classes.  A null doc_id links with nothing and has a null component.  Repeated rows are
all returned.  Extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import shingles, store
from .graph import components

U = np.uint64
WIDTH, NUM, DEN = 3, 9, 10
LEAST = 2
GROWTH = 1.2


class Plan:
    """Bands of sizes and their numbers of segments for the threshold num / den."""

    def __init__(self, num: int = NUM, den: int = DEN, least: int = LEAST, growth: float = GROWTH):
        self.num, self.den, self.least, self.growth = num, den, least, growth

    def differ(self, larger: int) -> int:
        """The most shingles in which a set of this size and a smaller linked one can differ."""
        return 2 * larger * (self.den - self.num) // (self.den + self.num)

    def band(self, n: int) -> tuple[int, int]:
        """Lowest and highest size of the band of ``n``."""
        low = 1
        while True:
            high = max(low, math.floor(low * self.growth))
            if n <= high:
                return low, high
            low = high + 1

    def bands(self, n: int) -> list[tuple[int, int]]:
        """(band's highest size, segments) of all bands in which a set of size n has linked sets as large or larger."""
        out, low = [], n
        while low * self.num <= n * self.den:
            high = self.band(low)[1]
            out.append((high, self.differ(high) + 1))
            low = high + 1
        return out


def keys(s: np.ndarray, plan: Plan, known: dict) -> np.ndarray:
    """The index keys (uint64) of one set."""
    n = len(s)
    if not n:
        return np.empty(0, U)
    if n not in known:
        if len(known) > 100_000:
            known.clear()
        known[n] = plan.bands(n)
    out = []
    for high, m in known[n]:
        salt = U((high * 0x9E3779B97F4A7C15) % (1 << 64))
        x = shingles.mix(s ^ salt)
        seg = (x >> U(32)).astype(np.int64) % m
        order = np.argsort(seg, kind="stable")
        g, y = seg[order], shingles.mix(x[order] + U(0x2545F4914F6CDD1D))
        count = np.bincount(g, minlength=m)
        total = np.zeros(m, U)
        here = np.flatnonzero(count)
        total[here] = np.add.reduceat(y, np.concatenate(([0], np.cumsum(count)[here][:-1])))
        name = np.arange(m, dtype=np.int64).astype(U) * U(0xD1342543DE82EF95) + salt
        full = shingles.mix(total + name)
        costly = count < plan.least
        z = int(costly.sum())
        if not z or m == 1:  # with one segment only equal sets link
            out.append(full)
            continue
        ample = np.cumsum(count > plan.least)
        few = ample[-1] < z
        out.append(full if few else full[~costly])
        first = m if few else int(np.searchsorted(ample, z)) + 1
        head = np.flatnonzero(~costly[:first])
        out.append(shingles.mix(total[head] + name[head] + U(1)))
        inside = (g < first) & (count[g] > plan.least)
        out.append(shingles.mix(total[g[inside]] - y[inside] + name[g[inside]] + U(1)))
    return np.concatenate(out) if out else np.empty(0, U)


BLOCK = 512
#: Pairs that a task sends on at once.
FLUSH = 50_000


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate(([0], np.cumsum([len(k) for k in parts], dtype=np.int64))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts) if parts else np.empty(0, np.int64)))


def parity(s: np.ndarray) -> np.ndarray:
    """Parity sketch of a set: as many bits as the next power of two from 3/5 of the set's size on, 128 at least.

    Sketches of unrelated sets of one size differ in half of their bits or nearly so, linked sets in 2/9 of their size at most.
    """
    bits = 1 << max(7, int(0.6 * len(s)).bit_length())
    at = (shingles.mix(s ^ U(0x3C6EF372FE94F82B)) & U(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8), bitorder="little").view(np.int64)


def fold(sketches: np.ndarray, words: int) -> np.ndarray:
    """Sketches (rows) of the given number of words: the halves of a sketch, put together, are one of half its bits."""
    while sketches.shape[-1] > words:
        half = sketches.shape[-1] // 2
        sketches = sketches[..., :half] ^ sketches[..., half:]
    return sketches


def signed(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n, f1, f2 (digest of its words) and sketch of every row; f1 and f2 are null without words."""
    out = store.schema("n long, f1 long, f2 long, sketch array<long>")
    schema = docs.select("doc_id").schema
    for f in out:
        schema = schema.add(f.name, f.dataType)

    def run(batches):
        for batch in batches:
            n, f1, f2, sk = [], [], [], []
            with np.errstate(over="ignore"):
                for s in shingles.shingle_sets(batch.column("text"), width):
                    n.append(len(s))
                    sk.append(parity(s))
            for part in shingles.pieces(batch.column("text")):
                for d in shingles.digests(part):
                    f1.append(d and int.from_bytes(d[:8], "little", signed=True))
                    f2.append(d and int.from_bytes(d[8:], "little", signed=True))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), _lists(sk)], names=schema.names)
        store.trim()

    return docs.select("doc_id", "text").mapInArrow(run, schema)


#: Keys that a task holds before it sends them on, and keys of a place at most, about.
HELD, PLACE = 2_000_000, 1 << 20
#: Bytes of a key that are sent: chance equals of a shorter key only add pairs, which are then compared.
SENT = 6


def packed(x: np.ndarray, first: int = 0) -> bytes:
    """Numbers of 64 bits as planes of bytes, from byte ``first`` on: bytes that agree lie together, and compress."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8)[:, first:].T.tobytes()


def unpacked(data: bytes, first: int = 0) -> np.ndarray:
    """The numbers (uint64) of :func:`packed`, bytes before ``first`` being 0."""
    planes = np.frombuffer(data, np.uint8).reshape(8 - first, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, first:] = planes.T
    return out.view(U).ravel()


def _others(k: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(k, d) in order; whether an element is the first of its key; the first member of its key."""
    order = np.lexsort((d, k))
    k, d = k[order], d[order]
    head = np.concatenate(([True], k[1:] != k[:-1]))
    return k, d, head, d[head][np.cumsum(head) - 1]


def stars(docs: DataFrame, plan: Plan, width: int, places: int) -> DataFrame:
    """key, a, b: in every bucket of two members or more, b is compared with a smaller member a.

    Keys go to the shuffle packed, sorted by ranges (``places``, a power of two), about 7 bytes each; nearly all of them
    have one member and end there.  Members of a bucket that one task holds meet in it, and only the
    least of them goes on as a member, so a bucket's members in a place are bounded by the number of times a task sends.
    """
    bits = U(64 - (places.bit_length() - 1))
    drop = 8 - SENT

    def local(batches):
        known: dict = {}
        ks, ds, size = [], [], 0

        def flush():
            k, d, head, hub = _others(np.concatenate(ks) >> U(8 * drop) << U(8 * drop), np.repeat(np.array(ds, np.int64), [len(x) for x in ks]))
            kh, dh = k[head], d[head]
            at = np.concatenate((np.searchsorted(kh >> bits, np.arange(places, dtype=U)), [len(kh)])).tolist()
            rows = [(p, packed(kh[i:j], drop), packed(dh[i:j]), None) for p, (i, j) in enumerate(zip(at, at[1:], strict=False)) if i < j]
            other = ~head & (d != hub)
            k, a, b = k[other], hub[other], d[other]
            for i in range(0, len(k), 100_000):  # a local pair is done: it may go anywhere
                x = slice(i, i + 100_000)
                rows.append((int(k[i] % U(places - 1)) if places > 1 else 0, packed(k[x], drop), packed(a[x]), packed(b[x])))
            for i in range(0, len(rows), 256):
                columns = zip(*rows[i : i + 256], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["place", "key", "a", "b"])

        for batch in batches:
            with np.errstate(over="ignore"):
                for d, s in zip(batch.column("doc_id").to_pylist(), shingles.shingle_sets(batch.column("text"), width), strict=True):
                    k = keys(s, plan, known)
                    if len(k):
                        ks.append(k)
                        ds.append(d)
                        size += len(k)
                    if size >= HELD:
                        yield from flush()
                        ks, ds, size = [], [], 0
        if ks:
            yield from flush()
        store.trim()

    def met(batches):
        place, ks, ds = None, [], []

        def found(k, a, b):
            for i in range(0, len(k), 200_000):
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x[i : i + 200_000]).view(np.int64)) for x in (k, a, b)], names=["key", "a", "b"])

        def flush():
            k, d, head, hub = _others(np.concatenate(ks), np.concatenate(ds))
            other = ~head & (d != hub)
            yield from found(k[other], hub[other], d[other])

        for batch in batches:
            for p, k, a, b in zip(*(batch.column(c) for c in ("place", "key", "a", "b")), strict=True):
                k, a = unpacked(k.as_py(), drop), unpacked(a.as_py()).view(np.int64)
                if b.is_valid:
                    yield from found(k, a, unpacked(b.as_py()).view(np.int64))
                    continue
                if p.as_py() != place:
                    if ks:
                        yield from flush()
                    place, ks, ds = p.as_py(), [], []
                ks.append(k)
                ds.append(a)
        if ks:
            yield from flush()
        store.trim()

    sent = docs.select("doc_id", "text").mapInArrow(local, "place int, key binary, a binary, b binary")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return sent.repartition(parts, "place").sortWithinPartitions("place").mapInArrow(met, "key long, a long, b long")


def possible(pairs: DataFrame, known: DataFrame, plan: Plan) -> DataFrame:
    """The pairs (a, b) that their sizes and sketches do not dismiss; ``known`` has doc_id, n, sketch."""
    one = pairs.join(known.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa")), "a")
    two = one.join(known.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb")), "b")
    num, den = plan.num, plan.den

    def run(batches):
        for batch in batches:
            na, nb = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("na", "nb"))
            fit = (np.minimum(na, nb) * den >= np.maximum(na, nb) * num) & (np.minimum(na, nb) > 0)
            most = (na + nb) * (den - num) // (den + num)
            parts = []
            for name in ("sa", "sb"):
                col = batch.column(name)
                ends = np.concatenate(([0], np.cumsum(np.diff(np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1]))))
                parts.append((col.flatten().to_numpy(zero_copy_only=False), ends))
            (x, xe), (y, ye) = [(v.view(U), e) for v, e in parts]  # bits of signed numbers are counted without their sign
            for i in np.flatnonzero(fit).tolist():
                s, t = x[xe[i] : xe[i + 1]], y[ye[i] : ye[i + 1]]
                words = min(len(s), len(t))
                fit[i] = np.bitwise_count(fold(s, words) ^ fold(t, words)).sum() <= most[i]
            yield batch.select(["a", "b"]).filter(pa.array(fit))

    return two.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(run, "a long, b long").distinct()


def unmet(told: DataFrame) -> DataFrame:
    """key, x, c (component): the members of buckets that can hold pairs across components that were not compared.

    ``told`` has the compared pairs: key, a, b, ca, cb (components).  A bucket of one pair is done; one with a single smaller
    member a has all its pairs with a behind it, so only the others are left.
    """
    left = told.groupBy("key").agg(F.count("*").alias("n"), F.min("a").alias("a0"), F.max("a").alias("a1"), F.min("cb").alias("c0"), F.max("cb").alias("c1"), F.count_if(F.col("ca") != F.col("cb")).alias("open"))
    left = left.filter((F.col("n") > 1) & (F.col("open") > 0) & ((F.col("a0") != F.col("a1")) | (F.col("c0") != F.col("c1")))).select("key", (F.col("a0") != F.col("a1")).alias("several"))
    rows = told.join(left, "key")
    both = F.array(F.struct(F.col("b").alias("x"), F.col("cb").alias("c")), F.when(F.col("several"), F.struct(F.col("a").alias("x"), F.col("ca").alias("c"))))
    return rows.select("key", F.explode(F.array_compact(both)).alias("m")).select("key", "m.*").distinct()


def doubtful(members: DataFrame, known: DataFrame, plan: Plan) -> DataFrame:
    """cell, key, x: members of a cell that a pair of one bucket and of different components holds which sizes and sketches do not dismiss.

    ``members`` has key, x, c (component), ``known`` doc_id, n, sketch.  A bucket's members are dealt
    into blocks; a cell holds a pair of blocks.  Sketches are sent once, to the cells.  A cell gives on
    each member once at most, however many pairs it has.
    """
    size = members.groupBy("key").agg(F.count("*").alias("g")).filter(F.col("g") > BLOCK).select("key", F.ceil(F.col("g") / BLOCK).cast("int").alias("blocks"))
    dealt = members.join(size, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("i", F.pmod(F.xxhash64("x"), F.col("blocks")).cast("int"))
    cells = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least("i", j).alias("lo"), F.greatest("i", j).alias("hi")))
    dealt = dealt.select("key", "x", "c", "i", F.explode(cells).alias("cell")).select(F.xxhash64("key", "cell.lo", "cell.hi").alias("cell"), "key", (F.col("cell.lo") == F.col("cell.hi")).alias("own"), "i", "x", "c")
    dealt = dealt.join(known, F.col("x") == F.col("doc_id")).drop("doc_id")
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    num, den = plan.num, plan.den

    def left(rows):
        """Members of one cell's rows [own, i, x, c, n, sketch] that are in a pair."""
        words = min(len(r[5]) for r in rows)
        sk = np.stack([fold(r[5], words) for r in rows])
        own, blk, x, c, n = rows[0][0], *(np.array([r[k] for r in rows]) for k in (1, 2, 3, 4))
        kept = np.zeros(len(rows), bool)
        for i in range(len(rows) - 1):
            m = n[i + 1 :]
            ok = (c[i + 1 :] != c[i]) & (np.minimum(m, n[i]) * den >= np.maximum(m, n[i]) * num)
            if not own:
                ok &= blk[i + 1 :] != blk[i]
            at = np.flatnonzero(ok) + i + 1
            if len(at):
                near = at[np.bitwise_count(sk[at] ^ sk[i]).sum(axis=1) <= (n[at] + n[i]) * (den - num) // (den + num)]
                kept[near] = True
                kept[i] |= len(near) > 0
        return x[kept]

    def cells_of(batches):
        """(cell, key), rows of one cell after another."""
        cell, rows = None, []
        for batch in batches:
            col = batch.column("sketch")
            ends = np.concatenate(([0], np.cumsum(np.diff(np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1])))).tolist()
            flat = col.flatten().to_numpy(zero_copy_only=False).view(U)  # bits of signed numbers are counted without their sign
            columns = [batch.column(k).to_pylist() for k in ("cell", "key", "own", "i", "x", "c", "n")]
            for at, (h, k, *rest) in enumerate(zip(*columns, strict=True)):
                if (h, k) != cell:
                    if len(rows) > 1:
                        yield cell, rows
                    cell, rows = (h, k), []
                rows.append((*rest, flat[ends[at] : ends[at + 1]]))
        if len(rows) > 1:
            yield cell, rows

    def run(batches):
        held, size = [], 0

        def flush():
            cell, key, x = (np.concatenate([p[k] for p in held] or [np.empty(0, np.int64)]) for k in range(3))
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (cell, key, x)], names=["cell", "key", "x"])

        for (cell, key), rows in cells_of(batches):
            x = left(rows)
            held.append((np.full(len(x), cell), np.full(len(x), key), x))
            size += len(x)
            if size > FLUSH:
                yield flush()
                held, size = [], 0
        yield flush()

    return dealt.repartition(parts, "cell").sortWithinPartitions("cell", "key").mapInArrow(run, "cell long, key long, x long")


#: Bytes of texts on one side of a comparison of a cell's members, and shingles of a product, about.
SIDE, COLUMNS = 4 << 20, 4096


def linked(texts: pa.Array, plan: Plan, width: int) -> np.ndarray:
    """Matrix of which of some texts link, by exact counts of common shingles: products of the table of texts and shared shingles."""
    sets = shingles.exact_sets(texts, width)
    if sets and isinstance(sets[0], frozenset):
        code: dict = {}
        sets = [np.array([code.setdefault(s, len(code)) for s in t], U) for t in sets]
    n = np.array([len(s) for s in sets], np.int64)
    _, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times[at] > 1
    column = (np.cumsum(times > 1) - 1)[at[shared]]
    row = np.repeat(np.arange(len(sets)), n)[shared]
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    both = np.zeros((len(sets), len(sets)))
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        i, j = np.searchsorted(column, (start, start + COLUMNS))
        part = np.zeros((len(sets), COLUMNS))
        part[row[i:j], column[i:j] - start] = 1
        both += part @ part.T
    return (both > 0) & (both * plan.den >= plan.num * (n[:, None] + n[None, :] - both))


def forest(links: np.ndarray) -> list[tuple[int, int]]:
    """Links (i < j) that join the same rows as all of ``links`` do, one for each time two groups of rows meet."""
    root, out = np.arange(len(links)), []
    for j in range(1, len(links)):
        near = np.flatnonzero(links[j, :j])
        if len(near):
            roots, at = np.unique(root[near], return_index=True)
            out += [(i, j) for i in near[at].tolist()]
            root[j] = roots[0]
            root[np.isin(root, roots)] = roots[0]
    return out


def across(members: DataFrame, known: DataFrame, docs: DataFrame, plan: Plan, width: int = WIDTH) -> DataFrame:
    """Links (a, b) that join all members of one bucket and of different components that link.

    Members that sketches leave in doubt are compared on their texts in their cell, so a pair is never a row:
    of a cell's links those of a forest leave the task, fewer than its members.  Cells of the same members are one.
    """
    hot = doubtful(members, known, plan)
    same = hot.groupBy("cell", "key").agg(F.sort_array(F.collect_list("x")).alias("xs")).select("xs").distinct()
    cells = store.table(same.withColumn("cell", F.monotonically_increasing_id()), "op5-cells")
    placed = cells.select("cell", F.explode("xs").alias("doc_id"))
    texts = store.table(docs.select("doc_id", "text").filter("doc_id is not null").join(placed.select("doc_id").distinct(), "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]), "op5-texts")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))

    def compared(ids: pa.Array, texts: pa.Array):
        size = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
        side = (np.cumsum(size) - size) // SIDE
        ends = [*np.flatnonzero(np.diff(side, prepend=-1)).tolist(), len(side)]
        blocks = list(zip(ends, ends[1:], strict=False))
        for p, (i, j) in enumerate(blocks):
            for k, m in blocks[p + 1 :] or ([(j, j)] if p == 0 else []):
                one = pa.concat_arrays([texts.slice(i, j - i), texts.slice(k, m - k)])
                x = pa.concat_arrays([ids.slice(i, j - i), ids.slice(k, m - k)]).to_numpy()
                with np.errstate(over="ignore"):
                    found = forest(linked(one, plan, width))
                for a, b in found:
                    if x[a] != x[b]:
                        yield min(x[a], x[b]), max(x[a], x[b])

    def run(batches):
        cell, ids, texts = None, [], []

        def flush():
            found = list(compared(pa.concat_arrays(ids), pc.fill_null(pa.concat_arrays(texts), ""))) if ids else []
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            at = batch.column("cell").to_numpy()
            starts = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(at)]
            for i, j in zip(starts, starts[1:], strict=False):
                if i == j:
                    continue
                if at[i] != cell:
                    yield flush()
                    cell, ids, texts = at[i], [], []
                ids.append(batch.column("doc_id").slice(i, j - i))
                texts.append(batch.column("text").slice(i, j - i))
        yield flush()
        store.trim()

    sent = placed.join(texts, "doc_id").repartition(parts, "cell").sortWithinPartitions("cell").select("cell", "doc_id", "text")
    out = store.table(sent.mapInArrow(run, "a long, b long").distinct(), "op5-links")
    store.drop(cells)
    store.drop(texts)
    return out


def verified(pairs: DataFrame, docs: DataFrame, plan: Plan, width: int = WIDTH) -> DataFrame:
    """The pairs (a, b) whose sets link, compared on the documents' texts."""
    need = pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id"))).distinct()
    texts = store.table(docs.select("doc_id", "text").filter("doc_id is not null").join(need, "doc_id", "left_semi"), "op5-texts")
    one = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a")
    two = one.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b")
    num, den = plan.num, plan.den

    def parts(batch, rows=512, most=4 << 20):
        """Slices of at most ``rows`` pairs and about ``most`` bytes of texts."""
        sizes = (pc.binary_length(pc.fill_null(batch.column("ta"), "")).to_numpy(zero_copy_only=False).astype(np.int64) + pc.binary_length(pc.fill_null(batch.column("tb"), "")).to_numpy(zero_copy_only=False)).tolist()
        at = 0
        while at < len(sizes):
            to, held = at, 0
            while to < len(sizes) and to - at < rows and (to == at or held + sizes[to] <= most):
                held += sizes[to]
                to += 1
            yield batch.slice(at, to - at)
            at = to

    def run(batches):
        for batch in batches:
            for part in parts(batch):
                enc = pc.fill_null(part.column("ta"), "").dictionary_encode()  # the bucket's least member recurs
                right = pc.fill_null(part.column("tb"), "")
                with np.errstate(over="ignore"):
                    sets = shingles.exact_sets(pa.concat_arrays([enc.dictionary, right]), width)
                    keep = []
                    for i, t in zip(enc.indices.to_pylist(), sets[len(enc.dictionary) :], strict=True):
                        s = sets[i]
                        small, large = min(len(s), len(t)), max(len(s), len(t))
                        if not small or small * den < large * num:
                            keep.append(False)
                            continue
                        both = len(s & t) if isinstance(s, frozenset) else len(s) + len(t) - len(np.union1d(s, t))
                        keep.append(both * den >= num * (len(s) + len(t) - both))
                yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
        store.trim()

    out = store.table(two.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long").distinct(), "op5-links")
    store.drop(texts)
    return out


def links(docs: DataFrame, *, width: int = WIDTH, num: int = NUM, den: int = DEN) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs``."""
    plan = Plan(num, den)
    rows = store.table(signed(docs, width), "op5-rows")
    full = rows.filter("doc_id is not null and n > 0")
    # equal texts are one class; its least doc_id stands for it
    classes = store.table(full.groupBy("f1", "f2").agg(F.min("doc_id").alias("doc_id"), F.min_by("n", "doc_id").alias("n"), F.min_by("sketch", "doc_id").alias("sketch")), "op5-classes")
    spare = store.table(full.select("doc_id").join(classes.select("doc_id"), "doc_id", "left_anti").distinct(), "op5-spare")
    asked = docs.select("doc_id", "text").filter("doc_id is not null").join(spare, "doc_id", "left_anti")
    shuffled = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    total = classes.agg(F.sum("n")).first()[0] or 0
    met = store.table(stars(asked, plan, width, 1 << (max(4 * shuffled, 3 * total // PLACE) - 1).bit_length()), "op5-stars")  # at most about three keys a shingle
    store.drop(spare)
    known = classes.select("doc_id", "n", "sketch")
    pairs = store.table(possible(met.select("a", "b").distinct(), known, plan), "op5-pairs")
    same = verified(pairs, docs, plan, width)
    store.drop(pairs)
    # a doc_id whose texts differ joins their classes
    print_ = F.struct("f1", "f2")
    several = full.groupBy("doc_id").agg((F.min(print_) != F.max(print_)).alias("several")).filter("several").select(F.col("doc_id").alias("b"))
    own = full.select("f1", "f2", F.col("doc_id").alias("b")).join(several, "b", "left_semi").join(classes.select("f1", "f2", F.col("doc_id").alias("a")), ["f1", "f2"]).filter("a <> b")
    same = same.unionByName(own.select("a", "b").distinct())
    comp = store.table(components(same), "op5-components")

    def component(df, node, name):
        c = comp.select(F.col("node").alias(f"__{name}"), F.col("component").alias(f"__c{name}"))
        return df.join(c, F.col(node) == F.col(f"__{name}"), "left").withColumn(name, F.coalesce(f"__c{name}", node)).drop(f"__{name}", f"__c{name}")

    # buckets that still hold several components: members across them that have not met are compared
    told = store.table(component(component(met, "a", "ca"), "b", "cb"), "op5-told")
    store.drop(met)
    late = across(unmet(told), known, docs, plan, width)
    store.drop(told)
    if not late.isEmpty():
        before, comp = comp, store.table(components(same.unionByName(late)), "op5-components")
        store.drop(before)

    # of a class, of a row
    whole = component(classes.select("f1", "f2", "doc_id"), "doc_id", "component_id").drop("doc_id")
    narrow = rows.select("doc_id", F.col("n").alias("n_shingles"), "f1", "f2")
    named = whole.select(F.col("f1").alias("g1"), F.col("f2").alias("g2"), "component_id")
    out = narrow.join(named, (F.col("f1") == F.col("g1")) & (F.col("f2") == F.col("g2")) & F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links(store.read(spark, sf_dir, "documents"))


def brute_force(docs: list[tuple], width: int = WIDTH, num: int = NUM, den: int = DEN) -> list[tuple]:
    """Reference for tests: all pairs of all rows."""
    import re

    sets = []
    for _, text in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    parent = {d: d for d, _ in docs}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in enumerate(sets):
        for j in range(i):
            if s and sets[j] and den * len(s & sets[j]) >= num * len(s | sets[j]):
                a, b = root(docs[i][0]), root(docs[j][0])
                parent[max(a, b)] = min(a, b)
    return [(d, len(s), root(d)) for (d, _), s in zip(docs, sets, strict=True)]

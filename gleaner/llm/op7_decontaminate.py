"""Operator 7: benchmark decontamination by Wu-Manber multi-pattern search over words.

A text is lower-cased in A-Z and cut into words of ASCII letters, digits and all
non-ASCII characters.  A pattern is a window of ``window`` consecutive words of a
benchmark item; an item with fewer words, but not none, is one pattern.  Patterns
are grouped by length.  In each group a shift table over blocks of two words tells
how far the scan may jump when no pattern can end here; where the shift is zero,
the bucket of that suffix block holds the candidate patterns, and a comparison of
the words themselves confirms an occurrence.

Defined results.  Null or empty text, or text without words: no words, no hits.
Repeated documents give repeated rows; repeated items each count by their own
``item_id``.  A null ``item_id`` never enters the item list but its windows hit.
An empty benchmark leaves every document clean.  Columns besides ``doc_id`` and
``text`` are ignored by :func:`search`.

Scale.  The search has no shuffle: each task scans its own rows.  The pattern
tables are built per block of items with a bounded number of words
(``block_words``), and each block's tables are shipped with the pass over that
block, so what a task holds is bounded however large the benchmark is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store

WINDOW = 10
BLOCK_WORDS = 200_000

_SEPARATORS = bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
_TABLE = bytes(0x20 if (i in _SEPARATORS and not 0x41 <= i <= 0x5A) else (i + 32 if 0x41 <= i <= 0x5A else i) for i in range(256))


def words_of(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8 bytes."""
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split() if text else []


class WuManber:
    """Search tables for patterns (tuples of words) that all have ``length`` words."""

    def __init__(self, patterns: dict[tuple[bytes, ...], list[int]], length: int):
        self.length, self.block = length, min(2, length)
        self.default = length - self.block + 1
        self.shift: dict = {}
        self.bucket: dict = {}
        for pattern, ids in patterns.items():
            for end in range(self.block, length + 1):
                key = pattern[end - 1] if self.block == 1 else (pattern[end - 2], pattern[end - 1])
                jump = length - end
                if jump < self.shift.get(key, self.default):
                    self.shift[key] = jump
                if jump == 0:
                    self.bucket.setdefault(key, []).append((pattern, ids))

    def search(self, words: list[bytes]) -> Iterator[tuple[int, list[int]]]:
        """(start, ids) of every occurrence, by rising start."""
        length, shift, default, n = self.length, self.shift, self.default, len(words)
        end, one = length, self.block == 1
        while end <= n:
            key = words[end - 1] if one else (words[end - 2], words[end - 1])
            jump = shift.get(key, default)
            if jump:
                end += jump
                continue
            found = tuple(words[end - length : end])
            for pattern, ids in self.bucket[key]:
                if pattern == found:
                    yield end - length, ids
                    break
            end += 1


def build(items: list[tuple[int | None, str | None]], window: int = WINDOW) -> list[WuManber]:
    """One automaton for each pattern length that occurs in ``items``."""
    by: dict[int, dict[tuple[bytes, ...], list]] = {}
    for item, text in items:
        ws = words_of(text)
        n = min(window, len(ws))
        for i in range(len(ws) - n + 1 if n else 0):
            ids = by.setdefault(n, {}).setdefault(tuple(ws[i : i + n]), [])
            if item is not None and item not in ids:
                ids.append(item)
    return [WuManber(p, n) for n, p in sorted(by.items())]


def hits(words: list[bytes], tables: list[WuManber]) -> tuple[list[tuple[int, int]], set[int]]:
    """Merged word intervals [start, end) inside occurrences, and the items that occur."""
    spans: list[tuple[int, int]] = []
    items: set[int] = set()
    for t in tables:
        for start, ids in t.search(words):
            spans.append((start, start + t.length))
            items.update(ids)
    merged: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if merged and a <= merged[-1][1]:
            if b > merged[-1][1]:
                merged[-1] = (merged[-1][0], b)
        else:
            merged.append((a, b))
    return merged, items


def _blocks(bench: DataFrame, block_words: int) -> Iterator[list[tuple[int, str]]]:
    """Items in blocks of at most ``block_words`` words (one item at least), streamed through the driver."""
    block, size = [], 0
    for r in bench.toLocalIterator():
        n = len(words_of(r[1]))
        if block and size + n > block_words:
            yield block
            block, size = [], 0
        block.append((r[0], r[1]))
        size += n
    yield block


OUT = "n_words long, spans array<struct<start:int,end:int>>, items array<long>"


def search(docs: DataFrame, bench: DataFrame, *, window: int = WINDOW, block_words: int = BLOCK_WORDS, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns of every document with its word count, merged hit spans and occurring items.

    With more than one block of items, each document gets one row per block, marked
    by ``block``; :func:`report` puts them together.
    """
    keep = keep or ["doc_id"]
    rows = docs.select(*[f"`{k}`" for k in keep], F.col("text").alias("__text"))
    kept = docs.select(*[f"`{k}`" for k in keep]).schema
    out = store.schema(OUT)
    for f in out:
        kept = kept.add(f.name, f.dataType)

    def one(block):
        tables = docs.sparkSession.sparkContext.broadcast(block)  # at most block_words words of item text

        def run(batches):
            found = build(tables.value, window)
            for batch in batches:
                n, spans, items = [], [], []
                for text in batch.column("__text").to_pylist():
                    ws = words_of(text)
                    s, i = hits(ws, found) if ws and found else ([], set())
                    n.append(len(ws))
                    spans.append([{"start": a, "end": b} for a, b in s])
                    items.append(sorted(i))
                cols = [batch.column(k) for k in keep] + [
                    pa.array(n, pa.int64()),
                    pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                    pa.array(items, pa.list_(pa.int64())),
                ]
                yield pa.RecordBatch.from_arrays(cols, names=kept.names)

        return rows.mapInArrow(run, kept)

    passes = [one(b) for b in _blocks(bench.select("item_id", "text"), block_words)]
    whole = passes[0].withColumn("block", F.lit(0))
    for k, p in enumerate(passes[1:], 1):
        whole = whole.unionByName(p.withColumn("block", F.lit(k)))
    whole._gleaner_blocks = len(passes)
    return whole


def _union_length(spans):
    """Words inside merged spans of one document."""
    return F.aggregate(spans, F.lit(0).cast("long"), lambda a, s: a + (s["end"] - s["start"]).cast("long"))


def report(found: DataFrame) -> DataFrame:
    """The contract's columns from :func:`search`."""
    blocks = found._gleaner_blocks
    if blocks > 1:
        # __row tells two documents with one doc_id apart
        found = (
            found.groupBy("doc_id", "__row")
            .agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
            .withColumn("covered", F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["end"] - 1)))))
            .withColumn("n_hit", F.size("covered").cast("long"))
        )
    else:
        found = found.withColumn("n_hit", _union_length(F.col("spans")))
    ids = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, bench: DataFrame, *, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every row of ``docs``."""
    keep = ["doc_id"]
    chars = bench.agg(F.sum(F.length("text"))).first()[0] or 0
    if chars > block_words:  # perhaps several blocks: rows need a name that outlives the passes
        docs = store.table(docs.select("doc_id", "text", F.monotonically_increasing_id().alias("__row")), "op7-rows")
        keep = ["doc_id", "__row"]
    return report(search(docs, bench, window=window, block_words=block_words, keep=keep))


def clean(docs: DataFrame, bench: DataFrame, *, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of ``docs`` in which no window of the benchmark occurs, with their columns.

    Every block of items is one pass over what the blocks before it have left.
    """
    names = docs.columns
    schema = docs.schema
    text = names.index("text")

    def one(left, block):
        tables = left.sparkSession.sparkContext.broadcast(block)  # at most block_words words of item text

        def run(batches):
            found = build(tables.value, window)
            for batch in batches:
                keep = [next((False for t in found for _ in t.search(ws)), True) if (ws := words_of(x)) else True for x in batch.column(text).to_pylist()]
                yield batch.filter(pa.array(keep, pa.bool_()))

        return left.mapInArrow(run, schema)

    for block in _blocks(bench.select("item_id", "text"), block_words):
        docs = one(docs, block)
    return docs


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(store.read(spark, sf_dir, "documents"), store.read(spark, sf_dir, "benchmark"))


def brute_force(docs: list[tuple], items: list[tuple], window: int = WINDOW) -> list[tuple]:
    """Reference for tests: compare every window at every position."""
    pats = []
    for item, text in items:
        ws = words_of(text)
        n = min(window, len(ws))
        pats += [(item, ws[i : i + n]) for i in range(len(ws) - n + 1 if n else 0)]
    out = []
    for doc, text in docs:
        ws, hit, found = words_of(text), set(), set()
        for item, p in pats:
            for i in range(len(ws) - len(p) + 1):
                if ws[i : i + len(p)] == p:
                    hit.update(range(i, i + len(p)))
                    found.add(item)
        found.discard(None)
        ids = ",".join(sorted(map(str, found)))
        out.append((doc, len(ws), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)))
    return out

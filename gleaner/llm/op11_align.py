r"""Operator 11: tokens of two tokenizers aligned by elementary intervals.

Space + text is cut by a byte-level BPE (A), the text by a sentence-piece BPE that adds the
space itself (B).  Both cut the same bytes.  The ends of both, joined by ``union1d``, bound
elementary intervals; ``searchsorted`` names the A and the B token that own an interval, and
every interval is one overlap, since two ranges overlap in one piece.  An end that both share
closes a group.

Neither tokenizer joins anything over a single space between two other characters that are not
white space: A cuts before it, and no piece of B has a space behind another character (the
vocabulary is checked).  So a text is cut at such spaces into stretches, the distinct
stretches of a block of documents are encoded and aligned once, and a document is the
sequence of its stretches.

Counts.  How many documents hold a pair of ids linked is summed in three steps: distinct pairs
of a document, documents of a block, blocks.  The totals go back to the blocks by a join on
the pair, of which every block has one row, so no pair is hot beyond the number of blocks,
and nothing is broadcast.  A task holds one block of about ``BLOCK_BYTES`` of text, or one
longer document.

Defined results.  Null and empty texts, and texts whose A or B bytes differ from space + text
(those with U+2581), have no tokens: zeros and an empty digest; their pairs count nowhere.
Repeated rows are documents of their own.  A null doc_id stays null.  An empty table gives no
rows.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import store
from .op4_bpe import byte_letters, vocabulary_path

A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Bytes of text in a block, and in what is cut at once.
BLOCK_BYTES, SLICE_BYTES = 8 << 20, 1 << 20
#: Stretches and characters of stretches that a worker keeps from one block to the next.
KEEP, KEEP_CHARS = 600_000, 8 << 20
#: Characters that are encoded in one call.
CALL_CHARS = 1 << 14
_CUT = re.compile(r"(?<=\S) (?=\S)")
_EDGE = re.compile(r"^\s|\s$")
MARK = "▁"


class Tokenizers:
    """Both tokenizers and the bytes of their tokens."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        byte = {c: bytes([i]) for i, c in enumerate(byte_letters())}
        inverse = {i: t for t, i in self.a.get_vocab(with_added_tokens=True).items()}
        self.a_bytes = [b"".join(byte.get(c, c.encode()) for c in inverse.get(i, "")) for i in range(max(inverse) + 1)]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("a piece holds a space behind another character")
        self.a_size, self.b_size = (np.array([len(x) for x in v], np.int64) for v in (self.a_bytes, self.b_bytes))
        self.a_name, self.b_name = [str(i) for i in range(len(self.a_bytes))], [str(i) for i in range(len(self.b_bytes))]

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of A and B; None where their bytes are not those of space + text."""
        whole = b" " + text.encode()
        a, b = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        if b"".join([self.a_bytes[i] for i in a]) != whole or b"".join([self.b_bytes[i] for i in b]) != whole:
            return None
        return np.array(a, np.int64), np.array(b, np.int64)


def aligned(t: Tokenizers, a: np.ndarray, b: np.ndarray) -> tuple:
    """(ends of A, ends of B, shared ends, all ends, links): a link is id of A * 2^32 + id of B, one for every interval."""
    ea, eb = np.cumsum(t.a_size[a]), np.cumsum(t.b_size[b])
    ends = np.union1d(ea, eb)
    x, y = np.searchsorted(ea, ends), np.searchsorted(eb, ends)
    shared = ends[(ea[x] == ends) & (eb[y] == ends)]
    return ea, eb, shared, ends, a[x] << 32 | b[y]


class Stretches:
    """What is known of stretches: numbers of tokens, groups and links, groups as text, and the links."""

    def __init__(self, t: Tokenizers):
        self.t = t
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.chars = 0
        self.groups: list[str | None] = []  # None: its bytes differ
        self.sizes: list[np.ndarray] = []  # n_a, n_b, n_groups, n_links, n_products, first link
        self.links: list[np.ndarray] = []
        self.n_links = 0

    def add(self, new: list[str]) -> None:
        """Learn stretches that are not known yet."""
        plain, calls, size = [], [], 0
        for s in new:
            if _EDGE.search(s) or not s:
                calls.append([s])
                continue
            plain.append(s)
            size += len(s) + 1
            if size > CALL_CHARS:
                calls.append(plain)
                plain, size = [], 0
        for call in [*calls, *([plain] if plain else [])]:
            if not self._learn(call):
                for s in call:
                    if not self._learn([s]):
                        self._put(s, None, (0, 0, 0, 0, 0, self.n_links))

    def _put(self, s: str, groups: str | None, sizes: tuple) -> None:
        self.at[s] = len(self.groups)
        self.chars += len(s)
        self.groups.append(groups)
        self.sizes.append(np.array([sizes], np.int64))

    def _learn(self, call: list[str]) -> bool:
        """Encode stretches with single spaces between them; False if the bytes of any differ."""
        ids = self.t.encode(" ".join(call))
        if ids is None:
            return False
        a, b = ids
        ea, eb, shared, ends, links = aligned(self.t, a, b)
        cuts = np.cumsum([len(s.encode()) + 1 for s in call])
        last = np.searchsorted(shared, cuts)
        if not np.array_equal(shared[np.minimum(last, len(shared) - 1)], cuts):
            if len(call) == 1:
                raise ValueError("the tokens of a text do not end together")
            return False
        ga, gb = np.searchsorted(ea, shared, "right"), np.searchsorted(eb, shared, "right")
        an, bn = [self.t.a_name[i] for i in a.tolist()], [self.t.b_name[i] for i in b.tolist()]
        names, i, k = [], 0, 0
        for j, m in zip(ga.tolist(), gb.tolist(), strict=True):
            names.append(f"{an[i]}|{bn[k]}" if j == i + 1 and m == k + 1 else f"{','.join(an[i:j])}|{','.join(bn[k:m])}")
            i, k = j, m
        products = np.concatenate(([0], np.cumsum(np.diff(ga, prepend=0) * np.diff(gb, prepend=0))))
        g = np.concatenate(([0], last + 1))
        a_at, b_at = np.concatenate(([0], ga))[g], np.concatenate(([0], gb))[g]
        l_at = np.concatenate(([0], np.searchsorted(ends, cuts, "right")))
        rows = np.stack([np.diff(a_at), np.diff(b_at), np.diff(g), np.diff(l_at), np.diff(products[g]), l_at[:-1] + self.n_links], axis=1)
        first = g.tolist()
        self.at.update(zip(call, range(len(self.groups), len(self.groups) + len(call)), strict=True))
        self.chars += sum(map(len, call))
        self.groups += [";".join(names[i:j]) for i, j in zip(first[:-1], first[1:], strict=True)]
        self.sizes.append(rows)
        self.links.append(links)
        self.n_links += len(links)
        return True

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """(sizes, links) as arrays."""
        self.links = [np.concatenate(self.links)] if self.links else [np.empty(0, np.int64)]
        self.sizes = [np.concatenate(self.sizes)] if self.sizes else [np.empty((0, 6), np.int64)]
        return self.sizes[0], self.links[0]


def expand(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions starts[i] .. starts[i] + sizes[i] - 1 of all i."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


def int_lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    ends = np.concatenate(([0], np.cumsum([len(p) for p in parts], dtype=np.int64))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*parts, np.empty(0, np.int64)]), kind))


#: Columns of what a block writes: rows of documents, then one row of the block itself (n_a null).
_COUNTS = ("n_a", "n_b", "n_groups", "n_links", "n_products")
_LISTS = {"words": pa.int32(), "times": pa.int32(), "pairs": pa.int64(), "df": pa.int32(), "sizes": pa.int32(), "links": pa.int32()}


class Block:
    """Documents whose distinct stretches are put down together."""

    def __init__(self, number: int):
        self.number, self.bytes = number, 0
        self.ids: list = []
        self.found: list[tuple[np.ndarray, np.ndarray]] = []  # stretches of a document and how often it has each
        self.digests: list[str] = []

    def add(self, doc_id, pieces: list[str] | None, known: Stretches) -> None:
        self.ids.append(doc_id)
        seq = list(map(known.at.__getitem__, pieces or []))
        groups = [known.groups[i] for i in seq]
        if not seq or None in groups:
            seq, groups = [], None
        self.found.append(np.unique(np.array(seq, np.int64), return_counts=True))
        self.digests.append(hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "")

    def rows(self, known: Stretches, names: list[str], id_type: pa.DataType):
        sizes, links = known.table()
        per_doc = np.array([len(u) for u, _ in self.found], np.int64)
        u, c = (np.concatenate([f[k] for f in self.found]) for k in (0, 1))
        own, local = np.unique(u, return_inverse=True)
        doc = np.repeat(np.arange(len(per_doc)), per_doc)
        counts = [np.bincount(doc, weights=sizes[u, k] * c, minlength=len(per_doc)).astype(np.int64) for k in range(5)]
        flat = links[expand(sizes[own, 5], sizes[own, 3])]
        pairs, flat = np.unique(flat, return_inverse=True)
        first = np.concatenate(([0], np.cumsum(sizes[own, 3])))
        df = np.zeros(len(pairs), np.int64)
        at = np.concatenate(([0], np.cumsum(per_doc)))
        lo = 0
        while lo < len(per_doc):  # distinct pairs of documents, some documents at once
            hi = max(lo + 1, int(np.searchsorted(at, at[lo] + 50_000, "right")) - 1)
            w = local[at[lo] : at[hi]]
            n = sizes[own[w], 3]
            held = np.unique(np.repeat(doc[at[lo] : at[hi]], n) * len(pairs) + flat[expand(first[w], n)]) if len(w) else np.empty(0, np.int64)
            df += np.bincount(held % max(len(pairs), 1), minlength=len(pairs))
            lo = hi
        n, empty = len(per_doc), np.empty(0, np.int64)
        split = np.split(local, at[1:-1])
        values = {"words": [*split, empty], "times": [*[f[1] for f in self.found], empty], "pairs": [*[empty] * n, pairs], "df": [*[empty] * n, df], "sizes": [*[empty] * n, sizes[own, 3]], "links": [*[empty] * n, flat]}
        columns = [pa.array([self.number] * (n + 1), pa.int64()), pa.array([*self.ids, None], id_type), *[pa.array([*x.tolist(), None], pa.int64()) for x in counts], pa.array([*self.digests, None], pa.string()), *[int_lists(values[k], kind) for k, kind in _LISTS.items()]]
        whole = pa.RecordBatch.from_arrays(columns, names=names)
        for k in range(0, n + 1, 2000):
            yield whole.slice(k, 2000)


_OPEN: dict[tuple[str, str], Stretches] = {}


def blocks(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Rows of documents and of blocks: block, doc_id, counts, groups_sha256, lists."""
    schema = T.StructType([T.StructField("block", T.LongType()), *docs.select("doc_id").schema, *[T.StructField(c, T.LongType()) for c in _COUNTS], T.StructField("groups_sha256", T.StringType())])
    for k, kind in _LISTS.items():
        schema = schema.add(k, T.ArrayType(T.LongType() if kind == pa.int64() else T.IntegerType()))

    def run(batches):
        if (a_path, b_path) not in _OPEN:
            _OPEN[a_path, b_path] = Stretches(Tokenizers(a_path, b_path))
        known, part, made, block = _OPEN[a_path, b_path], TaskContext.get().partitionId(), 0, None
        for batch in batches:
            size = pc.binary_length(pc.fill_null(batch.column("text"), "")).to_numpy(zero_copy_only=False)
            lo = 0
            while lo < len(batch):
                hi = lo + 1
                held = int(size[lo])
                while hi < len(batch) and held + size[hi] <= SLICE_BYTES:
                    held += int(size[hi])
                    hi += 1
                rows = batch.slice(lo, hi - lo)
                pieces = [_CUT.split(x) if x else None for x in rows.column("text").to_pylist()]
                known.add(list({p: None for ps in pieces if ps for p in ps if p not in known.at}))
                block = block or Block(part << 32 | made)
                for i, ps in zip(rows.column("doc_id").to_pylist(), pieces, strict=True):
                    block.add(i, ps, known)
                block.bytes += held
                if block.bytes >= BLOCK_BYTES:
                    yield from block.rows(known, schema.names, rows.schema.field("doc_id").type)
                    made, block = made + 1, None
                    if len(known.at) > KEEP or known.chars > KEEP_CHARS:
                        known.clear()
                lo = hi
            id_type = batch.schema.field("doc_id").type
        if block is not None:
            yield from block.rows(known, schema.names, id_type)
        if len(known.at) > KEEP or known.chars > KEEP_CHARS:
            known.clear()
        store.trim()

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def pair_counts(found: DataFrame) -> DataFrame:
    """pair, n (documents that hold it linked), best (no pair of its A id has more) from :func:`blocks`."""
    held = found.filter("n_a is null").select(F.explode(F.arrays_zip("pairs", "df")).alias("x")).select("x.pairs", "x.df")
    counts = held.groupBy(F.col("pairs").alias("pair")).agg(F.sum("df").alias("n")).withColumn("a", F.shiftright("pair", 32))
    most = counts.groupBy("a").agg(F.max("n").alias("most"))
    return counts.join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def align(docs: DataFrame, *, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, n_products (pairs of ids in one group) of every row."""
    found = store.table(blocks(docs, a_path or vocabulary_path(A_FILE), b_path or vocabulary_path(B_FILE)), "op11-blocks")
    totals = store.table(pair_counts(found), "op11-pairs")
    back = found.filter("n_a is null").select("block", F.posexplode("pairs").alias("pos", "pair")).join(totals, "pair").select(F.col("block").alias("of_block"), "pos", "n", "best")
    schema = T.StructType([*docs.select("doc_id").schema, *[T.StructField(c, T.LongType()) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")], T.StructField("groups_sha256", T.StringType()), T.StructField("n_products", T.LongType())])

    def totals_of(rows: pa.Table, values: pa.Table) -> pa.Table:
        own = pc.is_null(rows["n_a"])
        head, rows = rows.filter(own), rows.filter(pc.invert(own))
        order = np.argsort(values["pos"].to_numpy())
        words, times = (rows[c].combine_chunks() for c in ("words", "times"))
        doc = np.repeat(np.arange(len(rows)), pc.list_value_length(words).to_numpy(zero_copy_only=False))
        out = []
        for c in ("best", "n"):
            value = values[c].to_numpy().astype(np.int64)[order]
            sizes, links = (np.array(head[k][0].values.to_numpy(), np.int64) for k in ("sizes", "links"))
            by_word = np.concatenate(([0], np.cumsum(value[links])))[np.concatenate(([0], np.cumsum(sizes)))]
            per_word = np.diff(by_word)[words.flatten().to_numpy()]
            total = np.zeros(len(rows), np.int64)
            np.add.at(total, doc, per_word * times.flatten().to_numpy())
            out.append(pa.array(total))
        return pa.table([*[rows[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")], *out, rows["groups_sha256"], rows["n_products"]], names=schema.names)

    rows = found.drop("pairs", "df")
    return rows.groupBy("block").cogroup(back.groupBy("of_block")).applyInArrow(totals_of, schema)


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(store.read(spark, sf_dir, "documents"))


def brute_force(docs: list[tuple], a_path: str | None = None, b_path: str | None = None) -> list[tuple]:
    """Reference for tests: whole texts, every pair of tokens compared; (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)."""
    from collections import Counter

    t = Tokenizers(a_path or vocabulary_path(A_FILE), b_path or vocabulary_path(B_FILE))
    seen, held = [], Counter()
    for _, text in docs:
        ids = t.encode(text) if text else None
        links, groups = [], []
        if ids:
            spans = []
            for found, size in ((ids[0].tolist(), t.a_size), (ids[1].tolist(), t.b_size)):
                at, out = 0, []
                for i in found:
                    out.append((at, at + int(size[i]), i))
                    at += int(size[i])
                spans.append(out)
            links = [(a[2], b[2]) for a in spans[0] for b in spans[1] if a[0] < b[1] and b[0] < a[1]]
            left = right = 0
            for end in sorted({a[1] for a in spans[0]} & {b[1] for b in spans[1]}):
                i, j = sum(a[1] <= end for a in spans[0]), sum(b[1] <= end for b in spans[1])
                groups.append(",".join(str(a[2]) for a in spans[0][left:i]) + "|" + ",".join(str(b[2]) for b in spans[1][right:j]))
                left, right = i, j
        held.update(set(links))
        seen.append((ids, links, groups))
    most = Counter()
    for (a, _), n in held.items():
        most[a] = max(most[a], n)
    out = []
    for (i, _), (ids, links, groups) in zip(docs, seen, strict=True):
        sha = hashlib.sha256(";".join(groups).encode()).hexdigest() if ids else ""
        out.append((i, len(ids[0]) if ids else 0, len(ids[1]) if ids else 0, len(groups), len(links), sum(held[x] == most[x[0]] for x in links), sum(held[x] for x in links), sha))
    return out

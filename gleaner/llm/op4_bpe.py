r"""Operator 4: BPE encoding and decoding with a transducer lexicon.

Texts become what the vocabulary file prescribes: special tokens are cut out, the
rest is NFC-normalized, lower-cased character by character, cut into pre-tokens and
each pre-token's UTF-8 bytes are merged by rank, the last symbol carrying the
end-of-word mark.

Frequent pre-tokens, counted over all documents, are compiled with their ids into a
minimal acyclic automaton: words that end alike share their states.  Every arc carries
the number of words that sort before it, so the sum along a word's path is its number
in the table of ids; the automaton is a transducer from words to ids.  It is one flat
file in the shared store, memory-mapped by every worker.  Pre-tokens outside it are
merged exactly.

Defined results.  Null or empty text: no tokens, empty decoded text.  Repeated rows are
each returned; nothing is shuffled by document.  Extra columns are ignored.  An empty
table gives an empty lexicon.  The lexicon affects time only, never ids.

Bounds.  The driver holds the ``LEXICON_WORDS`` most frequent pre-tokens and the
vocabulary, both of constant size.  A word longer than ``LEXICON_BYTES`` bytes is never
put in the lexicon.  Workers keep at most ``CACHE_WORDS`` recent words, and hold the ids of
at most ``SLICE`` bytes of text at once: a longer text is cut at white space and digested
piece by piece.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import mmap
import struct
import sys
import unicodedata
from array import array
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import store

LEXICON_WORDS = 60_000
LEXICON_BYTES = 64
CACHE_WORDS = 400_000
#: Longest words, in bytes, of the groups that are merged together; longer ones are merged one by one.
MERGED_TOGETHER, MERGED_ROWS = (6, 9, 12, 18, 30), 8_000
#: Bytes of text that are encoded at once.
SLICE = 2 << 20

#: White space as Unicode's White_Space property has it.
_SPACE = r"\t-\r \x85\xa0  -     　"
#: Fixed by the vocabulary file's pre-tokenizer.
PRETOKEN = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{_SPACE}\p{{L}}\p{{N}}]+")
_LINES = regex.compile("\n|" + PRETOKEN.pattern)
END = "</w>"
_GAP = regex.compile("[\\x09-\\x0D\\x20]")


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself where printable, else the next from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


class Vocabulary:
    """Tokens, merge ranks and special tokens of a vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        vocab = whole["model"]["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in whole["model"]["merges"]]
        self.special = {t["content"]: t["id"] for t in whole["added_tokens"]}
        self.tokens = [""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for t, i in [*vocab.items(), *self.special.items()]:
            self.tokens[i] = t
        #: (left id, right id) -> (rank, merged id)
        self.merge = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(merges)}
        letters = byte_letters()
        self.byte = [vocab[c] for c in letters]
        self.last = [vocab[c + END] for c in letters]
        #: the same merges as arrays: sorted pairs left id * 2^32 + right id, the rank of each, and ids made by rank
        table = np.array([(a << 32 | b, rank) for (a, b), (rank, _) in self.merge.items()], np.int64).reshape(-1, 2)
        self.pairs, ranks = table[np.argsort(table[:, 0])].T.copy()
        self.ranks, self.none = ranks.astype(np.int32), np.int32(len(merges))
        self.news = np.array([vocab[a + b] for a, b in merges], np.int32)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of the pairs (a, b); ``none`` where they do not merge."""
        key = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.ranks[at], self.none)


def merged(word: bytes, v: Vocabulary) -> list[int]:
    """Ids of one pre-token: the pair of least rank, leftmost first, is merged until none is left."""
    ids = [v.byte[b] for b in word]
    ids[-1] = v.last[word[-1]]
    n = len(ids)
    left, right, heap = list(range(-1, n - 1)), list(range(1, n + 1)), []

    def offer(i):
        j = right[i]
        if j < n and (m := v.merge.get((ids[i], ids[j]))):
            heapq.heappush(heap, (m[0], i, ids[i], ids[j], m[1]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, a, b, new = heapq.heappop(heap)
        j = right[i]
        if ids[i] != a or j >= n or ids[j] != b:
            continue
        ids[i], ids[j] = new, -1
        right[i] = right[j]
        if right[j] < n:
            left[right[j]] = i
        offer(i)
        if left[i] >= 0:
            offer(left[i])
    return [x for x in ids if x >= 0]


def merged_all(words: list[bytes], v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of many pre-tokens, one after another, and how many each has: words of like length are merged together."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    counts, found, low = np.zeros(len(words), np.int64), [], 0
    for high in MERGED_TOGETHER:
        group = np.flatnonzero((sizes > low) & (sizes <= high))
        for at in range(0, len(group), MERGED_ROWS):
            part = group[at : at + MERGED_ROWS]
            ids, n = _merge_rows([words[i] for i in part.tolist()], high, v)
            counts[part] = n
            found.append((part, n, ids[np.arange(high) < n[:, None]]))
        low = high
    for i in np.flatnonzero(sizes > low).tolist():
        ids = np.array(merged(words[i], v), np.int32)
        counts[i] = len(ids)
        found.append((np.array([i]), np.array([len(ids)]), ids))
    begin = np.cumsum(counts) - counts
    out = np.empty(int(counts.sum()), np.int32)
    for part, n, ids in found:
        out[np.repeat(begin[part] - (np.cumsum(n) - n), n) + np.arange(len(ids))] = ids
    return out, counts


def _merge_rows(words: list[bytes], width: int, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids (a row a word) and their numbers; every step merges in each row its pair of least rank, the leftmost of equals."""
    n = np.fromiter(map(len, words), np.int64, len(words))
    raw = np.frombuffer(b"".join([w.ljust(width, b"\0") for w in words]), np.uint8).reshape(-1, width)
    ids = np.array(v.byte, np.int32)[raw]
    rows = np.arange(len(words))
    ids[rows, n - 1] = np.array(v.last, np.int32)[raw[rows, n - 1]]
    rank = np.where(np.arange(width - 1) < (n - 1)[:, None], v.rank(ids[:, :-1], ids[:, 1:]), v.none)
    out, sizes = np.zeros_like(ids), n.copy()
    columns = np.arange(width)
    while len(rows):
        k = np.arange(len(rows))
        at = rank.argmin(axis=1)
        go = rank[k, at] < v.none
        if not go.all():
            out[rows[~go]], sizes[rows[~go]] = ids[~go], n[~go]
            rows, ids, rank, n, at = rows[go], ids[go], rank[go], n[go], at[go]
            k = k[: len(rows)]
            if not len(rows):
                break
        new = v.news[rank[k, at]]
        # what stands right of the pair moves one place left
        after = columns[:-1] + (columns[:-1] > at[:, None])
        ids[:, :-1] = np.take_along_axis(ids, after, 1)
        ids[k, at] = new
        rank[:, :-1] = np.take_along_axis(rank, after[:, :-1], 1)
        rank[:, -1] = v.none
        n = n - 1
        left, right = np.flatnonzero(at > 0), np.flatnonzero(at < n - 1)  # the new token's pairs
        rank[left, at[left] - 1] = v.rank(ids[left, at[left] - 1], new[left])
        inside = at < width - 1
        rank[k[inside], at[inside]] = v.none
        rank[right, at[right]] = v.rank(new[right], ids[right, at[right] + 1])
    return out, sizes


def compile_lexicon(words: dict[bytes, list[int]]) -> bytes:
    """The minimal acyclic transducer of ``words`` as one flat file.

    Layout, little-endian 32-bit words: number of nodes, arcs, words and ids; per node
    its first arc (and one end); per node 1 if a word ends there; per arc its label,
    target and the number of words before it; per word its first id (and one end); ids.
    """
    known: dict[tuple, int] = {}
    finals, arcs_of, counts = [], [], []

    def freeze(node) -> int:
        signature = (node[0], tuple(node[1]))
        if signature not in known:
            known[signature] = len(finals)
            finals.append(node[0])
            arcs_of.append(tuple(node[1]))
            counts.append(node[0] + sum(counts[t] for _, t in node[1]))
        return known[signature]

    # words come sorted, so all but the last path is final and can be shared at once
    ordered = sorted(words)
    path = [[0, []]]
    before = b""
    for w in [*ordered, b""]:
        same = 0
        while same < min(len(w), len(before)) and w[same] == before[same]:
            same += 1
        while len(path) > same + 1:
            node = path.pop()
            path[-1][1].append((before[len(path) - 1], freeze(node)))
        for _ in w[same:]:
            path.append([0, []])
        if w:
            path[-1][0] = 1
        before = w
    root = freeze(path[0])
    first, label, target, skipped = [0], [], [], []
    for node, arcs in enumerate(arcs_of):
        seen = finals[node]
        for c, t in arcs:
            label.append(c)
            target.append(t)
            skipped.append(seen)
            seen += counts[t]
        first.append(len(label))
    at, ids = [0], []
    for w in ordered:
        ids += words[w]
        at.append(len(ids))
    head = [len(finals), len(label), len(ordered), len(ids), root]
    return struct.pack(f"<{5 + len(first) + len(finals) + 3 * len(label) + len(at) + len(ids)}I", *head, *first, *finals, *label, *target, *skipped, *at, *ids)


class Lexicon:
    """A compiled lexicon in a memory map."""

    def __init__(self, buffer):
        view = np.frombuffer(buffer, "<u4")
        nodes, arcs, words, ids, root = view[:5].tolist()
        parts, p = [], 5
        for n in (nodes + 1, nodes, arcs, arcs, arcs, words + 1, ids):
            parts.append(view[p : p + n])
            p += n
        first, self.final, label, self.target, self.skipped, self.at, self.ids = parts
        self.root, self.buffer = root, buffer
        #: arcs in order of (node, label), as they lie in the file
        self.arcs = np.repeat(np.arange(nodes, dtype=np.int64), np.diff(first.astype(np.int64))) << 8 | label

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """Each word's number in the table of ids, -1 for words outside: all words walk the automaton together, a byte a step."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        out = np.full(len(words), -1)
        if not len(self.arcs):
            return out
        data = np.frombuffer(b"".join(words), np.uint8)
        begin = np.cumsum(sizes) - sizes
        alive = np.flatnonzero((sizes > 0) & (sizes <= LEXICON_BYTES))
        node, number = np.full(len(alive), self.root, np.int64), np.zeros(len(alive), np.int64)
        step = 0
        while len(alive):
            key = node << 8 | data[begin[alive] + step]
            arc = np.minimum(np.searchsorted(self.arcs, key), len(self.arcs) - 1)
            ok = self.arcs[arc] == key
            alive, arc, number = alive[ok], arc[ok], number[ok]
            number = number + self.skipped[arc]
            node = self.target[arc].astype(np.int64)
            step += 1
            ended = sizes[alive] == step
            there = ended & (self.final[node] == 1)
            out[alive[there]] = number[there]
            alive, node, number = alive[~ended], node[~ended], number[~ended]
        return out

    def get(self, word: bytes) -> list[int] | None:
        i = self.numbers([word])[0]
        return self.ids[self.at[i] : self.at[i + 1]].tolist() if i >= 0 else None

    @classmethod
    def open(cls, uri: str) -> Lexicon:
        fs, path = store.open_fs(uri)
        if fs.type_name == "local":
            with open(path, "rb") as f:
                return cls(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))
        with fs.open_input_stream(path) as f:  # a remote store has no pages to map: one copy in anonymous ones
            data = f.read()
        own = mmap.mmap(-1, len(data))
        own[:] = data
        return cls(own)


def pretokens(text: str, pattern=PRETOKEN) -> list[str]:
    """Pre-tokens of a text without special tokens."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)
    # a capital sigma has no final form here: characters are lowered one by one
    text = text.lower() if "Σ" not in text else "".join(c.lower() for c in text)
    return pattern.findall(text)


def stretches(column: pa.Array, most: int = SLICE):
    """(row numbers, texts) of runs of rows of at most ``most`` bytes; a longer text comes alone, cut at white space into several."""
    col = pc.fill_null(column, "")
    sizes = pc.binary_length(col).to_numpy(zero_copy_only=False)
    at = 0
    while at < len(col):
        if sizes[at] > most:
            text, lo = col[at].as_py(), 0
            while lo < len(text):
                cut = _GAP.search(text, lo + most // 4)
                hi = cut.start() if cut else len(text)
                yield np.array([at]), pa.array([text[lo:hi]], pa.string())
                lo = hi
            at += 1
            continue
        to, held = at, 0
        while to < len(col) and sizes[to] <= most and held + sizes[to] <= most:
            held += sizes[to]
            to += 1
        yield np.arange(at, to), col.slice(at, to - at)
        at = to


class Codec:
    """Encoder and decoder of one worker: whole Arrow arrays at a time, the rare words one by one."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon | None = None):
        self.v, self.lexicon, self.cache = vocabulary, lexicon, {}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, vocabulary.special)) + ")") if vocabulary.special else None
        self.tokens = pa.array(vocabulary.tokens, pa.large_string())

    def words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pre-tokens, one after another, and how many each has: by the lexicon, the unseen by merges."""
        number = self.lexicon.numbers(words) if self.lexicon else np.full(len(words), -1)
        unseen, known = np.flatnonzero(number < 0), np.flatnonzero(number >= 0)
        rare, counts = merged_all([words[i] for i in unseen.tolist()], self.v)
        sizes = np.zeros(len(words), np.int64)
        sizes[unseen] = counts
        if len(known):
            at = self.lexicon.at.astype(np.int64)
            sizes[known] = at[number[known] + 1] - at[number[known]]
        begin = np.cumsum(sizes) - sizes
        ids = np.empty(int(sizes.sum()), np.uint32)
        ids[np.repeat(begin[unseen] - (np.cumsum(counts) - counts), counts) + np.arange(len(rare))] = rare
        if len(known):
            k = sizes[known]
            step = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
            ids[np.repeat(begin[known], k) + step] = self.lexicon.ids[np.repeat(at[number[known]], k) + step]
        return ids, sizes

    def resolve(self, chunks: list[str]) -> list[bytes]:
        """Packed ids of stretches without white space at their ends."""
        if not self.cut or not any("<|" in c for c in chunks):
            return self._resolve(chunks)
        parts = [self.cut.split(c) if "<|" in c else [c] for c in chunks]
        plain = iter(self._resolve([x for p in parts for x in p[::2]]))
        packed = {w: array("I", [i]).tobytes() for w, i in self.v.special.items()}
        return [b"".join(packed[x] if k % 2 else next(plain) for k, x in enumerate(p)) if len(p) > 1 else next(plain) for p in parts]

    def _resolve(self, chunks: list[str]) -> list[bytes]:
        """As :func:`resolve`, of stretches without special tokens."""
        index: dict[str, int] = {"\n": 0}
        which = np.array([index.setdefault(w, len(index)) for w in pretokens("\n".join(chunks) + "\n", _LINES)])
        raw = [w.encode() for w in index]
        raw[0] = b""
        ids, sizes = self.words(raw)
        counts = sizes[which]
        first = (np.cumsum(sizes) - sizes)[which]
        ends = np.cumsum(counts)
        packed = ids[np.repeat(first - (ends - counts), counts) + np.arange(ends[-1])].tobytes()
        stops = [0, *(4 * ends[which == 0]).tolist()]
        return [packed[a:b] for a, b in zip(stops[:-1], stops[1:], strict=True)]

    def encode_batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of ``texts``, and where each text's ids begin (with the end).

        No pre-token, no special token and no normalization reaches across white space, so
        texts are cut there, and each distinct stretch is encoded once.
        """
        lists = pc.ascii_split_whitespace(texts)
        coded = lists.flatten().dictionary_encode()
        which = coded.indices.to_numpy(zero_copy_only=False)
        cache = self.cache
        distinct = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(coded.dictionary)], pa.int32()), coded.dictionary), "\n")[0].as_py().split("\n") if len(coded.dictionary) else []
        parts = list(map(cache.get, distinct))
        if missing := [i for i, p in enumerate(parts) if p is None]:
            if len(cache) > CACHE_WORDS:
                cache.clear()
            for i, p in zip(missing, self.resolve([distinct[i] for i in missing]), strict=True):
                parts[i] = p
                if len(distinct[i]) <= LEXICON_BYTES:
                    cache[distinct[i]] = p
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        flat = np.frombuffer(b"".join(parts), np.uint32)
        counts = sizes[which]
        ends = np.concatenate(([0], np.cumsum(counts)))
        first = (np.cumsum(sizes) - sizes)[which]
        ids = flat[np.repeat(first - ends[:-1], counts) + np.arange(ends[-1])]
        offsets = lists.offsets.to_numpy(zero_copy_only=False)
        return ids, ends[offsets - offsets[0]]

    def decode_batch(self, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
        """Decoded texts: tokens joined by spaces, for the vocabulary file names no decoder."""
        tokens = self.tokens.take(pa.array(ids.astype(np.int64)))
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), tokens), pa.scalar(" ", pa.large_string()))

    def encode(self, text: str | None) -> array:
        """Token ids of one text."""
        ids = array("I")
        for _, part in stretches(pa.array([text], pa.string())):
            ids.frombytes(self.encode_batch(part)[0].tobytes())
        return ids

    def decode(self, ids) -> str:
        return " ".join([self.v.tokens[i] for i in ids])


def _payloads(texts: pa.Array):
    """Bytes of every value of a large string array, without copies."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1].tolist()
    data = memoryview(texts.buffers()[2] or b"")
    return (data[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True))


def frequent(docs: DataFrame, most: int = LEXICON_WORDS) -> list[str]:
    """The most frequent pre-tokens of all documents: all above the least count that leaves at most ``most``.

    The threshold comes from a histogram of counts, so no task and no step sends the driver more than the words chosen.
    """

    def flush(seen: Counter) -> pa.RecordBatch:
        words: Counter = Counter()
        for chunk, n in seen.items():
            for w in pretokens(chunk):
                if len(w) <= LEXICON_BYTES // 4:
                    words[w] += n
        return pa.RecordBatch.from_arrays([pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())], names=["w", "n"])

    def run(batches):
        seen: Counter = Counter()
        for batch in batches:
            for _, texts in stretches(batch.column(0)):
                found = pc.value_counts(pc.ascii_split_whitespace(texts).flatten())
                for w, n in zip(found.field(0).to_pylist(), found.field(1).to_pylist(), strict=True):
                    seen[w] += n
                if len(seen) > CACHE_WORDS:
                    yield flush(seen)
                    seen.clear()
        yield flush(seen)

    counts = docs.select("text").mapInArrow(run, "w string, n long").groupBy("w").agg(F.sum("n").alias("n")).filter("n > 1")
    counts = store.table(counts.withColumn("level", F.floor(F.log2("n") * 64).cast("int")), "op4-counts")
    room, least = most, None
    for r in counts.groupBy("level").agg(F.count("*").alias("k")).orderBy(F.desc("level")).collect():  # 64 levels for each doubling
        if r["k"] > room:
            break
        room, least = room - r["k"], r["level"]
    words = [] if least is None else [r["w"] for r in counts.filter(F.col("level") >= least).select("w").collect()]
    store.drop(counts)
    return words


def build(docs: DataFrame, path: str, most: int = LEXICON_WORDS) -> str:
    """Compile the lexicon of ``docs`` into the shared store; its URI."""
    v = Vocabulary(path)
    words = {r: merged(r, v) for w in frequent(docs, most) if len(r := w.encode()) <= LEXICON_BYTES}
    folder = store.new_dir(docs.sparkSession, "op4-lexicon")
    fs, at = store.open_fs(folder)
    fs.create_dir(at)
    with fs.open_output_stream(f"{at}/lexicon.bin") as f:
        f.write(compile_lexicon(words))
    return f"{folder}/lexicon.bin"


#: The codec of this worker process, by lexicon: tasks of one job share its recent words.
_OPEN: dict[str, Codec] = {}


def _codecs(docs: DataFrame, path: str, lexicon: str | None):
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(path))  # of the vocabulary file's size

    def get() -> Codec:
        name = f"{path} {lexicon}"
        if name not in _OPEN:
            _OPEN.clear()
            _OPEN[name] = Codec(shared.value, Lexicon.open(lexicon) if lexicon else None)
        return _OPEN[name]

    return get


def encode(docs: DataFrame, *, path: str | None = None, lexicon: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns and ids array<int> of every row."""
    path, keep = path or vocabulary_path(), keep or ["doc_id"]
    lexicon = lexicon or build(docs, path)
    codec = _codecs(docs, path, lexicon)
    rows = docs.select(*[f"`{k}`" for k in keep], F.col("text").alias("__text"))
    schema = docs.select(*[f"`{k}`" for k in keep]).schema.add("ids", T.ArrayType(T.IntegerType()))

    def run(batches):
        c = codec()
        for batch in batches:
            for at in range(0, len(batch), 1000):
                part = batch.slice(at, 1000)
                ids, sizes = [], np.zeros(len(part), np.int64)
                for where, texts in stretches(part.column("__text")):  # in row order, so ids can be strung together
                    got, ends = c.encode_batch(texts)
                    ids.append(got)
                    sizes[where] += np.diff(ends)
                ends = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids).view(np.int32) if ids else np.empty(0, np.int32)))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], lists], names=schema.names)
        store.trim()

    return rows.mapInArrow(run, schema)


def decode(tokens: DataFrame, *, path: str | None = None) -> DataFrame:
    """``tokens`` with decoded text instead of ids; null ids are empty."""
    codec = _codecs(tokens, path or vocabulary_path(), None)
    keep = [c for c in tokens.columns if c != "ids"]
    schema = tokens.select(*[f"`{k}`" for k in keep]).schema.add("decoded", "string")

    def run(batches):
        c = codec()
        for batch in batches:
            for at in range(0, len(batch), 1000):
                part = batch.slice(at, 1000)
                lists = pc.fill_null(part.column("ids"), pa.scalar([], pa.list_(pa.int32())))
                ends = np.concatenate(([0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))))
                out = c.decode_batch(lists.flatten().to_numpy(zero_copy_only=False), ends).cast(pa.string())
                yield pa.RecordBatch.from_arrays([*[part.column(k) for k in keep], out], names=schema.names)

    return tokens.select(*[f"`{k}`" for k in keep], "ids").mapInArrow(run, schema)


def round_trip(docs: DataFrame, *, path: str | None = None, lexicon: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: every text is encoded, and its ids are decoded."""
    path = path or vocabulary_path()
    codec = _codecs(docs, path, lexicon or build(docs, path))
    schema = docs.select("doc_id").schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")

    def run(batches):
        c = codec()
        for batch in batches:
            n = [0] * len(batch)
            a, b = [hashlib.sha256() for _ in n], [hashlib.sha256() for _ in n]
            for where, texts in stretches(batch.column("text")):
                ids, ends = c.encode_batch(texts)
                raw = memoryview(ids.astype("<u4", copy=False).view(np.uint8))
                bounds = ends.tolist()
                for row, text, lo, hi in zip(where.tolist(), _payloads(c.decode_batch(ids, ends)), bounds[:-1], bounds[1:], strict=True):
                    if hi > lo:
                        a[row].update(raw[4 * lo : 4 * hi])
                        if n[row]:  # the text goes on from an earlier stretch
                            b[row].update(b" ")
                        b[row].update(text)
                        n[row] += hi - lo
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array([x.hexdigest() for x in a], pa.string()), pa.array([x.hexdigest() for x in b], pa.string())], names=schema.names)
        store.trim()

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def op4_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(store.read(spark, sf_dir, "documents"))

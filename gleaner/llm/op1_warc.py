"""Operator 1: deterministic sharded WARC writer and reader.

Pages are cut into shards by ranges of ``page_id``, sorted inside a shard, and written
as records that are gzip members of their own.  A file is closed when its compressed
size reaches ``roll_bytes``.  Headers, lengths and digests are made from the payload.
Of records with equal payloads of at least ``REVISIT_BYTES`` bytes, that with the
largest page_id is a response and the others revisit it.

A task writes under a temporary name of its own attempt and reports its files; only
the reports of tasks that Spark commits reach the manifest, so a lost executor leaves
a stray temporary file at most.  A second job gives the files their final names, which
can be repeated, and the manifest is written last: archives are those it lists.

Determinism.  Shards are intervals of page_id of one width, which depends on the number
of pages, their lowest and highest id and the fullest interval, without its most frequent
id; order,
headers and dates depend on the rows only.  The same table gives the same files.

Skew.  Copies meet as (digest, largest page_id) pairs, summed before the shuffle, and go
back to the pages by page_id, never by digest: a payload that a third of all pages share
adds a narrow row to each of them.  Payloads are shuffled once, by shard, and streamed.  An
interval that a repeated page_id fills, and the pages without one, are split by payload
digest into parts of about ``SHARD_ROWS`` rows; only repeats of one page_id with one payload
stay together.

Defined results.  Null html: empty payload, a response.  Null url: an empty target; control
characters of a url are percent-encoded.  Null page_id: a shard of its own; such a row is a response where no page with an id has its
payload, else revisits that.  Rows that repeat the largest page_id with its payload are
all responses, with record ids of their own.  Ids may span all of 64 bits.  An empty table gives an empty manifest.  Extra columns are not written.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store

REVISIT_BYTES = 1000
ROLL_BYTES = 256 << 20
SHARD_ROWS, MOST_SHARDS = 2_000, 20_000
DATE = "2024-01-01T00:00:00Z"
_NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL name space of RFC 4122

MANIFEST = "shard long, sub int, seq int, temporary string, name string, bytes long, records long, sha256 string"


def _id(page, digest: str, repeat: int = 0) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMES, f'page:{page}:{digest}' + (f':{repeat}' if repeat else ''))}>"


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _head(fields: list[tuple[str, str]]) -> bytes:
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode("utf-8", "surrogatepass")


def record(page, url: str | None, payload: bytes, refers=None, repeat: int = 0) -> bytes:
    """One response or revisit record, uncompressed."""
    digest = hashlib.sha1(payload).hexdigest()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers is not None else http + payload
    target = "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in url or "")
    fields = [
        ("WARC-Type", "response" if refers is None else "revisit"),
        ("WARC-Record-ID", _id(page, digest, repeat)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", target),
        ("WARC-Payload-Digest", _sha1(payload)),
        ("WARC-Block-Digest", _sha1(block)),
        ("Content-Type", "application/http;msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if page is not None:
        fields.append(("X-Page-Id", str(page)))
    if refers is not None:
        fields += [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("WARC-Refers-To", _id(refers, digest)),
            ("X-Refers-To-Page", str(refers)),
            ("X-Payload-Length", str(len(payload))),
        ]
    return _head(fields) + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """A gzip member without time or name, so equal data give equal bytes."""
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


class _File:
    """An open archive under a temporary name."""

    def __init__(self, fs, folder: str, shard: int, sub: int, seq: int, attempt: str):
        self.shard, self.sub, self.seq = shard, sub, seq
        self.name = f"part-{shard:08d}-{sub:05d}-{seq:05d}.warc.gz" if shard >= 0 else f"part-none-{sub:05d}-{seq:05d}.warc.gz"
        self.temporary = f"_temporary/{attempt}-{self.name}"
        self.out = fs.open_output_stream(f"{folder}/{self.temporary}", compression=None)
        self.bytes = self.records = 0
        self.sha = hashlib.sha256()
        info = b"software: deterministic sharded writer\r\nformat: WARC File Format 1.1\r\n"
        self.put(_head([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(_NAMES, self.name)}>"), ("WARC-Date", DATE), ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields"), ("Content-Length", str(len(info)))]) + info + b"\r\n\r\n")
        self.records = 0

    def put(self, data: bytes) -> None:
        z = member(data)
        self.out.write(z)
        self.sha.update(z)
        self.bytes += len(z)
        self.records += 1

    def close(self) -> tuple:
        self.out.close()
        return self.shard, self.sub, self.seq, self.temporary, self.name, self.bytes, self.records, self.sha.hexdigest()


def shard_of(pages: DataFrame, rows: int = SHARD_ROWS, most: int = MOST_SHARDS):
    """A column giving the shard of ``page_id`` (its interval; -1 for null), a table (shard, parts) of those that are split, and how many shards and parts there are."""
    n, named, low, high = pages.agg(F.count("*"), F.count("page_id"), F.min("page_id"), F.max("page_id")).first()
    rows = max(rows, -(-n // most))
    low, high = (low, high) if named else (0, 0)
    width = max(1, (high - low + 1) * rows // max(named, 1))
    column = lambda w: F.coalesce(F.expr(f"(cast(page_id AS decimal(20,0)) - {low}BD) div {w}BD"), F.lit(-1).cast("long")).cast("long")
    ids = store.table(pages.groupBy("page_id").agg(F.count("*").alias("n")), "op1-ids")  # narrow rows, read again by each try
    while True:  # ids that lie close together get narrower intervals; the one id that fills an interval most cannot be helped so
        held = ids.groupBy(column(width).alias("shard")).agg(F.sum("n").alias("n"), F.max("n").alias("top"))
        fullest = held.agg(F.max(F.col("n") - F.col("top"))).first()[0] or 0
        if width == 1 or fullest <= 4 * rows:
            break
        width = max(1, width * rows // fullest)
    split = held.filter(F.col("n") > 4 * rows).select("shard", F.ceil(F.col("n") / rows).cast("int").alias("parts"))
    return column(width), split, -(-n // rows)


def copies(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """page_id, digest, refers_to of the pages that revisit another one. Narrow rows only."""
    t = pages.select("page_id", F.coalesce("html", F.lit("")).alias("h")).filter(F.octet_length("h") >= least).select("page_id", F.sha1("h").alias("digest"))
    t = store.table(t, "op1-digests")
    first = t.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1 and refers_to is not null").drop("n")
    return t.join(first, "digest").filter("page_id is null or page_id < refers_to").select("page_id", "digest", "refers_to").distinct()


def write(pages: DataFrame, folder: str, *, roll_bytes: int = ROLL_BYTES, shard_rows: int = SHARD_ROWS, least: int = REVISIT_BYTES) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as archives below ``folder``; the manifest."""
    spark = pages.sparkSession
    shard, split, number = shard_of(pages, shard_rows)
    split = store.table(split, "op1-split")
    rows = pages.select(shard.alias("shard"), "page_id", F.lit(1).alias("ord"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"), F.lit(None).cast("long").alias("refers"))
    marks = copies(pages, least).select(shard.alias("shard"), "page_id", F.lit(0).alias("ord"), F.lit("").alias("url"), F.col("digest").alias("html"), F.col("refers_to").alias("refers"))

    def dealt_in(df, digest):
        """With ``sub``: the part of its shard, by payload; a split shard has more than 4 * shard_rows rows, so there are MOST_SHARDS / 4 at most."""
        part = F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64(digest), F.col("parts"))).otherwise(F.lit(0))
        return df.join(F.broadcast(split), "shard", "left").select("shard", part.cast("int").alias("sub"), "page_id", "ord", "url", "html", "refers")

    both = dealt_in(marks, F.col("html")).unionByName(dealt_in(rows, F.sha1("html")))
    dealt = both.repartition(max(1, number), "shard", "sub").sortWithinPartitions("shard", "sub", F.col("page_id").asc_nulls_first(), "ord", "url", "html")
    fs, at = store.open_fs(folder)
    fs.create_dir(f"{at}/_temporary")

    def run(batches):
        fs, at = store.open_fs(folder)
        attempt, file, place, seq, mark_page, marks, seen = uuid.uuid4().hex, None, None, 0, object(), {}, {}
        closed: list[tuple] = []
        for batch in batches:
            for lo in range(0, len(batch), 64):
                for s, sub, page, ord_, url, html, refers in zip(*[c.to_pylist() for c in batch.slice(lo, 64).columns], strict=True):
                    if (s, sub, page) != mark_page:
                        mark_page, marks, seen = (s, sub, page), {}, {}
                    if not ord_:
                        marks[html] = refers
                        continue
                    if file and ((s, sub) != place or file.bytes >= roll_bytes):
                        closed.append(file.close())
                        file, seq = None, seq + 1 if (s, sub) == place else 0
                    if file is None:
                        seq = seq if (s, sub) == place else 0
                        place = (s, sub)
                        file = _File(fs, at, s, sub, seq, attempt)
                    payload = html.encode("utf-8", "surrogatepass")
                    digest = hashlib.sha1(payload).hexdigest()
                    repeat = seen[digest] = seen.get(digest, -1) + 1
                    file.put(record(page, url, payload, marks.get(digest), repeat))
        if file:
            closed.append(file.close())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*closed, strict=True) if closed else [[]] * 8, [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()], strict=True)], names=["shard", "sub", "seq", "temporary", "name", "bytes", "records", "sha256"])

    dealt.mapInArrow(run, MANIFEST).write.parquet(f"{folder}/_written")
    written = spark.read.schema(MANIFEST).parquet(f"{folder}/_written")

    def rename(batches):
        fs, at = store.open_fs(folder)
        for batch in batches:
            for temporary, name in zip(batch.column("temporary").to_pylist(), batch.column("name").to_pylist(), strict=True):
                if fs.get_file_info(f"{at}/{temporary}").is_file:  # else an earlier try of this task moved it
                    fs.move(f"{at}/{temporary}", f"{at}/{name}")
                elif not fs.get_file_info(f"{at}/{name}").is_file:
                    raise FileNotFoundError(f"{folder}/{temporary}")
            yield batch

    written.mapInArrow(rename, MANIFEST).drop("temporary").write.parquet(f"{folder}/manifest")
    store.remove(spark, f"{folder}/_temporary")
    return spark.read.parquet(f"{folder}/manifest")


class _Stream:
    """Decompressed bytes of a file of gzip members, read piece by piece."""

    def __init__(self, source):
        self.source, self.z, self.buffer, self.rest = source, zlib.decompressobj(31), bytearray(), b""

    def _more(self) -> bool:
        if not self.rest:
            self.rest = self.source.read(1 << 20)
            if not self.rest:
                return False
        self.buffer += self.z.decompress(self.rest)
        self.rest = b""
        while self.z.eof and self.z.unused_data:
            left, self.z = self.z.unused_data, zlib.decompressobj(31)
            self.buffer += self.z.decompress(left)
        return True

    def until(self, mark: bytes) -> bytes | None:
        at = 0
        while (i := self.buffer.find(mark, at)) < 0:
            at = max(0, len(self.buffer) - len(mark))
            if not self._more():
                return None
        out = bytes(self.buffer[:i])
        del self.buffer[: i + len(mark)]
        return out

    def take(self, n: int) -> bytes:
        while len(self.buffer) < n:
            if not self._more():
                raise EOFError("an archive ends inside a record")
        out = bytes(self.buffer[:n])
        del self.buffer[:n]
        return out


def records(source):
    """(headers, block) of every record of an open archive."""
    s = _Stream(source)
    while (head := s.until(b"\r\n\r\n")) is not None:
        lines = head.decode("utf-8", "surrogatepass").split("\r\n")
        fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
        block = s.take(int(fields["Content-Length"]))
        s.take(4)
        yield fields, block


READ = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long"


def read(spark: SparkSession, folder: str, *, payload: bool = False) -> DataFrame:
    """Records of all archives that the manifest lists, one task per group of files; digests are made anew and checked."""
    manifest = spark.read.parquet(f"{folder}/manifest")
    schema = store.schema(READ + (", payload string" if payload else ""))
    parts = max(1, min(manifest.count(), MOST_SHARDS))

    def run(batches):
        fs, at = store.open_fs(folder)
        for batch in batches:
            for name in batch.column("name").to_pylist():
                rows: list[tuple] = []
                held = 0
                with fs.open_input_stream(f"{at}/{name}", compression=None) as f:
                    for h, block in records(f):
                        if h["WARC-Type"] == "warcinfo":
                            continue
                        if _sha1(block) != h["WARC-Block-Digest"]:
                            raise ValueError(f"{name}: a block differs from its digest")
                        body = block[block.index(b"\r\n\r\n") + 4 :]
                        revisit = h["WARC-Type"] == "revisit"
                        digest = base64.b32decode(h["WARC-Payload-Digest"][5:]).hex()
                        if not revisit and hashlib.sha1(body).hexdigest() != digest:
                            raise ValueError(f"{name}: a payload differs from its digest")
                        number = lambda k, h=h: int(h[k]) if k in h else None
                        rows.append((number("X-Page-Id"), h["WARC-Target-URI"], h["WARC-Type"], number("X-Payload-Length") if revisit else len(body), digest, number("X-Refers-To-Page"), *((None if revisit else body.decode("utf-8", "surrogatepass"),) if payload else ())))
                        held += len(body) if payload else 100
                        if held > 4 << 20:
                            yield _batch(rows, payload)
                            rows, held = [], 0
                if rows:
                    yield _batch(rows, payload)

    return manifest.select("name").repartition(parts, "name").mapInArrow(run, schema)


def _batch(rows: list[tuple], payload: bool) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()] + [pa.string()] * payload
    names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to"] + ["payload"] * payload
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def op1_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = store.new_dir(spark, "op1-warc")
    write(store.read(spark, sf_dir, "pages"), folder)
    return read(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


ORACLE = """
WITH p AS (
  SELECT page_id, coalesce(url, '') AS url, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), m AS (SELECT payload_digest, max(page_id) AS top FROM p GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id < top THEN top END AS refers_to, url
FROM p JOIN m USING (payload_digest)
"""

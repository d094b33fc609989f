"""Tables of versions: new data beside the old, one rename as the commit, resumable runs.

Layout below ``path``: ``data/<name>`` holds Parquet folders that never change, ``manifest/<n>.json``
says which of them are version n, and what its writer noted.  A version exists from the moment its manifest,
written under another name, is renamed; a rename to a name that is taken fails, so of two
writers one wins.  A run killed before that leaves data that no manifest names, which the next
commit deletes; one killed after it has committed.  Readers of the last version and of the one before
it are never disturbed.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import catalog

#: Versions whose data stays.
KEEP = 2


class Conflict(RuntimeError):
    """Another writer has committed this version."""


class Table:
    """A table of versions at ``path``, a URI of any file system that Spark writes to."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, name: str):
        p = self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p.getFileSystem(self._conf), p

    def _names(self, folder: str) -> list[str]:
        fs, p = self._at(folder)
        return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []

    def version(self) -> int:
        """The last version's number, 0 without any."""
        return max((int(n[:-5]) for n in self._names("manifest") if n.endswith(".json") and n[:-5].isdigit()), default=0)

    def manifest(self, version: int | None = None) -> dict:
        """Folders (``data``) and ``notes`` of a version; empty for version 0."""
        version = self.version() if version is None else version
        if not version:
            return {"version": 0, "data": [], "notes": {}}
        fs, p = self._at(f"manifest/{version}.json")
        stream = fs.open(p)
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def read(self, version: int | None = None) -> DataFrame | None:
        """The rows of a version; None without any data."""
        data = self.manifest(version)["data"]
        return self.spark.read.parquet(*[f"{self.path}/data/{d}" for d in data]) if data else None

    def write_data(self, df: DataFrame) -> str:
        """Write rows that belong to no version yet; their folder's name."""
        name = uuid.uuid4().hex
        df.write.parquet(f"{self.path}/data/{name}")
        return name

    def commit(self, data: list[str], notes: dict | None = None, *, after: int | None = None) -> int:
        """Make ``data`` the version behind ``after`` (the last one); :class:`Conflict` if that number is taken."""
        number = (self.version() if after is None else after) + 1
        fs, final = self._at(f"manifest/{number}.json")
        _, draft = self._at(f"manifest/.{uuid.uuid4().hex}")
        out = fs.create(draft, True)
        try:
            out.write(json.dumps({"version": number, "data": data, "notes": notes or {}}).encode())
        finally:
            out.close()
        self._rename(fs, draft, final)
        return number

    def _rename(self, fs, draft, final) -> None:
        if fs.exists(final) or not fs.rename(draft, final):
            fs.delete(draft, False)
            raise Conflict(final.toString())

    def clean(self, keep: int = KEEP) -> None:
        """Delete old manifests, and data that no version left names.  For the table's only writer, since it deletes data not yet committed."""
        last = self.version()
        stay = [v for v in range(max(1, last - keep + 1), last + 1) if f"{v}.json" in self._names("manifest")]
        used = {d for v in stay for d in self.manifest(v)["data"]}
        for folder, names in (("manifest", {f"{v}.json" for v in stay}), ("data", used)):
            for n in self._names(folder):
                if n not in names:
                    fs, p = self._at(f"{folder}/{n}")
                    fs.delete(p, True)

    def replace(self, df: DataFrame, notes: dict | None = None) -> int:
        """A version with the rows of ``df``, which may read the last one."""
        before = self.version()
        number = self.commit([self.write_data(df)], notes, after=before)
        self.clean()
        return number


def upsert(table: Table, new: DataFrame, keys: list[str], notes: dict | None = None) -> int:
    """A version in which ``new`` rows replace those with their keys."""
    old = table.read()
    return table.replace(new if old is None else catalog.upsert(old, new, keys), notes)


def add_batch(table: Table, fresh: DataFrame, batch: int, keys: list[str], sums: list[str]) -> bool:
    """Add a stream's batch of counts to the table's; False if this batch, or a later one, is in it already."""
    if batch <= table.manifest()["notes"].get("batch", -1):
        return False
    old = table.read()
    both = fresh if old is None else old.unionByName(fresh)
    table.replace(both.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums]), {"batch": batch})
    return True


def run_parts(todo: DataFrame, key: str, step: Callable[[DataFrame], DataFrame], table: Table, *, parts: int = 8, run: str = "run") -> DataFrame:
    """``step`` over all of ``todo``, one part of the keys after another, each committed when it is done.

    A run that was stopped goes on behind its last commit: parts that the manifest names are not
    computed again.  Rows go to parts by a hash of the key, so a part is the same in every run; ``parts`` and ``run``
    must be too.  The result is the table of all parts, to be aggregated again by the caller.
    """
    notes = {"run": run, "parts": parts, "done": []}
    seen = table.manifest()
    if seen["version"] and {k: seen["notes"].get(k) for k in ("run", "parts")} != {"run": run, "parts": parts}:
        raise ValueError(f"the table at {table.path} belongs to another run")
    done, data = list(seen["notes"].get("done", [])), list(seen["data"])
    for part in range(parts):
        if part in done:
            continue
        rows = todo.filter(F.pmod(F.xxhash64(key), F.lit(parts)) == part)
        before = table.version()
        name = table.write_data(step(rows))
        table.commit([*data, name], notes | {"done": [*done, part]}, after=before)
        done, data = [*done, part], [*data, name]
        table.clean()
    return table.read()

"""Stored tables by buckets of a key, switched by numbered commits, so that a batch reads and rewrites only the buckets that it meets.

A table's rows lie in folders ``table/version/bucket=b``. A commit is one small file that names, for each table and bucket, the versions that
hold its rows; readers take the newest whole commit. Versions are written before the commit that names them and never changed after, so a crash
leaves the old tables, a reader keeps what it began with, and all tables of a batch change at once. There is one writer at a time: a commit whose
number is taken is an error.

Appending adds a version to the buckets met. Replacing writes the buckets met anew and leaves the others' files alone. Compaction merges a bucket's
small versions, newest first, while the next older one is at most twice as large as those merged so far, so that a row is rewritten as often as
the logarithm of its bucket's size, and a bucket has few files however many batches there were. Versions that none of the last commits names are
deleted by ``clean``.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import SCHEMAS, conform, folder

#: Key of each table, by which it is dealt to buckets.
KEYS = {"message": "id", "sender": "id", "sender_identity": "value", "sender_merge": "source_id", "decision": "sender_id", "unsubscribe_attempt": "sender_id", "sync_state": "folder"}


def has_commits(spark: SparkSession, root: str) -> bool:
    files, at = folder(spark, f"{root}/_commits")
    return files.exists(at)


class Store:
    """The tables under ``root``. The number of buckets is fixed by the first commit."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        self.spark, self.root = spark, root.rstrip("/")
        self.number, state = self._newest()
        self.buckets = state["buckets"] if state else buckets
        self.tables: dict[str, dict[str, list]] = state["tables"] if state else {}

    def _names(self, path: str) -> list[str]:
        files, at = folder(self.spark, path)
        return sorted(s.getPath().getName() for s in files.listStatus(at)) if files.exists(at) else []

    def _newest(self) -> tuple[int, dict | None]:
        done = [n for n in self._names(f"{self.root}/_commits") if n.endswith(".json")]
        return (int(done[-1].removesuffix(".json")), self._load(done[-1])) if done else (0, None)

    def _load(self, name: str) -> dict:
        # A commit file is one line, read by Spark's own file systems.
        return json.loads(self.spark.read.text(f"{self.root}/_commits/{name}", wholetext=True).first()[0])

    # -- reading

    def bucket(self, name: str, key: Column | str | None = None) -> Column:
        """The bucket of a key of the table."""
        key = F.col(KEYS[name]) if key is None else F.col(key) if isinstance(key, str) else key
        return F.pmod(F.xxhash64(key), F.lit(1 if name == "sync_state" else self.buckets)).cast("int")

    def met(self, name: str, keys: DataFrame, key: str) -> list[int]:
        """The buckets of some keys: at most as many numbers as there are buckets come to the driver."""
        return sorted(r[0] for r in keys.select(self.bucket(name, key).alias("b")).distinct().collect())

    def parts(self, name: str, buckets: list[int] | None = None) -> list[tuple[int, str, int]]:
        """(bucket, version, bytes) of what a read takes."""
        chosen = None if buckets is None else set(buckets)
        return [(int(b), v, size) for b, versions in self.tables.get(name, {}).items() for v, size in versions if chosen is None or int(b) in chosen]

    def _read(self, name: str, parts: list[tuple[int, str, int]]) -> DataFrame:
        paths = [f"{self.root}/{name}/{v}/bucket={b}" for b, v, _ in parts]
        return self.spark.read.schema(SCHEMAS[name]).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMAS[name])

    def read(self, name: str, buckets: list[int] | None = None) -> DataFrame:
        """The table, or the rows of some of its buckets; the files of the others are not opened."""
        return self._read(name, self.parts(name, buckets))

    # -- writing

    def _write(self, df: DataFrame, name: str) -> tuple[str, dict[int, int]]:
        """A new version, one file a bucket, its rows by sender where they have one; (version, bytes of each bucket it has)."""
        version = f"v{self.number + 1:09d}-{uuid.uuid4().hex[:8]}"
        path = f"{self.root}/{name}/{version}"
        out = conform(df, name).withColumn("bucket", self.bucket(name))
        order = [c for c in ("sender_id",) if c in out.columns]
        out.repartition("bucket").sortWithinPartitions("bucket", *order).write.partitionBy("bucket").parquet(path)
        files, at = folder(self.spark, path)
        sizes = {}
        for s in files.listStatus(at):
            if s.getPath().getName().startswith("bucket="):
                sizes[int(s.getPath().getName().removeprefix("bucket="))] = files.getContentSummary(s.getPath()).getLength()
        return version, sizes

    def change(self) -> Change:
        return Change(self)

    def _commit(self, tables: dict) -> None:
        text = json.dumps({"buckets": self.buckets, "tables": tables})
        base = f"{self.root}/_commits"
        files, at = folder(self.spark, f"{base}/{self.number + 1:09d}.json")
        temp = folder(self.spark, f"{base}/.{uuid.uuid4().hex}")[1]
        out = files.create(temp, False)
        out.write(bytearray(text.encode()))
        out.close()
        if files.exists(at) or not files.rename(temp, at):
            files.delete(temp, False)
            raise RuntimeError(f"commit {self.number + 1} of {self.root} was made by another writer")
        self.number, self.tables = self.number + 1, tables

    def compact(self, name: str, most: int = 8) -> int:
        """Merge the small versions of the buckets that have more than ``most``, in one job and one commit; the number of buckets merged."""
        tail: dict[str, int] = {}
        for b, versions in self.tables.get(name, {}).items():
            if len(versions) > most:
                first, held = len(versions) - 1, versions[-1][1]
                while first > 0 and (versions[first - 1][1] <= 2 * held or first >= most):
                    first -= 1
                    held += versions[first][1]
                tail[b] = first
        if not tail:
            return 0
        version, sizes = self._write(self._read(name, [(int(b), v, n) for b, first in tail.items() for v, n in self.tables[name][b][first:]]), name)
        merged = {b: [*versions[: tail[b]], [version, sizes[int(b)]]] if b in tail else versions for b, versions in self.tables[name].items()}
        self._commit({**self.tables, name: merged})
        return len(tail)

    def clean(self, keep: int = 6) -> int:
        """Delete versions that none of the last ``keep`` commits names, and older commits; readers that began before lose theirs."""
        commits = [n for n in self._names(f"{self.root}/_commits") if n.endswith(".json")]
        states = [self._load(n) for n in commits[-keep:]]
        gone = 0
        for name in KEYS:
            used = {v for s in states for versions in s["tables"].get(name, {}).values() for v, _ in versions}
            for v in self._names(f"{self.root}/{name}"):
                if v.startswith("v") and v not in used:
                    files, at = folder(self.spark, f"{self.root}/{name}/{v}")
                    files.delete(at, True)
                    gone += 1
        for n in commits[:-keep]:
            files, at = folder(self.spark, f"{self.root}/_commits/{n}")
            files.delete(at, False)
        return gone


class Change:
    """Versions written for the next commit; nothing is seen before ``commit``."""

    def __init__(self, store: Store):
        self.store = store
        self.tables = {n: {b: list(v) for b, v in of.items()} for n, of in store.tables.items()}

    def append(self, name: str, df: DataFrame) -> None:
        version, sizes = self.store._write(df, name)
        for b, size in sizes.items():
            self.tables.setdefault(name, {}).setdefault(str(b), []).append([version, size])

    def replace(self, name: str, df: DataFrame, buckets: list[int]) -> None:
        """``df`` has all rows of these buckets; the others keep their files."""
        version, sizes = self.store._write(df, name)
        stray = set(sizes) - set(buckets)
        if stray:
            raise ValueError(f"rows of buckets that are not replaced: {sorted(stray)}")
        of = self.tables.setdefault(name, {})
        for b in buckets:
            of.pop(str(b), None)
            if b in sizes:
                of[str(b)] = [[version, sizes[b]]]

    def commit(self) -> None:
        self.store._commit(self.tables)

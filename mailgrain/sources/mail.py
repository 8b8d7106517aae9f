"""Raw mail: folders of .eml files, Parquet tables with a raw column, and the projection to header fields."""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import cache
from itertools import islice

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import mime
from ..functions.detect import message_key
from ..operators.graph import cut
from . import tables
from .tables import RAW_MAIL

FILES = "path string, modificationTime timestamp, content binary"
NAMES = "root int, name binary, modificationTime timestamp"
#: Names that a task lists at a time, and files that it reads where there are many; bytes after which a batch of messages ends.
MANY, BATCH = 10_000, 1 << 22


def _roots(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """(name in Hadoop's terms, place in Arrow's) of the folders that ``path`` or its pattern names; none if one of them is a file, or out of Arrow's reach."""
    files, at = tables.folder(spark, path)
    roots = []
    for found in files.globStatus(at) or []:
        uri = found.getPath().toUri()
        place = uri.getPath() if uri.getScheme() == "file" else uri.toString()
        try:
            system, root = fs.FileSystem.from_uri(place)
            if system.get_file_info(root).type != fs.FileType.Directory:
                return []
        except (pa.ArrowException, OSError):
            return []
        roots.append((found.getPath().toString().rstrip("/"), place))
    return roots


def _entries(system: fs.FileSystem, at: str) -> Iterator[tuple[str, bool, int, int | None]]:
    """(name, is a folder, size, when changed, in ms) of what lies in a folder. Local names are told as they come; those of other systems a task holds for a while."""
    if not isinstance(system, fs.LocalFileSystem):
        for f in system.get_file_info(fs.FileSelector(at)):
            yield f.base_name, f.type == fs.FileType.Directory, f.size, f.mtime_ns and f.mtime_ns // 10**6
        return
    with os.scandir(at) as found:
        for e in found:
            try:
                known = e.stat()
            except FileNotFoundError:  # gone meanwhile, or a link to nothing
                continue
            yield e.name, e.is_dir(), known.st_size, known.st_mtime_ns // 10**6


def _eml(system: fs.FileSystem, at: str, under: str = "") -> Iterator[tuple[bytes, int | None]]:
    """(name, when changed) of the .eml files that Spark's readers see in a folder: not the hidden and empty ones, and those in folders key=value as well."""
    for name, is_folder, size, changed in _entries(system, f"{at}/{under}"):
        if name.startswith(".") or name.startswith("_") and "=" not in name:
            continue
        if is_folder and "=" in name:
            yield from _eml(system, at, f"{under}{name}/")
        elif not is_folder and size and name.endswith(".eml"):
            yield os.fsencode(under + name), changed


def _listed(places: list[str]):
    def run(batches):
        for b in batches:
            for k in b.column("id").to_pylist():
                names = _eml(*fs.FileSystem.from_uri(places[k]))
                while some := list(islice(names, MANY)):
                    changed = pa.array([x[1] for x in some], pa.timestamp("ms", "UTC")).cast(pa.timestamp("us", "UTC"))
                    yield pa.RecordBatch.from_arrays([pa.array([k] * len(some), pa.int32()), pa.array([x[0] for x in some], pa.binary()), changed], names=["root", "name", "modificationTime"])

    return run


def _contents(roots: list[tuple[str, str]]):
    def read(system, at: str) -> bytes:
        with open(at, "rb") if isinstance(system, fs.LocalFileSystem) else system.open_input_stream(at, compression=None) as file:
            return file.read()

    def batch(rows):
        path, changed, content = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(path, pa.string()), pa.array(changed, pa.timestamp("us", "UTC")), pa.array(content, pa.binary())], names=["path", "modificationTime", "content"])

    def run(batches):
        system_at = cache(lambda k: fs.FileSystem.from_uri(roots[k][1]))
        for b in batches:
            rows, size = [], 0
            for k, name, changed in zip(b.column("root").to_pylist(), b.column("name").to_pylist(), b.column("modificationTime").cast(pa.int64()).to_pylist(), strict=True):
                system, at = system_at(k)
                rows.append((f"{roots[k][0]}/{name.decode(errors='replace')}", changed, read(system, f"{at}/{os.fsdecode(name)}")))
                size += len(rows[-1][2])
                if size >= BATCH:
                    yield batch(rows)
                    rows, size = [], 0
            if rows:
                yield batch(rows)

    return run


def _files(spark: SparkSession, path: str) -> DataFrame:
    """The .eml files of a folder, or of the folders that a pattern names, as Spark's reader of binary files has them.

    That reader keeps every file's name and a task for each few of them in the driver. Here a task lists each folder, the names, fixed from then on, go to
    spark.checkpoint.dir, and are dealt out to the tasks that read the files. Only what Arrow's file systems don't reach, or single files, are left to Spark's.
    """
    roots = _roots(spark, path)
    if not roots:
        return spark.read.format("binaryFile").option("pathGlobFilter", "*.eml").load(path)
    names = cut(spark.range(0, len(roots), 1, len(roots)).mapInArrow(_listed([place for _, place in roots]), NAMES))
    n = names.count()
    tasks = max(1, min(n, spark.sparkContext.defaultParallelism), n // MANY)
    return names.repartition(tasks, "root", "name").mapInArrow(_contents(roots), FILES)


def read_eml(spark: SparkSession, path: str, folder: str = "INBOX", uidvalidity: int = 1) -> DataFrame:
    """Raw mail of a folder of .eml files. A file's uid is the number in its name, or else a hash of its path."""
    files = _files(spark, path)
    number = F.regexp_extract("path", r"([0-9]+)[^/0-9]*\.eml$", 1).try_cast("long")
    uid = F.coalesce(number, F.xxhash64("path").bitwiseAND(F.lit(2**53 - 1)))
    return files.select(F.lit(folder).alias("folder"), F.lit(uidvalidity).cast("long").alias("uidvalidity"), uid.alias("uid"), F.col("modificationTime").cast("timestamp_ntz").alias("internal_date"), F.col("content").cast("string").alias("raw"))


def read_raw_mail(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet archive of raw mail, by schema."""
    return spark.read.schema(RAW_MAIL).parquet(path)


def write_archive(raw: DataFrame, path: str) -> None:
    """Append raw mail to an archive by folder and month of arrival, so that a window, or a folder, reads only its own files.

    Rows are gathered by folder and month and then evened out: Spark splits what a busy folder's month has too much of.
    """
    month = F.date_format("internal_date", "yyyy-MM")
    raw.withColumn("month", F.coalesce(month, F.lit("none"))).hint("rebalance", "folder", "month").write.mode("append").partitionBy("folder", "month").parquet(path)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """An archive by folder and month; ``backfill_filter`` and ``folder_filter`` prune it."""
    return spark.read.schema(RAW_MAIL + ", month string").parquet(path)


def write_eml(raw: DataFrame, path: str) -> int:
    """One file uid.eml for each message, under a folder of its own for each mail folder; the number of files. A repeated task writes the same files again."""

    def run(batches):
        system, root = fs.FileSystem.from_uri(path)
        for b in batches:
            for folder, uid, text in zip(b.column("folder").to_pylist(), b.column("uid").to_pylist(), b.column("raw").to_pylist(), strict=True):
                system.create_dir(f"{root}/{folder}", recursive=True)
                with system.open_output_stream(f"{root}/{folder}/{uid}.eml", compression=None) as out:
                    out.write((text or "").encode())
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], names=["files"])

    return raw.select("folder", "uid", "raw").mapInArrow(run, "files long").agg(F.coalesce(F.sum("files"), F.lit(0))).first()[0]


def with_headers(raw: DataFrame, keep: tuple[str, ...] | None = mime.KEPT_HEADERS) -> DataFrame:
    """Adds ``headers``; the raw text stays only as a column that later steps may leave unread."""
    headers = mime.parse_headers(mime.split_message(F.col("raw"))["head"])
    return raw.withColumn("headers", mime.project_headers(headers, keep) if keep else headers)


def parsed_mail(raw: DataFrame) -> DataFrame:
    """One row per message with its key, sender fields and header array; one pass, no shuffle."""
    h = F.col("headers")

    def field(name: str) -> Column:
        return mime.header(h, name)

    rows = with_headers(raw).withColumn("from_", mime.parse_address(field("from")))
    return rows.select(
        message_key(field("message-id"), F.col("folder"), F.col("uidvalidity"), F.col("uid")).alias("id"),
        "folder", "uidvalidity", "uid", F.col("internal_date").alias("received_at"), mime.decode_encoded_words(field("subject")).alias("subject"),
        F.col("from_.name").alias("from_name"), F.col("from_.address").alias("from_address"), field("list-id").alias("list_id"), mime.dkim_domains(h).alias("dkim"), "headers", "raw",
    )

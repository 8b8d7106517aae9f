"""Helpers shared by the corpus operators."""

from __future__ import annotations

import gc
import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import folder


def shared_dir(spark: SparkSession) -> str:
    """A new path under the folder that the whole cluster shares (spark.checkpoint.dir).

    Only where the session names none and its master is local, as in tests, a folder of our own is made and set.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        context = spark.sparkContext
        if context.getCheckpointDir() is None:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
            context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="spark-"))
        base = context.getCheckpointDir()
    return f"{base.rstrip('/')}/mailgrain-{uuid.uuid4().hex}"


_scope: ContextVar[list | None] = ContextVar("scope", default=None)


@contextmanager
def scratch(spark: SparkSession):
    """What ``written`` writes inside is deleted at the end: for a job that has stored its own result by then. Folders of others stay."""
    paths: list[str] = []
    token = _scope.set(paths)
    try:
        yield
    finally:
        _scope.reset(token)
        for path in paths:
            files, at = folder(spark, path)
            files.delete(at, True)


def written(df: DataFrame, path: str | None = None, compression: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here and lost executors cost no recomputation."""
    spark = df.sparkSession
    path = path or shared_dir(spark)
    if _scope.get() is not None:
        _scope.get().append(path)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files and broadcasts that nothing refers to any more: Spark's cleaner follows the driver's collector."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


class Words(dict):
    """f(word) of words, kept by a worker for the ones it meets again; long words are not kept, so the table stays small."""

    def __init__(self, f, max_words: int = 500_000, max_length: int = 64):
        super().__init__()
        self.f, self.max_words, self.max_length = f, max_words, max_length

    def __missing__(self, word: str):
        value = self.f(word)
        if len(word) <= self.max_length:
            if len(self) >= self.max_words:
                self.clear()
            self[word] = value
        return value


_in_use = None


def keep_only(cache) -> None:
    """For the start of a task: a worker serves one operator after another, and what it kept for the last one is let go, so that it holds one cache at a time."""
    global _in_use
    if cache is not _in_use:
        if _in_use is not None:
            _in_use.clear()
            pa.default_memory_pool().release_unused()
        _in_use = cache


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Column names for the time of a job that clash with none of ``df``'s, upper and lower case being one."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name in taken:
            name += "_"
        out.append(name)
        taken.add(name)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, text string): the two columns the operators read, whatever else the table holds. Null texts become empty."""
    from pyspark.sql import functions as F

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

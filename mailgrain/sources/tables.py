"""The seven stored tables: schemas, reading, appending and snapshots. Instants are TIMESTAMP_NTZ in UTC."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import free_names

SCHEMAS = {
    "sender": "id string, display_name string, name_at timestamp_ntz, display_address string, address_at timestamp_ntz, first_seen_at timestamp_ntz, last_seen_at timestamp_ntz, created_at timestamp_ntz, merged_into string",
    "sender_identity": "sender_id string, kind string, value string, first_seen_at timestamp_ntz",
    "sender_merge": "id long, source_id string, target_id string, merged_at timestamp_ntz, active boolean, note string",
    "message": "id string, sender_id string, folder string, uidvalidity long, uid long, received_at timestamp_ntz, subject string, from_name string, from_address string, list_id string, method string, confidence double, unsubscribe_uri string, suspicious boolean, ingested_at timestamp_ntz",
    "decision": "id long, sender_id string, decision string, decided_at timestamp_ntz, suppressed_until timestamp_ntz, note string",
    "unsubscribe_attempt": "id long, sender_id string, method string, attempted_at timestamp_ntz, result string, http_status int, target_uri string, sent_message_id string, error string",
    "sync_state": "folder string, uidvalidity long, last_uid long, last_synced_at timestamp_ntz, backfill_since timestamp_ntz",
}
#: Tables that are replaced as a whole, by snapshots.
REPLACED = ("sender", "sync_state")
RAW_MAIL = "folder string, uidvalidity long, uid long, internal_date timestamp_ntz, raw string"


def folder(spark: SparkSession, path: str):
    """(file system, path) in Hadoop's terms."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _snapshots(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the whole snapshots under ``path``; one that a crash left half-written has no _SUCCESS and doesn't count."""
    files, at = folder(spark, path)
    names = [s.getPath().getName() for s in files.listStatus(at)] if files.exists(at) else []
    numbers = [int(n.removeprefix("snapshot-")) for n in names if n.startswith("snapshot-")]
    return sorted(n for n in numbers if files.exists(folder(spark, f"{path}/snapshot-{n:09d}/_SUCCESS")[1]))


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A stored table by its declared schema: of a store with commits the newest state, else the newest snapshot of those that are replaced; an empty frame where nothing was written yet."""
    from .store import Store, has_commits

    if has_commits(spark, root):
        return Store(spark, root).read(name)
    path = f"{root}/{name}"
    if name in REPLACED:
        known = _snapshots(spark, path)
        return spark.read.schema(SCHEMAS[name]).parquet(f"{path}/snapshot-{known[-1]:09d}") if known else spark.createDataFrame([], SCHEMAS[name])
    files, at = folder(spark, path)
    return spark.read.schema(SCHEMAS[name]).parquet(path) if files.exists(at) else spark.createDataFrame([], SCHEMAS[name])


def conform(df: DataFrame, name: str) -> DataFrame:
    """Columns of the table in order and type; those missing are null."""
    fields = [f.strip().split() for f in SCHEMAS[name].split(",")]
    return df.select(*[(F.col(n) if n in df.columns else F.lit(None)).cast(t).alias(n) for n, t in fields])


def append_log(df: DataFrame, root: str, name: str) -> None:
    """Decisions, attempts and merges are appended, never updated."""
    conform(df, name).write.mode("append").parquet(f"{root}/{name}")


def write_messages(df: DataFrame, root: str, buckets: int = 16) -> None:
    """Messages, partitioned by a bucket of their sender, so that one sender's mail is read from one folder."""
    out = conform(df, "message").withColumn("bucket", F.pmod(F.xxhash64("sender_id"), F.lit(buckets)))
    out.write.mode("append").partitionBy("bucket").parquet(f"{root}/message")


def write_snapshot(df: DataFrame, root: str, name: str) -> None:
    """Replace a small table as a whole: a new folder beside the old one, which stays readable until the new one is whole.

    The one before is kept for readers that have begun; older ones go.
    """
    spark, path = df.sparkSession, f"{root}/{name}"
    known = _snapshots(spark, path)
    conform(df, name).write.mode("overwrite").parquet(f"{path}/snapshot-{(known[-1] if known else 0) + 1:09d}")
    for n in known[:-1]:
        files, at = folder(spark, f"{path}/snapshot-{n:09d}")
        files.delete(at, True)


def upsert(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` replace those of ``stored`` with the same keys."""
    is_new, n = free_names(stored.columns + new.columns, "is_new", "n")
    both = stored.withColumn(is_new, F.lit(0)).unionByName(new.withColumn(is_new, F.lit(1)), allowMissingColumns=True)
    last = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(is_new)))
    return both.withColumn(n, last).filter(F.col(n) == 1).drop(is_new, n)


def upsert_sync_state(stored: DataFrame, new: DataFrame) -> DataFrame:
    """One row per folder."""
    return upsert(stored, new, ["folder"])


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)

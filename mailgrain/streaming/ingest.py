"""Incremental ingest with Structured Streaming: files of raw mail in, the stored tables kept up to date batch by batch.

Each micro-batch runs the batch operators on the buckets of the stored tables that it meets, and ends with one commit of them all. It is
idempotent: keys already stored are left out by an anti-join, so a batch repeated after a crash changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.identity import candidate_identities
from ..functions.text import free_names
from ..operators.graph import cut
from ..operators.ingest import advance_watermark, as_messages, backfill_filter, dedupe_messages, detect_parsed, folder_filter, incremental_filter, sender_touch
from ..operators.resolve import identities_of, resolve_senders
from ..operators.senders import new_identities
from ..sources import tables
from ..sources.mail import parsed_mail
from ..sources.store import Store
from ..sources.tables import RAW_MAIL


def ingest_batch(raw: DataFrame, root: str, as_of, since, folders: tuple[str, ...] = ("INBOX",), scrape_bodies: bool = True, mailbox: str = "", by_watermark: bool = True, buckets: int = 64, most_versions: int = 8) -> None:
    """Ingest one batch of raw mail into the store under ``root``.

    ``by_watermark`` leaves out what a folder's watermark says was examined before; for a scan of a mailbox, in which uids only rise. Without it any
    uid may come late. Either way keys already stored are left out by an anti-join on the key alone, before any body is decoded.

    Of messages, identities and senders only the buckets that the batch meets are read, and only the senders' are rewritten: what a batch costs
    follows the batch (up to as many buckets as there are), not the archive. All tables change with one commit; a crash before it leaves
    the old ones, and the batch is then ingested as if for the first time.
    """
    spark = raw.sparkSession
    store = Store(spark, root, buckets)
    sync_state = store.read("sync_state")
    mail = folder_filter(raw, folders)
    mail = incremental_filter(mail, sync_state, since) if by_watermark else backfill_filter(mail, since)
    parsed = parsed_mail(mail.drop("folder_ord"))
    if store.tables.get("message"):
        stored = store.read("message", store.met("message", parsed, "id"))
        parsed = parsed.join(stored.select("id"), "id", "left_anti")
    place = F.array_position(F.array(*[F.lit(f) for f in folders]), F.col("folder")).cast("int")
    messages = as_messages(detect_parsed(parsed, scrape_bodies).withColumn("folder_ord", place), as_of)
    new = cut(dedupe_messages(messages).withColumn("ord", F.struct("folder_ord", "uid")))
    keys = new.select(F.explode(candidate_identities(F.col("list_id"), F.col("from_address"), F.col("dkim"))).alias("c")).select("c.value")
    identities = store.read("sender_identity", store.met("sender_identity", keys, "value"))
    resolved = cut(resolve_senders(new, identities, mailbox))
    rows = cut(new.join(resolved.select("id", "sender_id"), "id"))
    found = new_identities(identities_of(new, resolved), identities).withColumn("first_seen_at", as_of)
    touched = store.met("sender", rows, "sender_id")
    senders = store.read("sender", touched)
    kept = senders.select("id", F.col("created_at").alias("created_before"), "merged_into")
    senders = sender_touch(rows, senders).withColumn("created_at", as_of).join(kept, "id", "left").withColumn("created_at", F.coalesce("created_before", "created_at")).drop("created_before")
    change = store.change()
    change.append("sender_identity", found)
    change.replace("sender", senders, touched)
    change.append("message", rows)
    change.replace("sync_state", tables.upsert_sync_state(sync_state, advance_watermark(mail, sync_state, since, as_of)), [0])
    change.commit()
    for name in ("sender_identity", "message"):
        store.compact(name, most_versions)
    store.clean()


def stream_ingest(spark: SparkSession, source: str, root: str, checkpoint: str, as_of, since, folders: tuple[str, ...] = ("INBOX",), max_files: int = 100):
    """Ingest what has arrived under ``source`` and stop; the checkpoint remembers files, so a later call goes on from there.

    Files come in any order of uids, so the watermark leaves nothing out here; it is kept up to date for mailbox scans.
    """
    raw = spark.readStream.schema(RAW_MAIL).option("maxFilesPerTrigger", max_files).parquet(source)
    run = raw.writeStream.foreachBatch(lambda df, _: ingest_batch(df, root, as_of, since, folders, by_watermark=False))
    return run.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_dedupe(messages: DataFrame, delay: str = "7 days", time: str = "received_at") -> DataFrame:
    """Bounded-state form: a key is remembered for ``delay`` of event time. The exact form is the anti-join of ingest_batch."""
    (at,) = free_names(messages.columns, "event_time")
    return messages.withColumn(at, F.col(time).cast("timestamp")).withWatermark(at, delay).dropDuplicatesWithinWatermark(["id"]).drop(at)

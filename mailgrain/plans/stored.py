"""Registered queries of what is stored and how: archives, .eml files, the store's buckets, rejects, reports, and searches of many questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates
from ..operators import ingest, resolve, review, senders
from ..operators.graph import cut
from ..sources import mail as mail_source
from ..sources import typed
from ..sources.store import Store
from ..streaming import ingest as streaming
from . import driver_mail as dm
from .queries import _DKIM, _FROM, ISO, as_of, iso, query, workspace

FOLDERS = ("F0", "F1", "F2")
SINCE = "2023-01-01T00:00:00Z"


@query("read_archive", "SELECT concat('F', event_id % 3) AS folder, count(*) AS n, min(event_id) AS low FROM events WHERE ts >= TIMESTAMP '2024-01-15' AND event_id % 3 <> 1 GROUP BY 1", views=False)
def _(spark, d):
    """An archive by folder and month, of which a window and two folders are read."""
    root = workspace(spark)
    mail_source.write_archive(dm.raw_mail(spark, d), root)
    rows = ingest.folder_filter(mail_source.read_archive(spark, root), ("F0", "F2"))
    return ingest.backfill_filter(rows, dates.instant("2024-01-15T00:00:00Z")).groupBy("folder").agg(F.count("*").alias("n"), F.min("uid").alias("low"))


@query("read_eml", f"SELECT concat('F', event_id % 3) AS folder, event_id AS uid, {_FROM} AS address, {_DKIM} AS domains, concat('Hello again ', event_id) AS subject FROM events", views=False)
def _(spark, d):
    """One .eml file for each event, in a folder of its own for each mail folder."""
    root = workspace(spark)
    mail_source.write_eml(dm.raw_mail(spark, d), root)
    parts = [mail_source.read_eml(spark, f"{root}/{f}", f) for f in FOLDERS]
    rows = mail_source.parsed_mail(parts[0].unionByName(parts[1]).unionByName(parts[2]))
    return rows.select("folder", "uid", F.col("from_address").alias("address"), F.array_join("dkim", ",").alias("domains"), "subject")


_WRITTEN = "CASE event_id % 8 WHEN 0 THEN '2024-02-30T10:00:00Z' WHEN 1 THEN 'yesterday' WHEN 2 THEN '' WHEN 3 THEN NULL ELSE concat('2024-01-0', 1 + event_id % 9, 'T10:00:00Z') END"
_SAID = "CASE event_id % 10 WHEN 0 THEN 'soon' WHEN 1 THEN '3 fortnights' WHEN 2 THEN '-2m' WHEN 3 THEN '0m' WHEN 4 THEN '3' WHEN 5 THEN ' ' WHEN 6 THEN '99999999999d' WHEN 7 THEN NULL WHEN 8 THEN 'Never' ELSE concat(1 + event_id % 9, ' Months') END"
_WHY = {
    "instant": "CASE event_id % 8 WHEN 0 THEN 'no such date or time' WHEN 1 THEN 'not an ISO-8601 instant' ELSE 'empty' END",
    "duration": "CASE event_id % 10 WHEN 3 THEN 'not positive' WHEN 5 THEN 'empty' WHEN 6 THEN 'too long' ELSE 'not a duration (use 3m, 45d, 1y or forever)' END",
}


def _read(spark, d):
    """Both columns read in one pass and written; rejects and rows are then read from what was written."""
    e = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("uid"), F.expr(_WRITTEN).alias("decided_at"), F.expr(_SAID).alias("hold"))
    root = workspace(spark)
    rows, rejects = typed.read_typed(e, {"decided_at": "instant", "hold": "duration"})
    rows.write.parquet(root)
    return spark.read.parquet(root), rejects


@query("parse_rejects", f"SELECT event_id AS uid, 'decided_at' AS \"column\", {_WRITTEN} AS value, {_WHY['instant']} AS reason FROM events WHERE event_id % 8 < 3 UNION ALL SELECT event_id, 'hold', {_SAID}, {_WHY['duration']} FROM events WHERE event_id % 10 < 7", views=False)
def _(spark, d):
    rows, rejects = _read(spark, d)
    return typed.rejected(rows, "uid", rejects)


@query("parse_accepted", f"SELECT event_id AS uid, CASE WHEN event_id % 8 > 3 THEN concat('2024-01-0', 1 + event_id % 9, 'T10:00:00.000Z') END AS decided_at, CASE WHEN event_id % 10 = 9 THEN CAST(1 + event_id % 9 AS INTEGER) END AS months, coalesce(event_id % 10 = 8, false) AS forever FROM events WHERE event_id % 8 > 2 AND event_id % 10 > 6", views=False)
def _(spark, d):
    rows, rejects = _read(spark, d)
    return typed.accepted(rows, rejects).select("uid", dates.to_iso(F.col("decided_at")).alias("decided_at"), "hold.months", F.coalesce("hold.forever", F.lit(False)).alias("forever"))


@query("sync_report", "SELECT CASE WHEN grouping(folder) = 0 THEN folder END AS folder, grouping(folder) = 1 AS total, count(*) AS examined, count(*) FILTER (event_type <> 'error') AS detected, count(*) FILTER (event_type <> 'error') AS recorded, count(*) FILTER (event_type IN ('signup', 'error')) AS bodies_fetched, CASE WHEN grouping(folder) = 0 THEN max(event_id) END AS last_uid, grouping(folder) = 1 OR folder = 'F1' AS uidvalidity_changed FROM (SELECT *, concat('F', event_id % 3) AS folder FROM events) GROUP BY GROUPING SETS ((folder), ())", views=False)
def _(spark, d):
    """Folders and totals; F1's mail has been numbered anew."""
    found = cut(ingest.detect_messages(dm.raw_mail(spark, d)))
    state = spark.sql("SELECT * FROM VALUES ('F0', 1L), ('F1', 7L) AS t(folder, uidvalidity)")
    counts = ("examined", "detected", "recorded", "bodies_fetched")
    return ingest.sync_report(found, ingest.dedupe_messages(ingest.as_messages(found)), state).select("folder", "total", *[F.col(c).cast("long").alias(c) for c in counts], "last_uid", "uidvalidity_changed")


@query("ingest_by_bucket", "SELECT concat('F', event_id % 3) AS folder, count(*) AS messages, (SELECT count(*) FROM events WHERE event_type <> 'error') AS stored FROM events WHERE event_type <> 'error' GROUP BY 1", views=False)
def _(spark, d):
    """Three batches, the second small and the third part of the first again; each reads and rewrites only the buckets that it meets."""
    root, raw = workspace(spark), dm.raw_mail(spark, d)
    for part in (raw.filter("uid % 100 <> 5"), raw.filter("uid % 100 = 5"), raw.filter("uid % 100 = 7")):
        streaming.ingest_batch(part, root, as_of(), dates.instant(SINCE), FOLDERS, by_watermark=False)
    rows = Store(spark, root).read("message")
    return rows.groupBy("folder").agg(F.count("*").alias("messages")).crossJoin(rows.agg(F.countDistinct("id").alias("stored")))  # one row


@query("store_compaction", f"SELECT id, sender_id, decision, strftime(decided_at, '{ISO}') AS decided_at FROM dec")
def _(spark, d):
    """Decisions appended in twelve batches, and merged whenever a bucket has more than four versions."""
    store, rows = Store(spark, workspace(spark), buckets=8), dm.decisions(spark, d)
    for k in range(12):
        change = store.change()
        change.append("decision", rows.filter(F.col("id") % 12 == k))
        change.commit()
        store.compact("decision", 4)
    store.clean()
    return store.read("decision").select("id", "sender_id", "decision", *iso("decided_at"))


@query("resolve_chain", "SELECT event_id // 1000 AS block, count(*) AS messages, 1 AS senders FROM events GROUP BY 1", views=False)
def _(spark, d):
    """Chains of a thousand messages, each tied to the one before by its list or its address: one sender each, in logarithmic rounds."""
    rows = spark.read.parquet(f"{d}/events.parquet").selectExpr("event_id AS ord", "event_id div 1000 AS block", "event_id % 1000 AS i")
    mail = rows.selectExpr("cast(ord AS string) AS id", "ord", "block", "concat('l', (i + 1) div 2, '.b', block) AS list_id", "concat('a', i div 2, '@b', block, '.example') AS from_address")
    known = spark.createDataFrame([], "sender_id string, kind string, value string")
    out = resolve.resolve_senders(mail, known).join(mail.select("id", "block"), "id")
    return out.groupBy("block").agg(F.count("*").alias("messages"), F.countDistinct("sender_id").cast("int").alias("senders"))


_NEEDLES = "SELECT DISTINCT right(c_name, 3) AS reference FROM customer"


@query("find_many", f"SELECT reference AS question, concat('c', c_custkey) AS sender_id FROM ({_NEEDLES}) JOIN customer ON lower(c_name) LIKE concat('%', reference, '%') OR starts_with(concat('c', c_custkey), reference) OR concat('key', c_custkey) = reference", views=False)
def _(spark, d):
    """Every ending of three characters is a question, answered from a written index."""
    c = spark.read.parquet(f"{d}/customer.parquet")
    people = c.select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.col("c_name").alias("display_name"), F.lit(None).cast("string").alias("display_address"))
    known = c.select(F.concat(F.lit("c"), "c_custkey").alias("sender_id"), F.lit("list_id").alias("kind"), F.concat(F.lit("key"), "c_custkey").alias("value"))
    root = workspace(spark)
    senders.gram_index(people).write.parquet(root)
    questions = c.select(F.expr("right(c_name, 3)").alias("reference")).distinct().select(F.col("reference").alias("question"), "reference")
    return senders.find_many(questions, people, known, spark.read.parquet(root))


@query("sender_detail_lists", f"""SELECT sender_id, 'identities' AS list, concat_ws('|', 'from_address', from_address) AS item FROM (SELECT DISTINCT sender_id, from_address FROM m)
UNION ALL SELECT dec.sender_id, 'history', concat_ws('|', id, decision, strftime(decided_at, '{ISO}'), coalesce(strftime(suppressed_until, '{ISO}'), '-')) FROM dec JOIN agg USING (sender_id)
UNION ALL SELECT att.sender_id, 'attempts', concat_ws('|', id, att.method, result, strftime(attempted_at, '{ISO}')) FROM att JOIN agg USING (sender_id)""")
def _(spark, d):
    """What the nested lists of ``sender_detail`` hold, item by item."""
    m = dm.messages(spark, d)
    known = m.select("sender_id", F.lit("from_address").alias("kind"), F.col("from_address").alias("value")).distinct()
    rows = review.sender_detail(m, known, dm.decisions(spark, d), dm.attempts(spark, d), as_of())
    items = {
        "identities": lambda x: F.concat_ws("|", x["kind"], x["value"]),
        "history": lambda x: F.concat_ws("|", x["id"], x["decision"], dates.to_iso(x["decided_at"]), F.coalesce(dates.to_iso(x["suppressed_until"]), F.lit("-"))),
        "attempts": lambda x: F.concat_ws("|", x["id"], x["method"], x["result"], dates.to_iso(x["attempted_at"])),
    }
    none = F.array().cast("array<struct<list:string,item:string>>")

    def listed(name: str):
        return F.coalesce(F.transform(name, lambda x: F.struct(F.lit(name).alias("list"), items[name](x).alias("item"))), none)

    return rows.select("sender_id", F.explode(F.concat(*[listed(name) for name in items])).alias("x")).select("sender_id", "x.*")

"""From raw mail to messages: windows and watermarks, detection with bodies only where needed, senders, deduplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import detect as signals
from ..functions import mime
from ..functions.dates import add_months
from ..functions.identity import registrable_domain
from ..functions.rules import DEFAULT_RULES, Rules
from ..functions.text import free_names
from ..sources.mail import parsed_mail

BACKFILL_MONTHS = 12


def folder_filter(mail: DataFrame, folders: tuple[str, ...] = ("INBOX",)) -> DataFrame:
    """Mail of the chosen folders, with their position in that list."""
    place = F.array_position(F.array(*[F.lit(f) for f in folders]), F.col("folder"))
    return mail.filter(F.col("folder").isin(*folders)).withColumn("folder_ord", place.cast("int"))


def default_since(as_of: Column, tz: str = "UTC") -> Column:
    return add_months(as_of, -BACKFILL_MONTHS, tz)


def backfill_filter(mail: DataFrame, since: Column) -> DataFrame:
    """Pushed down to the scan where ``since`` is a literal; of an archive by month, earlier months are never opened."""
    if "month" in mail.columns:
        mail = mail.filter((F.col("month") >= F.date_format(since, "yyyy-MM")) & (F.col("month") != "none"))
    return mail.filter(F.col("internal_date") >= since)


def incremental_filter(mail: DataFrame, sync_state: DataFrame, since: Column) -> DataFrame:
    """Rows not examined before: above the folder's watermark, or all after a new uidvalidity or a wider window.

    sync_state has one row per folder, so Spark broadcasts it by its own size check.
    """
    state = sync_state.select("folder", F.struct("uidvalidity", "last_uid", "backfill_since").alias("mark"))
    mark = F.col("mark")
    fresh = mark.isNull() | (mark["uidvalidity"] != F.col("uidvalidity")) | F.coalesce(mark["backfill_since"] > since, F.lit(False)) | (F.col("uid") > mark["last_uid"])
    return backfill_filter(mail, since).join(state, "folder", "left").filter(fresh).drop("mark")


def detect_parsed(rows: DataFrame, scrape_bodies: bool = True, rules: Rules = DEFAULT_RULES) -> DataFrame:
    """Parsed mail with its detection, tier by tier as columns of their own, so that nothing is computed twice.

    Only rows whose headers say nothing pass the body decoder; the others give it a null.
    """
    uris = signals.parse_list_unsubscribe(F.array_join(mime.header_all(F.col("headers"), "list-unsubscribe"), ", "))
    rows = rows.withColumn("by_head", signals.header_tiers(uris, signals.has_one_click_post(F.col("headers")))).withColumn("body_read", F.col("by_head").isNull() & F.lit(scrape_bodies))
    if scrape_bodies:
        rows = rows.withColumn("html", mime.html_part(mime.decode_parts(F.when(F.col("body_read"), F.col("raw")))))
        rows = rows.withColumn("by_body", signals.detect_body_link(F.col("html")))
        b = F.col("by_body")
        rows = rows.withColumn("by_body", F.when(b.isNotNull(), F.struct(F.lit("body_link").alias("method"), b["uri"].alias("uri"), b["confidence"].alias("confidence"), b["evidence"].alias("evidence"))))
        rows = rows.withColumn("best", F.coalesce("by_head", "by_body"))
    else:
        rows = rows.withColumn("best", F.col("by_head"))
    rows = rows.withColumn("target", signals.target_domain(F.col("best.uri"), rules)).withColumn("own", registrable_domain(F.when(F.col("target").isNotNull(), F.col("from_address")), rules))
    signed = F.exists("dkim", lambda d: F.coalesce(registrable_domain(d, rules) == F.col("target"), F.lit(False)))
    suspicious = F.when(F.col("target").isNull() | F.coalesce(F.col("own") == F.col("target"), F.lit(False)), False).otherwise(~signed)
    best = F.col("best")
    detection = F.struct(best["method"].alias("method"), best["uri"].alias("uri"), best["confidence"].alias("confidence"), best["evidence"].alias("evidence"), suspicious.alias("suspicious"))
    return rows.withColumn("detection", F.when(best.isNotNull(), detection)).drop("raw", "html", "by_head", "by_body", "best", "target", "own")


def detect_messages(mail: DataFrame, scrape_bodies: bool = True, rules: Rules = DEFAULT_RULES) -> DataFrame:
    """Raw mail, parsed and with its detection."""
    return detect_parsed(parsed_mail(mail), scrape_bodies, rules)


def with_signal(detected: DataFrame) -> DataFrame:
    """Rows that have a detection. Exploded, not filtered: the optimiser would push a filter below and compute all tiers twice."""
    found = F.explode(F.filter(F.array("detection"), lambda d: d.isNotNull())).alias("detection")
    return detected.select(*[F.col(c) for c in detected.columns if c != "detection"], found)


def as_messages(detected: DataFrame, ingested_at: Column | None = None) -> DataFrame:
    """Rows of the message table, still without senders; rows without a signal go."""
    d = F.col("detection")
    extra = [F.col("folder_ord")] if "folder_ord" in detected.columns else []
    return with_signal(detected).select(
        "id", "folder", "uidvalidity", "uid", "received_at", "subject", "from_name", "from_address", "list_id", "dkim", d["method"].alias("method"), d["confidence"].alias("confidence"),
        d["uri"].alias("unsubscribe_uri"), d["suspicious"].alias("suspicious"), (ingested_at if ingested_at is not None else F.lit(None).cast("timestamp_ntz")).alias("ingested_at"), *extra,
    )


def dedupe_messages(messages: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """One row per message key, the first by folder position and uid; keys already stored are left out."""
    place, (n,) = [c for c in ("folder_ord", "folder", "uid") if c in messages.columns], free_names(messages.columns, "n")
    rows = messages.withColumn(n, F.row_number().over(Window.partitionBy("id").orderBy(*place))).filter(F.col(n) == 1).drop(n)
    return rows if stored is None else rows.join(stored.select("id"), "id", "left_anti")


def sender_touch(messages: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """First and last seen, and the name and address of the newest message that has one, of each sender, together with what is stored.

    ``name_at`` and ``address_at`` are the instants of those messages, so that an old batch that comes late doesn't win.
    """
    order = F.struct("received_at", *[c for c in ("folder_ord", "uid") if c in messages.columns])

    def newest(c: str) -> Column:
        return F.max_by(F.struct(F.col(c).alias("value"), F.col("received_at").alias("at")), F.when(F.col(c).isNotNull(), order))

    new = messages.groupBy(F.col("sender_id").alias("id")).agg(F.min("received_at").alias("first_seen_at"), F.max("received_at").alias("last_seen_at"), newest("from_name").alias("name"), newest("from_address").alias("address"))
    if stored is not None:
        old = stored.select("id", F.struct("first_seen_at", "last_seen_at", F.struct(F.col("display_name").alias("value"), F.col("name_at").alias("at")).alias("name"), F.struct(F.col("display_address").alias("value"), F.col("address_at").alias("at")).alias("address")).alias("old"))

        def later(c: str) -> Column:
            return F.when(F.col(c).isNull() | (F.col("old")[c]["at"] > F.col(c)["at"]), F.col("old")[c]).otherwise(F.col(c))

        new = old.join(new, "id", "full").select("id", F.least("old.first_seen_at", "first_seen_at").alias("first_seen_at"), F.greatest("old.last_seen_at", "last_seen_at").alias("last_seen_at"), later("name").alias("name"), later("address").alias("address"))
    return new.select("id", "first_seen_at", "last_seen_at", F.col("name.value").alias("display_name"), F.col("name.at").alias("name_at"), F.col("address.value").alias("display_address"), F.col("address.at").alias("address_at"))


def advance_watermark(examined: DataFrame, stored: DataFrame | None, since: Column, as_of: Column) -> DataFrame:
    """New sync_state rows of the folders examined: the highest uid of the highest uidvalidity, which numbers a folder's mail anew.

    Write it after the messages: a crash then repeats work and leaves no gap.
    """
    now = examined.groupBy("folder").agg(F.max(F.struct("uidvalidity", F.col("uid").alias("last_uid"))).alias("now"))
    if stored is None:
        return now.select("folder", "now.*", as_of.alias("last_synced_at"), since.alias("backfill_since"))
    old = stored.select("folder", F.struct("uidvalidity", "last_uid").alias("old"), F.col("backfill_since").alias("old_since"))
    both = now.join(old, "folder", "left").withColumn("mark", F.greatest("now", "old"))
    kept = F.col("old.uidvalidity") == F.col("mark.uidvalidity")
    return both.select("folder", "mark.*", as_of.alias("last_synced_at"), F.when(kept, F.least(since, F.col("old_since"))).otherwise(since).alias("backfill_since"))


def sync_summary(detected: DataFrame, recorded: DataFrame, sync_state: DataFrame | None = None) -> DataFrame:
    """Per folder: examined, detected, recorded, bodies read, last uid, and whether its uidvalidity changed."""
    return sync_report(detected, recorded, sync_state).filter("NOT total").drop("total", "uidvalidity")


def sync_report(detected: DataFrame, recorded: DataFrame, sync_state: DataFrame | None = None) -> DataFrame:
    """The folders and, as one more row whose ``total`` is true and whose folder is null, all of them together: both levels of one aggregation.

    Examined and recorded mail are counted in one pass by grouping sets. The total has no last uid, and its uidvalidity has changed if any folder's has.
    A null folder among the mail is a row of its own, told from the total by ``total``. Without mail there are no rows.
    """
    seen = detected.select("folder", "uid", "uidvalidity", F.lit(1).alias("examined"), F.col("detection").isNotNull().cast("int").alias("detected"), F.lit(0).alias("recorded"), F.col("body_read").cast("int").alias("bodies_fetched"))
    none = [F.lit(None).cast("long").alias(c) for c in ("uid", "uidvalidity")]
    new = recorded.select("folder", *none, F.lit(0).alias("examined"), F.lit(0).alias("detected"), F.lit(1).alias("recorded"), F.lit(0).alias("bodies_fetched"))
    counts = ("examined", "detected", "recorded", "bodies_fetched")
    by_folder = seen.unionByName(new).groupingSets([["folder"], []], "folder").agg(
        F.grouping("folder").cast("boolean").alias("total"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counts], F.max("uid").alias("last_uid"), F.max("uidvalidity").alias("uidvalidity"),
    )
    total = F.col("total")
    out = by_folder.withColumn("last_uid", F.when(~total, F.col("last_uid")))
    if sync_state is None:
        return out.withColumn("uidvalidity_changed", F.lit(False))
    # A row a folder: small beside the mail, and joined before the total looks at all of them.
    old = sync_state.select(F.col("folder").alias("known"), F.col("uidvalidity").alias("before"))
    out = out.join(old, F.col("folder").eqNullSafe(F.col("known")) & ~total, "left")
    out = out.withColumn("uidvalidity_changed", F.coalesce(F.col("before") != F.col("uidvalidity"), F.lit(False)) & ~total).drop("known", "before")
    changed = out.agg(F.coalesce(F.max("uidvalidity_changed"), F.lit(False)).alias("any"))  # one row
    return out.crossJoin(changed).withColumn("uidvalidity_changed", F.when(total, F.col("any")).otherwise(F.col("uidvalidity_changed"))).drop("any")


def summary_totals(summary: DataFrame) -> DataFrame:
    return summary.agg(*[F.sum(c).alias(c) for c in ("examined", "detected", "recorded", "bodies_fetched")])

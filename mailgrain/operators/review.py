"""Review, kept and follow-up tables, and the plan of what to do for a sender."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates
from ..functions.detect import parse_mailto
from . import decisions as log
from .senders import aggregate_senders

STILL_SENDING_DAYS = 10


def build_review(aggregates: DataFrame, decisions: DataFrame, as_of: Column, include_suppressed: bool = False, limit: int | None = None, tz: str = "UTC") -> DataFrame:
    """Senders to decide on, most mail first, then the latest seen; sender_id settles ties. With ``limit`` a top-k, no full sort."""
    rows = log.suppression_status(aggregates, decisions, as_of, tz)
    if not include_suppressed:
        rows = rows.filter(log.is_reviewable(F.col("state")))
    rows = rows.withColumn("returning_tag", log.returning_tag(F.col("state"), F.col("decided_at"), F.col("until"), tz))
    rows = rows.orderBy(F.desc("message_count"), F.desc("last_seen"), "sender_id")
    return rows.limit(limit) if limit is not None else rows


def hidden_count(aggregates: DataFrame, decisions: DataFrame, as_of: Column) -> DataFrame:
    """How many senders a keep hides, before any filter or limit."""
    rows = log.suppression_status(aggregates, decisions, as_of)
    return rows.agg(F.count_if(log.is_hidden_by_keep(F.col("state"))).alias("hidden"))


def build_kept(aggregates: DataFrame, decisions: DataFrame, as_of: Column, tz: str = "UTC") -> DataFrame:
    """Held senders, the soonest to return first, those kept forever last."""
    rows = log.suppression_status(aggregates, decisions, as_of, tz).filter(log.is_hidden_by_keep(F.col("state")))
    rows = rows.withColumn("returns", log.return_description(F.col("state"), F.col("until"), F.col("days_remaining"), tz))
    return rows.orderBy(F.col("days_remaining").asc_nulls_last(), "sender_id")


def sender_label(name: Column, address: Column, sender_id: Column) -> Column:
    return F.coalesce(F.when(name != "", name), F.when(address != "", address), F.substring(sender_id, 1, 8))


def method_label(method: Column) -> Column:
    return F.when(method == "one_click", "one-click").when(method == "http_link", "link").when(method == "mailto", "mailto").when(method == "body_link", "body link").otherwise("none")


def mailbox_status(aggregates: DataFrame, decisions: DataFrame, as_of: Column, sync_state: DataFrame | None = None) -> DataFrame:
    """One row: senders, messages, awaiting a decision, hidden by a keep; with ``sync_state`` also each folder's watermark, by folder."""
    rows = log.suppression_status(aggregates, decisions, as_of)
    state = F.col("state")
    out = rows.agg(F.count("*").alias("senders"), F.coalesce(F.sum("message_count"), F.lit(0)).alias("messages"), F.count_if(log.is_reviewable(state)).alias("awaiting"), F.count_if(log.is_hidden_by_keep(state)).alias("hidden"))
    if sync_state is None:
        return out
    return out.crossJoin(sync_state.agg(F.sort_array(F.collect_list(F.struct("folder", "uidvalidity", "last_uid", "last_synced_at"))).alias("folders")))  # one row with one row


def latest_attempt(attempts: DataFrame) -> DataFrame:
    newest = F.max_by(F.struct("id", "method", "attempted_at", "result", "target_uri"), F.struct("attempted_at", "id"))
    return attempts.groupBy("sender_id").agg(newest.alias("a")).select("sender_id", F.col("a.id").alias("attempt_id"), F.col("a.method").alias("attempt_method"), "a.attempted_at", "a.result", "a.target_uri")


def still_sending(aggregates: DataFrame, attempts: DataFrame, days: int = STILL_SENDING_DAYS) -> DataFrame:
    """Senders whose last attempt succeeded and that were seen strictly later than ``days`` times 24 hours after it."""
    last = latest_attempt(attempts).filter("result = 'success'")
    return aggregates.join(last, "sender_id").filter(F.col("last_seen") > dates.add_days(F.col("attempted_at"), days))


def mail_after_attempt(messages: DataFrame, attempts: DataFrame, days: int = STILL_SENDING_DAYS) -> DataFrame:
    """The same in detail: number and time of the messages received after the grace days. Sender equality joins, the band filters."""
    last = latest_attempt(attempts).filter("result = 'success'").select("sender_id", "attempted_at")
    late = messages.select("sender_id", "received_at").join(last, "sender_id").filter(F.col("received_at") > dates.add_days(F.col("attempted_at"), days))
    return late.groupBy("sender_id", "attempted_at").agg(F.count("*").alias("messages_after"), F.max("received_at").alias("latest"))


def pending_follow_ups(aggregates: DataFrame, attempts: DataFrame) -> DataFrame:
    """Senders whose page was opened and whose outcome nobody has told."""
    return aggregates.join(latest_attempt(attempts).filter("result = 'pending_manual'"), "sender_id")


def follow_ups(aggregates: DataFrame, attempts: DataFrame) -> DataFrame:
    """Both kinds in one table."""
    pending = pending_follow_ups(aggregates, attempts).withColumn("kind", F.lit("pending_manual"))
    return pending.unionByName(still_sending(aggregates, attempts).withColumn("kind", F.lit("still_sending")))


def unsubscribe_plan(aggregates: DataFrame, as_of: Column, confirm_suspicious: bool = False) -> DataFrame:
    """The action for each sender, in place of doing it: a POST, a page for a person, a mail, or nothing. Row-local."""
    mail = parse_mailto(F.col("unsubscribe_uri"))
    skip = F.col("suspicious") & F.lit(not confirm_suspicious)
    method = F.col("method")
    result = F.when(skip, "skipped_suspicious").when(method == "one_click", "planned_post").when(method.isin("http_link", "body_link"), "pending_manual").when(mail.isNotNull(), "planned_mail").otherwise("failed")
    rows = aggregates.filter("method IS NOT NULL AND unsubscribe_uri IS NOT NULL").withColumn("result", result)
    return rows.select(
        "sender_id", "method", as_of.alias("attempted_at"), "result", F.col("unsubscribe_uri").alias("target_uri"),
        F.when(F.col("result") == "planned_post", "List-Unsubscribe=One-Click").alias("post_body"), F.when(F.col("result") == "planned_mail", mail).alias("mail"),
        F.when(F.col("result") == "failed", "Unparseable mailto URI").alias("error"),
    )


def sender_detail(messages: DataFrame, identities: DataFrame, decisions: DataFrame, attempts: DataFrame, as_of: Column, sender_ids: list[str] | None = None) -> DataFrame:
    """Aggregates, status, identities, decisions and attempts of each sender, one row each."""
    if sender_ids is not None:
        messages, identities, decisions, attempts = (t.filter(F.col("sender_id").isin(*sender_ids)) for t in (messages, identities, decisions, attempts))
    rows = log.suppression_status(aggregate_senders(messages), decisions, as_of)
    known = identities.groupBy("sender_id").agg(F.sort_array(F.collect_list(F.struct("kind", "value"))).alias("identities"))
    tries = attempts.groupBy("sender_id").agg(F.sort_array(F.collect_list(F.struct("attempted_at", "id", "method", "result"))).alias("attempts"))
    return rows.join(known, "sender_id", "left").join(log.decision_history(decisions), "sender_id", "left").join(tries, "sender_id", "left")

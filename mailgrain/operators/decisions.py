"""The decision log: rows to append, its projection to a status, and the sentences about it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates

REVIEWABLE = ("never_decided", "returning", "unsuppressed")
HIDDEN = ("suppressed", "suppressed_forever")


def keep_decisions(senders: DataFrame, as_of: Column, months: int | None = 3, days: int | None = None, tz: str = "UTC", note: str | None = None) -> DataFrame:
    """Keep rows for senders; neither months nor days means forever."""
    until = dates.add_months(as_of, months, tz) if months else dates.add_days(as_of, days) if days else F.lit(None).cast("timestamp_ntz")
    return _rows(senders, "keep", as_of, until, note)


def unsubscribe_decisions(attempts: DataFrame, as_of: Column, note: str | None = None) -> DataFrame:
    """For every attempt that was made; a skipped one leaves its sender on the review list."""
    return _rows(attempts.filter("result <> 'skipped_suspicious'"), "unsubscribe", as_of, F.lit(None).cast("timestamp_ntz"), note)


def unsuppress_decisions(status: DataFrame, as_of: Column, note: str | None = None) -> DataFrame:
    """Only for senders that are held now."""
    return _rows(status.filter(is_hidden_by_keep(F.col("state"))), "unsuppress", as_of, F.lit(None).cast("timestamp_ntz"), note)


def _rows(senders: DataFrame, decision: str, as_of: Column, until: Column, note: str | None) -> DataFrame:
    return senders.select("sender_id", F.lit(decision).alias("decision"), as_of.alias("decided_at"), until.alias("suppressed_until"), F.lit(note).cast("string").alias("note"))


def latest_decision(decisions: DataFrame) -> DataFrame:
    """The newest decision of each sender, then the highest id: one aggregation with partial maxima."""
    newest = F.max_by(F.struct("id", "decision", "decided_at", "suppressed_until", "note"), F.struct("decided_at", "id"))
    return decisions.groupBy("sender_id").agg(newest.alias("d")).select("sender_id", "d.*")


def decision_history(decisions: DataFrame) -> DataFrame:
    """The log of each sender, oldest first."""
    entry = F.struct("decided_at", "id", "decision", "suppressed_until", "note")
    return decisions.groupBy("sender_id").agg(F.sort_array(F.collect_list(entry)).alias("history"))


def suppression_status(senders: DataFrame, decisions: DataFrame, as_of: Column, tz: str = "UTC") -> DataFrame:
    """``senders`` with state, decided_at, until and days_remaining at the instant ``as_of``."""
    last = latest_decision(decisions).select("sender_id", F.col("decision").alias("__d"), "decided_at", F.col("suppressed_until").alias("__u"))
    d, until = F.col("__d"), F.col("__u")
    state = (
        F.when(d.isNull(), "never_decided").when(d == "unsubscribe", "unsubscribed").when(d == "unsuppress", "unsuppressed")
        .when(until.isNull(), "suppressed_forever").when(until > as_of, "suppressed").otherwise("returning")
    )
    out = senders.join(last, "sender_id", "left").withColumn("state", state)
    held = F.col("state").isin("suppressed", "returning")
    return out.withColumn("until", F.when(held, until)).withColumn("days_remaining", F.when(F.col("state") == "suppressed", dates.days_until(as_of, until, tz))).drop("__d", "__u")


def is_reviewable(state: Column) -> Column:
    return state.isin(*REVIEWABLE)


def is_hidden_by_keep(state: Column) -> Column:
    return state.isin(*HIDDEN)


# The sentences below must read exactly so.
def keep_confirmation(name: Column, until: Column, tz: str = "UTC") -> Column:
    return F.when(until.isNull(), F.concat(F.lit("Keeping "), name, F.lit(". Won't ask again."))).otherwise(F.concat(F.lit("Keeping "), name, F.lit(". Won't ask again until "), dates.format_date(until, tz), F.lit(".")))


def return_description(state: Column, until: Column, days: Column, tz: str = "UTC") -> Column:
    on = F.concat(F.lit(" ("), dates.format_date(until, tz), F.lit(")"))
    soon = F.when(days <= 0, F.concat(F.lit("Returns today"), on)).otherwise(F.concat(F.lit("Returns in "), dates.counted(days, "day"), on))
    return F.when(state == "suppressed_forever", "Never returns (kept forever)").when(state == "suppressed", soon).otherwise("Returns now")


def returning_tag(state: Column, decided_at: Column, until: Column, tz: str = "UTC") -> Column:
    text = F.concat(F.lit("Returning — you kept this on "), dates.format_date(decided_at, tz), F.lit("; the "), dates.hold_length(decided_at, until, tz), F.lit(" hold has expired."))
    return F.when(state == "returning", text)


def hidden_footer(n: Column, command: str) -> Column:
    """``command`` is how the caller names its view of kept senders."""
    some = F.concat(dates.counted(n, "sender"), F.lit(f" hidden — kept within the last 3 months. Run '{command}' to see them and their return dates."))
    return F.when(n == 0, f"No senders hidden. Run `{command}` to see past decisions.").otherwise(some)


def status_description(state: Column, decided_at: Column, until: Column, days: Column, tz: str = "UTC") -> Column:
    on = dates.format_date(decided_at, tz)
    return (
        F.when(state == "never_decided", "never decided on")
        .when(state == "suppressed", F.concat(F.lit("kept on "), on, F.lit("; "), F.lower(return_description(state, until, days, tz))))
        .when(state == "suppressed_forever", F.concat(F.lit("kept forever on "), on))
        .when(state == "returning", F.concat(F.lit("kept on "), on, F.lit("; hold expired "), dates.format_date(until, tz)))
        .when(state == "unsubscribed", F.concat(F.lit("unsubscribed on "), on))
        .otherwise(F.concat(F.lit("hold ended early on "), on))
    )

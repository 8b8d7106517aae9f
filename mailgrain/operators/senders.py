"""Sender aggregation, merges, identity matching and search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.identity import RESOLVING, is_resolving
from ..functions.text import free_names, trim


def _rank():
    return F.struct("confidence", "received_at", "id")


def best_method_per_sender(messages: DataFrame) -> DataFrame:
    """Method, confidence, uri and flag of each sender's most confident, then newest message; one aggregation, no window."""
    best = F.max_by(F.struct("method", "confidence", "unsubscribe_uri", "suspicious"), _rank())
    return messages.groupBy("sender_id").agg(best.alias("b")).select("sender_id", "b.*")


def aggregate_senders(messages: DataFrame, senders: DataFrame | None = None) -> DataFrame:
    """Count, first and last seen and best method of each surviving sender; messages pass one shuffle, already counted.

    Without ``senders`` the display fields come from the messages themselves, newest first.
    """
    best = F.max_by(F.struct("method", "confidence", "unsubscribe_uri", "suspicious"), _rank()).alias("b")
    aggs = [F.count("*").alias("message_count"), F.min("received_at").alias("first_seen"), F.max("received_at").alias("last_seen"), best]
    if senders is None:
        newest = F.struct("received_at", "id")
        aggs += [F.max_by("from_name", F.when(F.col("from_name").isNotNull(), newest)).alias("display_name"), F.max_by("from_address", F.when(F.col("from_address").isNotNull(), newest)).alias("display_address")]
    rows = messages.groupBy("sender_id").agg(*aggs)
    if senders is not None:
        alive = senders.filter("merged_into IS NULL").select(F.col("id").alias("sender_id"), "display_name", "display_address")
        rows = alive.join(rows, "sender_id")
    return rows.select(
        "sender_id", "display_name", "display_address", "message_count", "first_seen", "last_seen", F.col("b.method").alias("method"),
        F.coalesce("b.confidence", F.lit(0.0)).alias("confidence"), F.col("b.unsubscribe_uri").alias("unsubscribe_uri"), F.coalesce("b.suspicious", F.lit(False)).alias("suspicious"),
    )


def count_for_sender(messages: DataFrame) -> DataFrame:
    return messages.groupBy("sender_id").agg(F.count("*").alias("message_count"))


def total_messages(messages: DataFrame) -> DataFrame:
    return messages.agg(F.count("*").alias("total"))


def method_distribution(messages: DataFrame) -> DataFrame:
    return messages.groupBy("method").agg(F.count("*").alias("messages"))


def find_matches(candidates: DataFrame, identities: DataFrame, merges: DataFrame | None = None) -> DataFrame:
    """Known senders that own candidate keys, after merges: (message_id, kind, value, sender_id). DKIM domains never match."""
    own = identities.filter(is_resolving(F.col("kind"))).select("kind", "value", "sender_id")
    hit = candidates.filter(is_resolving(F.col("kind"))).join(own, ["kind", "value"])
    return effective_sender(hit, merges) if merges is not None else hit


def priority(kind=None):
    kind = F.col("kind") if kind is None else kind
    return F.array_position(F.array(*[F.lit(k) for k in RESOLVING]), kind)


def resolve_known(candidates: DataFrame, identities: DataFrame, merges: DataFrame | None = None) -> DataFrame:
    """Against a fixed identity table: message_id, outcome (new, existing, ambiguous), sender_id and the other senders matched."""
    hits = find_matches(candidates, identities, merges)
    found = hits.groupBy("message_id").agg(F.min_by("sender_id", priority()).alias("sender_id"), F.collect_set("sender_id").alias("all"))
    every = candidates.select("message_id").distinct().join(found, "message_id", "left")
    others = F.array_sort(F.array_except("all", F.array("sender_id")))
    outcome = F.when(F.col("sender_id").isNull(), "new").when(F.size("all") > 1, "ambiguous").otherwise("existing")
    return every.select("message_id", outcome.alias("outcome"), "sender_id", F.when(F.col("all").isNotNull(), others).alias("also_matched"))


def new_identities(found: DataFrame, stored: DataFrame) -> DataFrame:
    """Insert-or-ignore: a resolving key belongs to one sender, the first; a DKIM domain is stored once a sender."""
    resolving = found.filter(is_resolving(F.col("kind"))).join(stored.select("kind", "value"), ["kind", "value"], "left_anti")
    resolving = resolving.groupBy("kind", "value").agg(F.min(F.struct("ord", "sender_id")).alias("first")).select("first.sender_id", "kind", "value")
    dkim = found.filter(~is_resolving(F.col("kind"))).select("sender_id", "kind", "value").distinct()
    return resolving.unionByName(dkim.join(stored.select("sender_id", "kind", "value"), ["sender_id", "kind", "value"], "left_anti"))


def renormalize(stored: DataFrame, recomputed: DataFrame) -> DataFrame:
    """Identities after a rule change: keys are only added, for the sender that has them; no owner changes."""
    return stored.select("sender_id", "kind", "value").unionByName(new_identities(recomputed, stored))


def merge_rows(pairs: DataFrame, as_of, note: str | None = None) -> DataFrame:
    """Rows to append for merges: (source_id, target_id), a sender never into itself."""
    return pairs.filter("source_id <> target_id").select("source_id", "target_id", as_of.alias("merged_at"), F.lit(True).alias("active"), F.lit(note).cast("string").alias("note"))


def split_rows(sources: DataFrame, merges: DataFrame, as_of, note: str = "split") -> DataFrame:
    """Rows to append to undo merges: the last target of each source, inactive."""
    last = merges.groupBy("source_id").agg(F.max_by("target_id", "id").alias("target_id"))
    return sources.select("source_id").distinct().join(last, "source_id").select("source_id", "target_id", as_of.alias("merged_at"), F.lit(False).alias("active"), F.lit(note).alias("note"))


def active_merges(merges: DataFrame) -> DataFrame:
    """The latest row of each source, if it is active: (source_id, target_id)."""
    last = merges.groupBy("source_id").agg(F.max_by(F.struct("target_id", "active"), "id").alias("m"))
    return last.filter("m.active AND m.target_id <> source_id").select("source_id", F.col("m.target_id").alias("target_id"))


def resolve_merge_target(merges: DataFrame, rounds: int = 6) -> DataFrame:
    """(source_id, target_id) with chains followed to their end by pointer doubling: 2**rounds hops; members of a cycle stay themselves."""
    now = active_merges(merges)
    for _ in range(rounds):
        ahead = now.select(F.col("source_id").alias("via"), F.col("target_id").alias("end"))
        now = now.join(ahead, F.col("target_id") == F.col("via"), "left").select("source_id", F.coalesce("end", "target_id").alias("target_id"))
    ends = now.join(active_merges(merges).select(F.col("source_id").alias("still")), F.col("target_id") == F.col("still"), "left")
    return ends.select("source_id", F.when(F.col("still").isNull(), F.col("target_id")).otherwise(F.col("source_id")).alias("target_id"))


def effective_sender(df: DataFrame, merges: DataFrame) -> DataFrame:
    """``df`` with sender_id after merges. Rows keep their first sender in storage, so a split is exact."""
    source, target = free_names(df.columns, "source_id", "target_id")
    to = resolve_merge_target(merges).select(F.col("source_id").alias(source), F.col("target_id").alias(target))
    joined = df.join(to, F.col("sender_id") == F.col(source), "left")
    return joined.withColumn("sender_id", F.coalesce(target, "sender_id")).drop(source, target)


def find_senders(reference: str, senders: DataFrame, identities: DataFrame, aggregates: DataFrame, merges: DataFrame | None = None) -> DataFrame:
    """Senders whose id starts with the text, that own it as an identity, or whose name or address holds it; merges followed."""
    needle = reference.strip().lower()
    if not needle:
        return aggregates.limit(0)
    name, address = (F.lower(F.coalesce(c, F.lit(""))) for c in ("display_name", "display_address"))
    by_sender = senders.filter(F.lower("id").startswith(needle) | name.contains(needle) | address.contains(needle)).select(F.col("id").alias("sender_id"))
    by_identity = identities.filter(F.lower("value") == needle).select("sender_id")
    found = by_sender.union(by_identity)
    if merges is not None:
        found = effective_sender(found, merges)
    return aggregates.join(found.distinct(), "sender_id", "left_semi")


# -- many searches at once -------------------------------------------------------------------------------------------------------


def grams(text, sizes=(1, 2, 3)):
    """The distinct runs of one, two and three characters of a text."""

    def runs(n: int):
        each = F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda i: F.substring(text, i, F.lit(n)))
        return F.when(F.length(text) >= n, each).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.concat(*[runs(n) for n in sizes]))


def gram_index(senders: DataFrame) -> DataFrame:
    """(gram, sender_id) of each sender's name and address, in lower case, sorted by gram: to be written, so that a gram's senders lie together."""
    shown = F.array(*[F.lower(F.coalesce(c, F.lit(""))) for c in ("display_name", "display_address")])
    rows = senders.select(F.col("id").alias("sender_id"), F.explode(F.array_distinct(F.flatten(F.transform(shown, lambda text: grams(text))))).alias("gram"))
    return rows.select("gram", "sender_id").repartitionByRange("gram", "sender_id").sortWithinPartitions("gram", "sender_id")


def find_many(questions: DataFrame, senders: DataFrame, identities: DataFrame, index: DataFrame, merges: DataFrame | None = None) -> DataFrame:
    """(question, sender_id) for (question, reference): what ``find_senders`` finds for each reference, many in one job.

    Of a reference's runs of three characters (or of itself, where it is shorter) the rarest is looked up in the index, and only the senders that
    have it are compared with the reference. A reference with a run that no sender has finds nothing by name. Empty ones find nothing.
    """
    needle = F.lower(trim(F.col("reference")))
    asked = questions.select("question", needle.alias("needle")).filter("needle <> ''")
    parts = F.when(F.length("needle") < 3, F.array("needle")).otherwise(F.filter(grams(F.col("needle"), (3,)), lambda g: g != ""))
    wanted = asked.select("needle").distinct().select("needle", F.explode(parts).alias("gram"))
    known = index.join(wanted.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("n"))
    rarest = wanted.join(known, "gram", "left").groupBy("needle").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"))
    name, address = (F.lower(F.coalesce(c, F.lit(""))) for c in ("display_name", "display_address"))
    shown = senders.select(F.col("id").alias("sender_id"), name.alias("name"), address.alias("address"))
    near = rarest.join(index, "gram").join(shown, "sender_id").filter(F.contains("name", F.col("needle")) | F.contains("address", F.col("needle"))).select("needle", "sender_id")
    by_value = asked.select("needle").distinct().join(identities.select(F.lower("value").alias("needle"), "sender_id"), "needle")
    # An id is asked for by its beginning: it is cut at the lengths asked for, of which there are no more than the longest id has characters.
    longest = senders.agg(F.max(F.length("id"))).first()[0] or 0
    lengths = [r[0] for r in asked.select(F.length("needle").alias("n")).filter(F.col("n") <= longest).distinct().collect()]
    low = F.lower("id")
    cut_at = F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n <= F.length(low))
    starts = senders.select(F.col("id").alias("sender_id"), F.explode(F.transform(cut_at, lambda n: F.substring(low, F.lit(1), n))).alias("needle"))
    by_id = asked.select("needle").distinct().join(starts, "needle")
    found = near.unionByName(by_value).unionByName(by_id)
    if merges is not None:
        found = effective_sender(found, merges)
    return asked.join(found.distinct(), "needle").select("question", "sender_id").distinct()

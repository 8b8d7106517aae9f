"""Cold sender resolution: what a sequential pass over the mail would decide, without one.

The first message that uses a key owns it, and a message goes to the owner of its best key (list_id, from_address,
normalized_key); it claims its free keys and never takes an owned one. Only the distinct (list, address, key) tuples and the order of
their first use matter.

A tuple claims all its free keys, so whoever uses a key first owns it, unless it was stored before. Whether a key is free to a tuple is then
known without deciding anything: it is not stored, and no earlier tuple has it. So each tuple has at most one other to follow, the first user of its
best key that is not free; one whose keys are all free is a new sender. These pointers form a forest, and pointer doubling finds
every root in as many rounds as the logarithm of the longest chain. No group of tuples is ever in one task's hands; a key that very many
tuples share meets one row, its first user, in a join whose hot part Spark splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.identity import RESOLVING, normalize_list_id, normalized_key, split_address
from ..functions.rules import DEFAULT_RULES, Rules
from ..functions.text import let
from .graph import cut

NAMED = ("list_key", "address_key", "norm_key")


def message_keys(messages: DataFrame, rules: Rules = DEFAULT_RULES) -> DataFrame:
    """Adds list_key, address_key and norm_key to messages with id, list_id and from_address."""
    whole = let(split_address(F.col("from_address")), lambda x: F.when(x.isNotNull(), F.concat(x["local"], F.lit("@"), x["domain"])))
    return messages.withColumns({
        "list_key": normalize_list_id(F.col("list_id")),
        "address_key": whole,
        "norm_key": normalized_key(F.col("list_id"), F.col("from_address"), rules)["key"],
    })


def sender_key(mailbox: str, key):
    """Stored once when a sender is created, and never recomputed, so that a rule change can't move it."""
    return F.sha2(F.concat_ws("\x1f", F.lit(mailbox), key), 256)


def tuple_key(named: list[str]):
    """128 bits of a tuple of keys, so that no two of very many are taken for one."""
    return F.unhex(F.md5(F.concat_ws("\x1f", *[F.coalesce(c, F.lit("\x00")) for c in named])))


def decide(tuples: DataFrame) -> DataFrame:
    """(tuple, sender_id, outcome, also_matched) for tuples with first_ord, new_id, their keys, and each key's stored owner in own_<key>."""
    rows = cut(tuples.select("tuple", "first_ord", "new_id", *NAMED, *[f"own_{c}" for c in NAMED]))
    for c in NAMED:
        free = rows.filter(F.col(c).isNotNull() & F.col(f"own_{c}").isNull())
        first = cut(free.groupBy(c).agg(F.min(F.struct("first_ord", "tuple"))["tuple"].alias(f"first_{c}")))
        rows = rows.join(first, c, "left")
    taken = {c: F.when(F.col(f"first_{c}") != F.col("tuple"), F.col(f"first_{c}")) for c in NAMED}  # an earlier tuple has the key
    rows = rows.withColumns({f"first_{c}": F.when(F.col(f"own_{c}").isNull(), taken[c]) for c in NAMED})
    target = [F.when(F.coalesce(F.col(f"own_{c}").isNotNull() | F.col(f"first_{c}").isNotNull(), F.lit(False)), F.struct(F.col(f"own_{c}").alias("sender"), F.col(f"first_{c}").alias("to"))) for c in NAMED]
    rows = cut(rows.withColumn("follows", F.coalesce(*target)).drop("first_ord", *NAMED))
    senders = follow(rows.select("tuple", F.coalesce("follows.sender", F.when(F.col("follows").isNull(), F.col("new_id"))).alias("sender_id"), F.col("follows.to").alias("to")))

    out = rows.join(senders, "tuple")
    for c in NAMED:
        owner = senders.select(F.col("tuple").alias("by"), F.col("sender_id").alias("claimed"))
        out = out.join(owner, F.col(f"first_{c}") == F.col("by"), "left").withColumn(f"own_{c}", F.coalesce(f"own_{c}", "claimed")).drop("by", "claimed")
    owned = F.array_distinct(F.filter(F.array(*[F.col(f"own_{c}") for c in NAMED]), lambda o: o.isNotNull()))
    others = F.array_sort(F.array_except(owned, F.array("sender_id")))
    outcome = F.when(F.col("follows").isNull(), "new").when(F.size(others) > 0, "ambiguous").otherwise("existing")
    return out.select("tuple", "sender_id", outcome.alias("outcome"), others.alias("also_matched"))


def follow(rows: DataFrame) -> DataFrame:
    """(tuple, sender_id) for (tuple, sender_id, to): those without a sender get that of the tuple they lead to, by pointer doubling."""
    now = cut(rows)
    while True:
        open_ = now.filter("sender_id IS NULL")
        if open_.isEmpty():
            return now.select("tuple", "sender_id")
        ahead = now.select(F.col("tuple").alias("by"), F.col("sender_id").alias("found"), F.col("to").alias("next"))
        moved = open_.join(ahead, F.col("to") == F.col("by")).select("tuple", F.col("found").alias("sender_id"), F.col("next").alias("to"))
        now = cut(now.filter("sender_id IS NOT NULL").unionByName(moved))


def resolve_senders(messages: DataFrame, identities: DataFrame, mailbox: str = "", rules: Rules = DEFAULT_RULES) -> DataFrame:
    """(id, sender_id, outcome, also_matched) for messages with id, ord (the ingest order), list_id and from_address.

    ``identities`` are the stored (sender_id, kind, value). A message without any usable key is a sender of its own, by its id.
    """
    keyed = cut(message_keys(messages.select("id", "ord", "list_id", "from_address"), rules).select("id", "ord", *NAMED))  # read twice below
    usable = F.col("norm_key").isNotNull() | F.col("list_key").isNotNull() | F.col("address_key").isNotNull()
    stored = identities.filter(F.col("kind").isin(*RESOLVING)).select("kind", "value", "sender_id")

    named = list(NAMED)
    distinct = keyed.filter(usable).groupBy(*named).agg(F.min("ord").alias("first_ord"))
    tuples = distinct.withColumn("tuple", tuple_key(named))
    for kind, c in zip(RESOLVING, named, strict=True):
        own = stored.filter(F.col("kind") == kind).select(F.col("value").alias(c), F.col("sender_id").alias(f"own_{c}"))
        tuples = tuples.join(own, c, "left")
    first = F.coalesce(*[F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{k}\x1f"), F.col(c))) for k, c in zip(RESOLVING, named, strict=True)])
    by_tuple = decide(tuples.withColumn("new_id", sender_key(mailbox, first)))
    with_tuple = keyed.withColumn("tuple", F.when(usable, tuple_key(named)))
    out = with_tuple.join(by_tuple, "tuple", "left")
    return out.select("id", F.coalesce("sender_id", sender_key(mailbox, F.concat(F.lit("message\x1f"), F.col("id")))).alias("sender_id"), F.coalesce("outcome", F.lit("new")).alias("outcome"), F.coalesce("also_matched", F.array().cast("array<string>")).alias("also_matched"))


def identities_of(messages: DataFrame, resolved: DataFrame, rules: Rules = DEFAULT_RULES) -> DataFrame:
    """Candidate rows (sender_id, kind, value, ord) of resolved messages, for ``new_identities``; DKIM domains too if there."""
    from ..functions.identity import candidate_identities

    dkim = F.col("dkim") if "dkim" in messages.columns else F.lit(None).cast("array<string>")
    rows = messages.join(resolved.select("id", "sender_id"), "id").select("sender_id", "ord", F.explode(candidate_identities(F.col("list_id"), F.col("from_address"), dkim, rules)).alias("c"))
    return rows.groupBy("sender_id", "c").agg(F.min("ord").alias("ord")).select("sender_id", "c.kind", "c.value", "ord")

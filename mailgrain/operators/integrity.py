"""Invariants of the stored tables as jobs that return what breaks them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.detect import METHODS
from ..functions.identity import is_resolving

#: Allowed values by table and column.
ENUMS = {
    ("sender_identity", "kind"): ("list_id", "from_address", "normalized_key", "dkim_domain"),
    ("message", "method"): METHODS,
    ("decision", "decision"): ("keep", "unsubscribe", "unsuppress"),
    ("unsubscribe_attempt", "method"): METHODS,
    ("unsubscribe_attempt", "result"): ("success", "pending_manual", "failed", "skipped_suspicious"),
}


def orphan_check(senders: DataFrame, children: dict[str, DataFrame]) -> DataFrame:
    """(table, sender_id, rows) of child rows without a sender."""
    known = senders.select(F.col("id").alias("sender_id"))
    out = [t.select("sender_id").join(known, "sender_id", "left_anti").groupBy("sender_id").agg(F.count("*").alias("rows")).select(F.lit(n).alias("table"), "sender_id", "rows") for n, t in children.items()]
    return reduce(DataFrame.unionByName, out)


def duplicate_identity_check(identities: DataFrame) -> DataFrame:
    """Resolving keys that more than one sender owns."""
    own = identities.filter(is_resolving(F.col("kind"))).groupBy("kind", "value").agg(F.countDistinct("sender_id").alias("owners"))
    return own.filter("owners > 1")


def enum_check(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, column, value, rows) of values that a column may not hold, and merges of a sender into itself."""
    out = []
    for (name, column), allowed in ENUMS.items():
        if name in tables:
            bad = tables[name].filter(~F.coalesce(F.col(column).isin(*allowed), F.lit(False)))
            out.append(bad.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), F.lit(column).alias("column"), "value", "rows"))
    if "sender_merge" in tables:
        same = tables["sender_merge"].filter("source_id = target_id").groupBy(F.col("source_id").alias("value")).agg(F.count("*").alias("rows"))
        out.append(same.select(F.lit("sender_merge").alias("table"), F.lit("target_id").alias("column"), "value", "rows"))
    return reduce(DataFrame.unionByName, out)

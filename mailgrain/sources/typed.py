"""Text columns read as instants and durations, with a reject for each value that can't be read, in one pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dates
from ..functions.text import free_names

READERS = {"instant": (dates.parse_instant, dates.instant_reject), "duration": (dates.parse_duration, dates.duration_reject)}


def read_typed(rows: DataFrame, kinds: dict[str, str]) -> tuple[DataFrame, str]:
    """(``rows`` with the named text columns read, and an array of (column, value, reason) beside them; that array's name).

    A value that can't be read is null, and says so there; nulls are no rejects. Each value is read once; write the result, and take
    ``accepted`` and ``rejected`` from what was written, so that both come of one pass.
    """
    (name,) = free_names(rows.columns, "rejects")
    reject = [F.when(READERS[kind][1](F.col(c)).isNotNull(), F.struct(F.lit(c).alias("column"), F.col(c).alias("value"), READERS[kind][1](F.col(c)).alias("reason"))) for c, kind in kinds.items()]
    out = rows.withColumn(name, F.filter(F.array(*reject), lambda r: r.isNotNull()))
    return out.withColumns({c: READERS[kind][0](F.col(c)) for c, kind in kinds.items()}), name


def accepted(typed: DataFrame, rejects: str = "rejects") -> DataFrame:
    """Rows whose values could all be read."""
    return typed.filter(F.size(rejects) == 0).drop(rejects)


def rejected(typed: DataFrame, key: str, rejects: str = "rejects") -> DataFrame:
    """(key, column, value, reason): one row for each value that couldn't be read; only the key and the rejects are scanned."""
    return typed.select(key, F.explode(rejects).alias("r")).select(key, "r.column", "r.value", "r.reason")

"""Reading views that may lag behind the log.

A copy stands at a position. It is converging while the log holds an event past it that the
view takes, or one that changes marks; rows that such events touch aren't settled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomlog.sources.event_log import EVERY_VIEW


def tail(log: DataFrame, position: int, interest: Column) -> DataFrame:
    """Events past the position that the view takes or that change marks."""
    return log.where((F.col("sequence_number") > position) & (interest | F.col("entry_type").isin(*EVERY_VIEW)))


def currency(log: DataFrame, position: int, interest: Column) -> DataFrame:
    """(position, head, converging, unsettled): how far behind the copy is, and how many aggregates wait."""
    behind = tail(log, position, interest).agg(F.count("*").alias("n"), F.countDistinct("aggregate_id").alias("unsettled"))
    head = log.agg(F.coalesce(F.max("sequence_number"), F.lit(0)).alias("head"))
    # Both sides are one row by construction.
    return behind.withColumn("one", F.lit(1)).join(head.withColumn("one", F.lit(1)), "one").select(
        F.lit(position).cast("long").alias("position"), "head", (F.col("n") > 0).alias("converging"), "unsettled"
    )


def read_rows(rows: DataFrame, log: DataFrame, position: int, interest: Column, *, by_aggregate: bool, key: str = "row_key", limit: int | None = None, offset: int = 0) -> DataFrame:
    """Rows ordered by key. While converging, a table view has none to show and an aggregate view leaves out unsettled ones,
    after limit and offset, so a page may be short."""
    page = rows.orderBy(key).offset(offset)
    page = page if limit is None else page.limit(limit)
    waiting = tail(log, position, interest)
    if not by_aggregate:
        return page if waiting.isEmpty() else page.limit(0)
    return page.join(waiting.select(F.col("aggregate_id").alias(key)).distinct(), key, "left_anti")


def read_states(keys: DataFrame, rows: DataFrame, log: DataFrame, position: int, interest: Column, *, by_aggregate: bool, key: str = "row_key") -> DataFrame:
    """``keys`` with ``state`` (settled, absent, pending) and the row of those that are settled."""
    waiting = tail(log, position, interest).select(F.col("aggregate_id").alias(key)).distinct().withColumn("waits", F.lit(True))
    found = keys.join(rows.withColumn("held", F.lit(True)), key, "left")
    if by_aggregate:
        found = found.join(waiting, key, "left")
    else:
        found = found.withColumn("waits", F.lit(not waiting.isEmpty()))
    pending = F.coalesce("waits", F.lit(False))
    state = F.when(pending, "pending").when(F.col("held"), "settled").otherwise("absent")
    out = found.withColumn("state", state)
    return out.select(key, "state", *(F.when(F.col("state") == "settled", F.col(c)).alias(c) for c in rows.columns if c != key))


def match_fields(rows: DataFrame, fields: dict, *, as_text: bool = False, column: str = "row_json") -> DataFrame:
    """Rows whose JSON has all of these values: typed, or compared as text, where null matches nothing."""
    parsed = F.parse_json(column)
    for name, value in fields.items():
        path = f"$.{name}"
        if as_text:
            rows = rows.where(F.variant_get(parsed, path, "string") == F.lit(None if value is None else str(value)))
        elif value is None:
            rows = rows.where(F.is_variant_null(F.variant_get(parsed, path, "variant")))
        else:
            kind = "boolean" if isinstance(value, bool) else "bigint" if isinstance(value, int) else "double" if isinstance(value, float) else "string"
            typed = F.try_variant_get(parsed, path, kind)
            is_string = F.schema_of_variant(F.variant_get(parsed, path, "variant")) == "STRING"
            rows = rows.where((typed == F.lit(value)) & (is_string if kind == "string" else ~is_string))
    return rows


def by_keys(rows: DataFrame, keys: DataFrame, key: str = "row_key") -> DataFrame:
    return rows.join(keys.select(key).distinct(), key, "left_semi")

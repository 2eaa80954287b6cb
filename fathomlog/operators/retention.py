"""The security context beside the log: audit pages, retention and redaction."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomlog.functions.values import truncate_ip

INITIATOR = ("type", "user_id", "service", "triggering_event_id", "ip_address")


def audit_page(
    log: DataFrame, context: DataFrame, *, initiator: dict | None = None, flow_token: str | None = None, ip_address: str | None = None,
    start: datetime | None = None, end: datetime | None = None, limit: int = 50, cursor: tuple | None = None,
) -> DataFrame:
    """Events with their security context, latest recorded first, one row more than ``limit``: its presence tells of a next page.

    start and end are inclusive. cursor: (recorded_at, event_id) of the last row seen; pages go on strictly before it.
    """
    if not 1 <= limit <= 1000:
        raise ValueError("a page has 1 to 1000 rows")
    if initiator is not None:
        for name in INITIATOR:
            log = log.where(F.col(f"initiator.{name}").eqNullSafe(F.lit(initiator.get(name))))
    if flow_token is not None:
        log = log.where(F.col("flow_token") == flow_token)
    if ip_address is not None:
        context = context.where(F.col("ip_address") == ip_address)
    if start is not None:
        context = context.where(F.col("recorded_at") >= F.lit(start))
    if end is not None:
        context = context.where(F.col("recorded_at") <= F.lit(end))
    if cursor is not None:
        at, event_id = cursor
        context = context.where((F.col("recorded_at") < F.lit(at)) | ((F.col("recorded_at") == F.lit(at)) & (F.col("event_id") < F.lit(event_id))))
    return log.join(context, "event_id").orderBy(F.desc("recorded_at"), F.desc("event_id")).limit(limit + 1)


def sweep(context: DataFrame, now: datetime, *, full_days: int = 90, truncated_days: int = 365, keep_geo: bool = True) -> tuple[DataFrame, DataFrame]:
    """The context after a sweep, and (truncated, deleted).

    Rows recorded ``full_days`` ago or earlier lose detail, unless redacted; those a further ``truncated_days`` old go.
    Truncation leaves no trace in the row, so old rows are truncated, and counted, by every sweep until they go;
    a row past both bounds counts in both.
    """
    old = F.lit(now - timedelta(days=full_days))
    gone = F.lit(now - timedelta(days=full_days + truncated_days))
    truncates = F.coalesce((F.col("recorded_at") <= old) & F.col("redacted_at").isNull(), F.lit(False))
    deletes = F.coalesce(F.col("recorded_at") <= gone, F.lit(False))
    counts = context.agg(F.count_if(truncates).alias("truncated"), F.count_if(deletes).alias("deleted"))
    changed = {"ip_address": F.when(truncates, truncate_ip(F.col("ip_address"))).otherwise(F.col("ip_address")), "user_agent": F.when(~truncates, F.col("user_agent"))}
    if not keep_geo:
        changed |= {c: F.when(~truncates, F.col(c)) for c in ("geo_country", "geo_region") if c in context.columns}
    return context.where(~deletes).withColumns(changed), counts


def redact(context: DataFrame, event_ids: DataFrame) -> DataFrame:
    """The context without the rows of these events."""
    return context.join(event_ids.select("event_id"), "event_id", "left_anti")

"""The event log: its schema, how rows get their positions, and the scans over it.

``sequence_number`` is the only order of a log. A client's timestamp is data.
"""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathomlog.sources.scratch import written

VERSION = "struct<major:int,minor:int>"
HOP = (
    "struct<hop:string,received_at:string,identifier:string,software_version:string,transform_version:string,database_id:string,"
    "library_version:string,ingest_sequence_number:bigint,previous_ingest_hash:string,arrival_hash:string,origin_sequence_number:bigint>"
)
SCHEMA = (
    "sequence_number bigint not null, event_id string, aggregate_id string, aggregate_type string, entry_type string, "
    f"entry_type_version {VERSION}, lib_format_version {VERSION}, event_type string, data string, metadata string, provenance array<{HOP}>, "
    "initiator struct<type:string,user_id:string,service:string,triggering_event_id:string,ip_address:string>, "
    "client_timestamp timestamp, client_timestamp_text string, event_hash string, previous_event_hash string, flow_token string, "
    "causal struct<kind:string,eligible:boolean,parents:array<struct<event_id:string,event_hash:string>>>, unknown_fields string"
)

# Entry types that every view folds and every native sink gets.
EVERY_VIEW = ("system.security_finding", "system.sender_succession")
SYSTEM_PREFIX = "system."


def with_positions(rows: DataFrame, ts: str, tie: str, *, base: int = 0, seconds: int = 3600, name: str = "sequence_number") -> DataFrame:
    """Gapless positions from ``base + 1`` in the order of (ts, tie).

    Rows are numbered within time buckets, which run in parallel; only the buckets' counts,
    one row to a bucket, are summed up in one place. (ts, tie) must tell rows apart.
    """
    bucketed = rows.withColumn("__bucket", F.floor(F.unix_timestamp(ts) / F.lit(seconds)))
    before = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = bucketed.groupBy("__bucket").agg(F.count("*").alias("__n"))
    offsets = counts.select("__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    own = F.row_number().over(Window.partitionBy("__bucket").orderBy(ts, tie))
    numbered = bucketed.withColumn("__rn", own).join(offsets, "__bucket")
    return numbered.withColumn(name, (F.col("__before") + F.col("__rn") + F.lit(base)).cast("long")).drop("__bucket", "__rn", "__before")


def numbered(rows: DataFrame, *order: Column, name: str = "sequence_number") -> DataFrame:
    """Gapless positions from 1 in ``order``, whatever its columns: rows are dealt by ranges of it, sorted within these and written with their places; only the ranges' counts meet in one place."""
    # The id holds the range's number in its upper bits and the place within the range in the lower 33.
    ranged = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id()))
    placed = ranged.withColumn("__range", F.shiftright("__id", 33)).withColumn("__place", F.col("__id").bitwiseAND(F.lit((1 << 33) - 1)) + 1)
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy("__range").agg(F.count("*").alias("__n"))
    offsets = counts.select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    return placed.join(F.broadcast(offsets), "__range").withColumn(name, F.col("__before") + F.col("__place")).drop("__id", "__range", "__place", "__before")


def events_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``events`` table as a log: one aggregate per user; payload fields beside the payload itself."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    rows = events.select(
        "event_id",
        F.col("user_id").alias("aggregate_id"),
        F.lit("user_activity").alias("entry_type"),
        F.lit("user").alias("aggregate_type"),
        "event_type",
        F.col("ts").cast("timestamp").alias("client_timestamp"),
        "value",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )
    return with_positions(rows, "client_timestamp", "event_id")


def is_system(entry_type: str = "entry_type") -> Column:
    return F.col(entry_type).startswith(SYSTEM_PREFIX)


def _among(column: str, values: Iterable | None) -> Column:
    """No restriction for None; nothing for an empty set."""
    if values is None:
        return F.lit(True)
    values = list(values)
    return F.col(column).isin(values) if values else F.lit(False)


def scan(
    log: DataFrame, *, after: int | None = None, limit: int | None = None, originator_hop: str | None = None, originator_identifier: str | None = None,
    entry_type: str | None = None, event_types: Iterable[str] | None = None, start: datetime | None = None, end: datetime | None = None,
) -> DataFrame:
    """Events past ``after`` that meet every condition, client time in [start, end), in log order."""
    first = F.get(F.col("provenance"), F.lit(0)) if originator_hop or originator_identifier else None
    conditions = [
        None if after is None else F.col("sequence_number") > after,
        None if originator_hop is None else first["hop"] == originator_hop,
        None if originator_identifier is None else first["identifier"] == originator_identifier,
        None if entry_type is None else F.col("entry_type") == entry_type,
        None if event_types is None else _among("event_type", event_types),
        None if start is None else F.col("client_timestamp") >= F.lit(start),
        None if end is None else F.col("client_timestamp") < F.lit(end),
    ]
    for condition in conditions:
        if condition is not None:
            log = log.where(condition)
    log = log.orderBy("sequence_number")
    return log if limit is None else log.limit(limit)


def candidates(log: DataFrame, *, after: int, through: int, limit: int | None = None, entry_types=None, event_types=None, aggregate_types=None) -> DataFrame:
    """Events in (after, through] that a view may fold: those of its types, and what every view folds."""
    own = _among("entry_type", entry_types) & _among("event_type", event_types) & _among("aggregate_type", aggregate_types)
    rows = log.where((F.col("sequence_number") > after) & (F.col("sequence_number") <= through) & (own | F.col("entry_type").isin(*EVERY_VIEW)))
    rows = rows.orderBy("sequence_number")
    return rows if limit is None else rows.limit(limit)


def history(log: DataFrame, aggregate_id) -> DataFrame:
    return log.where(F.col("aggregate_id") == aggregate_id).orderBy("sequence_number")


def by_id(log: DataFrame, event_id) -> DataFrame:
    return log.where(F.col("event_id") == event_id).limit(1)


def latest_first(log: DataFrame, event_types: Iterable[str] | None = None, limit: int | None = None) -> DataFrame:
    rows = log.where(_among("event_type", event_types)).orderBy(F.desc("sequence_number"))
    return rows if limit is None else rows.limit(limit)


def head(log: DataFrame, *, at_head: str = "event_id") -> DataFrame:
    """(head, at_head, events): the last position, a column's value there, and the number of events."""
    return log.agg(
        F.coalesce(F.max("sequence_number"), F.lit(0)).alias("head"),
        F.max_by(at_head, "sequence_number").alias("at_head"),
        F.count("*").alias("events"),
    )

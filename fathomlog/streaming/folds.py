"""Views and event streams as Structured Streaming queries.

The fold keeps a key's row as state and runs the same step as the batch forms. Change rows
are ``delta`` (the row after a micro-batch), ``tombstone`` (a row that is gone) and ``failure``
(an event that couldn't be folded: its position, and why as JSON).
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from fathomlog.operators.folds import EVENT, Folder, asked_operations, event_dict, table_step
from fathomlog.plans.promotion import Promotions
from fathomlog.plans.specs import AggregateView, TableView
from fathomlog.sources.scratch import scratch_dir

CHANGES = "row_key string, kind string, row_json string, position long"


_NAMES = [x.split()[0] for x in CHANGES.split(", ")]


def _changes(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=_NAMES, dtype="object").astype({"position": "int64"})


def _failures(key: str | None, failed: list[tuple[int, str, str]]) -> list[tuple]:
    return [(key, "failure", json.dumps({"reason": reason, "detail": detail}), place) for place, reason, detail in failed]


def _settled(key: str, row: dict | None, position: int, state: GroupState) -> list[tuple]:
    """The change row of a key after a micro-batch, its row being kept as state."""
    had = state.exists
    if row is None:
        if had:
            state.remove()
        return [(key, "tombstone", None, position)] if had else []
    text = json.dumps(row, ensure_ascii=False, sort_keys=True)
    state.update((text,))
    return [(key, "delta", text, position)]


def fold_stream(log: DataFrame, view: AggregateView | TableView, promotions: Promotions | None = None, declared: dict | None = None) -> DataFrame:
    """Change rows of a view over a stream of events, which must come in the order of their positions per row."""
    if isinstance(view, TableView):
        return _table_stream(log, view, promotions, declared)
    folder = Folder(view, promotions, declared)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        row = json.loads(state.get[0]) if state.exists else None
        events = [e for pdf in batches for e in pdf.to_dict("records")]
        ordered = sorted(events, key=lambda e: e["sequence_number"])
        row, failed = folder.aggregate(row, (event_dict(e) for e in ordered))
        yield _changes(_failures(str(key[0]), failed) + _settled(str(key[0]), row, int(ordered[-1]["sequence_number"]), state))

    return (
        log.where(view.interest.condition(log)).select(*EVENT).groupBy("aggregate_id")
        .applyInPandasWithState(run, CHANGES, "row_json string", "update", GroupStateTimeout.NoTimeout)
    )


def _table_stream(log: DataFrame, view: TableView, promotions: Promotions | None, declared: dict | None) -> DataFrame:
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        asked = [r for pdf in batches for r in pdf.itertuples(index=False)]
        if key[0] is None:
            yield _changes(_failures(None, [(int(r.sequence_number), r.reason, r.detail) for r in asked]))
            return
        row = json.loads(state.get[0]) if state.exists else None
        for r in sorted(asked, key=lambda r: r.sequence_number):
            event = {"data": {view.match_field: json.loads(r.matched)} if view.match_field else {}, "sequence_number": int(r.sequence_number)}
            row = table_step(view, row, key[0], r.kind, json.loads(r.row_data), event)
        yield _changes(_settled(key[0], row, int(max(r.sequence_number for r in asked)), state))

    asked = asked_operations(log, view, promotions, declared)
    # Failures have no key; they are dealt by position.
    dealt = F.when(F.col("row_key").isNull(), F.pmod("sequence_number", F.lit(64)))
    return asked.withColumn("dealt", dealt).groupBy("row_key", "dealt").applyInPandasWithState(run, CHANGES, "row_json string", "update", GroupStateTimeout.NoTimeout)


def current_rows(changes: DataFrame) -> DataFrame:
    """View rows from all change rows so far: the last change of each key, if it isn't a tombstone."""
    last = changes.where("kind <> 'failure'").groupBy("row_key").agg(F.max_by(F.struct("kind", "row_json"), "position").alias("c"), F.max("position").alias("position"))
    return last.where("c.kind = 'delta'").select("row_key", F.col("c.row_json").alias("row_json"), "position")


def run_available(stream: DataFrame, path: str, mode: str = "update") -> DataFrame:
    """Run a stream over all that is there, append its output under ``path``, and read that."""
    spark = stream.sparkSession
    out = f"{path}/changes"

    def keep(batch: DataFrame, epoch: int) -> None:
        # A micro-batch that is run again overwrites its own folder.
        batch.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").foreachBatch(keep).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/*")


def update_frames(changes: DataFrame, view: str) -> DataFrame:
    """(frame): change rows as the JSON messages that subscribers get."""
    return changes.select(F.to_json(F.struct(F.col("kind").alias("type"), F.lit(view).alias("view"), F.col("row_key").alias("key"), F.col("position"), F.parse_json("row_json").alias("row"))).alias("frame"))


def pending_frames(waiting: DataFrame, view: str) -> DataFrame:
    """(frame): what subscribers are told of rows (row_key, position) that events past the view's position will change."""
    return waiting.select(F.to_json(F.struct(F.lit("pending").alias("type"), F.lit(view).alias("view"), F.col("row_key").alias("key"), F.col("position"))).alias("frame"))


def snapshot_frames(rows: DataFrame, position: int, view: str) -> DataFrame:
    """A view's rows as snapshot messages, then the mark of their end, in that order by ``n``."""
    body = rows.select(F.lit(0).alias("n"), F.to_json(F.struct(F.lit("snapshot").alias("type"), F.lit(view).alias("view"), F.col("row_key").alias("key"), F.parse_json("row_json").alias("row"))).alias("frame"))
    end = rows.sparkSession.range(1).select(F.lit(1).alias("n"), F.to_json(F.struct(F.lit("end_of_replay").alias("type"), F.lit(view).alias("view"), F.lit(position).alias("position"))).alias("frame"))
    return body.union(end).orderBy("n")


def scratch(spark: SparkSession) -> str:
    """A folder for one stream's checkpoint and output."""
    return scratch_dir(spark, "stream")

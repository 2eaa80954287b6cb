"""A store's log and views as streams, with an exact hand-over from what is there already.

The manifests of a store are small files that appear whole and never change, so a file stream of them is a
stream of its commits. Each names all appends, and of each view its last delta. What a subscriber hasn't seen is told by
the folders' names, kept as the state of the stream: a manifest that comes late or is skipped leaves no gap, as the
next one names the same appends, and none is given twice. The snapshot is pinned to one manifest, and only what lies
past its position follows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fathomlog.operators.folds import ROWS
from fathomlog.sources.store import LogStore, Manifest
from fathomlog.streaming.folds import snapshot_frames, update_frames

_APPENDS = "log array<struct<folder:string,first:bigint,last:bigint>>"
_DELTAS = "views map<string,struct<position:bigint,copy:struct<latest:struct<number:bigint,folder:string>>>>"


def _commits(store: LogStore, schema: str) -> DataFrame:
    text = store.spark.readStream.format("text").option("wholetext", "true").load(f"{store.path}/manifest-*")
    return text.select(F.from_json("value", schema).alias("m"))


def appends(store: LogStore, after: int = 0) -> DataFrame:
    """A stream of (folder, first, last), one row for each append that reaches past ``after``."""
    return _commits(store, _APPENDS).select(F.explode("m.log").alias("x")).select("x.*").where(F.col("last") > after).dropDuplicates(["folder"])


def deltas(store: LogStore, view: str, after: int = 0) -> DataFrame:
    """A stream of (position, folder), one row for each delta of a view past the position ``after``.

    A delta whose manifest the stream never saw alone (several commits between two triggers) is found in that commit's own manifest, as
    the stream reads all of them.
    """
    rows = _commits(store, _DELTAS).select(F.col("m.views")[view].alias("v")).select("v.position", "v.copy.latest.folder")
    return rows.where(F.col("folder").isNotNull() & (F.col("position") > after)).dropDuplicates(["folder"])


def _folders(batch: DataFrame, order: str) -> list[str]:
    """The folders of a micro-batch in order: as many as there were commits since the one before."""
    return [r.folder for r in batch.orderBy(order).select("folder").collect()]


def follow_log(store: LogStore, handle: Callable[[DataFrame, int], None], checkpoint: str, *, after: int = 0) -> StreamingQuery:
    """Give ``handle`` the events past ``after`` as they are committed, each once, with the number of the micro-batch.

    A micro-batch that is run again has the same events; ``handle`` must make up for that by its number.
    """

    def run(batch: DataFrame, epoch: int) -> None:
        if folders := _folders(batch, "first"):
            events = store.spark.read.parquet(*(f"{store.path}/{f}" for f in folders))
            handle(events.where(F.col("sequence_number") > after), epoch)

    return appends(store, after).writeStream.option("checkpointLocation", checkpoint).outputMode("append").foreachBatch(run).start()


def changes_in(store: LogStore, folder: str, position: int | None = None) -> DataFrame:
    """(row_key, kind, row_json, position) of a view's delta."""
    rows = store.spark.read.schema(ROWS).parquet(f"{store.path}/{folder}")
    kind = F.when(F.col("row_json").isNull(), "tombstone").otherwise("delta")
    return rows.select("row_key", kind.alias("kind"), "row_json", F.coalesce("position", F.lit(position)).cast("long").alias("position"))


def subscribe(store: LogStore, view: str, send: Callable[[DataFrame, int], None], checkpoint: str, at: Manifest | None = None) -> StreamingQuery:
    """Send a view's rows as of one commit, the mark of their end, and then its changes as they are committed.

    ``send`` gets frames (JSON texts) and a number: -1 for the snapshot, then that of the micro-batch. The snapshot stands at the copy's position;
    a catch-up that commits while it is being sent is past that position, so it is neither lost nor sent twice. A view that is rebuilt under
    another definition needs a new subscription.
    """
    at = at or store.manifest()
    rows, position = store.view(view, at)
    send(snapshot_frames(rows.where("row_json is not null").select("row_key", "row_json"), position, view), -1)

    def run(batch: DataFrame, epoch: int) -> None:
        for r in batch.orderBy("position").collect():  # a row to a commit
            send(update_frames(changes_in(store, r.folder, r.position), view), epoch)

    return deltas(store, view, position).writeStream.option("checkpointLocation", checkpoint).outputMode("append").foreachBatch(run).start()

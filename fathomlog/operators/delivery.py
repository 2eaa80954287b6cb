"""Delivery queues computed from the log: admission, batching, queue state, retries and holds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomlog.operators.chain import BLOCK
from fathomlog.sources.event_log import EVERY_VIEW
from fathomlog.sources.scratch import written

# Which status may follow which; null is pending.
TRANSITIONS = {None: ("sent", "wedged", "tombstoned"), "wedged": ("tombstoned",)}
#: Fixed values of the default policy: seconds, factor, seconds, share, attempts, seconds.
BACKOFF = {"initial": 60, "factor": 5, "longest": 7200, "jitter": 0.1, "max_attempts": 20, "max_time": 86400}


def may_become(status: str | None, after: str, attempts: int = 1) -> bool:
    """Whether an item's status may change; a pending item is only given up after an attempt."""
    return after in TRANSITIONS.get(status, ()) and not (status is None and after == "tombstoned" and attempts == 0)


def is_active(start: Column, end: Column, now: Column) -> Column:
    """A schedule is active in [start, end)."""
    return F.coalesce((start <= now) & (end.isNull() | (now < end)), F.lit(False))


def admit(log: DataFrame, interest: Column, *, start, upper, own: Column | None = None, channel_wide: bool = False) -> DataFrame:
    """Events with ``decision`` admitted or skipped, up to the first one that must wait.

    Own events of interest in [start, upper] are admitted; others are skipped. One that is of interest but
    past ``upper`` is deferred, and the walk stops there: later events aren't decided yet.
    channel_wide: a native sink gets the types every view folds whatever the interest and window say.
    """
    ts = F.col("client_timestamp")
    wide = F.col("entry_type").isin(*EVERY_VIEW) if channel_wide else F.lit(False)
    mine = own if own is not None else F.lit(True)
    due = mine & interest & (ts >= F.lit(start))
    decision = F.when(mine & wide, "admitted").when(due & (ts > F.lit(upper)), "deferred").when(due, "admitted").otherwise("skipped")
    decided = log.withColumn("decision", decision)
    stop = decided.where("decision = 'deferred'").agg(F.min("sequence_number")).first()[0]
    return decided if stop is None else decided.where(F.col("sequence_number") < stop)


def gap_replay(log: DataFrame, interest: Column, *, cursor: int, start, gap_upper, own: Column | None = None, channel_wide: bool = False, queued: DataFrame | None = None) -> DataFrame:
    """Own events at or before the cursor that are of interest and whose client time lies in [start, gap_upper).

    channel_wide: a native sink gets the types every view folds whatever their time and the interest,
    unless ``queued`` (event_id) has them already.
    """
    ts = F.col("client_timestamp")
    mine = log.where((F.col("sequence_number") <= cursor) & (own if own is not None else F.lit(True)))
    due = interest & (ts >= F.lit(start)) & (ts < F.lit(gap_upper))
    wide = F.col("entry_type").isin(*EVERY_VIEW)
    if not channel_wide:
        return mine.where(due)
    always = mine.where(wide)
    if queued is not None:
        always = always.join(queued.select("event_id").distinct(), "event_id", "left_anti").select(*mine.columns)
    return mine.where(~wide & due).unionByName(always)


def _blocks(rows: DataFrame, **ends: Column) -> DataFrame:
    """One row for each block of positions."""
    return rows.groupBy("__block").agg(*(c.alias(n) for n, c in ends.items()))


def batches(admitted: DataFrame, size: int | None = None, key: str | None = None, *, weight: Column | None = None, most: int | None = None) -> DataFrame:
    """Adds ``batch`` (from 0): consecutive events, each joining the batch before it as long as that may take it.

    A batch takes an event while it holds fewer than ``size``, their ``weight`` (not negative) stays within ``most``, and its
    first event has the same ``key``, no key being one of its own. Its first event joins whatever it weighs. All is counted within
    blocks of positions; between them go a row to a block and, with weights, the prefix sums of its first batch's length.
    """
    if weight is not None and most is not None:
        return _weighed(admitted, size, key, weight, most)
    rows = admitted.withColumn("__block", F.floor(F.col("sequence_number") / F.lit(BLOCK))).withColumn("__key", F.struct((F.col(key) if key else F.lit(0)).alias("k")))
    own, before = Window.partitionBy("__block").orderBy("sequence_number"), Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    counted = _blocks(rows, n=F.count("*"), last=F.max_by("__key", "sequence_number")).select("__block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__n"), F.lag("last").over(Window.orderBy("__block")).alias("__last"))
    rows = rows.withColumn("__i", F.row_number().over(own)).withColumn("__prior", F.lag("__key").over(own)).join(counted, "__block")
    rows = rows.withColumn("__i", F.col("__n") + F.col("__i") - 1).withColumn("__wall", F.when(~F.coalesce("__prior", "__last").eqNullSafe(F.col("__key")), F.col("__i")))
    # Where each event's run of one key began: in its block, or as the blocks before carry it on.
    runs = _blocks(rows, wall=F.max("__wall")).select("__block", F.max("wall").over(before).alias("__carried"))
    rows = rows.withColumn("__run", F.max("__wall").over(own)).join(runs, "__block").withColumn("__run", F.coalesce("__run", "__carried"))
    place = F.col("__i") - F.col("__run")
    rows = rows.withColumn("__begins", (place % F.lit(size) == 0 if size else place == 0).cast("long"))
    begun = _blocks(rows, begins=F.sum("__begins")).select("__block", F.coalesce(F.sum("begins").over(before), F.lit(0)).alias("__begun"))
    rows = rows.withColumn("__begins", F.sum("__begins").over(own)).join(begun, "__block")
    return rows.select(*admitted.columns, (F.col("__begun") + F.col("__begins") - 1).cast("long").alias("batch"))


def _ends(weights: np.ndarray, keys: list, size: int | None, most: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Prefix sums of a block, where the batch that begins at each event ends, and where its first key ends."""
    n = len(weights)
    sums = np.concatenate([[0], np.cumsum(weights)])
    ends = np.maximum(np.searchsorted(sums, sums[:-1] + most, side="right") - 1, np.arange(1, n + 1))
    walls = [i for i in range(1, n) if keys[i] != keys[i - 1]] + [n]
    ends = np.minimum(ends, np.array(walls)[np.searchsorted(walls, np.arange(n), side="right")])
    return sums, np.minimum(ends, np.arange(n) + size) if size else ends, walls[0]


def _taken(sums: np.ndarray, wall: int, held: int, count: int, size: int | None, most: int) -> int:
    """Events of a block that an open batch of ``count`` events weighing ``held`` still takes, its key being the block's first."""
    fits = int(np.searchsorted(sums, most - held, side="right")) - 1
    return max(0, min(wall, fits, *([size - count] if size else [])))


_TABLE = "block long, n long, total long, wall long, first string, last string, sums array<long>, left array<long>, rest array<long>, begun array<long>"
_OPEN = "block long, held long, count long, key string, done long"


def _named(schema: str, rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[x.split()[0] for x in schema.split(", ")])


def _none(value):
    return None if value is None or value != value else value


def _weighed(admitted: DataFrame, size: int | None, key: str | None, weight: Column, most: int) -> DataFrame:
    """Greedy batches by weight.

    What a block does to the batch that is open when it is entered depends on how much of the block that batch still takes; from
    there on all is decided within the block. So each block is worked off on its own to a table by that number (as many entries as an
    empty batch takes events); the tables are walked in order, which tells each block what is open at its beginning.
    """
    block = F.floor(F.col("sequence_number") / F.lit(BLOCK)).cast("long")
    rows = admitted.select("sequence_number", block.alias("block"), (F.col(key).cast("string") if key else F.lit(None).cast("string")).alias("key"), weight.cast("long").alias("weight"))

    def sorted_block(pdf: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, list]:
        pdf = pdf.sort_values("sequence_number")
        return pdf, pdf["weight"].to_numpy(), [_none(k) for k in pdf["key"]]

    def table(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, weights, keys = sorted_block(pdf)
        sums, ends, wall = _ends(weights, keys, size, most)
        n = len(keys)
        begins, begun = np.arange(n), np.ones(n, np.int64)
        for i in range(n - 1, -1, -1):  # the last batch that follows from one that begins here, and their number
            if ends[i] < n:
                begins[i], begun[i] = begins[ends[i]], 1 + begun[ends[i]]
        takes = min(_taken(sums, wall, 0, 0, size, most), n - 1)
        begins, begun = begins[: takes + 1], begun[: takes + 1]
        return _named(_TABLE, [(int(pdf["block"].iloc[0]), n, int(sums[-1]), wall, keys[0], keys[-1], sums[: takes + 2], n - begins, sums[-1] - sums[begins], begun)])

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, count, open_key, done = 0, 0, None, 0
        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                out.append((r.block, held, count, open_key, done))
                at = _taken(np.asarray(r.sums), r.wall, held, count, size, most) if done and open_key == _none(r.first) else 0
                if at >= r.n:
                    held, count = held + r.total, count + r.n
                else:
                    held, count, open_key, done = int(r.rest[at]), int(r.left[at]), _none(r.last), done + int(r.begun[at])
            yield _named(_OPEN, out)

    def number(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, weights, keys = sorted_block(pdf)
        sums, ends, wall = _ends(weights, keys, size, most)
        held, count, done, open_key = (pdf[c].iloc[0] for c in ("held", "count", "done", "open_key"))
        at = _taken(sums, wall, held, count, size, most) if done and _none(open_key) == keys[0] else 0
        out = np.full(len(keys), done - 1, np.int64)
        while at < len(keys):
            out[at : ends[at]] = done
            at, done = ends[at], done + 1
        return pd.DataFrame({"sequence_number": pdf["sequence_number"], "batch": out})

    tables = written(rows.groupBy("block").applyInPandas(table, _TABLE))
    opened = tables.repartition(1).sortWithinPartitions("block").mapInPandas(walk, _OPEN).withColumnRenamed("key", "open_key")
    numbered = rows.join(opened, "block").groupBy("block").applyInPandas(number, "sequence_number long, batch long")
    return admitted.join(numbered, "sequence_number").select(*admitted.columns, "batch")


def queue_heads(items: DataFrame) -> DataFrame:
    """The first item of each queue that is pending or wedged, whole."""
    open_items = items.where(F.col("final_status").isNull() | (F.col("final_status") == "wedged"))
    rest = [c for c in items.columns if c != "destination_id"]
    first = open_items.groupBy("destination_id").agg(F.min_by(F.struct(*rest), "sequence_in_queue").alias("h"))
    return first.select("destination_id", "h.*")


def wedged(items: DataFrame) -> DataFrame:
    """(destination_id, sequence_in_queue, wedged_at): queues whose head is wedged, since its last attempt."""
    heads = queue_heads(items).where("final_status = 'wedged'")
    at = F.coalesce(F.expr("get(attempts, size(attempts) - 1).attempted_at"), F.col("enqueued_at"))
    return heads.select("destination_id", "sequence_in_queue", at.alias("wedged_at"))


def longest_delay(i: Column, policy: dict = BACKOFF) -> Column:
    """The longest delay before attempt ``i`` (0 for the first), jitter included."""
    return F.least(F.lit(float(policy["initial"])) * F.pow(F.lit(float(policy["factor"])), i), F.lit(float(policy["longest"]))) * F.lit(1 + policy["jitter"])


def retry_budget(attempts: DataFrame, *, cadence: float, policy: dict = BACKOFF) -> DataFrame:
    """(item_id, attempts, spent_seconds, exhausted) from (item_id, attempted_at).

    The time spent is the sum of gaps between attempts, each counted up to the longest delay before the
    later attempt and one cadence, so that time asleep doesn't count.
    """
    by_time = Window.partitionBy("item_id").orderBy("attempted_at")
    gap = F.unix_micros("attempted_at") / 1e6 - F.lag(F.unix_micros("attempted_at")).over(by_time) / 1e6
    i = F.row_number().over(by_time) - 1
    counted = attempts.select("item_id", F.least(gap, longest_delay(i, policy) + F.lit(cadence)).alias("gap"))
    out = counted.groupBy("item_id").agg(F.count("*").alias("attempts"), F.coalesce(F.sum("gap"), F.lit(0.0)).alias("spent_seconds"))
    return out.withColumn("exhausted", (F.col("attempts") >= policy["max_attempts"]) | (F.col("spent_seconds") >= policy["max_time"]))


def sweep(items: DataFrame, destination_id: str, after: int, key: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Items left after pending ones past ``after`` (of ``key``, if given) are deleted; and (deleted, lowest_event)."""
    goes = (F.col("destination_id") == destination_id) & F.col("final_status").isNull() & (F.col("sequence_in_queue") > after)
    if key is not None:
        goes &= F.col("block_key") == key
    goes = F.coalesce(goes, F.lit(False))
    return items.where(~goes), items.where(goes).agg(F.count("*").alias("deleted"), F.min("first_sequence").alias("lowest_event"))


def tombstone_and_refill(items: DataFrame, destination_id: str) -> tuple[DataFrame, int | None]:
    """Give up a wedged head and delete what is pending behind it; and the cursor to fill from again.

    Anything but a wedged head is an error.
    """
    head = queue_heads(items.where(F.col("destination_id") == destination_id)).first()
    if head is None or head["final_status"] != "wedged":
        raise ValueError("the queue's head is not wedged")
    mine = F.col("destination_id") == destination_id
    is_head = mine & (F.col("sequence_in_queue") == head["sequence_in_queue"])
    behind = mine & F.col("final_status").isNull() & (F.col("sequence_in_queue") > head["sequence_in_queue"])
    lowest = items.where(is_head | behind).agg(F.min("first_sequence")).first()[0]
    left = items.where(~behind).withColumn("final_status", F.when(is_head, "tombstoned").otherwise(F.col("final_status")))
    return left, None if lowest is None else lowest - 1


def retained_delivery(items: DataFrame, generation: int, number: int) -> DataFrame:
    """The latest sent item of a delivery."""
    sent = items.where((F.col("final_status") == "sent") & (F.col("delivery_generation") == generation) & (F.col("delivery_number") == number))
    return sent.orderBy(F.desc("sequence_in_queue")).limit(1)


def missing_deliveries(items: DataFrame, destination_id: str, generation: int, accepted: int, last: int) -> DataFrame:
    """(delivery_number, retained): what a receiver that stands at ``accepted`` lacks, and whether it can be sent again."""
    spark = items.sparkSession
    sent = items.where((F.col("destination_id") == destination_id) & (F.col("delivery_generation") == generation) & (F.col("final_status") == "sent"))
    due = spark.range(accepted + 1, last + 1).withColumnRenamed("id", "delivery_number")
    return due.join(sent.select("delivery_number").distinct().withColumn("retained", F.lit(True)), "delivery_number", "left").select("delivery_number", F.coalesce("retained", F.lit(False)).alias("retained"))


def recover(items: DataFrame, senders: DataFrame, acts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All queues at once that resume or begin a new generation: the items after, and a row for each such queue.

    senders: (destination_id, generation, number, receiver, cursor); acts: (destination_id, act, record_number, responding), act being ``resume``, from
    the number at which the receiver stands, or ``new_generation``. Pending items are retired: deleted without an attempt, tombstoned
    with one. A queue that resumes fills again from below the lowest event that they carried, and sends the numbers above the record again; a new generation
    fills from the start and numbers from 1.
    Queues: (destination_id, act, generation, number, receiver, cursor, resend_first, resend_last, lacking): what is sent again is a range,
    ``lacking`` its numbers of which no sent item is held.
    """
    pending = F.col("final_status").isNull()
    tried = F.coalesce(F.size("attempts"), F.lit(0)) > 0
    marked = items.join(acts.select("destination_id", F.lit(True).alias("__acts")), "destination_id", "left")
    goes = pending & F.coalesce("__acts", F.lit(False))
    after = marked.where(~goes | tried).withColumn("final_status", F.when(goes, "tombstoned").otherwise(F.col("final_status"))).select(*items.columns)
    lowest = marked.where(goes).groupBy("destination_id").agg(F.min("first_sequence").alias("lowest"))
    queues = acts.join(senders, "destination_id").join(lowest, "destination_id", "left")
    resumes = F.col("act") == "resume"
    behind = resumes & (F.col("record_number") < F.col("number"))
    queues = queues.select(
        "destination_id", "act", F.when(resumes, F.col("generation")).otherwise(F.col("generation") + 1).alias("generation"), F.when(resumes, F.col("record_number")).otherwise(F.lit(0)).cast("long").alias("number"),
        F.col("responding").alias("receiver"), F.when(~resumes, F.lit(-1)).otherwise(F.least("cursor", F.col("lowest") - 1)).cast("long").alias("cursor"),
        F.when(behind, F.col("record_number") + 1).cast("long").alias("resend_first"), F.when(behind, F.col("number")).cast("long").alias("resend_last"),
    )
    held = resends(items, queues).groupBy("destination_id").agg(F.countDistinct("delivery_number").alias("held"))
    due = F.coalesce(F.col("resend_last") - F.col("resend_first") + 1, F.lit(0))
    return after, queues.join(held, "destination_id", "left").withColumn("lacking", due - F.coalesce("held", F.lit(0))).drop("held")


def resends(items: DataFrame, queues: DataFrame) -> DataFrame:
    """The items that ``queues`` (of ``recover``) send again, each with its new place behind all of its queue, in ascending numbers."""
    due = queues.where("resend_first is not null").select("destination_id", F.col("generation").alias("delivery_generation"), "resend_first", "resend_last")
    last = items.groupBy("destination_id").agg(F.max("sequence_in_queue").alias("behind"))
    sent = items.where("final_status = 'sent'").join(due, ["destination_id", "delivery_generation"]).where("delivery_number between resend_first and resend_last").join(last, "destination_id")
    return sent.select(*(c for c in items.columns if c != "sequence_in_queue"), (F.col("behind") + F.col("delivery_number") - F.col("resend_first") + 1).cast("long").alias("sequence_in_queue"))


def hold_key(items: DataFrame, destination_id: str, key: str, held: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Put a key on hold: its refused head is given up, its pending items go, and their events join the key's list.

    held: (sequence_number, event_id) of the list so far. Gives the items and the list, each event once.
    """
    head = queue_heads(items.where(F.col("destination_id") == destination_id)).first()
    at = head["sequence_in_queue"] if head and head["block_key"] == key else None
    mine = (F.col("destination_id") == destination_id) & F.col("block_key").eqNullSafe(F.lit(key)) & F.col("final_status").isNull()
    is_head = (F.col("destination_id") == destination_id) & F.lit(at is not None) & (F.col("sequence_in_queue") == F.lit(at))
    is_head = F.coalesce(is_head, F.lit(False))
    moved = items.where(mine | is_head).select(F.explode("events").alias("e")).select("e.sequence_number", "e.event_id")
    left = items.where(~mine | is_head).withColumn("final_status", F.when(is_head, "tombstoned").otherwise(F.col("final_status")))
    return left, held.select("sequence_number", "event_id").union(moved).dropDuplicates(["event_id"])


def channel_wide_sent(items: DataFrame, generation: int) -> DataFrame:
    """(event_id) in pending or wedged items, or sent under this generation: not to be queued again."""
    open_or_sent = F.col("final_status").isNull() | (F.col("final_status") == "wedged") | ((F.col("final_status") == "sent") & (F.col("delivery_generation") == generation))
    return items.where(open_or_sent).select(F.explode("events").alias("e")).select("e.event_id").distinct()


# What a receiver's answer means, and what follows from requests about schedules and holds.


def read_answers(answers: DataFrame) -> DataFrame:
    """``answers`` with ``reading``.

    Columns: recorded_receiver and responding (databases), own_number and own_hash (what the sender has recorded of the
    receiver), number and hash (what the receiver answered), fence_number and fence_hash (what is being sent),
    attempted (the sender attempted or sent that delivery), resendable, marked_sent (something was marked sent at that number).
    """
    other = F.col("recorded_receiver").isNotNull() & (F.col("recorded_receiver") != F.col("responding"))
    ahead, behind = F.col("number") > F.col("own_number"), F.col("number") < F.col("own_number")
    fenced = F.col("fence_number").eqNullSafe(F.col("number")) & F.col("fence_hash").eqNullSafe(F.col("hash"))
    reading = (
        F.when(other, "unexplained")
        .when(ahead & F.col("attempted") & fenced, "acknowledged")
        .when(ahead & F.col("attempted"), "adopted")
        .when((F.col("number") == F.col("own_number")) & F.col("hash").eqNullSafe(F.col("own_hash")), "in_step")
        .when(behind & F.col("resendable"), "receiver_behind")
        .when(ahead & ~F.col("marked_sent"), "sender_regressed")
        .otherwise("unexplained")
    )
    return answers.withColumn("reading", reading)


def start_change(held, when, wedged: bool = False, pending_upper=None) -> tuple[str, tuple | None]:
    """What setting a start date does: (``first`` | ``gap`` | ``unchanged``, the replay's [start, upper)).

    A start is never moved later, nor earlier while the queue is wedged; a gap still to be replayed keeps the larger bound.
    """
    if held is None:
        return "first", (when, None)
    if when == held:
        return "unchanged", None
    if when > held:
        raise ValueError("a start date can't move later")
    if wedged:
        raise ValueError("the queue is wedged")
    return "gap", (when, max(held, pending_upper) if pending_upper else held)


def end_change(end, now) -> str:
    return "closed" if end <= now else "scheduled"


def release_hold(state: str | None, held_id: str | None, asked_id: str) -> str:
    """What asking for a key's release does: ``stale`` (another hold is there, or none), ``releasing_already`` or ``releasing``."""
    if state is None or held_id != asked_id:
        return "stale"
    return "releasing_already" if state == "releasing" else "releasing"


def due_for_release(held: DataFrame, lists: DataFrame, fill_position: int, *, replay_pending: bool = False) -> DataFrame:
    """(key, sequence_number, event_id): the front of each releasing key's list, if the fill has come that far.

    held: (key, state); lists: (key, sequence_number, event_id).
    """
    front = lists.join(held.where("state = 'releasing'").select("key"), "key", "left_semi")
    front = front.groupBy("key").agg(F.min(F.struct("sequence_number", "event_id")).alias("e")).select("key", "e.*")
    return front.where((F.col("sequence_number") <= fill_position) & F.lit(not replay_pending))


def route_held(admitted: DataFrame, lists: DataFrame, held: DataFrame, key: str = "key") -> tuple[DataFrame, DataFrame]:
    """Events of held keys go to their lists, each once; the others are left to be queued."""
    listed = admitted.join(held.select(key), key, "left_semi").select(key, "sequence_number", "event_id")
    return admitted.join(held.select(key), key, "left_anti"), lists.union(listed).dropDuplicates([key, "event_id"])


def delivery_status(schedules: DataFrame, items: DataFrame, heartbeats: DataFrame) -> DataFrame:
    """One row per destination: its schedule, what waits, its head, and when its drainer was last heard of."""
    waits = items.where("final_status is null").groupBy("destination_id").agg(F.count("*").alias("pending"))
    heads = queue_heads(items).select("destination_id", F.col("sequence_in_queue").alias("head"), F.col("final_status").alias("head_status"))
    out = schedules.join(waits, "destination_id", "left").join(heads, "destination_id", "left").join(heartbeats, "destination_id", "left")
    return out.withColumn("pending", F.coalesce("pending", F.lit(0)))


def deliver(stream: DataFrame, send, path: str, *, size: int = 500):
    """A streaming query that hands each micro-batch to a sink, in the order of positions, ``size`` events to a delivery.

    send(events, epoch) takes a DataFrame of one micro-batch with its ``batch`` column, and must take a batch
    that comes again (after a failure) as the one it knows.
    """

    def run(batch: DataFrame, epoch: int) -> None:
        send(batches(batch, size), epoch)

    return stream.writeStream.option("checkpointLocation", path).foreachBatch(run).trigger(availableNow=True).start()


# Why a queue's head may be wedged.
WEDGE_CAUSES = ("permanent_refusal", "retry_budget_exhausted", "operator_halt", "acknowledgement_invalid", "transform_failed")


def transition_refused(status: Column, after: Column, attempts: Column) -> Column:
    """``may_become`` in columns: whether a change of an item's status is to be refused."""
    allowed = F.lit(False)
    for held, then in TRANSITIONS.items():
        allowed |= status.eqNullSafe(F.lit(held)) & after.isin(*then)
    return ~F.coalesce(allowed, F.lit(False)) | (status.isNull() & (after == "tombstoned") & (F.coalesce(attempts, F.lit(0)) == 0))


def pending_keyless(items: DataFrame) -> DataFrame:
    """(destination_id): queues that hold a pending item without key."""
    return items.where("final_status is null and block_key is null").select("destination_id").distinct()


def register_destinations(schedules: DataFrame, asked: DataFrame, lists: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Schedules after registrations, and what became of each request (request_id, destination_id, outcome).

    schedules: (destination_id, start, end, hard_delete, key_scheme); asked: (request_id, destination_id, hard_delete, key_scheme,
    arrival); lists: (destination_id) of queues with held keys, whose keying must stay as it is. A new id begins dormant; a known one
    keeps its dates; of several requests the last one's opt-in and keying hold.
    """
    held = schedules.select("destination_id", F.col("key_scheme").alias("__scheme"), F.lit(True).alias("__known"))
    keyed = lists.select("destination_id").distinct().withColumn("__keyed", F.lit(True))
    judged = asked.join(held, "destination_id", "left").join(keyed, "destination_id", "left")
    bad = (F.coalesce(F.length("destination_id"), F.lit(0)) == 0) | F.col("destination_id").contains("|")
    outcome = (
        F.when(bad, "id_refused")
        .when(F.col("key_scheme") == "", "key_scheme_refused")
        .when(F.col("__keyed") & ~F.col("key_scheme").eqNullSafe(F.col("__scheme")), "keying_refused")
        .when(F.col("__known"), "known").otherwise("registered")
    )
    judged = judged.withColumn("outcome", outcome)
    taken = judged.where(F.col("outcome").isin("known", "registered"))
    last = taken.groupBy("destination_id").agg(F.max_by(F.struct("hard_delete", "key_scheme"), "arrival").alias("n"))
    after = schedules.join(last, "destination_id", "full").select(
        "destination_id", "start", "end", F.when(F.col("n").isNotNull(), F.col("n.hard_delete")).otherwise(F.col("hard_delete")).alias("hard_delete"),
        F.when(F.col("n").isNotNull(), F.col("n.key_scheme")).otherwise(F.col("key_scheme")).alias("key_scheme"),
    )
    return after, judged.select("request_id", "destination_id", "outcome")


def delete_destinations(schedules: DataFrame, items: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items after deletions, and (destination_id, refusal, tombstoned, deleted) per queue asked for.

    A deletion needs the opt-in and is refused while the head is pending. A wedged head is given up, pending items
    behind it go, and what was sent or given up stays as the record.
    """
    heads = queue_heads(items).select("destination_id", F.col("sequence_in_queue").alias("__head"), F.col("final_status").alias("__status"))
    judged = asked.select("destination_id").distinct().join(schedules.select("destination_id", "hard_delete"), "destination_id", "left").join(heads, "destination_id", "left")
    refusal = F.when(F.col("hard_delete").isNull(), "unknown").when(~F.col("hard_delete"), "no_opt_in").when(F.col("__head").isNotNull() & F.col("__status").isNull(), "head_pending")
    judged = judged.withColumn("refusal", refusal)
    goes = judged.where("refusal is null").select("destination_id", "__head", F.lit(True).alias("__goes"))
    marked = items.join(goes, "destination_id", "left")
    is_head = F.col("__goes") & (F.col("sequence_in_queue") == F.col("__head"))
    behind = F.coalesce(F.col("__goes") & F.col("final_status").isNull(), F.lit(False))
    left = marked.where(~behind).withColumn("final_status", F.when(is_head, "tombstoned").otherwise(F.col("final_status"))).select(*items.columns)
    counts = marked.where("__goes").groupBy("destination_id").agg(F.max(F.when(is_head, F.col("sequence_in_queue"))).alias("tombstoned"), F.count_if(behind).alias("deleted"))
    return left, judged.select("destination_id", "refusal").join(counts, "destination_id", "left").select("destination_id", "refusal", "tombstoned", F.coalesce("deleted", F.lit(0)).cast("long").alias("deleted"))


def open_halts(events: DataFrame) -> DataFrame:
    """(destination_id, request_event_id) of halts that wait: asked for, and neither cancelled nor consumed by a wedge of any cause since.

    events: (destination_id, sequence_number, event_id, kind), kind being halt_requested, halt_cancelled or wedged.
    A request while one is open changes nothing, so the first since the last end counts.
    """
    asks = F.col("kind") == "halt_requested"
    ends = events.groupBy("destination_id").agg(F.max(F.when(~asks, F.col("sequence_number"))).alias("__end"))
    waits = events.where(asks).join(ends, "destination_id").where(F.col("__end").isNull() | (F.col("sequence_number") > F.col("__end")))
    return waits.groupBy("destination_id").agg(F.min_by("event_id", "sequence_number").alias("request_event_id"))


def wedge_refusals(heads: DataFrame) -> DataFrame:
    """``heads`` with ``refusal``: null where the evidence supports wedging it for ``cause``.

    Columns: final_status, cause, attempts (count), last_outcome, max_attempts and time_bound (null: none in effect), halt_request
    (event id or null), transform_failed.
    """
    permanent = F.col("last_outcome").eqNullSafe(F.lit("permanent"))
    spent = (F.col("attempts") >= 1) & (F.col("time_bound").isNotNull() | (F.col("attempts") >= F.col("max_attempts")))
    cause = F.col("cause")
    supported = (
        F.when(cause == "permanent_refusal", permanent)
        .when(cause == "retry_budget_exhausted", spent)
        .when(cause == "operator_halt", F.col("halt_request").isNotNull() & ~permanent)
        .when(cause == "transform_failed", F.col("transform_failed"))
        .when(cause == "acknowledgement_invalid", F.lit(True))
    )
    refusal = F.when(F.col("final_status").isNotNull(), "not_pending").when(~cause.isin(*WEDGE_CAUSES), "cause_unknown").when(~F.coalesce(supported, F.lit(False)), "evidence")
    return heads.withColumn("refusal", refusal)


def relinked(deliveries: DataFrame) -> DataFrame:
    """(destination_id, generation, delivery_number) of retained deliveries that don't link to the one before, so that only a new generation can follow.

    deliveries: (destination_id, generation, delivery_number, delivery_hash, previous_hash).
    """
    before = deliveries.select("destination_id", "generation", (F.col("delivery_number") + 1).alias("delivery_number"), F.col("delivery_hash").alias("__before"))
    joined = deliveries.join(before, ["destination_id", "generation", "delivery_number"], "left")
    first = F.col("delivery_number") == 1
    wrong = F.when(first, F.col("previous_hash").isNotNull()).otherwise(F.col("__before").isNotNull() & ~F.col("previous_hash").eqNullSafe(F.col("__before")))
    return joined.where(wrong).select("destination_id", "generation", "delivery_number")

"""Commands in batches: content dedupe, idempotency, and the events that come of them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomlog.functions.values import clean_error
from fathomlog.operators.chain import BLOCK

# Why a command is denied.
DENIALS = ("unknown_action", "missing_key", "parse_error", "idempotency_mismatch", "validation_error", "not_authorized", "execution_error")


def content_changes(log: DataFrame, content: Column, keys: tuple[str, ...] = ("aggregate_id", "entry_type")) -> DataFrame:
    """Events whose content differs from the event before of the same keys; repeats are what dedupe would not append."""
    hashed = log.withColumn("__content", F.sha2(content, 256)).withColumn("__block", F.floor(F.col("sequence_number") / F.lit(BLOCK)))
    # Within blocks of positions, so that a key's history is no single task; a block's first event looks at the blocks before.
    own = Window.partitionBy(*keys, "__block").orderBy("sequence_number")
    within = hashed.withColumn("__n", F.row_number().over(own)).withColumn("__before", F.lag("__content").over(own))
    last = hashed.groupBy(*keys, "__block").agg(F.max_by("__content", "sequence_number").alias("__last"))
    prior = last.select(*(F.col(k).alias(f"__{k}") for k in keys), F.col("__block").alias("__b"), F.lag("__last").over(Window.partitionBy(*keys).orderBy("__block")).alias("__prior"))
    on = F.col("__block") == F.col("__b")
    for k in keys:
        on &= F.col(k).eqNullSafe(F.col(f"__{k}"))
    before = F.when(F.col("__n") == 1, F.col("__prior")).otherwise(F.col("__before"))
    return within.join(prior, on, "left").where(~F.col("__content").eqNullSafe(before)).select(*log.columns)


def idempotency(commands: DataFrame, held: DataFrame, now: Column) -> DataFrame:
    """``commands`` (action, principal, key, input_hash, arrival) with ``outcome``: run, replay or idempotency_mismatch.

    held: (action, principal, key, held_hash, expires_at). Entries count until they expire; among new commands
    of one key the first runs. Commands without key always run.
    """
    keys = ["action", "principal", "key"]
    alive = held.where(F.col("expires_at") > now).select(*keys, "held_hash")
    first = F.first("input_hash").over(Window.partitionBy(*keys).orderBy("arrival"))
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy("arrival"))
    joined = commands.withColumn("__first", first).withColumn("__nth", nth).join(alive, keys, "left")
    known = F.coalesce("held_hash", F.when(F.col("__nth") > 1, F.col("__first")))
    outcome = F.when(F.col("key").isNull() | known.isNull(), "run").when(known == F.col("input_hash"), "replay").otherwise("idempotency_mismatch")
    return joined.withColumn("outcome", outcome).drop("__first", "__nth", "held_hash")


@dataclass(frozen=True)
class Action:
    """A kind of command.

    valid and draft take the commands' DataFrame: a condition on the input, and the columns (aggregate_id,
    entry_type, event_type, data) of the event that it appends.
    """

    name: str
    permission: str
    valid: Callable[[DataFrame], Column]
    draft: Callable[[DataFrame], dict[str, Column]]
    needs_key: bool = False


def dispatch(commands: DataFrame, actions: list[Action], held: DataFrame, allowed: DataFrame, now: datetime) -> tuple[DataFrame, DataFrame]:
    """Results (request_id, outcome) of all commands, and the events (request_id, ...) of those that run.

    commands: (request_id, action, principal, key, input, arrival). allowed: (request_id, allowed), as of the same
    snapshot of the views. Checks come in order: action, key, idempotency, validity, permission.
    """
    hashed = commands.withColumn("input_hash", F.sha2("input", 256))
    judged = idempotency(hashed, held, F.lit(now)).join(allowed, "request_id", "left")
    outcome = F.lit("unknown_action")
    for action in actions:
        own = (
            F.when(F.lit(action.needs_key) & F.col("key").isNull(), "missing_key")
            .when(F.col("outcome") != "run", F.col("outcome"))
            .when(~F.coalesce(action.valid(judged), F.lit(False)), "validation_error")
            .when(~F.coalesce("allowed", F.lit(False)), "not_authorized")
            .otherwise("done")
        )
        outcome = F.when(F.col("action") == action.name, own).otherwise(outcome)
    decided = judged.withColumn("outcome", outcome)
    events = None
    for action in actions:
        ran = decided.where((F.col("action") == action.name) & (F.col("outcome") == "done"))
        made = ran.select("request_id", *(c.alias(n) for n, c in action.draft(ran).items()))
        events = made if events is None else events.unionByName(made)
    return decided.select("request_id", "action", "principal", "key", "outcome"), events


def denials(results: DataFrame, message: Column | None = None) -> DataFrame:
    """One event per denied command, its message cleaned of what shows the host."""
    denied = results.where(F.col("outcome").isin(*DENIALS))
    text = clean_error(message) if message is not None else F.lit(None).cast("string")
    return denied.select("request_id", F.concat(F.lit("denied_"), F.col("outcome")).alias("event_type"), text.alias("message"))

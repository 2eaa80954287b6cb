"""Delivery envelopes: JSON texts that carry a channel's events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The envelope's version and its exact keys.
VERSION = "esd/batch@3"
KEYS = (
    "attributes batch_format_version batch_id channel delivery_hash delivery_number events previous_delivery_hash "
    "sender_hop sender_identifier sender_software_version sent_at"
).split()
CHANNEL = "struct<sender_database_id:string,destination_id:string,registration_id:string,generation:bigint>"


def refusal(text: Column) -> Column:
    """Why an envelope can't be read, or null."""
    version = F.get_json_object(text, "$.batch_format_version")
    keys = F.array_sort(F.json_object_keys(text))
    events = F.get_json_object(text, "$.events")
    return (
        F.when(keys.isNull(), "not_an_object")
        .when(~version.eqNullSafe(F.lit(VERSION)), "format_unsupported")
        .when(keys != F.array(*(F.lit(k) for k in sorted(KEYS))), "keys")
        .when(~F.coalesce(F.get_json_object(text, "$.attributes").startswith("{"), F.lit(False)), "attributes_not_object")
        .when(~F.coalesce(events.startswith("["), F.lit(False)), "events_not_array")
        .when(F.coalesce(F.json_array_length(events), F.lit(0)) == 0, "no_events")
        .when(F.coalesce(F.get_json_object(text, "$.delivery_number").cast("bigint"), F.lit(0)) < 1, "delivery_number")
    )


def decode(envelopes: DataFrame, text: str = "envelope") -> DataFrame:
    """``envelopes`` with ``refusal``, channel, delivery_number, delivery_hash, previous_delivery_hash and events (JSON texts)."""
    body = F.col(text)
    get = lambda k: F.get_json_object(body, f"$.{k}")
    out = envelopes.withColumn("refusal", refusal(body))
    read = {
        "channel": F.from_json(get("channel"), CHANNEL),
        "delivery_number": get("delivery_number").cast("bigint"),
        "delivery_hash": get("delivery_hash"),
        "previous_delivery_hash": get("previous_delivery_hash"),
        "events": F.transform(F.from_json(get("events"), "array<variant>"), lambda v: F.to_json(v)),
    }
    return out.withColumns({n: F.when(F.col("refusal").isNull(), c) for n, c in read.items()})

"""Taking in events from other databases: what each record is, and what each delivery is."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomlog.functions.canonical_json import content_hash
from fathomlog.sources.event_log import with_positions
from fathomlog.sources.scratch import written


def classify(incoming: DataFrame, log: DataFrame, *, order: str = "arrival", unstorable: Column | None = None) -> DataFrame:
    """``incoming`` (event_id, sealed_hash, ``order``) with ``outcome``.

    ``duplicate``: held already, or earlier among the incoming, with the same hash; ``kept_in_finding``: it can't be
    stored, or its id is taken by another hash; ``ingested_with_finding``: stored though its predecessor is wrong;
    ``ingested`` otherwise.
    """
    held = log.select("event_id", F.col("sealed_hash").alias("held_hash"))
    first = Window.partitionBy("event_id").orderBy(order)
    ranked = incoming.withColumn("first_hash", F.first("sealed_hash").over(first)).withColumn("nth", F.row_number().over(first))
    known = F.coalesce("held_hash", F.when(F.col("nth") > 1, F.col("first_hash")))
    outcome = (
        F.when(unstorable if unstorable is not None else F.lit(False), "kept_in_finding")
        .when(known.isNotNull() & (known == F.col("sealed_hash")), "duplicate")
        .when(known.isNotNull(), "kept_in_finding")
        .when(F.col("has_finding"), "ingested_with_finding")
        .otherwise("ingested")
    )
    if "has_finding" not in incoming.columns:
        ranked = ranked.withColumn("has_finding", F.lit(False))
    return ranked.join(held, "event_id", "left").withColumn("outcome", outcome).drop("first_hash", "nth", "held_hash")


def admission(incoming: DataFrame, registry: DataFrame, format_major: int) -> DataFrame:
    """``incoming`` with ``refusal``: null, or why its version or type isn't taken.

    registry: (entry_type, major, event_types), as many rows as there are entry types.
    """
    joined = incoming.join(F.broadcast(registry.withColumnRenamed("major", "known_major")), "entry_type", "left")
    refusal = (
        F.when(F.col("lib_format_version.major") != format_major, "data_format")
        .when(F.col("known_major").isNull(), "entry_type")
        .when(F.col("entry_type_version.major") > F.col("known_major"), "entry_type_version")
        .when(~F.array_contains("event_types", F.col("event_type")), "event_type")
    )
    return joined.withColumn("refusal", refusal).drop("known_major", "event_types")


def unstorable(data: str = "data", provenance: str = "provenance") -> Column:
    """Payloads with reserved keys, or records without provenance."""
    return F.coalesce(F.exists(F.json_object_keys(data), lambda k: k.startswith("$")), F.lit(False)) | (F.coalesce(F.size(provenance), F.lit(0)) < 1)


def misplaced(provenance: str = "provenance") -> Column:
    """Whether provenance doesn't place an event in an origin chain and a storage chain.

    It is none, or a receiver's hop lacks the arrival hash, the first receiver's the origin's position, or one before the last its own position.
    """
    p = F.col(provenance)

    def lacks(hop: Column, k: Column) -> Column:
        first, inner = (k == 1) & hop["origin_sequence_number"].isNull(), (k < F.size(p) - 1) & hop["ingest_sequence_number"].isNull()
        return (k > 0) & (hop["arrival_hash"].isNull() | first | inner)

    return p.isNull() | F.exists(F.transform(p, lacks), lambda x: x)


def unstorable_reason(originator: Column, shapes: dict[str, tuple[frozenset[str], frozenset[str]]], audits: frozenset[str] = frozenset(), data: str = "data", provenance: str = "provenance") -> Column:
    """Why a record isn't stored as an event, null where it is: ``record_malformed``, ``reserved_type_undeclared`` or ``audit_identity_invalid``, the first that holds.

    shapes: of each reserved entry type that is declared, its aggregate and event types. audits: those of them that are destination audits, whose
    ``id`` and ``database_id`` must be texts, not empty and without bars, and the latter the originator's. Other reserved types are stored as they come.
    """
    reserved = F.coalesce(F.exists(F.json_object_keys(data), lambda k: k.startswith("$")), F.lit(False))
    shaped = F.lit(None).cast("boolean")
    for entry_type, (aggregates, events) in sorted(shapes.items()):
        shaped = F.when(F.col("entry_type") == entry_type, F.col("aggregate_type").isin(*sorted(aggregates)) & F.col("event_type").isin(*sorted(events))).otherwise(shaped)
    fields = F.from_json(data, "map<string,variant>")

    def named(name: str) -> Column:
        v = F.try_element_at(fields, F.lit(name))
        return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))

    sound = lambda text: F.coalesce((F.length(text) > 0) & ~text.contains("|"), F.lit(False))
    audit = F.col("entry_type").isin(*sorted(audits)) if audits else F.lit(False)
    identified = sound(named("id")) & sound(named("database_id")) & named("database_id").eqNullSafe(originator)
    return (
        F.when(reserved | misplaced(provenance), "record_malformed")
        .when(~F.coalesce(shaped, F.lit(True)), "reserved_type_undeclared")
        .when(audit & ~identified, "audit_identity_invalid")
    )


def foreign(sender: Column, provenance: str = "provenance") -> Column:
    """Whether neither end of an event's provenance is the channel's sender."""
    p = F.col(provenance)
    return ~(F.get(p, F.lit(0))["database_id"].eqNullSafe(sender) & F.element_at(p, -1)["database_id"].eqNullSafe(sender))


ACCEPTED = "channel string, arrival long, delivery_number long, outcome string"
#: Arrivals of a channel that are walked together.
BLOCK = 100_000
_STATE = "channel string, block long, number long, digest string"
_STEP = f"{_STATE}, to_number long, to_digest string, marker boolean"


def _columns(batch: pa.RecordBatch, names: str) -> Iterator[tuple]:
    return zip(*(batch.column(c).to_pylist() for c in names.split()), strict=True)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows, strict=True), fields, strict=True)], [n for n, _ in fields])


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Where each state that a block goes on from leads to, from its sound deliveries, latest first: what arrives earlier comes before."""
    at, leads = None, {}

    def steps() -> list[tuple]:
        return [(*at, *state, *to, False) for state, to in leads.items()] + [(*at, None, None, None, None, True)]

    for batch in batches:
        out = []
        for channel, block, own, stated, before, sound in _columns(batch, "channel block delivery_number delivery_hash previous_hash sound"):
            if at is None or at != (channel, block):
                out += steps() if at is not None else []
                at, leads = (channel, block), {}
            if sound:
                leads[own - 1, before] = leads.get((own, stated), (own, stated))
        if out:
            yield _batch(out, _STEP)
    if at is not None:
        yield _batch(steps(), _STEP)


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state in which each block of a channel is entered, from the steps of its blocks in order, a block's marker last."""
    at, begun, state, after = None, False, (0, None), None
    for batch in batches:
        out = []
        for channel, block, number, digest, to_number, to_digest, marker in _columns(batch, "channel block number digest to_number to_digest marker"):
            if not begun or channel != at:
                at, begun, state, after = channel, True, (0, None), None
            if marker:
                out.append((channel, block, *state))
                state, after = after or state, None
            elif (number, digest) == state:
                after = to_number, to_digest
        if out:
            yield _batch(out, _STATE)


def _outcomes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at, number, digest = None, 0, None
    for batch in batches:
        out = []
        for channel, block, entered, left, own, sound, stated, before in _columns(batch, "channel block number digest delivery_number sound delivery_hash previous_hash"):
            if at is None or (channel, block) != at:
                at, number, digest = (channel, block), entered, left
            if not sound:
                out.append("hash_mismatch")
            elif own == number and stated == digest:
                out.append("represented")
            elif own == number + 1 and before == digest:
                number, digest = own, stated
                out.append("accepted")
            else:
                out.append("out_of_sequence")
        yield pa.RecordBatch.from_arrays([batch.column("channel"), batch.column("arrival"), batch.column("delivery_number"), pa.array(out, pa.string())], ["channel", "arrival", "delivery_number", "outcome"])


def accept_deliveries(deliveries: DataFrame) -> DataFrame:
    """(channel, arrival, delivery_number, outcome) from (channel, arrival, delivery_number, delivery_hash, previous_hash, computed_hash).

    In the order of arrival per channel: the next number that links to the last hash is accepted; the last number with
    its hash again is represented; a hash that isn't the content's is refused; anything else is out of sequence.

    A channel is worked off by blocks of arrivals in parallel. A block takes few states any further: those that one of its deliveries
    links to and that an earlier block may have left, which is only where the delivery that makes the state arrived earlier. Where those lead is walked
    block by block, a handful of rows each; then every block is walked from the state that it is entered in. Only channels of several blocks need that.
    """
    sound = F.coalesce(F.col("delivery_hash") == F.col("computed_hash"), F.lit(False))
    block = F.floor(F.col("arrival") / F.lit(BLOCK)).cast("long")
    dealt = written(deliveries.select(F.col("channel").cast("string").alias("channel"), "arrival", F.col("delivery_number").cast("long").alias("delivery_number"), "delivery_hash", "previous_hash", sound.alias("sound"), block.alias("block")))
    # Most channels are one block, which is entered in the first state.
    spans = dealt.groupBy(F.col("channel").alias("l_channel")).agg(F.min("block").alias("low"), F.max("block").alias("high"))
    several = written(spans.where("low < high").select("l_channel"))
    long = dealt.join(several, F.col("channel").eqNullSafe(F.col("l_channel")), "left_semi")
    steps = long.repartition("channel", "block").sortWithinPartitions("channel", "block", F.desc("arrival")).mapInArrow(_steps, _STEP)
    born = long.where("sound").groupBy(F.col("channel").alias("b_channel"), F.col("delivery_number").alias("b_number"), F.col("delivery_hash").alias("b_digest")).agg(F.min("block").alias("born"))
    made = F.col("channel").eqNullSafe(F.col("b_channel")) & (F.col("number") == F.col("b_number")) & F.col("digest").eqNullSafe(F.col("b_digest"))
    possible = F.col("marker") | (F.col("born") < F.col("block")) | ((F.col("number") == 0) & F.col("digest").isNull())
    few = steps.join(born, made, "left").where(possible).select(*[x.split()[0] for x in _STEP.split(", ")])
    entered = few.repartition("channel").sortWithinPartitions("channel", "block", "marker").mapInArrow(_entries, _STATE)
    entered = written(entered.select(F.col("channel").alias("e_channel"), F.col("block").alias("e_block"), "number", "digest"))
    joined = dealt.join(entered, F.col("channel").eqNullSafe(F.col("e_channel")) & (F.col("block") == F.col("e_block")), "left").drop("e_channel", "e_block")
    joined = joined.withColumn("number", F.coalesce("number", F.lit(0)))
    return joined.repartition("channel", "block").sortWithinPartitions("channel", "block", "arrival").mapInArrow(_outcomes, ACCEPTED)


def channels(accepted: DataFrame) -> DataFrame:
    """The last accepted delivery of each channel."""
    rest = [c for c in accepted.columns if c != "channel"]
    return accepted.groupBy("channel").agg(F.max_by(F.struct(*rest), "delivery_number").alias("r")).select("channel", "r.*")


def deliveries_between(accepted: DataFrame, channel: str, first: int, last: int) -> tuple[DataFrame, int | None]:
    """Deliveries first to last of a channel, and the first of them that can't be served."""
    own = accepted.where((F.col("channel") == channel) & F.col("delivery_number").between(first, last))
    spark = accepted.sparkSession
    lacking = spark.range(first, last + 1).withColumnRenamed("id", "delivery_number").join(own.select("delivery_number"), "delivery_number", "left_anti")
    missing = lacking.agg(F.min("delivery_number")).first()[0]
    return (own if missing is None else own.where(F.col("delivery_number") < missing)).orderBy("delivery_number"), missing


def delivery_hash(channel: dict, number: int, previous: str | None, event_hashes: list[str], attributes: dict | None = None) -> str:
    return content_hash({"channel": channel, "number": number, "previous": previous, "events": event_hashes, "attributes": attributes or {}})


def restore_order(events: DataFrame, lineage_rank: DataFrame) -> DataFrame:
    """Events to restore, each (id, hash) once from its lowest delivery, by lineage and origin position.

    lineage_rank: (origin_db, rank).
    """
    lowest = events.groupBy("event_id", "sealed_hash").agg(F.min_by(F.struct(*[c for c in events.columns if c not in ("event_id", "sealed_hash")]), F.struct("registration", "generation", "delivery_number")).alias("e"))
    return lowest.select("event_id", "sealed_hash", "e.*").join(lineage_rank, "origin_db", "left").orderBy("rank", "origin_position")


def stamp(incoming: DataFrame, *, base: int, hop: str, identifier: str, database_id: str, received_at: str, order: str = "arrival") -> DataFrame:
    """Events as a receiver stores them: fresh positions from ``base + 1`` in the order of arrival, and one more hop in their provenance.

    The hop keeps the hash and the position under which an event came; ``event_hash`` is left to be computed anew
    over the whole (``event_hashes``). Hashes of the events before aren't linked here: they are known only as each is sealed.
    """
    ranked = with_positions(incoming.withColumn("__at", F.timestamp_seconds(F.col(order))), "__at", order, base=base, seconds=100_000, name="__place").drop("__at")
    fields = {
        "hop": F.lit(hop), "received_at": F.lit(received_at), "identifier": F.lit(identifier), "database_id": F.lit(database_id),
        "ingest_sequence_number": F.col("__place"), "arrival_hash": F.col("event_hash"), "origin_sequence_number": F.col("sequence_number"),
    }
    kinds = incoming.schema["provenance"].dataType.elementType
    added = F.struct(*(fields.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in kinds))
    return ranked.withColumn("provenance", F.array_append(F.coalesce("provenance", F.array().cast(incoming.schema["provenance"].dataType)), added)).withColumn("sequence_number", F.col("__place")).drop("__place", "event_hash")


def delivery_faults(deliveries: DataFrame) -> DataFrame:
    """``deliveries`` (channel, delivery_number from 1, delivery_hash, previous_hash, computed_hash) with ``fault`` and ``served``.

    fault: ``hash_mismatch``, its hash isn't that of its content; ``missing_before``, the number before isn't held (without channel
    none is); ``link_break``, it doesn't name that one's hash (nothing, for the first); null if it is sound. served: every delivery of its
    channel up to it is sound. A delivery's neighbour is looked up within blocks of numbers, to each of which the last delivery of the block before is
    added, so a channel that holds much of the table is many tasks, and deliveries that are dealt by their channels aren't dealt again for it.
    """
    at = F.col("delivery_number").cast("long")
    block = F.floor(at / F.lit(BLOCK))
    blocks = F.when((at + 1) % F.lit(BLOCK) == 0, F.array(block, block + 1)).otherwise(F.array(block))
    # Whether a hash is wrong is told before rows are sorted, so that the other hash needn't be.
    odd = ~F.col("delivery_hash").eqNullSafe(F.col("computed_hash"))
    placed = deliveries.withColumn("__odd", odd).withColumn("__at", at).withColumn("__block", F.explode(blocks))
    at_before = Window.partitionBy("channel", "__block").orderBy("__at").rangeBetween(-1, -1)
    held = F.col("channel").isNotNull() & F.col("__at").isNotNull() & (F.count("*").over(at_before) > 0)
    known = placed.withColumn("__held", held).withColumn("__before", F.max("delivery_hash").over(at_before))
    first = F.col("delivery_number") == 1
    fault = (
        F.when(F.col("__odd"), "hash_mismatch")
        .when(~first & ~F.col("__held"), "missing_before")
        .when(~F.col("previous_hash").eqNullSafe(F.when(~first, F.col("__before"))), "link_break")
    )
    marked = known.where(F.col("__block").eqNullSafe(F.floor(F.col("__at") / F.lit(BLOCK)))).withColumn("fault", fault).select(*deliveries.columns, "fault")
    ends = marked.where("fault is not null").groupBy(F.col("channel").alias("e_channel")).agg(F.min("delivery_number").alias("broken"))
    out = marked.join(ends, F.col("channel").eqNullSafe(F.col("e_channel")), "left")
    return out.select(*marked.columns, (F.col("broken").isNull() | (F.col("delivery_number") < F.col("broken"))).alias("served"))


def restore_once(occurrences: DataFrame, place: tuple[str, ...] = ()) -> DataFrame:
    """``restore_choice`` of occurrences that all have an id; a null is one like any other.

    What isn't the lowest of an id and hash is left out before rows move, so an id that is served over and over is no hot key; only what is left, one row to an
    id and hash, moves again to be compared by id.
    """
    lowest = Window.partitionBy("event_id", "event_hash").orderBy("registration", "generation", "delivery_number", *place)
    once = occurrences.withColumn("__nth", F.row_number().over(lowest)).where("__nth = 1").drop("__nth")
    best = Window.partitionBy("event_id").orderBy(~F.coalesce("storable", F.lit(False)), "registration", "generation", "delivery_number", "event_hash")
    return once.withColumn("place", F.when(F.row_number().over(best) == 1, "stored").otherwise("other_hash"))


def restore_choice(occurrences: DataFrame, place: tuple[str, ...] = ()) -> DataFrame:
    """What becomes of each distinct event of a restore: ``stored``, ``other_hash`` or ``unkeyed``, one row each.

    occurrences: (event_id, event_hash, registration, generation, delivery_number, storable, ...). Of one id and hash the lowest (registration,
    generation, delivery_number) counts; ``place``: columns that tell apart occurrences with the same of these, of which the lowest counts. Of an id's hashes one that can be stored comes first, then the lowest; the others
    are told apart as ``other_hash``. Rows without id can't be told apart and stay, each.
    """
    chosen = restore_once(occurrences.where("event_id is not null"), place)
    return chosen.unionByName(occurrences.where("event_id is null").withColumn("place", F.lit("unkeyed")))


def restore_findings(taken: DataFrame, lineage_rank: DataFrame, predecessor: Column) -> DataFrame:
    """What ``restore_choice`` took with rank, ``finding`` and where it is kept, in no order; see ``restore``."""
    ranked = taken.join(lineage_rank, "origin_db", "left").withColumn("from_sender", predecessor)
    finding = (
        F.when(F.col("rank").isNull() & ~F.coalesce("from_sender", F.lit(False)), "foreign")
        .when(F.col("place") == "other_hash", "identity_mismatch")
        .when(~F.coalesce("storable", F.lit(False)), "event_unstorable")
    )
    kept = ranked.withColumn("finding", finding).withColumn("place", F.when(finding.isNotNull() & (F.col("place") == "stored"), "kept_in_finding").otherwise(F.col("place")))
    return kept.select(*taken.columns, "rank", "finding")


def restore(deliveries: DataFrame, occurrences: DataFrame, lineage_rank: DataFrame, predecessor: Column, place: tuple[str, ...] = ()) -> DataFrame:
    """The events that a restore takes, in the order in which they are stored, with ``place`` and ``finding``.

    Only deliveries that are served count (``delivery_faults``); events that neither come from the channel's sender (``predecessor``) nor from one of its
    lineage (origin_db, rank) are ``foreign``; what can't be stored is ``event_unstorable``, an id's further hash ``identity_mismatch``. Stored events
    come first, by lineage and origin position, then what is kept in findings alone. place: see ``restore_choice``.
    """
    served = delivery_faults(deliveries).where("served").select("channel", "delivery_number").distinct()
    taken = restore_choice(occurrences.join(served, ["channel", "delivery_number"], "left_semi"), place)
    return restore_findings(taken, lineage_rank, predecessor).orderBy(F.col("place") != "stored", "rank", "origin_position", "event_id", "event_hash")

"""Folding events into views: the step, and how Spark runs it.

``step`` is one pure function from a row and an event to the row after it. It serves
all forms: ``fold`` deals events by row key, sorts them within their partitions and runs it
over each partition once, holding one row at a time (exact for every definition), and the
streaming form keeps the row as state. ``latest_rows`` and
``path_writes`` are DataFrame forms for definitions whose outcome doesn't depend on the
row before: they shuffle and aggregate in the JVM and are the ones to use at scale.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from datetime import UTC, datetime, timedelta

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomlog.functions.timestamps import iso_of
from fathomlog.functions.values import deep_merge, shallow_merge
from fathomlog.plans import columns
from fathomlog.plans.promotion import Promotions
from fathomlog.plans.specs import AggregateView, Combined, ConstantFields, EventTimestamp, FoldFailure, ListLength, SelectedFields, TableView, WholePayload
from fathomlog.sources.scratch import written

#: Positions whose operations of a key are walked together.
BLOCK = 100_000
#: Columns of an event that a fold reads.
EVENT = "sequence_number event_id aggregate_id aggregate_type entry_type entry_type_version event_type data client_timestamp".split()


def aggregate_step(view: AggregateView, row: dict | None, event: dict) -> dict | None:
    if event["event_type"] in view.tombstones:
        return None
    moment = iso_of(event["client_timestamp"])
    out = deep_merge(row or {}, event["data"])
    out |= {
        "aggregateId": event["aggregate_id"],
        "entryType": event["entry_type"],
        "aggregateType": event["aggregate_type"],
        "latestEventId": event["event_id"],
        "updatedAt": moment,
        "firstEventTimestamp": row["firstEventTimestamp"] if row else moment,
        "sequence": event["sequence_number"],
    }
    for derived in view.derived:  # each sees the ones before it
        out[derived.name] = derived(out)
    return out


def keyed_operations(view: TableView, event: dict) -> list[tuple[str, str, dict]]:
    """(row key, operation, data) that an event asks for; keys and data are extracted whether or not a row exists."""
    kind = view.operation(event["event_type"])
    if kind == "none":
        return []
    if kind == "listed":
        return [(key, "drop", {}) for key in view.listed(event)]
    key = view.row_key(event)
    data = view.row_data(event) if kind == "insert" else view.update_data(event) if kind == "update" else {}
    return [(key, kind, data)]


def table_step(view: TableView, row: dict | None, key: str, kind: str, data: dict, event: dict) -> dict | None:
    stamps = {"aggregateId": key, "sequence": event["sequence_number"]}
    if kind == "insert":
        return data | stamps
    if row is None or kind == "drop":
        return None
    if view.match_field and row.get(view.match_field, None) != event["data"].get(view.match_field, None):
        return row
    return shallow_merge(row, data) | stamps if kind == "update" else None


def check_versions(log: DataFrame, declared: dict[str, tuple[int, int]]) -> None:
    """Events of a later major than declared are an error before anything is folded, never a skipped failure."""
    for entry_type, (major, _) in declared.items():
        newer = log.where((F.col("entry_type") == entry_type) & (F.col("entry_type_version.major") > major)).limit(1)
        if not newer.isEmpty():
            raise ValueError(f"{entry_type} has events of a later major than {major}")


class Folder:
    """Runs a view's step over the events of one key, in order, and notes what failed."""

    def __init__(self, view: AggregateView | TableView, promotions: Promotions | None = None, declared: dict[str, tuple[int, int]] | None = None):
        self.view, self.promotions, self.declared = view, promotions, declared or {}

    def promoted(self, event: dict, row: dict | None) -> dict:
        target, held = self.declared.get(event["entry_type"]), event["entry_type_version"]
        if not (self.promotions and target and held and tuple(held) < target and held[0] <= target[0]):
            return event
        # Rows of a table view don't shield fields from defaults.
        known = row if isinstance(self.view, AggregateView) else None
        return event | {"data": self.promotions.promote(self.view.name, event["entry_type"], tuple(held), target, event["data"], known)}

    def aggregate(self, row: dict | None, events: Iterable[dict]) -> tuple[dict | None, list[tuple[int, str, str]]]:
        failures = []
        for event in events:
            try:
                row = aggregate_step(self.view, row, self.promoted(event, row))
            except FoldFailure as e:
                failures.append((event["sequence_number"], e.reason, e.detail))
        return row, failures

    def operations(self, event: dict) -> tuple[list[tuple[str, str, dict]], list[tuple[int, str, str]]]:
        try:
            return keyed_operations(self.view, self.promoted(event, None)), []
        except FoldFailure as e:
            return [], [(event["sequence_number"], e.reason, e.detail)]


def event_dict(values: dict) -> dict:
    """An event as the steps take it, from a row with the EVENT columns."""
    version = values["entry_type_version"]
    if version is not None and not isinstance(version, tuple):
        version = (version["major"], version["minor"]) if isinstance(version, dict) else tuple(version)
    moment = values["client_timestamp"]
    moment = moment.to_pydatetime() if hasattr(moment, "to_pydatetime") else moment
    return values | {"data": json.loads(values["data"]), "entry_type_version": version, "client_timestamp": moment.replace(tzinfo=moment.tzinfo or UTC), "sequence_number": int(values["sequence_number"])}


ROWS = "row_key string, row_json string, source_aggregate_id string, position long, sequence_number long, reason string, detail string"
ASKED = "row_key string, kind string, row_data string, matched string, source string, sequence_number long, reason string, detail string"
_KINDS = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}
_START = datetime(1970, 1, 1, tzinfo=UTC)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, _KINDS[k]) for c, (_, k) in zip(zip(*rows, strict=True), fields, strict=True)], [n for n, _ in fields])


def _records(batch: pa.RecordBatch) -> Iterator[tuple]:
    return zip(*(c.to_pylist() for c in batch.columns), strict=True)


#: Columns of an event that are passed on as they are.
_PLAIN = [c for c in EVENT if c not in ("entry_type_version", "client_timestamp")]


def _plain_events(log: DataFrame) -> DataFrame:
    """The EVENT columns as texts and numbers, which cross to Python cheaply."""
    return log.select(*_PLAIN, F.col("entry_type_version.major").alias("major"), F.col("entry_type_version.minor").alias("minor"), F.unix_micros("client_timestamp").alias("micros"))


def _event(record: tuple) -> dict:
    event = dict(zip(_PLAIN, record, strict=False))
    major, minor, micros = record[len(_PLAIN) : len(_PLAIN) + 3]
    event["data"] = json.loads(event["data"])
    event["entry_type_version"] = None if major is None else (major, minor)
    event["client_timestamp"] = None if micros is None else _START + timedelta(microseconds=micros)
    return event


def _dump(value) -> str:
    return json.dumps(value, ensure_ascii=False, sort_keys=True)


def asked_operations(log: DataFrame, view: TableView, promotions: Promotions | None = None, declared: dict | None = None) -> DataFrame:
    """What each event asks of a table view's rows (row_key, kind, row_data, matched, source, sequence_number), and failures (reason, detail) without key.

    By columns, where the definition has such a form; events whose values have none, if there are any, go through the step function.
    What is read more than once is written first, so that payloads are opened once.
    """
    events = log.where(view.interest.condition(log))
    if log.isStreaming:
        return _asked_by_steps(events, view, promotions, declared)
    try:
        rows, odd = columns.asked(events, view, promotions, declared)
    except columns.NoColumns:
        return _asked_by_steps(events, view, promotions, declared)
    if odd is not None or not view.match_field:
        rows = written(rows.select(*(EVENT if odd is not None else ("aggregate_id", "sequence_number")), "failed", "ops", "matched", "odd"))
    if odd is None or rows.where(odd).isEmpty():
        return columns.asked_rows(rows)
    return columns.asked_rows(rows.where(~odd)).union(_asked_by_steps(rows.where(odd).select(*EVENT), view, promotions, declared))


def _asked_by_steps(events: DataFrame, view: TableView, promotions: Promotions | None = None, declared: dict | None = None) -> DataFrame:
    folder = Folder(view, promotions, declared)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for record in _records(batch):
                event = _event(record)
                source, place = event["aggregate_id"], event["sequence_number"]
                operations, failed = folder.operations(event)
                # Guards see the payload as promoted, as the step does.
                matched = json.dumps(folder.promoted(event, None)["data"].get(view.match_field)) if view.match_field and operations else None
                out += [(key, kind, json.dumps(data, ensure_ascii=False), matched, source, place, None, None) for key, kind, data in operations]
                out += [(None, None, None, None, source, s, reason, detail) for s, reason, detail in failed]
            if out:
                yield _batch(out, ASKED)

    return _plain_events(events).mapInArrow(spread, ASKED)


def fold_operations(asked: DataFrame, view: TableView, held: DataFrame | None = None) -> DataFrame:
    """View rows and failures from ``asked_operations``, going on from rows ``held``.

    Aggregates do for all but views with a match field. Of those a key's operations are walked by blocks of positions
    that run in parallel, each to what it does to a row that enters it: an insert or a listed removal settles the row whatever came before;
    else only rows of one of the block's match values change, which stay of that value. The blocks' summaries are then walked in order.
    Where updates may change the match field itself, a key is walked as a whole.
    """
    if not view.match_field:
        return columns.table_rows(asked, held)
    if held is not None:
        rows = held.select("row_key", F.lit("held").alias("kind"), F.col("row_json").alias("row_data"), F.lit(None).cast("string").alias("matched"), F.col("source_aggregate_id").alias("source"), F.lit(-1).cast("long").alias("sequence_number"))
        asked = asked.unionByName(rows, allowMissingColumns=True)
    block = F.floor(F.col("sequence_number") / F.lit(BLOCK)).cast("long") if keeps_match(view.update_data, view.match_field) else F.lit(0).cast("long")
    # Failures have no key; they are dealt by their positions.
    dealt = asked.withColumn("block", block).withColumn("dealt", F.when(F.col("row_key").isNull(), F.pmod("sequence_number", F.lit(64))))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, segment = None, None
        for batch in batches:
            out = []
            for key, kind, data, matched, own, place, reason, detail, where, _ in _records(batch):
                if key is None:
                    out.append((None, where, None, None, None, None, own, None, place, reason, detail))
                    continue
                if (key, where) != at:
                    out += segment.rows() if segment else []
                    at, segment = (key, where), Segment(view, key, where)
                segment.add(kind, json.loads(data), json.loads(matched) if matched is not None else None, own, place)
            if out:
                yield _batch(out, SEGMENTS)
        if segment:
            yield _batch(segment.rows(), SEGMENTS)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, row, source = None, None, None
        for batch in batches:
            out = []
            for key, _, settled, matched, alive, data, own, place, failed_at, reason, detail in _records(batch):
                if key is None:
                    out.append((None, None, own, None, failed_at, reason, detail))
                    continue
                if key != at:
                    if row:
                        out.append((at, _dump(row), source, row["sequence"], None, None, None))
                    at, row, source = key, None, None
                if settled:
                    row, source = json.loads(data) if alive else None, own
                elif row is not None and equal_key(row.get(view.match_field)) == matched:
                    row, source = (row | json.loads(data) | {"aggregateId": key, "sequence": place}, own) if alive else (None, None)
            if out:
                yield _batch(out, ROWS)
        if row:
            yield _batch([(at, _dump(row), source, row["sequence"], None, None, None)], ROWS)

    segments = dealt.repartition("row_key", "dealt", "block").sortWithinPartitions("row_key", "block", "sequence_number").mapInArrow(summed, SEGMENTS)
    return segments.repartition("row_key", "sequence_number").sortWithinPartitions("row_key", "block").mapInArrow(joined, ROWS)


SEGMENTS = "row_key string, block long, settled boolean, matched string, alive boolean, row_data string, source string, position long, sequence_number long, reason string, detail string"


def keeps_match(spec, name: str) -> bool:
    """Whether row data leave a field as the payload has it, or out."""
    if isinstance(spec, WholePayload | SelectedFields):
        return True
    if isinstance(spec, ConstantFields):
        return name not in dict(spec.values)
    if isinstance(spec, ListLength | EventTimestamp):
        return spec.name != name
    return isinstance(spec, Combined) and all(keeps_match(part, name) for part in spec.parts)


def equal_key(value) -> str:
    """A text that two JSON values share exactly if they are equal: true is 1 and 1.0 is 1."""

    def plain(x):
        if isinstance(x, dict):
            return {k: plain(v) for k, v in x.items()}
        if isinstance(x, list):
            return [plain(v) for v in x]
        return int(x) if isinstance(x, bool) or (isinstance(x, float) and x.is_integer()) else x

    return json.dumps(plain(value), sort_keys=True)


class Segment:
    """What some consecutive operations of one key do to the row that stands before them."""

    def __init__(self, view: TableView, key: str, block: int):
        self.view, self.key, self.block = view, key, block
        self.settled, self.row, self.source = False, None, None
        #: By match value: fields to set, their origin and place; None once such a row is removed.
        self.changes: dict[str, tuple[dict, str | None, int] | None] = {}

    def add(self, kind: str, data: dict, matched, source: str | None, place: int) -> None:
        if kind == "held":
            self.settled, self.row, self.source = True, data, source
        elif kind in ("insert", "drop") or self.settled:
            event = {"data": {self.view.match_field: matched}, "sequence_number": place}
            after = table_step(self.view, self.row, self.key, kind, data, event)
            if after is not self.row or kind == "drop":
                self.row, self.source = after, source
            self.settled = True
        else:
            value = equal_key(matched)
            before = self.changes.get(value, ({}, None, place))
            if before is not None:
                self.changes[value] = (before[0] | data, source, place) if kind == "update" else None

    def rows(self) -> list[tuple]:
        if self.settled:
            return [(self.key, self.block, True, None, self.row is not None, _dump(self.row), self.source, None, None, None, None)]
        return [(self.key, self.block, False, value, change is not None, *((_dump(change[0]), change[1], change[2]) if change else (None,) * 3), None, None, None) for value, change in self.changes.items()]


def fold(log: DataFrame, view: AggregateView | TableView, promotions: Promotions | None = None, declared: dict | None = None, held: DataFrame | None = None) -> DataFrame:
    """View rows (row_key, row_json, source_aggregate_id, position) and failures (sequence_number, reason, detail).

    Rows have no reason, failures no row_json. Events are dealt by row key and sorted; a task walks its
    partition once and holds one row, however many events a key has. held: rows of an earlier fold, of which
    ``log`` holds the events that follow; keys that those don't touch come back as they were.
    """
    if isinstance(view, TableView):
        return fold_operations(asked_operations(log, view, promotions, declared), view, held)
    folder = Folder(view, promotions, declared)
    events = _plain_events(log.where(view.interest.condition(log))).withColumn("held", F.lit(False))
    if held is not None:
        rows = held.select(F.col("row_key").alias("aggregate_id"), F.col("row_json").alias("data"), F.lit(-1).cast("long").alias("sequence_number"), F.lit(True).alias("held"))
        events = events.withColumn("aggregate_id", F.col("aggregate_id").cast("string")).unionByName(rows, allowMissingColumns=True)
    place, data = _PLAIN.index("aggregate_id"), _PLAIN.index("data")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, row, begun, out = None, None, False, []
        for batch in batches:
            for record in _records(batch):
                key = record[place]
                if not begun or key != at:
                    if row:
                        out.append((at, _dump(row), at, row["sequence"], None, None, None))
                    at, row, begun = key, None, True
                if record[-1]:
                    row = json.loads(record[data])
                    continue
                row, failed = folder.aggregate(row, [_event(record)])
                out += [(key, None, key, None, *f) for f in failed]
            if out:
                yield _batch(out, ROWS)
                out = []
        if row:
            yield _batch([(at, _dump(row), at, row["sequence"], None, None, None)], ROWS)

    return events.repartition("aggregate_id").sortWithinPartitions("aggregate_id", "sequence_number").mapInArrow(run, ROWS)


# DataFrame forms.


def live_events(log: DataFrame, is_tombstone: Column, key: str = "aggregate_id") -> DataFrame:
    """Events after the last tombstone of their aggregate, which is aggregated and joined: a hot key is combined map-side."""
    last = log.groupBy(key).agg(F.max(F.when(is_tombstone, F.col("sequence_number"))).alias("__last"))
    return log.join(last, key).where(F.col("__last").isNull() | (F.col("sequence_number") > F.col("__last"))).drop("__last")


def aggregate_rows(log: DataFrame, is_tombstone: Column, values: dict[str, Column], key: str = "aggregate_id") -> DataFrame:
    """Aggregate view rows for flat payloads: the last value of each field written since the last tombstone.

    values: payload fields as columns, null where an event has no such field. The last tombstone is
    aggregated with the events rather than looked up by a window, so a hot key is combined map-side.
    """
    position = F.col("sequence_number")
    last = log.groupBy(key).agg(F.max(F.when(is_tombstone, position)).alias("__last"))
    live = log.join(last, key).where(F.col("__last").isNull() | (position > F.col("__last")))
    fields = [F.max_by(v, F.when(v.isNotNull(), position)).alias(n) for n, v in values.items()]
    return live.groupBy(key).agg(
        *fields,
        F.max_by("event_id", position).alias("latest_event_id"),
        F.max_by("client_timestamp", position).alias("updated_at"),
        F.min_by("client_timestamp", position).alias("first_event_at"),
        F.max(position).alias("sequence"),
    )


def path_writes(log: DataFrame, is_tombstone: Column, key: str = "aggregate_id") -> DataFrame:
    """Deep merge without a fold: (key, path, value, sequence) of every leaf that is alive.

    Payloads are flattened to writes of paths, level by level, each level being written before the
    next is read, so neither their number nor their depth is bounded. The last write of a path holds, unless a later
    write of something other than an object replaced one of the path's ancestors.
    """
    spark = log.sparkSession
    level = live_events(log, is_tombstone, key).select(key, "sequence_number", F.array().cast("array<string>").alias("path"), F.parse_json("data").alias("v"))
    writes = None
    while True:  # one level of the payloads after another, until none holds an object
        opened = spark.sql(f"SELECT {key}, sequence_number, concat(path, array(x.key)) AS path, x.value AS v, schema_of_variant(x.value) AS kind FROM {{level}}, LATERAL variant_explode(v) x", level=level)
        is_object = F.col("kind").startswith("OBJECT")
        value = F.when(~is_object, F.to_json("v")).when(F.col("kind") == "OBJECT<>", F.lit("{}"))
        rows = written(opened.select(key, "sequence_number", "path", is_object.alias("is_object"), value.alias("value"), F.when(is_object & (F.col("kind") != "OBJECT<>"), F.col("v")).alias("v")))
        writes = rows.drop("v") if writes is None else writes.union(rows.drop("v"))
        level = rows.where("v is not null").select(key, "sequence_number", "path", "v")
        if level.isEmpty():
            break
    last = writes.groupBy(key, "path").agg(
        F.max("sequence_number").alias("written"),
        F.max(F.when(~F.col("is_object"), F.col("sequence_number"))).alias("replaced"),
        F.max_by(F.struct("value", "is_object"), "sequence_number").alias("w"),
    )
    ancestors = last.select(F.col(key).alias("__key"), F.col("path").alias("__ancestor"), "replaced").where("replaced is not null")
    leaves = last.where("not w.is_object or w.value = '{}'").select(key, "path", "written", F.col("w.value").alias("value"))
    prefixes = leaves.where("size(path) > 1").select(key, "path", "written", F.explode(F.expr("transform(sequence(1, size(path) - 1), n -> slice(path, 1, n))")).alias("prefix"))
    dead = prefixes.join(ancestors, (F.col(key) == F.col("__key")) & (F.col("prefix") == F.col("__ancestor")) & (F.col("replaced") > F.col("written"))).select(key, "path").distinct()
    return leaves.join(dead, [key, "path"], "left_anti").select(key, "path", "value", F.col("written").alias("sequence"))


def latest_rows(operations: DataFrame, fields: list[str]) -> DataFrame:
    """Table view rows from (row_key, sequence_number, op, *fields) without match field.

    The last insert or remove of a key decides whether it has a row; updates after that insert
    replace the fields that they carry (not null). Both are aggregates, combined map-side.
    """
    position = F.col("sequence_number")
    base = operations.where(F.col("op") != "update").groupBy("row_key").agg(
        F.max(position).alias("base"), *(F.max_by(F.struct("op", *fields), position).alias(n) for n in ("b",))
    ).where("b.op = 'insert'").select("row_key", "base", *(F.col(f"b.{c}").alias(f"base_{c}") for c in fields))
    later = operations.where(F.col("op") == "update").join(base.select("row_key", "base"), "row_key").where(position > F.col("base"))
    updates = later.groupBy("row_key").agg(
        F.max(position).alias("updated"), *(F.max_by(F.col(c), F.when(F.col(c).isNotNull(), position)).alias(f"new_{c}") for c in fields)
    )
    return base.join(updates, "row_key", "left").select(
        "row_key", *(F.coalesce(f"new_{c}", f"base_{c}").alias(c) for c in fields), F.coalesce("updated", "base").alias("sequence")
    )


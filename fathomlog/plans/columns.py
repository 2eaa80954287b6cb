"""Table view definitions as columns: what events ask of a view's rows, and the rows that follow, without Python in a task.

A payload is a map of its fields to variants. Keys, row data and promotions of payloads are expressions
over that map; a part of a definition without such a form raises ``NoColumns``. Values
whose text depends on how a number was written (fractions, decimals, whole objects as a part of a key) are ``odd``: the few
events that have some are left to the step functions, which the result is the same as. Numbers in row data keep all their digits.
"""

from __future__ import annotations

import json
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomlog.functions.timestamps import iso_text
from fathomlog.plans.promotion import Default, Drop, Promotions, Rename
from fathomlog.plans.specs import AggregateId, Combined, Composite, ConstantFields, EventTimestamp, FoldFailure, ListLength, PayloadField, SelectedFields, TableView, WholePayload

_MAP = "map<string,variant>"


class NoColumns(Exception):
    """A part of a definition that has no column form."""


def _text(value: str | None) -> Column:
    return F.lit(value).cast("string")


def _variants(values: dict[str, Any]) -> Column:
    return F.from_json(F.lit(json.dumps(values)), _MAP)


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def _nothing(v: Column) -> Column:
    return v.isNull() | F.is_variant_null(v)


def _is(v: Column, start: str) -> Column:
    return F.coalesce(_kind(v).startswith(start), F.lit(False))


def _merged(a: Column, b: Column) -> Column:
    """The fields of ``b`` over those of ``a``."""
    return F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b)


def _without(a: Column, name: str) -> Column:
    return F.map_filter(a, lambda k, _: k != name)


def _renamed(a: Column, source: str, target: str) -> Column:
    entry = lambda e: F.struct(F.when(e["key"] == source, F.lit(target)).otherwise(e["key"]).alias("key"), e["value"].alias("value"))
    return F.map_from_entries(F.transform(F.map_entries(a), entry))


def _named(condition: Column, name: str, value: Column) -> Column:
    """A map of one field where the condition holds, or an empty one."""
    return F.when(condition, F.map_from_arrays(F.array(F.lit(name)), F.array(value))).otherwise(_variants({}))


class _Part:
    """A value, why it can't be had (reason and detail, or null), and whether the step functions must decide."""

    def __init__(self, value: Column, detail: Column | None = None, odd: Column | None = None):
        self.value, self.detail, self.odd = value, _text(None) if detail is None else detail, F.lit(False) if odd is None else odd


def _resolved(path: str, item: Column | None = None) -> _Part:
    """A part of a key as text."""
    if path in ("aggregateId", "eventType") and not path.startswith("item."):
        return _Part(F.col("aggregate_id" if path == "aggregateId" else "event_type").cast("string"))
    if path.startswith("item."):
        v = _text(None) if item is None else F.try_element_at(item, F.lit(path[5:]))
    else:
        first, *rest = path.removeprefix("data.").split(".")
        if any("'" in x or "\\" in x for x in rest):
            raise NoColumns(path)
        v = F.try_element_at(F.col("__m"), F.lit(first))
        if rest:
            v = F.try_variant_get(v, "$" + "".join(f"['{x}']" for x in rest), "variant")
    known = _kind(v).isin("STRING", "BIGINT", "BOOLEAN")
    lost = _nothing(v)
    return _Part(F.try_variant_get(v, "$", "string"), F.when(lost, _text(f"{path} leads to nothing")), ~lost & ~known)


def _key(spec, item: Column | None = None) -> _Part:
    if isinstance(spec, AggregateId):
        return _Part(F.col("aggregate_id").cast("string"))
    if not isinstance(spec, Composite):
        raise NoColumns(spec)
    parts = [_resolved(p, item) for p in spec.paths]
    return _Part(F.concat_ws("|", *(p.value for p in parts)), F.coalesce(*(p.detail for p in parts), _text(None)), reduce(lambda a, b: a | b, (p.odd for p in parts)))


def _data(spec) -> _Part:
    """The fields that an extractor makes."""
    m = F.col("__m")
    field = lambda name: F.try_element_at(m, F.lit(name))
    if isinstance(spec, WholePayload):
        return _Part(m)
    if isinstance(spec, PayloadField):
        v = field(spec.name)
        return _Part(F.when(_is(v, "OBJECT"), F.try_variant_get(v, "$", _MAP)).otherwise(_variants({})), F.when(v.isNotNull() & ~_is(v, "OBJECT"), _text(f"{spec.name} is no object")))
    if isinstance(spec, SelectedFields):
        return _Part(F.map_filter(m, lambda k, _: k.isin(*spec.names)) if spec.names else _variants({}))
    if isinstance(spec, ConstantFields):
        return _Part(_variants(dict(spec.values)))
    if isinstance(spec, ListLength):
        v = field(spec.source)
        size = F.parse_json(F.size(F.try_variant_get(v, "$", "array<variant>")).cast("string"))
        return _Part(_named(_is(v, "ARRAY"), spec.name, size), F.when(~_nothing(v) & ~_is(v, "ARRAY"), _text(f"{spec.source} is no list")))
    if isinstance(spec, EventTimestamp):
        moment = F.parse_json(F.concat(F.lit('"'), iso_text(F.col("client_timestamp")), F.lit('"')))
        return _Part(_named(F.lit(True), spec.name, moment))
    raise NoColumns(spec)


def _parts(spec) -> list[_Part]:
    """The fields that an extractor makes, later parts over earlier ones."""
    return [x for p in spec.parts for x in _parts(p)] if isinstance(spec, Combined) else [_data(spec)]


def _with_data(events: DataFrame, name: str, spec, wanted: Column) -> tuple[DataFrame, Column]:
    """Adds ``name``, the fields that an extractor makes where they are ``wanted``; and why they can't be made.

    Parts are columns of their own: a lambda over the fields of one looks at those of the others, and must not make them anew for each field.
    """
    parts = _parts(spec)
    names = [f"{name}_{n}" for n in range(len(parts))]
    out = events.withColumns({n: F.when(wanted, p.value) for n, p in zip(names, parts, strict=True)})

    def own(n: int) -> Column:
        return F.map_filter(names[n], lambda k, _: ~reduce(lambda a, b: a | b, (F.map_contains_key(c, k) for c in names[n + 1 :])))

    left = [own(n) if n + 1 < len(names) else F.col(names[n]) for n in range(len(names))]
    value = F.map_concat(*left) if len(left) > 1 else left[0] if left else _variants({})
    return out.withColumn(name, value).drop(*names), F.coalesce(*(p.detail for p in parts), _text(None))


def json_of(fields: Column) -> Column:
    """A map of fields to JSON texts as one JSON object."""
    quoted = lambda k: F.substring(F.to_json(F.array(k)), F.lit(2), F.length(F.to_json(F.array(k))) - 2)
    return F.concat(F.lit("{"), F.array_join(F.transform(F.map_entries(fields), lambda e: F.concat(quoted(e["key"]), F.lit(":"), e["value"])), ","), F.lit("}"))


def texts_of(fields: Column) -> Column:
    """A map of fields to variants as one of fields to JSON texts."""
    return F.transform_values(fields, lambda _, v: F.to_json(v))


def _promoted(events: DataFrame, view: TableView, promotions: Promotions | None, declared: dict | None) -> DataFrame:
    """Adds ``__m``, the payload's fields as of the declared versions, and ``__failed``, why it can't be promoted."""
    m, failed = F.from_json("data", _MAP), _text(None)
    if not promotions or not declared:
        return events.withColumns({"__m": m, "__failed": failed})
    events = events.withColumn("__m", m)
    version = F.struct(F.col("entry_type_version.major").alias("major"), F.col("entry_type_version.minor").alias("minor"))
    held = events.where(F.col("entry_type").isin(list(declared)) & F.col("entry_type_version").isNotNull()).select("entry_type", version.alias("v")).distinct().collect()  # versions
    m = F.col("__m")
    for r in held:
        start, end = (r.v.major, r.v.minor), declared[r.entry_type]
        if start >= end or start[0] > end[0]:
            continue
        own = (F.col("entry_type") == r.entry_type) & (F.col("entry_type_version.major") == start[0]) & (F.col("entry_type_version.minor") == start[1])
        fields, broken = F.col("__m"), _text(None)
        try:
            for step in promotions.chain(view.name, r.entry_type, start, end):
                if isinstance(step, Rename):
                    both = F.map_contains_key(fields, step.source) & F.map_contains_key(fields, step.target)
                    broken = F.coalesce(broken, F.when(both, _text(f"{step.target} is there already")))
                    fields = F.when(F.map_contains_key(fields, step.source) & ~both, _renamed(fields, step.source, step.target)).otherwise(fields)
                elif isinstance(step, Default):
                    fields = F.when(F.map_contains_key(fields, step.name), fields).otherwise(F.map_concat(fields, _variants({step.name: step.value})))
                elif isinstance(step, Drop):
                    fields = _without(fields, step.name)
                else:
                    raise NoColumns(step)
        except FoldFailure as e:
            broken = _text(e.detail)
        m, failed = F.when(own, fields).otherwise(m), F.when(own, broken).otherwise(failed)
    return events.withColumn("__failed", failed).withColumn("__m", m)


def asked(log: DataFrame, view: TableView, promotions: Promotions | None = None, declared: dict | None = None) -> tuple[DataFrame, Column | None]:
    """What events of a log ask for (see ``folds.asked_operations``), a row to an event: (event columns, failed, ops, matched), and which are odd.

    ops: array of (row_key, kind, row_data). The second is None where no event of such a definition can be odd.
    """
    kinds = [("insert", view.inserts), ("update", view.updates), ("remove", view.removes), ("listed", view.listed.event_types if view.listed else frozenset())]
    kind = reduce(lambda out, k: F.when(F.col("event_type").isin(*sorted(k[1])), k[0]).otherwise(out) if k[1] else out, reversed(kinds), F.lit("none"))
    events = _promoted(log, view, promotions, declared).withColumn("__kind", kind)
    key = _key(view.row_key)
    is_ = lambda k: F.col("__kind") == k
    events, insert_detail = _with_data(events, "__insert", view.row_data, is_("insert"))
    events, update_detail = _with_data(events, "__update", view.update_data, is_("update"))
    texts = F.when(is_("insert"), F.to_json("__insert")).when(is_("update"), F.to_json("__update")).otherwise("{}")
    data_detail = F.when(is_("insert"), insert_detail).when(is_("update"), update_detail)
    failed = F.struct(F.lit("row_key_failed").alias("reason"), key.detail.alias("detail"))
    data_failed = F.struct(F.lit("row_data_failed").alias("reason"), data_detail.alias("detail"))
    one = F.array(F.struct(key.value.alias("row_key"), F.col("__kind").alias("kind"), texts.alias("row_data")))
    empty = F.expr("cast(array() as array<struct<row_key:string,kind:string,row_data:string>>)")
    keyed = F.col("__kind").isin("insert", "update", "remove")
    odd = F.when(keyed, key.odd).otherwise(F.lit(False))
    why = F.when(keyed, F.when(key.detail.isNotNull(), failed).when(data_detail.isNotNull(), data_failed))
    ops = F.when(keyed & why.isNull(), one)
    if view.listed:
        v = F.try_element_at(F.col("__m"), F.lit(view.listed.list_field))
        items = F.try_variant_get(v, "$", "array<variant>")
        each = Composite(view.listed.paths)
        sound = _is(v, "ARRAY") & F.forall(items, lambda x: _is(x, "OBJECT"))
        opened = lambda x: F.try_variant_get(x, "$", _MAP)
        lost = F.filter(F.transform(items, lambda x: _key(each, opened(x)).detail), lambda d: d.isNotNull())
        no_list = F.when(~_nothing(v) & ~sound, _text(f"{view.listed.list_field} is no list of objects"))
        detail = F.coalesce(no_list, F.when(sound, F.get(lost, F.lit(0))))
        listed = is_("listed")
        why = F.when(listed & detail.isNotNull(), F.struct(F.lit("row_key_failed").alias("reason"), detail.alias("detail"))).otherwise(why)
        drops = F.transform(items, lambda x: F.struct(_key(each, opened(x)).value.alias("row_key"), F.lit("drop").alias("kind"), F.lit("{}").alias("row_data")))
        ops = F.when(listed & sound & detail.isNull(), drops).otherwise(ops)
        odd = F.when(listed & sound, F.exists(items, lambda x: _key(each, opened(x)).odd)).otherwise(odd)
    broken = F.struct(F.lit("promoter_failed").alias("reason"), F.col("__failed").alias("detail"))
    why = F.when(F.col("__failed").isNotNull(), broken).otherwise(why)
    ops = F.coalesce(F.when(F.col("__failed").isNull(), ops), empty)
    matched = F.coalesce(F.to_json(F.try_element_at(F.col("__m"), F.lit(view.match_field))), F.lit("null")) if view.match_field else _text(None)
    may_be_odd = not isinstance(view.row_key, AggregateId) or view.listed is not None
    rows = events.select(*log.columns, why.alias("failed"), ops.alias("ops"), matched.alias("matched"), F.coalesce(odd, F.lit(False)).alias("odd"))
    return rows, F.col("odd") if may_be_odd else None


def asked_rows(rows: DataFrame) -> DataFrame:
    """(row_key, kind, row_data, matched, source, sequence_number, reason, detail) of what ``asked`` gives."""
    source, place = F.col("aggregate_id").cast("string").alias("source"), F.col("sequence_number").cast("long").alias("sequence_number")
    none = _text(None)
    done = F.transform("ops", lambda o: F.struct(o["row_key"].alias("row_key"), o["kind"].alias("kind"), o["row_data"].alias("row_data"), none.alias("reason"), none.alias("detail")))
    lost = F.array(F.struct(none.alias("row_key"), none.alias("kind"), none.alias("row_data"), F.col("failed.reason").alias("reason"), F.col("failed.detail").alias("detail")))
    every = F.when(F.col("failed").isNull(), done).otherwise(F.concat(done, lost))
    return rows.select("matched", source, place, F.explode(every).alias("o")).select("o.row_key", "o.kind", "o.row_data", F.when(F.col("o.reason").isNull(), F.col("matched")).alias("matched"), "source", "sequence_number", "o.reason", "o.detail")


def table_rows(operations: DataFrame, held: DataFrame | None = None) -> DataFrame:
    """View rows and failures from operations of a view without match field, going on from rows ``held``; all by aggregates that are combined map-side.

    A key's last insert or removal decides whether it has a row; updates after it replace the fields that they carry.
    """
    place = F.col("sequence_number")
    ops = operations.where("row_key is not null").select("row_key", "kind", "row_data", "source", "sequence_number", _text(None).cast("long").alias("stands"))
    if held is not None:
        ops = ops.unionByName(held.select("row_key", F.lit("held").alias("kind"), F.col("row_json").alias("row_data"), F.col("source_aggregate_id").alias("source"), F.lit(-1).cast("long").alias("sequence_number"), F.col("position").alias("stands")))
    last = ops.where("kind <> 'update'").groupBy("row_key").agg(F.max_by(F.struct("kind", "row_data", "source", "sequence_number", "stands"), place).alias("b")).where("b.kind in ('insert', 'held')")
    base = last.select("row_key", F.col("b.row_data").alias("row_data"), F.col("b.source").alias("source"), F.col("b.sequence_number").alias("base"), F.coalesce("b.stands", "b.sequence_number").alias("stands"))
    later = ops.where("kind = 'update'").join(base.select("row_key", "base"), "row_key").where(place > F.col("base"))
    updated = later.groupBy("row_key").agg(F.max(place).alias("updated"), F.max_by("source", place).alias("by"))
    written = later.select("row_key", "sequence_number", F.explode(texts_of(F.from_json("row_data", _MAP))).alias("field", "value")).groupBy("row_key", "field").agg(F.max_by("value", place).alias("value"))
    changes = written.groupBy("row_key").agg(F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("changes"))  # a row's fields
    joined = base.join(updated, "row_key", "left").join(changes, "row_key", "left")
    stands = F.coalesce("updated", "stands")
    key = F.to_json(F.array("row_key"))
    stamps = F.create_map(F.lit("aggregateId"), F.substring(key, F.lit(2), F.length(key) - 2), F.lit("sequence"), stands.cast("string"))
    fields = texts_of(F.from_json("row_data", _MAP))
    row = _merged(F.when(F.col("changes").isNull(), fields).otherwise(_merged(fields, F.col("changes"))), stamps)
    none = _text(None)
    rows = joined.select("row_key", json_of(row).alias("row_json"), F.coalesce("by", "source").alias("source_aggregate_id"), stands.alias("position"), none.cast("long").alias("sequence_number"), none.alias("reason"), none.alias("detail"))
    failures = operations.where("row_key is null").select(none.alias("row_key"), none.alias("row_json"), F.col("source").alias("source_aggregate_id"), none.cast("long").alias("position"), "sequence_number", "reason", "detail")
    return rows.union(failures)

"""Definitions of table views as columns, against the step functions."""

import json
import random

import pytest
from pyspark.sql import functions as F
from test_views import LOG, as_dict, event

from fathomlog.operators import folds
from fathomlog.plans import columns, decision_queries
from fathomlog.plans.promotion import Default, Drop, Promotions, Rename
from fathomlog.plans.specs import AggregateId, Combined, Composite, ConstantFields, EventTimestamp, Interest, ListedKeys, ListLength, PayloadField, SelectedFields, TableView, WholePayload


def payloads(seed, n=250):
    """Everything that JSON has, in places where the definitions look."""
    r = random.Random(seed)
    values = [None, True, False, 0, 7, -3, 123456789012, 1.5, 2.0, 1e30, "", "a", 'q"\\\n', "é|", {}, {"b": 1}, {"b": {"c": "deep"}}, {"b": None, "z z": [1]}, [], [1, 2], [{"k": "x"}, {"k": 4}], [{"k": None}], [{"j": 1}], [{"k": 1.0}], ["x"]]
    kinds = ["added", "changed", "removed", "cleared", "other"]
    out = []
    for i in range(1, n + 1):
        data = {name: r.choice(values) for name in ("k", "a", "list", "v", "old", "new") if r.random() < 0.6}
        if r.random() < 0.7:
            data["k"] = r.choice(["x", "y", "4", 4, True])
        out.append(event(i, f"g{r.randrange(6)}", r.choice(kinds), data, "item", r.choice([(1, 0), (1, 1), (2, 0), (2, 1), (1, 5)])))
    return out


LISTED = ListedKeys(frozenset({"cleared", "removed"}), "list", ("item.k", "aggregateId"))
PROMOTED = Combined((WholePayload(), ConstantFields((("c", {"x": [1, None]}), ("v", "set")))))
DEFINITIONS = {
    "whole": (AggregateId(), WholePayload(), SelectedFields(("v", "missing")), None),
    "parts": (Composite(("data.k", "aggregateId", "eventType")), Combined((PayloadField("a"), SelectedFields(("v", "k")), ListLength("n", "list"), EventTimestamp("at"), ConstantFields((("v", 1),)))), PayloadField("a"), LISTED),
    "deep": (Composite(("a.b.c",)), PROMOTED, ListLength("n", "list"), None),
    "listed": (Composite(("k",)), EventTimestamp("at"), Combined(()), LISTED),
}


def view_of(name, match=None):
    key, data, update, listed = DEFINITIONS[name]
    return TableView("made", Interest(), frozenset({"added"}), frozenset({"removed"}), key, data, updates=frozenset({"changed"}), update_data=update, listed=listed, match_field=match)


def promotions():
    out = Promotions()
    out.register("made", "item", (1, 0), (1, 1), (Default("v", {"d": 0}),))
    out.register("made", "item", (1, 5), (2, 0), (Rename("old", "new"), Drop("a")))
    out.register("made", "item", (2, 0), (2, 1), (Default("w", "x"),))
    return out


def opened(df):
    load = lambda x: None if x is None else json.loads(x)
    return sorted(((r.row_key, r.kind, load(r.row_data), load(r.matched), r.source, r.sequence_number, r.reason, r.detail) for r in df.collect()), key=lambda r: (r[5], str(r)))


@pytest.mark.parametrize("name", sorted(DEFINITIONS))
@pytest.mark.parametrize("match", ["v"])
@pytest.mark.parametrize("promoted", [False, True])
def test_columns_ask_what_steps_ask(spark, name, match, promoted):
    log = spark.createDataFrame(payloads(len(name)), LOG)
    view = view_of(name, match)
    arguments = (promotions(), {"item": (2, 1)}) if promoted else ()
    rows, odd = columns.asked(log, view, *arguments)
    left = {r.sequence_number for r in rows.where(odd).collect()} if odd is not None else set()
    assert len(left) < 100
    every = opened(folds._asked_by_steps(log, view, *arguments))
    own = [x for x in every if x[5] not in left]
    got = opened(columns.asked_rows(rows.where(~odd) if odd is not None else rows))
    assert got == own and {r[6] for r in got} - {None} <= {"row_key_failed", "row_data_failed", "promoter_failed"}
    # And all together, odd ones among them.
    assert opened(folds.asked_operations(log, view, *arguments)) == every


@pytest.mark.parametrize("name", ["whole", "parts", "listed"])
def test_rows_by_aggregates_equal_steps(spark, name):
    events, view = payloads(99, 400), view_of(name)
    steps, sources, rows = folds.Folder(view), {}, {}
    for e in map(as_dict, events):
        for key, kind, data in steps.operations(e)[0]:
            after = folds.table_step(view, rows.get(key), key, kind, data, e)
            if after is not rows.get(key):
                rows[key], sources[key] = after, e["aggregate_id"]
    expected = {k: (v, sources[k], v["sequence"]) for k, v in rows.items() if v is not None}
    log = spark.createDataFrame(events, LOG)
    as_rows = lambda df: {r.row_key: (json.loads(r.row_json), r.source_aggregate_id, r.position) for r in df.where("reason is null").collect()}
    assert as_rows(folds.fold(log, view)) == expected and len(expected) > 3
    # Going on from rows held.
    held = folds.fold(log.where("sequence_number <= 170"), view).where("row_json is not null")
    assert as_rows(folds.fold(log.where("sequence_number > 170"), view, held=held)) == expected


@pytest.mark.parametrize("name", ["view_row_data", "view_listed_keys", "view_promoted_table"])
def test_plans_have_no_python(spark, sf_dir, name):
    plan = getattr(decision_queries, name)(spark, sf_dir)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


@pytest.mark.parametrize("name", ["view_row_data", "view_listed_keys", "view_promoted_table"])
def test_payloads_are_opened_once(spark, sf_dir, name):
    """Rows and failures read what was asked as written, not the log again."""
    assert "Window" not in getattr(decision_queries, name)(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()


def test_other_definitions_go_through_steps(spark):
    log = spark.createDataFrame([event(1, "a", "added", {"k": 1})], LOG)
    view = TableView("own", Interest(), frozenset({"added"}), frozenset(), lambda e: "key", WholePayload())
    with pytest.raises(columns.NoColumns):
        columns.asked(log, view)
    assert [r.row_key for r in folds.fold(log, view).collect()] == ["key"]
    assert columns.table_rows(folds.asked_operations(log.where(F.lit(False)), view_of("whole"))).count() == 0


GUARDS = {
    "selected": (SelectedFields(("v", "a", "list")), True),
    "whole": (Combined((WholePayload(), ConstantFields((("c", 1),)))), True),
    "changing": (Combined((SelectedFields(("a",)), ConstantFields((("v", 7),)))), False),
}


@pytest.mark.parametrize("name", sorted(GUARDS))
@pytest.mark.parametrize("block", [3, 100_000])
def test_guarded_rows_by_blocks_equal_steps(spark, monkeypatch, name, block):
    """Few keys and match values, equal ones written differently among them, over blocks that split every key."""
    monkeypatch.setattr(folds, "BLOCK", block)
    update, keeps = GUARDS[name]
    assert folds.keeps_match(update, "v") == keeps
    view = TableView("guarded", Interest(), frozenset({"added"}), frozenset({"removed"}), AggregateId(), WholePayload(), updates=frozenset({"changed"}), update_data=update, match_field="v", listed=ListedKeys(frozenset({"cleared"}), "list", ("item.k",)))
    r = random.Random(block)
    events = []
    for i in range(1, 301):
        kind = r.choices(["added", "changed", "removed", "cleared"], [2, 6, 1, 0.3])[0]
        data = {"a": r.choice([1, "x", None]), "v": r.choice([1, 1.0, True, 7, "s", None, {"z": 1}, {"z": 1.0}]), "list": [{"k": "g1"}]}
        if r.random() < 0.2:
            del data["v"]
        events.append(event(i, f"g{r.choice([0, 0, 0, 1, 2])}", kind, data, "item"))
    steps, sources, rows = folds.Folder(view), {}, {}
    for e in map(as_dict, events):
        for key, kind, data in steps.operations(e)[0]:
            after = folds.table_step(view, rows.get(key), key, kind, data, e)
            if after is not rows.get(key):
                rows[key], sources[key] = after, e["aggregate_id"]
    expected = {k: (v, sources[k], v["sequence"]) for k, v in rows.items() if v is not None}
    log = spark.createDataFrame(events, LOG).repartition(3)
    as_rows = lambda df: {r.row_key: (json.loads(r.row_json), r.source_aggregate_id, r.position) for r in df.where("reason is null").collect()}
    assert as_rows(folds.fold(log, view)) == expected and expected
    held = folds.fold(log.where("sequence_number <= 130"), view).where("row_json is not null")
    assert as_rows(folds.fold(log.where("sequence_number > 130"), view, held=held)) == expected

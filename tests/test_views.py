"""View definitions: steps, promotion, and the forms of a fold against each other."""

import json
import random
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from fathomlog.operators import folds
from fathomlog.plans.promotion import Default, Drop, Promotions, Rename
from fathomlog.plans.specs import (
    AggregateId, AggregateView, Combined, Composite, Constant, ConstantFields, Derived, EventTimestamp, FirstEventTimestamp, FoldFailure, Interest, ListedKeys,
    ListLength, PayloadField, SelectedFields, TableView, WholePayload, view_fingerprint,
)
from fathomlog.sources.store import Conflict, LogStore

START = datetime(2024, 1, 1, tzinfo=UTC)
LOG = "sequence_number long, event_id string, aggregate_id string, aggregate_type string, entry_type string, entry_type_version struct<major:int,minor:int>, event_type string, data string, client_timestamp timestamp"


def event(n, aggregate, kind, data, entry="note", version=(1, 0)):
    return (n, f"e{n}", aggregate, "t", entry, version, kind, json.dumps(data), START + timedelta(seconds=n))


def as_dict(e):
    return folds.event_dict(dict(zip([c.split()[0] for c in LOG.replace("struct<major:int,minor:int>", "x").split(", ")], e, strict=True)))


def random_log(seed, n=700):
    """Edits and deletes of notes with nested payloads, additions and removals of items."""
    r = random.Random(seed)
    out = []
    for i in range(1, n + 1):
        p = r.random()
        if p < 0.5:
            data = {}
            if r.random() < 0.7:
                data["title"] = f"t{r.randrange(9)}"
            if r.random() < 0.6:
                data["meta"] = r.choice([{"x": r.randrange(5)}, {"y": True}, {}, {"z": {"w": r.randrange(3)}}, {"z": None}, 7])
            if r.random() < 0.3:
                data["extra"] = r.choice([None, "s", {"a": 1}])
            out.append(event(i, f"n{r.randrange(30)}", "edited", data))
        elif p < 0.58:
            out.append(event(i, f"n{r.randrange(30)}", "deleted", {}))
        elif p < 0.88:
            out.append(event(i, f"i{r.randrange(20)}", "added", {"k": f"k{r.randrange(25)}", "v": r.randrange(100)}, "item"))
        else:
            out.append(event(i, f"i{r.randrange(20)}", "removed", {"k": f"k{r.randrange(35)}", "v": r.randrange(100)}, "item"))
    return out


NOTES = AggregateView("notes", Interest(entry_types=frozenset({"note"})), frozenset({"deleted"}), (Derived("shown", "title", Constant("none")), Derived("since", "missing.path", FirstEventTimestamp())))
ITEMS = TableView("items", Interest(entry_types=frozenset({"item"})), frozenset({"added"}), frozenset({"removed"}), Composite(("data.k",)), WholePayload())


def plain_aggregate(view, log):
    rows = {}
    for e in map(as_dict, log):
        if e["entry_type"] == "note":
            rows[e["aggregate_id"]] = folds.aggregate_step(view, rows.get(e["aggregate_id"]), e)
    return {k: v for k, v in rows.items() if v is not None}


def plain_table(view, log):
    rows = {}
    for e in map(as_dict, log):
        if e["entry_type"] == "item":
            for key, kind, data in folds.keyed_operations(view, e):
                rows[key] = folds.table_step(view, rows.get(key), key, kind, data, e)
    return {k: v for k, v in rows.items() if v is not None}


@pytest.mark.parametrize("seed", [1, 20260930])
def test_folds_equal_replay(spark, seed):
    log = random_log(seed)
    df = spark.createDataFrame(log, LOG)
    got = {r.row_key: json.loads(r.row_json) for r in folds.fold(df, NOTES).collect()}
    assert got == plain_aggregate(NOTES, log)
    got = {r.row_key: json.loads(r.row_json) for r in folds.fold(df, ITEMS).collect()}
    assert got == plain_table(ITEMS, log)


def test_path_writes_equal_replay(spark):
    log = [e for e in random_log(5) if e[4] == "note"]
    plain = AggregateView("notes", Interest(), frozenset({"deleted"}))
    expected = set()

    def leaves(row, path=()):
        for k, v in row.items():
            if isinstance(v, dict) and v:
                yield from leaves(v, (*path, k))
            else:
                yield (*path, k), json.dumps(v, separators=(",", ":"))

    stamps = {"aggregateId", "entryType", "aggregateType", "latestEventId", "updatedAt", "firstEventTimestamp", "sequence"}
    for key, row in plain_aggregate(plain, log).items():
        expected |= {(key, *x) for x in leaves({k: v for k, v in row.items() if k not in stamps})}
    got = folds.path_writes(spark.createDataFrame(log, LOG), F.col("event_type") == "deleted").collect()
    # An object that gained fields is shown by its fields alone.
    filled = {(r.aggregate_id, tuple(r.path[:n])) for r in got for n in range(1, len(r.path))}
    assert {(r.aggregate_id, tuple(r.path), r.value) for r in got if not (r.value == "{}" and (r.aggregate_id, tuple(r.path)) in filled)} == expected


def test_streaming_equals_batch(spark, tmp_path):
    from fathomlog.streaming.folds import current_rows, fold_stream, run_available, snapshot_frames, update_frames

    log = random_log(3, 300)
    for i in range(3):  # three files, one micro-batch each
        spark.createDataFrame(log[i * 100 : i * 100 + 100], LOG).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))
    changes = run_available(fold_stream(stream, NOTES), str(tmp_path / "out"))
    got = {r.row_key: json.loads(r.row_json) for r in current_rows(changes).collect()}
    assert got == plain_aggregate(NOTES, log)
    frames = [json.loads(r.frame) for r in update_frames(changes, "notes").collect()]
    assert {f["type"] for f in frames} <= {"delta", "tombstone"}
    ends = [json.loads(r.frame) for r in snapshot_frames(current_rows(changes), 300, "notes").collect()]
    assert ends[-1] == {"type": "end_of_replay", "view": "notes", "position": 300} and len(ends) == len(got) + 1


def test_table_features():
    view = TableView(
        "t", Interest(), frozenset({"add"}), frozenset({"remove"}), Composite(("data.k", "aggregateId")), Combined((SelectedFields(("v", "m")), ConstantFields((("c", 1),)), ListLength("n", "l"), EventTimestamp("at"))),
        updates=frozenset({"change"}), update_data=SelectedFields(("v",)), match_field="m", listed=ListedKeys(frozenset({"clear"}), "l", ("item.k", "aggregateId")),
    )
    run = lambda row, e: [folds.table_step(view, row, key, kind, data, e) for key, kind, data in folds.keyed_operations(view, e)]
    added = as_dict(event(1, "a", "add", {"k": 1, "v": None, "m": 5, "l": [1, 2], "other": 0}))
    (row,) = run(None, added)
    assert row == {"v": None, "m": 5, "c": 1, "n": 2, "at": "2024-01-01T00:00:01.000Z", "aggregateId": "1|a", "sequence": 1}
    assert run(row, as_dict(event(2, "a", "change", {"k": 1, "v": 3, "m": 6}))) == [row]
    assert run(row, as_dict(event(2, "a", "change", {"k": 1, "v": 3, "m": 5})))[0]["v"] == 3
    assert run(None, as_dict(event(2, "a", "change", {"k": 1, "v": 3, "m": 5}))) == [None]
    assert run(row, as_dict(event(3, "a", "remove", {"k": 1}))) == [row]
    assert run(row, as_dict(event(3, "a", "remove", {"k": 1, "m": 5}))) == [None]
    assert run(row, as_dict(event(3, "a", "clear", {"l": [{"k": 1}, {"k": 2}]}))) == [None, None]
    assert run(row, as_dict(event(3, "a", "clear", {}))) == []
    assert run(row, as_dict(event(3, "a", "other", {}))) == []
    for bad in ({"v": 1}, {"k": None}):  # the key is extracted before a row is looked for
        with pytest.raises(FoldFailure, match="row_key"):
            run(None, as_dict(event(4, "a", "change", bad)))
    with pytest.raises(FoldFailure, match="row_data"):
        run(None, as_dict(event(5, "a", "add", {"k": 1, "l": 3})))
    with pytest.raises(FoldFailure):
        PayloadField("p")({"data": {"p": None}})
    assert PayloadField("p")({"data": {}}) == {} and AggregateId()({"aggregate_id": "z"}) == "z"


def test_failures_skip_the_event_for_the_view(spark):
    log = [event(1, "i1", "added", {"k": "a", "v": 1}, "item"), event(2, "i1", "added", {"v": 1}, "item"), event(3, "i1", "added", {"k": "b", "v": 1}, "item")]
    got = folds.fold(spark.createDataFrame(log, LOG), ITEMS).collect()
    assert sorted(r.row_key for r in got if r.row_json) == ["a", "b"]
    assert [(r.sequence_number, r.reason, r.source_aggregate_id) for r in got if r.reason] == [(2, "row_key_failed", "i1")]


def steps():
    out = Promotions()
    out.register("v", "note", (1, 0), (1, 1), (Default("b", 0),))
    out.register("v", "note", (1, 2), (2, 0), (Rename("b", "c"), Drop("old")))
    out.register("v", "note", (2, 0), (2, 1), (Default("d", "x"),))
    return out


def test_promotion():
    p = steps()
    assert p.promote("v", "note", (1, 0), (2, 1), {"old": 1}) == {"c": 0, "d": "x"}
    assert p.promote("v", "note", (1, 1), (2, 1), {"b": 5}) == {"c": 5, "d": "x"}  # 1.2 has no step of its own
    assert p.promote("v", "note", (1, 0), (2, 1), {}, {"c": 9}) == {"d": "x"}  # the row has it under its final name
    assert p.promote("v", "note", (2, 1), (2, 5), {}) == {}
    with pytest.raises(FoldFailure, match="promoter"):
        p.promote("v", "note", (2, 1), (3, 0), {})
    with pytest.raises(FoldFailure, match="there already"):
        p.promote("v", "note", (1, 2), (2, 0), {"b": 1, "c": 2})
    with pytest.raises(ValueError, match="in use"):
        p.register("v", "note", (3, 0), (4, 0), ())
    fresh = Promotions()
    for bad in [((1, 0), (1, 1), (Drop("x"),)), ((1, 0), (1, 2), ()), ((1, 0), (2, 1), ()), ((1, 0), (3, 0), ())]:
        with pytest.raises(ValueError):
            fresh.register("v", "n", *bad)
    fresh.register("v", "n", (1, 0), (2, 0), ())
    with pytest.raises(ValueError, match="its step"):
        fresh.register("v", "n", (1, 1), (2, 0), ())


def test_promotion_in_a_fold(spark):
    log = [event(1, "a", "edited", {"b": 5, "old": 1}, version=(1, 1)), event(2, "a", "edited", {"t": 1}, version=(1, 0)), event(3, "z", "edited", {}, version=(2, 1))]
    df = spark.createDataFrame(log, LOG)
    rows = {r.row_key: json.loads(r.row_json) for r in folds.fold(df, AggregateView("v", Interest()), steps(), {"note": (2, 1)}).collect()}
    assert rows["a"]["c"] == 5 and rows["a"]["t"] == 1 and rows["a"]["d"] == "x" and "old" not in rows["a"]
    folds.check_versions(df, {"note": (2, 1)})
    with pytest.raises(ValueError, match="later major"):
        folds.check_versions(df, {"note": (1, 9)})


def test_fingerprints():
    base = view_fingerprint(ITEMS, {"item": (1, 0)}, [])
    same = TableView(**{**ITEMS.__dict__, "interest": Interest(entry_types=frozenset({"item"}), predicate=lambda d: F.lit(True))})
    assert view_fingerprint(same, {"item": (1, 0)}, []) == base  # a predicate doesn't count
    assert view_fingerprint(ITEMS, {"item": (1, 1)}, []) != base
    assert view_fingerprint(TableView(**{**ITEMS.__dict__, "match_field": "m"}), {"item": (1, 0)}, []) != base


def test_store_catches_up_like_a_replay(spark, tmp_path):
    log = random_log(11, 400)
    store = LogStore(spark, str(tmp_path / "store"))
    names = [c.split()[0] for c in LOG.replace("struct<major:int,minor:int>", "x").split(", ")]
    drop = lambda rows: spark.createDataFrame(rows, LOG).drop("sequence_number")
    store.append(drop(log[:250]))
    store.catch_up(NOTES)
    assert store.progress("notes") == {"position": 250, "head": 250, "current": True}
    pinned = store.manifest()
    store.append(drop(log[250:]))
    assert not store.progress("notes")["current"]
    store.catch_up(NOTES)
    store.catch_up(ITEMS)
    rows, position = store.view("notes")
    assert position == 400 and {r.row_key: json.loads(r.row_json) for r in rows.where("row_json is not null").collect()} == plain_aggregate(NOTES, log)
    assert {r.row_key: json.loads(r.row_json) for r in store.view("items")[0].collect()} == plain_table(ITEMS, log)
    # A reader that pinned the earlier version still sees it.
    assert {r.row_key: json.loads(r.row_json) for r in store.view("notes", pinned)[0].collect()} == plain_aggregate(NOTES, log[:250])
    assert [r.sequence_number for r in store.log().orderBy("sequence_number").collect()] == list(range(1, 401)) and set(store.log().columns) == set(names)
    with pytest.raises(Conflict):
        store.commit(pinned)
    store.rebuild(NOTES)
    store.delete_marked()
    assert {r.row_key for r in store.view("notes")[0].collect()} == set(plain_aggregate(NOTES, log))

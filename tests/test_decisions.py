"""System views, envelopes, finding evidence, and the decisions about deliveries, holds and sessions."""

import json
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from fathomlog.operators import access, delivery, envelopes, findings, folds
from fathomlog.plans import system_views
from fathomlog.sources import event_log as el

T = datetime(2024, 1, 1, tzinfo=UTC)


def row_after(view, events):
    rows = {}
    for n, (kind, data) in enumerate(events, 1):
        event = {"sequence_number": n, "event_id": f"e{n}", "aggregate_id": "d", "event_type": kind, "data": data, "client_timestamp": T, "entry_type": "system.x"}
        for key, op, values in folds.keyed_operations(view, event):
            rows[key] = folds.table_step(view, rows.get(key), key, op, values, event)
    return {k: v for k, v in rows.items() if v}


def test_holds_view():
    view = system_views.holds(frozenset({"system.destination"}), "destination_audit")
    held = {"database_id": "db", "id": "d", "key": "k", "hold_id": "h1", "event_ids": ["a", "b"], "other": 1}
    rows = row_after(view, [("destination_held", held)])
    assert rows["db|d|k"] == {"id": "d", "database_id": "db", "key": "k", "hold_id": "h1", "event_count": 2, "held_at": "2024-01-01T00:00:00.000Z", "state": "held", "aggregateId": "db|d|k", "sequence": 1}
    other, own = {**held, "hold_id": "h2"}, {**held}
    assert row_after(view, [("destination_held", held), ("destination_hold_released", other)])["db|d|k"]["state"] == "held"
    assert row_after(view, [("destination_held", held), ("destination_hold_released", own)])["db|d|k"]["state"] == "releasing"
    assert row_after(view, [("destination_held", held), ("destination_hold_cleared", other)]) != {}
    assert row_after(view, [("destination_held", held), ("destination_hold_cleared", own)]) == {}
    gone = {"database_id": "db", "id": "d", "key_lists": [{"key": "k"}]}
    assert row_after(view, [("destination_held", held), ("destination_deleted", gone)]) == {}


def test_wedges_and_grants_views(spark):
    view = system_views.wedges(frozenset({"system.destination"}), "destination_audit")
    wedge = {"database_id": "db", "id": "d", "cause": "permanent", "unknown": 1}
    assert row_after(view, [("destination_wedged", wedge)])["db|d"]["cause"] == "permanent"
    assert row_after(view, [("destination_wedged", wedge), ("destination_wedge_recovered", wedge)]) == {}
    assert row_after(system_views.GRANTS, [("permission_granted", {"role": "r"})]) and not row_after(system_views.GRANTS, [("permission_granted", {}), ("permission_revoked", {})])
    hop = "struct<database_id:string>"
    log = spark.createDataFrame([("system.destination", "destination_wedged", "destination_audit", [("a",)]), ("system.destination", "destination_wedged", "destination_audit", [("a",), ("a",)]), ("note", "destination_wedged", "destination_audit", [("a",)])], f"entry_type string, event_type string, aggregate_type string, provenance array<{hop}>")
    assert [r[0] for r in log.select(view.interest.condition(log)).collect()] == [True, False, False]


def test_schema_matches_the_log(spark):
    assert set(folds.EVENT) <= set(spark.createDataFrame([], el.SCHEMA).columns)


def envelope(**changes):
    out = {k: "x" for k in envelopes.KEYS} | {"batch_format_version": envelopes.VERSION, "attributes": {}, "delivery_number": 3, "previous_delivery_hash": None, "events": [{"a": 1.5}, {"b": None}],
                                              "channel": {"sender_database_id": "s", "destination_id": "d", "registration_id": "r", "generation": 2}}
    out |= changes
    return json.dumps({k: v for k, v in out.items() if v != "drop"})


def test_envelopes(spark):
    cases = [(envelope(), None), (envelope(extra=1), "keys"), (envelope(sent_at="drop"), "keys"), (envelope(batch_format_version="esd/batch@2"), "format_unsupported"), (envelope(attributes=[]), "attributes_not_object"),
             (envelope(events={}), "events_not_array"), (envelope(events=[]), "no_events"), (envelope(delivery_number=0), "delivery_number"), ("[1]", "not_an_object"), ("junk", "not_an_object"), (None, "not_an_object")]
    out = envelopes.decode(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, envelope string")).orderBy("i").collect()
    assert [r.refusal for r in out] == [w for _, w in cases]
    assert out[0].channel.generation == 2 and out[0].delivery_number == 3 and [json.loads(e) for e in out[0].events] == [{"a": 1.5}, {"b": None}] and out[1].events is None


def test_evidence(spark):
    rows = [("hash_mismatch", {"event_id": 1, "carried_hash": "a", "recomputed_hash": "b"}, True), ("hash_mismatch", {"event_id": 1}, False), ("nothing", {}, False), ("sequence_missing", {"local_sequence_number": 4}, True),
            ("fold_failed", {"view": "v", "definition_fingerprint": "f", "event_id": "e", "sealed_hash": "s", "reason": "row_key_failed"}, True), ("fold_failed", {"view": "v", "definition_fingerprint": "f", "event_id": "e", "sealed_hash": "s", "reason": "odd"}, False)]
    df = spark.createDataFrame([(i, k, json.dumps(e)) for i, (k, e, _) in enumerate(rows)], "i int, kind string, evidence string")
    assert [r[0] for r in df.orderBy("i").select(findings.valid_evidence()).collect()] == [ok for *_, ok in rows]
    log = spark.createDataFrame([(1, "note", "{}", "e1", "s1"), (2, "system.security_finding", '{"kind":"fold_failed"}', "e2", "s2")], "sequence_number long, entry_type string, data string, event_id string, sealed_hash string")
    failures = spark.createDataFrame([(1, "row_key_failed"), (2, "row_key_failed"), (None, None)], "sequence_number long, reason string")
    made = findings.fold_findings(failures, log, "v", "f")
    assert made.select(findings.valid_evidence()).collect()[0][0] and made.count() == 1


def test_answers(spark):
    schema = "recorded_receiver string, responding string, own_number long, own_hash string, number long, hash string, fence_number long, fence_hash string, attempted boolean, resendable boolean, marked_sent boolean"
    rows = [(("a", "b", 1, "h", 1, "h", None, None, False, False, False), "unexplained"), (("a", "a", 1, "h", 2, "g", 2, "g", True, False, False), "acknowledged"), ((None, "a", 1, "h", 2, "g", 3, "g", True, False, False), "adopted"),
            (("a", "a", 1, "h", 1, "h", None, None, False, False, False), "in_step"), (("a", "a", 3, "h", 1, "g", None, None, False, True, False), "receiver_behind"), (("a", "a", 3, "h", 1, "g", None, None, False, False, False), "unexplained"),
            (("a", "a", 1, "h", 4, "g", None, None, False, False, False), "sender_regressed"), (("a", "a", 1, "h", 4, "g", None, None, False, False, True), "unexplained"), (("a", "a", 0, None, 0, None, None, None, False, False, False), "in_step")]
    got = delivery.read_answers(spark.createDataFrame([r for r, _ in rows], schema).coalesce(1)).collect()
    assert [r.reading for r in got] == [w for _, w in rows]


def test_schedules_and_holds(spark):
    day = lambda d: datetime(2024, 1, d)
    assert delivery.start_change(None, day(3)) == ("first", (day(3), None)) and delivery.start_change(day(3), day(3)) == ("unchanged", None)
    assert delivery.start_change(day(3), day(1)) == ("gap", (day(1), day(3))) and delivery.start_change(day(3), day(1), pending_upper=day(5)) == ("gap", (day(1), day(5)))
    for bad in (dict(when=day(4)), dict(when=day(1), wedged=True)):
        with pytest.raises(ValueError):
            delivery.start_change(day(3), **bad)
    assert delivery.end_change(day(1), day(2)) == "closed" and delivery.end_change(day(3), day(2)) == "scheduled"
    assert [delivery.release_hold(*x) for x in ((None, None, "h"), ("held", "g", "h"), ("releasing", "h", "h"), ("held", "h", "h"))] == ["stale", "stale", "releasing_already", "releasing"]
    held = spark.createDataFrame([("k", "releasing"), ("j", "held")], "key string, state string")
    lists = spark.createDataFrame([("k", 5, "e5"), ("k", 3, "e3"), ("j", 1, "e1")], "key string, sequence_number long, event_id string")
    assert [tuple(r) for r in delivery.due_for_release(held, lists, 4).collect()] == [("k", 3, "e3")]
    assert delivery.due_for_release(held, lists, 2).count() == 0 and delivery.due_for_release(held, lists, 4, replay_pending=True).count() == 0
    queued, listed = delivery.route_held(spark.createDataFrame([("k", 3, "e3"), ("k", 9, "e9"), ("z", 4, "e4")], "key string, sequence_number long, event_id string"), lists, held)
    assert [r.event_id for r in queued.collect()] == ["e4"] and listed.count() == 4


def test_deliveries_of_a_stream(spark, tmp_path):
    spark.range(1, 121).selectExpr("id as sequence_number", "concat('e', id) as event_id").coalesce(1).write.parquet(str(tmp_path / "log"))
    sent = []
    stream = spark.readStream.schema("sequence_number long, event_id string").parquet(str(tmp_path / "log"))
    delivery.deliver(stream, lambda events, epoch: sent.extend(r.batch for r in events.collect()), str(tmp_path / "c"), size=50).awaitTermination()
    assert sorted(sent) == [0] * 50 + [1] * 50 + [2] * 20


def test_status(spark):
    items = spark.createDataFrame([("d", 1, "sent"), ("d", 2, None), ("d", 3, None)], "destination_id string, sequence_in_queue int, final_status string")
    schedules = spark.createDataFrame([("d", "2024"), ("x", None)], "destination_id string, start string")
    beats = spark.createDataFrame([("d", "now")], "destination_id string, heard string")
    got = {r.destination_id: (r.pending, r.head, r.heard) for r in delivery.delivery_status(schedules, items, beats).collect()}
    assert got == {"d": (2, 2, "now"), "x": (0, None, None)}


def test_seeds_assignments_and_watching(spark):
    assert access.assignment_id("u", "r", {"value": "v", "class": "c"}) == '{"role":"r","scope":{"class":"c","value":"v"},"user_id":"u"}'
    assert access.check_seed({"roles": ["a"], "grants": {"a": ["p"]}}, {"p"}) == []
    assert len(access.check_seed({"roles": ["a", "a"], "grants": {"a": ["q"], "b": ["p"]}}, {"p"})) == 3
    changes = spark.createDataFrame([("role_assigned", "u", "r"), ("permission_revoked", None, "s")], "event_type string, user_id string, role string")
    sessions = spark.createDataFrame([(1, "u", "r"), (2, "v", "s"), (3, "v", "r")], "session_id int, user_id string, role string")
    assert {tuple(r) for r in access.watch(changes, sessions).collect()} == {(1, "stale"), (2, "close")}
    index = access.empty_index(spark)
    classes = access.ScopeClasses(access.ScopeClass("a"), access.ScopeClass("b", "a", "i"))
    values = spark.createDataFrame([("x",)], "value string")
    assert access.resolve_up(values, classes, {"i": index}, "b").count() == 1 and access.expand_down(values, classes, {"i": index}, "b", "a").count() == 0
    assert access.resolve_up(values, classes, {"i": spark.createDataFrame([("x", "")], "key string, parent string")}, "b").select(F.max("class")).first()[0] == "b"


def test_watching_meets_each_session_once_per_key(spark):
    """Changes of one role are summed up before they are joined, and one that can't be told apart closes."""
    changes = spark.range(400).select(F.lit("role_assigned").alias("event_type"), F.col("id").alias("user_id"), F.lit("r").alias("role")).union(spark.sql("SELECT null, 7L, 'r'"))
    sessions = spark.range(400).select(F.col("id").alias("session_id"), F.col("id").alias("user_id"), F.lit("r").alias("role"))
    watched = access.watch(changes, sessions)
    assert " OR " not in watched._jdf.queryExecution().optimizedPlan().toString()
    got = dict(watched.collect())
    assert len(got) == 400 and {k for k, v in got.items() if v == "close"} == {7}

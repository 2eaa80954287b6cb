"""Chain checks on planted anomalies, delivery state, access, ingest and retention."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from fathomlog.functions.coordinates import is_held_as_authored, is_locally_originated, not_received_from_own_identity, with_coordinates
from fathomlog.operators import access, chain, commands, delivery, findings, ingest, retention, view_reads
from fathomlog.plans import decision_queries, queries
from fathomlog.sources import event_log as el

CHAIN = (
    "sequence_number long, event_id string, aggregate_id string, event_hash string, previous_event_hash string, ingest_sequence_number long, previous_ingest_hash string, "
    "origin_db string, sealed_hash string, origin_position long, held_as_authored_by string, causal struct<kind:string,eligible:boolean,parents:array<struct<event_id:string,event_hash:string>>>"
)


def clean_chain(n=12):
    out, latest = [], {}
    for i in range(1, n + 1):
        agg = f"a{i % 3}"
        parents = [latest[agg]] if agg in latest else []
        before = f"h{i - 1}" if i > 1 else None
        out.append(dict(sequence_number=i, event_id=f"e{i}", aggregate_id=agg, event_hash=f"h{i}", previous_event_hash=before, ingest_sequence_number=i, previous_ingest_hash=before,
                        origin_db="me", sealed_hash=f"h{i}", origin_position=i, held_as_authored_by="me", causal=("version", True, parents)))
        latest[agg] = (f"e{i}", f"h{i}")
    return out


def verify(spark, rows, **bounds):
    df = spark.createDataFrame([tuple(r.values()) for r in rows], CHAIN)
    return [(r.kind, r.sequence_number) for r in chain.verify_chains(df, holder="me", expected_hash=F.concat(F.lit("h"), "sequence_number"), **bounds).collect()]


def test_clean_chain_has_no_findings(spark):
    assert verify(spark, clean_chain()) == []


def test_each_anomaly_is_found(spark):
    def changed(i, **values):
        rows = clean_chain()
        rows[i - 1].update(values)
        return rows

    assert ("hash_mismatch", 5) in verify(spark, changed(5, event_hash="x"))
    gone = [r for r in clean_chain() if r["sequence_number"] not in (5, 6)]
    kinds = verify(spark, gone)
    assert ("sequence_missing", 5) in kinds and ("sequence_missing", 6) in kinds and not [k for k in kinds if k[0] == "storage_link_break"]
    assert ("predecessor_break", 7) in kinds  # what it follows isn't held though the holder wrote it
    assert verify(spark, changed(5, previous_ingest_hash="x")) == [("storage_link_break", 5)]
    assert verify(spark, changed(5, ingest_sequence_number=4)) == [("storage_link_break", 5)]
    assert verify(spark, changed(1, previous_ingest_hash="x")) == [("storage_link_break", 1)]
    assert ("predecessor_break", 6) in verify(spark, changed(5, origin_db="other", held_as_authored_by=None))
    assert verify(spark, changed(5, previous_event_hash="h7")) == [("predecessor_break", 5), ("fork_unrecorded", 8)]
    assert ("position_reused", 6) in verify(spark, changed(6, origin_position=5))
    assert verify(spark, changed(6, causal=("version", True, []))) == [("parents_not_stamped", 6)]
    assert ("parent_invalid", 6) in verify(spark, changed(6, causal=("version", True, [("e3", "no")])))
    assert ("parent_invalid", 6) in verify(spark, changed(6, causal=("version", True, [("e1", "h1")])))
    assert verify(spark, changed(5, previous_ingest_hash="x"), start=6) == []
    for bad in (dict(start=-1), dict(start=3, stop=2)):
        with pytest.raises(ValueError):
            verify(spark, clean_chain(), **bad)


def test_dangling_predecessor_counts_only_for_the_holder(spark):
    rows = clean_chain()
    rows[4].update(previous_event_hash="far", held_as_authored_by=None)
    df = spark.createDataFrame([tuple(r.values()) for r in rows], CHAIN)
    assert chain.predecessor_break(df, "me").count() == 0
    assert chain.unresolved_predecessors(df, "me").first()[0] == 1


def test_coordinates(spark):
    hop = "struct<database_id:string,identifier:string,arrival_hash:string,origin_sequence_number:long>"
    df = spark.createDataFrame([(1, "h", [("a", "x", None, None)]), (2, "g", [("a", "x", None, None), ("b", "y", "s", 7)]), (3, "f", [("a", "x", None, None), ("a", "x", "t", 8)])], f"sequence_number long, event_hash string, provenance array<{hop}>")
    out = with_coordinates(df).orderBy("sequence_number").select("origin_db", "sealed_hash", "origin_position", "held_as_authored_by").collect()
    assert [tuple(r) for r in out] == [("a", "h", 1, "a"), ("a", "s", 7, None), ("a", "t", 8, None)]
    flags = df.orderBy("sequence_number").select(not_received_from_own_identity(), is_locally_originated("x"), is_held_as_authored("a")).collect()
    assert [tuple(r) for r in flags] == [(True, True, True), (True, True, False), (False, True, False)]


def test_marks_and_lineage(spark):
    authors = spark.createDataFrame([("a1", "p", 5), ("a2", "p", 9), ("a2", "q", 3)], "aggregate_id string, origin_db string, max_position long")
    found = spark.createDataFrame([("f1", "fork_unrecorded", "p", None, 6), ("f2", "hash_mismatch", "q", "a2", None), ("f3", "hash_mismatch", "r", "a1", None)], "finding_id string, kind string, origin_db string, aggregate_id string, threshold long")
    line = findings.lineage(spark.createDataFrame([("r", "p", 1), ("q", "r", 2), ("p", "q", 3)], "origin_db string, predecessor string, sequence_number long"))
    assert line.count() == 9  # a cycle: everyone descends from everyone
    alone = {r.aggregate_id: r.finding_ids for r in findings.marks(found, authors).collect()}
    assert alone == {"a2": ["f1", "f2"]}
    assert {r.aggregate_id: r.finding_ids for r in findings.marks(found, authors, line).collect()}["a1"] == ["f3"]
    marked = findings.with_marks(authors.select("aggregate_id").distinct(), findings.marks(found, authors))
    assert {r.aggregate_id: r.finding_ids for r in marked.collect()} == {"a1": [], "a2": ["f1", "f2"]}
    first = findings.finding_id("d", "walk", "hash_mismatch", {"b": 1, "a": 2})
    assert first == findings.finding_id("d", "walk", "hash_mismatch", {"a": 2, "b": 1})
    ids = spark.createDataFrame([(first,), (first,), ("x",)], "finding_id string")
    assert findings.new_findings(ids, ids.where("finding_id = 'x'")).count() == 1
    with pytest.raises(ValueError):
        findings.finding_id("d", "nobody", "k", {})


def test_positions_continue_and_leave_no_gap(spark):
    r = random.Random(1)
    rows = [(i, datetime(2024, 1, 1) + timedelta(seconds=r.randrange(90000))) for i in range(500)]
    out = el.with_positions(spark.createDataFrame(rows, "event_id long, ts timestamp"), "ts", "event_id", base=10).orderBy("sequence_number").collect()
    assert [x.sequence_number for x in out] == list(range(11, 511))
    assert [x.event_id for x in out] == [i for i, _ in sorted(rows, key=lambda x: (x[1], x[0]))]
    assert el.with_positions(spark.createDataFrame([], "event_id long, ts timestamp"), "ts", "event_id").count() == 0


def test_empty_type_sets_admit_nothing(spark, sf_dir):
    log = el.events_log(spark, sf_dir)
    assert el.candidates(log, after=0, through=99, event_types=[]).count() == 0
    assert el.candidates(log, after=0, through=99).count() == 99


def test_delivery_states(spark):
    assert delivery.may_become(None, "sent") and delivery.may_become("wedged", "tombstoned")
    assert not delivery.may_become(None, "tombstoned", 0) and not delivery.may_become("sent", "wedged")
    rows = [("d", i, s, i * 10, 1, i, "k" if i % 2 else "j", [(i * 10, f"e{i}")]) for i, s in enumerate(["sent", "wedged", None, None, None], 1)]
    items = spark.createDataFrame(rows, "destination_id string, sequence_in_queue int, final_status string, first_sequence long, delivery_generation int, delivery_number int, block_key string, events array<struct<sequence_number:long,event_id:string>>")
    left, counts = delivery.sweep(items, "d", 3, "k")
    assert left.count() == 4 and tuple(counts.first()) == (1, 50)
    left, cursor = delivery.tombstone_and_refill(items, "d")
    assert cursor == 19 and {r.sequence_in_queue: r.final_status for r in left.collect()} == {1: "sent", 2: "tombstoned"}
    with pytest.raises(ValueError):
        delivery.tombstone_and_refill(items.where("sequence_in_queue <> 2"), "d")
    assert delivery.retained_delivery(items, 1, 1).first().sequence_in_queue == 1 and delivery.retained_delivery(items, 1, 2).count() == 0
    left, held = delivery.hold_key(items, "d", "j", spark.createDataFrame([(1, "e0"), (20, "e2")], "sequence_number long, event_id string"))
    assert {r.event_id for r in held.collect()} == {"e0", "e2", "e4"} and {r.sequence_in_queue: r.final_status for r in left.collect()} == {1: "sent", 2: "tombstoned", 3: None, 5: None}
    assert {r.event_id for r in delivery.channel_wide_sent(items, 1).collect()} == {f"e{i}" for i in range(1, 6)}
    now = F.lit(datetime(2024, 1, 2)).cast("timestamp")
    day = lambda d: F.lit(datetime(2024, 1, d)).cast("timestamp")
    none = F.lit(None).cast("timestamp")
    assert list(spark.range(1).select(delivery.is_active(day(2), none, now), delivery.is_active(day(1), day(2), now), delivery.is_active(none, none, now)).first()) == [True, False, False]


def test_scope_classes():
    for bad in ([access.ScopeClass("a", "b", "i")], [access.ScopeClass("a"), access.ScopeClass("a")], [access.ScopeClass("a", "b", "i"), access.ScopeClass("b", "a", "i")], [access.ScopeClass("a"), access.ScopeClass("b", "a")]):
        with pytest.raises(ValueError):
            access.ScopeClasses(*bad)
    classes = access.ScopeClasses(access.ScopeClass("a"), access.ScopeClass("b", "a", "i"))
    assert classes.ancestors("b") == ["a"] and classes.relation("a", "b") == "ancestor" and classes.relation("b", "a") == "none" and classes.relation("a", "a") == "exact"


def test_decisions(spark):
    requests = spark.createDataFrame([(1, "u", "r", "read", None, None), (2, "u", "r", "edit", None, None), (3, None, "r", "read", None, None), (4, "u", "r", "read", "b", "b1"), (5, "u", "r", "read", "b", "b2"), (6, "w", "r", "read", "b", "b2"), (7, "x", "r", "read", None, None)],
                                     "request_id int, user_id string, role string, permission string, scope_class string, scope_value string")
    held = spark.createDataFrame([("u", "r", "a", "a1", False, False), ("w", "r", None, None, False, True)], "user_id string, role string, scope_class string, scope_value string, any_value boolean, any_class boolean")
    grants = spark.createDataFrame([("r", "read")], "role string, permission string")
    contains = spark.createDataFrame([("b", "b1", "b", "b1"), ("b", "b1", "a", "a1"), ("b", "b2", "b", "b2"), ("b", "b2", "a", "a2")], "class string, value string, ancestor_class string, ancestor string")
    got = {r.request_id: r.allowed for r in access.decide(requests, held, grants, contains).collect()}
    assert got == {1: True, 2: False, 3: False, 4: True, 5: False, 6: True, 7: False}
    assert not any(r.allowed for r in access.deny_all(requests).collect())


def test_ingest_ranges_and_order(spark):
    accepted = spark.createDataFrame([("c", 1), ("c", 2), ("c", 4)], "channel string, delivery_number long")
    rows, missing = ingest.deliveries_between(accepted, "c", 1, 5)
    assert missing == 3 and [r.delivery_number for r in rows.collect()] == [1, 2]
    events = spark.createDataFrame([("e1", "h1", 1, 1, 2, "p", 5), ("e1", "h1", 1, 1, 1, "p", 5), ("e2", "h2", 1, 1, 3, "q", 1)], "event_id string, sealed_hash string, registration int, generation int, delivery_number int, origin_db string, origin_position long")
    rank = spark.createDataFrame([("q", 0), ("p", 1)], "origin_db string, rank int")
    assert [(r.event_id, r.delivery_number) for r in ingest.restore_order(events, rank).collect()] == [("e2", 3), ("e1", 1)]
    assert ingest.delivery_hash({"a": 1}, 1, None, ["h"]) != ingest.delivery_hash({"a": 1}, 2, None, ["h"])
    data = spark.createDataFrame([('{"$x":1}', [("d",)]), ('{"x":1}', []), ('{"x":1}', [("d",)])], "data string, provenance array<struct<database_id:string>>")
    assert [r[0] for r in data.select(ingest.unstorable()).collect()] == [True, True, False]
    assert [r[0] for r in data.where("size(provenance) > 0").select(ingest.foreign(F.lit("d"))).collect()] == [False, False]


def test_audit_page_bounds(spark):
    log = spark.createDataFrame([(i, ("user", "u", None, None, None) if i % 2 else ("anonymous", None, None, None, "9.9.9.9"), "t") for i in range(6)], "event_id long, initiator struct<type:string,user_id:string,service:string,triggering_event_id:string,ip_address:string>, flow_token string")
    context = spark.createDataFrame([(i, datetime(2024, 1, 1 + i // 2), "10.0.0.1") for i in range(6)], "event_id long, recorded_at timestamp, ip_address string")
    page = retention.audit_page(log, context, limit=2)
    assert [r.event_id for r in page.collect()] == [5, 4, 3]
    assert [r.event_id for r in retention.audit_page(log, context, limit=2, cursor=(datetime(2024, 1, 3), 4)).collect()] == [3, 2, 1]
    assert [r.event_id for r in retention.audit_page(log, context, initiator={"type": "user", "user_id": "u"}, start=datetime(2024, 1, 1), end=datetime(2024, 1, 2)).collect()] == [3, 1]
    assert retention.redact(context, log.limit(2)).count() == 4
    for limit in (0, 1001):
        with pytest.raises(ValueError):
            retention.audit_page(log, context, limit=limit)


def test_commands(spark):
    rows = [(1, "note", "u", None, "a", 1), (2, "note", "u", "k", "", 2), (3, "note", "u", "k", "", 3), (4, "none", "u", "k", "x", 4), (5, "keyed", "u", None, "x", 5), (6, "note", "v", None, "b", 6), (7, "keyed", "u", "q", "x", 7), (8, "keyed", "u", "q", "y", 8)]
    asked = spark.createDataFrame(rows, "request_id int, action string, principal string, key string, input string, arrival int")
    held = spark.createDataFrame([], "action string, principal string, key string, held_hash string, expires_at timestamp")
    allowed = asked.select("request_id", (F.col("principal") == "u").alias("allowed"))
    draft = lambda d: {"aggregate_id": F.col("principal"), "entry_type": F.lit("note"), "event_type": F.lit("made"), "data": F.col("input")}
    actions = [commands.Action("note", "write", lambda d: F.length("input") > 0, draft), commands.Action("keyed", "write", lambda d: F.lit(True), draft, True)]
    results, events = commands.dispatch(asked, actions, held, allowed, datetime(2024, 1, 1))
    assert {r.request_id: r.outcome for r in results.collect()} == {1: "done", 2: "validation_error", 3: "replay", 4: "unknown_action", 5: "missing_key", 6: "not_authorized", 7: "done", 8: "idempotency_mismatch"}
    assert {r.request_id for r in events.collect()} == {1, 7}
    assert {r.event_type for r in commands.denials(results).collect()} == {f"denied_{k}" for k in ("validation_error", "unknown_action", "missing_key", "not_authorized", "idempotency_mismatch")}


def test_view_rows_by_typed_and_text_fields(spark):
    rows = spark.createDataFrame([("a", '{"n":1,"s":"1","z":null}'), ("b", '{"n":"1","s":"x"}')], "row_key string, row_json string")
    keys = lambda d: [r.row_key for r in d.orderBy("row_key").collect()]
    assert keys(view_reads.match_fields(rows, {"n": 1})) == ["a"]
    assert keys(view_reads.match_fields(rows, {"n": "1"})) == ["b"]
    assert keys(view_reads.match_fields(rows, {"n": 1}, as_text=True)) == ["a", "b"]
    assert keys(view_reads.match_fields(rows, {"z": None})) == ["a"]
    assert keys(view_reads.match_fields(rows, {"z": None}, as_text=True)) == []


def test_restore_tells_occurrences_of_one_line_apart(spark):
    """Of an id and hash at one place of a delivery the first in the table counts, however rows are dealt; between hashes the lower one does."""
    schema = "event_id int, event_hash string, registration int, generation int, delivery_number int, storable boolean, at int, origin_db int"
    rows = [(1, "x", 1, 1, 1, True, n, n) for n in (3, 1, 2)] + [(2, "b", 1, 1, 1, True, 1, 1), (2, "a", 1, 1, 1, True, 2, 2)]
    for order in (rows, rows[::-1]):
        chosen = ingest.restore_choice(spark.createDataFrame(order, schema).repartition(3), ("at",))
        assert {(r.event_id, r.event_hash): (r.origin_db, r.place) for r in chosen.collect()} == {(1, "x"): (1, "stored"), (2, "a"): (2, "stored"), (2, "b"): (1, "other_hash")}


def test_faults_over_blocks(spark, monkeypatch):
    """Neighbours across the blocks' ends, gaps, no channel; deliveries dealt by their channels are dealt again for the breaks alone."""
    monkeypatch.setattr(ingest, "BLOCK", 3)
    r = random.Random(3)
    rows = [(c, n, f"h{n}", None if n == 1 else f"h{n - 1}" if r.random() < 0.95 else "bad", f"h{n}" if r.random() < 0.95 else "other") for c in [None, *range(40)] for n in range(1, 14) if r.random() < 0.95]
    numbers, expected, broken = {(c, n) for c, n, *_ in rows if c is not None}, {}, {}
    for c, n, own, before, computed in rows:
        fault = "hash_mismatch" if own != computed else "missing_before" if n > 1 and (c, n - 1) not in numbers else "link_break" if before != (f"h{n - 1}" if n > 1 else None) else None
        broken.setdefault(c, n) if fault else None
        expected[c, n] = fault, c not in broken
    deliveries = spark.createDataFrame(rows, "channel long, delivery_number long, delivery_hash string, previous_hash string, computed_hash string")
    found = ingest.delivery_faults(deliveries.repartition(4, "channel"))
    assert {(x.channel, x.delivery_number): (x.fault, x.served) for x in found.collect()} == expected
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.split("== Initial Plan ==")[-1].count("hashpartitioning(") <= 4


def test_ranges_are_numbered_without_gap(spark):
    """In the order of several columns, nulls where it puts them, over several ranges; nothing for nothing."""
    r = random.Random(4)
    rows = [(r.choice([None, 1, 2]), k if k % 50 else None) for k in r.sample(range(2000), 2000)]
    order = (F.asc_nulls_first("a"), F.asc_nulls_last("b"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ranged = el.numbered(spark.createDataFrame(rows, "a int, b int").repartition(3), *order, name="n")
        assert len(ranged.inputFiles()) > 1
        out = ranged.orderBy("n").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [x.n for x in out] == list(range(1, 2001))
    assert [(x.a, x.b) for x in out] == sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is None, x[1] or 0))
    assert el.numbered(spark.createDataFrame([], "a int, b int"), *order).collect() == []


def _shuffled(spark):
    """Records that tasks have shuffled so far, over all stages."""
    store, jvm = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._jvm
    none = jvm.java.util.ArrayList()
    stages = store.stageList(none, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), none)
    return sum(stages.apply(n).shuffleWriteRecords() for n in range(stages.size()))


def test_restore_deals_lines_out_twice(spark, sf_dir):
    """By their orders and, those that are served, by their events; what the query works out isn't worked out again for the order of storing."""
    size = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet").count()
    lines, orders, before = size("lineitem"), size("orders"), _shuffled(spark)
    # As with tables that are too large to be broadcast.
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        decision_queries.restore_verified(spark, sf_dir).write.format("noop").mode("overwrite").save()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert lines < _shuffled(spark) - before < 2 * lines + 6 * orders


@pytest.mark.parametrize("name", ["restore_verified", "restore_deliveries"])
def test_restore_of_rows_without_keys(spark, tmp_path, name):
    """Orders without customer and lines without part or order, lines that are repeated, several files: as in the SQL."""
    import duckdb

    r = random.Random(5)
    some = lambda key: key if r.random() > 0.03 else None
    orders = [(k, some(r.choice([1, 2, r.randrange(60)])), datetime(2024, 1, 1) + timedelta(days=r.randrange(400))) for k in range(600)]
    lines = [(some(r.randrange(600)), some(r.choice([7, r.randrange(-20, 150)])), r.randrange(100), r.randrange(1, 4)) for _ in range(4000)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderdate timestamp").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    for part in (lines[:2500], lines[2500:]):
        spark.createDataFrame(part, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int").coalesce(1).write.mode("append").parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'; SET threads = 1")
    for t in ("orders", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    ours = queries.queries()[name](spark, str(tmp_path))
    columns = sorted(ours.columns)
    theirs = con.execute(f"SELECT {', '.join(columns)} FROM ({queries.oracle_sql()[name]})").fetchall()
    assert sorted(map(repr, map(tuple, ours.select(*columns).collect()))) == sorted(map(repr, theirs))


def test_restore_takes_served_deliveries_in_order(spark):
    """What comes after a break isn't taken; what is stored comes first, by lineage and origin position; without id each stays."""
    deliveries = spark.createDataFrame([(1, 1, "h1", None, "h1"), (1, 2, "h2", "h1", "h2"), (1, 3, "h3", "bad", "h3"), (1, 4, "h4", "h3", "h4")], "channel int, delivery_number int, delivery_hash string, previous_hash string, computed_hash string")
    events = [("a", "x", 2, True, 0, 5), ("a", "x", 1, True, 1, 5), ("a", "y", 1, True, 0, 5), ("b", "x", 1, False, 0, 1), ("c", "x", 2, True, 0, 9), ("d", "x", 4, True, 0, 1), ("e", "x", 1, True, 7, 1), (None, "x", 1, True, 0, 3), (None, "x", 1, True, 0, 3)]
    occurrences = spark.createDataFrame([(1, n, i, h, 1, 1, ok, db, at) for i, h, n, ok, db, at in events], "channel int, delivery_number int, event_id string, event_hash string, registration int, generation int, storable boolean, origin_db int, origin_position int")
    ranks = spark.createDataFrame([(0, 2), (1, 1)], "origin_db int, rank int")
    out = [(x.event_id, x.event_hash, x.delivery_number, x.rank, x.place, x.finding) for x in ingest.restore(deliveries, occurrences, ranks, F.lit(False)).collect()]
    assert out == [
        ("a", "x", 1, 1, "stored", None), ("c", "x", 2, 2, "stored", None), ("e", "x", 1, None, "kept_in_finding", "foreign"), ("b", "x", 1, 2, "kept_in_finding", "event_unstorable"),
        (None, "x", 1, 2, "unkeyed", None), (None, "x", 1, 2, "unkeyed", None), ("a", "y", 1, 2, "other_hash", "identity_mismatch"),
    ]


def test_channels_of_one_block_are_walked_once(spark):
    """No steps and entries are worked out for them in the plan of the outcomes; a null channel is one too."""
    rows = [(c, n, n, f"{n}", f"{n - 1}" if n > 1 else None, f"{n}") for c in ("a", None) for n in (1, 2, 3)]
    out = ingest.accept_deliveries(spark.createDataFrame(rows, "channel string, arrival long, delivery_number long, delivery_hash string, previous_hash string, computed_hash string"))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert [r.outcome for r in out.collect()] == ["accepted"] * 6


def test_predecessors_are_joined_once(spark):
    """Wrong and missing predecessors come out of one join; of several held events with one hash a finding comes once, events that lack theirs stay each."""
    schema = "sequence_number long, event_id string, sealed_hash string, previous_event_hash string, origin_db string, origin_position long, held_as_authored_by string"
    rows = [(1, "a", "h1", None, "d", 1, "d"), (2, "b", "h1", None, "d", 2, "d"), (3, "c", "h3", "h1", "e", 3, "d"), (4, "x", "h4", "gone", "d", 4, "d"), (4, "x", "h4", "gone", "d", 4, "d"), (5, "y", "h5", "gone", "d", 5, "o"), (6, "z", "h6", "h3", "e", 3, "d")]
    found = chain.predecessor_break(spark.createDataFrame(rows, schema), "d")
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
    assert sorted((r.event_id, r.detail) for r in found.collect()) == [("c", "other_origin"), ("x", "dangling"), ("x", "dangling"), ("z", "not_earlier")]


def test_links_over_blocks(spark, monkeypatch):
    """Neighbours across the blocks' ends, gaps, positions held twice; a log dealt by its chains isn't dealt again."""
    monkeypatch.setattr(chain, "BLOCK", 3)
    rows = []
    for db in (None, "a", "b"):
        for p in [1, 2, 3, 4, 5, 6, 6, 7, 8, 11, 12, 13]:
            place = p + (p == 5)
            rows.append((db, p, f"{db}-{len(rows)}", f"h{db}{p}{len(rows) % 2}", place, None if p == 1 else f"h{db}{p - 1}{p % 2}"))
    rows += [("c", 1, "c-1", "x", 1, "y"), ("c", None, "c-0", "x", None, "y")]
    log = spark.createDataFrame(rows, "db string, sequence_number long, event_id string, event_hash string, ingest_sequence_number long, previous_ingest_hash string")
    expected = []
    for db, p, event, _, place, before in rows:
        held = [r[3] for r in rows if r[0] == db and p is not None and r[1] == p - 1]
        for h in held or [None]:
            if place != p:
                expected.append((event, "ingest_sequence_number"))
            elif before is not None if p == 1 else held and before != h:
                expected.append((event, "previous_ingest_hash"))
    dealt = chain.storage_link_break(log.repartition(4, "db"), chain=["db"])
    assert sorted((r.event_id, r.detail) for r in dealt.collect()) == sorted(expected)
    plan = dealt._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(") <= 2 and "Join" not in plan


def test_chains_read_the_log_once(spark, tmp_path):
    """Every check reads what was written first, not the log's own sources."""
    rows = [(n, str(n), "a", f"h{n}", f"h{n}", "db", n, f"h{n - 1}" if n > 1 else None, "db", n, f"h{n - 1}" if n > 1 else None) for n in range(1, 6)]
    log = spark.createDataFrame(
        rows, "sequence_number long, event_id string, aggregate_id string, event_hash string, sealed_hash string, origin_db string, origin_position long, previous_event_hash string, held_as_authored_by string, "
        "ingest_sequence_number long, previous_ingest_hash string",
    )
    log.write.parquet(f"{tmp_path}/own-source")
    causal = "named_struct('kind', 'version', 'eligible', false, 'parents', cast(array() as array<struct<event_id:string,event_hash:string>>)) as causal"
    log = spark.read.parquet(f"{tmp_path}/own-source").selectExpr("*", causal, "if(sequence_number = 4, 'bad', event_hash) as expected")
    found = chain.verify_chains(log, holder="db", expected_hash=F.col("expected"))
    assert [(r.kind, r.sequence_number) for r in found.collect()] == [("hash_mismatch", 4)]
    assert not any("own-source" in f for f in found.inputFiles())


def deals(df):
    """The ways in which a plan deals rows out by keys."""
    return [x for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in x]


def test_lines_are_dealt_once_and_in_bounded_parts(spark, sf_dir, monkeypatch):
    lines = queries._t(spark, sf_dir, "lineitem").count()
    monkeypatch.setattr(queries, "PART_LINES", 100)
    log = queries._lines(spark, sf_dir)
    assert log.rdd.getNumPartitions() == -(-lines // 100) and log.count() == lines
    assert len(deals(chain.positions_reused(log))) == 1


def test_structure_moves_lines_by_hash_alone(spark, sf_dir):
    found = decision_queries.chain_structure(spark, sf_dir)
    keys = {x.split("hashpartitioning(")[1].split("#")[0] for x in deals(found)}
    assert keys == {"origin_db", "__key", "predecessor_break"}  # the last: findings, each once
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("seed", range(3))
def test_structure_findings_against_pairs(spark, seed):
    """Every new event with every stored one, with nulls, repeated ids and hashes of any form."""
    r = random.Random(seed)
    pick = lambda values, none: None if r.random() < none else r.choice(values)
    hashes = ["", "ab", "abab", "ABAB", "abc", "ab\n", "\u00e9", "deadbeef" * 8, "cafe" * 16]
    rows = [(s, pick([f"e{k}" for k in range(25)], 0.05), pick(["x", "y"], 0.2), pick(range(1, 6), 0.1), pick(hashes, 0.2), pick(hashes, 0.1), s % 3 == 0) for s in range(150 if seed else 60)]
    schema = "sequence_number long, event_id string, origin_db string, origin_position int, previous_event_hash string, sealed_hash string, fresh boolean"
    log = spark.createDataFrame(rows, schema).repartition(3)
    differ = lambda a, b: a is not None and b is not None and a != b
    broken, due = set(), []
    for s, i, db, pos, prev, _, fresh in rows:
        if not fresh:
            continue
        stored = [x for x in rows if not x[6]]
        for x in stored:
            if prev is not None and prev == x[5]:
                if x[2] != db:
                    broken.add(("predecessor_break", s, i, "other_origin"))
                elif pos is not None and x[3] is not None and x[3] >= pos:
                    broken.add(("predecessor_break", s, i, "not_earlier"))
        if any(x[2] == db and pos is not None and x[3] == pos and differ(x[1], i) for x in stored):
            due.append(("position_reused", s, i, str(pos)))
        if any(x[2] == db and x[4] == prev and differ(x[3], pos) and differ(x[1], i) for x in stored):
            due.append(("fork_unrecorded", s, i, prev))
    due = sorted(map(str, [*broken, *due]))
    for found in (chain.structure_findings(log.where("fresh"), log.where("not fresh")), chain.structure_findings_marked(log, F.col("fresh"))):
        assert sorted(str(tuple(x)) for x in found.collect()) == due

"""Views that go on from held rows, streams of table views, payloads of any depth, and positions in blocks."""

import json
import random

import pytest
from pyspark.sql import functions as F
from test_views import ITEMS, LOG, NOTES, event, plain_aggregate, plain_table, random_log

from fathomlog.functions import canonical_json as cj
from fathomlog.operators import chain, commands, delivery, findings, folds, frontier, ingest
from fathomlog.plans.specs import AggregateView, Interest, TableView
from fathomlog.sources.store import LogStore

GUARDED = TableView(**{**ITEMS.__dict__, "updates": frozenset({"removed"}), "removes": frozenset(), "update_data": ITEMS.row_data, "match_field": "v"})


def rows_of(df):
    return {r.row_key: json.loads(r.row_json) for r in df.where("row_json is not null").collect()}


@pytest.mark.parametrize("view", [NOTES, ITEMS, GUARDED], ids=["aggregate", "table", "guarded"])
def test_catching_up_equals_a_replay(spark, tmp_path, view):
    log = random_log(17, 300) + [event(301, "i1", "added", {"v": 1}, "item")]
    plain = plain_aggregate if isinstance(view, AggregateView) else plain_table
    store = LogStore(spark, str(tmp_path / "store"))
    for first, last in ((0, 120), (120, 121), (121, 301)):
        store.append(spark.createDataFrame(log[first:last], LOG).drop("sequence_number"))
        store.catch_up(view)
    rows, position = store.view(view.name)
    # An item without key can't be folded.
    good = log[:300]
    assert position == 301 and rows_of(rows) == plain(view, good)
    assert [(r.sequence_number, r.reason) for r in rows.where("reason is not null").collect()] == ([(301, "row_key_failed")] if isinstance(view, TableView) else [])
    assert rows_of(folds.fold(spark.createDataFrame(good, LOG), view)) == plain(view, good)


def test_catching_up_reads_new_events_only(spark, tmp_path):
    store = LogStore(spark, str(tmp_path / "store"))
    store.append(spark.createDataFrame(random_log(3, 200), LOG).drop("sequence_number"))
    plan = store.log().where("sequence_number > 150")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(sequence_number), GreaterThan(sequence_number,150)]" in plan and "Window" not in plan


def test_a_stream_of_a_table_view_keeps_failures(spark, tmp_path):
    from fathomlog.streaming.folds import current_rows, fold_stream, run_available

    log = [e for e in random_log(5, 240) if e[4] == "item"] + [event(241, "i1", "added", {"v": 1}, "item")]
    half = len(log) // 2
    for part in (log[:half], log[half:]):
        spark.createDataFrame(part, LOG).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))
    changes = run_available(fold_stream(stream, ITEMS), str(tmp_path / "out"))
    assert {r.row_key: json.loads(r.row_json) for r in current_rows(changes).collect()} == plain_table(ITEMS, log[:-1])
    failed = changes.where("kind = 'failure'").collect()
    assert [(r.position, json.loads(r.row_json)["reason"]) for r in failed] == [(241, "row_key_failed")]


def test_path_writes_of_many_and_of_deep_payloads(spark):
    """Over a million writes of paths, and an object forty levels deep."""
    log = spark.range(300_000).select(
        (F.col("id") + 1).alias("sequence_number"), (F.col("id") % 50).cast("string").alias("aggregate_id"), F.lit("edited").alias("event_type"), F.format_string('{"a":{"k":%d,"j":2},"b":3}', "id").alias("data")
    )
    got = {(r.aggregate_id, tuple(r.path)): (r.value, r.sequence) for r in folds.path_writes(log, F.lit(False)).collect()}
    assert len(got) == 150 and got["7", ("a", "k")] == ("299957", 299_958)
    deep = "1"
    for n in reversed(range(40)):
        deep = f'{{"k{n}":{deep}}}'
    row = spark.createDataFrame([(1, "x", "edited", deep)], "sequence_number long, aggregate_id string, event_type string, data string")
    (only,) = folds.path_writes(row, F.lit(False)).collect()
    assert list(only.path) == [f"k{n}" for n in range(40)] and only.value == "1"


@pytest.mark.parametrize("keys", [[], ["c"]])
def test_missing_positions_over_blocks(spark, monkeypatch, keys):
    monkeypatch.setattr(chain, "BLOCK", 7)
    r = random.Random(2)
    held = {(c, p) for c in "ab" for p in range(3, 90) if r.random() < 0.5 or (c == "a" and p < 30)}
    if not keys:
        held = {("a", p) for c, p in held if c == "a"}
    expected = {(c, p) for c in {c for c, _ in held} for p in range(min(p for d, p in held if d == c), max(p for d, p in held if d == c)) if (c, p) not in held}
    df = spark.createDataFrame(sorted(held), "c string, sequence_number long")
    got = chain.sequence_missing(df, chain=keys or None).collect()
    assert {(x.c if keys else "a", x.missing) for x in got} == expected


def test_content_changes_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(commands, "BLOCK", 5)
    r = random.Random(6)
    rows = [(n, r.choice(["a", "b", None]), "t", r.choice("xy")) for n in range(200)]
    before, expected = {}, []
    for n, a, t, v in rows:
        if before.get((a, t)) != v:
            expected.append(n)
        before[a, t] = v
    df = spark.createDataFrame(rows, "sequence_number long, aggregate_id string, entry_type string, v string")
    out = commands.content_changes(df, F.col("v"))
    assert out.columns == df.columns and sorted(x.sequence_number for x in out.collect()) == expected


def test_marks_by_position(spark):
    r = random.Random(3)
    authors = [(f"a{i}", f"d{r.randrange(4)}", r.randrange(50)) for i in range(40)]
    found = [(f"f{i}", "position_reused", f"d{r.randrange(4)}", None, r.randrange(50)) for i in range(30)]
    marked = findings.marks(spark.createDataFrame(found, "finding_id string, kind string, origin_db string, aggregate_id string, threshold int"), spark.createDataFrame(authors, "aggregate_id string, origin_db string, max_position int"))
    expected = {a: sorted(f for f, _, o, _, t in found if o == d and t <= m) for a, d, m in authors}
    assert {x.aggregate_id: x.finding_ids for x in marked.collect()} == {a: f for a, f in expected.items() if f}


def test_marks_that_arrivals_add(spark):
    """Findings, events and successions that come later add what marking everything anew would."""
    r = random.Random(9)
    kinds = ["position_reused", "fork_unrecorded", "hash_mismatch"]
    found = [(f"f{i}", r.choice(kinds), f"d{r.randrange(4)}", f"a{r.randrange(12)}", r.choice([0, 1, 5, 2**40, r.randrange(60)])) for i in range(40)]
    before = [(f"a{i}", f"d{d}", r.randrange(40)) for i in range(12) for d in range(4) if r.random() < 0.4]
    later = [(a, d, p + r.randrange(30)) for a, d, p in before if r.random() < 0.5] + [("a99", "d1", 2**41)]
    now = list(({(a, d): (a, d, p) for a, d, p in before} | {(a, d): (a, d, p) for a, d, p in later}).values())
    own = [(f"d{d}", f"d{d}") for d in range(4)]
    more = [("d1", "d2"), ("d1", "d3")]
    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    F_, A, M = "finding_id string, kind string, origin_db string, aggregate_id string, threshold long", "aggregate_id string, origin_db string, max_position long", "origin_db string, member string"
    held = findings.mark_rows(df(found[:25], F_), df(before, A), df(own, M))
    added = findings.added_marks(held, findings=df(found[:25], F_), new_findings=df(found[25:], F_), authors=df(now, A), new_authors=df(later, A), members=df(own + more, M), new_members=df(more, M))
    got = [tuple(x) for x in held.union(added).collect()]
    expected = set()
    for f, kind, origin, named, threshold in found:
        for a, d, p in now:
            if (d == origin and threshold <= p) if kind in findings.THRESHOLD_KINDS else (a == named and (origin, d) in own + more):
                expected.add((a, f))
    assert sorted(got) == sorted(expected) and len(got) > 30


@pytest.mark.parametrize("block", [7, 100_000])
def test_channels_by_blocks_equal_a_plain_walk(spark, monkeypatch, block):
    """Repeats, forks, gaps, bad hashes and beginnings anew, over blocks that are entered in every state."""
    monkeypatch.setattr(ingest, "BLOCK", block)
    r = random.Random(4)
    rows, expected, state = [], {}, {}
    for n in range(400):
        channel = r.choice(["a", "a", "a", "b", None])
        number, digest = state.get(channel, (0, None))
        kind = r.random()
        if kind < 0.55:
            own, before, stated = number + 1, digest, f"{channel}{number + 1}{r.choice('xy')}"
        elif kind < 0.75:
            own, stated = max(1, number - r.randrange(3)), f"{channel}{max(1, number)}x"
            before = r.choice([digest, None])
        else:
            own, before, stated = r.choice([1, number + 1, number + 2]), r.choice([None, "zz", f"{channel}{number}x"]), f"{channel}{number}{r.choice('xy')}"
        computed = "bad" if r.random() < 0.1 else stated
        rows.append((channel, n, own, stated, before, computed))
        if computed != stated:
            expected[n] = "hash_mismatch"
        elif own == number and stated == digest:
            expected[n] = "represented"
        elif own == number + 1 and before == digest:
            state[channel] = own, stated
            expected[n] = "accepted"
        else:
            expected[n] = "out_of_sequence"
    df = spark.createDataFrame(rows, "channel string, arrival long, delivery_number long, delivery_hash string, previous_hash string, computed_hash string").repartition(3)
    got = ingest.accept_deliveries(df).collect()
    assert {x.arrival: x.outcome for x in got} == expected and len(got) == 400 and set(expected.values()) == {"accepted", "represented", "hash_mismatch", "out_of_sequence"}


def test_a_hot_channel_is_walked_in_order(spark):
    rows, number = [], 0
    for n in range(3000):
        if n % 7 == 3:
            rows.append(("hot", n, number, f"h{number}", f"h{number - 1}" if number > 1 else None, f"h{number}"))
        elif n % 11 == 5:
            rows.append(("hot", n, number + 1, f"h{number + 1}", f"h{number}" if number else None, "other"))
        else:
            number += 1
            rows.append(("hot", n, number, f"h{number}", f"h{number - 1}" if number > 1 else None, f"h{number}"))
    rows.append((None, 1, 1, "x", None, "x"))
    df = spark.createDataFrame(rows, "channel string, arrival long, delivery_number long, delivery_hash string, previous_hash string, computed_hash string").repartition(5)
    got = {(x.channel, x.arrival): x.outcome for x in ingest.accept_deliveries(df).collect()}
    assert got[None, 1] == "accepted"
    for n in range(3000):
        # Before anything is accepted, number 0 links to nothing.
        assert got["hot", n] == ("represented" if n % 7 == 3 else "hash_mismatch" if n % 11 == 5 else "accepted")


def test_hashes_in_columns_equal_those_of_records(spark):
    rows = [("e1", "a1", '{"b":1.50,"a":"é"}', None, 4), ("e2", "a2", "{}", '{"provenance":[{"x":null}]}', 5)]
    df = spark.createDataFrame(rows, "event_id string, aggregate_id string, data string, metadata string, sequence_number long")
    got = [r[0] for r in df.orderBy("event_id").select(cj.event_hashes(df.columns)).collect()]
    records = [{"event_id": e, "aggregate_id": a, "data": json.loads(d), "metadata": m and json.loads(m), "sequence_number": s} for e, a, d, m, s in rows]
    assert got == [cj.event_hash(r) for r in records]


def test_verification_goes_on_where_it_stopped(spark):
    none = "cast(array() as array<struct<event_id:string,event_hash:string>>)"
    log = spark.range(1, 101).selectExpr(
        "id as sequence_number", "concat('e', id) as event_id", "'a' as aggregate_id", "concat('h', id) as event_hash", "concat('h', id) as sealed_hash", "'db' as origin_db", "id as origin_position", "'db' as held_as_authored_by",
        "id as ingest_sequence_number", "if(id = 1, null, if(id = 77, 'bad', concat('h', id - 1))) as previous_ingest_hash", "if(id = 1, null, concat('h', id - 1)) as previous_event_hash",
        f"named_struct('kind', 'annotation', 'eligible', false, 'parents', {none}) as causal",
    )
    through, found, _ = frontier.verify_through(log, holder="db", step=40)
    assert through == 40 and [(x.kind, x.sequence_number) for x in found.collect()] == [("storage_link_break", 77)]
    through, found, at = frontier.verify_through(log.where("sequence_number <= 70"), holder="db", through=40)
    assert (through, found) == (70, None) and frontier.verify_through(log, holder="db", frontier=at)[0] == 70


def test_destinations_are_deleted_with_their_queues(spark):
    items = spark.createDataFrame(
        [("a", 1, "sent"), ("a", 2, "wedged"), ("a", 3, None), ("b", 1, None), ("c", 1, "sent")], "destination_id string, sequence_in_queue long, final_status string"
    )
    schedules = spark.createDataFrame([("a", True), ("b", True), ("c", False)], "destination_id string, hard_delete boolean")
    left, said = delivery.delete_destinations(schedules, items, schedules.select("destination_id").union(spark.sql("SELECT 'z'")))
    assert sorted(tuple(r) for r in left.collect() if r.destination_id == "a") == [("a", 1, "sent"), ("a", 2, "tombstoned")] and left.count() == 4
    assert {r.destination_id: (r.refusal, r.tombstoned, r.deleted) for r in said.collect()} == {"a": (None, 2, 1), "b": ("head_pending", None, 0), "c": ("no_opt_in", None, 0), "z": ("unknown", None, 0)}


def test_registrations_keep_dates(spark):
    schedules = spark.createDataFrame([("a", None, None, False, None)], "destination_id string, start timestamp, end timestamp, hard_delete boolean, key_scheme string")
    asked = spark.createDataFrame([(1, "a", True, "k", 1), (2, "a", False, "k", 2), (3, "n", True, None, 3), (4, "x|y", True, None, 4)], "request_id int, destination_id string, hard_delete boolean, key_scheme string, arrival int")
    after, said = delivery.register_destinations(schedules, asked, spark.createDataFrame([], "destination_id string"))
    assert {r.request_id: r.outcome for r in said.collect()} == {1: "known", 2: "known", 3: "registered", 4: "id_refused"}
    assert sorted((r.destination_id, r.hard_delete, r.key_scheme) for r in after.collect()) == [("a", False, "k"), ("n", True, None)]


def test_empty_views_and_logs(spark):
    empty = spark.createDataFrame([], LOG)
    assert folds.fold(empty, AggregateView("n", Interest())).count() == folds.fold(empty, ITEMS).count() == 0
    assert folds.path_writes(empty, F.lit(False)).count() == 0 and chain.sequence_missing(empty).count() == 0

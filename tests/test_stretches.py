"""Views kept by deltas, logs verified in stretches, greedy batches, and holes of any length, each against a plain walk."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F
from test_upkeep import rows_of
from test_views import ITEMS, LOG, NOTES, event, plain_aggregate, plain_table, random_log

from fathomlog.operators import chain, delivery, folds, frontier
from fathomlog.plans.specs import AggregateView
from fathomlog.sources import store as stores
from fathomlog.sources.store import LogStore


def size_of(path, folders):
    return sum(os.path.getsize(os.path.join(d, f)) for folder in folders for d, _, names in os.walk(f"{path}/{folder}") for f in names if f.endswith(".parquet"))


@pytest.mark.parametrize("view", [NOTES, ITEMS], ids=["aggregate", "table"])
@pytest.mark.parametrize("compact", [3, 1000])
def test_deltas_equal_a_replay(spark, tmp_path, monkeypatch, view, compact):
    """Many small catch-ups, with rows that go and come back, buckets that are compacted or not, and a bucket that runs empty."""
    monkeypatch.setattr(stores, "COMPACT_ROWS", compact)
    log = random_log(23, 200)
    plain = plain_aggregate if isinstance(view, AggregateView) else plain_table
    store = LogStore(spark, str(tmp_path / "store"))
    for first, last in ((0, 90), (90, 91), (91, 130), (130, 135), (135, 200)):
        store.append(spark.createDataFrame(log[first:last], LOG).drop("sequence_number"))
        store.catch_up(view, buckets=4)
        assert rows_of(store.view(view.name)[0]) == plain(view, log[:last])
    copy = stores.Copy(**store.manifest().views[view.name]["copy"])
    assert copy.buckets == 4 and (any(b["through"] for b in copy.bases.values()) if compact == 3 else copy.deltas)
    # Readers of earlier versions see what was there.
    pinned = store.manifest(store.manifest().version - 1)
    assert rows_of(store.view(view.name, pinned)[0]) == plain(view, log[:135])
    store.delete_marked()
    assert rows_of(store.view(view.name)[0]) == plain(view, log)


def test_a_catch_up_writes_what_it_touches(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = spark.range(60_000).select(
        F.concat(F.lit("e"), "id").alias("event_id"), F.concat(F.lit("a"), F.col("id") % 20_000).alias("aggregate_id"), F.lit("t").alias("aggregate_type"), F.lit("note").alias("entry_type"),
        F.lit(None).cast("struct<major:int,minor:int>").alias("entry_type_version"), F.lit("edited").alias("event_type"), F.format_string('{"i":%d,"text":"%s"}', "id", F.sha2(F.col("id").cast("string"), 256)).alias("data"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id")).alias("client_timestamp"),
    )
    store = LogStore(spark, path)
    store.append(rows)
    store.catch_up(NOTES, buckets=16)
    whole = size_of(path, stores._folders(store.manifest().views["notes"]))
    store.append(rows.limit(100).withColumn("event_id", F.concat("event_id", F.lit("x"))))
    before = set(stores._folders(store.manifest().views["notes"]))
    store.catch_up(NOTES)
    after = set(stores._folders(store.manifest().views["notes"]))
    assert before < after and size_of(path, after - before) < whole / 20
    assert store.view("notes")[0].count() == 20_000


def test_a_copy_of_an_older_manifest(spark, tmp_path):
    log = random_log(29, 120)
    store = LogStore(spark, str(tmp_path / "store"))
    store.append(spark.createDataFrame(log[:80], LOG).drop("sequence_number"))
    store.catch_up(NOTES)
    at = store.manifest()
    store.view("notes")[0].write.parquet(str(tmp_path / "store/views/notes/old"))
    at.views["notes"] = {"fingerprint": at.views["notes"]["fingerprint"], "position": 80, "folder": "views/notes/old"}
    store.commit(at)
    assert rows_of(store.view("notes")[0]) == plain_aggregate(NOTES, log[:80])
    store.append(spark.createDataFrame(log[80:], LOG).drop("sequence_number"))
    store.catch_up(NOTES)
    assert rows_of(store.view("notes")[0]) == plain_aggregate(NOTES, log) and "views/notes/old" in store.manifest().marked


CHAIN = (
    "sequence_number long, event_id string, aggregate_id string, event_hash string, sealed_hash string, origin_db string, origin_position long, previous_event_hash string, held_as_authored_by string, "
    "ingest_sequence_number long, previous_ingest_hash string, causal struct<kind:string,eligible:boolean,parents:array<struct<event_id:string,event_hash:string>>>, expected string"
)


def broken_log(seed, n=160):
    """Several origins, with everything wrong that there is, references to later events and to none among it."""
    r, rows, last, versions, held = random.Random(seed), [], {}, {}, None
    for s in range(1, n + 1):
        if r.random() < 0.03 and s not in (1, n):
            continue
        db, agg, own = r.choice(["here", "b", "c"]), r.choice("xyz"), f"h{s}"
        pos, prev = last.get(db, (0, None))
        place = pos + 1
        if r.random() < 0.06 and pos:
            place = r.randrange(1, pos + 1)
        if r.random() < 0.12:
            prev = r.choice([None, "gone", "gone2", f"h{r.randrange(1, n)}"])
        due = versions.get(agg)
        parents = [due] if due else []
        if r.random() < 0.12:
            other = r.randrange(1, n)
            parents = r.choice([[], [(f"e{other}", f"h{other}")], [("nothing", "h")], [due[0:1] + ("bad",)] if due else []])
        kind, eligible = r.choice([("version", True), ("version", True), ("version", False), ("annotation", True)])
        rows.append((s, f"e{s}", agg, own, own, db, place, prev, db if db == "here" or r.random() < 0.5 else None, s if r.random() > 0.03 else s + 1, held if r.random() > 0.05 else "bad", (kind, eligible, parents), own if r.random() > 0.05 else "bad"))
        if place > pos:
            last[db] = (place, own)
        if kind == "version" and eligible:
            versions[agg] = (f"e{s}", own)
        held = own
    return rows


def found_in(df):
    return sorted((x.kind, x.sequence_number, x.event_id or "", x.detail or "") for x in df.collect())


@pytest.mark.parametrize("seed", range(2))
def test_stretches_find_what_one_walk_finds(spark, monkeypatch, seed):
    monkeypatch.setattr(chain, "BLOCK", 13)
    monkeypatch.setattr(frontier, "MERGE", 3)
    rows = broken_log(seed)
    log = spark.createDataFrame(rows, CHAIN).repartition(3).cache()
    whole = found_in(chain.verify_chains(log, holder="here", expected_hash=F.col("expected")))
    assert {k for k, *_ in whole} == {"sequence_missing", "storage_link_break", "predecessor_break", "position_reused", "fork_unrecorded", "parent_invalid", "parents_not_stamped", "hash_mismatch"}
    at = frontier.Frontier(frontier.scratch_dir(spark))
    head = rows[-1][0]
    for stop in (1, 60, 61, head):
        at = frontier.advance(log.where(F.col("sequence_number") > at.through), at, stop, holder="here", expected_hash=F.col("expected"))
        at = frontier.Frontier(**json.loads(json.dumps(at.as_dict())))
    assert found_in(at.findings(spark, "here")) == whole
    assert at.unresolved(spark) == chain.unresolved_predecessors(log).first()[0]


def test_a_frontier_reads_only_its_stretch(spark, tmp_path):
    rows = broken_log(5, 60)
    log = spark.createDataFrame(rows, CHAIN)
    at = frontier.advance(log, frontier.Frontier(frontier.scratch_dir(spark)), 30, holder="here")
    # Without the events before.
    later = frontier.advance(log.where("sequence_number > 30"), at, 60, holder="here")
    assert len(later.index) == 2 and spark.read.parquet(f"{later.folder}/{later.index[1]}").agg(F.min("sequence_number")).first()[0] > 30


def plain_batches(rows, size, most):
    """rows: (key, weight)."""
    out, held = [], []
    batch = -1
    for key, weight in rows:
        fits = held and held[0][0] == key and (size is None or len(held) < size) and (most is None or sum(w for _, w in held) + weight <= most)
        held = [*held, (key, weight)] if fits else [(key, weight)]
        batch += not fits
        out.append(batch)
    return out


@pytest.mark.parametrize("block", [5, 64])
@pytest.mark.parametrize("size, most, keyed", [(4, None, False), (3, None, True), (None, None, True), (None, 30, False), (None, 30, True), (5, 30, True), (None, 10_000, False), (1, 30, False), (None, 500, True)])
def test_batches_are_greedy(spark, monkeypatch, block, size, most, keyed):
    monkeypatch.setattr(delivery, "BLOCK", block)
    r = random.Random(block + (size or 0))
    rows, key = [], None
    for _ in range(150):
        key = r.choice(["a", "b", None]) if r.random() < 0.15 else key
        rows.append((key, r.choice([0, 1, 7, 12, 45])))
    positions = sorted(r.sample(range(1, 400), 150))
    df = spark.createDataFrame([(p, k, w, [p]) for p, (k, w) in zip(positions, rows, strict=True)], "sequence_number long, k string, w long, other array<int>")
    got = delivery.batches(df, size, "k" if keyed else None, **({"weight": F.col("w"), "most": most} if most else {}))
    assert got.columns == [*df.columns, "batch"]
    plain = plain_batches([(k if keyed else None, w) for k, w in rows], size, most)
    assert [x.batch for x in sorted(got.collect())] == plain


def test_keys_that_come_back_begin_new_batches(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "sequence_number long, k string")
    assert [x.batch for x in sorted(delivery.batches(df, 10, "k").collect())] == [0, 1, 2]


def test_a_hole_of_any_length_is_one_row(spark):
    df = spark.createDataFrame([(1,), (3,), (4_000_000_000_000_000_000,)], "sequence_number long")
    assert sorted(map(tuple, chain.missing_ranges(df).collect())) == [(2, 2), (4, 3_999_999_999_999_999_999)]
    ranges = spark.createDataFrame([("x", 5, 250_003), ("y", 7, 7)], "c string, first long, last long")
    got = chain.positions_in(ranges).groupBy("c").agg(F.count("*"), F.min("missing"), F.max("missing"), F.countDistinct("missing")).collect()
    assert sorted(map(tuple, got)) == [("x", 249_999, 5, 250_003, 249_999), ("y", 1, 7, 7, 1)]


def test_a_value_is_carried_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(chain, "BLOCK", 4)
    r = random.Random(8)
    rows = [(n, r.choice(["a", "b", None]), r.choice([None, n])) for n in range(60)]
    last, expected = {}, []
    for n, k, v in rows:
        expected.append(last.get(k))
        last[k] = v if v is not None else last.get(k)
    out = chain.with_last_before(spark.createDataFrame(rows, "sequence_number long, aggregate_id string, v int"), F.col("v"), "before")
    assert [x.before for x in sorted(out.collect())] == expected


def test_a_gap_is_replayed_with_own_events_only(spark):
    rows = [(1, "a", "note", 5, True), (2, "b", "note", 5, False), (3, "c", "system.sender_succession", 99, True), (4, "d", "system.security_finding", 1, True), (5, "e", "note", 99, True), (6, "f", "note", 5, True)]
    log = spark.createDataFrame(rows, "sequence_number long, event_id string, entry_type string, client_timestamp int, mine boolean")
    arguments = {"cursor": 5, "start": 2, "gap_upper": 9, "own": F.col("mine")}
    ids = lambda df: sorted(x.event_id for x in df.collect())
    assert ids(delivery.gap_replay(log, F.lit(True), **arguments)) == ["a"]
    assert ids(delivery.gap_replay(log, F.lit(True), **arguments, channel_wide=True)) == ["a", "c", "d"]
    assert ids(delivery.gap_replay(log, F.lit(True), **arguments, channel_wide=True, queued=log.where("event_id = 'd'"))) == ["a", "c"]


def test_bad_rows_are_no_events(spark):
    """A fold over nothing but an event of no interest leaves a view without rows, and a delta without files."""
    assert folds.fold(spark.createDataFrame([event(1, "z", "added", {"v": 1}, "elsewhere")], LOG), ITEMS).count() == 0


def test_an_append_makes_its_rows_once(spark, tmp_path):
    """However often numbering and dealing out read them."""
    made = spark.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    rows = spark.range(500).select(F.col("id").cast("string").alias("event_id"), F.lit("a").alias("aggregate_id"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 60).alias("client_timestamp"))
    LogStore(spark, str(tmp_path / "store")).append(rows.mapInArrow(run, rows.schema))
    assert made.value == 500

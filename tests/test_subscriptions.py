"""Streams of a store's commits: no gap and no repeat where the snapshot ends, whatever is appended meanwhile."""

import json
import threading

from test_upkeep import rows_of
from test_views import ITEMS, LOG, plain_table, random_log

from fathomlog.sources.store import LogStore
from fathomlog.streaming.subscriptions import follow_log, subscribe


def test_events_are_followed_once_each(spark, tmp_path):
    """Appends before, during and after the stream's start, and over a restart from its checkpoint."""
    log = random_log(31, 120)
    store = LogStore(spark, str(tmp_path / "store"))
    add = lambda a, b: store.append(spark.createDataFrame(log[a:b], LOG).drop("sequence_number"))
    seen, epochs = [], set()

    def handle(events, epoch):
        epochs.add(epoch)
        seen.extend(r.sequence_number for r in events.select("sequence_number").collect())

    add(0, 30)
    add(30, 50)
    query = follow_log(store, handle, str(tmp_path / "checkpoint"), after=40)
    writer = threading.Thread(target=lambda: [add(50, 60), store.catch_up(ITEMS), add(60, 90)])
    writer.start()
    writer.join()
    query.processAllAvailable()
    query.stop()
    assert sorted(seen) == list(range(41, 91))
    add(90, 120)
    query = follow_log(store, handle, str(tmp_path / "checkpoint"), after=40)
    query.processAllAvailable()
    query.stop()
    assert sorted(seen) == list(range(41, 121)) and len(epochs) >= 2


def test_a_view_is_handed_over_at_its_position(spark, tmp_path, monkeypatch):
    """A subscriber that applies all frames holds the view's rows, though catch-ups commit while the snapshot is sent, and buckets are compacted."""
    from fathomlog.sources import store as stores

    monkeypatch.setattr(stores, "COMPACT_ROWS", 2)
    log = [e for e in random_log(37, 400) if e[4] == "item"][:100]
    store = LogStore(spark, str(tmp_path / "store"))
    add = lambda a, b: (store.append(spark.createDataFrame(log[a:b], LOG).drop("sequence_number")), store.catch_up(ITEMS, buckets=3))
    held, ends, numbers = {}, [], []

    def send(frames, number):
        if number == -1:
            add(40, 55)  # before any frame is read
        for f in (json.loads(r.frame) for r in frames.collect()):
            numbers.append((number, f["type"]))
            if f["type"] == "end_of_replay":
                ends.append(f["position"])
            elif f["type"] == "tombstone":
                held.pop(f["key"], None)
            else:
                held[f["key"]] = f["row"]

    add(0, 40)
    query = subscribe(store, "items", send, str(tmp_path / "checkpoint"))
    add(55, 56)
    add(56, 80)
    query.processAllAvailable()
    add(80, 100)
    query.processAllAvailable()
    query.stop()
    placed = [(i + 1, *e[1:]) for i, e in enumerate(log)]
    assert ends == [40] and held == plain_table(ITEMS, placed) == rows_of(store.view("items")[0])
    assert {t for n, t in numbers if n >= 0} == {"delta", "tombstone"}

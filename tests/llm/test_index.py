"""The digest index's runs, filters and compaction, and thresholds between blocks."""

import numpy as np
from pyspark.sql import functions as F

from fathomlog.llm import exact_dedup, topk


def entries_of(df):
    return sorted((bytes(r.digest), r.low, r.high, r.n) for r in df.collect())


def test_runs_are_compacted_and_looked_up(spark):
    rows = spark.range(600).select(F.col("id"), F.unhex(F.sha2((F.col("id") % 250).cast("string"), 256)).alias("digest"))
    index = exact_dedup.DigestIndex(spark)
    for k in range(5):
        index.flush(rows.where(F.col("id") % 5 == k), 120)
    assert index.compactions >= 3 and [len(x) for x in index.levels] == [1, 0, 1]
    expected = rows.groupBy("digest").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count("*").alias("n"))
    assert entries_of(index.lookup(rows.select("digest").distinct())) == entries_of(expected)
    assert {bytes(r.digest) for r in index.hits().collect()} == {bytes(r.digest) for r in expected.where("n > 1").collect()}


def test_filters_lose_nothing_and_turn_strangers_away(spark):
    rows = spark.range(2000).select(F.col("id"), F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("digest"))
    index = exact_dedup.DigestIndex(spark)
    index.flush(rows.where("id < 1000"), 1000)
    run = index.levels[0][0]
    assert index._passed(rows.where("id < 1000").select("digest"), run).count() == 1000
    assert index._passed(rows.where("id >= 1000").select("digest"), run).count() < 150


def test_thresholds_of_earlier_blocks_stop_later_ones():
    rng = np.random.default_rng(4)
    near, far = np.floor(64 * rng.normal(1, 0.1, (200, 8))), np.floor(64 * rng.normal(0, 0.1, (500, 8)))
    queries = np.floor(64 * rng.normal(1, 0.1, (5, 8)))
    first = topk.SortedLists(np.arange(200), near).best(np.full(5, -1), queries, 10)
    floor = np.array([scores[-1] for _, scores in first])
    later = topk.SortedLists(np.arange(200, 700), far)
    read = []
    later.read = lambda q, depth: read.append(depth)
    assert all(not len(ids) for ids, _ in later.best(np.full(5, -1), queries, 10, floor)) and not read
    # A score that equals the threshold is kept, since its id may be smaller.
    same = topk.SortedLists(np.arange(200), near).best(np.full(5, -1), queries, 10, floor)
    assert all(a.tolist() == b.tolist() for (a, _), (b, _) in zip(first, same, strict=True))


def test_repeated_vectors_count_each(spark):
    rows = [(1, [1.0, 0.0])] * 30 + [(20, [1.0, 0.5]), (3, [0.5, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as v", "1 as dim", "1 as q", "1 as n", "1 as copies")
    out = topk.top_k(df, F.col("vec_id") % 20 == 0, k=20).orderBy("rank").collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in out] == [(20, n + 1, 1, 64 * 64) for n in range(20)]


def test_filters_are_read_at_every_size(spark, tricky, monkeypatch):
    """Filters too large to broadcast are met by their buckets; results are the same, and strangers are still turned away."""
    expected = sorted(map(str, exact_dedup.exact_groups(tricky, memtables=3).collect()))
    monkeypatch.setattr(exact_dedup, "BROADCAST_BYTES", 0)
    assert sorted(map(str, exact_dedup.exact_groups(tricky, memtables=3).collect())) == expected
    digests = lambda a, b: spark.range(a, b).select(F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("digest"), "id")
    index = exact_dedup.DigestIndex(spark)
    index.flush(digests(0, 3000), 3000)
    (run,) = [r for level in index.levels for r in level]
    assert index._passed(digests(0, 3000).select("digest"), run).count() == 3000
    assert index._passed(digests(10_000, 13_000).select("digest"), run).count() < 600

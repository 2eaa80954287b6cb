"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Each shard owns ``vnodes`` positions of a ring of ``RING`` slots. A row's place
is the hash of its text, so equal texts are neighbours and stay in one shard as
far as its bound allows. A shard holds at most its bound (``n // shards`` rows,
one more for the first ``n % shards`` shards); rows beyond it continue clockwise
to the next shard with room. Because the bounds add up to ``n``, two laps place
every row and counts are at most one apart.

Nothing is decided row by row: rows are counted by cell (ring slot and a salt
from the id, so that one text held by a third of the rows fills many cells), the
walk runs over the counts of the arcs (``shards * vnodes`` numbers whatever the
input), and a row finds its place from its rank within its cell.

Defined results: a null text is empty (size 1, CRC 0); null ids are allowed and
rank first; repeated rows each get a slot of their own; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RING = 4096
#: Parts of a ring slot at least, and rows of a part of one that holds all: a text held by most rows is still many tasks.
SALTS, SALT_ROWS = 64, 1 << 20


def ring_owners(shards: int, vnodes: int) -> list[tuple[int, int, int]]:
    """(ring slot, arc, shard) for every slot: the arc ends at the next virtual node clockwise.

    More shards only add nodes, so a slot keeps its owner unless a new node cuts its arc.
    """
    at: dict[int, int] = {}
    for shard in range(shards):
        for v in range(vnodes):
            place = int.from_bytes(hashlib.blake2b(f"{shard}/{v}".encode(), digest_size=8).digest(), "big") % RING
            while place in at:
                place = (place + 1) % RING
            at[place] = shard
    nodes = sorted(at)
    out, arc = [], 0
    for slot in range(RING):
        if arc < len(nodes) and slot > nodes[arc]:
            arc += 1
        k = arc % len(nodes)
        out.append((slot, k, at[nodes[k]]))
    return out


def _walk(arcs: DataFrame, shards: int) -> DataFrame:
    """Per arc: its bound, where its overflow starts in ring order, and the places that overflow is given.

    ``arcs``: (arc, shard, first, rows), ``first`` being the rank within the shard of the arc's first row.
    """
    total = Window.partitionBy("one")
    before = Window.partitionBy("one").orderBy("arc").rowsBetween(Window.unboundedPreceding, -1)
    n = F.sum("rows").over(total)
    counted = (
        arcs.withColumn("one", F.lit(1))
        .withColumn("cap", F.floor(n / F.lit(shards)).cast("long") + (F.col("shard") < n % F.lit(shards)).cast("long"))
        .withColumn("over", F.greatest(F.lit(0), F.expr("first + rows - greatest(cap, first)")).cast("long"))
        .withColumn("over_from", F.coalesce(F.sum("over").over(before), F.lit(0)).cast("long"))
    )
    walked = counted.groupBy("one").agg(
        F.array_sort(F.collect_list(F.struct("arc", "shard", "cap", "first", "rows", "over", "over_from"))).alias("arcs")
    )
    load = f"""transform(sequence(0, {shards - 1}), s -> coalesce(aggregate(filter(arcs, a -> a.shard = s),
        cast(0 as bigint), (m, a) -> greatest(m, least(a.first + a.rows, a.cap))), cast(0 as bigint)))"""
    start = f"""named_struct('carry', 0L, 'served', 0L, 'load', {load},
        'takes', cast(array() as array<struct<shard:int,at:bigint,n:bigint,slot:bigint>>))"""
    step = """(s, a) -> transform(array(least(s.carry + a.add, a.cap - s.load[a.shard])), t -> named_struct(
        'carry', s.carry + a.add - t, 'served', s.served + t,
        'load', transform(s.load, (x, j) -> if(j = a.shard, x + t, x)),
        'takes', if(t > 0, concat(s.takes, array(named_struct('shard', a.shard, 'at', s.served, 'n', t, 'slot', s.load[a.shard]))), s.takes)))[0]"""
    laps = "concat(transform(arcs, a -> named_struct('shard', a.shard, 'cap', a.cap, 'add', a.over)), transform(arcs, a -> named_struct('shard', a.shard, 'cap', a.cap, 'add', 0L)))"
    return (
        walked.withColumn("takes", F.expr(f"aggregate({laps}, {start}, {step}).takes"))
        .select(F.explode("arcs").alias("a"), "takes")
        .select(
            F.col("a.arc").alias("arc"),
            F.col("a.cap").alias("cap"),
            F.col("a.first").alias("first"),
            F.col("a.over_from").alias("over_from"),
            F.expr("filter(takes, t -> t.at < a.over_from + a.over and t.at + t.n > a.over_from)").alias("takes"),
        )
    )


def shard_rows(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shards: int = 16, vnodes: int = 32) -> DataFrame:
    """(id, size, text_crc32, shard, slot): every row in a shard, slots gapless from 0 in each."""
    spark = df.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    salts = max(SALTS, -(-df.count() // SALT_ROWS))
    rows = df.select(
        F.col(id_col).alias("id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("h"),
        F.xxhash64(F.col(id_col)).alias("g"),
    ).select("*", F.shiftrightunsigned("h", 52).cast("int").alias("ring"), F.pmod("g", F.lit(salts)).cast("int").alias("salt"))

    owners = spark.sql("SELECT * FROM VALUES " + ",".join(str(x) for x in ring_owners(shards, vnodes)) + " AS t(ring, arc, shard)")
    in_shard = Window.partitionBy("shard").orderBy("arc", "ring", "salt").rowsBetween(Window.unboundedPreceding, -1)
    cells = (
        rows.groupBy("ring", "salt").agg(F.count("*").alias("rows"))
        .join(F.broadcast(owners), "ring")  # RING rows
        .withColumn("first", F.coalesce(F.sum("rows").over(in_shard), F.lit(0)).cast("long"))
    )
    # Arcs without rows of their own are walked too: they take what overflows.
    counts = cells.groupBy("arc").agg(F.min("first").alias("first"), F.sum("rows").alias("rows"))
    arcs = owners.select("arc", "shard").distinct().join(counts, "arc", "left").fillna(0, ["first", "rows"])
    placed = cells.join(F.broadcast(_walk(arcs, shards).withColumnRenamed("first", "arc_first")), "arc")  # shards * vnodes rows
    own = Window.partitionBy("ring", "salt").orderBy("h", "g", "id", "text_crc32", "size")
    take = F.expr("get(filter(takes, t -> t.at <= o and o < t.at + t.n), 0)")
    return (
        rows.withColumn("rn", F.row_number().over(own))
        .join(placed.select("ring", "salt", "shard", "first", "cap", "arc_first", "over_from", "takes"), ["ring", "salt"])
        .withColumn("rank", F.col("first") + F.col("rn") - 1)
        .withColumn("o", F.when(F.col("rank") >= F.col("cap"), F.col("over_from") + F.col("rank") - F.greatest("cap", "arc_first")))
        .withColumn("take", take)
        .select(
            F.col("id").alias(id_col),
            "size",
            "text_crc32",
            F.coalesce(F.col("take.shard"), F.col("shard")).cast("int").alias("shard"),
            F.when(F.col("o").isNull(), F.col("rank")).otherwise(F.expr("take.slot + o - take.at")).cast("long").alias("slot"),
        )
    )

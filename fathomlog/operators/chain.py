"""Checks of hash chains, one DataFrame of findings each, and their union.

Input: a log with sequence_number, event_id, aggregate_id, event_hash, previous_event_hash,
causal and the coordinates of ``functions.coordinates``. Every check is a join or an
aggregate on its own key; none orders the whole log in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomlog.sources.scratch import written

#: Positions that are looked at together.
BLOCK = 100_000
#: Columns of a finding: what kind, where, and the evidence.
FINDING = ("kind", "sequence_number", "event_id", "detail")


def _found(rows: DataFrame, kind: str, detail: Column) -> DataFrame:
    return rows.select(F.lit(kind).alias("kind"), F.col("sequence_number").cast("long").alias("sequence_number"), F.col("event_id").cast("string").alias("event_id"), detail.cast("string").alias("detail"))


def hash_mismatch(log: DataFrame, expected: Column) -> DataFrame:
    """Events whose hash isn't that of their content, ``expected``."""
    return _found(log.where(~F.col("event_hash").eqNullSafe(expected)), "hash_mismatch", expected)


def missing_ranges(log: DataFrame, *, chain: list[str] | None = None, position: str = "sequence_number") -> DataFrame:
    """(*chain, first, last): the stretches of positions that are absent between two that are held.

    Neighbours are found within blocks of positions, which run in parallel whatever a chain's share of the log;
    only the blocks' ends, one row to a block, are put in order per chain. A hole is one row, however long.
    """
    keys = chain or []
    held = log.select(*keys, F.col(position).cast("long").alias("p")).where("p is not null").withColumn("b", F.floor(F.col("p") / F.lit(BLOCK)))
    within = held.select(*keys, "p", F.lead("p").over(Window.partitionBy(*keys, "b").orderBy("p")).alias("q"))
    ends = held.groupBy(*keys, "b").agg(F.min("p").alias("first"), F.max("p").alias("last"))
    across = ends.select(*keys, F.col("last").alias("p"), F.lead("first").over(Window.partitionBy(*keys).orderBy("b")).alias("q"))
    return within.union(across).where("q > p + 1").select(*keys, (F.col("p") + 1).alias("first"), (F.col("q") - 1).alias("last"))


def positions_in(ranges: DataFrame, name: str = "missing") -> DataFrame:
    """Every position (from 0) of ranges (first, last).

    A range is cut into ever shorter stretches, which are dealt out before they are opened: no array and
    no task holds a whole long one.
    """
    others = [c for c in ranges.columns if c not in ("first", "last")]
    for width in (BLOCK**3, BLOCK**2, BLOCK):
        cut = ranges.withColumn("__k", F.explode(F.expr(f"sequence(first div {width}L, last div {width}L)")))
        first = F.when(F.expr(f"first div {width}L") == F.col("__k"), F.col("first")).otherwise(F.col("__k") * F.lit(width))
        last = F.when(F.expr(f"last div {width}L") == F.col("__k"), F.col("last")).otherwise(F.col("__k") * F.lit(width) + F.lit(width - 1))
        ranges = cut.select(*others, first.alias("first"), last.alias("last"))
    return ranges.repartition("first").select(*others, F.explode(F.sequence("first", "last")).alias(name))


def sequence_missing(log: DataFrame, *, chain: list[str] | None = None, position: str = "sequence_number") -> DataFrame:
    """(*chain, missing): every position that is absent between two that are held."""
    return positions_in(missing_ranges(log, chain=chain, position=position))


def storage_link_break(log: DataFrame, *, chain: list[str] | None = None) -> DataFrame:
    """Events whose stored position or previous hash isn't that of the event before; skipped where that one is missing.

    The event before is looked up within blocks of positions, to each of which the last event of the block before is added;
    so every event moves once, not at all where the log is dealt by its chains already, and no chain is one task.
    """
    keys, at = chain or [], F.col("sequence_number").cast("long")
    block = F.floor(at / F.lit(BLOCK))
    blocks = F.when((at + 1) % F.lit(BLOCK) == 0, F.array(block, block + 1)).otherwise(F.array(block))
    rows = log.select(*keys, "sequence_number", "event_id", "event_hash", "ingest_sequence_number", "previous_ingest_hash", at.alias("__at"), F.explode(blocks).alias("__block"))
    at_before = Window.partitionBy(*keys, "__block").orderBy("__at").rangeBetween(-1, -1)
    rows = rows.withColumn("__before", F.when(F.col("__at").isNotNull(), F.collect_list(F.struct("event_hash")).over(at_before)).otherwise(F.array()))
    rows = rows.where(F.col("__block").eqNullSafe(F.floor(F.col("__at") / F.lit(BLOCK))))
    first = F.col("sequence_number") == 1
    wrong_place = ~F.col("ingest_sequence_number").eqNullSafe(F.col("sequence_number"))
    other = F.size(F.filter("__before", lambda x: ~F.col("previous_ingest_hash").eqNullSafe(x["event_hash"])))
    # A finding for each event held at the position before.
    each = F.greatest(F.lit(1), F.size("__before"))
    times = F.when(wrong_place, each).when(first, F.when(F.col("previous_ingest_hash").isNotNull(), each).otherwise(0)).otherwise(other)
    detail = F.when(wrong_place, "ingest_sequence_number").otherwise("previous_ingest_hash")
    found = rows.withColumn("__times", times).where("__times > 0").withColumn("__each", F.explode(F.array_repeat(F.lit(True), F.col("__times"))))
    return _found(found, "storage_link_break", detail)


def predecessors_met(refs: DataFrame, held: DataFrame) -> DataFrame:
    """``refs``, each with every held event under its predecessor's hash, or none: ``p_hash``, and ``why`` it can't be (null where it can)."""
    sealed = held.select(F.col("sealed_hash").alias("p_hash"), F.col("origin_db").alias("p_db"), F.col("origin_position").alias("p_pos"))
    joined = refs.join(sealed, F.col("previous_event_hash") == F.col("p_hash"), "left")
    why = F.when(F.col("p_hash").isNull(), None).when(~F.col("p_db").eqNullSafe(F.col("origin_db")), "other_origin").when(F.col("p_pos") >= F.col("origin_position"), "not_earlier")
    return joined.withColumn("why", why).drop("p_db", "p_pos")


def predecessors_found(met: DataFrame) -> DataFrame:
    return _found(met.where("why is not null"), "predecessor_break", F.col("why")).distinct()


def predecessors_judged(refs: DataFrame, held: DataFrame) -> DataFrame:
    """Findings of events whose predecessor is held but belongs to another origin or stands no earlier."""
    sealed = held.select(F.col("sealed_hash").alias("p_hash"), F.col("origin_db").alias("p_db"), F.col("origin_position").alias("p_pos"))
    joined = refs.where("previous_event_hash is not null").join(sealed, F.col("previous_event_hash") == F.col("p_hash"))
    why = F.when(~F.col("p_db").eqNullSafe(F.col("origin_db")), "other_origin").when(F.col("p_pos") >= F.col("origin_position"), "not_earlier")
    return _found(joined.withColumn("why", why).where("why is not null"), "predecessor_break", F.col("why")).distinct()


def predecessor_break(log: DataFrame, holder: str | None = None) -> DataFrame:
    """Events whose predecessor belongs to another origin, stands no earlier, or is missing though ``holder`` wrote them; one join tells all three."""
    if holder is None:
        return predecessors_judged(log, log)
    sealed = log.select(F.col("sealed_hash").alias("p_hash"), F.col("origin_db").alias("p_db"), F.col("origin_position").alias("p_pos"))
    joined = log.where("previous_event_hash is not null").join(sealed, F.col("previous_event_hash") == F.col("p_hash"), "left")
    held = F.col("p_hash").isNotNull()
    why = (
        F.when(~held, F.when(F.col("held_as_authored_by") == holder, "dangling"))
        .when(~F.col("p_db").eqNullSafe(F.col("origin_db")), "other_origin")
        .when(F.col("p_pos") >= F.col("origin_position"), "not_earlier")
    )
    found = _found(joined.withColumn("why", why).where("why is not null"), "predecessor_break", F.col("why"))
    # Several held events may share a hash, and say the same of one event; those that lack theirs are one row each.
    once = found.groupBy(*FINDING).agg(F.count("*").alias("__n"))
    return once.select(*FINDING, F.explode(F.array_repeat(F.lit(True), F.when(F.col("detail") == "dangling", F.col("__n")).otherwise(1).cast("int"))).alias("__each")).drop("__each")


def unresolved_predecessors(log: DataFrame, holder: str | None = None) -> DataFrame:
    """(unresolved): events with a predecessor that isn't held and that ``holder`` didn't write."""
    sealed = log.select(F.col("sealed_hash").alias("previous_event_hash")).distinct()
    left = log.where("previous_event_hash is not null").join(sealed, "previous_event_hash", "left_anti")
    return left.where(~F.col("held_as_authored_by").eqNullSafe(F.lit(holder)) | F.lit(holder is None)).agg(F.count("*").alias("unresolved"))


def positions_reused(log: DataFrame) -> DataFrame:
    """(origin_db, origin_position, events): positions of an origin that several events claim."""
    return log.groupBy("origin_db", "origin_position").agg(F.countDistinct("event_id").alias("events")).where("events > 1")


def forks(log: DataFrame) -> DataFrame:
    """(origin_db, previous_event_hash, lowest_position, successors): several successors of one event at several positions.

    Nothing (the start of a chain) is a predecessor too. Successors that share one position are a
    reused position rather than a fork.
    """
    return (
        log.groupBy("origin_db", "previous_event_hash")
        .agg(F.min("origin_position").alias("lowest_position"), F.size(F.collect_set(F.struct("origin_position"))).alias("positions"), F.countDistinct("event_id").alias("successors"))
        .where("positions > 1 and successors > 1").select("origin_db", "previous_event_hash", "lowest_position", "successors")
    )


def named_parents(log: DataFrame) -> DataFrame:
    """(sequence_number, event_id, aggregate_id, parent_id, parent_hash): a row for each parent that an event names."""
    rows = log.select("sequence_number", "event_id", "aggregate_id", F.explode("causal.parents").alias("p"))
    return rows.select("sequence_number", "event_id", "aggregate_id", F.col("p.event_id").cast("string").alias("parent_id"), F.col("p.event_hash").alias("parent_hash"))


def judged_parents(named: DataFrame, log: DataFrame) -> DataFrame:
    """Findings of named parents that ``log`` holds and that can't be parents; the first reason counts."""
    held = log.select(F.col("event_id").cast("string").alias("parent_id"), F.col("sealed_hash").alias("p_hash"), F.col("aggregate_id").alias("p_agg"), F.col("causal.kind").alias("p_kind"), F.col("causal.eligible").alias("p_eligible"))
    why = (
        F.when(~F.col("p_hash").eqNullSafe(F.col("parent_hash")), "held_under_other_hash")
        .when(F.col("p_agg") != F.col("aggregate_id"), "other_aggregate")
        .when(~F.col("p_kind").eqNullSafe("version"), "annotation")
        .when(~F.coalesce("p_eligible", F.lit(False)), "ineligible")
    )
    return _found(named.join(held, "parent_id").withColumn("why", why).where("why is not null"), "parent_invalid", F.concat_ws(":", "parent_id", "why"))


def parent_invalid(log: DataFrame) -> DataFrame:
    """Events with a held parent that can't be one; the first reason counts, and parents not held are passed over."""
    return judged_parents(named_parents(log), log)


def stamped_parent(eligible: Column, value: Column, key: str = "aggregate_id") -> Column:
    """The latest eligible version of the aggregate before each event, for aggregates of few events."""
    before = Window.partitionBy(key).orderBy("sequence_number").rowsBetween(Window.unboundedPreceding, -1)
    return F.last(F.when(eligible, value), ignorenulls=True).over(before)


def with_last_before(log: DataFrame, value: Column, name: str, key: str = "aggregate_id") -> DataFrame:
    """Adds ``name``: the last ``value`` that isn't null of the same key before each event.

    Looked for within blocks of positions; a block's first events take what the key's blocks before carry on, one
    row to a block. So a key that holds much of the log is many tasks.
    """
    blocked = log.withColumn("__value", value).withColumn("__block", F.floor(F.col("sequence_number") / F.lit(BLOCK)))
    own = Window.partitionBy(key, "__block").orderBy("sequence_number").rowsBetween(Window.unboundedPreceding, -1)
    ends = blocked.groupBy(F.col(key).alias("__key"), F.col("__block").alias("__b")).agg(F.max_by("__value", F.when(F.col("__value").isNotNull(), F.col("sequence_number"))).alias("__end"))
    earlier = Window.partitionBy("__key").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("__key", "__b", F.last("__end", ignorenulls=True).over(earlier).alias("__carried"))
    within = blocked.withColumn("__within", F.last("__value", ignorenulls=True).over(own))
    joined = within.join(carried, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__block") == F.col("__b")), "left")
    return joined.select(*log.columns, F.coalesce("__within", "__carried").alias(name))


def parents_not_stamped(log: DataFrame, holder: Column) -> DataFrame:
    """Events that ``holder`` admits and whose parents aren't exactly the latest eligible version before them, or none."""
    eligible = (F.col("causal.kind") == "version") & F.col("causal.eligible")
    version = F.when(eligible, F.struct(F.col("event_id").cast("string").alias("event_id"), F.col("sealed_hash").alias("event_hash")))
    none = F.array().cast("array<struct<event_id:string,event_hash:string>>")
    marked = with_last_before(log, version, "due").withColumn("expected", F.when(F.col("due").isNull(), none).otherwise(F.array("due")))
    return _found(marked.where(holder & ~F.col("causal.parents").eqNullSafe(F.col("expected"))), "parents_not_stamped", F.col("due.event_id"))


def _arises(log: DataFrame, keys: list[str], value: str, kind: str, detail: str) -> DataFrame:
    """A finding for each key with several values, at the first event whose value isn't that of the key's first event.

    What comes later in the log doesn't move it.
    """
    first = log.groupBy(*(F.col(c).alias(f"k_{c}") for c in keys)).agg(F.min_by(F.struct(value), "sequence_number").alias("first"), F.countDistinct(F.struct(value)).alias("values")).where("values > 1")
    on = F.lit(True)
    for c in keys:
        on &= F.col(c).eqNullSafe(F.col(f"k_{c}"))
    other = log.join(first, on).where(~F.struct(value).eqNullSafe(F.col("first")))
    at = other.groupBy(*keys).agg(F.min("sequence_number").alias("sequence_number"), F.min_by("event_id", "sequence_number").alias("event_id"))
    return _found(at, kind, F.col(detail))


def position_reuses(log: DataFrame) -> DataFrame:
    """A finding for each position of an origin that several events claim, where the second one stands."""
    return _arises(log.where("origin_db is not null and origin_position is not null"), ["origin_db", "origin_position"], "event_id", "position_reused", "origin_position")


def fork_points(log: DataFrame) -> DataFrame:
    """A finding for each event, or nothing, with successors of one origin at several positions, where the second such stands."""
    return _arises(log.where("origin_db is not null"), ["origin_db", "previous_event_hash"], "origin_position", "fork_unrecorded", "previous_event_hash")


def missing_findings(log: DataFrame) -> DataFrame:
    missing = F.col("missing").alias("sequence_number")
    return sequence_missing(log).select(F.lit("sequence_missing").alias("kind"), missing, F.lit(None).cast("string").alias("event_id"), F.lit(None).cast("string").alias("detail"))


def verify_chains(log: DataFrame, *, holder: str, expected_hash: Column | None = None, start: int | None = None, stop: int | None = None) -> DataFrame:
    """Findings of all checks with positions in [start, stop], in order; a log without any is valid.

    A bound below zero or a start past the stop is an error. Neighbours outside the bounds are looked at; positions
    are expected from 1.
    """
    if (start is not None and start < 0) or (start is not None and stop is not None and start > stop):
        raise ValueError("bounds must not be negative, nor start lie past stop")
    # Written once and narrow, as every check reads it, most of them twice.
    columns = ["sequence_number", "event_id", "aggregate_id", "event_hash", "sealed_hash", "origin_db", "origin_position", "previous_event_hash", "held_as_authored_by", "ingest_sequence_number", "previous_ingest_hash", "causal"]
    log = written(log.select(*columns, *([] if expected_hash is None else [expected_hash.alias("__expected")])))
    positions = log.select(F.col("sequence_number").cast("long").alias("sequence_number"))
    checks = [
        missing_findings(positions.union(log.sparkSession.range(1))),
        storage_link_break(log),
        predecessor_break(log, holder),
        position_reuses(log),
        fork_points(log),
        parent_invalid(log),
        parents_not_stamped(log, F.coalesce(F.col("held_as_authored_by") == holder, F.lit(False))),
    ]
    if expected_hash is not None:
        checks.append(hash_mismatch(log, F.col("__expected")))
    out = checks[0]
    for check in checks[1:]:
        out = out.unionByName(check)
    if start is not None:
        out = out.where(F.col("sequence_number") >= start)
    if stop is not None:
        out = out.where(F.col("sequence_number") <= stop)
    return out.orderBy("sequence_number", "kind", "event_id")


def _short(text: Column) -> Column:
    """A text as bytes that no other text has; hashes in hexadecimal take half their length."""
    return F.when(text.rlike(r"\A[0-9a-f]+\z") & (F.length(text) % 2 == 0), F.concat(F.lit(b"\1"), F.unhex(text))).otherwise(F.concat(F.lit(b"\2"), F.encode(text, "UTF-8")))


def structure_findings(new: DataFrame, stored: DataFrame) -> DataFrame:
    """Findings of ``new`` events against those stored before them; a predecessor that isn't held is none here.

    Kinds: ``predecessor_break`` (of another origin, or not earlier), ``position_reused`` and ``fork_unrecorded``.
    """
    columns = ["sequence_number", "event_id", "origin_db", "origin_position", "previous_event_hash", "sealed_hash"]
    side = lambda df, is_new: df.select(*(F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns), F.lit(is_new).alias("__new"))
    return structure_findings_marked(side(new, True).unionAll(side(stored, False)), F.col("__new"))


def structure_findings_marked(log: DataFrame, new: Column) -> DataFrame:
    """``structure_findings`` of one log, of which ``new`` tells the new events (true) from the stored ones (false).

    What a new event has to know of those stored under its key (hash, position or predecessor) are bounds and counts; so each key's events
    are looked at once, in the parts that a log dealt by its origins has already; by hash alone they move.
    """
    both = log.select("sequence_number", "event_id", "origin_db", "origin_position", "previous_event_hash", "sealed_hash", new.alias("__new")).where("__new is not null")
    of_stored = lambda value: F.when(~F.col("__new"), value)
    hashed = F.when(F.col("__new"), F.col("previous_event_hash")).otherwise(F.col("sealed_hash"))
    moved = (F.when(F.col("__new"), F.col(c)).alias(c) for c in ("sequence_number", "event_id"))
    met = both.select(_short(hashed).alias("__key"), "origin_db", "origin_position", *moved, "__new").where("__key is not null")
    held, own = Window.partitionBy("__key"), Window.partitionBy("__key", "origin_db")
    met = met.select(
        "*", F.count(of_stored(F.lit(1))).over(held).alias("__all"), F.count(of_stored(F.lit(1))).over(own).alias("__own"), F.max(of_stored(F.col("origin_position"))).over(own).alias("__highest")
    ).where("__new")
    why = F.filter(F.array(F.when(F.col("__all") > F.col("__own"), "other_origin"), F.when(F.col("__highest") >= F.col("origin_position"), "not_earlier")), lambda x: x.isNotNull())
    broken = _found(met.withColumn("why", F.explode(why)), "predecessor_break", F.col("why"))

    # By position; events under one id are no two.
    place = Window.partitionBy("origin_db", "origin_position")
    ids = of_stored(F.col("event_id"))
    placed = both.where("origin_position is not null").select("*", F.min(ids).over(place).alias("__a"), F.max(ids).over(place).alias("__b")).where("__new and (__a <> event_id or __b <> event_id)")
    reused = _found(placed, "position_reused", F.col("origin_position"))

    # By predecessor; a successor counts that differs in position and in id.
    after = Window.partitionBy("origin_db", "previous_event_hash")
    ids, places = of_stored(F.col("event_id")), of_stored(F.col("origin_position"))
    known = both.where("event_id is not null and origin_position is not null")
    known = known.select("*", F.min(ids).over(after).alias("__a"), F.max(ids).over(after).alias("__b"), F.min(places).over(after).alias("__p"), F.max(places).over(after).alias("__q"), F.max("__new").over(after).alias("__asked"))
    # Where stored ones differ from each other in both, those alike in position or id are counted off.
    mixed = F.col("__a").isNotNull() & (F.col("__a") != F.col("__b")) & (F.col("__p") != F.col("__q"))
    known = known.where(F.when(mixed, F.col("__asked")).otherwise(F.col("__new") & ((F.col("__a") != F.col("event_id")) | (F.col("__b") != F.col("event_id"))) & ((F.col("__p") != F.col("origin_position")) | (F.col("__q") != F.col("origin_position")))))
    alike = lambda *more: F.count(of_stored(F.lit(1))).over(Window.partitionBy("origin_db", "previous_event_hash", *more))
    others = alike() - alike("origin_position") - alike("event_id") + alike("event_id", "origin_position")
    known = known.withColumn("__others", others).where(F.col("__new") & (~mixed | (F.col("__others") > 0)))
    forked = _found(known, "fork_unrecorded", F.col("previous_event_hash"))
    return broken.distinct().unionByName(reused).unionByName(forked)

"""Verification of a log stretch by stretch, each event being read once.

A ``Frontier`` is what the events verified so far leave to those that follow: the last position and
hash, each origin's last event, each aggregate's last eligible version, a narrow index of all events for the
few references that go further back, and the references that nothing held so far answers. A stretch is
written once in narrow form, its own references are met within it first, and the index is read only for
what is left. All tables are Parquet files under one folder; the frontier itself is a small value that
``as_dict`` turns into JSON, for a manifest say.
"""

from __future__ import annotations

import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomlog.operators import chain
from fathomlog.sources.scratch import scratch_dir, written

_CAUSAL = "struct<kind:string,eligible:boolean,parents:array<struct<event_id:string,event_hash:string>>>"
#: An event as the index keeps it.
NARROW = (
    "sequence_number long, event_id string, aggregate_id string, event_hash string, sealed_hash string, origin_db string, origin_position long, previous_event_hash string, "
    f"held_as_authored_by string, ingest_sequence_number long, previous_ingest_hash string, causal {_CAUSAL}, expected string"
)
_FINDING = "kind string, sequence_number long, event_id string, detail string"
#: References without an answer: an event's predecessor, or a parent that it names.
_WAITING = (
    "sequence_number long, event_id string, aggregate_id string, origin_db string, origin_position long, previous_event_hash string, held_as_authored_by string, parent_id string, parent_hash string"
)
_ORIGIN = "origin_db string, max_position long, tip_hash string, followed boolean"
_VERSION = "aggregate_id string, sequence_number long, event_id string, sealed_hash string"
#: Folders of versions that are merged into one.
MERGE = 16


@dataclass
class Frontier:
    folder: str
    through: int = 0
    last_position: int = 0
    last_hash: str | None = None
    index: list[str] = field(default_factory=list)
    versions: list[str] = field(default_factory=list)
    found: list[str] = field(default_factory=list)
    origins: str | None = None
    waiting: str | None = None

    def as_dict(self) -> dict:
        return asdict(self)

    def read(self, spark: SparkSession, names: list[str] | str | None, schema: str) -> DataFrame:
        names = [names] if isinstance(names, str) else names
        return spark.read.schema(schema).parquet(*(f"{self.folder}/{n}" for n in names)) if names else spark.createDataFrame([], schema)

    def write(self, df: DataFrame, schema: str, kind: str) -> str:
        name = f"{kind}-{uuid.uuid4().hex}"
        fields = [x.strip().split(" ", 1) for x in _columns(schema)]
        df.select(*(F.col(n).cast(t).alias(n) for n, t in fields)).write.parquet(f"{self.folder}/{name}")
        return name

    def findings(self, spark: SparkSession, holder: str) -> DataFrame:
        """All findings so far in order: what was found, and own predecessors that nothing held answers."""
        lost = self.read(spark, self.waiting, _WAITING).where(F.col("previous_event_hash").isNotNull() & (F.col("held_as_authored_by") == holder))
        dangling = lost.select(F.lit("predecessor_break").alias("kind"), "sequence_number", "event_id", F.lit("dangling").alias("detail"))
        return self.read(spark, self.found, _FINDING).unionByName(dangling).orderBy("sequence_number", "kind", "event_id")

    def unresolved(self, spark: SparkSession) -> int:
        """Predecessors that aren't held."""
        return self.read(spark, self.waiting, _WAITING).where("previous_event_hash is not null").count()


def _columns(schema: str) -> list[str]:
    """A schema's fields, commas within types left alone."""
    out, depth = [""], 0
    for c in schema:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return out


def _rows_like(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` with all of ``columns``, null where it lacks one."""
    return df.select(*(F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns))


def advance(events: DataFrame, frontier: Frontier, stop: int, *, holder: str, expected_hash: Column | None = None) -> Frontier:
    """The frontier after the stretch (``frontier.through``, ``stop``] of a log, its findings being kept with it.

    events: the log or just that stretch of it, with the columns of ``operators.chain``.
    """
    spark, f, seq = events.sparkSession, frontier, F.col("sequence_number")
    stretch = events.where((seq > f.through) & (seq <= stop)).withColumn("expected", expected_hash if expected_hash is not None else F.col("event_hash"))
    name = f.write(stretch, NARROW, "index")
    new, old = f.read(spark, name, NARROW), f.read(spark, f.index, NARROW)
    waiting, origins = f.read(spark, f.waiting, _WAITING), f.read(spark, f.origins, _ORIGIN)
    versions = f.read(spark, f.versions, _VERSION).groupBy("aggregate_id").agg(F.max_by(F.struct("sequence_number", "event_id", "sealed_hash"), "sequence_number").alias("v")).select("aggregate_id", "v.*")
    prior = spark.createDataFrame([(f.last_position, f.last_hash)], "sequence_number long, event_hash string")
    found = [chain.missing_findings(new.select("sequence_number").union(prior.select("sequence_number"))), chain.hash_mismatch(new, F.col("expected"))]
    linked = new.unionByName(prior, allowMissingColumns=True) if f.last_position else new
    found.append(chain.storage_link_break(linked).where(seq > f.last_position))

    # Predecessors: in the stretch, at an origin's last event, or further back. One join of the stretch with itself, of which only
    # what isn't answered there, or is found wrong, is kept for what follows.
    refs = new.where("previous_event_hash is not null")
    hashes = lambda df, column: df.select(F.col(column).alias("previous_event_hash")).distinct()
    waits = [x.split()[0] for x in _columns(_WAITING)]
    tied = written(chain.predecessors_met(_rows_like(new, waits), new).where("p_hash is null or why is not null"))
    loose = tied.where("p_hash is null")
    beyond = loose.where("previous_event_hash is not null").select(*waits)
    tips = origins.select(F.col("tip_hash").alias("sealed_hash"), "origin_db", F.col("max_position").alias("origin_position"))
    far = beyond.join(hashes(origins, "tip_hash"), "previous_event_hash", "left_anti")
    back = old.join(hashes(far, "previous_event_hash").withColumnRenamed("previous_event_hash", "sealed_hash"), "sealed_hash", "left_semi") if f.index and not far.isEmpty() else None
    held = new.select("sealed_hash", "origin_db", "origin_position", F.lit(True).alias("fresh")).unionByName(tips.withColumn("fresh", F.lit(False)))
    if back is not None:
        held = held.unionByName(back.select("sealed_hash", "origin_db", "origin_position", F.lit(False).alias("fresh")))
    waited = waiting.where("previous_event_hash is not null")
    asked = beyond.unionByName(waited)
    held = written(held.join(asked.select(F.col("previous_event_hash").alias("sealed_hash")).distinct(), "sealed_hash", "left_semi"))
    # What the stretch answers may be the hash of an origin's last event too.
    found.append(chain.predecessors_found(tied).unionByName(chain.predecessors_judged(refs, tips)).unionByName(chain.predecessors_judged(asked, held)).distinct())
    still = [asked.join(hashes(held, "sealed_hash"), "previous_event_hash", "left_anti")]

    # Positions and forks: only keys that earlier events can hold too are looked up.
    near = new.join(origins.select("origin_db", "max_position"), "origin_db")
    again = near.where("origin_position <= max_position").select("origin_db", "origin_position").distinct()
    earlier = old.join(again, ["origin_db", "origin_position"], "left_semi") if f.index and not again.isEmpty() else None
    found.append(chain.position_reuses(new if earlier is None else new.unionByName(earlier)).where(seq > f.through))
    ends = origins.select("origin_db", "tip_hash", "followed")
    unmet = loose.join(ends, "origin_db").where(~(F.col("previous_event_hash").eqNullSafe(F.col("tip_hash")) & ~F.col("followed")))
    split = unmet.select("origin_db", "previous_event_hash").distinct()
    mates = None
    if f.index and not split.isEmpty():
        on = (F.col("origin_db") == F.col("s_db")) & F.col("previous_event_hash").eqNullSafe(F.col("s_prev"))
        mates = old.join(split.select(F.col("origin_db").alias("s_db"), F.col("previous_event_hash").alias("s_prev")), on, "left_semi")
    # Events that waited for one of these are its successors too.
    late = waited.where(seq <= f.through).join(hashes(held.where("fresh"), "sealed_hash"), "previous_event_hash", "left_semi").select("sequence_number", "event_id", "origin_db", "origin_position", "previous_event_hash")
    successors = new.select(*late.columns).unionByName(late)
    if mates is not None:
        successors = successors.unionByName(mates.select(*late.columns)).distinct()
    found.append(chain.fork_points(successors).where(seq > f.through))

    # Parents: in the stretch, an aggregate's last eligible version, or further back.
    named = chain.named_parents(new)
    own = named.join(new.select(F.col("event_id").alias("parent_id")), "parent_id", "left_anti").join(versions.select(F.col("event_id").alias("parent_id")), "parent_id", "left_anti")
    version_rows = versions.select("event_id", "sealed_hash", "aggregate_id", F.struct(F.lit("version").alias("kind"), F.lit(True).alias("eligible")).alias("causal"))
    columns = ["event_id", "sealed_hash", "aggregate_id", F.struct("causal.kind", "causal.eligible").alias("causal")]
    parents = new.select(*columns).unionByName(version_rows)
    if f.index and not own.isEmpty():
        parents = parents.unionByName(old.join(own.select(F.col("parent_id").alias("event_id")).distinct(), "event_id", "left_semi").select(*columns)).distinct()
    every = _rows_like(named, waits).unionByName(waiting.where("parent_id is not null"))
    found.append(chain.judged_parents(every, parents))
    still.append(every.join(parents.select(F.col("event_id").alias("parent_id")).distinct(), "parent_id", "left_anti"))

    # Stamping goes on from the versions of the aggregates that the stretch touches.
    touched = versions.join(new.select("aggregate_id").distinct(), "aggregate_id", "left_semi")
    before = touched.select("*", F.from_json(F.lit('{"kind":"version","eligible":true,"parents":[]}'), _CAUSAL).alias("causal"))
    mine = F.coalesce(F.col("held_as_authored_by") == holder, F.lit(False))
    found.append(chain.parents_not_stamped(new.unionByName(before, allowMissingColumns=True), mine).where(seq > f.through))

    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    after = Frontier(f.folder, stop, f.last_position, f.last_hash, [*f.index, name], list(f.versions), [*f.found, f.write(out, _FINDING, "found")])
    after.waiting = f.write(still[0].select(*waits).unionByName(still[1].select(*waits)), _WAITING, "waiting")
    top = new.where("origin_db is not null").groupBy("origin_db").agg(F.max("origin_position").alias("max_position"), F.max_by("sealed_hash", "origin_position").alias("tip_hash")).withColumn("followed", F.lit(False))
    ahead = written(origins.unionByName(top).groupBy("origin_db").agg(F.max_by(F.struct("max_position", "tip_hash", "followed"), "max_position").alias("o")).select("origin_db", "o.*"))
    follow = refs.select("origin_db", F.col("previous_event_hash").alias("tip_hash")).unionByName(waited.select("origin_db", F.col("previous_event_hash").alias("tip_hash")))
    follow = follow.join(ahead, ["origin_db", "tip_hash"], "left_semi").distinct().withColumn("is_followed", F.lit(True))
    after.origins = f.write(ahead.join(follow, ["origin_db", "tip_hash"], "left").withColumn("followed", F.col("followed") | F.coalesce("is_followed", F.lit(False))), _ORIGIN, "origins")
    eligible = new.where("causal.kind = 'version' and causal.eligible").groupBy("aggregate_id").agg(F.max_by(F.struct("sequence_number", "event_id", "sealed_hash"), "sequence_number").alias("v")).select("aggregate_id", "v.*")
    after.versions.append(f.write(eligible, _VERSION, "versions"))
    if len(after.versions) >= MERGE:
        merged = after.read(spark, after.versions, _VERSION).groupBy("aggregate_id").agg(F.max_by(F.struct("sequence_number", "event_id", "sealed_hash"), "sequence_number").alias("v")).select("aggregate_id", "v.*")
        after.versions = [f.write(merged, _VERSION, "versions")]
    last = new.agg(F.max("sequence_number").alias("p"), F.max_by("event_hash", "sequence_number").alias("h")).first()
    if last.p is not None:
        after.last_position, after.last_hash = last.p, last.h
    return after


def verify_through(
    log: DataFrame, *, holder: str, through: int = 0, step: int = 1_000_000, expected_hash: Column | None = None, frontier: Frontier | None = None
) -> tuple[int, DataFrame | None, Frontier]:
    """Verify on in stretches of ``step``: the last position found valid, the findings that ended the walk, and the frontier for the next call.

    The head is fixed at the start. A walk goes on from ``frontier``; without one, what lies up to ``through`` is taken in as
    verified first, in one stretch. Own predecessors that aren't held end a walk at the head only, as a later event may be the one.
    """
    spark = log.sparkSession
    head = log.agg(F.max("sequence_number")).first()[0] or 0
    if frontier is None:
        frontier = Frontier(scratch_dir(spark, "frontier"))
        if through:
            frontier = advance(log, frontier, through, holder=holder, expected_hash=expected_hash)
            frontier.found = []
    while frontier.through < head:
        after = advance(log, frontier, min(head, frontier.through + step), holder=holder, expected_hash=expected_hash)
        new = after.read(spark, after.found[len(frontier.found) :], _FINDING) if after.through < head else after.findings(spark, holder)
        if not new.isEmpty():
            return frontier.through, new.orderBy("sequence_number", "kind", "event_id"), after
        frontier = after
    return frontier.through, None, frontier

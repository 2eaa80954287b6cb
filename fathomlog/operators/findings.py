"""Security findings: identity, kinds, and the marks they put on aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomlog.functions.canonical_json import content_hash
from fathomlog.sources.scratch import written

# Who detects, and what a finding's evidence holds by kind.
ROLES = ("ingest", "restore", "sender", "walk", "fold")
EVIDENCE = {
    "undeclared_event_type": ("event_id", "entry_type", "event_type", "origin_database_id"),
    "fork_unrecorded": ("database_id", "previous_event_hash"),
    "position_reused": ("database_id", "origin_sequence_number"),
    "hash_mismatch": ("event_id", "carried_hash", "recomputed_hash"),
    "predecessor_break": ("database_id", "event_hash", "previous_event_hash"),
    "identity_mismatch": ("event_id", "held_hash", "record"),
    "event_malformed": ("reason", "record"),
    "delivery_hash_mismatch": ("channel", "delivery_number", "carried_hash", "recomputed_hash"),
    "own_event_ingested": ("event_id", "sealed_hash", "record"),
    "foreign_event": ("channel", "delivery_number", "event_id", "sealed_hash"),
    "channel_unexplained": ("channel", "sender_record", "receiver_record", "recorded_receiver_database_id", "responding_receiver_database_id"),
    "sender_regressed": ("channel", "sender_record", "receiver_record", "recorded_receiver_database_id", "responding_receiver_database_id"),
    "restore_unverified": ("channel", "delivery_number", "event_id", "check"),
    "succession_ahead": ("channel", "receiver_record", "succession_record"),
    "storage_link_break": ("local_sequence_number", "event_id", "field", "expected", "actual"),
    "sequence_missing": ("local_sequence_number",),
    "parent_invalid": ("local_sequence_number", "event_id", "parent", "reason"),
    "parents_not_stamped": ("local_sequence_number", "event_id", "expected", "actual"),
    "fold_failed": ("view", "definition_fingerprint", "event_id", "sealed_hash", "reason"),
}
CLOSED = {
    ("event_malformed", "reason"): ("record_malformed", "unstorable_character", "reserved_type_undeclared", "audit_identity_invalid"),
    ("restore_unverified", "check"): ("delivery_link", "delivery_hash", "originator", "receiver_entry"),
    ("storage_link_break", "field"): ("ingest_sequence_number", "previous_ingest_hash"),
    ("parent_invalid", "reason"): ("other_aggregate", "annotation", "ineligible", "held_under_other_hash"),
    ("fold_failed", "reason"): ("promoter_failed", "row_key_failed", "row_data_failed", "derived_field_failed", "row_write_failed"),
}
#: Kinds that mark by an origin's position rather than by the event they name.
THRESHOLD_KINDS = ("position_reused", "fork_unrecorded")


def finding_id(database_id: str, role: str, kind: str, evidence: dict) -> str:
    """A finding is recorded once per detector: its id is the hash of what it says."""
    if role not in ROLES:
        raise ValueError(f"no detector role {role}")
    return content_hash({"database_id": database_id, "role": role, "kind": kind, "evidence": evidence})


def valid_evidence(kind: str = "kind", evidence: str = "evidence") -> Column:
    """Whether a finding's evidence (JSON) has exactly its kind's keys, and only known values where they are closed."""
    keys = F.array_sort(F.json_object_keys(evidence))
    ok = F.lit(False)
    for name, fields in EVIDENCE.items():
        own = keys == F.array(*(F.lit(f) for f in sorted(fields)))
        for (of, field), values in CLOSED.items():
            if of == name:
                own &= F.coalesce(F.get_json_object(evidence, f"$.{field}").isin(*values), F.lit(False))
        ok = F.when(F.col(kind) == name, own).otherwise(ok)
    return F.coalesce(ok, F.lit(False))


def fold_findings(failures: DataFrame, log: DataFrame, view: str, fingerprint: str) -> DataFrame:
    """(kind, evidence) of what a fold skipped; a failure on a finding about a failed fold makes none.

    failures: (sequence_number, reason); log: with entry_type, data, event_id and sealed_hash.
    """
    skipped = failures.where("reason is not null").select("sequence_number", "reason").join(log, "sequence_number")
    about_fold = (F.col("entry_type") == "system.security_finding") & (F.get_json_object("data", "$.kind") == "fold_failed")
    evidence = F.to_json(F.struct(F.lit(view).alias("view"), F.lit(fingerprint).alias("definition_fingerprint"), F.col("event_id").cast("string").alias("event_id"), "sealed_hash", "reason"))
    return skipped.where(~F.coalesce(about_fold, F.lit(False))).select(F.lit("fold_failed").alias("kind"), evidence.alias("evidence"))


def new_findings(found: DataFrame, held: DataFrame) -> DataFrame:
    """Findings whose id isn't held yet, each once."""
    return found.dropDuplicates(["finding_id"]).join(held.select("finding_id"), "finding_id", "left_anti")


def authorship(log: DataFrame) -> DataFrame:
    """(aggregate_id, origin_db, max_position): the last position at which an origin wrote each aggregate."""
    return log.groupBy("aggregate_id", "origin_db").agg(F.max("origin_position").alias("max_position"))


def lowest_fork(log: DataFrame) -> DataFrame:
    """(origin_db, previous_event_hash, lowest_position) for every predecessor, nothing included."""
    return log.groupBy("origin_db", "previous_event_hash").agg(F.min("origin_position").alias("lowest_position"))


def _stretches(through: Column) -> Column:
    """Positions 0 to ``through`` as stretches (level, place), each 2**level long and beginning at a multiple of that."""
    stop = through + F.lit(1)
    levels = F.filter(F.sequence(F.lit(0), F.lit(62)), lambda k: F.call_function("getbit", stop, k) == 1)
    return F.transform(levels, lambda k: F.struct(k.alias("level"), (F.call_function("shiftright", stop, k) - 1).alias("place")))


def mark_rows(findings: DataFrame, authors: DataFrame, members: DataFrame) -> DataFrame:
    """(aggregate_id, finding_id), each once: see ``marks``.

    A threshold meets the positions that reach it in an equi-join: the positions up to an aggregate's last are some stretches of
    a power of two, of which exactly one holds the threshold. So rows are made in proportion to marks, and no
    origin's findings or aggregates come together in one row. Aggregates of origins without findings are left out first.
    """
    by_position = F.col("kind").isin(*THRESHOLD_KINDS)
    wrote = authors.select("aggregate_id", F.col("origin_db").alias("member"), F.col("max_position").cast("long").alias("max_position"))
    own = lambda rows: wrote.join(rows.select("member").distinct(), "member", "left_semi")
    named = findings.where(~by_position).select("finding_id", "origin_db", "aggregate_id").join(members, "origin_db").select("finding_id", "aggregate_id", "member")
    named = named.join(own(named).select("aggregate_id", "member"), ["aggregate_id", "member"]).select("aggregate_id", "finding_id")
    from_zero = F.greatest(F.lit(0).cast("long"), F.col("threshold").cast("long"))
    placed = F.transform(F.sequence(F.lit(0), F.lit(62)), lambda k: F.struct(k.alias("level"), F.call_function("shiftright", from_zero, k).alias("place")))
    thresholds = findings.where(by_position & F.col("threshold").isNotNull()).select("finding_id", F.col("origin_db").alias("member"), F.explode(placed).alias("s"))
    reached = own(thresholds).where("max_position >= 0").select("aggregate_id", "member", F.explode(_stretches(F.col("max_position"))).alias("s"))
    return named.union(reached.join(thresholds, ["member", "s"]).select("aggregate_id", "finding_id")).distinct()


def marks(findings: DataFrame, authors: DataFrame, lineage: DataFrame | None = None) -> DataFrame:
    """(aggregate_id, finding_ids): sorted ids of the findings that mark each aggregate.

    findings: (finding_id, kind, origin_db, aggregate_id, threshold). A finding that names an aggregate
    marks it if its origin, or one of the origin's lineage, wrote some event of it; a reused position or
    a fork marks every aggregate that its origin wrote at the threshold or later.
    lineage: (origin_db, member), each origin being a member of its own.
    """
    members = lineage if lineage is not None else authors.select("origin_db", F.col("origin_db").alias("member")).distinct()
    return mark_rows(findings, authors, members).groupBy("aggregate_id").agg(F.array_sort(F.collect_list("finding_id")).alias("finding_ids"))


def added_marks(held: DataFrame, *, findings: DataFrame, new_findings: DataFrame, authors: DataFrame, new_authors: DataFrame, members: DataFrame, new_members: DataFrame) -> DataFrame:
    """(aggregate_id, finding_id) that arrivals add to the marks ``held``; marks never go.

    Only what is new is looked at: new findings; findings held of aggregates that were written further (``new_authors``); and
    findings held of origins that got members (``new_members``). ``findings`` are those held before, ``authors`` and ``members`` as of now.
    """
    added = mark_rows(new_findings, authors, members).union(mark_rows(findings, new_authors, members))
    # Members matter to findings that name an aggregate alone.
    by_member = mark_rows(findings.where(~F.col("kind").isin(*THRESHOLD_KINDS)), authors, new_members)
    return added.union(by_member).distinct().join(held, ["aggregate_id", "finding_id"], "left_anti")


def with_marks(view_rows: DataFrame, marked: DataFrame, key: str = "aggregate_id") -> DataFrame:
    """View rows with their marks, joined when read so that findings never rewrite rows."""
    return view_rows.join(marked, key, "left").withColumn("finding_ids", F.coalesce("finding_ids", F.array().cast("array<string>")))


def lineage(successions: DataFrame, origin: str = "origin_db", predecessor: str = "predecessor", position: str = "sequence_number") -> DataFrame:
    """(origin_db, member): every origin with itself and all its predecessors, cycles ending where they close.

    The last succession of an origin counts. Rounds double the distance that is covered, so a
    line of n successions takes about log2(n) joins.
    """
    last = successions.groupBy(F.col(origin).alias("origin_db")).agg(F.max_by(predecessor, position).alias("member")).where("member is not null")
    every = successions.select(F.col(origin).alias("origin_db")).union(successions.select(F.col(predecessor).alias("origin_db"))).where("origin_db is not null").distinct()
    reach = every.select("origin_db", F.col("origin_db").alias("member")).union(last.select("origin_db", "member")).distinct()
    size, before = reach.count(), -1
    while size != before:
        onward = reach.select(F.col("origin_db").alias("member"), F.col("member").alias("next"))
        reach = written(reach.join(onward, "member").select("origin_db", F.col("next").alias("member")).distinct())
        before, size = size, reach.count()
    return reach

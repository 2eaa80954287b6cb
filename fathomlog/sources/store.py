"""A log and its views as Parquet folders under one manifest.

Each commit writes new folders and then one small JSON manifest, ``manifest-<version>``, which
names all folders that count. Readers pin a version and so see log and views of one
moment; one writer at a time, which checks that its version is the next. Files go through Spark,
so any store that Spark writes will do.

A view's copy is dealt into buckets by a hash of its row keys. A catch-up writes a delta: the rows
that its events touched, and tombstones for those that are gone, in the buckets that they belong to. Reads merge
the deltas into the base; a bucket whose deltas have grown is compacted, alone. So what a catch-up writes
follows from what its events touch, not from the size of the view.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomlog.operators.folds import ROWS, asked_operations, fold, fold_operations
from fathomlog.operators.frontier import Frontier, advance
from fathomlog.plans.promotion import Promotions
from fathomlog.plans.specs import AggregateView, TableView, view_fingerprint
from fathomlog.sources.event_log import with_positions
from fathomlog.sources.scratch import written


#: Rows of a bucket of a view's copy, and buckets at most.
BUCKET_ROWS, MOST_BUCKETS = 1_000_000, 10_000
#: Deltas of a bucket, and their rows, beyond which it is compacted.
MOST_DELTAS, COMPACT_ROWS = 16, 1000


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("row_key"), F.lit(buckets)).cast("int")


def _folders(held: dict) -> list[str]:
    return [held["folder"]] if "folder" in held else sorted(Copy(**held["copy"]).folders())


@dataclass
class Manifest:
    version: int = 0
    head: int = 0
    #: Folder, and the positions in it, of each append.
    log: list[dict] = field(default_factory=list)
    #: By view: fingerprint, position, and its copy (``Copy`` as a dict). Older manifests name one folder instead.
    views: dict[str, dict] = field(default_factory=dict)
    #: Copies that no definition leads to any more.
    marked: list[str] = field(default_factory=list)
    state: dict[str, Any] = field(default_factory=dict)


@dataclass
class Copy:
    """Where the rows of a view lie.

    bases: by bucket its folder, the number of its rows, and the last delta that it includes. deltas: in order, each with
    its number, folder and rows by bucket. failures: folders of events that couldn't be folded.
    """

    buckets: int
    bases: dict[str, dict] = field(default_factory=dict)
    deltas: list[dict] = field(default_factory=list)
    failures: list[str] = field(default_factory=list)
    made: int = 0
    #: The last delta, which subscribers are told of, compacted or not.
    latest: dict | None = None

    def pending(self, bucket: str) -> list[dict]:
        """The deltas that a bucket's base doesn't include."""
        through = self.bases[bucket]["through"] if bucket in self.bases else 0
        return [d for d in self.deltas if d["number"] > through and bucket in d["rows"]]

    def folders(self) -> set[str]:
        last = {self.latest["folder"]} if self.latest else set()
        return {b["folder"] for b in self.bases.values()} | {d["folder"] for d in self.deltas} | set(self.failures) | last


class Conflict(Exception):
    """Another writer committed first."""


class LogStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._conf = spark._jsc.hadoopConfiguration()

    def _file(self, name: str):
        target = self._hadoop.Path(f"{self.path}/{name}")
        return target.getFileSystem(self._conf), target

    def manifest(self, version: int | None = None) -> Manifest:
        """The latest manifest, or that of a version."""
        files, folder = self._file("")
        if version is None:
            if not files.exists(folder):
                return Manifest()
            names = [s.getPath().getName() for s in files.listStatus(folder)]
            version = max((int(n.removeprefix("manifest-")) for n in names if n.startswith("manifest-")), default=0)
            if not version:
                return Manifest()
        text = "".join(r.value for r in self.spark.read.text(f"{self.path}/manifest-{version}", wholetext=True).collect())
        return Manifest(**json.loads(text))

    def commit(self, after: Manifest) -> Manifest:
        """Make ``after`` the next version; fails if there is one already."""
        after.version += 1
        files, target = self._file(f"manifest-{after.version}")
        draft = files, self._hadoop.Path(f"{self.path}/.draft-{uuid.uuid4().hex}")
        out = draft[0].create(draft[1], False)
        out.write(json.dumps(after.__dict__).encode())
        out.close()
        # A rename onto an existing file is refused, which settles who was first.
        if files.exists(target) or not files.rename(draft[1], target):
            files.delete(draft[1], False)
            raise Conflict(f"version {after.version} is there already")
        return after

    def log(self, at: Manifest | None = None, *, after: int = 0, through: int | None = None) -> DataFrame:
        """The events in (after, through], read from the appends that reach into it."""
        at = at or self.manifest()
        if not at.log:
            raise ValueError("the log is empty")
        within = [x for x in at.log if x["last"] > after and (through is None or x["first"] <= through)]
        rows = self.spark.read.parquet(*(f"{self.path}/{x['folder']}" for x in within or at.log[-1:]))
        if after:
            rows = rows.where(F.col("sequence_number") > after)
        return rows if through is None else rows.where(F.col("sequence_number") <= through)

    def append(self, rows: DataFrame, ts: str = "client_timestamp", tie: str = "event_id") -> Manifest:
        """Append rows in the order of (ts, tie) after all that is held."""
        at = self.manifest()
        folder = f"log/{uuid.uuid4().hex}"
        # Numbering reads its rows twice, dealing them out by ranges once more.
        placed = with_positions(written(rows), ts, tie, base=at.head)
        # In the order of positions, so that a range of them is a few row groups; filters tell which hold an id.
        writer = placed.repartitionByRange("sequence_number").sortWithinPartitions("sequence_number").write
        for c in ("event_id", "aggregate_id"):
            writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
        writer.parquet(f"{self.path}/{folder}")
        last = self.spark.read.parquet(f"{self.path}/{folder}").agg(F.max("sequence_number")).first()[0]
        if last is None:
            return at
        at.log.append({"folder": folder, "first": at.head + 1, "last": last})
        at.head = last
        return self.commit(at)

    def _own(self, at: Manifest, view, versions: dict, promotions: list) -> dict | None:
        held = at.views.get(view.name)
        return held if held and held["fingerprint"] == view_fingerprint(view, versions, promotions) else None

    def _rows(self, copy: Copy, buckets: list[str] | None = None) -> DataFrame:
        """The rows (without failures) of these buckets: of each key what the last delta says, or else the base.

        A folder of buckets is read by the buckets' own paths, so others aren't touched.
        """
        every = {str(b) for b in range(copy.buckets)} if buckets is None else set(buckets)
        paths = [f"{self.path}/{copy.bases[b]['folder']}/bucket={b}" for b in every if b in copy.bases]
        base = self.spark.read.schema(ROWS).parquet(*paths) if paths else self.spark.createDataFrame([], ROWS)
        changed = [f"{self.path}/{d['folder']}/bucket={b}" for b in every for d in copy.pending(b)]
        if not changed:
            return base
        deltas = self.spark.read.schema(f"{ROWS}, number long").parquet(*changed)
        columns = [c for c in base.columns if c != "row_key"]
        last = deltas.groupBy("row_key").agg(F.max_by(F.struct(*columns), "number").alias("r")).select("row_key", "r.*")
        return base.join(last.select("row_key"), "row_key", "left_anti").unionByName(last.where("row_json is not null"))

    def _write_buckets(self, rows: DataFrame, copy: Copy, folder: str) -> dict[str, int]:
        """Write rows under ``folder``, a file to a bucket, and count them by bucket."""
        dealt = rows.withColumn("bucket", _bucket(copy.buckets))
        dealt.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/{folder}")
        files, target = self._file(folder)
        if not any(s.getPath().getName().startswith("bucket=") for s in files.listStatus(target)):
            return {}
        return {str(r.bucket): r["count"] for r in self.spark.read.parquet(f"{self.path}/{folder}").groupBy("bucket").count().collect()}  # buckets

    def view(self, name: str, at: Manifest | None = None) -> tuple[DataFrame, int]:
        """Rows of a view's copy, its failures among them, and the position they stand at."""
        held = (at or self.manifest()).views[name]
        if "folder" in held:
            return self.spark.read.parquet(f"{self.path}/{held['folder']}"), held["position"]
        copy = Copy(**held["copy"])
        rows = self._rows(copy)
        if copy.failures:
            rows = rows.unionByName(self.spark.read.schema(ROWS).parquet(*(f"{self.path}/{f}" for f in copy.failures)))
        return rows, held["position"]

    def _built(self, result: DataFrame, name: str, buckets: int | None) -> Copy:
        """A copy whose bases are all rows of ``result``."""
        result = written(result)
        n = result.where("row_json is not null").count()
        copy = Copy(buckets or min(MOST_BUCKETS, max(1, -(-n // BUCKET_ROWS))))
        folder = f"views/{name}/{uuid.uuid4().hex}"
        counts = self._write_buckets(result.where("row_json is not null"), copy, folder)
        copy.bases = {b: {"folder": folder, "rows": k, "through": 0} for b, k in counts.items()}
        return self._with_failures(copy, result, name)

    def _with_failures(self, copy: Copy, result: DataFrame, name: str) -> Copy:
        failed = result.where("row_json is null and reason is not null")
        if not failed.isEmpty():
            folder = f"views/{name}/{uuid.uuid4().hex}"
            failed.write.parquet(f"{self.path}/{folder}")
            copy.failures.append(folder)
        return copy

    def catch_up(
        self, view: AggregateView | TableView, *, promotions: Promotions | None = None, declared: dict | None = None, described: list | None = None, buckets: int | None = None
    ) -> Manifest:
        """Bring a view to the head of the log.

        Only events past the copy's position are read, and they are folded on from the rows of the keys that they
        touch, for which only those keys' buckets are read; what changes is written as a delta. A copy of another definition is
        marked and rebuilt, in ``buckets`` parts or as many as its rows ask for. Failures are kept beside the rows.
        """
        at = self.manifest()
        versions, described = declared or {}, described or []
        held = self._own(at, view, versions, described)
        if held and held["position"] == at.head:
            return at
        if view.name in at.views and not held:
            at.marked += _folders(at.views[view.name])
        if not held:
            copy = self._built(fold(self.log(at), view, promotions, declared), view.name, buckets)
        else:
            if "folder" in held:  # of an older manifest
                copy = self._built(self.view(view.name, at)[0], view.name, buckets)
                at.marked.append(held["folder"])
            else:
                copy = Copy(**held["copy"])
            before = copy.folders()
            self._fold_on(copy, self.log(at, after=held["position"]), view, promotions, declared)
            at.marked += sorted(before - copy.folders())
        at.views[view.name] = {"fingerprint": view_fingerprint(view, versions, described), "position": at.head, "copy": asdict(copy)}
        return self.commit(at)

    def _fold_on(self, copy: Copy, fresh: DataFrame, view: AggregateView | TableView, promotions: Promotions | None, declared: dict | None) -> None:
        """Add to ``copy`` the delta that these events make, and compact the buckets that have had enough of them."""
        if isinstance(view, AggregateView):
            asked = None
            keys = fresh.where(view.interest.condition(fresh)).select(F.col("aggregate_id").cast("string").alias("row_key"))
        else:
            asked = written(asked_operations(fresh, view, promotions, declared))
            keys = asked.where("row_key is not null").select("row_key")
        touched = written(keys.distinct())
        own = [str(r[0]) for r in touched.select(_bucket(copy.buckets).alias("b")).distinct().collect()]  # buckets
        rows = written(self._rows(copy, own).join(touched, "row_key", "left_semi"))
        after = written(fold(fresh, view, promotions, declared, rows) if asked is None else fold_operations(asked, view, rows))
        alive = after.where("row_json is not null")
        gone = rows.join(alive, "row_key", "left_anti").select("row_key", *(F.lit(None).cast(t).alias(n) for n, t in (x.split() for x in ROWS.split(", ")[1:])))
        self._with_failures(copy, after, view.name)
        copy.made += 1
        folder = f"views/{view.name}/{uuid.uuid4().hex}"
        counts = self._write_buckets(alive.unionByName(gone).withColumn("number", F.lit(copy.made).cast("long")), copy, folder)
        if counts:
            copy.deltas.append({"number": copy.made, "folder": folder, "rows": counts})
            copy.latest = {"number": copy.made, "folder": folder}
        self._compact(copy, view.name)

    def _compact(self, copy: Copy, name: str) -> None:
        """Write anew each bucket whose deltas are many, or have half as many rows as its base."""
        grown = []
        for b in {b for d in copy.deltas for b in d["rows"]}:
            pending = copy.pending(b)
            base = copy.bases[b]["rows"] if b in copy.bases else 0
            if len(pending) > MOST_DELTAS or sum(d["rows"][b] for d in pending) > max(COMPACT_ROWS, base // 2):
                grown.append(b)
        if not grown:
            return
        folder = f"views/{name}/{uuid.uuid4().hex}"
        counts = self._write_buckets(self._rows(copy, grown), copy, folder)
        for b in grown:
            if b in counts:
                copy.bases[b] = {"folder": folder, "rows": counts[b], "through": copy.made}
            else:
                copy.bases.pop(b, None)
                for d in copy.deltas:
                    d["rows"].pop(b, None)
        copy.deltas = [d for d in copy.deltas if any(d in copy.pending(b) for b in d["rows"])]

    def rebuild(self, view: AggregateView | TableView, **arguments) -> Manifest:
        """Refold from the start; the old copy is marked."""
        at = self.manifest()
        if held := at.views.pop(view.name, None):
            at.marked += _folders(held)
            self.commit(at)
        return self.catch_up(view, **arguments)

    def delete_marked(self) -> Manifest:
        """Delete the folders of marked copies."""
        at = self.manifest()
        for folder in at.marked:
            files, target = self._file(folder)
            files.delete(target, True)
        at.marked = []
        return self.commit(at)

    def verify(self, *, holder: str, expected_hash: Column | None = None, stop: int | None = None) -> int:
        """Check the log's chains on from where the last call stopped, up to ``stop`` or the head; the position reached. Each event is read once."""
        at = self.manifest()
        frontier = Frontier(**at.state["frontier"]) if "frontier" in at.state else Frontier(f"{self.path}/frontier")
        stop = at.head if stop is None else min(stop, at.head)
        if stop > frontier.through:
            frontier = advance(self.log(at, after=frontier.through, through=stop), frontier, stop, holder=holder, expected_hash=expected_hash)
            at.state["frontier"] = frontier.as_dict()
            self.commit(at)
        return frontier.through

    def findings(self, holder: str, at: Manifest | None = None) -> DataFrame:
        """What ``verify`` has found so far."""
        return Frontier(**(at or self.manifest()).state["frontier"]).findings(self.spark, holder)

    def progress(self, name: str) -> dict:
        at = self.manifest()
        held = at.views.get(name)
        return {"position": held["position"] if held else 0, "head": at.head, "current": bool(held) and held["position"] == at.head}

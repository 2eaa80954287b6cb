"""Removal of byte strings that occur more than once, by suffix arrays.

A byte goes if a window of ``length`` bytes covers it whose content also starts
anywhere else, in the same document or another. Matches are found in four steps:

1. Candidates. Every window has one anchor: the k-gram of it with the smallest hash,
   the leftmost of equals. Equal windows have equal anchors at equal places, so a window
   whose anchor's hash occurs once in the corpus is unique. A run of consecutive windows
   with one anchor is a *slice*; only slices (hashes and places) are shuffled, about one
   to 76 bytes, and those with an anchor of their own are done.
2. Copies. Slices with the same content are counted, not listed: a passage held by a third
   of all documents becomes one row per task. All windows of a repeated slice repeat.
3. Suffix arrays. Different slices under one anchor come together in a shard. Each shard
   sorts its suffixes by Larsson-Sadakane refinement in numpy and takes common prefixes by Kasai's
   walk, stepped for all slices at once; windows whose neighbour shares ``length`` bytes repeat.
4. Cross-shard merging. An anchor with more than ``SHARD_SLICES`` different slices is dealt
   over several shards; their sorted runs of window digests (two 64-bit hashes) are cut
   into ranges and merged by binary search, so no shard grows with an anchor's frequency.

Defined results: a null text is empty; texts shorter than ``length`` stay whole; repeated
rows are occurrences of each other; null ids are allowed; an empty table gives an empty
result; other columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomlog.llm.common import discard, free_names, materialize, released, scratch_scope, slices, unpack, with_packed_text

LENGTH = 200
KGRAM = 50
#: Bytes hashed at once, and the places that a key can hold beside 40 bits of hash.
BLOCK, PLACE_BITS = 1 << 19, 24
#: Different slices of one anchor that a shard takes.
SHARD_SLICES = 4096
#: Bytes of slices sorted at once.
SHARD_BYTES = 1 << 20

_rng = np.random.default_rng(7)
_BYTES = _rng.integers(1, 2**63, (2, 256), np.uint64) | np.uint64(1)
_BASE = (0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1)
_powers: dict[int, tuple[np.ndarray, ...]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, ...]:
    """For both bases, powers and inverse powers modulo 2**64, n of each at least."""
    if not _powers or len(_powers[0][0]) < n:
        made = []
        for base in _BASE:
            for x in (base, pow(base, -1, 1 << 64)):
                steps = np.full(n, x, np.uint64)
                steps[0] = 1
                made.append(np.cumprod(steps))
        _powers[0] = tuple(made)
    return _powers[0]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


class Hashes:
    """Rolling hashes of a byte array: of any k-gram, and of any substring in two bases."""

    def __init__(self, data: np.ndarray):
        tables = _power_tables(max(len(data), BLOCK) + 1)
        self.inverse = tables[1], tables[3]
        self.sums = []
        for k in (0, 1):
            total = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(_BYTES[k][data] * tables[2 * k][: len(data)], out=total[1:])
            self.sums.append(total)

    def of(self, k: int, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return _mix((self.sums[k][stop] - self.sums[k][start]) * self.inverse[k][start])

    def grams(self, n: int) -> np.ndarray:
        total = self.sums[0]
        return _mix((total[n:] - total[:-n]) * self.inverse[0][: len(total) - n])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive entries."""
    span = 1
    while 2 * span <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (width - span)], x[width - span :]) if span < width else x


def slices_of(data: np.ndarray, bounds: np.ndarray, length: int, kgram: int) -> tuple[np.ndarray, ...]:
    """(first window, windows, anchor hash, content hash) of the slices of documents laid end to end.

    bounds: where documents begin, and the end of the last.
    """
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, none
    hashes = Hashes(data)
    grams = hashes.grams(kgram)
    place = np.uint64((1 << PLACE_BITS) - 1)
    keys = (grams & ~place) | np.arange(len(grams), dtype=np.uint64)
    anchors = (sliding_min(keys, length - kgram + 1) & place).astype(np.int64)
    inside = np.zeros(len(anchors) + 1, np.int32)
    begin, stop = bounds[:-1], bounds[1:] - length + 1
    real = stop > begin
    np.add.at(inside, begin[real], 1)
    np.add.at(inside, stop[real], -1)
    inside = np.cumsum(inside[:-1]) > 0
    change = np.ones(len(anchors), bool)
    change[1:] = (anchors[1:] != anchors[:-1]) | ~inside[:-1]
    first = np.flatnonzero(inside & change)
    closing = np.ones(len(anchors), bool)
    closing[:-1] = change[1:] | ~inside[1:]
    count = np.flatnonzero(inside & closing) + 1 - first
    at = anchors[first]
    end = first + count - 1 + length
    content = hashes.of(0, first, end) * np.uint64(3) + hashes.of(1, first, end) + (count * 1024 + at - first).astype(np.uint64)
    return first, count, grams[at].view(np.int64), _mix(content).view(np.int64)


def _blocks(texts: list[bytes], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]]:
    """(bytes, bounds, (document, offset) of each part): whole documents together, long ones in overlapping parts."""
    held, size, origin = [], 0, []
    for i, text in enumerate(texts):
        for offset in range(0, max(1, len(text) - length + 1), BLOCK - length):
            part = text[offset : offset + BLOCK - 1]
            if held and size + len(part) > BLOCK:
                yield np.frombuffer(b"".join(held), np.uint8), np.cumsum([0, *map(len, held)]), origin
                held, size, origin = [], 0, []
            held.append(part)
            origin.append((i, offset))
            size += len(part)
    if held:
        yield np.frombuffer(b"".join(held), np.uint8), np.cumsum([0, *map(len, held)]), origin


def _documents(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, th, text): a row is told apart by its id and its text's hash."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return df.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("th"), text.alias("text"))


def candidate_slices(docs: DataFrame, length: int, kgram: int) -> DataFrame:
    """(id, th, fp, h, s0, ns) of every slice of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts = [x.encode() for x in batch.column("text").to_pylist()]
            for data, bounds, origin in _blocks(texts, length):
                first, count, fp, h = slices_of(data, bounds, length, kgram)
                if not len(first):
                    continue
                part = np.searchsorted(bounds, first, "right") - 1
                # A part's last windows belong to the next part of its document, if there is one.
                rows = np.array([i for i, _ in origin])[part]
                s0 = first - bounds[part] + np.array([o for _, o in origin])[part]
                take = pa.array(rows)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(take), batch.column("th").take(take), pa.array(fp), pa.array(h), pa.array(s0.astype(np.int64)), pa.array(count.astype(np.int32))],
                    ["id", "th", "fp", "h", "s0", "ns"],
                )

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(released(run), f"id {kind}, th long, fp long, h long, s0 long, ns int")


def fetched_slices(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """(fp, h, ns, bytes, shard, shards) of the slices that ``wanted`` (rid, rth, wanted) lists by document."""
    packed = with_packed_text(docs, "text")
    joined = packed.join(wanted, F.col("id").eqNullSafe(F.col("rid")) & (F.col("th") == F.col("rth"))).select("text", "wanted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("fp", "h", "ns", "bytes", "shard", "shards")
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.int32())
        rows, size = [], 0

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for batch in batches:
            for text, listed in zip(batch.column("text"), batch.column("wanted"), strict=True):
                raw = unpack(text.as_py())
                for w in listed.as_py():
                    cut = raw[w["s0"] : w["s0"] + w["ns"] + length - 1]
                    rows.append((w["fp"], w["h"], w["ns"], cut, w["h"] % w["shards"], w["shards"]))
                    size += len(cut)
                if size > SHARD_BYTES:
                    yield made()
                    rows, size = [], 0
        if rows:
            yield made()

    return joined.mapInArrow(released(run), "fp long, h long, ns int, bytes binary, shard int, shards int")


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Sorted suffixes of ``text`` (symbols under 512).

    Larsson-Sadakane: sorted by 7 symbols first; then only groups that are still tied are sorted
    again, by the rank of the suffix that follows the sorted part, which doubles it. Places and ranks
    take 4 bytes each: a task's memory is that of a shard's arrays.
    """
    n = len(text)
    padded = np.concatenate((text.astype(np.int16), np.zeros(8, np.int16)))
    key = np.zeros(n, np.int64)
    for k in range(7):
        key <<= 9
        key |= padded[k : k + n]
    sa = np.argsort(key, kind="stable").astype(np.int32)
    ranks = np.zeros(n + 1, np.int32)  # a group's rank is its first place, from 1; 0 is past the end

    def name(places: np.ndarray, fresh: np.ndarray) -> np.ndarray:
        """Ranks for suffixes at SA places, given where groups begin; those still tied."""
        heads = np.maximum.accumulate(np.where(fresh, places, 0))
        ranks[sa[places]] = heads + 1
        alone = fresh.copy()
        alone[:-1] &= fresh[1:]
        return places[~alone]

    key = key[sa]
    fresh = np.ones(n, bool)
    fresh[1:] = key[1:] != key[:-1]
    del key
    tied = name(np.arange(n, dtype=np.int32), fresh)
    done = 7
    while len(tied):
        group = ranks[sa[tied]]
        after = ranks[np.minimum(sa[tied] + done, n)]
        order = np.lexsort((after, group))
        sa[tied] = sa[tied][order]
        group, after = group[order], after[order]
        fresh = np.ones(len(tied), bool)
        fresh[1:] = (group[1:] != group[:-1]) | (after[1:] != after[:-1])
        tied = name(tied, fresh)
        done *= 2
    return sa


def kasai(text: np.ndarray, sa: np.ndarray, strands: np.ndarray, depth: int) -> np.ndarray:
    """Common prefix of each sorted suffix with the one before it, up to ``depth``.

    Kasai's walk drops one symbol from suffix to suffix and extends from there. It is stepped
    for all strands (stretches of the text, given by their bounds) together.
    """
    n = len(text)
    place = np.empty(n, np.int32)
    place[sa] = np.arange(n, dtype=np.int32)
    padded = np.concatenate((text.astype(np.int16), np.full(depth + 1, -1, np.int16)))
    before = np.full(n, -1, np.int32)
    before[sa[1:]] = sa[:-1]
    lcp = np.zeros(n, np.int32)
    i, stop = strands[:-1].astype(np.int64), strands[1:].astype(np.int64)
    live = i < stop
    i, stop = i[live], stop[live]
    h = np.zeros(len(i), np.int64)
    while len(i):
        j = before[i]
        more = (j >= 0) & (h < depth) & (padded[i + h] == padded[j + h])
        # Symbols past the end differ from every symbol, and the two suffixes end at different places.
        more &= (i + h < n) & (j + h < n)
        settled = ~more
        lcp[place[i[settled]]] = h[settled]
        h = np.where(more, h + 1, np.maximum(h - 1, 0))
        i = i + settled
        live = i < stop
        if not live.all():
            i, stop, h = i[live], stop[live], h[live]
    return lcp


def repeats_in_shard(slices: list[bytes], windows: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, group, slice bounds): the shard's windows by their groups of equal content, in sorted order."""
    sizes = np.fromiter(map(len, slices), np.int64, len(slices))
    bounds = np.concatenate(([0], np.cumsum(sizes + 1)))
    text = np.frombuffer(b"".join(x + b"\0" for x in slices), np.uint8).astype(np.int16) + np.int16(1)
    text[bounds[1:] - 1] = 0
    sa = suffix_array(text)
    group = np.cumsum(kasai(text, sa, bounds, length) < length, dtype=np.int32)
    edges = np.zeros(len(text) + 1, np.int8)
    np.add.at(edges, bounds[:-1], 1)
    np.add.at(edges, bounds[:-1] + windows, -1)
    real = np.cumsum(edges[:-1], dtype=np.int8).astype(bool)[sa]  # begins a window of its slice
    return sa[real], group[real], bounds


def _runs(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, stop) of the runs of consecutive numbers in a sorted array."""
    cut = np.flatnonzero(np.diff(places) != 1)
    return places[np.concatenate(([0], cut + 1))], places[np.concatenate((cut, [len(places) - 1]))] + 1


_VERDICT = "kind string, fp long, h long, a int, b int, shard int, range int, w1 long, w2 long"


def shard_verdicts(slices: DataFrame, length: int) -> DataFrame:
    """Rows of two kinds for slices (fp, h, ns, bytes, shard, shards), sorted by shard in their partition.

    ``run``: windows a to b of a slice repeat within its shard. ``window``: a distinct window of a
    shard whose anchor has several, with its digest; a = b - 1 its place, of shards ``range`` the one that merges it.
    """

    def work(table: pa.Table) -> Iterator[pa.RecordBatch]:
        # Repeated rows list their slices again, next to the first.
        fp, h = table.column("fp").to_numpy(), table.column("h").to_numpy()
        once = np.ones(len(fp), bool)
        once[1:] = (fp[1:] != fp[:-1]) | (h[1:] != h[:-1])
        table = table.filter(pa.array(once))
        fp, h = table.column("fp").to_numpy(), table.column("h").to_numpy()
        shards, shard = table.column("shards").to_numpy(), table.column("shard").to_numpy()
        raw = table.column("bytes").to_pylist()
        position, group, bounds = repeats_in_shard(raw, table.column("ns").to_numpy().astype(np.int64), length)
        if not len(position):
            return
        own = np.searchsorted(bounds, position, "right") - 1
        first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))  # groups stand in order
        count = np.diff(first, append=len(group))
        twice = position[np.repeat(count > 1, count)]
        if len(twice):
            twice = np.sort(twice)
            a, b = _runs(twice)
            at = np.searchsorted(bounds, a, "right") - 1
            n = len(a)
            yield _verdict("run", fp[at], h[at], a - bounds[at], b - bounds[at], np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n))
        spread = first[shards[own[first]] > 1]
        if len(spread):
            at, where = own[spread], position[spread]
            text = np.frombuffer(b"".join(x + b"\0" for x in raw), np.uint8)
            w = [np.zeros(len(where), np.int64) for _ in range(2)]
            for k0 in range(0, len(text), BLOCK - length):  # hashed in blocks
                here = (where >= k0) & (where < k0 + BLOCK - length)
                if here.any():
                    hashes = Hashes(text[k0 : k0 + BLOCK])
                    for k in (0, 1):
                        w[k][here] = hashes.of(k, where[here] - k0, where[here] - k0 + length).view(np.int64)
            ranges = (w[0].view(np.uint64) >> np.uint64(33)).astype(np.int64) * shards[at] >> 31
            yield _verdict("window", fp[at], h[at], where - bounds[at], where - bounds[at] + 1, shard[at], ranges, *w)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, last = 0, None
        for batch in batches:
            keys = list(zip(batch.column("fp").to_pylist(), batch.column("shard").to_pylist(), strict=True))
            sizes = pa.compute.binary_length(batch.column("bytes")).to_pylist()
            start = 0
            for i, key in enumerate(keys):
                if key != last and size > SHARD_BYTES:
                    held.append(batch.slice(start, i - start))
                    yield from work(pa.Table.from_batches(held))
                    held, size, start = [], 0, i
                size, last = size + sizes[i], key
            held.append(batch.slice(start))
        if size:
            yield from work(pa.Table.from_batches(held))

    return slices.mapInArrow(released(run), _VERDICT)


def _verdict(kind: str, *columns: np.ndarray) -> pa.RecordBatch:
    names = [x.split() for x in _VERDICT.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}
    values = [pa.array([kind] * len(columns[0])), *(pa.array(np.asarray(c).astype(np.int64), pa.int64()).cast(kinds[t]) for c, (_, t) in zip(columns, names[1:], strict=True))]
    return pa.RecordBatch.from_arrays(values, [n for n, _ in names])


def merge_shards(windows: DataFrame) -> DataFrame:
    """(fp, h, a, b) of windows that several shards of an anchor hold.

    Each group is one range of digests of one anchor: its shards' sorted runs are merged by binary search.
    """

    def merge(table: pa.Table) -> pa.Table:
        shard = table.column("shard").to_numpy()
        w = table.column("w1").to_numpy(), table.column("w2").to_numpy()
        order = np.lexsort((w[1], w[0], shard))
        cut = np.concatenate(([0], np.flatnonzero(np.diff(shard[order])) + 1, [len(order)]))
        digest = np.empty(len(order), [("x", np.int64), ("y", np.int64)])
        digest["x"], digest["y"] = w[0][order], w[1][order]
        merged = np.unique(digest)
        seen = np.zeros(len(merged), np.int64)
        found = np.empty(len(order), np.int64)
        for lo, hi in zip(cut[:-1], cut[1:], strict=True):  # one sorted run per shard
            found[lo:hi] = np.searchsorted(merged, digest[lo:hi])
            seen[found[lo:hi]] += 1
        return table.select(["fp", "h", "a", "b"]).take(pa.array(order[seen[found] > 1]))

    return windows.groupBy("fp", "range").applyInArrow(merge, "fp long, h long, a int, b int")


def repeated_windows(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, kgram: int = KGRAM) -> DataFrame:
    """(id, th, spans): for every document with repeats, the runs (first, stop) of windows that occur elsewhere."""
    with scratch_scope(df.sparkSession) as kept:
        docs = _documents(df, id_col, text_col)
        every = materialize(candidate_slices(docs, length, kgram))
        # Aggregates are written before they are joined: only a join of plain shuffles has its hot keys split.
        anchors = every.groupBy("fp").agg(F.count("*").alias("c"), F.min("h").alias("lo"), F.max("h").alias("hi")).where("c > 1")
        anchors = materialize(anchors.select("fp", (F.col("lo") != F.col("hi")).alias("several")))
        shared = materialize(every.join(anchors, "fp"))
        discard(every, anchors)
        plain = shared.where("not several").select("id", "th", F.col("s0").alias("first"), F.expr("s0 + ns").alias("stop"))

        mixed = shared.where("several")
        kinds = mixed.groupBy("fp", "h").agg(F.count("*").alias("n"), F.min(F.struct("id", "th", "s0", "ns")).alias("r"))
        kinds = materialize(kinds.select("fp", "h", "n", "r.*"))
        sizes = materialize(kinds.groupBy("fp").agg(F.count("*").alias("different"), F.min("n").alias("least")))
        shards = F.ceil(F.col("different") / F.lit(SHARD_SLICES)).cast("int")
        wanted = kinds.join(sizes.where("least = 1").select("fp", shards.alias("shards")), "fp")
        wanted = wanted.groupBy(F.col("id").alias("rid"), F.col("th").alias("rth")).agg(F.collect_list(F.struct("fp", "h", "ns", "s0", "shards")).alias("wanted"))
        dealt = fetched_slices(docs, wanted, length).repartition("fp", "shard").sortWithinPartitions("fp", "shard", "h")
        verdicts = materialize(shard_verdicts(dealt, length))
        windows = verdicts.where("kind = 'window'")
        spread = windows.select("fp", "h", "a", "b", "shard", "range", "w1", "w2")
        found = (
            verdicts.where("kind = 'run'").select("fp", "h", "a", "b")
            .union(merge_shards(spread))
            .union(kinds.where("n > 1").select("fp", "h", F.lit(0).alias("a"), F.col("ns").alias("b")))
        )
        found = materialize(found.distinct())
        placed = mixed.join(found, ["fp", "h"]).select("id", "th", F.expr("s0 + a").alias("first"), F.expr("s0 + b").alias("stop"))
        out = materialize(plain.union(placed).groupBy("id", "th").agg(F.array_sort(F.collect_set(F.struct("first", "stop"))).alias("spans")))
        kept.append(out)
    return out


def covered(spans: list[tuple[int, int]], length: int) -> list[tuple[int, int]]:
    """Maximal byte runs (start, stop) covered by windows from sorted runs of them."""
    out: list[tuple[int, int]] = []
    for first, stop in spans:
        end = stop - 1 + length
        if out and first <= out[-1][1]:
            if end > out[-1][1]:
                out[-1] = (out[-1][0], end)
        else:
            out.append((first, end))
    return out


def remove_repeats(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, kgram: int = KGRAM, keep_text: bool = False) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) per row.

    keep_text: in their place, all columns of ``df`` with the remaining text; a character cut in two is left out.
    """
    spans = repeated_windows(df, id_col=id_col, text_col=text_col, length=length, kgram=kgram)
    source = df if keep_text else df.select(id_col, text_col)
    own, id_, th, first_, stop_ = free_names(source, "__own", "__id", "__th", "__first", "__stop")
    looked = spans.select(F.col("id").alias(id_), F.col("th").alias(th), F.transform("spans", lambda x: x["first"]).alias(first_), F.transform("spans", lambda x: x["stop"]).alias(stop_))
    hashed = source.withColumn(own, F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
    packed = with_packed_text(hashed, text_col)
    joined = packed.join(looked, packed[id_col].eqNullSafe(looked[id_]) & (packed[own] == looked[th]), "left").drop(id_, th, own)
    names = source.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            firsts, stops = batch.column(first_).to_pylist(), batch.column(stop_).to_pylist()
            for value, first, stop in zip(batch.column(text_col).to_pylist(), firsts, stops, strict=True):
                raw = unpack(value) if value is not None else b""
                gone = covered(list(zip(first, stop, strict=True)), length) if first else []
                kept, at = [], 0
                for a, b in gone:
                    kept.append(raw[at:a])
                    at = b
                left = b"".join(kept) + raw[at:] if gone else raw
                if keep_text:
                    rows.append((left.decode("utf-8", "ignore") if value is not None else None,))
                else:
                    rows.append((len(raw), len(raw) - len(left), len(gone), hashlib.sha256(left).hexdigest()))
            columns = [list(c) for c in zip(*rows, strict=True)] if rows else [[]] * (1 if keep_text else 4)
            if keep_text:
                arrays = [pa.array(columns[0], pa.string()) if n == text_col else batch.column(n) for n in names]
                yield pa.RecordBatch.from_arrays(arrays, names)
            else:
                types = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([batch.column(id_col), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], [id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    kind = df.schema[id_col].dataType.simpleString()
    return joined.mapInArrow(released(run), source.schema if keep_text else f"{id_col} {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")

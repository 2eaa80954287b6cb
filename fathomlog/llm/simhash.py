"""SimHash near-duplicates by segment popcounts.

A fingerprint is cut into ``SEGMENTS`` segments and mapped to the vector of their
bit counts. The Manhattan distance of two such vectors never exceeds the Hamming
distance of the fingerprints, so fingerprints within ``bits`` = 2 lie within
distance 2 on that grid and share a grid cell at distance 1 or less from both.
The range join therefore sends each distinct fingerprint to its own cell and the
neighbours at distance 1, and compares exactly (popcount of the difference)
within a cell.

A cell with more than ``DENSE`` members isn't compared pair by pair. Its members
go to a second, equally exact round: each to the 65 values within one bit of it,
where two fingerprints meet if and only if they differ in two bits or fewer, and
each is linked to the smallest there. So no cell emits pairs with the square of
its size, and no link is lost.

Copies collapse first: everything after the fingerprints works on distinct ones.

Two bits are a narrow net: documents that share 0.8 of their shingles differ in 4 to 14
bits, where neither counts nor bits tell them from strangers. ``keep_one`` therefore looks
among all distinct texts for that similarity (of the sets of their shingles, intersection
over union) with candidates from ``BANDS`` bands of ``ROWS`` min-hashes, which share one but
for 8 in a million such pairs, while texts that share a passage of a third of them meet in one of 30; every candidate is verified on the shingles of both texts. A
bucket of candidates isn't compared pair by pair, but with a leader at a time (first who meets most others) as long as many leave: who is
similar to a leader leaves the bucket, and a leader has met all of it and leaves too. A bucket whose texts the links of the first
round join already is done. What leaders no longer thin out are texts that share a passage without being copies: they are dealt anew, by their
rarest shingles, so many of them that two similar texts share one (whatever the order of shingles, so a bounded sketch of
their counts may set it), meet some leaders in those buckets as long as many leave, and then each other where the shingle's place among those of either allows them to be similar.
Texts that links of the first round join don't meet. Who left without meeting others of the
bucket meets them in the end, unless links join the two already or what sets both apart from the leader
rules the pair out. So the links have the components of all similar candidates, and a group
of copies costs a few rows each.

Defined results: a null text is empty; a text without words has fingerprint zero,
linked like any other; a null id takes part but never names a component unless
it has no other; repeated rows each get a row; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomlog.llm.common import broadcast_if_small, discard, free_names, materialize, pack, released, scratch_scope, slices, unpack, with_text
from fathomlog.llm.components import connected_components

SEGMENTS = 16
#: Cells of more members are resolved by single-bit neighbours in place of pairs.
DENSE = 48
#: Bands of min-hashes and min-hashes in one; leaders of a bucket in the first round with several.
BANDS, ROWS, LEADERS = 50, 7, 8
#: Longs that mark the shingles by which two texts differ.
MARKS = 16
#: Counters of the sketch that tells rare shingles, and the parts in which it is summed up.
SLOTS, PARTS = 1 << 18, 16

_rng = np.random.default_rng(11)
_FACTORS = _rng.integers(1, 2**63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_TERMS = _rng.integers(0, 2**63, BANDS * ROWS, np.uint64)
_MIXERS = _rng.integers(1, 2**63, (BANDS, ROWS), np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_hashes(text: str, words: int, seed: int = 42) -> np.ndarray:
    """XXH64 of a text's shingles, repeats included."""
    got = text.encode().lower().split()
    k = min(words, len(got))
    shingles = got if k < 2 else map(b" ".join, zip(*(got[i:] for i in range(k))))
    return np.fromiter((xxhash.xxh64_intdigest(x, seed) for x in shingles), np.uint64)


def fingerprint(text: str, words: int, seed: int = 42) -> int:
    """One text's fingerprint, unsigned."""
    return fingerprint_of(shingle_hashes(text, words, seed))


def fingerprint_of(h: np.ndarray) -> int:
    """The fingerprint of shingle hashes; none give zero."""
    # Counts of set bits for each of the 64 places, most significant first.
    counts = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 15):
        part = h[at : at + (1 << 15)].byteswap().view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(h)).tobytes(), "big")


def bands_of(distinct: np.ndarray) -> np.ndarray:
    """A key for each band of min-hashes of distinct shingle hashes; none without shingles."""
    if not len(distinct):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(distinct), 256):
        least = np.minimum(least, (distinct[at : at + 256, None] * _FACTORS + _TERMS).min(axis=0))
    keys = ((least.reshape(BANDS, ROWS) ^ (least.reshape(BANDS, ROWS) >> np.uint64(29))) * _MIXERS).sum(axis=1, dtype=np.uint64)
    return (keys ^ (keys >> np.uint64(32))).view(np.int64)


def _rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text_hash, text): a row is told apart by its id and its text's hash."""
    rows = with_text(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text")
    return rows.select("id", F.xxhash64("text").alias("text_hash"), "text")


def fingerprints(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 3, banded: bool = False) -> DataFrame:
    """(id, text_hash, fp); fp is a signed 64-bit integer. banded: with (n, bands) of the distinct shingles, too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            fps, sizes, bands = [], [], []
            for text in batch.column("text").to_pylist():
                h = shingle_hashes(text, words)
                fps.append(fingerprint_of(h))
                if banded:
                    distinct = np.unique(h)
                    sizes.append(len(distinct))
                    bands.append(bands_of(distinct))
            columns = [batch.column("id"), batch.column("text_hash"), pa.array(np.array(fps, np.uint64).view(np.int64))]
            columns += [pa.array(sizes, pa.int64()), pa.array(bands, pa.list_(pa.int64()))] if banded else []
            yield pa.RecordBatch.from_arrays(columns, ["id", "text_hash", "fp", "n", "bands"][: len(columns)])

    kind = df.schema[id_col].dataType.simpleString()
    return _rows(df, id_col, text_col).mapInArrow(released(run), f"id {kind}, text_hash long, fp long" + ", n long, bands array<long>" * banded)


def _grid(fp: str) -> str:
    """The 16 bit counts of a fingerprint's 4-bit segments, each in 4 bits of a long: counts add nibble by nibble."""
    # Bit operations only, as signed sums of whole longs may overflow: first by pairs of bits, then by pairs of pairs.
    half, quarter = "6148914691236517205L", "3689348814741910323L"  # 0x5555..., 0x3333...
    next_bit = f"shiftrightunsigned({fp}, 1)"
    pairs = f"((({fp} ^ {next_bit}) & {half}) | shiftleft({fp} & {next_bit} & {half}, 1))"
    return f"(({pairs} & {quarter}) + (shiftrightunsigned({pairs}, 2) & {quarter}))"


def links(fps: DataFrame) -> DataFrame:
    """(a, b) between distinct fingerprints of ``fps`` (fp): its classes by 2 bits or fewer are those of these links."""
    unit = "shiftleft(1L, 4 * i)"
    # Up to 33 cells: its own, and each segment's count one less (from 1) or one more (to 4).
    cells = f"""concat(array(c), transform(filter(sequence(0, 15), i -> (shiftrightunsigned(c, 4 * i) & 15) > 0), i -> c - {unit}),
        transform(filter(sequence(0, 15), i -> (shiftrightunsigned(c, 4 * i) & 15) < 4), i -> c + {unit}))"""
    members = fps.select("fp", F.expr(_grid("fp")).alias("c")).select("fp", F.explode(F.expr(cells)).alias("cell"))
    # Counted map-side and joined, so that a crowded cell is no one task.
    counts = materialize(members.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1"))
    held = materialize(members.join(counts, "cell"))
    few = (
        held.where(F.col("n") <= DENSE)
        .groupBy("cell").agg(F.array_sort(F.collect_list("fp")).alias("m"))
        .select(F.explode(F.expr("flatten(transform(m, (x, i) -> transform(filter(slice(m, i + 2, size(m)), y -> bit_count(x ^ y) <= 2), y -> struct(x as a, y as b))))")).alias("p"))
        .select("p.a", "p.b")
        .distinct()
    )
    near = "concat(array(fp), transform(sequence(0, 63), i -> fp ^ shiftleft(1L, i)))"
    meet = held.where(F.col("n") > DENSE).select("fp").distinct().select("fp", F.explode(F.expr(near)).alias("z"))
    least = meet.groupBy("z").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1")
    many = meet.join(least, "z").where("a <> fp").select("a", F.col("fp").alias("b")).distinct()
    return few.union(many)


def near_groups(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(id, text_hash, fp, component_id): the smallest id reachable over links of 2 bits or fewer."""
    return _grouped(materialize(fingerprints(df, id_col=id_col, text_col=text_col, words=words)), id_col)


def _classes(rows: DataFrame) -> DataFrame:
    """(fp, low, n, root) of materialized fingerprints: their smallest id, their rows, and what names their class."""
    distinct = materialize(rows.groupBy("fp").agg(F.min("id").alias("low"), F.count("*").alias("n")))
    roots = connected_components(links(distinct.select("fp")))
    return distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def _grouped(rows: DataFrame, id_col: str) -> DataFrame:
    """Materialized fingerprints with their component_id, other columns as they were."""
    own = _classes(rows)
    least = own.groupBy("root").agg(F.min("low").alias("component_id"), F.sum("n").alias("n"))
    # Only fingerprints of more than one row are looked up; others are their own component.
    shared = materialize(own.select("fp", "root").join(least.where("n > 1").select("root", "component_id"), "root").select("fp", "component_id"))
    return rows.join(broadcast_if_small(shared, 24), "fp", "left").select(
        F.col("id").alias(id_col), *(c for c in rows.columns if c not in ("id", "component_id")), F.when(F.col("component_id").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id")
    )


def _shingle_sets(nodes: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """(o, s): the sorted distinct shingle hashes of rows (o), as bytes."""
    nodes = materialize(nodes.select("o", F.col("o.id").alias("__id"), F.col("o.text_hash").alias("__hash")))
    found = texts.join(broadcast_if_small(nodes, 96), F.col("id").eqNullSafe(F.col("__id")) & (F.col("text_hash") == F.col("__hash")))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets = [np.unique(shingle_hashes(t, words)).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("o"), pa.array(sets, pa.binary())], ["o", "s"])

    kind = nodes.schema["o"].dataType.simpleString()
    return materialize(found.select("o", "text").mapInArrow(released(hashed), f"o {kind}, s binary").dropDuplicates(["o"]))


def _compared(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b, gap, marks, extra, similar) for pairs (a, b): how many shingles only one of them has, and whether they are similar.

    marks: the bits on which those shingles fall, as longs; extra: how many fall on a bit that another has set.
    """

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gaps, marks, similar = [], np.zeros((batch.num_rows, MARKS * 64), np.uint8), []
            for i, (x, y) in enumerate(zip(batch.column("x"), batch.column("y"), strict=True)):
                one, other = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                apart = np.setxor1d(one, other, assume_unique=True)
                both = (len(one) + len(other) - len(apart)) // 2
                gaps.append(len(apart))
                marks[i, (apart % np.uint64(MARKS * 64)).astype(np.int64)] = 1
                similar.append(both >= similarity * (len(one) + len(other) - both))
            extra = np.array(gaps, np.int64) - marks.sum(axis=1, dtype=np.int64)
            packed = pa.FixedSizeListArray.from_arrays(pa.array(np.packbits(marks, axis=1).reshape(-1).view(np.int64)), MARKS).cast(pa.list_(pa.int64()))
            columns = [batch.column("a"), batch.column("b"), pa.array(gaps, pa.int64()), packed, pa.array(extra), pa.array(similar, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, ["a", "b", "gap", "marks", "extra", "similar"])

    kind = pairs.schema["a"].dataType.simpleString()
    joined = pairs.join(sets.select(F.col("o").alias("a"), F.col("s").alias("x")), "a").join(sets.select(F.col("o").alias("b"), F.col("s").alias("y")), "b")
    return joined.select("a", "b", "x", "y").mapInArrow(released(compared), f"a {kind}, b {kind}, gap long, marks array<long>, extra long, similar boolean")


def _crowded(members: DataFrame, roots: DataFrame) -> DataFrame:
    """Members (bucket, o, place, lead) of buckets that hold more than one component of ``roots`` (node, root), and someone who may lead; with their roots."""
    own = members.drop("root").withColumn("node", _plain("o")).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).drop("node")
    counts = materialize(own.groupBy("bucket").agg(F.min("root").alias("one"), F.max("root").alias("other"), F.max("lead").alias("led")).where("one <> other and led").select("bucket"))
    held = materialize(own.join(broadcast_if_small(counts, 16), "bucket"))
    discard(counts)
    return held


def _shingle_counts(sets: DataFrame) -> np.ndarray:
    """Of shingles of (o, s), by their hash modulo ``SLOTS``, in how many sets they are; other shingles of the slot count, too."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for s in batch.column("s"):
                np.add.at(counts, (np.frombuffer(s.as_buffer(), np.uint64) % np.uint64(SLOTS)).astype(np.int64), 1)
        parts = [(i, pack(part.tobytes())) for i, part in enumerate(np.split(counts, PARTS)) if part.any()]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in parts], pa.int32()), pa.array([c for _, c in parts], pa.binary())], ["part", "counts"])

    def summed(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(unpack(c.as_py()), np.int64) for c in table.column("counts"))
        return pa.table([table.column("part")[:1], pa.array([total.tobytes()], pa.binary())], ["part", "counts"])

    schema = "part int, counts binary"
    out = np.zeros((PARTS, SLOTS // PARTS), np.int64)
    for r in sets.select("s").mapInArrow(released(counted), schema).groupBy("part").applyInArrow(summed, schema).collect():  # the sketch's parts
        out[r.part] = np.frombuffer(r.counts, np.int64)
    return out.reshape(-1)


def _by_rare_shingles(sets: DataFrame, similarity: float) -> DataFrame:
    """(bucket, o, place, lead) of sets (o, s): their rarest shingles that others may have, of which two similar sets share one, and the shorter may lead.

    Similar sets share ``similarity`` of either at least, and twice that over 1 more than it of the shorter. So, in any order of shingles, one that
    both have is among the first of either when those are all but that share, and one more; and among the first so reckoned that lead of the shorter.
    """
    counts = np.minimum(_shingle_counts(sets), np.iinfo(np.int32).max).astype(np.int32)

    def rarest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, found, place, lead = [], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, bool)]
            for i, s in enumerate(batch.column("s")):
                h = np.frombuffer(s.as_buffer(), np.uint64)
                held = counts[(h % np.uint64(SLOTS)).astype(np.int64)]
                first = np.lexsort((h, held))[: len(h) - int(np.ceil(similarity * len(h) - 1e-6)) + 1]
                # What one text alone has leads to no other.
                shared = held[first] > 1
                found.append(h[first[shared]])
                place.append(np.flatnonzero(shared))
                lead.append(place[-1] <= len(h) - int(np.ceil(2 * similarity / (1 + similarity) * len(h) - 1e-6)))
                at.append(np.full(len(found[-1]), i))
            rows = pa.array(np.concatenate([np.zeros(0, np.int64), *at]), pa.int64())
            columns = [pa.array(np.concatenate(found).view(np.int64)), batch.column("o").take(rows), pa.array(np.concatenate(place)), pa.array(np.concatenate(lead))]
            yield pa.RecordBatch.from_arrays(columns, ["bucket", "o", "place", "lead"])

    kind = sets.schema["o"].dataType.simpleString()
    return materialize(sets.select("o", "s").mapInArrow(released(rarest), f"bucket long, o {kind}, place long, lead boolean"))


def _met_by_places(members: DataFrame, similarity: float) -> DataFrame:
    """(a, b) of members (bucket, o, place, lead, root) that can be similar with the bucket's shingle as the first that both have."""
    one = members.where("lead").select("bucket", F.col("o").alias("leader"), F.col("place").alias("at"), F.col("root").alias("own"))
    # Of either no more are shared than come from there on.
    most = F.least(F.col("leader.n") - F.col("at"), F.col("o.n") - F.col("place"))
    allowed = most >= F.lit(similarity / (1 + similarity)) * (F.col("leader.n") + F.col("o.n")) - 1e-6
    met = members.join(one, "bucket").where((F.col("root") != F.col("own")) & (F.col("leader.n") <= F.col("o.n")) & allowed & (F.col("leader") != F.col("o")))
    return met.select(*_ordered("o", "leader")).distinct()


def _close(one: str, other: str, similarity: float) -> Column:
    """Whether two sizes allow the similarity."""
    return F.least(f"{one}.n", f"{other}.n") >= F.lit(similarity) * F.greatest(f"{one}.n", f"{other}.n")


def _ordered(one: str, other: str) -> list[Column]:
    return [F.least(one, other).alias("a"), F.greatest(one, other).alias("b")]


def _plain(o: str) -> Column:
    """A member as the node that it is, without what orders leaders."""
    return F.struct(*(F.col(f"{o}.{c}").alias(c) for c in ("none", "id", "text_hash", "n")))


def _links(tried: DataFrame) -> DataFrame:
    """(a, b) of similar pairs, in the order of nodes."""
    one, other = _plain("a"), _plain("b")
    return tried.where("similar").select(F.least(one, other).alias("a"), F.greatest(one, other).alias("b"))


def similar_links(nodes: DataFrame, known: DataFrame, texts: DataFrame, *, words: int, similarity: float) -> DataFrame:
    """(a, b) between texts (o, bands), a being the smaller: with ``known`` links, they connect what all similar pairs connect.

    ``o`` is (none, id, text_hash, n), in the order in which texts stay.
    """
    placed = nodes.select("o", F.explode(F.array_distinct("bands")).alias("bucket"))
    # Counted first, as few buckets hold more than one: only members of those are written.
    counts = materialize(placed.groupBy("bucket").agg(F.count("*").alias("held")).where("held > 1"))
    held = materialize(placed.join(broadcast_if_small(counts, 24), "bucket"))
    # Who meets most others in all its buckets leads first: the text that others were made of, if it is there.
    degrees = held.groupBy("o").agg((-F.sum("held")).alias("d"))
    members = materialize(held.select("bucket", "o").join(degrees, "o").select("bucket", F.struct("d", "o.*").alias("o"), F.lit(0).cast("long").alias("place"), F.lit(True).alias("lead"), F.col("o").alias("root")))
    discard(counts, held)
    leaders, dealt, tried, roots = 1, False, None, None
    if members.isEmpty():
        return known
    sets = _shingle_sets(members.select("o").distinct(), texts, words)
    while not members.isEmpty():
        salt = F.pmod(F.xxhash64("o"), F.lit(leaders))
        led = members.where("lead").groupBy("bucket", salt.alias("salt")).agg(F.min(F.struct("o", "root")).alias("l"))
        led = materialize(led.select("bucket", F.col("l.o").alias("leader"), F.col("l.root").alias("own")))
        # Sizes further apart than the square of the similarity leave no text that is similar to both.
        met = members.join(led, "bucket").where((F.col("o") != F.col("leader")) & (F.col("root") != F.col("own"))).where(_close("o", "leader", similarity * similarity - 1e-9))
        pairs = met.select(*_ordered("o", "leader")).distinct()
        # Pairs that have met in another bucket before aren't compared again.
        pairs = materialize(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"))
        now = materialize(_compared(pairs, sets, similarity))
        tried = now if tried is None else tried.union(now)
        below = met.where(F.col("leader") < F.col("o")).select("bucket", F.col("leader").alias("a"), F.col("o").alias("b"))
        done = materialize(below.join(tried.where("similar"), ["a", "b"]).select("bucket", F.col("b").alias("o")).union(led.select("bucket", "leader")).distinct())
        left = members.join(done, ["bucket", "o"], "left_anti")
        if roots is None:
            # The first leaders have found most of each group: buckets within one are done.
            roots = materialize(connected_components(known.union(_links(tried))))
        left = _crowded(left, roots)
        # Leaders, which make a row for a member each, as long as a quarter of the members leaves.
        thinned = 4 * left.count() <= 3 * members.count()
        discard(led, pairs, done, members)
        members = left
        if not thinned and dealt:
            pairs = materialize(_met_by_places(members, similarity).join(tried, ["a", "b"], "left_anti"))
            tried = tried.union(materialize(_compared(pairs, sets, similarity)))
            break
        if not thinned:
            rest = materialize(sets.join(materialize(members.select("o").distinct()), "o", "left_semi"))
            members = _crowded(_by_rare_shingles(rest, similarity), roots)
            leaders, dealt = LEADERS, True
            discard(left)
    found = known.union(_links(tried))
    missed = _missed(tried, found, similarity)
    return found if missed.isEmpty() else found.union(_links(materialize(_compared(missed, sets, similarity))))


def _missed(tried: DataFrame, found: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) that haven't met as one left a bucket before, and may join components of the links ``found``.

    Who left was similar to a leader whom the other one met. The gap of the pair is that of both to the leader, less twice the
    shingles that are in both of these gaps; their marks bound those from above.
    """
    share, slack = (1 - similarity) / (1 + similarity), 1e-6  # similar pairs have a gap of ``share`` of their sizes' sum at most
    left = tried.where("similar").select(F.col("a").alias("leader"), F.col("b").alias("o"), "gap", F.col("marks").alias("m"), F.col("extra").alias("e"))
    reach = materialize(left.groupBy("leader").agg(F.max(F.col("gap") + share * F.col("o.n")).alias("reach")))
    met = tried.select(F.col("a").alias("leader"), F.col("b").alias("x"), F.col("gap").alias("far"), "marks", "extra")
    met = met.union(tried.select(F.col("b").alias("leader"), F.col("a").alias("x"), F.col("gap").alias("far"), "marks", "extra"))
    met = materialize(met.join(reach, "leader").where(F.col("far") <= F.col("reach") + share * F.col("x.n") + slack).drop("reach"))
    roots = materialize(connected_components(found))
    own = roots.select(F.col("node").alias("n1"), F.col("root").alias("one"))
    other = roots.select(F.col("node").alias("n2"), F.col("root").alias("other"))
    met = met.withColumn("n1", _plain("leader")).withColumn("n2", _plain("x")).join(own, "n1").join(other, "n2", "left")
    met = materialize(met.where("other is null or one <> other").select("leader", "x", "far", "marks", "extra"))
    most = share * (F.col("o.n") + F.col("x.n")) + slack
    shared = F.least("e", "extra")
    for i in range(MARKS):
        shared += F.bit_count(F.col("m")[i].bitwiseAND(F.col("marks")[i]))
    pairs = left.join(met, "leader").where(_close("o", "x", similarity)).where(F.abs(F.col("far") - F.col("gap")) <= most).where(F.col("gap") + F.col("far") - 2 * shared <= most)
    return materialize(pairs.select(*_ordered("o", "x")).distinct().join(tried, ["a", "b"], "left_anti"))


def keep_one(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """``df`` with one text of each group of near copies, that of the smallest id; all columns as they were.

    Near copies are of 2 bits or fewer, or of ``similarity`` or more. Rows that repeat both the id and the text stay together.
    """
    id_, hash_ = free_names(df, "__id", "__hash")
    with scratch_scope(df.sparkSession) as kept:
        rows = materialize(fingerprints(df, id_col=id_col, text_col=text_col, words=words, banded=True))
        first = F.min(F.struct(F.col("id").isNull().alias("none"), "id")).alias("first")
        nodes = rows.groupBy("text_hash", "fp", "n").agg(first, F.count("*").alias("copies"), F.first("bands").alias("bands"))
        nodes = materialize(nodes.select(F.struct("first.none", "first.id", "text_hash", "n").alias("o"), "fp", "copies", "bands"))
        # Texts of one class of fingerprints are linked to the smallest of it.
        classes = _classes(rows)
        shared = materialize(classes.join(classes.groupBy("root").agg(F.sum("n").alias("rows")).where("rows > 1"), "root").select("fp", "root"))
        classed = materialize(nodes.select("o", "fp").join(broadcast_if_small(shared, 24), "fp").select("o", "root"))
        least = materialize(classed.groupBy("root").agg(F.min("o").alias("a")))
        known = materialize(classed.join(broadcast_if_small(least, 64), "root").where("a <> o").select("a", F.col("o").alias("b")))
        links = similar_links(nodes, known, _rows(df, id_col, text_col), words=words, similarity=similarity)
        # Of a text that goes all rows go; of one that stays, those under other ids.
        gone = connected_components(links).where(F.col("node") != F.col("root")).select("node.text_hash", F.lit(True).alias("whole"), F.col("node.id").alias("first"))
        gone = gone.union(nodes.where("copies > 1").select("o.text_hash", F.lit(False), "o.id"))
        gone = materialize(gone)
        lost = rows.select("id", "text_hash").join(broadcast_if_small(gone, 32), "text_hash").where(F.col("whole") | ~F.col("id").eqNullSafe(F.col("first")))
        lost = materialize(lost.select(F.col("id").alias(id_), F.col("text_hash").alias(hash_)).distinct())
        kept.append(lost)
    own = F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    return df.join(broadcast_if_small(lost, 32), df[id_col].eqNullSafe(lost[id_]) & (own == lost[hash_]), "left_anti")

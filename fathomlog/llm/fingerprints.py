"""Similarity digests of documents from their improbable features.

Every window of ``WIDTH`` bytes is a feature. Its Shannon entropy falls into one of ``BINS`` bins, and a
bin is the more improbable the fewer windows of the whole corpus fall into it (``entropy_ranks`` counts
all of them); windows of nearly one byte only are never taken. Of each ``SPAN`` neighbouring windows the
most improbable, leftmost at ties, gets a point; a window with ``POINTS`` or more is selected. Selected
features, each once, are hashed to ``HASHES`` bits of a Bloom filter of ``BITS`` bits, and
a new filter is chained on after every ``FILL`` features: a fingerprint is its filters and grows
with its text.

The likeness of two fingerprints goes from the one with fewer bits: each of its filters is laid over all filters of the
other, the bits in common are reckoned between what chance gives and the most possible, the best
counts, and filters are averaged by their bits. Equal fingerprints have 1, unrelated ones about 0.

Windows are handled in NumPy, a buffer of many documents at a time: entropies by sliding sums of integers, the
most improbable of a span by doubling minima. A text longer than a buffer is worked off in pieces that overlap by a span and a
window, which changes nothing. ``neighbours`` deals documents out by ranges of their ids, so that a task walks
them in order with one buffer in memory, and only the first and last of a task meet in a second step.

Defined results: a null text is empty; a text without features (empty, or of nearly one byte) has no filters, likeness 1 to another such and 0 to
any other; of a text with no more windows than a span all are selected, and one shorter than a window has its ``SHORT`` bytes for windows. Null ids come first; rows of one id follow the hash of their texts, so of
repeated rows all but the last have their own text as the next; a single row is its own next; an
empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathomlog.llm.common import materialize, pack, released, slices, unpack

WIDTH, SPAN, POINTS = 16, 32, 6
#: Bytes of a feature of texts that are shorter than a window.
SHORT = 4
BINS, WEAK = 1001, 100
BITS, HASHES, FILL = 2048, 5, 160
#: What of the way from chance to the most possible still counts as chance.
SLACK = 0.3
#: Bytes that are looked at together.
BUFFER = 1 << 19
#: n * log2(n) and its steps in millionths, so that sums are exact in any order.
_G = np.array([0] + [round(n * np.log2(n) * 1e6) for n in range(1, WIDTH + 1)], np.int64)
_STEP = np.diff(_G)


def entropy_bins(raw: np.ndarray) -> np.ndarray:
    """The bin of each window of ``raw``: 1000 parts of the largest entropy that a window can have."""
    n = len(raw) - WIDTH + 1
    before, after = np.zeros(len(raw), np.uint8), np.zeros(len(raw), np.uint8)  # equal bytes among the WIDTH - 1 beside
    for shift in range(1, WIDTH):
        same = (raw[shift:] == raw[:-shift]).view(np.uint8)
        before[shift:] += same
        after[:-shift] += same
    first = int(_G[np.bincount(raw[:WIDTH], minlength=256)].sum())
    moved = _STEP[before[WIDTH:]] - _STEP[after[: n - 1]]  # the byte that enters, and the one that leaves
    held = np.concatenate([[first], first + np.cumsum(moved)])
    return (1000 * (_G[WIDTH] - held) // _G[WIDTH]).astype(np.int64)


def _buffers(texts: list[bytes], halo: int) -> Iterator[list[tuple[int, int, bytes, int, int]]]:
    """Lists of (text, place of the piece, piece, first window to keep, windows to keep), a buffer's worth each."""
    held, size = [], 0
    for i, raw in enumerate(texts):
        windows = len(raw) - WIDTH + 1
        for start in range(0, max(windows, 0), BUFFER):
            keep, at = min(BUFFER, windows - start), max(0, start - halo)
            held.append((i, at, raw[at : start + keep + halo + WIDTH - 1], start - at, keep))
            size += len(held[-1][2])
            if size >= BUFFER:
                yield held
                held, size = [], 0
    if held:
        yield held


def count_bins(texts: list[bytes]) -> np.ndarray:
    """Windows of these texts by bin."""
    out = np.zeros(BINS, np.int64)
    for held in _buffers(texts, 0):
        bins = entropy_bins(np.frombuffer(b"".join(p for _, _, p, _, _ in held), np.uint8))
        out += np.bincount(bins[_inside(held)], minlength=BINS)
    return out


def _inside(held: list) -> np.ndarray:
    """Places of the windows that lie within one piece."""
    out, at = [], 0
    for _, _, piece, first, keep in held:
        out.append(np.arange(at + first, at + first + keep))
        at += len(piece)
    return np.concatenate(out)


def entropy_ranks(docs: DataFrame, text: str = "text") -> list[int]:
    """A bin's place among all, the rarest in the corpus first; -1 for bins that are too weak to be taken."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BINS, np.int64)
        for batch in slices(batches, text):
            total += count_bins([t.encode() for t in batch.column(text).to_pylist()])
        at = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["bin", "n"])

    whole = docs.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias(text))
    counted = dict(whole.mapInArrow(released(run), "bin long, n long").groupBy("bin").agg(F.sum("n")).collect())  # BINS rows
    order = sorted(range(WEAK, BINS), key=lambda b: (counted.get(b, 0), b))
    ranks = [-1] * BINS
    for rank, b in enumerate(order):
        ranks[b] = rank
    return ranks


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def hashed(features: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row of bytes (n, WIDTH)."""
    lanes = np.ascontiguousarray(features).view("<u8")
    h = np.full(len(features), 0x9E3779B97F4A7C15, np.uint64)
    for j in range(lanes.shape[1]):
        h = _mixed(h ^ lanes[:, j]) + np.uint64(0x9E3779B97F4A7C15)
    return h


def selected(texts: list[bytes], ranks: np.ndarray) -> list[np.ndarray]:
    """The hashes of each text's selected features, in the order of their places, repeats included."""
    owners, hashes = [], []
    for held in _buffers(texts, SPAN):
        raw = np.frombuffer(b"".join(p for _, _, p, _, _ in held), np.uint8)
        bins = entropy_bins(raw)
        rank = ranks[bins]
        # Weak windows come last and never get a point. One number tells rank and place.
        keys = np.where(rank < 0, BINS, rank).astype(np.int64) << 32 | np.arange(len(rank))
        points = np.zeros(len(rank), np.int64)
        starts, at = [], 0
        for _, _, piece, _, _ in held:
            windows = len(piece) - WIDTH + 1
            if windows <= SPAN:  # all of a text that is one span
                points[at : at + windows] = POINTS
            else:
                starts.append(np.arange(at, at + windows - SPAN + 1))
            at += len(piece)
        if starts:
            least, reach = keys, 1
            while reach < SPAN:
                least = np.minimum(least[:-reach], least[reach:])
                reach *= 2
            points += np.bincount(least[np.concatenate(starts)] & 0xFFFFFFFF, minlength=len(points))
        taken = (points >= POINTS) & (rank >= 0)
        at = 0
        for i, _, piece, first, keep in held:
            where = at + first + np.nonzero(taken[at + first : at + first + keep])[0]
            owners.append(np.full(len(where), i))
            hashes.append(hashed(np.lib.stride_tricks.sliding_window_view(raw, WIDTH)[where]))
            at += len(piece)
    owner, value = (np.concatenate(owners), np.concatenate(hashes)) if owners else (np.zeros(0, int), np.zeros(0, np.uint64))
    cuts = np.searchsorted(owner, np.arange(len(texts) + 1))
    out = []
    for i, raw in enumerate(texts):
        own = value[cuts[i] : cuts[i + 1]]
        if 0 < len(raw) < WIDTH:
            parts = [raw[j : j + SHORT].ljust(WIDTH, b"\0") for j in range(max(1, len(raw) - SHORT + 1))]
            own = hashed(np.frombuffer(b"".join(parts), np.uint8).reshape(-1, WIDTH))
        out.append(own)
    return out


def filters_of(hashes: np.ndarray) -> np.ndarray:
    """The chained filters (n, BITS / 64) of a text's features."""
    if not len(hashes):
        return np.zeros((0, BITS // 64), np.uint64)
    kept = hashes[np.sort(np.unique(hashes, return_index=True)[1])]
    bits = np.zeros(((len(kept) + FILL - 1) // FILL, BITS), bool)
    row = np.arange(len(kept)) // FILL
    for j in range(HASHES):
        bits[row, (kept >> np.uint64(12 * j)).astype(np.int64) % BITS] = True
    return np.packbits(bits, axis=1, bitorder="little").view("<u8")


def likeness(x: np.ndarray, y: np.ndarray) -> float:
    """Of two fingerprints' filters, 0 to 1."""
    if not len(x) or not len(y):
        return float(len(x) == len(y))
    of_x, of_y = np.bitwise_count(x).sum(axis=1, dtype=np.int64), np.bitwise_count(y).sum(axis=1, dtype=np.int64)
    if (of_x.sum(), x.tobytes()) > (of_y.sum(), y.tobytes()):
        x, y, of_x, of_y = y, x, of_y, of_x
    best = np.empty(len(x))
    block = max(1, (1 << 18) // len(y))
    for start in range(0, len(x), block):
        part, own = x[start : start + block], of_x[start : start + block, None]
        met = np.bitwise_count(part[:, None, :] & y[None, :, :]).sum(axis=2, dtype=np.int64)
        most = np.minimum(own, of_y[None, :]).astype(float)
        chance = own * of_y[None, :] / BITS
        floor = chance + SLACK * (most - chance)
        best[start : start + block] = np.clip((met - floor) / np.maximum(most - floor, 1e-9), 0, 1).max(axis=1)
    return float((best * of_x).sum() / of_x.sum())


def written_as(filters: np.ndarray) -> str:
    return base64.b64encode(filters.tobytes()).decode()


def read_from(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), "<u8").reshape(-1, BITS // 64)


def edited(text: str, following: str) -> str:
    """The last quarter (rounded down) replaced by as much of the beginning of ``following``."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def _compared(docs: list[tuple], ranks: np.ndarray) -> Iterator[tuple]:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of (id, text), the last of which is only a next."""
    texts = [t.encode() for _, t in docs]
    changed = [edited(t, following).encode() for (_, t), (_, following) in zip(docs, docs[1:], strict=False)]
    prints = [filters_of(h) for h in selected(texts + changed, ranks)]
    for i, (id_, text) in enumerate(docs[:-1]):
        own, other = prints[i], prints[len(texts) + i]
        yield id_, len(text), hashlib.sha256(changed[i]).hexdigest(), written_as(own), written_as(other), likeness(own, other), likeness(own, prints[i + 1])


RESULT = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def neighbours(docs: DataFrame, ranks: list[int], *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) per row, next being the next larger id's, and the first's for the last."""
    id_type = docs.schema[id_col].dataType
    result = f"id {id_type.simpleString()}, {RESULT}"
    schema = f"task int, place int, text binary, {result}"
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("h"), F.spark_partition_id().alias("part"))
    table = np.array(ranks, np.int64)
    names = [x.split()[0] for x in schema.split(", ")]

    def batch_of(out: list[tuple], id_arrow: pa.DataType) -> pa.RecordBatch:
        kinds = [pa.int32(), pa.int32(), pa.binary(), id_arrow, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, held, size, id_arrow, begun = TaskContext.get().partitionId(), [], 0, None, False
        for batch in slices(batches, "text", BUFFER):
            id_arrow = batch.schema.field("id").type
            for row in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if not begun:  # the last document of the task before needs this one
                    yield batch_of([(task, 0, pack(row[1].encode()), row[0], *[None] * 6)], id_arrow)
                    begun = True
                held.append(row)
                size += len(row[1])
                if size >= BUFFER and len(held) > 1:
                    yield batch_of([(task, 1, None, *r) for r in _compared(held, table)], id_arrow)
                    held, size = held[-1:], len(row[1])
        if len(held) > 1:
            yield batch_of([(task, 1, None, *r) for r in _compared(held, table)], id_arrow)
        if held:
            yield batch_of([(task, 2, pack(held[-1][1].encode()), held[-1][0], *[None] * 6)], id_arrow)

    walked = materialize(
        rows.repartitionByRange("id", "h", "part").sortWithinPartitions("id", "h", "part").select("id", "text").mapInArrow(released(run), schema)
    )
    # Tasks that had rows, in order: one short row each; the texts are fetched by the tasks' numbers.
    tasks = walked.where("place = 0").select("task")
    in_order = Window.orderBy("task")
    following = tasks.select("task", F.coalesce(F.lead("task").over(in_order), F.first("task").over(in_order)).alias("next"))
    ends = walked.where("place = 2").select("task", "id", "text").join(following, "task").join(walked.where("place = 0").select(F.col("task").alias("next"), F.col("text").alias("next_text")), "next")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                id_, text, following_text = (batch.column(c)[i].as_py() for c in ("id", "text", "next_text"))
                pair = [(id_, unpack(text).decode()), (None, unpack(following_text).decode())]
                out = [(0, 1, None, *r) for r in _compared(pair, table)]
                yield batch_of(out, batch.schema.field("id").type).select(names[3:])

    return walked.where("place = 1").drop("task", "place", "text").unionByName(ends.select("id", "text", "next_text").mapInArrow(released(finish), result))

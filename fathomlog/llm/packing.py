"""Best-fit packing with large-item matching, on counts of lengths.

Documents are tokenized in Spark tasks and cut into pieces of ``capacity`` tokens
only where they are longer. Packing then looks at the histogram of piece lengths,
which has ``capacity`` entries whatever the input: lengths above a third of the
capacity are matched greedily, largest first, each with the largest partner that
fits (two to a sequence at most); shorter ones go, longest first, into the tightest
remaining gap, and into new sequences when no gap is left. Equal lengths are placed
as one block, so the plan is a short list of placements (length, ranks, sequences,
offset). A piece finds its place from its rank among the pieces of its length,
which is counted over (length, salt) cells: one length held by a third of all
pieces is still spread.

Defined results: a null text is empty (one token, the separator); repeated rows
are packed each on their own; null ids are allowed; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathomlog.llm.common import broadcast_if_small, materialize, released, slices, with_text
from fathomlog.llm.word_bpe import gather, split_words, word_encoder

#: Parts of a length at least, and rows of a part of one that has all: full pieces may be most of them.
SALTS, SALT_ROWS = 64, 1 << 20
CHUNK_TEXT = 4 << 20
#: Parts of words whose ids a worker remembers from batch to batch.
REMEMBERED = 3 << 17


def pieces(df: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, separator: int = 0) -> DataFrame:
    """(id, piece, start, length, ids_crc32) of every document's ids with the separator after them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_encoder(path, REMEMBERED)
        for batch in slices(batches, "text", CHUNK_TEXT):
            offsets, positions, words = split_words(batch.column("text"))
            starts, flat = encode.ids_of(words.to_pylist())
            stops = np.concatenate(([0], np.cumsum(starts[positions + 1] - starts[positions])))[offsets]
            ids = gather(starts, flat, positions).astype("<u4")
            rows: list[tuple] = []
            for i in range(batch.num_rows):
                own = np.append(ids[stops[i] : stops[i + 1]], np.uint32(separator)).astype("<u4")
                for k, at in enumerate(range(0, len(own), capacity)):
                    part = own[at : at + capacity]
                    rows.append((i, k, at, len(part), zlib.crc32(part.tobytes())))
            row, piece, start, length, crc = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                ["id", "piece", "start", "length", "ids_crc32"],
            )

    kind = df.schema[id_col].dataType.simpleString()
    docs = with_text(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text")
    return docs.mapInArrow(released(run), f"id {kind}, piece int, start long, length long, ids_crc32 long")


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Placements (length, first rank, pieces, first sequence, pieces to a sequence, offset).

    The pieces of a placement fill consecutive sequences, ``pieces to a sequence`` each.
    """
    left = {n: c for n, c in histogram.items() if c}
    used = dict.fromkeys(left, 0)
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> (first sequence, sequences)
    out: list[tuple[int, int, int, int, int, int]] = []
    made = 0

    def place(length: int, count: int, first: int, each: int, gap: int) -> None:
        out.append((length, used[length], count, first, each, capacity - gap))
        used[length] += count
        left[length] -= count

    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    for length in large:
        for other in (n for n in large if n <= min(length, capacity - length)):  # largest first
            while left[length] and left[other] and (other != length or left[length] > 1):
                pairs = min(left[length], left[other]) if other != length else left[length] // 2
                place(length, pairs, made, 1, capacity)
                place(other, pairs, made, 1, capacity - length)
                gaps.setdefault(capacity - length - other, []).append((made, pairs))
                made += pairs
        if left[length]:
            alone = left[length]
            gaps.setdefault(capacity - length, []).append((made, alone))
            place(length, alone, made, 1, capacity)
            made += alone

    for length in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        for gap in sorted(g for g in gaps if g >= length):
            each = gap // length
            while left[length] and gaps[gap]:
                first, n = gaps[gap].pop()
                full = min(n, left[length] // each)
                if full:
                    place(length, full * each, first, each, gap)
                    gaps.setdefault(gap - each * length, []).append((first, full))
                    first, n = first + full, n - full
                if n and 0 < left[length] < each:
                    few = left[length]
                    place(length, few, first, few, gap)
                    gaps.setdefault(gap - few * length, []).append((first, 1))
                    first, n = first + 1, n - 1
                if n:
                    gaps[gap].append((first, n))
            if not left[length]:
                break
        each = capacity // length
        if full := left[length] // each:
            gaps.setdefault(capacity - each * length, []).append((made, full))
            place(length, full * each, made, each, capacity)
            made += full
        if few := left[length]:
            gaps.setdefault(capacity - few * length, []).append((made, 1))
            place(length, few, made, few, capacity)
            made += 1
    return out


def pack(cut: DataFrame, *, capacity: int = 2048, keys: tuple[str, ...] = ("id", "piece")) -> DataFrame:
    """``cut`` (with ``length``, 1 to capacity) and each row's sequence_id and offset."""
    spark = cut.sparkSession
    salts = max(SALTS, -(-cut.count() // SALT_ROWS))
    dealt = cut.withColumn("salt", F.pmod(F.xxhash64(*keys), F.lit(salts)).cast("int"))
    cells = dealt.groupBy("length", "salt").agg(F.count("*").alias("rows"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    cells = materialize(cells.withColumn("before", F.coalesce(F.sum("rows").over(before), F.lit(0))))
    histogram = {r["length"]: r["n"] for r in cells.groupBy("length").agg(F.sum("rows").alias("n")).collect()}  # at most capacity rows
    placed = plan(histogram, capacity)
    table = spark.createDataFrame(
        pa.table({n: pa.array([int(x[i]) for x in placed], pa.int64()) for i, n in enumerate(("length", "rank0", "count", "first", "each", "offset0"))})
    )
    own = Window.partitionBy("length", "salt").orderBy(*keys, *(c for c in cut.columns if c not in keys))
    ranked = (
        dealt.withColumn("rn", F.row_number().over(own))
        .join(broadcast_if_small(cells.select("length", "salt", "before"), 32), ["length", "salt"])
        .withColumn("rank", F.col("before") + F.col("rn") - 1)
    )
    inside = (F.col("rank") >= F.col("rank0")) & (F.col("rank") < F.col("rank0") + F.col("count"))
    return (
        ranked.join(F.broadcast(table), (ranked["length"] == table["length"]) & inside)  # from a histogram of `capacity` entries
        .withColumn("k", F.col("rank") - F.col("rank0"))
        .select(
            *(ranked[c] for c in cut.columns),
            (F.col("first") + F.floor(F.col("k") / F.col("each"))).cast("long").alias("sequence_id"),
            (F.col("offset0") + F.pmod(F.col("k"), F.col("each")) * ranked["length"]).cast("long").alias("offset"),
        )
    )


def pack_documents(df: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, separator: int = 0) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset) of all pieces of all documents."""
    cut = materialize(pieces(df, path, id_col=id_col, text_col=text_col, capacity=capacity, separator=separator))
    return pack(cut, capacity=capacity).withColumnRenamed("id", id_col)

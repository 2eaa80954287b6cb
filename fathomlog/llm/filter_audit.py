"""How filters interact: what each removes in every order, from packed bitmaps.

Each partition packs its rows into NumPy bitsets, one for each filter's failures and each label, in
which every part (a language, say) owns a run of whole bytes. The rows that pass all filters of a
subset are the AND-NOT of a smaller subset's bitset and one more filter's; its popcounts, by part,
are all that leaves the partition. Counts of partitions are summed, and everything that is reported for
the ``k!`` orders follows from the ``2**k`` subsets that can stand before or after a step.

A repeated text is told by its digest: the smallest id of each digest is an aggregate (combined
map-side), and rows look for themselves there by digest and id together, so a text held by a third of
all rows is no hot key.

Defined results: a null text is empty and a null part is the empty string; a row without an id
has no labels and repeats nothing; rows repeating an id and a text are each counted and fail
alike; of several label rows of one id a 1 counts; an empty table gives no rows; other
columns play no part.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomlog.llm.common import materialize, released

#: What separates words.
BLANK = "[\\x20\\x09-\\x0D]+"
COUNTS = "part string, subset int, kept long, good long, toxic long"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, BLANK), "")


def too_few_words(text: Column, least: int = 200) -> Column:
    return F.size(words_of(text)) < least


def repetitive(text: Column, percent: int = 50) -> Column:
    """Fewer distinct words than that share of all; case counts."""
    return F.lit(100) * F.size(F.array_distinct(words_of(text))) < F.lit(percent) * F.size(words_of(text))


def many_capitals(text: Column, percent: int = 3) -> Column:
    """More letters A-Z than that share of all code points."""
    return F.lit(100).cast("long") * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > F.lit(percent) * F.length(text)


def has_symbols(text: Column, symbols: str = "[#$%&*|]") -> Column:
    return text.rlike(symbols)


def flagged(docs: DataFrame, labels: DataFrame, filters: dict[str, Column], repeats: str, part: Column, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(part, flags): bit k for a failure of the k-th filter, ``repeats`` (another row of smaller id has this text) last, then the labels quality and toxic."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    bits = [F.shiftleft(F.coalesce(failed, F.lit(False)).cast("int"), k) for k, failed in enumerate(filters.values())]
    flags = bits[0]
    for bit in bits[1:]:
        flags = flags.bitwiseOR(bit)
    # Written once: texts are read and matched a single time, and only digests travel.
    rows = materialize(docs.select(F.col(id_col).alias("id"), part.alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), flags.alias("flags")))
    first = rows.where("id is not null").groupBy("digest").agg(F.min("id").alias("id")).withColumn("is_first", F.lit(True))
    known = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False)).cast("int")).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False)).cast("int")).alias("toxic")
    )
    k = len(filters)
    repeated = (F.col("id").isNotNull() & F.col("is_first").isNull()).cast("int")
    labelled = F.shiftleft(F.coalesce("good", F.lit(0)), k + 1).bitwiseOR(F.shiftleft(F.coalesce("toxic", F.lit(0)), k + 2))
    return (
        rows.join(first, ["digest", "id"], "left").join(known, "id", "left")
        .select("part", F.col("flags").bitwiseOR(F.shiftleft(repeated, k)).bitwiseOR(labelled).alias("flags"))
    )


def subset_counts(flags: DataFrame, k: int) -> DataFrame:
    """(part, subset, kept, good, toxic): for every subset of ``k`` filters, as a bit mask, the rows of a part that pass all of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            coded = batch.column("part").dictionary_encode()
            codes, values = coded.indices.to_numpy(zero_copy_only=False), batch.column("flags").to_numpy(zero_copy_only=False)
            order = np.argsort(codes, kind="stable")
            codes, values = codes[order], values[order]
            sizes = np.bincount(codes, minlength=len(coded.dictionary))
            spans = (sizes + 7) // 8
            byte = np.concatenate([[0], np.cumsum(spans)[:-1]])  # where each part's run begins
            row = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            place = byte[codes] * 8 + np.arange(len(codes)) - row[codes]

            def bitset(marks, place=place, length=int(spans.sum()) * 8):
                bits = np.zeros(length, np.uint8)
                bits[place] = marks
                return np.packbits(bits)

            failed = [bitset(values >> j & 1) for j in range(k)]
            good, toxic = bitset(values >> k & 1), bitset(values >> k + 1 & 1)
            kept = [bitset(1)]
            for subset in range(1, 1 << k):
                low = (subset & -subset).bit_length() - 1
                kept.append(kept[subset & (subset - 1)] & ~failed[low])
            count = lambda bits: np.add.reduceat(np.bitwise_count(bits).astype(np.int64), byte)  # noqa: B023, E731
            names = coded.dictionary
            for subset, bits in enumerate(kept):
                yield pa.RecordBatch.from_arrays(
                    [names, pa.array(np.full(len(names), subset, np.int32)), pa.array(count(bits)), pa.array(count(bits & good)), pa.array(count(bits & toxic))],
                    ["part", "subset", "kept", "good", "toxic"],
                )

    counted = flags.select("part", "flags").mapInArrow(released(run), COUNTS)
    return counted.groupBy("part", "subset").agg(*(F.sum(c).alias(c) for c in ("kept", "good", "toxic")))


def audit(flags: DataFrame, names: str) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) for all orders of the filters ``names``, a letter each.

    shapley is a filter's removals summed over all orders; divided by their number it is its Shapley value.
    """
    k = len(names)
    steps = []
    for i, order in enumerate(itertools.permutations(range(k))):
        before = 0
        for step, f in enumerate(order):
            steps.append((i * k + step, "".join(names[j] for j in order), step + 1, f, before, before | 1 << f))
            before |= 1 << f
    table = flags.sparkSession.createDataFrame(steps, "i int, filter_order string, step int, f int, before int, after int")
    counts = subset_counts(flags, k)
    entries = F.map_from_entries(F.collect_list(F.struct("subset", F.struct("kept", "good", "toxic"))))  # 2 ** k
    by_part = counts.groupBy("part").agg(entries.alias("c"))
    at = lambda subset, what="kept": F.col("c")[subset][what]
    own, whole = F.expr("shiftleft(1, f)"), F.lit((1 << k) - 1)
    rows = by_part.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(len(steps) - 1)))).join(F.broadcast(table), "i")  # k * k! rows by definition
    removed = at(F.col("before")) - at(F.col("after"))
    told = rows.select(
        "part", "filter_order", "step", "f", at(F.col("after")).alias("kept"), removed.alias("removed"), (at(F.lit(0)) - at(own) - removed).alias("redundant"),
        (at(whole - own) - at(whole)).alias("unique_fails"), (at(F.col("before"), "good") - at(F.col("after"), "good")).alias("good_lost"),
        (at(F.col("before"), "toxic") - at(F.col("after"), "toxic")).alias("toxic_lost"),
    )
    return told.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "f"))).drop("f")  # k! rows each

"""Bounded samples of labelled documents for the classifiers, and fitting on them in a task."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomlog.llm.common import released


def remainder(id_col: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; -1 for a null id."""
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string")), F.lit(modulus)), F.lit(-1))


def sample_of(documents: DataFrame, labels: DataFrame, label: str, allowed: Column, *, per_class: int, columns: tuple[str, ...] = ("text",), id_col: str = "doc_id") -> DataFrame:
    """(label, *columns) of ``per_class`` documents of each label at most, the first by their ids' hashes; one row to an id.

    allowed: which rows of ``labels`` may be learned from. Rows without label are passed over. Of several
    rows under one id the smallest counts, so an id that holds much of the table is still one row.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col(id_col).isNotNull() & allowed).groupBy(F.col(id_col).alias("__id")).agg(F.min(label).alias("__label"))
    order = (F.xxhash64("__id"), F.col("__id"))
    picked = known.where("__label = 0").orderBy(*order).limit(per_class).union(known.where("__label = 1").orderBy(*order).limit(per_class))
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    rows = documents.select(F.col(id_col).alias("__id"), F.struct(*(text if c == "text" else F.col(c) for c in columns)).alias("__row"))
    held = rows.join(F.broadcast(picked), "__id").groupBy("__id").agg(F.min("__label").alias("label"), F.min("__row").alias("__row"))  # 2 * per_class rows
    return held.select("__id", "label", *(F.col(f"__row.{c}").alias(c) for c in columns))


def _in_order(rows: list[tuple]) -> list[tuple]:
    return [r[1:] for r in sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))]


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, allowed: Column, *, per_class: int, columns: tuple[str, ...] = ("text",), id_col: str = "doc_id") -> list[tuple]:
    """``sample_of``, collected: 2 * per_class rows at most."""
    return _in_order([tuple(r) for r in sample_of(documents, labels, label, allowed, per_class=per_class, columns=columns, id_col=id_col).collect()])


def fitted(sample: DataFrame, fit: Callable[[list[tuple]], Any]) -> Any:
    """``fit`` of a sample's rows, run in one task, so that neither they nor the training burden the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [tuple(r.values()) for batch in batches for r in batch.to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(_in_order(rows)))], pa.binary())], ["model"])

    got = sample.repartition(1).mapInArrow(released(run), "model binary").first()
    return pickle.loads(got[0]) if got else fit([])

"""How far the sources of a language differ in their words, exactly, from joint count histograms.

Tasks count words of their documents by (lang, source) in bounded tables; Spark adds the counts up.
A kept term is then one row with a cell for each source that has it. For a pair of sources only the distinct
combinations of counts matter: combinations where both have the term come from the cells, those with a
zero on one side are implied by each source's own histogram, and those with two zeros by the number of
kept terms. The measure is computed once for each combination and multiplied.

The shares are integers, ``p = 1 + floor(UNIT * (count + 1) / (N + V))``, and so is the measure
``f = floor((p - q)**2 / q)``: no rounding depends on an order of summing.

Defined results: null text, lang and source are the empty string; a document without terms still
makes its source occur; repeated rows count each; a language without kept terms has pairs of
value 0 and no terms; an empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomlog.llm.common import materialize, released, slices

UNIT = 1_000_000_000
#: Words that a task holds before it hands their counts on, and bytes of text that it splits at once.
HELD, PIECE = 400_000, 1 << 20
#: ASCII letters become lower case, all other ASCII a blank; bytes of other characters stay.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
COUNTED = "lang string, source string, term string, docs long, n long"


def _pieces(raw: bytes) -> Iterator[list[bytes]]:
    """The words of a text, a bounded part of it at a time unless a single word is longer."""
    start = 0
    while start < len(raw):
        stop = raw.find(b" ", start + PIECE)
        stop = len(raw) if stop < 0 else stop
        yield raw[start:stop].split()
        start = stop


def _counted(held: dict) -> pa.RecordBatch:
    keys = [(*group, term, docs[term], n) for group, (docs, all_of) in held.items() for term, n in all_of.items()]
    langs, sources, terms, docs, counts = zip(*keys, strict=True) if keys else ((),) * 5
    return pa.RecordBatch.from_arrays(
        [pa.array(langs, pa.string()), pa.array(sources, pa.string()), pa.array(terms, pa.binary()).cast(pa.string()), pa.array(docs, pa.int64()), pa.array(counts, pa.int64())],
        ["lang", "source", "term", "docs", "n"],
    )


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, docs, n): documents that hold a term, and its occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        for batch in slices(batches, "text"):
            for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text")), strict=True):
                in_docs, all_of = held.setdefault((lang, source), (Counter(), Counter()))
                seen: set[bytes] = set()
                for words in _pieces(text.encode().translate(_TABLE)):
                    all_of.update(words)
                    seen.update(words)
                in_docs.update(seen)
            if sum(len(a) for _, a in held.values()) > HELD:
                yield _counted(held)
                held = {}
        if held:
            yield _counted(held)

    return docs.mapInArrow(released(run), COUNTED).groupBy("lang", "source", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"))


def share(n: Column, total: Column, terms: Column) -> Column:
    """p of a count; decimals, as counts times UNIT may pass a long."""
    return F.when(terms > 0, F.lit(1) + _div(F.lit(UNIT).cast("decimal(38,0)") * (n + 1).cast("decimal(20,0)"), (total + terms).cast("decimal(20,0)")))


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def measure(p: Column, q: Column) -> Column:
    """f; the square of a difference of shares is below 2**63."""
    return _div((p - q) * (p - q), q)


def divergence(docs: DataFrame, *, least_docs: int = 3, top: int = 200) -> DataFrame:
    """(lang, source, part, item, value, rank): ``pair`` against each other source, ``term`` for what a source has more of than its language.

    Terms are reported to rank ``top``, pairs all.
    """
    named = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    groups = named.select("lang", "source").distinct()
    cells = F.array_sort(F.collect_list(F.struct("source", "n")))  # one for each source
    kept = materialize(
        term_counts(named).groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("all_n"), cells.alias("cells")).where(F.col("docs") >= least_docs).drop("docs")
    )
    single = kept.select("lang", "term", "all_n", F.explode("cells").alias("cell")).select("lang", "term", "all_n", "cell.source", "cell.n")
    of_lang = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("all_n").alias("lang_total"))
    histogram = materialize(single.groupBy("lang", "source", "n").agg(F.count("*").alias("times")))
    totals = histogram.groupBy("lang", "source").agg(F.sum(F.col("n") * F.col("times")).alias("total"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    sizes = materialize(groups.join(totals, ["lang", "source"], "left").join(of_lang, "lang", "left").select("lang", "source", zero("total"), zero("terms"), zero("lang_total")))
    out = _pairs(kept, histogram, sizes).unionByName(_terms(single, sizes, top))
    return out.select("lang", "source", "part", "item", "value", "rank")


def _pairs(kept: DataFrame, histogram: DataFrame, sizes: DataFrame) -> DataFrame:
    """Both directions of every two sources of a language, from the histogram of their (count, count) combinations."""
    ends = sizes.select("lang", F.col("source").alias("a"), F.col("total").alias("total_a"), "terms").join(sizes.select("lang", F.col("source").alias("b"), F.col("total").alias("total_b")), "lang").where("a < b")
    first = kept.select("lang", "cells", F.posexplode("cells").alias("i", "x"))
    both = first.select("lang", "x", F.explode(F.expr("slice(cells, i + 2, size(cells))")).alias("y")).groupBy(
        "lang", F.col("x.source").alias("a"), F.col("y.source").alias("b"), F.col("x.n").alias("na"), F.col("y.n").alias("nb")
    ).agg(F.count("*").alias("times"))
    # What both have is no zero of either: each combination is taken out of the implied zeros.
    out = F.expr("array(named_struct('na', na, 'nb', nb, 'times', times), named_struct('na', na, 'nb', 0L, 'times', -times), named_struct('na', 0L, 'nb', nb, 'times', -times), named_struct('na', 0L, 'nb', 0L, 'times', times))")
    met = both.select("lang", "a", "b", F.explode(out).alias("c")).select("lang", "a", "b", "c.*")
    pairs = ends.select("lang", "a", "b", "terms")
    # All of a source's terms, as if the other had none; they and the other's are taken from the terms that neither has.
    sided = lambda n, z: F.expr(f"array(named_struct('{n}', n, '{z}', 0L, 'times', times), named_struct('{n}', 0L, '{z}', 0L, 'times', -times))")
    of_a = pairs.join(histogram.withColumnRenamed("source", "a"), ["lang", "a"]).select("lang", "a", "b", F.explode(sided("na", "nb")).alias("c")).select("lang", "a", "b", "c.na", "c.nb", "c.times")
    of_b = pairs.join(histogram.withColumnRenamed("source", "b"), ["lang", "b"]).select("lang", "a", "b", F.explode(sided("nb", "na")).alias("c")).select("lang", "a", "b", "c.na", "c.nb", "c.times")
    neither = pairs.select("lang", "a", "b", F.lit(0).cast("long").alias("na"), F.lit(0).cast("long").alias("nb"), F.col("terms").alias("times"))
    cells = met.unionByName(of_a).unionByName(of_b).unionByName(neither).groupBy("lang", "a", "b", "na", "nb").agg(F.sum("times").alias("times")).where("times > 0")
    shares = cells.join(ends, ["lang", "a", "b"]).select("lang", "a", "b", "times", share(F.col("na"), F.col("total_a"), F.col("terms")).alias("p"), share(F.col("nb"), F.col("total_b"), F.col("terms")).alias("q"))
    sums = shares.groupBy("lang", "a", "b").agg(F.sum(measure(F.col("p"), F.col("q")) * F.col("times")).alias("ab"), F.sum(measure(F.col("q"), F.col("p")) * F.col("times")).alias("ba"))
    valued = pairs.join(sums, ["lang", "a", "b"], "left").select("lang", F.explode(F.expr("array(named_struct('source', a, 'item', b, 'value', coalesce(ab, 0L)), named_struct('source', b, 'item', a, 'value', coalesce(ba, 0L)))")).alias("r")).select("lang", "r.*")
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return valued.withColumn("part", F.lit("pair")).withColumn("rank", F.row_number().over(by_value))


def _terms(single: DataFrame, sizes: DataFrame, top: int) -> DataFrame:
    shares = single.join(sizes, ["lang", "source"]).select(
        "lang", "source", F.col("term").alias("item"), share(F.col("n"), F.col("total"), F.col("terms")).alias("p"), share(F.col("all_n"), F.col("lang_total"), F.col("terms")).alias("q")
    )
    valued = shares.where("p > q").select("lang", "source", F.lit("term").alias("part"), "item", measure(F.col("p"), F.col("q")).alias("value"))
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return valued.withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= top)

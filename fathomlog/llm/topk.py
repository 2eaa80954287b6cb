"""Exact top-k by inner product with Fagin's threshold algorithm.

Candidates are written once in blocks of rows and never copied. Queries come in chunks of a
bounded size that every task gets, and a chunk meets the candidates in two rounds: a
sixteenth of them first, whose k-th best score is each query's threshold for all the rest.

A block keeps a sorted list per dimension. For a query, the lists are read from their better
ends; what has been read to some depth bounds every vector not yet seen by the sum over
dimensions of the query's component times the list's value there. The scan stops at the
shallowest depth (of a grid, nothing read being the first) whose bound is below the
threshold, or below the k-th best score of the block's first accesses, since a bound that
equals it could still hide a tie. Everything read to that depth is scored. When that would
read more entries than the block has vectors, all of them are scored at once. Only scores
that reach the threshold leave a block, so what is shuffled grows with the queries and
not with queries times blocks. The best are merged per query, ties to the smaller id.

Components become integers, floor(scale * x), held in doubles: scores are exact while
they stay under 2**53.

Defined results: vectors that are null, empty, or hold null, NaN or infinite components
take no part, nor do null ids; only vectors of the query's dimension are candidates; a
query never meets a row of its own id; repeated rows count each, though only one of them is
scored; fewer candidates than k give fewer rows; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomlog.llm.common import materialize, released

#: Vectors of a block, at most, and queries that meet the candidates together.
CANDIDATES, QUERIES = 16384, 4096
#: One in so many candidates gives the thresholds for the rest.
SEEDS = 16
#: First accesses to each list, and the least share of a block that must be saved for a partial scan.
FIRST, WORTH = 8, 0.5


class SortedLists:
    """A block's vectors with one sorted list per dimension."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        by_id = np.argsort(ids, kind="stable")  # ties in score go to the earlier row
        self.ids, self.x = ids[by_id], np.ascontiguousarray(vectors[by_id])
        self.order = np.argsort(self.x, axis=0, kind="stable")
        n = len(ids)
        self.depths = np.unique(np.minimum(np.concatenate(([0], np.geomspace(1, n, 40))).astype(np.int64), n - 1))
        self.low = np.take_along_axis(self.x, self.order[self.depths], 0)
        self.high = np.take_along_axis(self.x, self.order[n - 1 - self.depths], 0)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """For each query and depth, what no vector unseen down to that depth can exceed."""
        return np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T

    def read(self, query: np.ndarray, depth: int) -> np.ndarray:
        """Rows in the first ``depth`` places of the lists, each read from the query's better end."""
        up, down = np.flatnonzero(query > 0), np.flatnonzero(query < 0)
        return np.unique(np.concatenate((self.order[len(self.x) - depth :, up].ravel(), self.order[:depth, down].ravel())))

    def best(self, query_ids: np.ndarray, queries: np.ndarray, k: int, floor: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """(ids, scores) for each query: its k best here that reach its ``floor``, best first."""
        return [(self.ids[rows], scores) for rows, scores in self.best_rows(query_ids, queries, k, floor)]

    def best_rows(self, query_ids: np.ndarray, queries: np.ndarray, k: int, floor: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """``best`` by the places of its vectors in the order of ids."""
        n, out = len(self.x), [None] * len(queries)
        floor = np.full(len(queries), -np.inf) if floor is None else floor
        bounds = self.bounds(queries)
        whole = []
        for i, query in enumerate(queries):
            if bounds[i, 0] < floor[i]:  # nothing here reaches it
                out[i] = self._top(np.zeros(0, np.int64), np.zeros(0), k)
                continue
            fits = np.flatnonzero(bounds[i] < floor[i])
            if not len(fits) or self.depths[fits[0]] > FIRST:  # a block's own scores may allow to stop earlier
                seen, scores = self._scored(query_ids[i], query, min(FIRST, n))
                kth = np.partition(scores, -k)[-k] if len(scores) >= k else -np.inf
                fits = np.flatnonzero(bounds[i] < max(kth, floor[i]))
            depth = int(self.depths[fits[0]]) + 1 if len(fits) else n
            if not query.any() or depth * np.count_nonzero(query) > WORTH * n:
                whole.append(i)
                continue
            seen, scores = self._scored(query_ids[i], query, max(depth, min(FIRST, n)))
            reach = scores >= floor[i]
            out[i] = self._top(seen[reach], scores[reach], k)
        for at in range(0, len(whole), 128):  # every vector is seen
            some = whole[at : at + 128]
            scores = queries[some] @ self.x.T
            rows = np.arange(n)
            for j, i in enumerate(some):
                lo, hi = np.searchsorted(self.ids, (query_ids[i], query_ids[i] + 1))
                scores[j, lo:hi] = -np.inf
            kths = np.partition(scores, max(0, n - k), axis=1)[:, max(0, n - k)]
            for j, i in enumerate(some):
                own = rows[scores[j] >= max(kths[j], floor[i])]
                out[i] = self._top(own, scores[j][own], k)
        return out

    def _scored(self, query_id: int, query: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        seen = self.read(query, depth)
        scores = self.x[seen] @ query
        scores[self.ids[seen] == query_id] = -np.inf
        return seen, scores

    def _top(self, rows: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((rows, -scores))[:k]
        order = order[np.isfinite(scores[order])]
        return rows[order], scores[order]


def _matrix(column: pa.Array | pa.ChunkedArray, n: int, scale: int) -> np.ndarray:
    flat = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten().to_numpy(zero_copy_only=False)
    return np.floor(scale * flat.reshape(n, -1))


def _search(candidates: DataFrame, asked: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], k: int, scale: int) -> DataFrame:
    """(n, id, copies, score): what each query (its number n) finds. asked: by dimension, (numbers, ids, vectors, floors) of the queries."""
    shared = candidates.sparkSession.sparkContext.broadcast(asked)  # QUERIES rows

    def found(block: pa.Table) -> Iterator[pa.RecordBatch]:
        for dim in np.unique(block.column("dim").to_numpy()):
            if dim not in shared.value:
                continue
            own = block.filter(pa.array(block.column("dim").to_numpy() == dim))
            ids, copies = own.column("id").to_numpy(), own.column("copies").to_numpy()
            lists = SortedLists(ids, _matrix(own.column("v"), len(ids), scale))
            copies = copies[np.argsort(ids, kind="stable")]
            numbers, query_ids, vectors, floors = shared.value[dim]
            for at in range(0, len(numbers), 512):
                some = slice(at, at + 512)
                got = lists.best_rows(query_ids[some], vectors[some], k, floors[some])
                at_rows, scores = (np.concatenate([x[j] for x in got]) for j in (0, 1))
                numbered = np.repeat(numbers[some], [len(r) for r, _ in got])
                yield pa.RecordBatch.from_arrays([pa.array(numbered, pa.int64()), pa.array(lists.ids[at_rows]), pa.array(copies[at_rows]), pa.array(scores.astype(np.int64))], ["n", "id", "copies", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, CANDIDATES):
                part = batch.slice(at, CANDIDATES)
                if held and size + part.num_rows > CANDIDATES:
                    yield from found(pa.Table.from_batches(held))
                    held, size = [], 0
                held.append(part)
                size += part.num_rows
        if held:
            yield from found(pa.Table.from_batches(held))

    return candidates.select("id", "v", "dim", "copies").mapInArrow(released(run), "n long, id long, copies long, score long")


def top_k(df: DataFrame, is_query: Column, *, k: int = 20, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, id, score) for the rows of ``df`` where ``is_query`` holds, against all its rows."""
    spark = df.sparkSession
    vector = F.col(vector_col)
    real = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = df.where(F.col(id_col).isNotNull() & vector.isNotNull() & (F.size(vector) > 0) & real).select(
        F.col(id_col).cast("long").alias("id"), vector.cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("q")
    )
    # Repeated rows are one with a count, so that none fills a block.
    once = rows.groupBy("id", "v").agg(F.count("*").alias("copies"), F.count_if("q").alias("q")).withColumn("dim", F.size("v"))
    once = materialize(once)
    n, m = once.agg(F.count("*"), F.count_if(F.col("q") > 0)).first()
    if not m:
        return spark.createDataFrame([], f"query_id long, rank int, {id_col} long, score long")
    tasks = max(-(-n // CANDIDATES), min(2 * spark.sparkContext.defaultParallelism, -(-n // 512)))
    seed = F.pmod(F.xxhash64("id", "v", F.lit(1)), F.lit(SEEDS)) == 0
    dealt = materialize(once.withColumn("seed", seed).repartition(tasks, F.xxhash64("id", "v")))
    chunks = -(-m // QUERIES)
    chunk = F.pmod(F.xxhash64("id", "v", F.lit(2)), F.lit(chunks))
    parts = []
    for c in range(chunks):
        queries = dealt.where("q > 0").where(chunk == c).select("id", "v", "dim", "q").toArrow()  # QUERIES rows or so
        ids, dims, times = (queries.column(x).to_numpy() for x in ("id", "dim", "q"))
        number = np.arange(len(ids))
        vectors = {d: _matrix(queries.filter(pa.array(dims == d)).column("v"), int((dims == d).sum()), scale) for d in np.unique(dims)}
        asked = {d: (number[dims == d], ids[dims == d], x, np.full(len(x), -np.inf)) for d, x in vectors.items()}
        first = materialize(_search(dealt.where("seed"), asked, k, scale))
        by_score = F.row_number().over(Window.partitionBy("n").orderBy(F.desc("score"), "id"))
        floors = first.withColumn("r", by_score).where(F.col("r") == k).select("n", "score").toArrow()
        floor = np.full(len(ids), -np.inf)
        floor[floors.column("n").to_numpy()] = floors.column("score").to_numpy()
        asked = {d: (a, b, x, floor[a]) for d, (a, b, x, _) in asked.items()}
        rest = _search(dealt.where("not seed"), asked, k, scale)
        named = spark.createDataFrame(pa.table({"n": pa.array(number, pa.int64()), "query_id": pa.array(ids), "times": pa.array(times)}))
        parts.append(first.union(rest).join(F.broadcast(named), "n"))  # QUERIES rows
    every = parts[0]
    for part in parts[1:]:
        every = every.union(part)
    copies = F.least(F.col("copies") * F.col("times"), F.lit(k)).cast("int")
    met = every.select("query_id", "id", "score", F.explode(F.array_repeat(F.lit(1), copies)).alias("one"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return met.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")

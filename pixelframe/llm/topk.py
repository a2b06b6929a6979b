"""Exact top-k search by inner product with multi-resolution segment statistics.

Vectors are turned into integers, floor(256 x). A vector is cut into segments at a few resolutions, and each segment keeps
its mean and its deviation. For two vectors, sum over segments of length * ((difference of means)^2 + (difference of
deviations)^2) is a lower bound of their squared distance, so (|q|^2 + |c|^2 - bound) / 2 is an upper bound of their
inner product. Candidates are looked at from coarse to fine: pairs whose bound stays below the query's k-th best score so
far go, and exact scores are computed for the surviving pairs alone (pair by pair once few are left, else as one product).

Each query starts with a floor: its k-th best exact score among a bounded sample of candidates, the queries themselves (at
most SEEDS of them). Queries of at most QUERY_BYTES, counted beforehand, are sent to all tasks, and the candidates stay
where they are. More queries meet all rows in blocks of QUERY_ROWS by ROW_BLOCK; one task handles one pair of blocks, whose
size does not depend on the data. A task returns at most k rows for each of its queries, only those at or above its floor;
these meet by query and the best k stay.

Defined results: rows with a null id, a null vector or a null or non-finite component take no part; vectors of another
length than the query's are no candidates; rows with the query's own id are no candidates; repeated candidate rows each
count, and take a rank each; equal (id, vector) rows are one query, and different vectors of one id are queries of their
own; ties go to the smaller id; an empty table gives an empty table. Scores outside the range of long stop at its ends.
Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pixelframe.llm.common import bounded_arrow, release, released

#: Components in a segment at each resolution, coarse to fine.
SEGMENTS = (16, 4, 2)
QUERY_BYTES, QUERY_ROWS, ROW_BLOCK, SEEDS = 8 << 20, 16384, 65536, 2048
#: Queries and candidates compared at once; the share of surviving pairs below which they are looked at one by one.
QUERY_CHUNK, CHUNK, FEW = 512, 2048, 1 / 32
PAIRS = 1 << 14
#: Sums of products are exact in doubles up to here.
EXACT = float(1 << 53)


def statistics(x: np.ndarray, size: int) -> np.ndarray:
    """Means and deviations of the segments, scaled by the root of their length: squared differences of these sum to the bound."""
    x = np.pad(x, ((0, 0), (0, -x.shape[1] % size))).reshape(len(x), -1, size)
    return np.concatenate([x.mean(2), x.std(2)], axis=1) * math.sqrt(size)


def _pair_products(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    parts = [np.einsum("nd,nd->n", a[i[at : at + PAIRS]], b[j[at : at + PAIRS]]) for at in range(0, len(i), PAIRS)]
    return np.concatenate(parts) if parts else np.empty(0)


class Search:
    """The k best rows of each query among the rows shown to it, ties to the smaller id. All vectors have one length."""

    def __init__(self, queries: np.ndarray, query_ids: np.ndarray, k: int, floor: np.ndarray | None = None) -> None:
        self.queries, self.ids, self.k = queries, query_ids, k
        self.floor = np.full(len(queries), -np.inf) if floor is None else floor.astype(float)
        self.norms, self.stats = (queries**2).sum(1), [statistics(queries, s) for s in SEGMENTS]
        self.most = float(np.abs(queries).max(initial=0))
        self.large: list[tuple[int, int, int]] = []
        none = np.empty(0, np.int64)
        self.found = {at: (none, none, np.empty(0)) for at in range(0, len(queries), QUERY_CHUNK)}
        self.pairs, self.survivors = 0, [0] * len(SEGMENTS)

    def show(self, rows: np.ndarray, row_ids: np.ndarray) -> None:
        if self.most * float(np.abs(rows).max(initial=0)) * rows.shape[1] > EXACT:
            self._show_large(rows, row_ids)
            return
        for at in range(0, len(rows), CHUNK):
            c, ids = rows[at : at + CHUNK], row_ids[at : at + CHUNK]
            norms, stats = (c**2).sum(1), [statistics(c, s) for s in SEGMENTS]
            for start in self.found:
                self._meet(start, c, ids, norms, stats)

    def _meet(self, start: int, c: np.ndarray, ids: np.ndarray, norms: np.ndarray, stats: list[np.ndarray]) -> None:
        own = slice(start, start + QUERY_CHUNK)
        q, floor = self.queries[own], self.floor[own]
        alive = self.ids[own][:, None] != ids[None, :]
        self.pairs += int(alive.sum())
        need = np.add.outer(floor - 0.5 - 1e-9 * self.norms[own], -1e-9 * norms)  # with room for rounding
        i = j = None
        for level, (a, b) in enumerate(zip((s[own] for s in self.stats), stats, strict=True)):
            # |a - b|^2 = |a|^2 + |b|^2 - 2ab on the statistics, whose own squared sums are the vectors' norms
            if i is None:
                alive &= a @ b.T >= need
                left = int(np.count_nonzero(alive))
                if left < FEW * alive.size:
                    i, j = np.nonzero(alive)
            else:
                stay = _pair_products(a, b, i, j) >= need[i, j]
                i, j = i[stay], j[stay]
                left = len(i)
            self.survivors[level] += left
        if i is None:
            scores = q @ c.T
            i, j = np.nonzero(alive & (scores >= floor[:, None]))
            scores = scores[i, j]
        else:
            scores = _pair_products(q, c, i, j)
            stay = scores >= floor[i]
            i, j, scores = i[stay], j[stay], scores[stay]
        if not len(i):
            return
        self.found[start] = held = _first_k(*(np.concatenate(x) for x in zip(self.found[start], (i, ids[j], scores), strict=True)), self.k)
        counts = np.bincount(held[0], minlength=len(q))
        full = counts >= self.k
        floor[full] = np.maximum(floor[full], held[2][(np.cumsum(counts) - 1)[full]])

    def _show_large(self, rows: np.ndarray, row_ids: np.ndarray) -> None:
        """The same with integers of any size, for components whose products doubles can't hold."""
        exact_q, exact_r = [[[int(v) for v in x] for x in y] for y in (self.queries, rows)]
        for i, q in enumerate(exact_q):
            self.large += [(i, int(row_ids[j]), sum(a * b for a, b in zip(q, r, strict=True))) for j, r in enumerate(exact_r) if row_ids[j] != self.ids[i]]
        best: dict[int, list] = {}
        for i, j, s in self.large:
            best.setdefault(i, []).append((-s, j))
        self.large = [(i, j, -s) for i, x in best.items() for s, j in sorted(x)[: self.k]]

    def results(self) -> Iterator[tuple[int, int, int]]:
        """(index of query, row id, score)."""
        for start, (i, j, s) in self.found.items():
            yield from zip((i + start).tolist(), j.tolist(), map(int, s), strict=True)
        yield from self.large


def _first_k(q: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores, q))
    q, ids, scores = q[order], ids[order], scores[order]
    place = np.arange(len(q)) - np.searchsorted(q, q)
    return q[place < k], ids[place < k], scores[place < k]


def _whole(vectors: np.ndarray) -> np.ndarray:
    return np.floor(vectors * 256.0) + 0.0  # -0.0 is 0.0


def _matrix(column: pa.ChunkedArray | pa.Array, d: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return _whole(column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)) if d else np.zeros((len(column), 1))


def floors(queries: np.ndarray, query_ids: np.ndarray, sample: np.ndarray, sample_ids: np.ndarray, k: int) -> np.ndarray:
    """Each query's k-th best score in the sample, or -inf."""
    search = Search(queries, query_ids, k)
    if search.most * float(np.abs(sample).max(initial=0)) * queries.shape[1] <= EXACT:
        search.show(sample, sample_ids)
    return search.floor


def top_k(df: DataFrame, k: int = 5, *, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 50) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by `every`, its k best other rows."""
    spark = df.sparkSession
    bounded_arrow(spark)
    v = F.col("v")
    src = df.select(df[id_col].cast("long").alias("id"), df[vector_col].cast("array<double>").alias("v"))
    src = src.where(F.col("id").isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))))
    src = src.withColumn("d", F.size("v"))
    queries = src.where(F.col("id") % every == 0).distinct().withColumn("q", F.xxhash64("id", "v"))
    held = queries.agg(F.count("*").alias("n"), F.sum(F.col("d") * 8 + 24).alias("bytes")).first()
    found = _sent(queries, src, k) if (held["bytes"] or 0) <= QUERY_BYTES else _in_blocks(queries, src, k, held["n"])
    w = Window.partitionBy("query_id", "q").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


RESULT = "query_id long, q long, vec_id long, score long"


def _result(rows: list[tuple[int, int, int, int]]) -> dict[str, pa.Array]:
    lo, hi = -(1 << 63), (1 << 63) - 1
    query, q, row, score = zip(*rows, strict=True) if rows else ((), (), (), ())
    return {n: pa.array(x, pa.int64()) for n, x in zip(("query_id", "q", "vec_id", "score"), (query, q, row, [min(max(s, lo), hi) for s in score]), strict=True)}


def searcher(queries: pa.Table, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The function that shows rows (id, v, d) to the queries (id, v, d, q) of their length, starting from their floors."""
    held = {}
    for d in set(queries.column("d").to_pylist()):
        own = queries.filter(pc.equal(queries.column("d"), d))
        ids, x = own.column("id").to_numpy(), _matrix(own.column("v"), d)
        some = np.random.default_rng(1).permutation(len(x))[:SEEDS]
        held[d] = (ids, own.column("q").to_numpy(), x, floors(x, ids, x[some], ids[some], k))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searches = {d: Search(x, ids, k, floor.copy()) for d, (ids, _, x, floor) in held.items()}
        for batch in batches:
            for d in set(batch.column("d").to_pylist()) & set(held):
                own = batch.filter(pc.equal(batch.column("d"), d))
                searches[d].show(_matrix(own.column("v"), d), own.column("id").to_numpy())
        for d, s in searches.items():
            ids, q, *_ = held[d]
            rows = [(int(ids[i]), int(q[i]), j, score) for i, j, score in s.results()]
            for at in range(0, len(rows), 10_000):
                yield pa.RecordBatch.from_pydict(_result(rows[at : at + 10_000]))

    return search


def _sent(queries: DataFrame, src: DataFrame, k: int) -> DataFrame:
    """All rows, where they are, before queries that were counted small."""
    return src.mapInArrow(released(searcher(queries.toArrow(), k)), RESULT)


def _in_blocks(queries: DataFrame, src: DataFrame, k: int, n_queries: int) -> DataFrame:
    q_blocks, r_blocks = max(1, math.ceil(n_queries / QUERY_ROWS)), max(1, math.ceil(src.count() / ROW_BLOCK))
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.withColumn("qb", F.pmod("q", F.lit(q_blocks)).cast("int")).withColumn("rb", upto(r_blocks))
    # the row's number takes part, so that a repeated id is no hot block
    right = src.withColumn("rb", F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(r_blocks)).cast("int")).withColumn("qb", upto(q_blocks))

    def meet(queries: pa.Table, rows: pa.Table) -> pa.Table:
        out = []
        if queries.num_rows and rows.num_rows:
            out = list(searcher(queries, k)(iter(rows.select(["id", "v", "d"]).to_batches(CHUNK))))
        release()
        return pa.Table.from_batches(out) if out else pa.table(_result([]))

    keys = ("d", "qb", "rb")
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, RESULT)


def oracle(k: int = 5, every: int = 50) -> str:
    return f"""
WITH v AS (
  SELECT vec_id, embedding AS e, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), q AS (
  SELECT DISTINCT vec_id, e, v FROM v WHERE vec_id % {every} = 0
), s AS (
  SELECT q.vec_id AS query_id, q.e, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
)
SELECT query_id, rank::INT AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id, e ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= {k}
"""

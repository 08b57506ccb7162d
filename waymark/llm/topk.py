"""Exact top-k search by inner product: three phases with a uniform threshold."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from waymark.llm.store import materialize, new_path

#: Candidates and queries that are compared at a time, and slices of the components.
BLOCK, QUERIES, SLICES = 4096, 512, 8
#: Bytes of queries that go out with one pass over the candidates (a counted bound; more queries take more passes).
BROADCAST_BYTES = 16 << 20
#: One of so many candidates is in the local score lists of the first phase; any choice gives a safe cutoff.
LISTED = 8
#: Share of a block's entries that may still reach the cutoff at which the rest is resolved entry by entry.
SPARSE = 1 / 16
#: Entries resolved at a time.
ENTRIES = 1 << 16
NONE = -(2**62)


def integer_vectors(rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = 1024) -> DataFrame:
    """vec_id and v: floor(scale * x) of every component; vectors with null or non-finite components are left out."""
    e = F.col(embedding).cast("array<double>")
    bad = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(F.col(vec_id).isNotNull() & e.isNotNull() & ~bad).select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(e, lambda x: F.floor(x * F.lit(float(scale))).cast("long")).alias("v"))


class Slices:
    """Vectors cut into slices of their components, with the norm of what follows each slice."""

    def __init__(self, v: np.ndarray):
        self.v, width = v, v.shape[1]
        self.cuts = np.linspace(0, width, SLICES + 1).astype(int)
        squares = np.square(v.astype(np.float64))
        self.rest = [np.sqrt(squares[:, b:].sum(1)) for b in self.cuts[1:]]


def _numbers(q: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whole numbers as floating ones where every sum of products is exact, which multiplies faster."""
    if float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(q.shape[1], 1) < 2**53:
        return q.astype(np.float64), c.astype(np.float64)
    return q, c


def _same(q_ids: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (query, candidate) with the same id."""
    order = np.argsort(ids, kind="stable")
    lo, hi = np.searchsorted(ids[order], q_ids, "left"), np.searchsorted(ids[order], q_ids, "right")
    n = hi - lo
    return np.repeat(np.arange(len(q_ids)), n), order[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]


def listed(q: np.ndarray, c: np.ndarray, own: tuple[np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, int]:
    """First phase: the local score list of every query, its k highest scores among every LISTED-th candidate, and the products it took.

    Entries of a query's own id have the score NONE.
    """
    part = c[::LISTED]
    score = q @ part.T
    i, j = own[0][own[1] % LISTED == 0], own[1][own[1] % LISTED == 0] // LISTED
    score[i, j] = NONE
    return (np.partition(score, len(part) - k, axis=1)[:, len(part) - k :] if len(part) > k else score), score.size * c.shape[1]


def collected(q: Slices, c: Slices, own: tuple[np.ndarray, np.ndarray], cutoff: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Second and third phase: entries (query, candidate, score) that reach their query's cutoff, and the products it took.

    The cutoff is shared evenly among the slices.  After every slice, an entry
    may lack so much of its shares as the other slices can have above theirs (by
    the norms of what is left, their sum is at most their product); entries that
    lack more go.  Slices are multiplied as a whole for queries with many entries
    left; where few are left, these are the collected ones, and their remaining
    components are resolved exactly, entry by entry.
    """
    width = q.v.shape[1]
    score = np.zeros((len(q.v), len(c.v)), q.v.dtype)
    left = np.ones(score.shape, bool)
    left[own] = False
    products, out = 0, []

    def resolve(rows: np.ndarray, at: int) -> int:
        """Entries left of ``rows`` whose components from ``at`` on are missing."""
        i, j = np.nonzero(left[rows])
        i = rows[i]
        found = score[i, j]
        for x in range(0, len(i) if at < width else 0, ENTRIES):
            some = slice(x, x + ENTRIES)
            found[some] += np.einsum("ij,ij->i", q.v[i[some], at:], c.v[j[some], at:])
        good = found >= cutoff[i]
        out.append((i[good], j[good], found[good]))
        return len(i) * (width - at)

    rows = np.arange(len(q.v))
    for n, (a, b) in enumerate(zip(q.cuts, q.cuts[1:])):
        columns = np.flatnonzero(left[rows].any(0))
        if len(rows) * len(columns) < 0.75 * left.size:
            score[np.ix_(rows, columns)] += q.v[rows, a:b] @ c.v[columns, a:b].T
            products += len(rows) * len(columns) * (b - a)
        else:
            score += q.v[:, a:b] @ c.v[:, a:b].T
            products += left.size * (b - a)
        if b < width and (q.rest[n][rows] * c.rest[n].max(initial=0) > cutoff[rows]).all():
            continue  # entries without a score so far could all reach the cutoff: next to none would go
        most = np.multiply.outer(q.rest[n][rows], c.rest[n])
        left[rows] &= score[rows] + (most * (1 + 1e-9) + 1e-6) >= cutoff[rows, None]
        few = np.count_nonzero(left[rows], axis=1) <= SPARSE * len(c.v)
        products += resolve(rows[few], b)
        rows = rows[~few]
        if not len(rows):
            break
    products += resolve(rows, width)
    return *(np.concatenate(x) for x in zip(*out)), products


class Lists:
    """First phase of one task: the k highest listed scores of every query."""

    def __init__(self, q_ids: np.ndarray, cutoff: np.ndarray | None, k: int):
        self.q_ids, self.k = q_ids, k
        self.best = np.full((len(q_ids), k), NONE, np.int64)

    def add(self, rows: slice, q: Slices, c: Slices, ids: np.ndarray) -> None:
        score, _ = listed(q.v, c.v, _same(self.q_ids[rows], ids), self.k)
        both = np.concatenate([self.best[rows], score.astype(np.int64)], 1)
        self.best[rows] = np.partition(both, both.shape[1] - self.k, axis=1)[:, both.shape[1] - self.k :]

    def hits(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        i, j = np.nonzero(self.best > NONE)
        return i, np.zeros(len(i), np.int64), self.best[i, j]


class Hits:
    """Last phases of one task: the k best entries of every query, and the cutoff, which rises to the k-th of them."""

    def __init__(self, q_ids: np.ndarray, cutoff: np.ndarray, k: int):
        self.q_ids, self.k = q_ids, k
        self.cutoff = np.where(cutoff == NONE, -np.inf, cutoff.astype(np.float64))
        self.row, self.id, self.score = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, rows: slice, q: Slices, c: Slices, ids: np.ndarray) -> None:
        i, j, score, _ = collected(q, c, _same(self.q_ids[rows], ids), self.cutoff[rows])
        if not len(i):
            return
        row, own, score = np.concatenate([self.row, i + rows.start]), np.concatenate([self.id, ids[j]]), np.concatenate([self.score, score.astype(np.int64)])
        order = np.lexsort((own, -score, row))
        row = row[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        kept = order[rank < self.k]
        self.row, self.id, self.score = row[rank < self.k], own[kept], score[kept]
        last = np.flatnonzero(rank == self.k - 1)
        np.maximum.at(self.cutoff, row[last], score[order[last]].astype(np.float64))

    def hits(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.row, self.id, self.score


HITS = "query_id long, query_key long, vec_id long, score long"


def _search(queries, phase: type, k: int) -> Callable:
    """The work of a task: its candidates, block by block, against all queries of a pass; at the end what it holds of every query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = {width: phase(q_ids, cutoff, k) for width, (q_ids, _, _, cutoff) in queries.value.items()}
        for batch in batches:
            v, ids = batch.column("v"), batch.column("vec_id").to_numpy()
            widths = v.value_lengths().to_numpy()
            for width in np.unique(widths).tolist():
                if width not in state:
                    continue
                at = np.flatnonzero(widths == width)
                for a in range(0, len(at), BLOCK):
                    some = at[a : a + BLOCK]
                    c = v.take(pa.array(some)).flatten().to_numpy(zero_copy_only=False).reshape(len(some), width)
                    for b in range(0, len(queries.value[width][0]), QUERIES):
                        rows = slice(b, b + QUERIES)
                        q, own = _numbers(queries.value[width][2][rows], c)
                        state[width].add(rows, Slices(q), Slices(own), ids[some])
        for width, held in state.items():
            row, vec_id, score = held.hits()
            q_ids, q_keys, *_ = queries.value[width]
            for a in range(0, len(row), 1 << 16):
                some = slice(a, a + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(x[some], pa.int64()) for x in (q_ids[row], q_keys[row], vec_id, score)], names=["query_id", "query_key", "vec_id", "score"])

    return run


def _passes(vectors: DataFrame, queries: DataFrame, n: int, phase: type, k: int, label: str) -> DataFrame:
    """Hits of all queries: a pass over the candidates for each of the ``n`` lots of queries, which are bounded in bytes and go out with the tasks."""
    spark = vectors.sparkSession
    path = new_path(spark, label)
    for lot in range(n):
        table = queries.where(F.col("lot") == lot).drop("lot").toArrow()
        packed = {}
        widths = table["width"].to_numpy()
        for width in np.unique(widths).tolist():
            some = table.take(pa.array(np.flatnonzero(widths == width)))
            v = some["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(some), width)
            packed[width] = (some["vec_id"].to_numpy(), some["query_key"].to_numpy(), v, some["cutoff"].to_numpy())
        shared = spark.sparkContext.broadcast(packed)
        vectors.mapInArrow(_search(shared, phase, k), HITS).write.parquet(f"{path}/lot={lot}")
        shared.unpersist()
    return spark.read.schema(HITS).parquet(path).select(*[x.split()[0] for x in HITS.split(", ")])


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """The k highest inner products of every query: query_id, rank, vec_id, score.

    Both tables have vec_id and v (array of longs).  A query's own row (same
    vec_id) is no candidate; ties go to the smaller vec_id.  Repeated candidates
    count each; equal repeated queries count once; vectors of another width are
    no candidates.  Without candidates or queries there are no rows.

    Candidates are never moved: tasks stream them past the queries, which go out
    in lots of bounded bytes.  Phase 1 gathers local score lists (see
    ``listed``) and takes the k-th best gathered score of each query as a safe
    cutoff; phases 2 and 3 go over the candidates again with the cutoffs (see
    ``collected``).  A task gives at most k entries per query, so a vector with
    very many copies floods nothing.
    """
    key = F.xxhash64("v")
    q = queries.select("vec_id", "v", key.alias("query_key"), F.size("v").alias("width")).distinct()
    q = materialize(q, "topk-queries")
    size = q.agg(F.coalesce(F.sum(F.col("width") + 5), F.lit(0))).first()[0] * 8
    n = max(1, -(-size // max(1, BROADCAST_BYTES))) if BROADCAST_BYTES else max(1, q.count())
    q = q.withColumn("lot", F.pmod(F.xxhash64("vec_id", "query_key"), F.lit(n)))
    vectors = materialize(vectors.select("vec_id", "v"), "topk-vectors")
    best = Window.partitionBy("query_id", "query_key").orderBy(F.col("score").desc(), "vec_id")
    lists = _passes(vectors, q.withColumn("cutoff", F.lit(NONE)), n, Lists, k, "topk-lists")
    cutoffs = lists.withColumn("rank", F.row_number().over(best)).where(F.col("rank") == k).select(F.col("query_id").alias("c_id"), F.col("query_key").alias("c_key"), F.col("score").alias("cutoff"))
    cut = q.join(cutoffs, (q["vec_id"] == F.col("c_id")) & (q["query_key"] == F.col("c_key")), "left").drop("c_id", "c_key").withColumn("cutoff", F.coalesce("cutoff", F.lit(NONE)))
    hits = _passes(vectors, materialize(cut, "topk-cutoffs"), n, Hits, k, "topk-hits")
    return hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_top_k_search(spark, sf_dir: str) -> DataFrame:
    """Top 10 of every hundredth vector of ``embeddings`` among all: see ``top_k``.

    Vectors that are null or hold null or non-finite components take no part;
    an empty table gives no rows.
    """
    vectors = integer_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return top_k(vectors, vectors.where(F.col("vec_id") % 100 == 0))


SQL = r"""
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND NOT list_bool_or(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)))
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 10
"""

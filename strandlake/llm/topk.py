"""Exact top-k inner products by the threshold algorithm over sorted per-dimension lists.

Candidates are dealt into blocks, queries into blocks of their own; each pair of blocks is one unit of
work. A block's vectors are rotated onto their principal components, of which as many as hold nearly
all of their length become dimensions; the length of what is left is one more. For each dimension the
block keeps its rows sorted by it. For a query the lists are read from the better end in steps; rows
met are scored in full, on the unrotated integers. Once the k-th best score is above what any row
further down all lists could reach (the sum of the lists' edges by the query's components), the search
stops; if most rows have been met before that, the others are scored too, and lists aren't read on.
Blocks' best k are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import rows_only


#: Share of the vectors' squared length that the dimensions with lists of their own hold at least.
HELD = 0.99


class SortedLists:
    def __init__(self, ids: np.ndarray, x: np.ndarray, rows: np.ndarray | None = None):
        order = np.argsort(ids, kind="stable")  # so that a smaller row number is a smaller id
        self.ids, self.x = ids[order], x[order]
        self.numbers = self.ids if rows is None else rows[order]
        # Sums of products stay exact in doubles up to 2 ** 53.
        self.big = big = float(np.abs(self.x).max(initial=0))
        self.exact = x.shape[1] * big * big < 2**53
        self.f = self.x.astype(np.float64)
        power, turn = np.linalg.eigh(self.f.T @ self.f)
        turn, power = turn[:, ::-1], np.maximum(power[::-1], 0)
        m = min(x.shape[1], int(np.searchsorted(np.cumsum(power), HELD * power.sum())) + 1)
        self.turn = turn[:, :m]
        y = self.f @ self.turn
        rest = np.sqrt(np.maximum((self.f**2).sum(1) - (y**2).sum(1), 0))
        y = np.column_stack([y, rest])
        self.rows = np.argsort(y, axis=0, kind="stable").T.copy()
        self.sorted = np.sort(y, axis=0).T.copy()
        # Rotated numbers are rounded; bounds are raised by more than that.
        self.slack = 1e-9 * x.shape[1] * (1 + big)
        self.scored = 0

    def search(self, q: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best rows but row ``own``, ties to smaller ids; ``scored`` counts the rows scored."""
        n = len(self.ids)
        if self.exact and float(np.abs(q).max(initial=0)) * self.big * len(q) < 2**53:
            x, weight = self.f, q.astype(np.float64)
        else:
            x, weight = self.x, q
        turned = q @ self.turn
        turned = np.append(turned, np.sqrt(max(0.0, float((q.astype(np.float64) ** 2).sum() - (turned**2).sum()))))
        slack = self.slack * (1 + float(np.abs(q).max(initial=0)))
        lists = np.flatnonzero(np.abs(turned) > 0)
        turned = turned[lists]
        unseen = self.numbers != own
        at, score = np.empty(0, np.int64), np.empty(0, weight.dtype)
        down = turned > 0
        depth, step = 0, max(2 * k, n // 128)
        while unseen.any():
            end = min(n, depth + step)
            mark = np.zeros(n, bool)
            mark[self.rows[lists[~down], depth:end]] = True
            mark[self.rows[lists[down], n - end : n - depth]] = True
            if not len(lists):
                mark[depth:end] = True
            fresh = mark & unseen
            unseen &= ~mark
            if 2 * np.count_nonzero(unseen) < n:  # once most rows have been met, the rest is scored without further reading of lists
                at = np.flatnonzero(self.numbers != own)
                self.scored += np.count_nonzero(unseen | fresh)
                score = (x @ weight)[at]
                break
            fresh = np.flatnonzero(fresh)
            self.scored += len(fresh)
            at = np.concatenate([at, fresh])
            score = np.concatenate([score, x[fresh] @ weight])
            at, score = _best(at, score, k)
            edge = np.where(down, self.sorted[lists, n - end], self.sorted[lists, end - 1])
            if len(lists) and len(at) >= k and score.min() > (edge * turned).sum() + slack:
                break
            depth, step = end, step + step // 2
        at, score = _best(at, score, k)
        return self.ids[at], score.astype(np.int64)


def _best(at: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores in order, ties to smaller row numbers."""
    if len(at) > 4 * k:
        high = score >= np.partition(score, len(score) - k)[len(score) - k]
        at, score = at[high], score[high]
    order = np.lexsort((at, -score))[:k]
    return at[order], score[order]


def _units(batches: Iterator, k: int) -> Iterator:
    """Rows sorted by unit (dim, c, q), candidates first."""
    unit, rows, queries = None, [], []

    def done():
        out: list[list] = [[], [], [], []]
        if rows and queries:
            lists = SortedLists(np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64).reshape(len(rows), -1), np.array([r[2] for r in rows], np.int64))
            for ident, q, row in queries:
                ids, scores = lists.search(np.array(q, np.int64), row, k)
                for column, x in zip(out, (np.full(len(ids), row, np.int64), np.full(len(ids), ident, np.int64), ids, scores), strict=True):
                    column.append(x)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else [], pa.int64()) for x in out], names=["row", "query_id", "vec_id", "score"])

    for b in batches:
        for dim, c, q, query, ident, x, row in zip(*(b.column(n).to_pylist() for n in ("dim", "c", "q", "query", "id", "x", "row")), strict=True):
            if (dim, c, q) != unit:
                if unit is not None:
                    yield done()
                unit, rows, queries = (dim, c, q), [], []
            (queries if query else rows).append((ident, x, row))
    if unit is not None:
        yield done()


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, scale: int = 64, block: int = 4096, query_block: int = 8192) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` rows with the largest inner product for each query.

    Components become floor(scale * x). Queries are the rows whose vec_id is divisible by ``every``;
    candidates are all other rows with as many components. Ties go to the smaller vec_id. Rows that share a
    vec_id, and repeated rows, are candidates and queries each: such a query_id has ranks from 1 more than once. Rows
    with a null vec_id or vector, or null or non-finite components, take no part. Other columns are ignored.
    """
    rows = rows_only(vectors, "vec_id", "embedding").where("vec_id is not null and embedding is not null")
    rows = rows.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("e"))
    rows = rows.where(F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    rows = rows.select("id", F.transform("e", lambda x: F.floor(x * scale).cast("long")).alias("x"), F.size("e").alias("dim"), F.monotonically_increasing_id().alias("row"))
    n = rows.count()
    nc, nq = max(1, -(-n // block)), max(1, -(-n // (query_block * every)))
    spread = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(spread, min(4 * nc * nq, 8 * spread))
    query = F.col("id") % every == 0
    c, q = F.pmod(F.xxhash64("row"), F.lit(nc)).cast("int"), F.pmod(F.xxhash64("row", F.lit(1)), F.lit(nq)).cast("int")
    each = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    as_row = rows.select("dim", c.alias("c"), each(nq).alias("q"), F.lit(False).alias("query"), "id", "x", "row")
    as_query = rows.where(query).select("dim", each(nc).alias("c"), q.alias("q"), F.lit(True).alias("query"), "id", "x", "row")
    units = as_row.unionByName(as_query).repartition(tasks, "dim", "c", "q").sortWithinPartitions("dim", "c", "q", "query")
    found = units.mapInArrow(lambda it: _units(it, k), "row long, query_id long, vec_id long, score long")
    order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

"""Exact top-k search by inner product over a KD-tree for each shard."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.llm.common import checked, stored, tidy


class KDTree:
    """Rows of integer components; median splits of the widest dimension, a tight bounding box for each node.

    Dot products of float64 are exact while no partial sum leaves 2^53; beyond, Python's integers are used.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf: int = 128):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors, self.leaf = ids[order], vectors[order], leaf
        self.low: list[np.ndarray] = []
        self.high: list[np.ndarray] = []
        self.kids: list[tuple[int, int] | None] = []
        self.span: list[tuple[int, int]] = []
        self.order = np.arange(len(ids))
        self._build(0, len(ids))
        self.ids, self.vectors = self.ids[self.order], self.vectors[self.order]

    def _build(self, start: int, end: int) -> None:
        """With a stack of spans; a span of equal rows is a leaf of any size."""
        work = [(start, end, -1, 0)]
        while work:
            a, b, parent, side = work.pop()
            rows = self.vectors[self.order[a:b]]
            node = len(self.span)
            low, high = rows.min(axis=0), rows.max(axis=0)
            self.low.append(low)
            self.high.append(high)
            self.kids.append(None)
            self.span.append((a, b))
            if parent >= 0:
                self.kids[parent] = (node, -1) if side == 0 else (self.kids[parent][0], node)
            d = int(np.argmax(high - low))
            if b - a > self.leaf and high[d] > low[d]:
                half = (b - a) // 2
                part = np.argpartition(rows[:, d], half)
                self.order[a:b] = self.order[a:b][part]
                work += [(a + half, b, node, 1), (a, a + half, node, 0)]

    def search(self, query: np.ndarray, k: int, own: int | None, floor: float = -np.inf) -> list[tuple[float, int]]:
        """The k best (score, id), ties to smaller ids, without id own; rows under floor may be left out.

        Best-first: the node with the largest bound is opened next; the search is over when that bound is below the
        kth score so far.
        """
        best: list[tuple[float, int]] = []  # a heap with the worst first: (score, -id)
        kth = floor
        up, down = np.maximum(query, 0), np.minimum(query, 0)
        bound = lambda n: float(up @ self.high[n] + down @ self.low[n])
        heap = [(-bound(0), 0)] if len(self.ids) else []
        while heap:
            top, n = heapq.heappop(heap)
            if -top < kth:
                break
            if self.kids[n]:
                for child in self.kids[n]:
                    if (x := bound(child)) >= kth:
                        heapq.heappush(heap, (-x, child))
                continue
            a, b = self.span[n]
            scores = self.vectors[a:b] @ query
            near = np.flatnonzero(scores >= kth)
            for s, i in zip(scores[near].tolist(), self.ids[a:b][near].tolist(), strict=True):
                if i == own:
                    continue
                if len(best) < k:
                    heapq.heappush(best, (s, -i))
                elif (s, -i) > best[0]:
                    heapq.heapreplace(best, (s, -i))
            if len(best) == k:
                kth = max(kth, best[0][0])
        return [(s, -i) for s, i in best]


def as_integers(x: np.ndarray) -> np.ndarray:
    return np.array([[int(v) for v in row] for row in x.tolist()], dtype=object).reshape(x.shape)


def exact_numbers(lists: list, scale: float) -> np.ndarray:
    """floor(scale * x) as float64 if every dot product is exact there, else as Python integers."""
    x = np.floor(np.array([np.asarray(v, dtype=np.float64) for v in lists]) * scale)
    if x.size and float(np.abs(x).max()) ** 2 * x.shape[1] < 2**52:
        return x
    return as_integers(x)


def top_k(table: DataFrame, queries: Column, k: int = 10, id: str = "vec_id", vector: str = "embedding", scale: float = 1024.0, shard_rows: int = 8192, growth: int = 4) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of each query's k best rows by inner product of floor(scale * x).

    queries: which rows of the table are queries. Candidates are all rows but the query's own id; ties go to smaller ids.

    Rows are dealt into shards of about shard_rows. A shard is one task: it builds its KD-tree once, and the queries come after its rows, a batch at
    a time, so memory is bounded by a shard and a batch, and every query meets every shard. Shards are searched in rounds,
    one in the first and growth times as many in each next; the kth scores found so far go with the queries to the
    next round, which prunes with them from the start. A shard returns at most k rows a query; between rounds, k are kept.

    Vectors that are null, empty, or hold null or non-finite components take no part, nor do rows with a null id. Vectors of different
    lengths don't meet: each length has shards of its own, and a query's candidates are as long as it is. An empty table
    gives an empty one. Rows that repeat an id are candidates each, but not for a query of that id; a repeated query
    id counts once, with the least of its vectors.
    """
    checked(table, id, vector)
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    valid = table.where(F.col(vector).isNotNull() & F.col(id).isNotNull()).where((F.size(vector) > 0) & ~bad)
    rows = valid.select(F.col(id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), queries.alias("q"))
    rows = stored(rows.withColumns({"h": F.xxhash64("id", F.lit(3)), "d": F.size("v")}), "vectors")
    kind = "query_id long, vec_id long, score long"
    # one row for each length of vectors
    lengths = sorted((r["d"], -(-r["n"] // shard_rows)) for r in rows.groupBy("d").agg(F.count("*").alias("n")).collect())
    if not lengths:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    place = F.lit(0)
    for d, n in reversed(lengths):
        place = F.when(F.col("d") == d, F.pmod("h", F.lit(n)).cast("int")).otherwise(place)
    placed = rows.select("id", "v", "d", place.alias("shard"))
    asked = rows.where("q").groupBy("id", "d").agg(F.min("v").alias("v"))
    asked = stored(asked.withColumn("_r", F.row_number().over(Window.partitionBy("id").orderBy("v"))).where("_r = 1").drop("_r"), "queries")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, ids, vectors, exact = None, [], [], True
        for batch in batches:
            b = batch.to_pandas()
            mine = b[~b.is_query]
            ids += mine.id.tolist()
            vectors += mine.v.tolist()
            wanted = b[b.is_query]
            if not len(wanted) or not ids:
                continue
            numbers = exact_numbers(wanted.v.tolist(), scale)
            if tree is None or (exact and numbers.dtype == object):  # rows come before queries
                held = exact_numbers(vectors, scale)
                exact = held.dtype != object and numbers.dtype != object and float(np.abs(held).max()) * float(np.abs(numbers).max()) * held.shape[1] < 2**52
                tree = KDTree(np.array(ids, dtype=np.int64), held if exact else held.astype(object))
            out = []
            for i, q, floor in zip(wanted.id.tolist(), numbers if exact else as_integers(numbers), wanted.kth.tolist(), strict=True):
                out += [(i, j, int(s)) for s, j in tree.search(q, k, i, -np.inf if floor is None or floor != floor else int(floor))]
            yield pa.RecordBatch.from_pandas(pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64"), preserve_index=False)

    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def best(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)

    found, low, wide = None, 0, 1
    most = max(n for _, n in lengths)
    while low < most:
        high = min(low + wide, most)
        told = asked.withColumn("kth", F.lit(None).cast("long"))
        if found is not None:  # with fewer than k rows so far nothing can be pruned
            kth = found.groupBy(F.col("query_id").alias("_i")).agg(F.min("score").alias("kth"), F.count("*").alias("c")).where(F.col("c") >= k)
            told = asked.join(kth.select("_i", "kth"), F.col("id") == F.col("_i"), "left").drop("_i")
        told = told.withColumn("shard", F.explode(F.sequence(F.lit(low), F.lit(high - 1))))
        slot = F.lit(0)  # a number for each length and shard of this round
        for number, (d, _) in enumerate(lengths):
            slot = F.when(F.col("d") == d, number * (high - low) + F.col("shard") - low).otherwise(slot)
        both = placed.where(F.col("shard").between(low, high - 1)).select("id", "v", "d", "shard", F.lit(None).cast("long").alias("kth"), F.lit(False).alias("is_query"))
        both = both.unionByName(told.select("id", "v", "d", "shard", "kth", F.lit(True).alias("is_query"))).withColumn("slot", slot.cast("int"))
        dealt = both.repartitionById(len(lengths) * (high - low), "slot").sortWithinPartitions("is_query", "id")
        new = dealt.select("id", "v", "kth", "is_query").mapInArrow(run, kind)
        whole = new if found is None else found.select("query_id", "vec_id", "score").unionByName(new)
        found = stored(best(whole), "best")
        low, wide = high, wide * growth
    return found.select("query_id", "rank", "vec_id", "score")

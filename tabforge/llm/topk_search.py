"""Exact top-k inner products by ball trees: branch and bound in every shard, with a shared k-th score.

Vectors become integers floor(scale * x). Rows are packed into shards, each a ball tree (nodes with centre and radius, leaves of
at most ``LEAF`` rows) in one binary row; queries are packed into blocks. A block walks a shard's tree with all its queries at once: the
node with the greatest upper bound q.c + |q| r goes first, and only queries whose bound reaches their k-th score so far go on below
it. The k-th score of a query is kept from shard to shard inside a task, and shared between tasks by rounds: the first round
searches one salt of the shards, the second starts all others from the k-th scores found there.

Blocks meet shards by equi-join on (block, salt): blocks are repeated per salt, shards per block. Nothing is broadcast; only k rows per query
and task are passed on, and merged by a window per query.

Scores are exact: products are summed in 64-bit floats while every partial sum is below 2^53, in 64-bit integers beyond; bounds are
widened so that rounding cannot prune a tie.

Defined cases: null vectors, vectors with null or non-finite components, empty vectors and null ids take no part; vectors of different
lengths are never compared; rows that share the query's id are its own; repeated query rows are each answered; repeated candidates
are candidates each; fewer than k candidates: all of them; other columns are not read.
"""

from __future__ import annotations

import heapq
import math
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabforge.llm.common import keep

LEAF = 64
SHARD_ROWS = 8192
BLOCK_QUERIES = 2048
EXACT = float(1 << 53)


class BallTree:
    """Nodes in arrays: centre, radius, first and last row, children (-1: a leaf)."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        order = np.arange(len(ids))
        nodes: list[tuple] = []

        def build(lo: int, hi: int) -> int:
            part = rows[order[lo:hi]].astype(np.float64)
            centre = part.mean(axis=0)
            gaps = np.sqrt(((part - centre) ** 2).sum(axis=1))
            at = len(nodes)
            nodes.append([centre, float(gaps.max()), lo, hi, -1, -1])
            if hi - lo > LEAF and gaps.max() > 0:
                one = part[gaps.argmax()]
                other = part[((part - one) ** 2).sum(axis=1).argmax()]
                middle = (hi - lo) // 2
                side = np.argpartition(part @ (other - one), middle)
                order[lo:hi] = order[lo:hi][side]
                nodes[at][4] = build(lo, lo + middle)
                nodes[at][5] = build(lo + middle, hi)
            return at

        build(0, len(ids))
        self.ids, self.rows = ids[order], rows[order]
        self.centres = np.array([n[0] for n in nodes])
        self.radii = np.array([n[1] for n in nodes])
        self.spans = np.array([n[2:6] for n in nodes])
        self.largest = float(np.abs(rows).max(initial=0))


class BlockSearch:
    """Best k of each query of a block, over the shards seen so far."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, floor: np.ndarray, k: int):
        self.ids, self.queries, self.k = ids, queries, k
        self.as_float = queries.astype(np.float64)
        self.norms = np.sqrt((self.as_float**2).sum(axis=1))
        self.largest = float(np.abs(queries).max(initial=0))
        self.floor = floor  # a k-th score found elsewhere, or the least integer
        low = np.iinfo(np.int64).min
        self.scores = np.full((len(ids), k), low)
        self.found = np.full((len(ids), k), np.iinfo(np.int64).max)
        self.filled = np.zeros((len(ids), k), dtype=bool)

    def kth(self) -> np.ndarray:
        own = np.where(self.filled.all(axis=1), self.scores[:, -1], np.iinfo(np.int64).min)
        return np.maximum(own, self.floor)

    def walk(self, tree: BallTree) -> None:
        exact = self.largest * tree.largest * tree.rows.shape[1] < EXACT
        kth = self.kth()

        def bounds(node: int, active: np.ndarray) -> np.ndarray:
            reach = self.norms[active] * tree.radii[node]
            middle = self.as_float[active] @ tree.centres[node]
            slack = 1e-9 * (np.abs(middle) + reach + self.norms[active] * math.sqrt(tree.rows.shape[1]) * tree.largest) + 1
            return middle + reach + slack

        everyone = np.arange(len(self.ids))
        first = bounds(0, everyone)
        queue = [(-float(first.max()), 0, everyone, first)]
        while queue:
            _, node, active, bound = heapq.heappop(queue)
            active = active[bound >= kth[active]]
            if not len(active):
                continue
            lo, hi, left, right = tree.spans[node]
            if left < 0:
                self._leaf(tree, lo, hi, active, exact)
                kth[active] = self.kth()[active]
                continue
            for child in (left, right):
                below = bounds(child, active)
                go = below >= kth[active]
                if go.any():
                    heapq.heappush(queue, (-float(below[go].max()), child, active[go], below[go]))

    def _leaf(self, tree: BallTree, lo: int, hi: int, active: np.ndarray, exact: bool) -> None:
        rows, ids = tree.rows[lo:hi], tree.ids[lo:hi]
        step = max(1, (1 << 18) // max(1, hi - lo))
        for at in range(0, len(active), step):  # a leaf of equal vectors can be long
            some = active[at:at + step]
            if exact:
                scores = (self.as_float[some] @ rows.astype(np.float64).T).astype(np.int64)
            else:
                scores = self.queries[some] @ rows.T
            usable = ids[None, :] != self.ids[some][:, None]
            scores = np.concatenate([self.scores[some], scores], axis=1)
            names = np.concatenate([self.found[some], np.broadcast_to(ids, (len(some), hi - lo))], axis=1)
            usable = np.concatenate([self.filled[some], usable], axis=1)
            best = np.lexsort((names, -scores, ~usable), axis=1)[:, :self.k]
            self.scores[some] = np.take_along_axis(scores, best, axis=1)
            self.found[some] = np.take_along_axis(names, best, axis=1)
            self.filled[some] = np.take_along_axis(usable, best, axis=1)


def _packed(rows_each: int, tree: bool):
    """Pack rows of ``id, vector`` by dimension into binary rows of at most ``rows_each``."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list] = {}

        def full(size: int) -> pd.DataFrame:
            ids = np.array([i for i, _ in held[size]], dtype=np.int64)
            rows = np.array([v for _, v in held[size]], dtype=np.int64)
            held[size] = []
            return pd.DataFrame({"dim": [size], "packed": [pickle.dumps(BallTree(ids, rows) if tree else (ids, rows), protocol=5)]})

        for batch in batches:
            for i, v in zip(batch["id"], batch["vector"]):
                some = held.setdefault(len(v), [])
                some.append((i, v))
                if len(some) == rows_each:
                    yield full(len(v))
        for size in [s for s, some in held.items() if some]:
            yield full(size)

    return pack


def _search(k: int):
    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, state = None, None

        def results() -> pd.DataFrame:
            q, r = np.nonzero(state.filled)
            return pd.DataFrame({
                "block": np.int64(block), "place": q.astype(np.int64), "query_id": state.ids[q], "vec_id": state.found[q, r], "score": state.scores[q, r]})

        for batch in batches:
            for row in batch.itertuples(index=False):
                if row.block != block:
                    if state is not None:
                        yield results()
                    block = row.block
                    ids, queries = pickle.loads(row.queries)
                    floor = np.full(len(ids), np.iinfo(np.int64).min)
                    if row.floors is not None:
                        for known in row.floors:
                            floor[known["place"]] = known["least"]
                    state = BlockSearch(ids, queries, floor, k)
                state.walk(pickle.loads(row.shard))
        if state is not None:
            yield results()

    return search


def integer_vectors(df: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    """``id, vector``: usable rows with integer components."""
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == F.lit(float("inf"))))
    usable = df.filter(F.col(key).isNotNull() & v.isNotNull() & (F.size(v) > 0) & ~F.coalesce(bad, F.lit(True)))
    return usable.select(F.col(key).cast("long").alias("id"), F.transform(v, lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))).alias("vector"))


def top_k(
    df: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id", vector: str = "embedding", scale: int = 1024, salts: int = 8,
) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the k greatest integer inner products of each query over ``df``."""
    spark = df.sparkSession
    shards = integer_vectors(df, key, vector, scale).mapInPandas(_packed(SHARD_ROWS, True), "dim int, packed binary")
    shards = keep(shards).withColumnRenamed("packed", "shard").withColumn("salt", F.pmod(F.xxhash64(F.sha1("shard")), F.lit(salts)))
    blocks = keep(integer_vectors(queries, key, vector, scale).mapInPandas(_packed(BLOCK_QUERIES, False), "dim int, packed binary"))
    # numbers of blocks: as many rows as there are blocks, each of thousands of queries
    order = W.partitionBy("dim").orderBy(F.sha1("packed"))
    blocks = keep(blocks.withColumn("block", F.row_number().over(order).cast("long") * 100_000 + F.col("dim")).withColumnRenamed("packed", "queries"))
    counts = keep(blocks.groupBy("dim").agg(F.collect_list("block").alias("blocks")))
    spread = shards.join(counts, "dim").select(F.explode("blocks").alias("block"), "salt", "shard")

    def round_(of_salts: list[int], floors: DataFrame | None) -> DataFrame:
        own = blocks.withColumn("salt", F.explode(F.array(*[F.lit(s).cast("long") for s in of_salts])))
        own = own.join(floors, "block", "left") if floors is not None else own.withColumn("floors", F.lit(None).cast("array<struct<place:long,least:long>>"))
        pairs = own.join(spread.filter(F.col("salt").isin(of_salts)), ["block", "salt"]).select("block", "queries", "floors", "shard")
        return keep(pairs.mapInPandas(_search(k), "block long, place long, query_id long, vec_id long, score long"))

    by = W.partitionBy("block", "place").orderBy(F.desc("score"), "vec_id")
    first = round_([0], None)
    best = first.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") == k)
    floors = best.groupBy("block").agg(F.collect_list(F.struct("place", F.col("score").alias("least"))).alias("floors"))
    both = first.unionByName(round_(list(range(1, salts)), floors)) if salts > 1 else first
    return both.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return top_k(rows, rows.filter(F.col("vec_id") % 100 == 0))


SQL = """
WITH v AS (
  SELECT vec_id, [floor(1024 * x::DOUBLE)::BIGINT for x in embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(embedding) > 0
    AND len([1 for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT q.vec_id AS query_id, v.vec_id, list_sum([a[1] * a[2] for a in list_zip(q.e, v.e)])::BIGINT AS score
  FROM v AS q JOIN v ON q.vec_id <> v.vec_id AND len(q.e) = len(v.e) WHERE q.vec_id % 100 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

"""Hard negatives: rotated one-bit codes bound every score, and only rows whose interval can matter are scored.

Vectors become integers floor(scale * x); a score is an integer inner product. An anchor's positives are its best other rows of the same label; its hard
negatives are, for each positive, the best rows of other labels whose score lies between a share of the positive's score and that score.

Codes. A row v, turned by a seeded rotation, is stored as the signs of its components, c = sign(v) / sqrt(d), with the alignment <v, c> between
vector and code and the length of the residual v - <v, c> c. An anchor, turned likewise, is held in 8-bit steps q, as bit planes; the part that the
steps miss has a known length. <q, c> follows from popcounts of the planes against the code. As the residual is orthogonal to c,

    <q, v> = <v, c> <q, c> +- sqrt(|q|^2 - <q, c>^2) |residual|   (Cauchy-Schwarz), +- |missed part| |v|

holds with certainty: an interval, not an estimate with a probability. A row is scored only if its interval reaches what one of the anchor's lists
still takes: the share of the positive or its last score so far, and not beyond the positive. Scores are exact integers.

Two passes. The first finds the positives, the second the negatives, whose limits come from the positives. Rows are packed, with their codes, where they
are read; anchors are packed into blocks of ``BLOCK`` by hash. A task holds a block of anchors and streams the shards of one salt, so
the vectors of the table are shipped once per block of anchors, and lists and limits go from shard to shard. Each task passes on the lists of
its anchors; they are merged by a window per list.

Defined cases: rows with a null label, a null id, a null or empty vector, or a vector with null or non-finite components take no part; vectors of different
lengths are never compared; rows that share the anchor's id are its own; repeated anchors are each answered, repeated other rows are rows each;
fewer positives or negatives than wanted: all there are; no row satisfies the limits of a negative positive score; components beyond 2^31 count
as 2^31; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import functools
import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabforge.llm.common import drop, give_back, keep
from tabforge.llm.vectors import integers, matrices

LIMIT = 1 << 31
EXACT = 1 << 53
SHARD = 4096
BLOCK = 16_384
PACK = 4096  # anchors of a block that travel in one row
TILE = 1 << 19  # pairs of anchors and rows looked at together
LEVELS = 255
NONE = np.iinfo(np.int64).min


@functools.lru_cache(maxsize=8)
def rotation(dim: int) -> np.ndarray:
    """A fixed random rotation."""
    return np.linalg.qr(np.random.default_rng(dim).standard_normal((dim, dim)))[0]


def words(signs: np.ndarray) -> np.ndarray:
    """Rows of bits as 64-bit words."""
    bits = np.packbits(signs, axis=1)
    bits = np.pad(bits, ((0, 0), (0, -bits.shape[1] % 8)))
    return np.ascontiguousarray(bits).view(np.uint64)


class Codes:
    """One-bit codes of rows: sign words, ones in each, alignment, residual and length."""

    def __init__(self, rows: np.ndarray):
        turned = rows.astype(np.float64) @ rotation(rows.shape[1])
        signs = turned > 0
        self.code = words(signs)
        self.ones = signs.sum(axis=1)
        self.align = np.abs(turned).sum(axis=1) / math.sqrt(rows.shape[1])
        self.length = np.sqrt((turned**2).sum(axis=1))
        self.residual = np.sqrt(np.maximum(0.0, self.length**2 - self.align**2)) + 1e-9 * self.length


class Planes:
    """Anchors in 8-bit steps, as bit planes."""

    def __init__(self, rows: np.ndarray):
        turned = rows.astype(np.float64) @ rotation(rows.shape[1])
        self.dim = rows.shape[1]
        self.low = turned.min(axis=1, initial=0.0)
        self.step = np.maximum(turned.max(axis=1, initial=0.0) - self.low, 1e-300) / LEVELS
        steps = np.clip(np.rint((turned - self.low[:, None]) / self.step[:, None]), 0, LEVELS).astype(np.uint8)
        held = self.low[:, None] + steps * self.step[:, None]
        self.planes = [words((steps >> b) & 1) for b in range(8)]
        self.total = held.sum(axis=1)
        self.square = (held**2).sum(axis=1)
        self.missed = np.sqrt(((turned - held) ** 2).sum(axis=1))
        self.length = np.sqrt((turned**2).sum(axis=1))

    def intervals(self, some: np.ndarray, codes: Codes) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the inner products of some anchors with all rows of a shard."""
        counts = np.zeros((len(some), len(codes.ones)))
        for b, plane in enumerate(self.planes):
            hits = np.zeros(counts.shape, dtype=np.uint32)
            for w in range(plane.shape[1]):
                hits += np.bitwise_count(plane[some, w][:, None] & codes.code[None, :, w])
            counts += hits * float(1 << b)
        # the sum of the components where the code has a one, less the others
        along = (2 * (self.step[some][:, None] * counts + self.low[some][:, None] * codes.ones) - self.total[some][:, None]) / math.sqrt(self.dim)
        middle = codes.align * along
        rest = np.sqrt(np.maximum(0.0, self.square[some][:, None] - along**2) + 1e-9 * self.square[some][:, None]) * codes.residual
        rest += self.missed[some][:, None] * codes.length + 1e-7 * self.length[some][:, None] * codes.length + 0.5
        return middle - rest, middle + rest


class Anchors:
    """A block's anchors with their lists: ``lists`` lists of ``size`` places for each."""

    def __init__(self, packs: list[tuple], lists: int, size: int):
        self.ids, self.labels, self.rows = (np.concatenate([p[i] for p in packs]) for i in range(3))
        self.planes = Planes(self.rows)
        self.top = int(np.abs(self.rows).max(initial=0))
        self.scores = np.full((len(self.ids), lists, size), NONE)
        self.names = np.full((len(self.ids), lists, size), np.iinfo(np.int64).max)
        self.filled = np.zeros((len(self.ids), lists, size), dtype=bool)

    def products(self, a: np.ndarray, rows: np.ndarray, r: np.ndarray, top: int) -> np.ndarray:
        """Exact integer inner products of pairs."""
        bound = self.top * top * rows.shape[1]
        if bound < 1 << 63:
            return np.einsum("ij,ij->i", self.rows[a], rows[r])
        exact = (self.rows[a].astype(object) * rows[r].astype(object)).sum(axis=1)
        return np.clip(exact, NONE + 1, (1 << 63) - 1).astype(np.int64)

    def take(self, which: int, a: np.ndarray, names: np.ndarray, scores: np.ndarray) -> None:
        """Keep the best of the candidates of each anchor in its list ``which``."""
        size = self.scores.shape[2]
        order = np.lexsort((names, -scores, a))
        a, names, scores = a[order], names[order], scores[order]
        first = np.concatenate([[True], a[1:] != a[:-1]])
        starts = np.flatnonzero(first)
        rank = np.arange(len(a)) - starts[np.cumsum(first) - 1]
        a, names, scores, rank = (x[rank < size] for x in (a, names, scores, rank))
        own, inverse = np.unique(a, return_inverse=True)
        offered = np.full((len(own), size), NONE), np.full((len(own), size), np.iinfo(np.int64).max), np.zeros((len(own), size), dtype=bool)
        offered[0][inverse, rank], offered[1][inverse, rank], offered[2][inverse, rank] = scores, names, True
        both = [np.concatenate([held[own, which], new], axis=1) for held, new in zip((self.scores, self.names, self.filled), offered)]
        best = np.lexsort((both[1], -both[0], ~both[2]), axis=1)[:, :size]
        for held, new in zip((self.scores, self.names, self.filled), both):
            held[own, which] = np.take_along_axis(new, best, axis=1)

    def last(self) -> np.ndarray:
        """The last score of each full list."""
        return np.where(self.filled.all(axis=2), self.scores[:, :, -1], NONE)


def _tiles(anchors: Anchors, shard: tuple) -> Iterator[np.ndarray]:
    step = max(1, TILE // max(1, len(shard[0])))
    for at in range(0, len(anchors.ids), step):
        yield np.arange(at, min(at + step, len(anchors.ids)))


def positives(anchors: Anchors, shard: tuple) -> None:
    ids, labels, rows, codes = shard
    top = int(np.abs(rows).max(initial=0))
    for some in _tiles(anchors, shard):
        low, high = anchors.planes.intervals(some, codes)
        fit = (anchors.labels[some][:, None] == labels) & (anchors.ids[some][:, None] != ids)
        # as many lower bounds as there are places already promise their least
        floor = anchors.last()[some, 0].astype(np.float64)
        size = anchors.scores.shape[2]
        if low.shape[1] > size:
            own = np.where(fit, low, -np.inf)
            floor = np.maximum(floor, -np.partition(-own, size - 1, axis=1)[:, size - 1])
        i, r = np.nonzero(fit & (high >= floor[:, None]))
        if len(i):
            scores = anchors.products(some[i], rows, r, top)
            anchors.take(0, some[i], ids[r], scores)


def negatives(anchors: Anchors, shard: tuple, goals: np.ndarray, has: np.ndarray, percent: int) -> None:
    """``goals``: the positives' scores of each anchor, where ``has``."""
    ids, labels, rows, codes = shard
    top = int(np.abs(rows).max(initial=0))
    least = np.array([[-(-percent * int(g) // 100) for g in row] for row in goals], dtype=np.int64).reshape(goals.shape)
    for some in _tiles(anchors, shard):
        low, high = anchors.planes.intervals(some, codes)
        other = anchors.labels[some][:, None] != labels
        need = np.maximum(least, anchors.last())[some]
        near = np.zeros(other.shape, dtype=bool)
        for j in range(goals.shape[1]):
            open_ = has[some, j] & (need[:, j] <= goals[some, j])
            near |= open_[:, None] & (high >= need[:, j].astype(np.float64)[:, None]) & (low <= goals[some, j].astype(np.float64)[:, None])
        i, r = np.nonzero(near & other)
        if not len(i):
            continue
        scores = anchors.products(some[i], rows, r, top)
        for j in range(goals.shape[1]):
            good = has[some[i], j] & (scores <= goals[some[i], j]) & (scores >= need[i, j])
            if good.any():
                anchors.take(j, some[i[good]], ids[r[good]], scores[good])


def usable(df: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).cast("array<double>").alias("vector"))
    return rows.filter("id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL")


def _packed(scale: int, size: int, coded: bool):
    """``block, dim, pack``: ids, labels and integers (and codes) of at most ``size`` rows of one block and length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list] = {}

        def pack(at: tuple[int, int]) -> pa.RecordBatch:
            ids, labels, rows = (np.concatenate([h[i] for h in held[at]]) for i in range(3))
            content = (ids, labels, rows, Codes(rows)) if coded else (ids, labels, rows)
            held[at] = []
            return pa.RecordBatch.from_arrays(
                [pa.array([at[0]], pa.int64()), pa.array([at[1]], pa.int32()), pa.array([pickle.dumps(content, protocol=5)], pa.binary())],
                names=["block", "dim", "pack"])

        for batch in batches:
            ids, labels, blocks = (batch.column(c).to_numpy() for c in ("id", "label", "block"))
            for places, found in matrices(batch.column("vector")):
                whole = integers(found, scale, LIMIT)
                for block in np.unique(blocks[places]):
                    own = np.flatnonzero(blocks[places] == block)
                    at = (int(block), found.shape[1])
                    some = held.setdefault(at, [])
                    while len(own):
                        room = size - sum(len(h[0]) for h in some)
                        part, own = own[:room], own[room:]
                        some.append((ids[places[part]], labels[places[part]], whole[part]))
                        if len(part) == room:
                            yield pack(at)
                            some = held[at]
        for at in [k for k, v in held.items() if v]:
            yield pack(at)
        give_back()

    return run


def _search(lists: int, size: int, percent: int | None):
    """Streams shards past a block's anchors; ``percent``: look for negatives, given the positives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, packs, anchors, goals, has = None, [], None, None, None

        def results() -> pa.RecordBatch:
            a, j, r = np.nonzero(anchors.filled)
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(a), task[0])), pa.array(np.full(len(a), task[1], np.int32)), pa.array(a), pa.array(anchors.ids[a]), pa.array(j),
                 pa.array(anchors.names[a, j, r]), pa.array(anchors.scores[a, j, r])], names=["block", "dim", "place", "anchor", "list", "id", "score"])

        for batch in batches:
            for row in batch.to_pylist():
                if (row["block"], row["dim"], row["salt"]) != task:
                    if anchors is not None:
                        yield results()
                    task, packs, anchors, goals = (row["block"], row["dim"], row["salt"]), [], None, row["goals"]
                if row["seq"] >= 0:
                    packs.append(pickle.loads(row["pack"]))
                    continue
                if anchors is None:
                    anchors = Anchors(packs, lists, size)
                    if percent is not None:
                        known, goals, has = goals or [], np.zeros((len(anchors.ids), lists), dtype=np.int64), np.zeros((len(anchors.ids), lists), dtype=bool)
                        for g in known:
                            goals[g["place"], g["list"]], has[g["place"], g["list"]] = g["score"], True
                shard = pickle.loads(row["pack"])
                if percent is None:
                    positives(anchors, shard)
                else:
                    negatives(anchors, shard, goals, has, percent)
        if anchors is not None:
            yield results()
        give_back()

    return run


def hard_negatives(
    df: DataFrame, is_anchor: Column, key: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = 256, n_positives: int = 5,
    n_negatives: int = 5, percent: int = 80, salts: int = 8, block: int = BLOCK,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``; ``is_anchor`` is a condition on the columns of ``df``."""
    shard_of = F.pmod(F.xxhash64(F.md5("pack")), F.lit(salts)).cast("int")
    rows = usable(df, key, vector, label).withColumn("block", F.lit(0).cast("long"))
    shards = keep(rows.mapInArrow(_packed(scale, SHARD, True), "block long, dim int, pack binary"))
    shards = shards.select("dim", shard_of.alias("salt"), F.lit(-1).cast("long").alias("seq"), "pack")

    chosen = usable(df.filter(is_anchor), key, vector, label)
    number = max(1, math.ceil(chosen.count() / block))
    spread = chosen.withColumn("block", F.pmod(F.xxhash64("id", "vector"), F.lit(number)))
    packs = spread.repartition(number, "block").mapInArrow(_packed(scale, PACK, False), "block long, dim int, pack binary")
    # packs of a block come in one order everywhere
    packs = keep(packs.withColumn("seq", F.monotonically_increasing_id()))
    tasks = packs.select("block", "dim").distinct().withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    goals_type = "array<struct<place:long,list:long,score:long>>"
    columns = "block long, dim int, place long, anchor long, list long, id long, score long"

    def pass_(lists: int, size: int, goals: DataFrame | None, share: int | None) -> DataFrame:
        own = packs.join(goals, ["block", "dim"], "left") if goals is not None else packs.withColumn("goals", F.lit(None).cast(goals_type))
        own = own.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).select("block", "dim", "salt", F.lit(0).alias("role"), "seq", "pack", "goals")
        passing = tasks.join(shards, ["dim", "salt"]).select("block", "dim", "salt", F.lit(1).alias("role"), "seq", "pack", F.lit(None).cast(goals_type).alias("goals"))
        work = own.union(passing).repartition(min(4 * number * salts, 20_000), "block", "dim", "salt").sortWithinPartitions("block", "dim", "salt", "role", "seq")
        found = keep(work.mapInArrow(_search(lists, size, share), columns))
        best = W.partitionBy("block", "dim", "place", "list").orderBy(F.desc("score"), "id")
        return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= size)

    found = pass_(1, n_positives, None, None)
    best = keep(found.select("block", "dim", "place", "anchor", (F.col("rank") - 1).cast("long").alias("list"), "id", "score"))
    goals = best.groupBy("block", "dim").agg(F.collect_list(F.struct("place", "list", "score")).alias("goals"))
    mined = pass_(n_positives, n_negatives, goals, percent)
    drop(shards)
    named = best.select("block", "dim", "place", "list", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = mined.join(named, ["block", "dim", "place", "list"])
    return out.select(F.col("anchor").alias("anchor_id"), "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives(rows, F.col("vec_id") % 100 == 0)


SQL = """
WITH v AS MATERIALIZED (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE)::BIGINT for x in embedding] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len([1 for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
), s AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, v.vec_id, a.label = v.label AS alike, list_sum([z[1] * z[2] for z in list_zip(a.e, v.e)])::BIGINT AS score
  FROM v AS a JOIN v ON a.vec_id <> v.vec_id AND len(a.e) = len(v.e) WHERE a.vec_id % 100 = 0
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id))::INT AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT alike AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY rank <= 5
"""

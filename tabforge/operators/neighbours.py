"""Nearest neighbours: exact by cells of space, approximate by random projections.

A small reference table is broadcast after its size is measured. Points of a larger one are kept in the
cells of pivots. A query first meets its own cell; its k-th distance there, the radii of the other cells and the borders
between cells then tell which of them can hold a nearer point, and it meets those alone. Meetings are of
bounded blocks, packed and written once: each task reads the blocks of its pairs, none is shuffled for a meeting. A task passes on
its k best per query, and holds one tile of distances at a time.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.ml.feature import BucketedRandomProjectionLSH
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabforge.plans.scale import fits, hash32, lookup_join, materialise

REFERENCE_BLOCK = 16_384
# Distances that a task holds at a time, and points of a row that bound its k-th distance before all are looked at.
TILE = 1 << 20
FIRST = 1_024
PIVOTS = 4_096


def _nearest(queries: np.ndarray, points: np.ndarray, keys: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances and positions of the k nearest points per query; ties go to the smaller key."""
    d = (queries**2).sum(1)[:, None] - 2 * queries @ points.T + (points**2).sum(1)[None, :]
    d = np.maximum(d, 0.0)
    chosen = [p[np.lexsort((keys[p], row[p]))][:k] for p, row in zip(_candidates(d, k), d)]
    return d, chosen


def _candidates(d: np.ndarray, k: int, margin: float = 0.0) -> list[np.ndarray]:
    """Per row the places of its k least values at least, all of those up to a bound on the k-th, so that ties are broken later."""
    if d.shape[1] <= k:
        return [np.arange(d.shape[1])] * d.shape[0]
    edge = np.partition(d[:, : max(FIRST, k)], k - 1, axis=1)[:, k - 1]
    return [np.flatnonzero(row <= e + margin) for row, e in zip(d, edge)]


def _tiles(rows: int, columns: int) -> Iterator[slice]:
    """Slices of rows whose distances to all columns are at most ``TILE`` numbers."""
    step = max(1, TILE // max(columns, 1))
    return (slice(a, a + step) for a in range(0, rows, step))


def _best(qk: np.ndarray, qx: np.ndarray, pk: np.ndarray, px: np.ndarray, pv: np.ndarray, k: int, exclude_self: bool) -> pd.DataFrame:
    """The k nearest points of each query of a block."""
    out_q, out_p, out_v, out_d = [], [], [], []
    for at in _tiles(len(qk), len(pk)):
        d, chosen = _nearest(qx[at], px, pk, k + exclude_self)
        for i, pick in enumerate(chosen):
            own = qk[at.start + i]
            pick = (pick[pk[pick] != own] if exclude_self else pick)[:k]
            out_q.append(np.full(len(pick), own))
            out_p.append(pk[pick])
            out_v.append(pv[pick])
            out_d.append(d[i, pick])
    cat = lambda x, t: np.concatenate(x) if x else np.array([], dtype=t)
    return pd.DataFrame({"_q": cat(out_q, "int64"), "_p": cat(out_p, "int64"), "_v": cat(out_v, float), "_d": cat(out_d, float)})


def _top(near: DataFrame, k: int) -> DataFrame:
    """The k nearest of each query among candidates: every task passes on at most k of each, then they are merged."""
    order = W.partitionBy("_q").orderBy("_d", "_p")
    return near.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= k).drop("_rank")


class Cells:
    """A partition of space by pivots: a point belongs to the cell of its nearest pivot, a cell's radius covers its points.

    No point of cell j is nearer to x than d(x, pivot j) - radius j; and none is nearer than
    (d(x, pivot j)^2 - d(x, pivot i)^2) / (2 d(pivot i, pivot j)), the distance to the border, for x in cell i.
    """

    def __init__(self, centres: np.ndarray):
        self.centres = centres
        self.between = np.sqrt(_squares(centres, centres))

    def home(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest pivot and distance to it."""
        cells, gaps = [np.array([], "int64")], [np.array([])]
        for at in _tiles(len(rows), len(self.centres)):
            d = _squares(rows[at], self.centres)
            cells.append(d.argmin(axis=1))
            gaps.append(np.sqrt(d[np.arange(len(d)), cells[-1]]))
        return np.concatenate(cells), np.concatenate(gaps)

    def near(self, rows: np.ndarray, own: int, cell: int, radii: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """Whether ``cell`` can hold a point within its limit, for each row of the cell ``own``; as ``reached`` for one cell."""
        if cell == own:
            return np.zeros(len(rows), bool)
        d = _squares(rows, self.centres[[own, cell]])
        border = (d[:, 1] - d[:, 0]) / max(2 * self.between[own, cell], 1e-300)
        least = np.maximum(np.sqrt(d[:, 1]) - radii[cell], border)
        return least <= limit + 1e-6 * self._scale(rows)

    def _scale(self, rows: np.ndarray) -> np.ndarray:
        # distances come from differences of squares: a margin keeps ties and near ties
        return np.sqrt((rows**2).sum(axis=1)) + np.abs(self.centres).max(initial=0) + 1

    def reached(self, rows: np.ndarray, radii: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) for the cells other than a row's own that can hold a point within its limit; empty cells have radius -inf."""
        d = _squares(rows, self.centres)
        cell = d.argmin(axis=1)
        own = d[np.arange(len(rows)), cell]
        border = (d - own[:, None]) / np.maximum(2 * self.between[cell], 1e-300)
        least = np.maximum(np.sqrt(d) - radii[None, :], border)
        near = (least <= limit[:, None] + 1e-6 * self._scale(rows)[:, None]) & (radii > -np.inf)[None, :]
        near[np.arange(len(rows)), cell] = False
        return np.nonzero(near)


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a**2).sum(1)[:, None] - 2 * a @ b.T + (b**2).sum(1)[None, :], 0.0)


def _cells_join(q: DataFrame, p: DataFrame, k: int, block: int, n_points: int, exclude_self: bool) -> DataFrame:
    """Candidates by cells: every query meets its own cell, then only the cells that can still hold one of its k nearest."""
    spark = q.sparkSession
    schema = "_q long, _p long, _v double, _d double"
    wanted = min(PIVOTS, max(1, math.ceil(2 * n_points / block)))
    # a bounded choice by hash; it decides where points are kept, not which are found
    chosen = p.orderBy(hash32("_p"), "_p").limit(wanted).select("_z").collect()
    shared = spark.sparkContext.broadcast(Cells(np.unique(np.array([r[0] for r in chosen], dtype=float), axis=0)))

    def celled(df: DataFrame, vector: str) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if len(b):
                    cell, gap = shared.value.home(_stack(b[vector]))
                    yield b.assign(_cell=cell.astype("int32"), _gap=gap)

        return df.mapInPandas(run, T.StructType([*df.schema.fields, T.StructField("_cell", T.IntegerType()), T.StructField("_gap", T.DoubleType())]))

    # rows without a key meet nothing
    q, p = celled(q.filter("_q IS NOT NULL"), "_x"), celled(p.filter("_p IS NOT NULL"), "_z")
    points = _pack(p, "_cell", "_z", "_p", {"_p": "<i8", "_v": "<f8", "_gap": "<f8"}, block)
    sizes = _radii(points).groupBy("_cell").agg(F.max("_radius").alias("radius")).collect()  # a row per pivot
    radii = np.full(len(shared.value.centres), -np.inf)
    for r in sizes:
        radii[r["_cell"]] = r["radius"]
    points = points.withColumnsRenamed({"_cell": "_there", "_n": "_m", "_single": "_short"}).drop("_id", "_gap", "_others")

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, found = None, None
        for row in _pairs(batches):
            if row["_id"] != at:
                if found is not None:
                    yield found.rows("_q", "_p", "_v", "_d")
                x = _matrix(row, "_x", "_n", "_single")
                limit = np.frombuffer(row["_limit"], "<f8") if "_limit" in row else np.full(len(x), np.inf)
                at, found = row["_id"], _Found(np.frombuffer(row["_q"], "<i8"), x, k, limit**2, exclude_self)
            among = None
            if "_limit" in row:
                among = np.flatnonzero(shared.value.near(found.points, row["_cell"], row["_there"], radii, limit))
            found.meet(np.frombuffer(row["_p"], "<i8"), _matrix(row, "_z", "_m", "_short"), np.frombuffer(row["_v"], "<f8"), among)
        if found is not None:
            yield found.rows("_q", "_p", "_v", "_d")

    def met(left: DataFrame, on: Column) -> DataFrame:
        # blocks are read again for each meeting, not shuffled
        pairs = left.join(points.hint("shuffle_replicate_nl"), on)
        return materialise(_top(pairs.mapInPandas(meet, schema), k), columnar=True)

    first = met(_pack(q, "_cell", "_x", "_q", {"_q": "<i8"}, block), F.col("_cell") == F.col("_there"))
    limits = first.groupBy("_q").agg(F.when(F.count(F.lit(1)) >= k, F.sqrt(F.max("_d"))).alias("_limit"))
    limits = q.join(limits, "_q", "left").withColumn("_limit", F.coalesce("_limit", F.lit(float("inf"))))

    def others(x: np.ndarray, b: pd.DataFrame) -> list[int]:
        cells = np.zeros(len(radii), bool)
        for at in _tiles(len(b), 4 * len(radii)):  # a handful of numbers for each cell
            cells[shared.value.reached(x[at], radii, b["_limit"].to_numpy()[at])[1]] = True
        return np.flatnonzero(cells).tolist()

    second = met(_pack(limits, "_cell", "_x", "_q", {"_q": "<i8", "_limit": "<f8"}, block, others), F.array_contains("_others", F.col("_there")))
    return first.union(second)


def _narrow(df: DataFrame, vector: str) -> DataFrame:
    """Vectors in single precision if that loses nothing in any row: they take half the disk, and are widened again where they meet."""
    exact = F.forall(vector, lambda x: x.cast("float").cast("double") == x)
    return df if df.filter(~exact).limit(1).count() else df.withColumn(vector, F.col(vector).cast("array<float>"))


def _stack(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype(float)


def _radii(points: DataFrame) -> DataFrame:
    """(_cell, _radius) of each packed block."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"_cell": b["_cell"], "_radius": [np.frombuffer(g, "<f8").max() for g in b["_gap"]]})

    return points.select("_cell", "_gap").mapInPandas(run, "_cell int, _radius double")


def _pack(df: DataFrame, home: str, vector: str, key: str | None, numbers: dict[str, str], block: int,
          others: Callable[[np.ndarray, pd.DataFrame], list[int]] | None = None) -> DataFrame:
    """Blocks of at most ``block`` rows of one home, each a row: (_id, home, _n, _single, vector, *numbers, _others), written as a table.

    Vectors and numbers are binary; vectors are in single precision where that loses nothing. Rows are dealt out by home and hash of the key, so a
    home of any size is gathered by many tasks. Without a key they are packed where they are read, and no table is written. ``others`` notes what
    a block as a whole needs.
    """
    dealt = df.select(home, vector, *numbers)
    if key is not None:
        dealt = dealt.repartitionByRange(max(1, math.ceil(df.count() / block)), F.col(home), hash32(key)).sortWithinPartitions(home)
    fields = [T.StructField("_id", T.LongType()), df.schema[home], T.StructField("_n", T.IntegerType()), T.StructField("_single", T.BooleanType())]
    fields += [T.StructField(c, T.BinaryType()) for c in (vector, *numbers)] + [T.StructField("_others", T.ArrayType(T.IntegerType()))]

    def row(number: int, held: list[pd.DataFrame]) -> pd.DataFrame:
        b = pd.concat(held, ignore_index=True)
        x = _stack(b[vector])
        short = x.astype("<f4")
        single = bool((short == x).all())
        out = {"_id": (TaskContext.get().partitionId() << 32) + number, home: b[home].iloc[0], "_n": len(b), "_single": single, vector: (short if single else x).tobytes()}
        for c, kind in numbers.items():
            out[c] = (np.stack(b[c].to_numpy()) if b[c].dtype == object else b[c].to_numpy()).astype(kind).tobytes()
        return pd.DataFrame([out | {"_others": others(x, b) if others else None}])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        number = 0
        for b in batches:
            homes = b[home].to_numpy()
            ends = [0, *(np.flatnonzero(homes[1:] != homes[:-1]) + 1), len(b)]
            for start, end in zip(ends, ends[1:]):
                while start < end:
                    size = sum(map(len, held))
                    if held and (size == block or held[-1][home].iloc[0] != homes[start]):
                        yield row(number, held)
                        held, size, number = [], 0, number + 1
                    upto = min(end, start + block - size)
                    held.append(b.iloc[start:upto])
                    start = upto
        if held:
            yield row(number, held)

    packed = dealt.mapInPandas(run, T.StructType(fields))
    return packed if key is None else materialise(packed, columnar=True)


def _pairs(batches: Iterator[pd.DataFrame]) -> Iterator[dict]:
    return (dict(zip(b.columns, row)) for b in batches for row in b.itertuples(index=False, name=None))


def _matrix(row: dict, vector: str, size: str, single: str) -> np.ndarray:
    return np.frombuffer(row[vector], "<f4" if row[single] else "<f8").reshape(row[size], -1).astype(float)


class _Found:
    """The k nearest points so far of each query of a block, within a limit of their squared distance; points come block by block.

    With ``radius``, distances are those of differences, not of products, and below it. ``alike``: per row the numbers of which
    a query and a point must share one at the same place (NaN is shared with none).
    """

    def __init__(self, keys: np.ndarray, points: np.ndarray, k: int, limit: np.ndarray, exclude_self: bool,
                 radius: float | None = None, alike: np.ndarray | None = None):
        self.keys, self.points, self.k, self.limit, self.exclude_self = keys, points, k, limit, exclude_self
        self.radius, self.alike = radius, alike
        self.kth = np.full(len(keys), np.inf)  # squared
        self.held = tuple(np.array([], t) for t in ("int64", "int64", float, float))  # place of the query, key of the point, distance, value

    def meet(self, keys: np.ndarray, points: np.ndarray, values: np.ndarray, among: np.ndarray | None = None, alike: np.ndarray | None = None) -> None:
        among = np.arange(len(self.keys)) if among is None else among
        if not len(among) or not len(keys):
            return
        own = int(pd.Series(keys).value_counts().max()) if self.exclude_self else 0  # rows that may have the query's key
        least = self.k + own
        largest = (points**2).sum(1).max()
        new = [self.held]
        for at in _tiles(len(among), len(keys)):
            some = among[at]
            d = _squares(self.points[some], points)
            margin = 1e-9 * (1 + largest + (self.points[some] ** 2).sum(1).max())
            edge = np.minimum(self.limit[some], self.kth[some])
            if len(keys) > least and not np.isfinite(self.kth[some]).all():
                head = d[:, : max(FIRST, least)]
                if alike is not None:
                    same = np.zeros(head.shape, bool)
                    for t in range(alike.shape[1]):
                        same |= self.alike[some, t][:, None] == alike[: head.shape[1], t]
                    head = np.where(same, head, np.inf)
                edge = np.minimum(edge, np.partition(head, least - 1, axis=1)[:, least - 1])
            row, col = np.nonzero(d <= edge[:, None] + margin)
            apart = d[row, col]
            q = some[row]
            fine = keys[col] != self.keys[q] if self.exclude_self else np.ones(len(q), bool)
            if alike is not None:
                fine &= (self.alike[q] == alike[col]).any(axis=1)
            q, col, apart = q[fine], col[fine], apart[fine]
            if self.radius is not None:
                for i in range(0, len(q), FIRST * 16):
                    part = slice(i, i + FIRST * 16)
                    apart[part] = np.sqrt(((points[col[part]] - self.points[q[part]]) ** 2).sum(1))
                fine = apart < self.radius
                q, col, apart = q[fine], col[fine], apart[fine]
            new.append(self._nearest(q, keys[col], apart, values[col]))
        self.held = self._nearest(*(np.concatenate(x) for x in zip(*new)))
        q, _, apart, _ = self.held
        full = np.flatnonzero(np.bincount(q, minlength=len(self.keys)) >= self.k)
        last = np.searchsorted(q, full, "right") - 1
        self.kth[full] = apart[last] if self.radius is None else apart[last] ** 2

    def _nearest(self, q: np.ndarray, keys: np.ndarray, apart: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, ...]:
        """The k nearest of each query, by query and distance; ties go to the smaller key."""
        order = np.lexsort((keys, apart, q))
        q = q[order]
        kept = np.arange(len(q)) - np.searchsorted(q, q) < self.k
        order = order[kept]
        return q[kept], keys[order], apart[order], values[order]

    def rows(self, query: str, point: str, value: str, distance: str) -> pd.DataFrame:
        q, keys, apart, values = self.held
        return pd.DataFrame({query: self.keys[q], point: keys, value: values, distance: apart})


def k_nearest(
    queries: DataFrame, points: DataFrame, features: str, query_key: str, point_key: str, value: str, k: int,
    block: int = REFERENCE_BLOCK, broadcast: bool | None = None, exclude_self: bool = True,
) -> DataFrame:
    """(query_key, point_key, value, distance) of the k nearest points of each query row; ties go to the smaller key.

    Keys are integers; with ``exclude_self`` a point with the query's own key is not its neighbour.
    """
    q = queries.select(F.col(query_key).cast("long").alias("_q"), vector_to_array(features).alias("_x"))
    p = points.select(F.col(point_key).cast("long").alias("_p"), vector_to_array(features).alias("_z"), F.col(value).cast("double").alias("_v"))
    n_points = p.count()
    if broadcast is None:
        broadcast = n_points <= block and fits(p)
    if broadcast or not n_points:
        rows = p.toPandas()
        shared = queries.sparkSession.sparkContext.broadcast(
            (rows["_p"].to_numpy(), np.stack(rows["_z"].to_numpy()) if len(rows) else None, rows["_v"].to_numpy()))

        def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            pk, px, pv = shared.value
            for b in batches:
                if len(b) and len(pk):
                    yield _best(b["_q"].to_numpy(), np.stack(b["_x"].to_numpy()), pk, px, pv, k, exclude_self)

        near = q.mapInPandas(search, "_q long, _p long, _v double, _d double")
    else:
        near = _cells_join(_narrow(q, "_x"), _narrow(p, "_z"), k, block, n_points, exclude_self)
    return _top(near, k).select(F.col("_q").alias(query_key), F.col("_p").alias("neighbour"), F.col("_v").alias("value"), F.sqrt("_d").alias("distance"))


def lsh_nearest(
    queries: DataFrame, points: DataFrame, features: str, query_key: str, point_key: str, value: str, k: int, radius: float,
    bucket_length: float, tables: int = 8, seed: int = 42, exclude_self: bool = True, block: int = REFERENCE_BLOCK,
) -> DataFrame:
    """The k nearest points within ``radius`` that share a bucket of random projections with the query: approximate, never farther than asked.

    Wider buckets and more tables find more and compare more. Equal rows count once. Queries and points meet as matrices; buckets of at most a block
    meet side by side in one task. Larger ones are packed in blocks, written once and read by each meeting: bucket by bucket or, where buckets
    are so wide that this compares more than all pairs, all blocks once. A task passes on k points per query.
    """
    spark = queries.sparkSession
    q = _distinct(queries.select(F.col(query_key).cast("long").alias("_q"), vector_to_array(features).alias("_x")), "_q")
    p = _distinct(points.select(F.col(point_key).cast("long").alias("_p"), vector_to_array(features).alias("_z"), F.col(value).cast("double").alias("_v")), "_p")
    if exclude_self:  # a row without a key is not told from the others
        q, p = q.filter("_q IS NOT NULL"), p.filter("_p IS NOT NULL")
    q, p = (materialise(_narrow(df, v).withColumn(i, F.monotonically_increasing_id()), columnar=True) for df, v, i in ((q, "_x", "_qi"), (p, "_z", "_pi")))
    lsh = BucketedRandomProjectionLSH(inputCol="_f", outputCol="_h", bucketLength=bucket_length, numHashTables=tables, seed=seed)
    lsh = lsh.fit(points.select(F.col(features).alias("_f")))

    def bucketed(df: DataFrame, vector: str) -> DataFrame:
        hashed = lsh.transform(df.withColumn("_f", array_to_vector(F.col(vector).cast("array<double>")))).drop("_f")
        each = hashed.select(*df.columns, F.posexplode("_h").alias("_table", "_hash")).withColumn("_hash", vector_to_array("_hash")[0])
        return each.withColumn("_bucket", F.xxhash64("_table", "_hash"))

    home = ["_table", "_hash", "_bucket"]
    left, right = bucketed(q, "_x"), bucketed(p, "_z")
    asked, there = (rows.groupBy(*home).agg(F.count(F.lit(1)).alias(n)) for rows, n in ((left, "_asked"), (right, "_there")))
    sizes = materialise(asked.join(there, home), columnar=True)
    large = materialise(sizes.filter((F.col("_asked") > block) | (F.col("_there") > block)).withColumn("_home", F.monotonically_increasing_id()), columnar=True)
    # small buckets share a task
    n_points = p.count()
    packs = max(1, math.ceil(n_points * tables / block))
    small = sizes.filter((F.col("_asked") <= block) & (F.col("_there") <= block)).select(*home, F.pmod("_bucket", F.lit(packs)).alias("_pack"))
    # the lowest long stands for a point without key, which comes first among equals
    query, point = F.coalesce("_q", F.lit(0)).alias("_q"), F.coalesce("_p", F.lit(-(1 << 63))).alias("_p")
    a = lookup_join(left, small, home, "inner").select("_pack", "_table", "_hash", "_qi", query, "_x")
    b = lookup_join(right, small, home, "inner").select(F.col("_pack").alias("_pack"), "_table", "_hash", "_pi", point, "_z")

    def meet(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({c: np.array([], float if c == "_d" else "int64") for c in ("_q", "_qi", "_p", "_pi", "_d")})]
        there = dict(list(b.groupby(["_table", "_hash"])))
        for bucket, asked in a.groupby(["_table", "_hash"]):
            if bucket in there:
                out.append(_within(asked, there[bucket], k, radius, exclude_self))
        return pd.concat(out)

    schema = "_q long, _qi long, _p long, _pi long, _d double"
    met = a.groupBy("_pack").cogroup(b.groupBy("_pack")).applyInPandas(meet, schema)
    held, pairs = large.agg(F.count(F.lit(1)), F.sum(F.col("_asked").cast("double") * F.col("_there"))).first()
    if held:
        if wide := pairs >= float(q.count()) * n_points:
            # a pair shares several of these: all rows meet once, and a pair counts if it shares one
            cuts = {t: np.array([r["_hash"] for r in large.filter(F.col("_table") == t).select("_hash").collect()]) for t in range(tables)}
            shared = spark.sparkContext.broadcast(cuts)

            def marked(df: DataFrame, vector: str) -> DataFrame:
                def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                    for b in batches:
                        if len(b):
                            marks = np.stack(b["_marks"].to_numpy())
                            for t, these in shared.value.items():
                                marks[:, t] = np.where(np.isin(marks[:, t], these), marks[:, t], np.nan)
                            yield b.assign(_marks=list(marks))[~np.isnan(marks).all(axis=1)]

                hashed = lsh.transform(df.withColumn("_f", array_to_vector(F.col(vector).cast("array<double>"))))
                hashed = hashed.select(*df.columns, F.lit(0).cast("long").alias("_home"), F.array(*[vector_to_array(F.col("_h")[t])[0] for t in range(tables)]).alias("_marks"))
                return hashed.mapInPandas(run, hashed.schema)

            a, b, extra = marked(q, "_x"), marked(p, "_z"), {"_marks": "<f8"}
            if (few := math.ceil(n_points / (8 * block))) < b.rdd.getNumPartitions():
                b = b.coalesce(few)  # a task passes on what it found in all its blocks
            if a.rdd.getNumPartitions() * few < spark.sparkContext.defaultParallelism:
                a = a.repartition(spark.sparkContext.defaultParallelism)
        else:
            numbered = large.select(*home, "_home")
            a, b, extra = lookup_join(left, numbered, home, "inner"), lookup_join(right, numbered, home, "inner"), {}
        a = _pack(a.withColumn("_q", query), "_home", "_x", None if wide else "_qi", {"_qi": "<i8", "_q": "<i8"} | extra, block).drop("_others")
        b = _pack(b.withColumn("_p", point), "_home", "_z", None if wide else "_pi", {"_pi": "<i8", "_p": "<i8"} | extra, block).drop("_others", "_id")
        b = b.withColumnsRenamed({"_home": "_to", "_n": "_m", "_single": "_short", "_marks": "_theirs"})
        # blocks are read again for each meeting, not shuffled
        together = a.join(b.hint("shuffle_replicate_nl"), F.col("_home") == F.col("_to"))

        def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            at, found, names = None, None, None
            out = lambda: found.rows("_q", "_p", "_pi", "_d").assign(_qi=names[found.held[0]])[["_q", "_qi", "_p", "_pi", "_d"]]
            for row in _pairs(batches):
                if row["_id"] != at:
                    if found is not None:
                        yield out()
                    x, names = _matrix(row, "_x", "_n", "_single"), np.frombuffer(row["_qi"], "<i8")
                    marks = np.frombuffer(row["_marks"], "<f8").reshape(len(x), -1) if wide else None
                    at, found = row["_id"], _Found(np.frombuffer(row["_q"], "<i8"), x, k, np.full(len(x), radius**2), exclude_self, radius, marks)
                marks = np.frombuffer(row["_theirs"], "<f8").reshape(row["_m"], -1) if wide else None
                found.meet(np.frombuffer(row["_p"], "<i8"), _matrix(row, "_z", "_m", "_short"), np.frombuffer(row["_pi"], "<i8"), None, marks)
            if found is not None:
                yield out()

        met = met.union(together.mapInPandas(blocks, schema))
    # one shuffle, by query, for pairs met in several buckets and for the nearest
    near = met.repartition("_q").groupBy("_q", "_qi", "_p", "_pi").agg(F.min("_d").alias("_d"))
    if not exclude_self:  # a missing key is not 0
        near = near.join(q.select("_qi", F.col("_q").alias("_own")), "_qi").withColumn("_q", F.col("_own"))
    near = materialise(_top(near, k).select("_q", "_pi", "_d"), columnar=True).join(p.select("_pi", "_p", "_v"), "_pi")
    return near.select(F.col("_q").alias(query_key), F.col("_p").alias("neighbour"), F.col("_v").alias("value"), F.col("_d").alias("distance"))


def _distinct(df: DataFrame, key: str) -> DataFrame:
    """Equal rows once; where no key repeats there are none, and no vector is moved."""
    return df if df.groupBy(key).count().filter("count > 1").isEmpty() else df.distinct()


def _within(asked: pd.DataFrame, there: pd.DataFrame, k: int, radius: float, exclude_self: bool) -> pd.DataFrame:
    """The k nearest points of a bucket nearer than ``radius``; products of matrices find them, differences measure them."""
    qi, qk, qx = asked["_qi"].to_numpy(), asked["_q"].to_numpy(), _stack(asked["_x"])
    pi, pk, px = there["_pi"].to_numpy(), there["_p"].to_numpy(), _stack(there["_z"])
    own = int(pd.Series(pk).value_counts().max()) if exclude_self else 0  # rows that may have the query's key
    sizes = (px**2).sum(1)
    out_q, out_p, out_d = [], [], []
    for at in _tiles(len(qk), len(pk)):
        d = _squares(qx[at], px)
        margin = 1e-9 * (1 + sizes.max() + (qx[at] ** 2).sum(1).max())
        for i, pick in enumerate(_candidates(d, k + own, margin), at.start):
            pick = pick[d[i - at.start, pick] < radius**2 + margin]
            pick = pick[pk[pick] != qk[i]] if exclude_self else pick
            exact = np.sqrt(((px[pick] - qx[i]) ** 2).sum(1))
            best = np.lexsort((pk[pick], exact))[:k]
            best = best[exact[best] < radius]
            out_q.append(np.full(len(best), i))
            out_p.append(pick[best])
            out_d.append(exact[best])
    found, near = np.concatenate(out_q), np.concatenate(out_p)
    return pd.DataFrame({"_q": qk[found], "_qi": qi[found], "_p": pk[near], "_pi": pi[near], "_d": np.concatenate(out_d)})


class NeighbourModel:
    """k nearest training rows decide: vote (smallest class on ties) or mean; rows need an integer key."""

    def __init__(self, points: DataFrame, features: str, value: str, key: str, k: int, classify: bool, weights: str = "uniform",
                 exclude_self: bool = True):
        self.points, self.features, self.value, self.key = points, features, value, key
        self.k, self.classify, self.weights, self.exclude_self = k, classify, weights, exclude_self

    def save(self, path: str) -> None:
        self.points.write.mode("overwrite").parquet(f"{path}/points")
        rows = [(self.features, self.value, self.key, self.k, self.classify, self.weights, self.exclude_self)]
        schema = "features string, value string, key string, k int, classify boolean, weights string, exclude_self boolean"
        self.points.sparkSession.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{path}/note")

    @classmethod
    def load(cls, path: str) -> NeighbourModel:
        spark = SparkSession.active()
        return cls(spark.read.parquet(f"{path}/points"), **spark.read.parquet(f"{path}/note").first().asDict())

    def transform(self, df: DataFrame) -> DataFrame:
        near = k_nearest(df, self.points, self.features, self.key, self.key, self.value, self.k,
                         exclude_self=self.exclude_self)
        w = F.lit(1.0) if self.weights == "uniform" else 1 / F.greatest(F.col("distance"), F.lit(1e-12))
        near = near.withColumn("_w", w)
        if self.classify:
            votes = near.groupBy(self.key, "value").agg(F.sum("_w").alias("_w"))
            total = F.sum("_w").alias("_t")
            got = votes.groupBy(self.key).agg(
                F.min_by("value", F.struct(-F.col("_w"), F.col("value"))).alias("prediction"),
                total, F.sum(F.when(F.col("value") == 1, F.col("_w")).otherwise(0.0)).alias("_one"))
            got = got.select(self.key, "prediction", (F.col("_one") / F.col("_t")).alias("positive"))
        else:
            got = near.groupBy(self.key).agg((F.sum(F.col("value") * F.col("_w")) / F.sum("_w")).alias("prediction"))
        return df.join(got, self.key, "left")

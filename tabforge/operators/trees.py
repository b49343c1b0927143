"""Regression trees of several targets, grown side by side on features cut into bins once.

A level of all trees is one pass over the rows: tasks add up counts, sums and squares by tree, node, feature and bin, these meet by tree and node,
and the best split of each comes back. Cuts, splits and leaves follow the rules of Spark's regression trees (variance, all features, no least gain).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabforge.plans.scale import lookup_join, materialise, prefix_sums

# Features whose sums travel and are judged together.
CHUNK = 64
# Bytes of sums that a task holds; the nodes of a level beyond it take another pass.
HELD_BYTES = 64 * 1024 * 1024
# Bins that a task looks at together.
CELLS = 1 << 20
_EPSILON = float(np.finfo(float).eps)


class Tree:
    """Nodes as parallel lists, the root first; a leaf has feature -1. A row whose feature is at most ``cut`` (``place`` as a bin) goes left."""

    FIELDS = {"feature": "int", "place": "int", "cut": "double", "left": "int", "right": "int", "value": "double", "gain": "double", "weight": "double"}

    def __init__(self, **fields: Sequence):
        for name in self.FIELDS:
            setattr(self, name, list(fields.get(name, ())))
        if not self.feature:
            self.add(0.0, 0.0)

    def add(self, value: float, weight: float) -> int:
        for name, x in zip(self.FIELDS, (-1, 0, 0.0, 0, 0, value, 0.0, weight)):
            getattr(self, name).append(x)
        return len(self.feature) - 1

    def split(self, node: int, feature: int, place: int, cut: float, gain: float, left: int, right: int) -> None:
        for name, x in zip(("feature", "place", "cut", "gain", "left", "right"), (feature, place, cut, gain, left, right)):
            getattr(self, name)[node] = x

    def steps(self, binned: bool) -> tuple[np.ndarray, ...]:
        limit = np.array(self.place, np.uint8) if binned else np.array(self.cut)
        return np.array(self.feature, np.int32), limit, np.array(self.left, np.int32), np.array(self.right, np.int32)


def reached(x: np.ndarray, steps: tuple[np.ndarray, ...]) -> np.ndarray:
    """The node without a split that each row comes to."""
    feature, limit, left, right = steps
    node = np.zeros(len(x), np.int32)
    rows = np.arange(len(x))
    while len(rows := rows[feature[node[rows]] >= 0]):
        at = node[rows]
        node[rows] = np.where(x[rows, feature[at]] <= limit[at], left[at], right[at])
    return node


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """The rows of a list column of equal lengths."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def bin_matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def feature_cuts(df: DataFrame, x: str, bins: int = 32) -> list[np.ndarray]:
    """Cuts of every entry of the array ``x``: between all values if these are at most ``bins``, else where running counts pass equal shares of the rows.

    Values are counted, and running counts taken, over all rows; of these only the few next to a share are gathered.
    """
    n, width = df.agg(F.count(F.lit(1)), F.max(F.size(x))).first()
    bins = min(bins, n)
    cells = materialise(df.select(F.posexplode(x).alias("_at", "_v")).groupBy("_at", "_v").agg(F.count(F.lit(1)).alias("_n")), columnar=True)
    placed = prefix_sums(cells, ["_at"], [F.col("_v")], {"_upto": F.col("_n"), "_i": F.lit(1).cast("long")})
    # shares passed at the middle of a value's rows, in whole numbers
    share = F.expr(f"((2 * _upto - _n) * {bins} - 1) div {2 * n}")
    placed = materialise(placed.withColumn("_share", share), columnar=True)
    runs = materialise(placed.groupBy("_at", "_share").agg(F.min("_i").alias("_first"), F.max("_v").alias("_last"), F.count(F.lit(1)).alias("_size")))
    # a value of many rows passes several shares, whose cuts fall to the values after it
    near = lookup_join(placed, runs, ["_at", "_share"], "inner").filter(F.col("_i") < F.col("_first") + bins)

    def cut(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_i")
        heads = rows.drop_duplicates("_share")
        # the last value of a run stands in for its rows that were left out
        ends = dict(zip((heads["_first"] + heads["_size"]).tolist(), heads["_last"].tolist()))
        few, found, before = heads["_size"].sum() <= bins, [], {}
        for i, v, s in zip(rows["_i"].tolist(), rows["_v"].tolist(), rows["_share"].tolist()):
            if i > 1 and (few or s > len(found)):
                found.append((before.get(i, ends.get(i)) + v) / 2.0)
            before = {i + 1: v}
        return pd.DataFrame({"_at": rows["_at"].iloc[:1], "cuts": [found]})

    cuts = {r["_at"]: r["cuts"] for r in near.groupBy("_at").applyInPandas(cut, "_at int, cuts array<double>").collect()}
    return [np.array(cuts[i]) for i in range(width)]


def bins_of(x: np.ndarray, cuts: Sequence[np.ndarray]) -> np.ndarray:
    out = np.empty(x.shape, np.uint8)
    for i, c in enumerate(cuts):
        out[:, i] = np.searchsorted(c, x[:, i], side="left")
    return out


def _impurity(n, s, q):
    with np.errstate(all="ignore"):
        return np.where(n > 0, (q - s * s / n) / n, 0.0)


def best_split(total: np.ndarray, cuts: np.ndarray, impurity: float | None) -> tuple:
    """Gain, feature, place, and counts, sums and squares of the node's left and right rows; ``total``: those by (3, feature, bin), ``cuts`` by feature."""
    upto = np.cumsum(total, axis=2)
    left = upto[:, :, :-1] if total.shape[2] > 1 else upto
    right = upto[:, :, -1:] - left
    allowed = np.arange(left.shape[2])[None, :] < cuts[:, None]
    if not allowed.any():
        return (-1.0, -1, 0, *upto[:, 0, -1], 0.0, 0.0, 0.0)
    if impurity is None:
        f = int(np.flatnonzero(cuts)[0])
        impurity = float(_impurity(*(left[:, f, 0] + right[:, f, 0])))
    n = left[0] + right[0]
    gain = impurity - left[0] / n * _impurity(*left) - right[0] / n * _impurity(*right)
    gain = np.where(allowed & (left[0] >= 1) & (right[0] >= 1), gain, -1.0)
    f, place = np.unravel_index(int(np.argmax(gain)), gain.shape)
    return (float(gain[f, place]), int(f), int(place), *left[:, f, place], *right[:, f, place])


def grow(rows: DataFrame, cuts: Sequence[np.ndarray], depth: int, trees: int, targets, columns: Sequence[str]) -> list[Tree]:
    """``trees`` trees over the rows' ``_bins``. ``targets`` gives a batch's values and which rows count, by (row, tree), from ``columns``."""
    width, bins = len(cuts), max(len(c) for c in cuts) + 1
    sizes = np.array([len(c) for c in cuts])
    most, chunks = max(1, CELLS // width), -(-width // CHUNK)
    cores = rows.sparkSession.sparkContext.defaultParallelism
    grown = [Tree() for _ in range(trees)]
    impurity: dict[tuple[int, int], float | None] = {(k, 0): None for k in range(trees)}
    judged = pa.schema([(c, pa.int32()) for c in ("tree", "node", "chunk")] + [("gain", pa.float64())] + [(c, pa.int32()) for c in ("feature", "place")]
                       + [(c, pa.float64()) for c in ("ln", "ls", "lq", "rn", "rs", "rq")])
    fields = ", ".join(f"{f.name} {'int' if f.type == pa.int32() else 'double'}" for f in judged)
    for level in range(max(depth, 1)):
        nodes, splits = list(impurity), []
        at_once = max(1, HELD_BYTES // (24 * width * bins))
        for start in range(0, len(nodes), at_once):
            part = nodes[start:start + at_once]

            def tally(batches: Iterator[pa.RecordBatch], part: list = part) -> Iterator[pa.RecordBatch]:
                wanted = {k: [node for tree, node in part if tree == k] for k in dict(part)}
                steps = {k: grown[k].steps(True) for k in wanted}
                # by feature, node and bin; rows that do not count fall to a node of their own
                sums = {k: np.zeros((3, width * (len(v) + 1) * bins)) for k, v in wanted.items()}
                for batch in (b.slice(i, most) for b in batches for i in range(0, b.num_rows, most)):
                    x = bin_matrix(batch.column("_bins"), width)
                    y, use = targets(batch)
                    turned = np.ascontiguousarray(x.T).astype(np.intp)
                    cell = np.empty_like(turned)
                    for k, some in wanted.items():
                        place = np.full(len(grown[k].feature), len(some))
                        place[some] = np.arange(len(some))
                        place = np.where(use[:, k], place[reached(x, steps[k])], len(some))
                        np.add(turned, np.arange(width)[:, None] * ((len(some) + 1) * bins), out=cell)
                        np.add(cell, place * bins, out=cell)
                        g = y[:, k]
                        for i, weight in enumerate((None, np.tile(g, width), np.tile(g * g, width))):
                            sums[k][i] += np.bincount(cell.ravel(), weight, sums[k].shape[1])
                for k, some in wanted.items():
                    held = sums.pop(k).reshape(3, width, len(some) + 1, bins).transpose(0, 2, 1, 3)
                    full = [i for i in range(len(some)) if held[0, i, 0].any()]
                    keys = [(some[i], c, held[:, i, c * CHUNK:(c + 1) * CHUNK].tobytes()) for i in full for c in range(chunks)]
                    if keys:
                        node, chunk, stats = zip(*keys)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([k] * len(keys), pa.int32()), pa.array(node, pa.int32()), pa.array(chunk, pa.int32()),
                             pa.array([TaskContext.get().partitionId()] * len(keys), pa.int32()), pa.array(stats, pa.binary())],
                            names=["tree", "node", "chunk", "part", "stats"])

            def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                key, total, found = None, None, []
                for batch in batches:
                    keys = zip(*(batch.column(i).to_pylist() for i in range(3)))
                    for one, stats in zip(keys, batch.column(4)):
                        if one != key:
                            found += [] if key is None else [(*key, *split_of(key, total))]
                            key, total = one, 0.0
                        total = total + np.frombuffer(stats.as_buffer()).reshape(3, -1, bins)
                found += [] if key is None else [(*key, *split_of(key, total))]
                yield pa.RecordBatch.from_pylist([dict(zip(judged.names, row)) for row in found], schema=judged)

            def split_of(key: tuple[int, int, int], total: np.ndarray) -> tuple:
                k, node, chunk = key
                gain, f, *rest = best_split(total, sizes[chunk * CHUNK:(chunk + 1) * CHUNK], impurity[k, node])
                return (gain, f + chunk * CHUNK if f >= 0 else -1, *rest)

            sums = rows.select("_bins", *columns).mapInArrow(tally, "tree int, node int, chunk int, part int, stats binary")
            met = sums.repartition(min(cores, len(part) * chunks), "tree", "node", "chunk").sortWithinPartitions("tree", "node", "chunk", "part")
            splits += met.mapInArrow(judge, fields).collect()
        best: dict[tuple[int, int], tuple] = {}
        for r in sorted(splits, key=lambda r: (r.tree, r.node, r.chunk)):
            if (r.tree, r.node) not in best or r.gain > best[r.tree, r.node].gain:
                best[r.tree, r.node] = r
        impurity = {}
        for (k, node), r in best.items():
            tree = grown[k]
            if level == 0:
                n, s = r.ln + r.rn, r.ls + r.rs
                tree.value[0], tree.weight[0] = s / n, n
            if r.gain <= 0 or depth == 0:
                continue
            sides = [(r.ln, r.ls, r.lq), (r.rn, r.rs, r.rq)]
            left, right = (tree.add(s / n, n) for n, s, _ in sides)
            tree.split(node, r.feature, r.place, float(cuts[r.feature][r.place]), r.gain, left, right)
            for child, side in zip((left, right), sides):
                rest = float(_impurity(*map(np.float64, side)))
                if level + 1 < depth and abs(rest) >= _EPSILON:
                    impurity[k, child] = rest
        if not impurity:
            break
    return grown

"""Embedding near-duplicates: every pair above a cosine threshold, by dual traversal of cover trees.

Links join vectors of equal label (and length) whose cosine reaches the threshold; on unit vectors that is a Euclidean distance of at most
sqrt(2 - 2 t). Equal vectors of a label are one class and count with their number, so copies never meet each other.

Cover trees. The classes of a label are cut into cells: each class goes to the nearest of its label's pivots (a bounded, hash-chosen sample;
it decides only where a class is looked at, never whether). A cell is held in trees of ``TREE_ROWS`` classes. A tree's levels are nested
(a node's own centre is its first child) and their radii halve: the children of a node of radius R are centres more than R/2 apart that cover its
points within R/2. Every node also stores its exact covering radius.

Dual traversal. Two trees (or a tree with itself) are walked from the pair of roots. With centres d apart and covering radii r and s, a pair of
nodes is dropped if d - r - s is above the threshold distance, settled as a whole if d + r + s is below it (its points are counted and joined
without being listed), else replaced by the pairs of their children; points and leaves are compared in double precision. Pairs of cells are
dropped by the same bound before any vector is shipped.

Scale. A task holds one cell (at most ``CELL_BYTES`` of vectors) and streams the trees of another, so a class is shipped once per cell that its
own can reach. Larger cells are cut by hash, and each piece meets the others: nothing is capped. A task passes on one row per
linked class and cell: its number of links and one class of its component; pairs are never rows. Components come from
min-label rounds with pointer jumping on those rows, each written to the shared folder. The driver holds the pivots, at most about ``PIVOTS``
vectors.

Defined cases: rows with a null label, and vectors that are null, empty, zero or hold null or non-finite components, link with nothing; vectors
of different lengths never link; null ids: a component's id is its smallest non-null id (null if it has none), a row is kept when its id
equals it, null equal to null; repeated ids are rows of their own; repeated rows link with each other; an empty table gives no rows. Other
columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabforge.llm.common import drop, give_back, keep
from tabforge.llm.minmax_dedup import components
from tabforge.llm.vectors import matrices, packed, packed_floats, unpacked_floats
from tabforge.plans.scale import lookup_join

LEAF = 24
TREE_ROWS = 2048
CELL_BYTES = 32 << 20
PIVOTS = 16_384  # expected number of pivots of all labels together
PAIR_CELLS = 1 << 20  # node pairs looked at together
POINT_CELLS = 1 << 12  # two nodes with no more pairs of points are compared point by point at once
COARSER = 4  # so are nodes with fewer pairs of points for each pair of children
# Distances on the unit sphere near zero are known to about 1e-8; within this margin of the threshold pairs are compared themselves.
MARGIN = 1e-6
NEAR = 1e-9  # cosines this close to the threshold are computed again, from the vectors as they are


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that neither squares overflow nor small vectors vanish."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows**2).sum(axis=1, keepdims=True))


def apart(products: np.ndarray) -> np.ndarray:
    """Distances of unit vectors from their inner products."""
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * products))


class CoverTree:
    """Nodes in arrays: centre (a point), covering radius, first and last point, first child and number of children (0: a leaf)."""

    def __init__(self, names: np.ndarray, weights: np.ndarray, rows: np.ndarray):
        units = unit(rows)
        order: list[np.ndarray] = []
        nodes: list[list] = []
        placed = 0
        # depth first, children of a node next to each other: points of a node are consecutive
        waiting: list[tuple[int, np.ndarray, int]] = []

        def add(members: np.ndarray, centre: int) -> int:
            gap = apart(units[members] @ units[centre])
            gap[members == centre] = 0.0
            nodes.append([centre, float(gap.max()), 0, 0, -1, 0])
            return len(nodes) - 1

        top = add(np.arange(len(rows)), 0)
        waiting.append((top, np.arange(len(rows)), 0))
        while waiting:
            at, members, centre = waiting.pop()
            radius = nodes[at][1]
            nodes[at][2] = placed
            nodes[at][3] = placed + len(members)
            if len(members) <= LEAF or radius <= MARGIN:
                order.append(members)
                placed += len(members)
                continue
            half = 2.0
            while half >= radius:
                half /= 2
            groups = self._net(units[members], int(np.flatnonzero(members == centre)[0]), half)
            children = [(add(members[g], int(members[c])), members[g], int(members[c])) for c, g in groups]
            nodes[at][4], nodes[at][5] = children[0][0], len(children)
            waiting += reversed(children)
        self.order = np.concatenate(order)
        self.names, self.weights, self.rows = names[self.order], weights[self.order], rows[self.order]
        place = np.empty(len(rows), dtype=np.int64)
        place[self.order] = np.arange(len(rows))
        self.centre = place[np.array([n[0] for n in nodes])]
        self.radius = np.array([n[1] for n in nodes])
        self.lo, self.hi, self.child, self.children = (np.array([n[i] for n in nodes]) for i in (2, 3, 4, 5))
        self.finish()

    @staticmethod
    def _net(units: np.ndarray, first: int, half: float) -> list[tuple[int, np.ndarray]]:
        """Centres more than ``half`` apart, each with the points it covers within ``half``; ``first`` is one of them."""
        near = apart(units @ units.T) <= half
        np.fill_diagonal(near, True)
        free = np.ones(len(units), dtype=bool)
        out, centre = [], first
        while True:
            covered = np.flatnonzero(near[centre] & free)
            out.append((centre, covered))
            free[covered] = False
            left = np.flatnonzero(free)
            if not len(left):
                return out
            centre = int(left[0])

    def finish(self) -> None:
        self.units = unit(self.rows)
        self.sums = np.concatenate([[0], np.cumsum(self.weights)])

    def __getstate__(self):
        held = {k: v for k, v in self.__dict__.items() if k not in ("units", "sums", "order")}
        small = held["rows"].astype(np.float32)
        return held | {"rows": small if (small == held["rows"]).all() else held["rows"]}

    def __setstate__(self, held):
        self.__dict__ = held
        self.rows = self.rows.astype(np.float64)
        self.finish()


class Found:
    """Numbers of links and components of the points of several trees, numbered one after the other."""

    def __init__(self, size: int):
        self.links = np.zeros(size, dtype=np.int64)
        self.root = np.arange(size)
        self._edges: list[tuple[np.ndarray, np.ndarray]] = []
        self._held = 0

    def grow(self, size: int) -> None:
        self.links = np.concatenate([self.links, np.zeros(size, dtype=np.int64)])
        self.root = np.concatenate([self.root, np.arange(len(self.root), len(self.root) + size)])

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        if not len(a):
            return
        self._edges.append((a, b))
        self._held += len(a)
        if self._held > 1 << 18:
            self.settle()

    def settle(self) -> None:
        """Take the edges so far into the components."""
        if not self._edges:
            return
        a, b = (np.concatenate([e[i] for e in self._edges]) for i in (0, 1))
        self._edges, self._held = [], 0
        while True:
            low, high = np.minimum(self.root[a], self.root[b]), np.maximum(self.root[a], self.root[b])
            open_ = low < high
            if not open_.any():
                return
            a, b, low, high = a[open_], b[open_], low[open_], high[open_]
            np.minimum.at(self.root, high, low)
            while True:
                further = self.root[self.root]
                if (further == self.root).all():
                    break
                self.root = further


def exact(a: np.ndarray, b: np.ndarray) -> float:
    """The cosine of two vectors."""
    a, b = a / np.abs(a).max(), b / np.abs(b).max()
    return math.fsum(a * b) / (math.sqrt(math.fsum(a * a)) * math.sqrt(math.fsum(b * b)))


def linked(products: np.ndarray, one: CoverTree, some: np.ndarray, two: CoverTree, others: np.ndarray, least: float) -> np.ndarray:
    """Which of the pairs of points with these inner products reach the threshold."""
    out = products >= least
    for i in np.flatnonzero(np.abs(products - least) < NEAR):
        out[i] = exact(one.rows[some[i]], two.rows[others[i]]) >= least
    return out


def traverse(one: CoverTree, two: CoverTree, found: Found, at_one: int, at_two: int, least: float) -> None:
    """Links between two trees, or within one (``one is two``); their points begin at ``at_one`` and ``at_two``."""
    alone = one is two
    limit = math.sqrt(2.0 - 2.0 * least)

    # what holds for ranges of points is noted at their ends and summed up once
    more = [np.zeros(len(one.names) + 1, dtype=np.int64)]
    chained = [np.zeros(len(one.names) + 1, dtype=np.int64)]
    own_ = np.zeros(len(one.names) + 1, dtype=np.int64)
    more += more if alone else [np.zeros(len(two.names) + 1, dtype=np.int64)]
    chained += chained if alone else [np.zeros(len(two.names) + 1, dtype=np.int64)]

    def settle(a: np.ndarray, b: np.ndarray) -> None:
        """All points of each pair of nodes link."""
        same = (a == b) & alone
        for side, tree, nodes, weights in ((0, one, a, two.sums[two.hi[b]] - two.sums[two.lo[b]]), (1, two, b, one.sums[one.hi[a]] - one.sums[one.lo[a]])):
            some = ~same if side else slice(None)
            np.add.at(more[side], tree.lo[nodes[some]], weights[some])
            np.add.at(more[side], tree.hi[nodes[some]], -weights[some])
            nodes = np.unique(nodes)
            np.add.at(chained[side], tree.lo[nodes] + 1, 1)
            np.add.at(chained[side], tree.hi[nodes], -1)
        np.add.at(own_, one.lo[a[same]], 1)
        np.add.at(own_, one.hi[a[same]], -1)
        found.join(at_one + one.lo[a], at_two + two.lo[b])

    def sum_up() -> None:
        for side, tree, at in ((0, one, at_one), (1, two, at_two))[:1 if alone else 2]:
            found.links[at:at + len(tree.names)] += np.cumsum(more[side])[:-1]
            after = np.flatnonzero(np.cumsum(chained[side])[:-1])
            found.join(at + after - 1, at + after)
        if alone:
            found.links[at_one:at_one + len(one.names)] -= one.weights * np.cumsum(own_)[:-1]

    def pairs(i: np.ndarray, j: np.ndarray) -> None:
        """Points that link, pair by pair."""
        np.add.at(found.links, at_one + i, two.weights[j])
        np.add.at(found.links, at_two + j, one.weights[i])
        found.join(at_one + i, at_two + j)

    def points(a: int, b: int) -> None:
        others = np.arange(two.lo[b], two.hi[b])
        step = max(1, PAIR_CELLS // len(others))  # a leaf of equal directions can be long
        for lo in range(one.lo[a], one.hi[a], step):
            some = np.arange(lo, min(lo + step, one.hi[a]))
            products = one.units[some] @ two.units[others].T
            near = products >= least - NEAR
            if alone and a == b:
                near &= some[:, None] < others[None, :]
            for i, j in zip(*np.nonzero(near & (products < least + NEAR))):
                near[i, j] = exact(one.rows[some[i]], two.rows[others[j]]) >= least
            if near.any():
                hits = near.astype(np.float64)
                found.links[at_one + some] += (hits @ two.weights[others].astype(np.float64)).astype(np.int64)
                found.links[at_two + others] += (one.weights[some].astype(np.float64) @ hits).astype(np.int64)
                i, j = np.nonzero(near)
                open_ = found.root[at_one + some[i]] != found.root[at_two + others[j]]
                found.join(at_one + some[i[open_]], at_two + others[j[open_]])

    def below(tree: CoverTree, node: int) -> np.ndarray:
        return np.arange(tree.child[node], tree.child[node] + tree.children[node]) if tree.children[node] else np.array([node])

    waiting = [(0, 0)]
    while waiting:
        a, b = waiting.pop()
        own, other = below(one, a), below(two, b)
        # points are compared themselves where they are few, or where the children are hardly fewer
        if (one.hi[a] - one.lo[a]) * (two.hi[b] - two.lo[b]) <= max(POINT_CELLS, COARSER * len(own) * len(other)) or len(own) * len(other) == 1:
            points(a, b)
            continue
        step = max(1, PAIR_CELLS // len(other))
        for at in range(0, len(own), step):
            some = own[at:at + step]
            products = one.units[one.centre[some]] @ two.units[two.centre[other]].T
            gaps = apart(products)
            reach = one.radius[some][:, None] + two.radius[other][None, :]
            if alone and a == b:
                gaps[some[:, None] == other[None, :]] = 0.0
            open_ = gaps - reach <= limit + MARGIN
            if alone and a == b:
                open_ &= some[:, None] <= other[None, :]
            # nodes of one point each are compared at once
            single = (one.hi[some] - one.lo[some] == 1)[:, None] & (two.hi[other] - two.lo[other] == 1)[None, :]
            i, j = np.nonzero(open_ & single)
            if len(i):
                p, q = one.centre[some[i]], two.centre[other[j]]
                hit = linked(products[i, j], one, p, two, q, least)
                if alone:
                    hit &= p != q
                if hit.any():
                    pairs(p[hit], q[hit])
            open_ &= ~single
            sure = open_ & (gaps + reach <= limit - MARGIN)
            i, j = np.nonzero(sure)
            if len(i):
                settle(some[i], other[j])
            waiting += [(some[i], other[j]) for i, j in zip(*np.nonzero(open_ & ~sure))]
    sum_up()


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``id, label, name, dim, vector``: a digest, the length and the bytes of the vectors that can link."""
    for batch in batches:
        names: list = [None] * batch.num_rows
        dims: list = [None] * batch.num_rows
        vectors: list = [None] * batch.num_rows
        for at, rows in matrices(batch.column(2)):
            some = np.abs(rows).max(axis=1) > 0
            whole = rows[some] + 0.0  # no negative zeros
            for i, row, short in zip(at[some], packed(whole), packed_floats(whole)):
                names[i], dims[i], vectors[i] = hashlib.md5(row).digest(), rows.shape[1], short
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(names, pa.binary()), pa.array(dims, pa.int32()), pa.array(vectors, pa.binary())],
            names=["id", "label", "name", "dim", "vector"])
    give_back()


def _celled(pivots: dict[int, np.ndarray]):
    """Adds the nearest pivot of the group and the distance to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups = batch.column("group").to_numpy()
            cells, gaps = np.zeros(len(groups), dtype=np.int32), np.full(len(groups), 2.0)
            for group in np.unique(groups):
                if group in pivots:
                    at = np.flatnonzero(groups == group)
                    for lo in range(0, len(at), 2048):
                        some = at[lo:lo + 2048]
                        rows = unpacked_floats(batch.column("vector").take(pa.array(some)), pivots[group].shape[1])
                        products = unit(rows) @ pivots[group].T
                        cells[some], gaps[some] = products.argmax(axis=1), apart(products.max(axis=1)) + MARGIN
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells), pa.array(gaps)], names=[*batch.schema.names, "cell", "gap"])
        give_back()

    return run


def _trees(tree_rows: int):
    """Cover trees of the classes of each block, which come one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, size = None, [], 0

        def built() -> pa.RecordBatch:
            names, weights, rows = (np.concatenate([h[i] for h in held]) for i in range(3))
            tree = pickle.dumps(CoverTree(names, weights, rows), protocol=5)
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([tree], pa.binary())], names=["block", "tree"])

        for batch in batches:
            blocks = batch.column("block").to_numpy()
            borders = np.flatnonzero(np.diff(blocks)) + 1
            for part in np.split(np.arange(len(blocks)), borders):
                at = 0
                while at < len(part):
                    if held and (blocks[part[0]] != block or size == tree_rows):
                        yield built()
                        held, size = [], 0
                    block = int(blocks[part[0]])
                    some = part[at:at + tree_rows - size]
                    cut = batch.slice(some[0], len(some))
                    held.append((cut.column("node").to_numpy(), cut.column("weight").to_numpy(), unpacked_floats(cut.column("vector"), cut.column("dim")[0].as_py())))
                    size, at = size + len(some), at + len(some)
        if held:
            yield built()
        give_back()

    return run


def _joined(least: float):
    """Links between the trees of two blocks: those of the first are held, those of the second go by."""

    def rows(found: Found, names: np.ndarray, lo: int, hi: int) -> pa.RecordBatch:
        found.settle()
        at = np.flatnonzero(found.links[lo:hi]) + lo
        return pa.RecordBatch.from_arrays(
            [pa.array(names[at]), pa.array(found.links[at]), pa.array(names[found.root[at]])], names=["node", "links", "root"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, held, starts, found, names = None, [], [], None, None

        def done() -> pa.RecordBatch:
            return rows(found, names, 0, len(names))

        for batch in batches:
            for row in batch.to_pylist():
                if (row["a"], row["b"]) != pair:
                    if pair is not None:
                        yield done()
                    pair, held, starts, found, names = (row["a"], row["b"]), [], [], Found(0), np.zeros(0, np.int64)
                tree = pickle.loads(row["tree"])
                start = len(names)
                found.grow(len(tree.names))
                if row["role"] == 0:
                    names = np.concatenate([names, tree.names])
                    held.append(tree)
                    starts.append(start)
                    if pair[0] == pair[1]:
                        for other, at in zip(held, starts):
                            traverse(other, tree, found, at, start, least)
                    continue
                for other, at in zip(held, starts):
                    traverse(other, tree, found, at, start, least)
                yield rows(found, np.concatenate([names, tree.names]), start, start + len(tree.names))
                found.links, found.root = found.links[:start], found.root[:start]
        if pair is not None:
            yield done()
        give_back()

    return run


def _reach(pivots: dict[int, np.ndarray], least: float):
    """The pairs of blocks whose cells' bounds leave a link possible."""
    limit = math.sqrt(2.0 - 2.0 * least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = {n: batch.column(n).to_numpy() for n in batch.schema.names}
            near = np.ones(batch.num_rows, dtype=bool)
            for i, group in enumerate(t["group"]):
                if t["cell_a"][i] != t["cell_b"][i]:
                    centres = pivots[group]
                    gap = apart(centres[t["cell_a"][i]] @ centres[t["cell_b"][i]])
                    near[i] = gap - t["radius_a"][i] - t["radius_b"][i] <= limit + 4 * MARGIN
            yield batch.select(["a", "b"]).filter(pa.array(near))

    return run


def _pivots(classes: DataFrame, groups: DataFrame, cell_bytes: int, expected: int) -> dict[int, np.ndarray]:
    """Pivots of the groups that are larger than a cell, chosen by hash: about two a cell, about ``expected`` in all at most."""
    want = F.ceil(F.col("n") * F.col("dim") * 8 / F.lit(cell_bytes))
    large = groups.withColumn("want", 2 * want).filter("want > 2")
    total = large.agg(F.sum("want")).first()[0]
    if not total:
        return {}
    share = F.col("want") / F.col("n") * min(1.0, expected / total)
    some = lookup_join(classes.select("group", "dim", "node", "vector"), large.select("group", share.alias("share")), "group", "inner")
    fraction = F.pmod(F.xxhash64("node"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen: dict[int, list] = {}
    for row in some.filter(fraction < F.col("share")).select("group", "dim", "node", "vector").collect():
        chosen.setdefault(row["group"], []).append((row["node"], row["dim"], bytes(row["vector"])))
    return {g: unit(unpacked_floats(pa.array([v for _, _, v in sorted(found)]), found[0][1])) for g, found in chosen.items()}


def near_vectors(
    df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", least: float = 0.93, cell_bytes: int = CELL_BYTES,
    tree_rows: int = TREE_ROWS, pivots: int = PIVOTS,
) -> DataFrame:
    """Per row: ``key, n_links, component_id, kept``."""
    if not 0 < least < 1:
        raise ValueError("the threshold lies between 0 and 1")
    spark = df.sparkSession
    kind = df.schema[label].dataType.simpleString()
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("vector"))
    rows = rows.withColumn("vector", F.when(F.col("label").isNotNull(), F.col("vector")))
    signed = keep(rows.mapInArrow(_vectors, f"id long, label {kind}, name binary, dim int, vector binary"))
    usable = signed.filter("name IS NOT NULL")

    classes = usable.groupBy("label", "name", "dim").agg(F.count(F.lit(1)).alias("weight"), F.min("id").alias("least"), F.first("vector").alias("vector"))
    classes = keep(classes.withColumn("node", F.monotonically_increasing_id()))
    groups = keep(classes.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n")).withColumn("group", F.monotonically_increasing_id()))
    grouped = lookup_join(classes.select("label", "dim", "node", "weight", "vector"), groups, ["label", "dim"], "inner").drop("label")
    centres = _pivots(grouped, groups, cell_bytes, pivots)
    celled = keep(grouped.select("group", "dim", "node", "weight", "vector").mapInArrow(
        _celled(centres), "group long, dim int, node long, weight long, vector binary, cell int, gap double"))

    # a cell beyond the size of a block is cut by hash
    cells = celled.groupBy("group", "cell", "dim").agg(F.count(F.lit(1)).alias("n"), F.max("gap").alias("radius"))
    cells = cells.withColumn("parts", F.ceil(F.col("n") * F.col("dim") * 8 / F.lit(cell_bytes)).cast("int"))
    blocks = cells.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    blocks = keep(blocks.select("group", "cell", "parts", "part", "radius").withColumn("block", F.monotonically_increasing_id()))
    sizes = blocks.select("group", "cell", "parts").distinct()
    parted = lookup_join(celled, sizes, ["group", "cell"], "inner").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts").cast("long")).cast("int"))
    parted = lookup_join(parted, blocks.select("group", "cell", "part", "block"), ["group", "cell", "part"], "inner").select("block", "dim", "node", "weight", "vector")
    number = blocks.count()
    dealt = parted.repartition(_tasks(number), "block").sortWithinPartitions("block", "node")
    trees = keep(dealt.mapInArrow(_trees(tree_rows), "block long, tree binary"))

    one = blocks.select("group", F.col("block").alias("a"), F.col("cell").alias("cell_a"), F.col("radius").alias("radius_a"))
    two = blocks.select("group", F.col("block").alias("b"), F.col("cell").alias("cell_b"), F.col("radius").alias("radius_b"))
    meet = keep(one.join(two, (one["group"] == two["group"]) & (F.col("a") <= F.col("b"))).drop(two["group"]).mapInArrow(_reach(centres, least), "a long, b long"))
    held = meet.join(trees.withColumnRenamed("block", "a"), "a").select("a", "b", F.lit(0).alias("role"), "tree")
    streamed = meet.filter("a < b").join(trees.withColumnRenamed("block", "b"), "b").select("a", "b", F.lit(1).alias("role"), "tree")
    work = held.union(streamed).repartition(_tasks(meet.count()), "a", "b").sortWithinPartitions("a", "b", "role")
    found = keep(work.mapInArrow(_joined(least), "node long, links long, root long"))
    for table in (celled, trees):
        drop(table)

    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    edges = keep(found.filter("node <> root").select(F.least("node", "root").alias("a"), F.greatest("node", "root").alias("b")).distinct())
    reached = classes.select("label", "name", "node", "weight", "least").join(links, "node", "left").join(components(edges).withColumnRenamed("label", "top"), "node", "left")
    reached = keep(reached.select("label", "name", "weight", "least", "links", F.coalesce("top", "node").alias("top")))
    tops = reached.groupBy("top").agg(F.min("least").alias("component_id"))
    answers = reached.join(tops, "top").select("label", "name", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id")

    out = _answered(signed, answers)
    return out.select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), "component_id",
                      F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def _answered(signed: DataFrame, answers: DataFrame) -> DataFrame:
    rows = signed.select("id", "label", "name")
    linked_ = rows.filter("name IS NOT NULL").join(answers, ["label", "name"], "left").select("id", "n_links", "component_id")
    none = rows.filter("name IS NULL").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked_.union(none)


def _tasks(pieces: int) -> int:
    """Partitions for so many pieces of work: several times as many, as keys are dealt by hash."""
    return max(1, min(4 * pieces, 20_000))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label"))


SQL = """
WITH RECURSIVE v AS MATERIALIZED (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len([1 for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0 AND len([1 for x in embedding if x <> 0]) > 0
), l AS MATERIALIZED (
  SELECT a.vec_id, b.vec_id AS other FROM v AS a JOIN v AS b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), r AS (
  SELECT vec_id, vec_id AS reached FROM embeddings UNION SELECT r.vec_id, l.other FROM r JOIN l ON r.reached = l.vec_id
), c AS (
  SELECT vec_id, min(reached) AS component_id FROM r GROUP BY vec_id
), n AS (
  SELECT vec_id, count(*) AS n_links FROM l GROUP BY vec_id
)
SELECT c.vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, c.vec_id = component_id AS kept FROM c LEFT JOIN n ON c.vec_id = n.vec_id
"""

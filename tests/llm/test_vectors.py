"""Operators on embeddings: brute force on small tables, bounds, edge cases."""

import collections
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabforge.llm import cover_join, hard_negatives, vector_codes

SCHEMA = "vec_id long, embedding array<double>, label int, node long, block string, codes string"
NAN, INF = float("nan"), float("inf")
ODD = [
    (1, [1.0, 2.0, 3.0, 4.0], 1, 1, "x", "x"), (1, [1.0, 2.0, 3.0, 4.0], 1, 1, "x", "x"), (2, [2.0, 4.0, 6.0, 8.0], 1, None, None, None),
    (3, None, 1, None, None, None), (4, [], 1, None, None, None), (5, [0.0, 0.0, 0.0, 0.0], 1, None, None, None),
    (6, [1.0, None, 3.0, 4.0], 1, None, None, None), (7, [1.0, NAN, 3.0, 4.0], 1, None, None, None), (8, [1.0, INF, 3.0, 4.0], 1, None, None, None),
    (9, [1.0, 2.0, 3.0, 4.0], None, None, None, None), (None, [1.0, 2.0, 3.0, 4.1], 1, None, None, None), (10, [1.0, 2.0, 3.0], 1, None, None, None),
    (11, [1e200, 2e200, 3e200, 4e200], 1, None, None, None), (12, [-1.0, -2.0, -3.0, -4.0], 2, None, None, None), (None, [5.0, -1.0, 0.0, 0.0], 3, None, None, None),
    (100, [1.0, 2.0, 3.0, 4.0], 2, None, None, None),
]


@pytest.fixture
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def clusters(n, dim, seed, labels=3, spread=0.15):
    """Rows in clusters, with copies and ties."""
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((max(2, n // 12), dim))
    rows = centres[rng.integers(0, len(centres), n)] + spread * rng.standard_normal((n, dim)) * rng.random((n, 1))
    rows[rng.integers(0, n, n // 10)] = rows[0]
    return [(int(i), [float(x) for x in row], int(rng.integers(0, labels)), None, None, None) for i, row in enumerate(rows)]


def usable(vector):
    return vector is not None and len(vector) > 0 and all(x is not None and math.isfinite(x) for x in vector)


def brute_links(rows, least):
    """Links and components by comparing everything."""
    good = [usable(r[1]) and any(r[1]) and r[2] is not None for r in rows]
    links = collections.defaultdict(set)
    for i, a in enumerate(rows):
        for j in range(i):
            b = rows[j]
            if good[i] and good[j] and a[2] == b[2] and len(a[1]) == len(b[1]) and cover_join.exact(np.array(a[1]), np.array(b[1])) >= least:
                links[i].add(j)
                links[j].add(i)
    out, seen = {}, set()
    for i in range(len(rows)):
        if i in seen:
            continue
        group, open_ = {i}, [i]
        while open_:
            for j in links[open_.pop()] - group:
                group.add(j)
                open_.append(j)
        seen |= group
        least_id = min((rows[j][0] for j in group if rows[j][0] is not None), default=None)
        for j in group:
            out[j] = (rows[j][0], len(links[j]), least_id, rows[j][0] == least_id)
    return sorted(out.values(), key=repr)


def linked(df, **options):
    return sorted((tuple(r) for r in cover_join.near_vectors(df, **options).collect()), key=repr)


@pytest.mark.parametrize("n, dim, spread, options", [
    (400, 16, 0.5, {}), (300, 3, 0.4, {"tree_rows": 64}), (500, 8, 0.6, {"cell_bytes": 2048, "tree_rows": 16}), (260, 2, 2.0, {"cell_bytes": 1024, "pivots": 4}),
    (200, 5, 0.3, {"cell_bytes": 512, "pivots": 1})])
def test_links_equal_brute_force(spark, n, dim, spread, options):
    rows = clusters(n, dim, n, spread=spread)
    assert linked(spark.createDataFrame(rows, SCHEMA), **options) == brute_links(rows, 0.93)


def test_links_of_odd_rows(spark, odd, none):
    assert linked(odd) == brute_links(ODD, 0.93)
    assert linked(odd, cell_bytes=64, tree_rows=1) == brute_links(ODD, 0.93)
    assert linked(none) == []


def test_links_at_the_threshold(spark):
    """Cosines of exactly 3/5 and just below; a large group of copies counts with its number."""
    rows = [(1, [1.0, 0.0], 1, None, None, None), (2, [3.0, 4.0], 1, None, None, None), (3, [2.9999999, 4.0], 1, None, None, None)]
    rows += [(i, [-1.0, 0.0], 1, None, None, None) for i in range(10, 40)]
    assert linked(spark.createDataFrame(rows, SCHEMA), least=0.6) == brute_links(rows, 0.6)


@pytest.mark.parametrize("spread, dim", [(0.01, 8), (0.1, 24), (0.24, 64), (1.0, 2), (3.0, 3)])
def test_traversal_counts_every_pair(spread, dim):
    rng = np.random.default_rng(dim)
    rows = np.ones((700, dim)) + spread * rng.standard_normal((700, dim))
    weights = rng.integers(1, 4, 700)
    trees = [cover_join.CoverTree(p, weights[p], rows[p]) for p in np.array_split(np.arange(700), 3)]
    starts = np.cumsum([0, *[len(t.names) for t in trees]])
    found = cover_join.Found(700)
    for j in range(3):
        for i in range(j + 1):
            cover_join.traverse(trees[i], trees[j], found, starts[i], starts[j], 0.93)
    found.settle()
    units = cover_join.unit(rows)
    near = units @ units.T >= 0.93
    np.fill_diagonal(near, False)
    names = np.concatenate([t.names for t in trees])
    assert (found.links == (near @ weights)[names]).all()
    for a, b in zip(*np.nonzero(near[np.ix_(names, names)])):
        assert found.root[a] == found.root[b]


def test_levels_are_nested_and_halve():
    rows = np.random.default_rng(5).standard_normal((300, 3))
    tree = cover_join.CoverTree(np.arange(300), np.ones(300, dtype=np.int64), rows)
    assert sorted(tree.names) == list(range(300))
    for node in range(len(tree.radius)):
        points = np.arange(tree.lo[node], tree.hi[node])
        gaps = cover_join.apart(tree.units[points] @ tree.units[tree.centre[node]])
        assert tree.centre[node] in points and gaps.max() <= tree.radius[node] + 1e-7
        if tree.children[node]:
            below = np.arange(tree.child[node], tree.child[node] + tree.children[node])
            assert tree.centre[below[0]] == tree.centre[node]
            assert sorted(np.concatenate([np.arange(tree.lo[c], tree.hi[c]) for c in below])) == list(points)
            half = 2.0
            while half >= tree.radius[node]:
                half /= 2
            assert (tree.radius[below] <= half + 1e-7).all()


def brute_negatives(rows, scale, wanted_p, wanted_n, percent, step):
    good = [(r[0], r[2], [max(-(1 << 31), min(1 << 31, math.floor(scale * x))) for x in r[1]]) for r in rows
            if r[0] is not None and r[2] is not None and usable(r[1])]
    out = []
    for anchor, label, v in good:
        if anchor % step:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), i, other) for i, other, w in good if i != anchor and len(w) == len(v))
        for minus, positive, _ in [s for s in scored if s[2] == label][:wanted_p]:
            fit = [s for s in scored if s[2] != label and percent * -minus <= 100 * -s[0] <= 100 * -minus][:wanted_n]
            out += [(anchor, positive, rank + 1, s[1], -minus, -s[0]) for rank, s in enumerate(fit)]
    return sorted(out)


def mined(df, step, **options):
    return sorted(tuple(r) for r in hard_negatives.hard_negatives(df, F.col("vec_id") % step == 0, **options).collect())


@pytest.mark.parametrize("n, dim, options", [
    (300, 16, {}), (400, 3, {"scale": 4, "salts": 3}), (250, 70, {"block": 8, "salts": 2}), (300, 5, {"scale": 2, "n_positives": 2, "n_negatives": 7, "percent": 50})])
def test_negatives_equal_brute_force(spark, monkeypatch, n, dim, options):
    monkeypatch.setattr(hard_negatives, "TILE", 1 << 10)
    rows = clusters(n, dim, dim)
    wanted = brute_negatives(rows, options.get("scale", 256), options.get("n_positives", 5), options.get("n_negatives", 5), options.get("percent", 80), 7)
    assert mined(spark.createDataFrame(rows, SCHEMA), 7, **options) == wanted


def test_negatives_of_odd_rows(spark, odd, none):
    assert mined(odd, 1) == brute_negatives(ODD, 256, 5, 5, 80, 1)
    assert mined(none, 1) == []


@pytest.mark.parametrize("dim", [1, 7, 64, 130])
def test_intervals_hold(dim):
    """Every score lies in its interval, also for vectors along an axis and of very different lengths."""
    rng = np.random.default_rng(dim)
    rows = np.concatenate([rng.integers(-300, 300, (200, dim)), np.eye(dim, dtype=np.int64)[:20] * 10**6, np.zeros((1, dim), dtype=np.int64), rng.integers(-2**31, 2**31, (20, dim))])
    low, high = hard_negatives.Planes(rows).intervals(np.arange(len(rows)), hard_negatives.Codes(rows))
    scores = (rows.astype(object) @ rows.astype(object).T)
    assert (low <= scores.astype(float)).all() and (scores.astype(float) <= high).all()
    if dim == 64:  # and is narrower than what lengths alone would say
        lengths = np.sqrt((rows[:200].astype(float) ** 2).sum(axis=1))
        assert ((high - low)[:200, :200] / 2 < 0.75 * lengths[:, None] * lengths).mean() > 0.9


def lloyd(rows, scale, parts, entries, rounds):
    """All entries every time, in plain integers."""
    kept = [(r[0], r[2], [max(-(1 << 53), min(1 << 53, math.floor(scale * x) if math.isfinite(scale * x) else (1 << 53) * (1 if x > 0 else -1))) for x in r[1]])
            for r in rows if usable(r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    if not kept:
        return [], []
    dim = len(kept[0][2])
    kept = [r for r in kept if len(r[2]) == dim]
    cut = [p * dim // parts for p in range(parts + 1)]
    books = [[list(r[2][cut[p]:cut[p + 1]]) for r in kept[:entries]] for p in range(parts)]

    def assign():
        return [[min((sum((x - y) ** 2 for x, y in zip(r[2][cut[p]:cut[p + 1]], c)), e) for e, c in enumerate(books[p])) for p in range(parts)] for r in kept]

    for _ in range(rounds):
        codes = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                own = [r[2][cut[p]:cut[p + 1]] for r, c in zip(kept, codes) if c[p][1] == e]
                if own:
                    books[p][e] = [sum(x) // len(own) for x in zip(*own)]
    codes = assign()
    errors = [min((1 << 63) - 1, sum(d for d, _ in c)) for c in codes]
    by_label = collections.Counter()
    for r, e in zip(kept, errors):
        by_label[r[1]] += e
    out = [(r[0], "".join(f"{e:02x}" for _, e in c), err, min((1 << 63) - 1, by_label[r[1]])) for r, c, err in zip(kept, codes, errors)]
    return sorted(out, key=repr), books


@pytest.mark.parametrize("n, dim, options", [(300, 8, {"entries": 16}), (200, 10, {"parts": 3, "entries": 40, "scale": 2}), (50, 4, {}), (120, 6, {"parts": 1, "entries": 5, "rounds": 30})])
def test_codes_equal_plain_lloyd(spark, n, dim, options):
    rows = clusters(n, dim, n)
    wanted, books = lloyd(rows, options.get("scale", 1024), options.get("parts", 4), options.get("entries", 256), options.get("rounds", 4))
    out, found = vector_codes.compress(spark.createDataFrame(rows, SCHEMA).repartition(5), **options)
    assert sorted((tuple(r) for r in out.collect()), key=repr) == wanted
    assert [b.tolist() for b in found] == books


def test_codes_of_odd_rows(spark, odd, none):
    wanted, books = lloyd(ODD, 1024, 4, 256, 4)
    out, found = vector_codes.compress(odd)
    assert sorted((tuple(r) for r in out.collect()), key=repr) == wanted
    assert [b.tolist() for b in found] == books
    out, found = vector_codes.compress(none)
    assert out.collect() == [] and found == [] and out.columns == ["vec_id", "code", "error", "label_error"]


def test_settled_parts_compare_only_moved_entries(monkeypatch):
    """Same result as a full scan, from fewer comparisons; ties go to the lower entry whether it moved or not."""
    rng = np.random.default_rng(3)
    compared = []
    full = vector_codes.nearest
    monkeypatch.setattr(vector_codes, "nearest", lambda rows, book: compared.append(len(rows) * len(book)) or full(rows, book))
    for trial in range(200):
        rows, old = rng.integers(-4, 5, (60, 2)), rng.integers(-4, 5, (12, 2))
        new, moved = old.copy(), rng.random(12) < 0.3
        new[moved] += rng.integers(-2, 3, (int(moved.sum()), 2))
        moved = (new != old).any(axis=1)
        codes, gaps = full(rows, old)
        compared.clear()
        got = vector_codes.reassigned(rows, codes, gaps, rng.random(60) < 0.9, new, moved)
        wanted = full(rows, new)
        assert (got[0] == wanted[0]).all() and (got[1] == wanted[1]).all()
        assert sum(compared) <= 60 * 12

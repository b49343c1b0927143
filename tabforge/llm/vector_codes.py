"""Vector code compression by active-entry Lloyd rounds.

Vectors become integers floor(scale * x) and are cut into consecutive parts. Every part position has a codebook, which starts as that part of
the vectors with the smallest ids. A round assigns every part to the nearest entry (squared distance, ties to the lower index) and
replaces each entry by the floored mean of its parts.

Active entries. The table written after a round holds, beside the integers, each part's entry and its exact distance. In the next round a part
whose entry stayed where it was compares only the entries that moved with that distance: all others are as far as they were, and none
of them was nearer (or as near with a lower index) then. A part whose entry moved is compared with all entries. When no entry
moves any more, the remaining rounds change nothing and are left out.

Scale. Rows never move: a round is one pass without a shuffle that rewrites the narrow integers (two bytes a component while they fit) and
one that adds up parts per entry inside each task; at most parts * entries rows a task are shuffled. The driver holds the
codebooks alone, parts * entries vectors of a part's length. A round's table is dropped when the next one is written. Sums are decimals and
distances are whole numbers: every result is exact and independent of the order of rows.

Defined cases: rows whose vector is null, empty or holds null or non-finite components are dropped; the length of the vectors is that of the first
codebook vector, rows of another length are dropped; a length that the parts do not divide gives parts whose lengths differ by one; components beyond
2^53 count as 2^53; distances beyond the greatest long are compared exactly but reported as it. Null ids are kept and come last in the
order of ids; repeated ids are ordered by their integers; fewer rows than entries: as many entries as rows; an empty table gives no
rows. Labels may be null (one group of their own). Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabforge.llm.common import drop, give_back, keep, same
from tabforge.llm.vectors import integers, matrices, packed

LIMIT = 1 << 53
LONG = (1 << 63) - 1
STEP = 4096  # rows compared with a codebook at a time
WIDTHS = ((np.int16, "<i2"), (np.int32, "<i4"), (np.int64, "<i8"))


def nearest(rows: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each row, the lower of equal ones, and its squared distance; exact whole numbers."""
    best, least = np.zeros(len(rows), dtype=np.int64), np.zeros(len(rows), dtype=object)
    top = int(np.abs(rows).max(initial=0)) + int(np.abs(book).max(initial=0))
    if rows.shape[1] * top * top < LIMIT:  # every sum is a whole number that a double holds
        least = least.astype(np.int64)
        points = book.astype(np.float64)
        own = (points**2).sum(axis=1)
        for at in range(0, len(rows), STEP):
            some = rows[at:at + STEP].astype(np.float64)
            gaps = (some**2).sum(axis=1)[:, None] - 2 * (some @ points.T) + own
            best[at:at + STEP] = gaps.argmin(axis=1)
            least[at:at + STEP] = gaps.min(axis=1).astype(np.int64)
        return best, least
    points = book.astype(object)
    for i, row in enumerate(rows.astype(object)):
        gaps = ((points - row) ** 2).sum(axis=1)
        best[i], least[i] = int(gaps.argmin()), int(gaps.min())
    return best, least


def reassigned(rows: np.ndarray, codes: np.ndarray, gaps: np.ndarray, known: np.ndarray, book: np.ndarray, moved: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries and distances of the parts ``rows`` after the entries ``moved``, given those of the round before where ``known``."""
    codes, gaps = codes.copy(), gaps.astype(object)
    settled = known.copy()
    settled[known] = ~moved[codes[known]]
    active = np.flatnonzero(moved)
    some = np.flatnonzero(settled)
    if len(active) and len(some):
        best, least = nearest(rows[some], book[active])
        best = active[best]
        better = (least < gaps[some]) | ((least == gaps[some]) & (best < codes[some]))
        codes[some[better]], gaps[some[better]] = best[better], least[better]
    rest = np.flatnonzero(~settled)
    if len(rest):
        codes[rest], gaps[rest] = nearest(rows[rest], book)
    return codes, gaps


def cuts(dim: int, parts: int) -> list[int]:
    """Where parts begin and end."""
    return [p * dim // parts for p in range(parts + 1)]


def _integers_of(scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, rows in matrices(batch.column(2)):
                if len(at):
                    whole = integers(rows, scale, LIMIT)
                    top = np.abs(whole).max()
                    kind = next(w for t, w in WIDTHS if top <= np.iinfo(t).max)
                    yield pa.RecordBatch.from_arrays([
                        batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), pa.array(np.full(len(at), rows.shape[1], np.int32)),
                        pa.array(np.full(len(at), int(kind[2]), np.int32)), pa.array(packed(whole.astype(kind)), pa.binary())],
                        names=["id", "label", "dim", "width", "vector"])
        give_back()

    return run


def _unpacked(batch: pa.RecordBatch, dim: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, integers) of the rows of each width."""
    widths = batch.column("width").to_numpy()
    vectors = batch.column("vector")
    for width in np.unique(widths):
        at = np.flatnonzero(widths == width)
        yield at, np.frombuffer(b"".join(vectors.take(pa.array(at)).to_pylist()), f"<i{width}").reshape(len(at), dim).astype(np.int64)


def _assign(books: list[np.ndarray], moved: list[np.ndarray], dim: int):
    parts, edges = len(books), cuts(dim, len(books))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = np.zeros((batch.num_rows, parts), dtype=np.int64)
            gaps = np.zeros((batch.num_rows, parts), dtype=object)
            known = np.zeros((batch.num_rows, parts), dtype=bool)
            if "codes" in batch.schema.names:
                codes = np.frombuffer(b"".join(batch.column("codes").to_pylist()), np.uint8).reshape(-1, parts).astype(np.int64)
                held = batch.column("gaps").flatten()
                known = held.is_valid().to_numpy(zero_copy_only=False).reshape(-1, parts)
                gaps = held.fill_null(0).to_numpy(zero_copy_only=False).reshape(-1, parts)
            codes, gaps = codes.copy(), gaps.astype(object)
            for at, rows in _unpacked(batch, dim):
                for p in range(parts):
                    codes[at, p], gaps[at, p] = reassigned(rows[:, edges[p]:edges[p + 1]], codes[at, p], gaps[at, p], known[at, p], books[p], moved[p])
            fits = gaps <= LONG
            flat = pa.array(np.where(fits, gaps, 0).astype(np.int64).ravel(), mask=~fits.ravel())  # not held: compared with all entries again
            offsets = pa.array(np.arange(batch.num_rows + 1) * parts, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(packed(codes.astype(np.uint8)), pa.binary()), pa.ListArray.from_arrays(offsets, flat)],
                names=[*batch.schema.names[:5], "codes", "gaps"])
        give_back()

    return run


def _totals(parts: int, entries: int, dim: int):
    edges = cuts(dim, parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((parts, entries), dtype=np.int64)
        sums = [np.zeros((entries, edges[p + 1] - edges[p]), dtype=object) for p in range(parts)]
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = np.frombuffer(b"".join(batch.column("codes").to_pylist()), np.uint8).reshape(-1, parts)
            for at, rows in _unpacked(batch, dim):
                small = np.abs(rows).max(initial=0) * len(rows) < LIMIT
                for p in range(parts):
                    own, some = codes[at, p], rows[:, edges[p]:edges[p + 1]]
                    counts[p] += np.bincount(own, minlength=entries)
                    added = np.zeros(sums[p].shape, dtype=np.int64 if small else object)
                    np.add.at(added, own, some if small else some.astype(object))
                    sums[p] += added.astype(object)
        for p in range(parts):
            used = np.flatnonzero(counts[p])
            if len(used):
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(used), p, np.int32)), pa.array(used.astype(np.int32)), pa.array(counts[p][used]),
                    pa.array([[Decimal(int(x)) for x in row] for row in sums[p][used]], pa.list_(pa.decimal128(38, 0)))],
                    names=["part", "entry", "n", "total"])
        give_back()

    return run


def _updated(state: DataFrame, books: list[np.ndarray], dim: int) -> list[np.ndarray]:
    """Codebooks after a round: floored means; entries without parts stay."""
    parts, widest = len(books), max(b.shape[1] for b in books)
    totals = state.select("dim", "width", "vector", "codes").mapInArrow(
        _totals(parts, len(books[0]), dim), "part int, entry int, n long, total array<decimal(38,0)>")
    sums = [F.sum(F.get("total", F.lit(i))).alias(f"s{i}") for i in range(widest)]
    after = [b.copy() for b in books]
    for row in totals.groupBy("part", "entry").agg(F.sum("n").alias("n"), *sums).collect():  # parts * entries rows at most
        entry = after[row["part"]][row["entry"]]
        entry[:] = [int(row[f"s{i}"]) // row["n"] for i in range(len(entry))]
    return after


def compress(
    df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = 1024, parts: int = 4, entries: int = 256,
    rounds: int = 4,
) -> tuple[DataFrame, list[np.ndarray]]:
    """``key, code, error, label_error`` per row, and the final codebooks (one matrix per part)."""
    if not 1 <= entries <= 256 or parts < 1:
        raise ValueError("a codebook holds 1 to 256 entries, and there is at least one part")
    kind = df.schema[label].dataType.simpleString()
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("vector"))
    columns = f"id long, label {kind}, dim int, width int, vector binary"
    state = keep(rows.mapInArrow(_integers_of(scale), columns))
    # the bytes of a row do not sort as its numbers do
    order = [F.col("id").asc_nulls_last(), F.col("dim")]
    first = state.orderBy(*order).limit(1).first()
    if first is None:
        return state.select(F.col("id").alias(key), *[F.lit(None).cast(t).alias(c) for c, t in (("code", "string"), ("error", "long"), ("label_error", "long"))]), []
    dim = first["dim"]
    whole = state.filter(F.col("dim") == dim)
    start = _starting(whole, entries, dim)
    edges = cuts(dim, parts)
    books = [start[:, edges[p]:edges[p + 1]].copy() for p in range(parts)]
    moved = [np.ones(len(b), dtype=bool) for b in books]
    columns += ", codes binary, gaps array<long>"
    for done in range(rounds + 1):
        after = keep(whole.mapInArrow(_assign(books, moved, dim), columns))
        drop(state)
        state = whole = after
        if done < rounds:
            latest = _updated(state, books, dim)
            moved = [(new != old).any(axis=1) for new, old in zip(latest, books)]
            books = latest
            if not any(m.any() for m in moved):
                break
    top = F.lit(LONG).cast("decimal(38,0)")
    exact = F.aggregate("gaps", F.lit(0).cast("decimal(38,0)"), lambda a, x: (a + F.coalesce(x.cast("decimal(20,0)"), top)).cast("decimal(38,0)"))
    out = state.select("id", "label", F.lower(F.hex("codes")).alias("code"), F.least(exact, top).cast("long").alias("error"))
    by_label = out.groupBy("label").agg(F.least(F.sum(F.col("error").cast("decimal(28,0)")), top).cast("long").alias("label_error"))
    out = same(out, by_label, ["label"])
    return out.select(F.col("id").alias(key), "code", "error", "label_error"), books


def _starting(state: DataFrame, entries: int, dim: int) -> np.ndarray:
    """The integers of the rows of smallest id; rows of one id in the order of their integers."""
    numbers = F.col("numbers")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, rows in _unpacked(batch, dim):
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(pa.array(at)), pa.array(list(rows), pa.list_(pa.int64()))], names=["id", "numbers"])

    # ids first: only rows that can be among the first become arrays
    last = state.select("id").orderBy(F.col("id").asc_nulls_last()).limit(entries).agg(F.max("id"), F.count_if(F.col("id").isNull())).first()
    some = state if last[1] else state.filter(F.col("id") <= last[0])
    rows = some.select("id", "width", "vector").mapInArrow(run, "id long, numbers array<long>")
    found = rows.orderBy(F.col("id").asc_nulls_last(), numbers).limit(entries).collect()
    return np.array([r["numbers"] for r in found], dtype=np.int64)


def codebook_digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all entries' integers by part, entry and place."""
    return hashlib.sha256(",".join(str(int(x)) for b in books for x in b.ravel()).encode()).hexdigest()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    out, books = compress(rows)
    return out.withColumn("codebooks_sha256", F.lit(codebook_digest(books)))


def _sql(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """The rounds as plain Lloyd: every part against every entry each time."""

    def assigned(i: int) -> str:
        return f"""
a{i} AS MATERIALIZED (
  SELECT p.vec_id, p.part, any_value(p.x) AS x, min({{'d': list_sum([(z[1] - z[2]) * (z[1] - z[2]) for z in list_zip(p.x, b.c)])::BIGINT, 'e': b.entry}}) AS m
  FROM p JOIN b{i} AS b ON p.part = b.part GROUP BY p.vec_id, p.part
)"""

    def means(i: int) -> str:
        return f"""
b{i + 1} AS MATERIALIZED (
  SELECT b.part, b.entry, coalesce(n.c, b.c) AS c FROM b{i} AS b LEFT JOIN (
    SELECT part, entry, list(floor(s / k::DOUBLE)::BIGINT ORDER BY place) AS c FROM (
      SELECT part, entry, place, sum(v)::BIGINT AS s, count(*) AS k
      FROM (SELECT part, m.e AS entry, unnest(x) AS v, generate_subscripts(x, 1) AS place FROM a{i}) GROUP BY part, entry, place
    ) GROUP BY part, entry
  ) AS n ON b.part = n.part AND b.entry = n.entry
)"""

    steps = ",".join(assigned(i) + "," + means(i) for i in range(rounds)) + "," + assigned(rounds)
    return f"""
WITH v AS MATERIALIZED (
  SELECT vec_id, label, [floor(1024 * x::DOUBLE)::BIGINT for x in embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len([1 for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
), p AS MATERIALIZED (
  SELECT vec_id, r.range::INT AS part, e[(r.range * len(e)) // {parts} + 1:((r.range + 1) * len(e)) // {parts}] AS x FROM v, range({parts}) AS r
), s AS (
  SELECT vec_id, (row_number() OVER (ORDER BY vec_id) - 1)::INT AS entry FROM v QUALIFY entry < {entries}
), b0 AS MATERIALIZED (
  SELECT part, entry, x AS c FROM s JOIN p USING (vec_id)
),{steps},
f AS (
  SELECT vec_id, string_agg(printf('%02x', m.e), '' ORDER BY part) AS code, sum(m.d)::BIGINT AS error FROM a{rounds} GROUP BY vec_id
), l AS (
  SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error FROM f JOIN v USING (vec_id)
), h AS (
  SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{rounds}
)
SELECT vec_id, code, error, label_error, codebooks_sha256 FROM l, h
"""


SQL = _sql()

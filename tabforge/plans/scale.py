"""Building blocks that keep the operators safe on large and skewed tables.

Everything here answers one of three questions: may this side be broadcast,
how is an ordered computation split when one group holds a large share of all
rows, and how is an exact order statistic found without sorting the table.
"""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A lookup side with at most this many (narrow) rows is broadcast.
BROADCAST_ROWS = 1_000_000
# ... and this many bytes.
BROADCAST_BYTES = 256 * 1024 * 1024
# An ordered group with at most this many rows is handled by one task.
BLOCK_ROWS = 2_000_000
# At most this many values are gathered to read off an exact order statistic.
GATHER_VALUES = 100_000
# Columns with at most about this many distinct values use the built-in exact percentile,
# whose memory grows with them.
DISTINCT_VALUES = 200_000


def shared_folder(spark: SparkSession) -> str:
    """This application's folder below ``spark.checkpoint.dir``; a local one only when the session names none and runs on one machine."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tabforge-checkpoint-"))
    return context.getCheckpointDir()


def materialise(df: DataFrame, columnar: bool = False) -> DataFrame:
    """Write ``df`` to the session's checkpoint folder and read it back.

    The result survives the loss of executors and fixes values that depend on
    the physical layout. ``columnar`` writes a Parquet table instead of a row
    checkpoint: for large tables that are read several times, a few columns at
    a time.
    """
    folder = shared_folder(df.sparkSession)
    if not columnar or any(isinstance(f.dataType, T.NullType) for f in df.schema.fields):
        return df.checkpoint()
    path = f"{folder}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fits(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """True when ``df`` stays within the given numbers of rows and bytes (both are measured)."""
    width: Column = F.lit(0).cast("long")
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            part = F.octet_length(c) + 16
        elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            part = F.octet_length(F.to_json(F.struct(c))) + 16
        else:
            part = F.lit(16)
        width = width + F.coalesce(part, F.lit(16))
    n, used = df.agg(F.count(F.lit(1)), F.sum(width)).first()
    return n <= rows and (used or 0) <= size


def lookup_join(
    df: DataFrame,
    lookup: DataFrame,
    on: str | Sequence[str],
    how: str = "left",
    max_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Join a small-looking table to a large one, broadcasting only after a size check.

    Null keys match null keys. Beyond the bound the join is left to the
    planner, where adaptive skew handling splits hot keys of the large side.
    """
    on = [on] if isinstance(on, str) else list(on)
    side = lookup.withColumnsRenamed({c: f"_k_{c}" for c in on})
    match = F.lit(True)
    for c in on:
        match = match & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    side = F.broadcast(side) if fits(lookup, max_rows) else side
    return df.join(side, match, how).drop(*[f"_k_{c}" for c in on])


def largest_group(df: DataFrame, group: Sequence[str]) -> int:
    """Row count of the largest group; partial counts are combined before the shuffle."""
    counts = df.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    return counts.agg(F.max("_n")).first()[0] or 0


def prefix_sums(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[Column],
    sums: Mapping[str, Column],
    inclusive: bool = True,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Add running sums inside each group, in the given (total) order.

    Groups of at most ``block_rows`` rows use one plain window. If some group
    is larger, rows are range-partitioned by (group, order); each partition is
    a block, running sums are computed per block and shifted by the totals of
    the group's earlier blocks. Only groups that continue over a block border
    need a shift, so that table has fewer rows than there are blocks.
    """
    group = list(group)
    end = 0 if inclusive else -1

    def running(partition: Sequence[str], keys: Sequence[Column]) -> dict[str, Column]:
        frame = W.partitionBy(*partition).orderBy(*keys).rowsBetween(W.unboundedPreceding, end)
        return {k: F.coalesce(F.sum(v).over(frame), F.lit(0)) for k, v in sums.items()}

    if largest_group(df, group) <= block_rows:
        return df.withColumns(running(group, order))

    blocks = max(2, math.ceil(df.count() / block_rows))
    ranged = materialise(
        df.repartitionByRange(blocks, *[F.col(g) for g in group], *order).withColumn(
            "_block", F.spark_partition_id()
        ),
        columnar=True,
    )
    # helper columns are numbered so that no name given by the caller can meet them
    totals = ranged.groupBy(*group, "_block").agg(*[F.sum(v).alias(f"_total{i}") for i, v in enumerate(sums.values())])
    earlier = W.partitionBy(*group).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    shifts = totals.select(
        *[F.col(g).alias(f"_group{i}") for i, g in enumerate(group)],
        F.col("_block").alias("_place"),
        *[F.sum(f"_total{i}").over(earlier).alias(f"_shift{i}") for i in range(len(sums))],
        F.count(F.lit(1)).over(earlier).alias("_earlier"),
    ).filter("_earlier > 0")
    match = F.col("_block") == F.col("_place")
    for i, g in enumerate(group):
        match = match & F.col(g).eqNullSafe(F.col(f"_group{i}"))
    within = ranged.withColumns(running([*group, "_block"], order))
    joined = within.join(F.broadcast(shifts), match, "left")
    joined = joined.withColumns({k: F.col(k) + F.coalesce(F.col(f"_shift{i}"), F.lit(0)) for i, k in enumerate(sums)})
    return joined.drop("_block", *shifts.columns)


def positions(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[Column],
    name: str = "_pos",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Number the rows of each group 1, 2, ... in the given (total) order."""
    return prefix_sums(df, group, order, {name: F.lit(1).cast("long")}, block_rows=block_rows)


def shifted(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[Column],
    columns: Mapping[str, tuple[Column, int]],
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Add lagged (positive offset) or leading (negative offset) columns per group.

    ``columns`` maps the new name to (expression, offset). A group larger than
    ``block_rows`` is cut into tiles of that many consecutive rows; each tile
    also receives the few rows next to its borders that its shifts look at.
    """
    group = list(group)
    back = max([0, *[n for _, n in columns.values()]])
    ahead = max([0, *[-n for _, n in columns.values()]])

    def shifts(partition: Sequence[str], keys: Sequence[Column]) -> dict[str, Column]:
        window = W.partitionBy(*partition).orderBy(*keys)
        return {k: F.lag(e, n).over(window) if n >= 0 else F.lead(e, -n).over(window) for k, (e, n) in columns.items()}

    if largest_group(df, group) <= block_rows:
        return df.withColumns(shifts(group, order))

    # names of our own, so that no column of the caller is met or dropped
    pos, at, to = (_unused(df, name) for name in ("_pos", "_home", "_tile"))
    tile = max(block_rows, back, ahead, 1)
    numbered = positions(df, group, order, pos, block_rows)
    home = F.floor((F.col(pos) - 1) / tile)
    place = (F.col(pos) - 1) % tile
    none = F.lit(None).cast("long")
    tiles = F.array_compact(
        F.array(
            home,
            F.when(place >= tile - back, home + 1).otherwise(none),
            F.when(place < ahead, home - 1).otherwise(none),
        )
    )
    spread = numbered.withColumn(at, home).withColumn(to, F.explode(tiles))
    out = spread.withColumns(shifts([*group, to], [F.col(pos)]))
    return out.filter(F.col(to) == F.col(at)).drop(pos, at, to)


def _unused(df: DataFrame, name: str) -> str:
    """``name``, or a longer one if ``df`` has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def hash32(key: Column | str, seed: int = 0) -> Column:
    """A 32-bit hash of ``seed:key`` that any engine with MD5 can reproduce."""
    key = F.col(key) if isinstance(key, str) else key
    text = F.concat(F.lit(f"{seed}:"), key.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def _clean(column: str) -> Column:
    """The column as double with NaN turned into null."""
    value = F.col(column).cast("double")
    return F.when(~F.isnan(value), value)


def exact_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probabilities: Sequence[float],
    gather: int = GATHER_VALUES,
    distinct: int = DISTINCT_VALUES,
) -> dict[str, list[float | None]]:
    """Exact quantiles (linear interpolation) of whole columns, without sorting them.

    Columns of few distinct values are read directly. On others every wanted rank is
    bracketed between two values from an approximate summary, the bracket is
    checked with exact counts and narrowed again until few values remain.
    All columns and ranks share each pass; only numbers reach the driver.
    """
    sizes = [F.count(_clean(c)).alias(f"n{i}") for i, c in enumerate(columns)]
    sizes += [F.approx_count_distinct(_clean(c)).alias(f"d{i}") for i, c in enumerate(columns)]
    measured = df.agg(*sizes).first()
    counts = {c: measured[f"n{i}"] for i, c in enumerate(columns)}
    # the sketch is off by a few percent at most
    direct = [c for i, c in enumerate(columns) if counts[c] and measured[f"d{i}"] <= distinct]
    out: dict[str, list[float | None]] = {}
    if direct:
        wanted = F.array(*[F.lit(float(p)) for p in probabilities])
        row = df.agg(*[F.percentile(_clean(c), wanted).alias(f"q{i}") for i, c in enumerate(direct)]).first()
        out = {c: list(row[f"q{i}"]) for i, c in enumerate(direct)}
    found: dict[tuple[str, int], float] = {}
    open_ranks: dict[tuple[str, int], list] = {}
    for c in columns:
        for p in probabilities:
            if counts[c] and c not in out:
                spot = (counts[c] - 1) * p
                for r in {math.floor(spot), math.ceil(spot)}:
                    # [below lo, values inside, lo, hi] with an open bracket (lo, hi)
                    open_ranks[(c, r)] = [0, counts[c], None, None]

    def inside(c: str, lo: float | None, hi: float | None) -> Column:
        v = _clean(c)
        if lo is not None:
            v = F.when(_clean(c) > lo, v)
        if hi is not None:
            v = F.when(_clean(c) < hi, v)
        return v

    while open_ranks:
        keys = list(open_ranks)
        exprs = []
        for i, (c, r) in enumerate(keys):
            below, n, lo, hi = open_ranks[(c, r)]
            v = inside(c, lo, hi)
            if n <= gather:
                exprs.append(F.sort_array(F.collect_list(v))[r - below].alias(f"v{i}"))
            else:
                share = (r - below) / n
                span = [max(0.0, share - 2e-4), min(1.0, share + 2e-4)]
                exprs.append(F.percentile_approx(v, span, 10_000).alias(f"v{i}"))
        guess = df.agg(*exprs).first()
        still: dict[tuple[str, int], list] = {}
        exprs = []
        for i, key in enumerate(keys):
            if open_ranks[key][1] <= gather:
                found[key] = guess[f"v{i}"]
                continue
            still[key] = guess[f"v{i}"]
            v = _clean(key[0])
            a, b = still[key]
            tests = {"la": v < a, "ea": v == a, "lb": v < b, "eb": v == b}
            exprs += [F.count_if(t).alias(f"{k}{i}") for k, t in tests.items()]
        if not still:
            break
        exact = df.agg(*exprs).first()
        nxt: dict[tuple[str, int], list] = {}
        for i, key in enumerate(keys):
            if key not in still:
                continue
            (a, b), r = still[key], key[1]
            below, n, lo, hi = open_ranks[key]
            la, ea, lb, eb = (exact[f"{k}{i}"] for k in ("la", "ea", "lb", "eb"))
            if la <= r < la + ea:
                found[key] = a
            elif lb <= r < lb + eb:
                found[key] = b
            elif r < la:
                nxt[key] = [below, la - below, lo, a]
            elif r < lb:
                nxt[key] = [la + ea, lb - la - ea, a, b]
            else:
                nxt[key] = [lb + eb, below + n - lb - eb, b, hi]
        open_ranks = nxt

    for c in columns:
        if c in out:
            continue
        row: list[float | None] = []
        for p in probabilities:
            if not counts[c]:
                row.append(None)
                continue
            spot = (counts[c] - 1) * p
            low, high = found[(c, math.floor(spot))], found[(c, math.ceil(spot))]
            row.append(low + (high - low) * (spot - math.floor(spot)))
        out[c] = row
    return out


def grouped_quantiles(
    df: DataFrame,
    group: Sequence[str],
    column: str,
    probabilities: Mapping[str, float],
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Exact quantiles (linear interpolation) per group as one row per group.

    Equal values are counted first; running counts then tell which values hold
    the wanted ranks, so no group is gathered anywhere.
    """
    group = list(group)
    values = (
        df.filter(_clean(column).isNotNull())
        .groupBy(*group, _clean(column).alias("_v"))
        .agg(F.count(F.lit(1)).alias("_c"))
    )
    values = materialise(values)
    totals = values.groupBy(*group).agg(F.sum("_c").alias("_n"))
    run = prefix_sums(values, group, [F.col("_v")], {"_upto": F.col("_c")}, block_rows=block_rows)
    if group:
        run = lookup_join(run, totals, group, "inner")
    else:
        run = run.withColumn("_n", F.lit(totals.first()[0]))
    aggs = []
    for name, p in probabilities.items():
        spot = (F.col("_n") - 1) * F.lit(p)
        for side, rank in (("lo", F.floor(spot)), ("hi", F.ceil(spot))):
            hit = (rank < F.col("_upto")) & (rank >= F.col("_upto") - F.col("_c"))
            aggs.append(F.max(F.when(hit, F.col("_v"))).alias(f"_{side}_{name}"))
    out = run.groupBy(*group).agg(F.max("_n").alias("_n"), *aggs)
    cols = []
    for name, p in probabilities.items():
        spot = (F.col("_n") - 1) * F.lit(p)
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        cols.append((lo + (hi - lo) * (spot - F.floor(spot))).alias(name))
    return out.select(*group, *cols)

"""Column selection, row filters, unions, group membership, profiles and top-k."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC)]


def quoted(name: str) -> Column:
    """A column by its literal name, whatever characters it holds."""
    return F.col(f"`{name}`")


# -- projection and filters ----------------------------------------------------


def select_features(df: DataFrame, features: Sequence[str] | str, keep: Sequence[str] = ()) -> DataFrame:
    if features == "*":
        return df
    return df.select(*[quoted(c) for c in dict.fromkeys([*keep, *features])])


def drop_by_root(df: DataFrame, roots: Sequence[str]) -> DataFrame:
    """Drop columns and all their lags ``root[...]``; unknown names are ignored."""
    gone = set(roots)
    return df.select(*[quoted(c) for c in df.columns if c.split("[")[0] not in gone])


def drop_null_target(df: DataFrame, target: str, live: bool = False) -> DataFrame:
    return df if live else df.filter(quoted(target).isNotNull())


def unlabeled(df: DataFrame, target: str) -> DataFrame:
    """Rows kept for pure inference."""
    return df.filter(quoted(target).isNull())


def align_types(df: DataFrame, like: DataFrame) -> DataFrame:
    """Cast to the types of the training table; differing column counts are an error."""
    if len(df.columns) != len(like.columns):
        raise ValueError(f"{len(df.columns)} columns, but training has {len(like.columns)}")
    return df.select(*[quoted(f.name).cast(f.dataType).alias(f.name) for f in like.schema.fields])


def literal(df: DataFrame, column: str, value) -> Column:
    """A constant of the column's type; wall-clock timestamps are not moved between time zones."""
    if isinstance(df.schema[column].dataType, T.TimestampNTZType):
        return F.lit(str(value)).cast("timestamp_ntz")
    return F.lit(value)


def split_by_date(df: DataFrame, date: str, boundary) -> tuple[DataFrame, DataFrame]:
    """Rows up to and including the boundary, and rows after it."""
    edge = literal(df, date, boundary)
    return df.filter(quoted(date) <= edge), df.filter(quoted(date) > edge)


def stringify(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Non-numeric, non-boolean columns as text; nulls stay null."""
    plain = (*NUMERIC, T.BooleanType)
    chosen = columns or [f.name for f in df.schema.fields if not isinstance(f.dataType, plain)]
    nested = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))}
    return df.withColumns({c: F.to_json(c) if c in nested else F.col(c).cast("string") for c in chosen})


def drop_zero_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Drop numeric columns holding nothing but zeros (or nulls); one pass for all of them."""
    if not columns:
        return df
    tests = [F.max(F.coalesce((quoted(c) != 0), F.lit(False))).alias(f"t{i}") for i, c in enumerate(columns)]
    row = df.agg(*tests).first()
    gone = {c for i, c in enumerate(columns) if not row[f"t{i}"]}
    return df.select(*[quoted(c) for c in df.columns if c not in gone])


def fixed_one_hot(df: DataFrame, column: str, vocabulary: Sequence[str], before: str, prefix: str) -> DataFrame:
    """Replace a category by 0/1 columns over a fixed vocabulary, placed before the target."""
    flags = [F.when(quoted(column) == v, 1).otherwise(0).alias(f"{prefix}{v}") for v in vocabulary]
    left = [quoted(c) for c in df.columns if c not in (column, before)]
    return df.select(*left, *flags, quoted(before))


# -- unions and joins ----------------------------------------------------------


def stack_partitions(train: DataFrame, test: DataFrame) -> DataFrame:
    """Train and test rows as one table told apart by ``partition``."""
    tagged = [d.withColumn("partition", F.lit(n)) for d, n in ((train, "train"), (test, "test"))]
    return tagged[0].unionByName(tagged[1], allowMissingColumns=True)


def append_columns(df: DataFrame, extra: DataFrame, key: str) -> DataFrame:
    """Add another table's columns by key; a differing set of keys is an error.

    Both tables must hold each key once. The check is one aggregate over the
    keys of both sides and does not bring rows to the driver.
    """
    both = df.select(key, F.lit(1).alias("_l"), F.lit(0).alias("_r")).unionAll(
        extra.select(key, F.lit(0).alias("_l"), F.lit(1).alias("_r"))
    )
    odd = both.groupBy(key).agg(F.sum("_l").alias("_l"), F.sum("_r").alias("_r")).filter("_l <> 1 or _r <> 1")
    if not odd.isEmpty():
        raise IndexError(f"rows do not match one to one on {key}")
    return df.join(extra, key, "inner")


def group_members(df: DataFrame, members: DataFrame, on: str, inside: bool = True) -> DataFrame:
    """Rows whose value is (or is not) a member of the group."""
    return df.join(members.select(on).distinct(), on, "left_semi" if inside else "left_anti")


def group_add(group: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The enlarged membership table and the members that were not in it before."""
    return group.unionByName(new).distinct(), new.subtract(group)


def group_remove(group: DataFrame, gone: DataFrame) -> DataFrame:
    return group.subtract(gone)


def is_subset(part: DataFrame, whole: DataFrame) -> bool:
    return part.subtract(whole).isEmpty()


# -- profiles ------------------------------------------------------------------


def count_by(df: DataFrame, *keys: str, name: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def distinct_counts(df: DataFrame, columns: Sequence[str], approx: bool = False) -> DataFrame:
    """Number of distinct values per column (long form); null counts as a value."""
    count = F.approx_count_distinct if approx else F.count_distinct
    exprs = [
        (count(quoted(c)) + F.max(quoted(c).isNull().cast("int"))).cast("long").alias(f"d{i}")
        for i, c in enumerate(columns)
    ]
    return _long(df.agg(*exprs), [(c, {"n_unique": f"d{i}"}) for i, c in enumerate(columns)])


def profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows, nulls, distinct non-null values and a has-nulls flag per column."""
    columns = list(columns or df.columns)
    exprs = [F.count(F.lit(1)).alias("n")]
    for i, c in enumerate(columns):
        exprs += [F.count_if(quoted(c).isNull()).alias(f"m{i}"), F.count_distinct(quoted(c)).alias(f"d{i}")]
    wide = df.agg(*exprs)
    rows = [(c, {"rows": "n", "nulls": f"m{i}", "n_unique": f"d{i}"}) for i, c in enumerate(columns)]
    return _long(wide, rows).withColumn("has_nulls", F.col("nulls") > 0)


def _long(wide: DataFrame, rows: Sequence[tuple[str, dict[str, str]]]) -> DataFrame:
    """Turn a one-row table of statistics into one row per column."""
    items = [
        F.struct(F.lit(c).alias("column"), *[F.col(src).alias(name) for name, src in stats.items()])
        for c, stats in rows
    ]
    return wide.select(F.inline(F.array(*items)))


def text_lengths(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    exprs = []
    for i, c in enumerate(columns):
        size = F.char_length(quoted(c))
        exprs += [F.min(size).alias(f"lo{i}"), F.max(size).alias(f"hi{i}")]
    rows = [(c, {"min_length": f"lo{i}", "max_length": f"hi{i}"}) for i, c in enumerate(columns)]
    return _long(df.agg(*exprs), rows)


def crosstab(df: DataFrame, factor: str, target: str, levels: Sequence) -> DataFrame:
    """Share of every target level within each factor value; rows sum to one."""
    total = F.count(quoted(target))
    shares = [(F.count_if(quoted(target) == v) / total).alias(f"p_{v}") for v in levels]
    return df.groupBy(factor).agg(*shares)


def mean_by(df: DataFrame, key: str, value: str, at_least: int = 1) -> DataFrame:
    """Mean and count per category, largest mean first."""
    out = df.groupBy(key).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))
    return out.filter(F.col("n") >= at_least).orderBy(F.desc("mean"), key)


# -- order and top-k -----------------------------------------------------------


def top_n(df: DataFrame, n: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(n)


def top_k_per_group(df: DataFrame, group: str, k: int, *order: Column, rank: str = "rank") -> DataFrame:
    """The first k rows of each group.

    The rank filter is pushed below the shuffle, so every task forwards at most
    k rows per group however large the group is.
    """
    ranked = df.withColumn(rank, F.row_number().over(W.partitionBy(group).orderBy(*order)))
    return ranked.filter(F.col(rank) <= k)


def contiguous_groups(df: DataFrame, group: str, *order: str) -> DataFrame:
    """Globally ordered by (group, ...): range partitions may split a large group, order is kept."""
    return df.orderBy(group, *order)


def positive_importances(df: DataFrame, value: str = "importance", n: int | None = None) -> DataFrame:
    out = df.filter(F.col(value) > 0).orderBy(F.desc(value), "feature")
    return out.limit(n) if n else out


# -- row counts ----------------------------------------------------------------


def add(columns: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def row_counts(df: DataFrame, columns: Sequence[str] | None = None, digits: bool = True) -> DataFrame:
    """Per row: non-null and null cells, and how many numeric cells equal 0 ... 9.

    ``nan_count`` is the number of non-null cells and takes part in the digit counts.
    """
    columns = list(columns or df.columns)
    full = add([quoted(c).isNotNull().cast("int") for c in columns])
    out = df.withColumn("nan_count", full).withColumn("null_count", F.lit(len(columns)) - full)
    if digits:
        cells = [c for c in numeric_columns(df) if c in columns] + ["nan_count"]
        counts = {}
        for i in range(10):
            counts[f"count_{i}"] = add([F.coalesce((quoted(c) == i).cast("int"), F.lit(0)) for c in cells])
        out = out.withColumns(counts)
    return out

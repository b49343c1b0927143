"""Lagged features, forecast targets and the time split of panels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabforge.operators.frame import quoted
from tabforge.plans.scale import BLOCK_ROWS, materialise, prefix_sums, shifted


def sequence_frame(
    df: DataFrame,
    target: str,
    date: str,
    key: str,
    forecast_period: int = 1,
    n_lags: int = 1,
    leaders: Sequence[str] = (),
    group: str | None = None,
    keep_current: bool = False,
    lag_target: bool = False,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Lags ``c[-1]`` ... ``c[-n]`` of every plain column and the target shifted ahead, per group.

    Target, date, group, key and leaders are not lagged. The target becomes
    the value ``forecast_period - 1`` rows later. ``keep_current=True`` keeps
    the current values of lagged columns, ``lag_target=True`` lags the target too.
    Rows are ordered by (date, key); groups of any size are handled.
    """
    outside = {target, date, key, group, *leaders}
    plain = [c for c in df.columns if c not in outside]
    lagged = plain + ([target] if lag_target else [])
    columns = {f"{c}[-{i}]": (quoted(c), i) for i in range(1, n_lags + 1) for c in lagged}
    columns["_ahead"] = (quoted(target), 1 - forecast_period)
    order = [quoted(date), quoted(key)]
    out = shifted(df, [group] if group else [], order, columns, block_rows)
    kept = [c for c in df.columns if c != target and (keep_current or c not in plain)]
    lags = [c for c in columns if c != "_ahead"]
    return out.select(*[quoted(c) for c in kept + lags], F.col("_ahead").alias(target))


def split_date(df: DataFrame, date: str, test_share: float):
    """The date standing at row ``int((1 - share) * n)`` of the date-sorted table.

    Rows are counted per date first, so the running count covers dates, not rows.
    """
    dates = materialise(df.filter(quoted(date).isNotNull()).groupBy(quoted(date).alias("_d")).agg(F.count(F.lit(1)).alias("_c")))
    n = dates.agg(F.sum("_c")).first()[0] or 0
    spot = min(int((1 - test_share) * n), max(n - 1, 0))
    run = prefix_sums(dates, [], [F.col("_d")], {"_upto": F.col("_c")})
    return run.filter(F.col("_upto") > spot).agg(F.min("_d")).first()[0]


def lag_by(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], lags: dict[str, tuple[Column, int]],
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Named lags of expressions per group."""
    return shifted(df, group, order, lags, block_rows)

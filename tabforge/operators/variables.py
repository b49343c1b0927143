"""Named derived columns, column functions and table transforms."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabforge.operators.frame import quoted
from tabforge.plans.scale import BLOCK_ROWS, shifted


class Lag:
    """An expression looked up ``n`` rows back inside its group."""

    def __init__(self, expression: Column | str, n: int):
        self.expression = quoted(expression) if isinstance(expression, str) else expression
        self.n = n


def apply_variables(
    df: DataFrame,
    layers: Sequence[Mapping[str, Column | Lag]],
    group: Sequence[str] = (),
    order: Sequence[Column] = (),
    aliases: Mapping[str, str] | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Add derived columns layer by layer; a layer may use the columns of earlier ones.

    All entities share one table: lags are taken inside ``group`` in ``order``,
    all lags of a layer in one window. Plain expressions of a layer become one
    projection. ``aliases`` maps further names to existing ones.
    """
    for layer in layers:
        lags = {k: (v.expression, v.n) for k, v in layer.items() if isinstance(v, Lag)}
        plain = {k: v for k, v in layer.items() if not isinstance(v, Lag)}
        if lags:
            df = shifted(df, group, order, lags, block_rows)
        if plain:
            df = df.withColumns(plain)
    if aliases:
        df = df.withColumns({new: quoted(old) for new, old in aliases.items()})
    return df


class Functions:
    """Registry of named functions: parameterised columns and table transforms."""

    def __init__(self):
        self._columns: dict[str, Callable[..., Column]] = {}
        self._tables: dict[str, Callable[..., DataFrame]] = {}

    def column(self, fn: Callable[..., Column]) -> Callable[..., Column]:
        self._columns[fn.__name__] = fn
        return fn

    def table(self, fn: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        self._tables[fn.__name__] = fn
        return fn

    def variable(self, name: str, *params) -> tuple[str, Column]:
        """Column name ``name_p1_p2`` and the column of the function called with the parameters."""
        label = "_".join([name, *[str(p) for p in params]])
        return label, self._columns[name](*params)

    def transform(self, df: DataFrame, name: str, column: str, *params) -> DataFrame:
        """Apply a table transform to a column, or to the latest lag of a root of that name."""
        return self._tables[name](df, latest_lag(df, column), *params)


def latest_lag(df: DataFrame, root: str) -> str:
    """The column itself if present, else its most recent lag ``root[-i]``."""
    if root in df.columns:
        return root
    lags = [c for c in df.columns if c.split("[")[0] == root and c.endswith("]")]
    if not lags:
        raise KeyError(root)
    return min(lags, key=lambda c: abs(int(c[len(root) + 1 : -1])))


def transform_columns(df: DataFrame, column: str, parts: Callable[[Column], Mapping[str, Column]]) -> DataFrame:
    """Append the columns a part function makes of one column, prefixed with its name."""
    return df.withColumns({f"{column}_{k}": v for k, v in parts(quoted(column)).items()})


def float_factor(x: Column | str, rounding: int) -> Column:
    """Digits of the number written with ``rounding`` decimals, as an integer; 0 if there are none."""
    x = F.col(x) if isinstance(x, str) else x
    text = F.format_string(f"%.{rounding}f", x.cast("double"))
    digits = F.regexp_replace(text, "[^0-9]", "")
    return F.coalesce(F.when(digits != "", digits).try_cast("long"), F.lit(0).cast("long"))


def unit_scale(df: DataFrame, column: str, name: str) -> DataFrame:
    """Decision scores mapped to [0, 1] by the minimum and maximum of the whole column."""
    low, high = df.agg(F.min(column), F.max(column)).first()
    return df.withColumn(name, (F.col(column) - F.lit(low)) / F.lit((high - low) or 1.0))


def candle(open_: str = "open", close: str = "close") -> dict[str, Column]:
    """Geometry of price bars: middle and height of the body, and up / down flags."""
    o, c = F.col(open_), F.col(close)
    return {
        "mid": (o + c) / 2,
        "span": F.abs(c - o),
        "up": c > o,
        "down": o > c,
    }

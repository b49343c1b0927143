"""Small pieces that several operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabforge.plans.scale import materialise

# A word: a run of characters other than blank, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keep(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder (``spark.checkpoint.dir``) and read it back: read several times, survives lost executors."""
    out = materialise(df, columnar=True)
    for made in _scopes:
        made.append(out)
    return out


_scopes: list[list[DataFrame]] = []


@contextlib.contextmanager
def scratch() -> Iterator[list[DataFrame]]:
    """Tables that ``keep`` writes within; those still listed at the end are removed."""
    made: list[DataFrame] = []
    _scopes.append(made)
    try:
        yield made
    finally:
        _scopes.remove(made)
        for table_ in made:
            drop(table_)


def drop(df: DataFrame) -> None:
    """Remove the files of a table written by ``keep`` that nothing reads any more."""
    spark = df.sparkSession
    folders = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    for folder in folders:
        if "/table-" in folder:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def same(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Equi-join on keys in which null equals null; the keys of ``left`` stay."""
    side = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    match: Column = F.lit(True)
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return left.join(side, match, how).drop(*[f"_r_{k}" for k in keys])


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z; other letters stay."""
    return F.translate(text, UPPER, LOWER)


def give_back() -> None:
    """At the end of a Python task: hand freed memory back, as the worker waits on beside the next tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass

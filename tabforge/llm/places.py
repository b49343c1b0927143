"""Rows by their place (file and row number), so that decisions on narrow rows come back to whole rows without moving texts.

Decisions are kept as bitmaps: a bit per row and copy, 4 KB for 32,768 rows of a file. The scan of the files is joined with them by broadcast: as
many bitmaps as ``BITMAP_BYTES`` (measured) at a time; beyond, the files are dealt into groups, and each group is scanned with its own.
"""

from __future__ import annotations

import math

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabforge.llm.common import keep

BITMAP_BYTES = 64 << 20


class Placed:
    """A table whose rows have places: files as they are read, or a copy of ``df`` in the shared folder if it is anything else."""

    def __init__(self, df: DataFrame):
        self.columns = df.columns
        self.void = {f.name for f in df.schema.fields if isinstance(f.dataType, T.NullType)}
        if df._jdf.queryExecution().analyzed().nodeName() != "LogicalRelation" or not self._has_places(df):
            df = keep(df.select(*[F.col(f"`{c}`").cast("string").alias(c) if c in self.void else F.col(f"`{c}`") for c in df.columns]))
        self.df = df
        # longer than any name of the table
        self.prefix = "_" * (1 + max(len(c) for c in df.columns))

    @staticmethod
    def _has_places(df: DataFrame) -> bool:
        try:
            place = df.metadataColumn("_metadata")
            df.select(place["file_path"], place["row_index"])
        except AnalysisException:  # files without row numbers, or no files
            return False
        return True

    @property
    def file(self) -> Column:
        return self.df.metadataColumn("_metadata")["file_path"]

    @property
    def row(self) -> Column:
        return self.df.metadataColumn("_metadata")["row_index"]

    def rows(self, chosen: DataFrame, most: int = 1) -> DataFrame:
        """The rows at the places ``_file, _row``, each as often as ``_copies`` says (up to ``most``); other rows go."""
        at = F.col("_row") + 1
        bits = chosen.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))) if most > 1 else chosen.withColumn("_copy", F.lit(1))
        bits = bits.groupBy("_file", F.bitmap_bucket_number(at).alias("_bucket"), "_copy").agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("_bits"))
        maps = keep(bits.groupBy("_file", "_bucket").agg(F.collect_list("_bits").alias("_maps")))  # at most ``most`` bitmaps
        used = maps.agg(F.sum(F.size("_maps") * 4096 + F.octet_length("_file"))).first()[0] or 0
        groups = max(1, math.ceil(used / BITMAP_BYTES))
        p = self.prefix
        side = maps.withColumnsRenamed({c: p + c for c in maps.columns})
        whole = self.df.select(*[F.col(f"`{c}`") for c in self.df.columns], self.file.alias(f"{p}at"), (self.row + 1).alias(f"{p}row"))
        parts = []
        for group in range(groups):
            some, own = whole, side
            if groups > 1:
                # a condition on the path alone: files of other groups are not read
                own = side.filter(F.pmod(F.xxhash64(f"{p}_file"), F.lit(groups)) == group)
                some = whole.filter(F.pmod(F.xxhash64(f"{p}at"), F.lit(groups)) == group)
            match = (F.col(f"{p}at") == F.col(f"{p}_file")) & (F.bitmap_bucket_number(F.col(f"{p}row")) == F.col(f"{p}_bucket"))
            parts.append(some.join(F.broadcast(own), match))
        out = parts[0]
        for part in parts[1:]:
            out = out.unionAll(part)
        place = F.bitmap_bit_position(F.col(f"{p}row")).cast("int")

        def bit(bitmap: Column) -> Column:
            byte = F.conv(F.hex(F.substring(bitmap, F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
            return F.floor(byte / F.pow(F.lit(2), F.pmod(place, F.lit(8)))).cast("int") % 2

        out = out.withColumn(f"{p}n", F.aggregate(f"{p}_maps", F.lit(0), lambda n, m: n + bit(m))).filter(F.col(f"{p}n") > 0)
        if most > 1:
            out = out.withColumn(f"{p}copy", F.explode(F.sequence(F.lit(1), F.col(f"{p}n"))))
        return out.select(*[F.lit(None).alias(c) if c in self.void else F.col(f"`{c}`") for c in self.columns])

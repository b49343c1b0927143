"""Vectors made from columns, without Python."""

from __future__ import annotations

from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def sparse_vector(size: int, indices: Column, values: Column) -> Column:
    """A sparse vector of int ``indices`` (ascending) and double ``values``."""
    fields = F.struct(F.lit(0).alias("type"), F.lit(size).alias("size"), indices.alias("indices"), values.alias("values"))
    # a struct cannot be cast to a vector, but be read as one
    return F.from_json(F.to_json(F.struct(fields.alias("v"))), T.StructType([T.StructField("v", VectorUDT())]))["v"]

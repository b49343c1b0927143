"""Reading and writing tables, run snapshots, predictions, submissions and metrics."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabforge.operators import encode
from tabforge.plans.scale import fits, lookup_join, materialise, shared_folder

# Type names of column overrides; any other name means text.
OVERRIDES = {
    "int": "bigint",
    "int64": "bigint",
    "int32": "int",
    "float": "double",
    "float64": "double",
    "str": "string",
    "string": "string",
    "bool": "boolean",
}
# Quotes are doubled, line breaks stand inside quotes.
DELIMITED = {"header": True, "multiLine": True, "quote": '"', "escape": '"'}


def scratch_folder(spark: SparkSession) -> str:
    """A fresh folder name next to the session's checkpoints, reachable by all executors."""
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def _delimited_types(rows: DataFrame) -> dict[str, str]:
    """Integer, float, boolean or text per column, from all rows; dates stay text."""
    exprs = []
    for i, c in enumerate(rows.columns):
        text = F.col(f"`{c}`")
        for t in ("bigint", "double", "boolean"):
            exprs.append(F.bool_and(text.try_cast(t).isNotNull() | text.isNull()).alias(f"{t}{i}"))
    fit = rows.agg(*exprs).first().asDict()
    return {
        c: next((t for t in ("bigint", "double", "boolean") if fit[f"{t}{i}"]), "string")
        for i, c in enumerate(rows.columns)
    }


def read_frame(
    spark: SparkSession,
    path: str | list[str],
    sep: str = ",",
    dtypes: Mapping[str, str] | None = None,
    schema: T.StructType | str | None = None,
    fmt: str = "csv",
    multi_line: bool = True,
) -> DataFrame:
    """Read a table with a header row, or Parquet. A missing path is an error.

    ``schema`` skips inference, which reads every file once more; ``dtypes`` overrides the type of single columns. Quoted fields may hold line
    breaks, for which a file is read as a whole by one task; with ``multi_line=False`` (no field holds one) large files are split.
    """
    paths = [path] if isinstance(path, str) else list(path)
    if fmt == "parquet":
        return spark.read.parquet(*paths)
    options = {**DELIMITED, "sep": sep, "multiLine": multi_line}
    if schema is None:
        types = _delimited_types(spark.read.options(**options).csv(paths))
        types |= {c: OVERRIDES.get(t, "string") for c, t in (dtypes or {}).items()}
        schema = ", ".join(f"`{c}` {t}" for c, t in types.items())
    # a value that does not fit its declared type is an error, not a null
    return spark.read.schema(schema).options(**options, mode="FAILFAST").csv(paths)


def _flat(field: T.StructField) -> Column:
    """Nested values written to text files become JSON text."""
    col = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(col).alias(field.name)
    return col


def write_frame(
    df: DataFrame,
    path: str,
    sep: str = ",",
    columns: Sequence[str] | None = None,
    tag: str | None = None,
    fmt: str = "parquet",
    mode: str = "overwrite",
) -> str:
    """Write chosen columns; ``tag`` is appended to the folder name. Returns the folder."""
    target = f"{path}_{tag}" if tag else path
    out = df.select(*[f"`{c}`" for c in columns]) if columns else df
    if fmt == "parquet":
        out.write.mode(mode).parquet(target)
    else:
        flat = out.select(*[_flat(f) for f in out.schema.fields])
        flat.write.mode(mode).options(header=True, quote='"', escape='"', sep=sep).csv(target)
    return target


def load_frames(
    spark: SparkSession,
    folder: str,
    members: DataFrame,
    member: str = "member",
    extension: str = "csv",
    sep: str = ",",
    schema: T.StructType | str | None = None,
    splits: bool = True,
    multi_line: bool = True,
) -> DataFrame:
    """Read the files of a group's members as one table with a leading ``tag_id``.

    With ``splits`` there is one file or folder per member, named after it, or a folder written by ``dump_frames`` (``extension="partitions"``);
    otherwise one consolidated table already carries ``tag_id``. Either way the members are chosen by a semi join, not by listing names on the
    driver. In a dumped folder the members' table, once measured and broadcast, prunes the sub-folders before they are read.
    """
    wanted = members.select(F.col(member).cast("string").alias("tag_id")).distinct()
    if extension == "partitions":
        found = spark.read.schema(schema) if schema is not None else spark.read
        fields = [f for f in found.parquet(folder).schema.fields if f.name != "tag_id"]
        df = spark.read.schema(T.StructType([*fields, T.StructField("tag_id", T.StringType())])).parquet(folder)
        df = df.select("tag_id", *[f"`{f.name}`" for f in fields])
        # the planner prunes by a table that has a condition
        wanted = wanted.filter(F.length("tag_id") >= 0)
        return df.join(F.broadcast(wanted) if fits(wanted) else wanted, "tag_id", "left_semi")
    if splits:
        path = f"{folder}/*.{extension}"
        df = read_frame(spark, path, sep, schema=schema, fmt=extension, multi_line=multi_line)
        name = F.regexp_extract(F.col("_metadata.file_path"), rf"([^/]+)\.{extension}(/[^/]*)?$", 1)
        df = df.select(F.url_decode(name).alias("tag_id"), "*")
    else:
        df = read_frame(spark, folder, sep, schema=schema, fmt=extension, multi_line=multi_line)
        df = df.select("tag_id", *[c for c in df.columns if c != "tag_id"])
    return df.join(wanted, "tag_id", "left_semi")


def dump_frames(df: DataFrame, folder: str, tag: str = "tag_id", mode: str = "overwrite", file_rows: int = 1_000_000) -> None:
    """Write one sub-folder per member, in files of about ``file_rows`` rows: a large member is written by many tasks, a small one by one."""
    sizes = df.groupBy(tag).agg(F.ceil(F.count(F.lit(1)) / F.lit(file_rows)).alias("_files"))
    plain = [F.col(f"`{f.name}`") for f in df.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    dealt = lookup_join(df, materialise(sizes), tag, "inner").withColumn("_file", F.pmod(F.xxhash64(*plain), F.col("_files")))
    dealt.repartition(tag, "_file").drop("_files", "_file").write.mode(mode).option("maxRecordsPerFile", file_rows).partitionBy(tag).parquet(folder)


def get_data(
    df: DataFrame,
    target: str,
    features: Sequence[str] | str = "*",
    keep: Sequence[str] = (),
    live: bool = False,
    classify: bool = True,
    labels: encode.LabelModel | None = None,
) -> tuple[DataFrame, encode.LabelModel | None]:
    """Prepare a partition: chosen features, no null targets (unless live), encoded labels.

    Pass the label model of the training partition when preparing another one.
    """
    if features != "*":
        df = df.select(*dict.fromkeys([*keep, *features, target]))
    if not live:
        df = df.filter(F.col(target).isNotNull())
    if not classify:
        return df, None
    if labels is None:
        labels = encode.LabelEncoder(target).fit(df)
    return labels.transform(df), labels


def snapshot(df: DataFrame, folder: str) -> None:
    """Keep the engineered rows of a run, one sub-folder per partition."""
    df.write.mode("overwrite").partitionBy("partition").parquet(folder)


def ranked_predictions(df: DataFrame, scores: DataFrame, key: str, best: str) -> DataFrame:
    """Original columns plus every model's predictions, best model's score first."""
    return df.join(scores, key, "inner").orderBy(F.desc(best), key)


def submission(sample: DataFrame, scores: DataFrame, score: str) -> DataFrame:
    """The sample with its second column replaced by the score of the same id.

    Every sample row is kept, and ids are matched by value, not by position.
    """
    ident, value = sample.columns[:2]
    picked = scores.select(F.col(scores.columns[0]).alias("_id"), F.col(score).alias("_value"))
    joined = sample.join(picked, F.col(ident) == F.col("_id"), "left")
    return joined.withColumn(value, F.col("_value")).drop("_id", "_value")


def save_metrics(metrics: DataFrame, path: str, mode: str = "overwrite") -> None:
    metrics.select("algo", "partition", "metric", "value").write.mode(mode).parquet(path)


def record_run(spark: SparkSession, registry: str, run_id: str, path: str) -> None:
    """Append a finished run to the run table."""
    row = spark.range(1).select(
        F.lit(run_id).alias("run_id"), F.lit(path).alias("path"), F.current_timestamp().alias("saved_at")
    )
    row.write.mode("append").parquet(registry)


def latest_run(spark: SparkSession, registry: str) -> str:
    """Folder of the run recorded last."""
    newest = F.max_by("path", F.struct("saved_at", "run_id"))
    return spark.read.parquet(registry).agg(newest).first()[0]

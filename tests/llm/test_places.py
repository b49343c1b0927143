"""Rows by place, and the stages of the pipeline on odd tables."""

import collections

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tabforge.llm import minmax_dedup, mixing, places
from tests.conftest import SF


def _counted(df):
    return collections.Counter(map(tuple, df.collect()))


@pytest.mark.parametrize("limit", [64 << 20, 9000])
def test_rows_come_back_as_often_as_chosen(spark, tmp_path, monkeypatch, limit):
    monkeypatch.setattr(places, "BITMAP_BYTES", limit)
    df = spark.range(100_000).select("id", (F.col("id") % 7).alias("_metadata"), F.lit(None).alias("void"), F.col("id").cast("string").alias("_file"))
    df.drop("void").repartition(5).write.parquet(str(tmp_path / "t"))
    for source in (spark.read.parquet(str(tmp_path / "t")), df):
        placed = places.Placed(source)
        copies = F.when(F.col("id") % 3 == 0, 0).when(F.col("id") < 70_000, 1).otherwise(F.col("id") % 4)
        chosen = placed.df.select(placed.file.alias("_file"), placed.row.alias("_row"), copies.alias("_copies")).filter("_copies > 0")
        out = placed.rows(chosen, 3)
        assert out.columns == source.columns and out.dtypes == source.dtypes
        want = source.withColumn("n", copies).filter("n > 0").select(F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))), "id").select("id")
        assert out.select("id").exceptAll(want).isEmpty() and out.count() == want.count()


def test_rows_of_joins_and_repeated_reads(spark, tmp_path):
    """Tables that are not plain files are copied first: two rows made from one have places of their own."""
    spark.range(10).write.parquet(str(tmp_path / "t"))
    one = spark.read.parquet(str(tmp_path / "t"))
    for df in (one.union(one), one.withColumn("x", F.explode(F.array(F.lit(1), F.lit(2))))):
        placed = places.Placed(df)
        chosen = placed.df.select(placed.file.alias("_file"), placed.row.alias("_row")).distinct()
        assert chosen.count() == 20 and placed.rows(chosen.withColumn("_copies", F.lit(1))).count() == 20


def test_rows_without_id_are_compared_as_others(spark):
    """Sets are fetched by id and text: many rows without an id meet no others."""
    rows = [(None, " ".join(f"w{i}x{j}" for j in range(12))) for i in range(300)] + [(None, " ".join(f"w{i}x{j}" for j in range(12)) + " end") for i in range(0, 300, 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    signed, _ = minmax_dedup.labelled(df, "doc_id", "text", 5, 85)
    nodes = signed.select("node").distinct()
    assert minmax_dedup.sets_of(df, signed, nodes, "doc_id", "text", 5).count() == 400
    assert minmax_dedup.deduplicated(df).count() == 300


DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, ambiguous int, lang_pred string, _digest string, _key int, _source string, _size int, _copy string, spans string"


def _documents(spark):
    """Documents of the given table with columns that bear the operators' names, null ids, repeated rows and empty texts."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    docs = docs.withColumn("doc_id", F.when(F.col("doc_id") % 5 > 0, F.col("doc_id")))
    docs = docs.union(docs.limit(20)).union(spark.createDataFrame([(1, None, "en", None, None), (2, "", None, "b", 0), (None, None, None, None, None)], docs.schema))
    extra = {"score": F.concat(F.lit("s"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))), "ambiguous": F.lit(7), "lang_pred": F.lit("mine"), "_digest": F.lit("d"), "_key": F.lit(1),
             "_source": F.lit("x"), "_size": F.lit(3), "_copy": F.lit("c"), "spans": F.lit("none")}
    return docs.withColumns(extra).select(*[c.split()[0] for c in DOCS.split(", ")])


def test_stages_keep_user_columns_and_odd_rows(spark, tmp_path):
    docs = _documents(spark)
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        before = docs
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.dtypes == before.dtypes and docs.count() > 0
        assert {(r.ambiguous, r.lang_pred, r._key, r.spans) for r in docs.collect()} == {(7, "mine", 1, "none")}
        assert all(r.score == f"s{'-' if r.doc_id is None else r.doc_id}" for r in docs.collect())
        if name == "near_duplicates":
            assert max(_counted(docs.select("text")).values()) == 1
        if name == "mixing":
            plan = mixing.pareto_mix(before).agg(F.sum("copies")).first()[0]
            assert docs.count() == plan
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == docs.count()


def test_run_of_odd_and_empty_tables(spark, tmp_path):
    for name, docs in (("odd", _documents(spark)), ("empty", _documents(spark).limit(0))):
        docs.write.parquet(str(tmp_path / name / "documents.parquet"))
        out = corpus_pipeline.run(spark, str(tmp_path / name))
        assert (out.count() > 0) == (name == "odd")

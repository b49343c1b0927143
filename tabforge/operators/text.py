"""Text features: TF-IDF over word n-grams, on whole texts and the whole vocabulary."""

from __future__ import annotations

import ctypes
import functools
import math
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabforge.operators.scaling import NULL_TEXT
from tabforge.plans.scale import fits, lookup_join, materialise, prefix_sums, shared_folder

# An input of fewer bytes a core is spread over the cores before its texts are split.
SPREAD_BYTES = 64 * 1024 * 1024

# Runs of words in more bytes of text than this are weighed in blocks of about so many bytes; terms of so many meet to be counted.
LARGE_TEXT = 64 * 1024 * 1024
BLOCK_TEXT = 4 * 1024 * 1024
SHARE_TEXT = 16 * 1024 * 1024
# Rows that a task passes on at a time.
BATCH = 1 << 18

# Fixed value: a word is a run of two or more letters, digits or underscores.
WORD = r"([\p{L}\p{N}_]{2,})"


def words(text: Column | str) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(NULL_TEXT))), F.lit(WORD), F.lit(1))


def with_terms(df: DataFrame, text: str, output: str, ngrams_max: int = 1) -> DataFrame:
    """Add all word n-grams of length 1..n as an array, words joined by a blank.

    The words are a column of their own, so each text is split once; longer
    runs extend the runs one word shorter, which takes linear time.
    """
    df = df.withColumn("_words", words(text))
    if ngrams_max == 1:
        return df.withColumnRenamed("_words", output)
    tokens, runs, parts = F.col("_words"), F.col("_words"), ["_words"]
    for n in range(2, ngrams_max + 1):
        count = F.greatest(F.size(tokens) - (n - 1), F.lit(0))
        longer = F.zip_with(F.slice(runs, 1, count), F.slice(tokens, n, count), lambda a, b: F.concat(a, F.lit(" "), b))
        df = df.withColumn(f"_runs{n}", longer)
        runs = F.col(f"_runs{n}")
        parts.append(f"_runs{n}")
    return df.withColumn(output, F.concat(*parts)).drop(*parts)


def spread(df: DataFrame) -> DataFrame:
    """Small inputs lie in a file or two: spread over the cores. Larger ones are read by many tasks as they are."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * SPREAD_BYTES else df


def term_counts(df: DataFrame, text: str, output: str, ngrams_max: int = 1) -> DataFrame:
    """Add the distinct terms of each text with their numbers, as array<struct<term, tf>>; counted inside the row, without a shuffle.

    Sorted terms end a run where the next one differs; the places of the ends tell the lengths of the runs.
    """
    out = with_terms(df, text, "_terms", ngrams_max).withColumn("_sorted", F.sort_array("_terms"))
    ends = F.zip_with("_sorted", F.slice("_sorted", F.lit(2), F.size("_sorted")), lambda a, b: F.struct(a.alias("term"), (b.isNull() | (a != b)).alias("last")))
    out = out.withColumn("_ends", F.transform(ends, lambda x, i: F.when(x["last"], F.struct(x["term"].alias("term"), (i + 1).alias("upto")))))
    out = out.withColumn("_runs", F.filter("_ends", lambda x: x.isNotNull()))
    earlier = F.concat(F.array(F.lit(0)), F.transform("_runs", lambda x: x["upto"]))
    runs = F.zip_with("_runs", F.slice(earlier, F.lit(1), F.size("_runs")), lambda x, before: F.struct(x["term"].alias("term"), (x["upto"] - before).cast("long").alias("tf")))
    return out.withColumn(output, runs).drop("_terms", "_sorted", "_ends", "_runs")


def vocabulary(long: DataFrame, documents: int, least: int = 1) -> DataFrame:
    """(term, idf) of rows that hold each term of a document once: smooth inverse document frequency, of terms in ``least`` documents or more."""
    frequency = long.groupBy("term").agg(F.count(F.lit(1)).alias("df")).filter(F.col("df") >= least)
    return frequency.select("term", (F.log((1 + documents) / (1 + F.col("df"))) + 1).alias("idf"))


def tf_idf(df: DataFrame, key: str, text: str, ngrams_max: int = 1) -> DataFrame:
    """(key, term, weight) with smooth inverse document frequency, each document of length one.

    Terms are counted inside each row, once, and written as a table. Frequencies are partial aggregates shuffled by term. Terms of one
    document have the same weight, so the vocabulary is a table of the others, of any size, and its join a checked lookup. If it is too large to
    broadcast, rows are shuffled by term once and by document once, where a window adds up the length. Rows of one key are one document.

    The vocabulary of runs of words grows with the text, and each document would take both shuffles with most of it. In a large text they are
    weighed in blocks (``_block_weights``), unless one key has more text than a few blocks.
    """
    if ngrams_max > 1:
        size = F.coalesce(F.octet_length(F.col(text).cast("string")), F.lit(len(NULL_TEXT))).cast("long")
        each = df.groupBy(key).agg(F.sum(size).alias("_size"), F.count(F.lit(1)).alias("_n"))
        total, largest, documents = each.agg(F.sum("_size"), F.max("_size"), F.sum("_n")).first()
        if (total or 0) > LARGE_TEXT and largest <= 8 * BLOCK_TEXT:
            return _block_weights(df, key, text, ngrams_max, total, documents)
    kept = materialise(term_counts(spread(df.select(key, text)), text, "_counts", ngrams_max).select(key, "_counts"), columnar=True)
    documents = kept.count()
    long = kept.select(key, F.inline("_counts"))
    if not kept.groupBy(key).count().filter("count > 1").isEmpty():
        long = long.groupBy(key, "term").agg(F.sum("tf").alias("tf"))
    idf = materialise(vocabulary(long, documents, least=2), columnar=True)
    once = F.log(F.lit((1 + documents) / 2)) + 1
    weighted = lookup_join(long, idf, "term").select(key, "term", (F.col("tf") * F.coalesce("idf", once)).alias("_w"))
    squares = F.sum(F.col("_w") * F.col("_w"))
    if fits(idf):
        # rows stay where they were read: a document's terms lie together, and its length is nearly whole before the shuffle
        weighted = lookup_join(weighted, materialise(weighted.groupBy(key).agg(F.sqrt(squares).alias("_length"))), key, "inner")
    else:
        weighted = weighted.withColumn("_length", F.sqrt(squares.over(W.partitionBy(key))))
    return weighted.select(key, "term", (F.col("_w") / F.col("_length")).alias("weight"))


def _block_weights(df: DataFrame, key: str, text: str, ngrams_max: int, size: int, documents: int) -> DataFrame:
    """Weights of documents dealt out in blocks; what moves are the texts, and numbers of terms instead of terms.

    A block asks for the frequency of each of its terms once: sorted 80-bit hashes, as differences, go by share of the hashes with the numbers of
    the block's documents. (Two among 10^9 terms are alike with probability 4e-7.) Sums go back in the same order, so without the
    terms. Then the texts, packed as before, are dealt out again, split again, and weighed with the sums of their block, in one task.
    """
    blocks, bits = math.ceil(size / BLOCK_TEXT), max(1, math.ceil(math.log2(max(size / SHARE_TEXT, 1))))
    docs = df.select(F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias("_block"), F.col(key).alias("_key"), F.col(text).cast("string").alias("_text"))

    def coded(rows: DataFrame, terms: Column) -> DataFrame:
        out = rows.withColumn("_first", F.transform(terms, lambda x: F.xxhash64(x)))
        return out.withColumn("_second", F.transform(terms, lambda x: F.shiftright(F.xxhash64(F.lit(1), x), 48).cast("short")))

    @_trimmed
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, rows in _gathered(batches, "_block"):
            doc, first, second, _ = _hashed(rows)
            del rows
            order, starts = _alike(first, second, doc)
            first, second = first[order[starts]], second[order[starts]]
            starts = _starts(first, second)
            counts = np.diff(starts, append=len(first))
            first, second = first[starts], second[starts]
            shares = (first >> np.uint64(64 - bits)).astype(int)
            ends = [0, *(np.flatnonzero(np.diff(shares)) + 1), len(shares)]
            parts = [(a, b) for a, b in zip(ends, ends[1:]) if a < b]
            asked = [_squeeze(np.diff(first[a:b], prepend=np.uint64(0)), second[a:b], counts[a:b]) for a, b in parts]
            yield pa.RecordBatch.from_arrays([pa.array([block] * len(parts), pa.int32()), pa.array([shares[a] for a, _ in parts], pa.int32()),
                                              pa.array(asked, pa.binary())], ["_block", "_share", "_asked"])

    @_trimmed
    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for share, rows in _gathered(batches, "_share"):
            asked = [_stretch(x) for x in rows["_asked"].to_pylist()]
            first, second, counts = (np.concatenate(x) for x in zip(*[(np.cumsum(a, dtype="<u8"), b, c) for a, b, c in asked]))
            order, starts = _alike(first, second)
            sums = np.empty(len(order), "<u8")
            sums[order] = np.repeat(np.add.reduceat(counts[order], starts), np.diff(starts, append=len(order)))
            told = [_squeeze(x) for x in np.split(sums, np.cumsum([len(a) for a, _, _ in asked])[:-1])]
            yield pa.RecordBatch.from_arrays([rows["_block"].combine_chunks(), pa.array([share] * len(told), pa.int32()), pa.array(told, pa.binary())],
                                             ["_block", "_share", "_told"])

    @_trimmed
    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _gathered(batches, "_block"):
            texts = rows["_told"].null_count  # the sums come after the texts
            sums = np.concatenate([np.array([], "<u8"), *[_stretch(x)[0] for x in rows["_told"][texts:].to_pylist()]])
            rows = rows.slice(0, texts)
            doc, first, second, repeated = _hashed(rows)
            order, starts = _alike(first, second)
            if len(starts) != len(sums):
                raise RuntimeError("the texts of a block differ from those counted")
            if not len(order):
                continue
            frequency = np.empty(len(order))
            frequency[order] = np.repeat(sums, np.diff(starts, append=len(order)))
            counts = [c.flatten() for c in rows["_counts"].chunks]
            terms, at = pa.chunked_array([c.field("term") for c in counts], pa.string()), np.arange(len(order))
            tf = np.concatenate([c.field("tf").to_numpy(zero_copy_only=False) for c in counts])
            if repeated:
                order, starts = _alike(doc, first, second)
                at = order[starts]
                tf, doc, frequency = np.add.reduceat(tf[order], starts), doc[at], frequency[at]
            del order, first, second
            weight = tf * (np.log((1 + documents) / (1 + frequency)) + 1)
            weight /= np.sqrt(np.bincount(doc, weight * weight))[doc]
            held = np.repeat(np.arange(len(rows)), _lengths(rows, "_counts"))[at]
            names = rows["_key"].combine_chunks()
            del rows, tf, doc, frequency, starts
            for i in range(0, len(at), BATCH):
                some = slice(i, i + BATCH)
                some_terms = terms.take(pa.array(at[some])) if repeated else terms.slice(i, BATCH)
                yield pa.RecordBatch.from_arrays([names.take(pa.array(held[some])), some_terms.combine_chunks(), pa.array(weight[some])], [key, "term", "weight"])

    @_trimmed
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = pa.Table.from_batches([batch.take(pa.array(np.argsort(batch.column("_block").to_numpy(), kind="stable")))])
            for block, some in _gathered(iter(rows.to_batches()), "_block"):
                with pa.BufferOutputStream() as out:
                    some = some.select(["_key", "_text"])
                    with pa.ipc.new_stream(out, some.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as to:
                        to.write_table(some)
                    packed = out.getvalue().to_pybytes()
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([packed], pa.binary())], ["_block", "_pack"])

    @_trimmed
    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["_block", "_key", "_text", "_told"]
        for batch in batches:
            for block, packed, told in zip(*(batch.column(c).to_pylist() for c in ("_block", "_pack", "_told"))):
                if packed is None:
                    yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), *(pa.nulls(1, t) for t in kinds), pa.array([told], pa.binary())], names)
                    continue
                for some in pa.ipc.open_stream(packed):
                    n, kinds = some.num_rows, some.schema.types  # a block's texts come before its sums
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, block, "int32")), some.column(0), some.column(1), pa.nulls(n, pa.binary())], names)

    unpacked = T.StructType([*docs.schema.fields, T.StructField("_told", T.BinaryType())])
    packs = docs.mapInArrow(pack, "_block int, _pack binary")

    def dealt(rows: DataFrame, *order: Column) -> DataFrame:
        return rows.repartition(blocks, "_block").sortWithinPartitions("_block", *order).mapInArrow(unpack, unpacked)

    none = F.lit(None).cast("binary")
    split = with_terms(dealt(packs.withColumn("_told", none)), "_text", "_terms", ngrams_max)
    asked = coded(split, F.col("_terms")).select("_block", "_key", "_first", "_second").mapInArrow(ask, "_block int, _share int, _asked binary")
    told = asked.repartition(1 << bits, "_share").sortWithinPartitions("_share").mapInArrow(answer, "_block int, _share int, _told binary")
    told = materialise(told, columnar=True)
    both = packs.select("_block", "_pack", F.lit(None).cast("int").alias("_share"), none.alias("_told")).union(told.select("_block", none, "_share", "_told"))
    counted = term_counts(dealt(both, F.col("_share")), "_text", "_counts", ngrams_max)
    rows = coded(counted, F.col("_counts.term")).select("_block", "_key", "_counts", "_first", "_second", "_told")
    return rows.mapInArrow(weigh, T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("term", T.StringType()), T.StructField("weight", T.DoubleType())]))


def _trim() -> None:
    """Hand freed memory back."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


def _trimmed(run: Callable) -> Callable:
    """Memory goes back at the end of a Python task, as its worker waits on beside the next tasks."""

    @functools.wraps(run)
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        _trim()

    return task


def _gathered(batches: Iterator[pa.RecordBatch], by: str) -> Iterator[tuple[int, pa.Table]]:
    """The rows of each value of ``by``, which come one after another."""
    held: list[pa.RecordBatch] = []
    at = None
    for batch in batches:
        values = batch.column(by).to_numpy()
        ends = [0, *(np.flatnonzero(np.diff(values)) + 1), len(values)]
        for a, b in zip(ends, ends[1:]):
            if a == b:
                continue
            if held and values[a] != at:
                rows, held = pa.Table.from_batches(held), []
                yield at, rows
                rows = None
                _trim()
            at = int(values[a])
            held.append(batch.slice(a, b - a))
    if held:
        rows, held = pa.Table.from_batches(held), []
        yield at, rows


def _values(rows: pa.Table, column: str) -> np.ndarray:
    return np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in rows[column].chunks])


def _lengths(rows: pa.Table, column: str) -> np.ndarray:
    return pc.list_value_length(rows[column]).to_numpy()


def _hashed(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
    """Number of the document and both hashes of each term of each row, and whether a document has several rows."""
    numbers: dict[str, int] = {}
    doc = np.array([numbers.setdefault(repr(k), len(numbers)) for k in rows["_key"].to_pylist()], "int32")
    first, second = (_values(rows, c) for c in ("_first", "_second"))
    return np.repeat(doc, _lengths(rows, "_first")), first.view("<u8"), second.view("<u2"), len(numbers) < len(doc)


def _alike(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by the columns, and where in it equal rows start."""
    order = np.lexsort(columns[::-1])
    return order, _starts(*(c[order] for c in columns))


def _starts(*columns: np.ndarray) -> np.ndarray:
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _squeeze(*columns: np.ndarray) -> bytes:
    """Whole numbers of 0 or more as bytes, those of one weight together."""
    planes = [np.ascontiguousarray(c.astype("<u8")).view("u1").reshape(-1, 8).T.tobytes() for c in columns]
    return len(columns).to_bytes(1, "little") + zlib.compress(b"".join(planes), 1)


def _stretch(packed: bytes) -> np.ndarray:
    """The columns of ``_squeeze``."""
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(packed[1:]), "u1").reshape(packed[0], 8, -1).transpose(0, 2, 1)).view("<u8")[:, :, 0]


class TextVectors:
    """TF-IDF as a sparse vector column, for model input.

    The vocabulary is a table of terms, their numbers (running counts in the order of terms) and frequencies; vectors come from a join by term
    and an aggregate per row. Neither the driver nor a task holds the vocabulary, unless it was measured to be small enough
    to broadcast. Rows are written once with a number of their own, vectors are read back from a table.
    """

    def __init__(self, terms: DataFrame, output: str, size: int):
        self.terms, self.output, self.size = terms, output, size

    @classmethod
    def fit(cls, df: DataFrame, text: str, output: str, ngrams_max: int = 1) -> TextVectors:
        counts = materialise(term_counts(spread(df.select(text)), text, "_counts", ngrams_max).select("_counts"), columnar=True)
        found = materialise(vocabulary(counts.select(F.inline("_counts")), counts.count()), columnar=True)
        numbered = prefix_sums(found, [], [F.col("term")], {"number": F.lit(1).cast("long")})
        terms = materialise(numbered.withColumn("number", F.col("number") - 1), columnar=True)
        size = terms.count()
        if size >= 1 << 31:
            raise ValueError("a vector has fewer than 2^31 places")
        return cls(terms, output, max(size, 1))

    def save(self, path: str) -> None:
        self.terms.write.mode("overwrite").parquet(f"{path}/terms")
        self.terms.sparkSession.createDataFrame([(self.output, self.size)], "output string, size int").write.mode("overwrite").parquet(f"{path}/note")

    @classmethod
    def load(cls, path: str) -> TextVectors:
        spark = SparkSession.active()
        note = spark.read.parquet(f"{path}/note").first()
        return cls(spark.read.parquet(f"{path}/terms"), note["output"], note["size"])

    def transform(self, df: DataFrame, text: str, ngrams_max: int = 1) -> DataFrame:
        if df.isStreaming:
            raise ValueError("text vectors regroup rows, which a stream cannot offer: score its batches")
        rows = materialise(df.withColumn("_row", F.monotonically_increasing_id()), columnar=True)
        long = term_counts(rows.select("_row", text), text, "_counts", ngrams_max).select("_row", F.inline("_counts"))
        weighted = lookup_join(long, self.terms, "term", "inner")
        places = F.array_sort(F.collect_list(F.struct(F.col("number").cast("int").alias("number"), (F.col("tf") * F.col("idf")).alias("w"))))
        sparse = weighted.groupBy("_row").agg(places.alias("_places"))
        length = F.sqrt(F.aggregate("_places", F.lit(0.0), lambda a, x: a + x["w"] * x["w"]))
        vectors = sparse.withColumn("_length", length).select("_row", F.transform("_places", lambda x: x["number"]).alias("_indices"),
                                                              F.transform("_places", lambda x: x["w"] / F.col("_length")).alias("_values"))
        # the fields of a vector, as it is stored
        fields = F.struct(F.lit(0).cast("byte").alias("type"), F.lit(self.size).alias("size"),
                          F.coalesce("_indices", F.array().cast("array<int>")).alias("indices"), F.coalesce("_values", F.array().cast("array<double>")).alias("values"))
        out = rows.join(vectors, "_row", "left").withColumn(self.output, fields).drop("_row", "_indices", "_values")
        path = f"{shared_folder(df.sparkSession)}/vectors-{uuid.uuid4().hex}"
        out.write.parquet(path)
        schema = T.StructType([f for f in out.schema.fields if f.name != self.output] + [T.StructField(self.output, VectorUDT())])
        return df.sparkSession.read.schema(schema).parquet(path)

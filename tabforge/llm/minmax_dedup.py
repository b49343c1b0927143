"""Near-duplicate groups by min-max hashing.

Signature. A document's set holds its distinct word shingles. Each of 120 permutations of the shingle hashes gives two signature values, the
minimum and the maximum, so 240 values cost 120 evaluations; both agree with probability J between sets of Jaccard
similarity J, and together they vary less than two minima. Six values form a band; of 40 bands at least one is shared by a
pair of J = 0.85 with probability 1 - 6e-9.

Candidates. Equal sets are one class (exact copies never meet each other). In a bucket (band, key) every class is paired with one leader
(a different one per bucket), never with all others. Pairs that a 240-byte sketch puts far below the threshold (more
than six deviations) are left out, all others are confirmed on full sets, and links form components.

The rest. A bucket that still holds several components may hide a link between two non-leaders. Its classes go through an exact join by
prefixes: shingles in order of rarity, of which two similar sets share one among their first n - ceil(0.85 n) + 1, with length
and position bounds; only pairs from different components are confirmed. Whatever the size of a bucket, no link is lost there.

Scale. Texts are scanned, not shuffled, while the classes to confirm fit a measured broadcast; beyond it they are joined by id and digest.
``deduplicated`` chooses rows by file and row number, and a scan joined with bitmaps brings them back (``places``). Bands are aggregated with partial results, components come from min-label rounds with pointer jumping, each written to the shared folder.

Defined cases: null texts and texts without words have no set, link with nothing and form their own component; null ids: a component's id is its
smallest non-null id (null if it has none), a row is kept when its id equals it, null equal to null; repeated rows are copies and share
the answer; an empty table gives no rows. Only id and text are read. ``deduplicated`` keeps exactly one row of every component, that of
smallest id (null last), then of smallest text digest; rows without words are one component per id and text.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabforge.llm.common import give_back, keep, scratch
from tabforge.llm.places import Placed
from tabforge.plans.scale import fits, lookup_join

WORDS = 5
BANDS, ROWS = 40, 6
PERMUTATIONS = BANDS * ROWS // 2
_MIX = 0x9E3779B97F4A7C15
_WORD_CACHE = 120_000
# Full sets of up to so many bytes (measured) are broadcast.
SMALL_BYTES = 32 << 20
_words: dict[bytes, int] = {}


def word_hashes(text: str) -> np.ndarray:
    """64-bit hashes of the words of a text, A-Z lower-cased."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII letters and ASCII white space only
    if len(_words) > _WORD_CACHE:
        _words.clear()
    seen = _words
    out = []
    for w in words:
        h = seen.get(w)
        if h is None:
            h = seen[w] = xxhash.xxh3_64_intdigest(w)
        out.append(h)
    return np.array(out, dtype=np.uint64)


def _scramble(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; fewer words than a shingle form one."""
    h = word_hashes(text) if text else np.zeros(0, dtype=np.uint64)
    if not len(h):
        return h
    k = min(words, len(h))
    mixed = np.full(len(h) - k + 1, k, dtype=np.uint64)
    for j in range(k):
        mixed = _scramble(mixed * np.uint64(_MIX) + h[j:len(h) - k + 1 + j])
    return np.unique(mixed)


_random = np.random.default_rng(11)
_A = _random.integers(1, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _random.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)


def min_max(values: np.ndarray) -> np.ndarray:
    """Minimum and maximum under each permutation, side by side."""
    low, high = np.full(PERMUTATIONS, ~np.uint64(0)), np.zeros(PERMUTATIONS, dtype=np.uint64)
    for at in range(0, len(values), 2048):
        ranks = values[at:at + 2048, None] * _A + _B
        np.minimum(low, ranks.min(axis=0), out=low)
        np.maximum(high, ranks.max(axis=0), out=high)
    return np.stack([low, high], axis=1).reshape(-1)


def band_keys(values: np.ndarray) -> np.ndarray:
    """One 64-bit key per band of ``ROWS`` signature values."""
    rows = values.reshape(BANDS, ROWS)
    key = np.arange(BANDS, dtype=np.uint64)
    for j in range(ROWS):
        key = _scramble(key * np.uint64(_MIX) + rows[:, j])
    return key


def class_of(found: np.ndarray) -> int:
    """64-bit name of a set, as a signed number."""
    return int(np.frombuffer(xxhash.xxh3_64_digest(found.tobytes()), dtype=">i8")[0])


def signatures(df: DataFrame, key: str, text: str, words: int, place: Sequence[Column] = ()) -> DataFrame:
    """``_id, n_shingles, node, bands, sketch, _digest`` of the text and the columns ``place``; ``node, bands, sketch`` are null without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sizes, nodes, bands, sketches = [], [], [], []
                for value in part.column(1).to_pylist():
                    found = shingles(value, words)
                    sizes.append(len(found))
                    if not len(found):
                        nodes.append(None)
                        bands.append(None)
                        sketches.append(None)
                        continue
                    values = min_max(found)
                    nodes.append(class_of(found))
                    bands.append(band_keys(values).view(np.int64))
                    sketches.append((_scramble(values) & np.uint64(255)).astype(np.uint8).tobytes())
                yield pa.RecordBatch.from_arrays([
                    part.column(0), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), pa.array(bands, pa.list_(pa.int64())),
                    pa.array(sketches, pa.binary()), *part.columns[2:]], names=["_id", "n_shingles", "node", "bands", "sketch", *part.schema.names[2:]])
        _words.clear()
        give_back()

    rows = df.select(F.col(key).cast("long").alias("_id"), F.col(text).alias("_text"), text_digest(text).alias("_digest"), *place)
    carried = [f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[2:]]
    return rows.mapInArrow(run, ", ".join(["_id long, n_shingles long, node long, bands array<long>, sketch binary", *carried]))


def text_digest(text: str) -> Column:
    return F.unhex(F.md5(F.col(text).cast("binary")))


def sets_of(df: DataFrame, signed: DataFrame, nodes: DataFrame, key: str, text: str, words: int) -> DataFrame:
    """``node, found``: the full sets of the given classes, from one document each, known by its id and the digest of its text."""
    some = lookup_join(signed.filter("node IS NOT NULL").select("_id", "_digest", "node"), nodes, "node", "inner")
    first = some.groupBy("node").agg(F.min(F.struct("_digest", F.col("_id").isNull().alias("_none"), "_id")).alias("_first"))
    wanted = keep(first.select("node", "_first._id", "_first._digest"))
    rows = df.select(F.col(key).cast("long").alias("_id"), text_digest(text).alias("_digest"), F.col(text).alias("_text"))
    rows = lookup_join(rows, wanted, ["_digest", "_id"], "inner").select("node", "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part, seen = batch.slice(at, 512), {}
                for node, value in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    found = shingles(value, words)
                    if len(found) and class_of(found) == node:  # an id can name several texts
                        seen[node] = found.tobytes()
                yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.binary())], names=["node", "found"])
        _words.clear()
        give_back()

    return keep(rows.mapInArrow(run, "node long, found binary"))


@F.pandas_udf(T.DoubleType())
def sketch_likeness(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([(np.frombuffer(x, np.uint8) == np.frombuffer(y, np.uint8)).mean() for x, y in zip(a, b)], dtype=float)


@F.pandas_udf(T.LongType())
def common(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True)) for x, y in zip(a, b)], dtype="int64")


def _two(pairs: DataFrame, side: DataFrame) -> DataFrame:
    """Add the columns of ``side`` (one row per node) for both ends, as ``<column>_a`` and ``<column>_b``."""
    small = fits(side)
    for end in ("a", "b"):
        own = side.withColumnsRenamed({"node": end, **{c: f"{c}_{end}" for c in side.columns if c != "node"}})
        pairs = pairs.join(F.broadcast(own) if small else own, end)
    return pairs


class _Links:
    """Confirms pairs of classes."""

    def __init__(self, df: DataFrame, signed: DataFrame, sketches: DataFrame, key: str, text: str, words: int, percent: int):
        self.df, self.signed, self.sketches, self.key, self.text, self.words, self.percent = df, signed, sketches, key, text, words, percent

    def likely(self, pairs: DataFrame) -> DataFrame:
        """Without the pairs that sizes or sketches rule out."""
        both = _two(pairs, self.sketches)
        low, high = F.least("n_shingles_a", "n_shingles_b"), F.greatest("n_shingles_a", "n_shingles_b")
        share = self.percent / 100
        floor = share - 6.5 * (share * (1 - share) / (2 * PERMUTATIONS)) ** 0.5
        return keep(both.filter(low * 100 >= high * self.percent).filter(sketch_likeness("sketch_a", "sketch_b") >= floor).select("a", "b"))

    def confirmed(self, pairs: DataFrame) -> DataFrame:
        """The pairs that are links."""
        pairs = self.likely(pairs)
        nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        return self.compared(pairs, sets_of(self.df, self.signed, nodes, self.key, self.text, self.words))

    def compared(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """Links among ``pairs`` by full sets, which are broadcast while they are small."""
        small = fits(sets, size=SMALL_BYTES)
        for end in ("a", "b"):
            own = sets.select(F.col("node").alias(end), F.col("found").alias(f"f{end}"))
            pairs = pairs.join(F.broadcast(own) if small else own, end)
        both = pairs.withColumn("_both", common("fa", "fb"))
        union = (F.octet_length("fa") + F.octet_length("fb")) / 8 - F.col("_both")
        return keep(both.filter(F.col("_both") * 100 >= union * self.percent).select("a", "b").distinct())


def components(edges: DataFrame) -> DataFrame:
    """``node, label``: the smallest node that each node of an edge reaches."""
    both = edges.select(F.col("a").alias("source"), F.col("b").alias("target"))
    both = keep(both.union(edges.select("b", "a")).filter("source <> target").distinct())
    labels = keep(both.groupBy(F.col("source").alias("node")).agg(F.least(F.col("node"), F.min("target")).alias("label")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "source"), "source").groupBy(F.col("target").alias("node")).agg(F.min("label").alias("_near"))
        nearer = keep(labels.join(near, "node").withColumn("_best", F.least("label", "_near")))
        jump = nearer.select(F.col("node").alias("_best"), F.col("_best").alias("_further"))
        after = keep(nearer.join(jump, "_best").select("node", F.least("_best", "_further").alias("label"), F.col("label").alias("_old")))
        moved = after.filter("label <> _old").limit(1).count()
        labels = after.select("node", "label")
        if not moved:
            return labels


def joined(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """Labels after more edges: components of the graph of labels."""
    ends = edges
    for end in ("a", "b"):
        side = labels.select(F.col("node").alias(end), F.col("label").alias(f"_{end}"))
        ends = ends.join(side, end, "left").withColumn(f"_{end}", F.coalesce(f"_{end}", end))
    between = keep(ends.select(F.col("_a").alias("a"), F.col("_b").alias("b")).filter("a <> b").distinct())
    moved = components(between).select(F.col("node").alias("label"), F.col("label").alias("_to"))
    alone = moved.select(F.col("label").alias("node"), "label")  # classes that had no edge before
    every = labels.union(alone.join(labels.select("node"), "node", "left_anti"))
    return keep(every.join(moved, "label", "left").select("node", F.coalesce("_to", "label").alias("label")))


def prefix_pairs(sets: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Pairs of classes with different labels that could be similar: exact, by prefixes in order of rarity."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                values = np.frombuffer(found, np.int64)
                for at in range(0, len(values), 1 << 16):
                    some = values[at:at + (1 << 16)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(some), node)), pa.array(some), pa.array(np.full(len(some), len(values)))], names=["node", "shingle", "n"])

    tokens = keep(sets.mapInArrow(spread, "node long, shingle long, n long").distinct())
    often = tokens.groupBy("shingle").agg(F.count(F.lit(1)).alias("_often"))
    ranked = tokens.join(often, "shingle").withColumn("_at", F.row_number().over(W.partitionBy("node").orderBy("_often", "shingle")))
    least = F.ceil(F.col("n") * percent / 100)
    heads = ranked.filter((F.col("_at") <= F.col("n") - least + 1) & (F.col("_often") > 1))
    heads = keep(lookup_join(heads, labels, "node").withColumn("label", F.coalesce("label", "node")))
    one = heads.select("shingle", F.col("node").alias("a"), F.col("n").alias("na"), F.col("_at").alias("ia"), F.col("label").alias("la"))
    two = heads.select("shingle", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("_at").alias("ib"), F.col("label").alias("lb"))
    reach = F.lit(1) + F.least(F.col("na") - F.col("ia"), F.col("nb") - F.col("ib"))
    need = F.ceil((F.col("na") + F.col("nb")) * F.lit(percent) / F.lit(100 + percent))
    near = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent
    met = one.join(two, (one["shingle"] == two["shingle"]) & (F.col("a") < F.col("b")) & (F.col("la") != F.col("lb")) & near & (reach >= need))
    return keep(met.select("a", "b").distinct())


def labelled(df: DataFrame, key: str, text: str, words: int, percent: int, place: Sequence[Column] = ()) -> tuple[DataFrame, DataFrame]:
    """The signatures of the rows, and ``node, _least, label`` per class: its smallest id and its component."""
    signed = keep(signatures(df, key, text, words, place))
    banded = signed.filter("node IS NOT NULL").select("node", F.explode("bands").alias("band"))
    # the leader of a bucket is the class of smallest (name xor bucket): another order in every bucket, and a plain long to aggregate
    place = F.col("node").bitwiseXOR(F.col("band"))
    leaders = banded.groupBy("band").agg(F.min(place).alias("_first"), F.max(place).alias("_last")).filter("_first <> _last")
    leaders = keep(leaders.select("band", F.col("_first").bitwiseXOR(F.col("band")).alias("leader")))
    buckets = keep(lookup_join(banded, leaders, "band", "inner").groupBy("band", "leader", "node").agg(F.lit(1).alias("_one")).drop("_one"))
    pairs = buckets.filter("node <> leader").select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).distinct()

    met = buckets.select("node").distinct()
    sketches = lookup_join(signed.select("node", "n_shingles", "sketch"), met, "node", "inner")
    sketches = keep(sketches.groupBy("node").agg(F.max("n_shingles").alias("n_shingles"), F.max("sketch").alias("sketch")))
    links = _Links(df, signed, sketches, key, text, words, percent)
    edges = links.confirmed(keep(pairs))
    labels = components(edges)

    held = lookup_join(buckets.select("band", "node"), labels, "node").withColumn("label", F.coalesce("label", "node"))
    mixed = held.groupBy("band").agg(F.count(F.lit(1)).alias("_n"), F.min("label").alias("_low"), F.max("label").alias("_high"))
    mixed = mixed.filter("_n > 2 AND _low <> _high").select("band")
    unsettled = keep(lookup_join(buckets.select("band", "node"), keep(mixed), "band", "inner").select("node").distinct())
    if unsettled.limit(1).count():
        sets = sets_of(df, signed, unsettled, key, text, words)
        more = prefix_pairs(sets, labels, percent)
        if not fits(sets, size=SMALL_BYTES):  # else the sets are at hand, and sketches would save nothing
            more = links.likely(more)
        labels = joined(labels, links.compared(more, sets))

    classes = signed.filter("node IS NOT NULL").groupBy("node").agg(F.min("_id").alias("_least"))
    return signed, keep(classes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")))


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = 85) -> DataFrame:
    """Per row: ``key, n_shingles, component_id, kept``."""
    signed, classes = labelled(df, key, text, words, percent)
    least = classes.groupBy("label").agg(F.min("_least").alias("component_id"))
    named = classes.join(least, "label").select("node", "component_id")
    out = signed.select("_id", "n_shingles", "node").join(named, "node", "left")
    out = out.withColumn("component_id", F.when(F.col("node").isNull(), F.col("_id")).otherwise(F.col("component_id")))
    return out.select(F.col("_id").alias(key), "n_shingles", "component_id", F.col("_id").eqNullSafe(F.col("component_id")).alias("kept"))


def deduplicated(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = 85) -> DataFrame:
    """One row of ``df`` for each group; decided on narrow rows, the texts stay where they are."""
    placed = Placed(df)
    with scratch() as made:
        signed, classes = labelled(placed.df, key, text, words, percent, [placed.file.alias("_file"), placed.row.alias("_row")])
        place = F.struct(F.col("_id").isNull().alias("_none"), "_id", "_digest", "_file", "_row")
        some = signed.filter("node IS NOT NULL").join(classes.select("node", "label"), "node").groupBy("label").agg(F.min(place).alias("_first"))
        without = signed.filter("node IS NULL").groupBy("_id", "_digest").agg(F.min(F.struct("_file", "_row")).alias("_first"))
        out = placed.rows(some.select("_first._file", "_first._row").union(without.select("_first._file", "_first._row")))
        del made[-1]  # the bitmaps, which the result reads
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))

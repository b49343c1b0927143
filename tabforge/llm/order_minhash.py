"""Order MinHash fingerprints, sensitive to edit distance, and the edited copies they are tried on.

A text is cut into pieces (runs of up to eight characters that are not white space); ``k`` pieces in a row make a k-mer, and the
j-th time a k-mer occurs it counts as a k-mer of its own. One hash of (k-mer, j) gives both one of ``BINS`` bins and a value. Each bin
keeps the two k-mers of smallest value, puts them back into text order and hashes that pair: the bin's part of the signature
(a bin with one k-mer hashes that one, an empty bin has no part). Moved text changes the order inside pairs, replaced text changes
the minima, so the share of equal parts falls with the edit distance. Likeness is the number of equal parts over the number of bins
that either text fills.

Everything runs inside the row on arrays of 64-bit integers: values carry their positions in their low bits, so two primitive sorts
replace grouping and windows. Text position is kept modulo 2^24 pieces, hashes to 40 bits before binning.

The next document in the order of the key is found on (key, hash of text) alone: rows are range-partitioned, the last row of
a range looks into the table of first rows. One shuffle of the texts then serves both joins: it hands each document's head to
its predecessor, and joins the head there.

Defined cases: a null text is empty; an empty text has the empty fingerprint, two of them are alike with 1.0, an empty and a filled one with 0.0; a text of
fewer than ``k`` pieces is one k-mer; null keys come first; rows that repeat key and text count as one document in the order, and each
gets its row; a single document is its own successor; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabforge.llm.common import keep, same

PIECE = r"[^\x20\x09-\x0D]{1,8}"
K = 3
BIN_BITS = 6
BINS = 1 << BIN_BITS
POSITION_BITS = 24
VALUE_BITS = 63 - BIN_BITS - POSITION_BITS


def _let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it in ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _mer(v: Column) -> Column:
    return F.shiftright(v, POSITION_BITS)


def _occurrence(s: Column, v: Column, i: Column) -> Column:
    """How many equal k-mers stand before place ``i`` of the sorted array: found by halving steps, only where there are any."""
    steps = F.sequence(F.floor(F.log2(i + 1)).cast("int"), F.lit(0), F.lit(-1))

    def step(d: Column, t: Column) -> Column:
        further = d + F.call_function("shiftleft", F.lit(1), t)
        return F.when((further <= i) & (_mer(F.get(s, i - further)) == _mer(v)), further).otherwise(d)

    again = (i > 0) & (_mer(F.get(s, i - 1)) == _mer(v))
    return F.when(again, F.aggregate(steps, F.lit(0), step)).otherwise(F.lit(0))


def signature(text: Column, k: int = K) -> Column:
    """Array of longs, one per filled bin: the bin in the high bits, a 32-bit hash of its ordered pair below."""
    pieces = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PIECE), F.lit(0))
    hashes = F.transform(pieces, lambda w: F.xxhash64(w))
    low, high = (F.lit(x).cast("long") for x in ((1 << POSITION_BITS) - 1, -(1 << POSITION_BITS)))

    def mers(h: Column) -> Column:
        n = F.size(h)
        places = F.when(n > k, F.sequence(F.lit(0), n - k)).when(n > 0, F.array(F.lit(0))).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(k)]).bitwiseAND(high).bitwiseOR(i.cast("long").bitwiseAND(low)))

    def values(s: Column) -> Column:
        def one(v: Column, i: Column) -> Column:
            mixed = F.shiftrightunsigned(F.xxhash64(_mer(v), _occurrence(s, v, i)), 1)
            return mixed.bitwiseAND(high).bitwiseOR(v.bitwiseAND(low))
        return F.transform(s, one)

    def chosen(e: Column) -> Column:
        """The two smallest of each bin, as bin, position, value from high to low bits."""
        shift = 63 - BIN_BITS
        bin_of = lambda v: F.shiftright(v, shift)
        first_two = F.filter(e, lambda v, i: (i < 2) | (bin_of(F.get(e, i - 2)) != bin_of(v)))
        value = lambda v: F.shiftright(v, POSITION_BITS).bitwiseAND(F.lit((1 << VALUE_BITS) - 1).cast("long"))
        return F.array_sort(F.transform(first_two, lambda v: F.shiftleft(bin_of(v), shift).bitwiseOR(
            F.shiftleft(v.bitwiseAND(low), VALUE_BITS)).bitwiseOR(value(v))))

    def parts(c: Column) -> Column:
        bin_of = lambda v: F.shiftright(v, 63 - BIN_BITS)
        value = lambda v: v.bitwiseAND(F.lit((1 << VALUE_BITS) - 1).cast("long"))

        def pair(i: Column) -> Column:
            here, after = F.get(c, i), F.get(c, i + 1)
            second = F.when(bin_of(after) == bin_of(here), value(after)).otherwise(F.lit(-1).cast("long"))
            return F.shiftleft(bin_of(here), 32).bitwiseOR(F.xxhash64(value(here), second).bitwiseAND(F.lit((1 << 32) - 1).cast("long")))

        starts = F.filter(F.sequence(F.lit(0), F.size(c) - 1), lambda i: (i == 0) | (bin_of(F.get(c, i - 1)) != bin_of(F.get(c, i))))
        return F.when(F.size(c) > 0, F.transform(starts, pair)).otherwise(F.array().cast("array<bigint>"))

    return _let(hashes, lambda h: _let(F.sort_array(mers(h)), lambda s: _let(F.sort_array(values(s)), lambda e: _let(chosen(e), parts))))


def fingerprint(parts: Column) -> Column:
    """A signature as text: ten hexadecimal digits for each filled bin."""
    return F.array_join(F.transform(parts, lambda v: F.lpad(F.hex(v), 10, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Equal parts over bins filled in either signature."""
    bins = lambda x: F.transform(x, lambda v: F.shiftright(v, 32))
    either = F.size(F.array_union(bins(a), bins(b)))
    return F.when(either == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / either)


def successors(ids: DataFrame) -> DataFrame:
    """``_id, _hash, _next_id, _next_hash`` for distinct rows in ascending order, the first following the last."""
    order = [F.col("_id").asc_nulls_first(), F.col("_hash").asc()]
    n = max(2, int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = keep(ids.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()))
    me = F.struct("_id", "_hash")
    # one row per range, at most as many as there are shuffle partitions
    heads = ranged.groupBy("_range").agg(F.min(F.struct(F.col("_id").isNotNull().alias("_filled"), "_id", "_hash")).alias("_head"))
    heads = heads.select("_range", F.struct("_head._id", "_head._hash").alias("_head")).withColumn("_one", F.lit(1))
    by = W.partitionBy("_one").orderBy("_range")
    heads = heads.select("_range", F.coalesce(F.lead("_head").over(by), F.first("_head").over(W.partitionBy("_one").orderBy("_range"))).alias("_after"))
    inside = ranged.withColumn("_next", F.lead(me).over(W.partitionBy("_range").orderBy(*order)))
    out = inside.join(F.broadcast(heads), "_range").withColumn("_next", F.coalesce("_next", "_after"))
    return out.select("_id", "_hash", F.col("_next._id").alias("_next_id"), F.col("_next._hash").alias("_next_hash"))


def edited_copies(df: DataFrame, key: str = "doc_id", text: str = "text", share: int = 4) -> DataFrame:
    """Per row ``_id, _hash, _text, n_chars, edited, _next_id, _next_hash``: the last 1/share of a text replaced by the head of the next."""
    docs = df.select(F.col(key).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text")).withColumn("_hash", F.xxhash64("_text"))
    want = F.max(F.floor(F.length("_text") / share).cast("int")).alias("_want")
    ids = keep(docs.groupBy("_id", "_hash").agg(want, F.count(F.lit(1)).alias("_rows")))
    order = keep(same(successors(ids.select("_id", "_hash")), ids.select("_id", "_hash", "_want"), ["_id", "_hash"], "inner"))
    # what each document hands to its predecessor; the shuffled texts serve this join and the next
    asked = order.select(
        F.col("_id").alias("_to_id"), F.col("_hash").alias("_to_hash"), "_want", F.col("_next_id").alias("_id"), F.col("_next_hash").alias("_hash"))
    giving = docs
    if (ids.agg(F.max("_rows")).first()[0] or 0) > 1:  # repeated rows hand out one copy
        giving = docs.groupBy("_id", "_hash").agg(F.first("_text").alias("_text"))
    heads = same(giving, asked, ["_id", "_hash"], "inner").select(
        F.col("_to_id").alias("_to"), F.col("_to_hash"), F.col("_id").alias("_next_id"), F.col("_hash").alias("_next_hash"),
        F.left("_text", F.col("_want")).alias("_head"))
    heads = heads.withColumnsRenamed({"_to": "_id", "_to_hash": "_hash"})
    out = same(docs, heads, ["_id", "_hash"], "inner").withColumn("n_chars", F.length("_text").cast("long"))
    kept = (F.col("n_chars") - F.floor(F.col("n_chars") / share)).cast("int")
    return out.withColumn("edited", F.concat(F.left("_text", kept), "_head")).drop("_head")


def near_copies(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and its edited copy, and their likeness; also likeness to the next document."""
    docs = edited_copies(df, key, text)
    docs = docs.select(
        "_id", "_hash", "n_chars", "_next_id", "_next_hash", F.sha2(F.col("edited"), 256).alias("edited_sha256"),
        signature(F.col("_text")).alias("_parts"), signature(F.col("edited")).alias("_edited"))
    docs = keep(docs)
    of_next = docs.groupBy(F.col("_id").alias("_next_id"), F.col("_hash").alias("_next_hash")).agg(F.first("_parts").alias("_next_parts"))
    out = same(docs, of_next, ["_next_id", "_next_hash"], "inner")
    return out.select(
        F.col("_id").alias(key), "n_chars", "edited_sha256", fingerprint(F.col("_parts")).alias("fingerprint"),
        fingerprint(F.col("_edited")).alias("edited_fingerprint"), likeness(F.col("_parts"), F.col("_edited")).alias("near_edited"),
        likeness(F.col("_parts"), F.col("_next_parts")).alias("near_next"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(spark.read.parquet(f"{sf_dir}/documents.parquet"))

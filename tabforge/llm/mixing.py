"""Mixing sources to target weights by Pareto order sampling.

Targets. Sources in code-point order (null last) take weights in turn and share ``share`` times all words. A target stops at ``cap``
times its source; the excess goes to the others by weight. Sorted by cap/weight the capped sources are a prefix, so running sums
over the table of sources give the final level at once.

Inclusion. Inside a source a document expects e = min(cap, k * w) copies, where w is the bit length of its size (longer documents
repeat more often) and k makes the expected words meet the target; sizes of one bit length share e, so k comes from running sums
over at most 64 rows a source. floor(e) copies are certain. The fraction p = e - floor(e) is an inclusion probability:
documents are ranked by Q = (u / (1 - u)) / (p / (1 - p)) with u a uniform hash of the key, and the sample of fixed size is the head of
that order, size being counted in words: a document is in when the middle of its words lies within what is left of the target.
So a source misses its target by at most half a document.

Scale. Texts are read once, to count words; the rest works on (key, source, size) in the shared folder. The order of a hot
source is never held by one task: documents fall into 1,024 ranges of Q, sums by range tell which ones are in, and only the one
range that holds the border is ordered (by blocks when it is large). Random numbers are hashes, so reruns agree.

Defined cases: null or empty texts have size 0 and give 0 words; null sources form the last source; a null key hashes as empty text;
repeated rows are ranked alike and counted each; an empty table gives no rows. Only key, source and text are read, so other columns
cannot clash.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabforge.llm.common import WORD, keep, scratch
from tabforge.llm.places import Placed
from tabforge.plans.scale import lookup_join, positions, prefix_sums

RANGES = 1024


def uniform(key: Column, seed: int) -> Column:
    """A number in (0, 1) with 52 random bits from the MD5 of ``seed:key``."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(2**52))


def words_of(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, share: float, weights: Sequence[int], cap: int) -> DataFrame:
    """One row per source: ``source, source_size, target``. ``sizes`` has ``source, source_size``."""
    numbered = positions(sizes, [], [F.col("source").asc_nulls_last()], "_at")
    pick = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (((F.col("_at") - 1) % len(weights)) + 1).cast("int"))
    table = keep(numbered.withColumn("_weight", pick.cast("long")).withColumn("_cap", F.col("source_size") * F.lit(int(cap))))
    words, weight = table.agg(F.sum("source_size"), F.sum("_weight")).first()
    if words is None:
        return table.select("source", "source_size", F.lit(0.0).alias("target"))
    order = [F.col("_cap") / F.col("_weight"), F.col("_at")]
    run = prefix_sums(table, [], order, {"_caps": F.col("_cap"), "_weights": F.col("_weight")}, inclusive=False)
    level = (F.lit(share * words) - F.col("_caps")) / (F.lit(weight) - F.col("_weights"))
    first = run.withColumn("_level", level).filter(F.col("_level") * F.col("_weight") <= F.col("_cap")).orderBy(*order).select("_level").first()
    free = F.lit(first[0]) * F.col("_weight") if first else F.col("_cap").cast("double")
    return table.select("source", "source_size", F.least(F.col("_cap").cast("double"), free).alias("target"))


def copies_by_class(classes: DataFrame, targets: DataFrame, cap: int) -> DataFrame:
    """Expected copies ``_e`` and the words ``_open`` left to the sample, per source and bit length ``_bits``.

    ``classes`` has ``source, _bits, _words``; a source has at most 64 of them.
    """
    down = W.partitionBy("source").orderBy(F.desc("_bits")).rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy("source")
    mass = F.col("_words") * F.col("_bits")
    t = lookup_join(classes.filter("_words > 0"), targets, "source", "inner")
    t = t.withColumns({
        "_above": F.coalesce(F.sum("_words").over(down), F.lit(0)) * F.lit(int(cap)),
        "_rest": F.sum(mass).over(whole) - F.coalesce(F.sum(mass).over(down), F.lit(0)),
    })
    t = t.withColumn("_k", (F.col("target") - F.col("_above")) / F.col("_rest"))
    free = F.col("_k") * F.col("_bits") <= F.lit(cap)
    k = F.max_by(F.when(free, F.col("_k")), F.when(free, F.col("_bits"))).over(whole)
    e = F.when(F.col("target") >= F.col("source_size") * F.lit(int(cap)), F.lit(float(cap)))
    e = F.coalesce(e, F.least(F.lit(float(cap)), k * F.col("_bits")), F.lit(float(cap)))
    t = t.withColumn("_e", e)
    certain = F.sum(F.floor("_e") * F.col("_words")).over(whole)
    return t.select("source", "_bits", "_e", (F.col("target") - certain).alias("_open"))


def pareto_mix(
    df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
    share: float = 1.5, weights: Sequence[int] = (5, 2, 1), cap: int = 2, seed: int = 17,
) -> DataFrame:
    """Per row: ``key, source, size, source_size, target, copies, taken``."""
    out = _planned(df.select(F.col(key).alias("_key"), F.col(source).alias("source"), words_of(text).alias("size")), share, weights, cap, seed)
    return out.withColumnRenamed("_key", key)


def _planned(docs: DataFrame, share: float, weights: Sequence[int], cap: int, seed: int) -> DataFrame:
    """The plan for ``_key, source, size``; further columns of ``docs`` stay, and settle ties in their order."""
    extra = docs.columns[3:]
    docs = keep(docs)
    docs = docs.withColumn("_bits", F.length(F.bin("size")).cast("long"))
    classes = keep(docs.groupBy("source", "_bits").agg(F.sum("size").alias("_words")))
    targets = keep(source_targets(keep(classes.groupBy("source").agg(F.sum("_words").alias("source_size"))), share, weights, cap))
    plan = keep(copies_by_class(classes, targets, cap))

    docs = lookup_join(lookup_join(docs, targets, "source"), plan, ["source", "_bits"])
    docs = docs.withColumns({"_e": F.coalesce("_e", F.lit(0.0)), "_open": F.coalesce("_open", F.lit(0.0))})
    u, p = uniform(F.col("_key"), seed), F.col("_e") - F.floor("_e")
    docs = docs.withColumn("_q", F.when(p > 0, (u / (F.lit(1.0) - u)) / (p / (F.lit(1.0) - p))))
    docs = docs.withColumn("_range", F.floor(F.col("_q") / (F.lit(1.0) + F.col("_q")) * RANGES))
    docs = keep(docs)

    sums = docs.filter("_q IS NOT NULL").groupBy("source", "_range").agg(F.sum("size").alias("_n"), F.max("_open").alias("_open"))
    upto = F.sum("_n").over(W.partitionBy("source").orderBy("_range"))
    border = sums.withColumn("_upto", upto).filter("_upto > _open").groupBy("source").agg(
        F.min("_range").alias("_border"), F.min_by(F.col("_upto") - F.col("_n"), "_range").alias("_base"))
    docs = lookup_join(docs, keep(border), "source")
    inside = F.coalesce(F.col("_range") < F.coalesce("_border", F.lit(RANGES + 1)), F.lit(False))
    at_border = F.coalesce(F.col("_range") == F.col("_border"), F.lit(False))
    rest = docs.filter(~at_border).withColumn("_in", inside)
    head = prefix_sums(docs.filter(at_border), ["source"], [F.col("_q"), F.col("_key"), F.col("size"), *[F.col(c) for c in extra]], {"_before": F.col("size")}, inclusive=False)
    head = head.withColumn("_in", 2 * (F.col("_base") + F.col("_before")) + F.col("size") <= 2 * F.col("_open")).drop("_before")
    out = rest.unionByName(head)
    copies = (F.floor("_e") + F.col("_in").cast("long")).cast("long")
    return out.select("_key", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), *extra)


def mixed(
    df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
    share: float = 1.5, weights: Sequence[int] = (5, 2, 1), cap: int = 2, seed: int = 17,
) -> DataFrame:
    """The mix itself: every row of ``df`` as often as it is taken.

    The plan is made on narrow rows that know their file and row number, and a scan joined with bitmaps brings the texts back (``places``). Where
    the border of the sample falls among rows of one key, source and size, the digest of the text decides.
    """
    placed = Placed(df)
    with scratch() as made:
        digest = F.unhex(F.md5(F.col(text).cast("binary")))
        narrow = placed.df.select(F.col(key).alias("_key"), F.col(source).alias("source"), words_of(text).alias("size"),
                                  digest.alias("_digest"), placed.file.alias("_file"), placed.row.alias("_row"))
        plan = _planned(narrow, share, weights, cap, seed).filter("copies > 0")
        out = placed.rows(plan.select("_file", "_row", F.col("copies").alias("_copies")), cap)
        del made[-1]  # the bitmaps, which the result reads
    return out


SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    ((('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT)::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM documents
), b AS (
  SELECT *, CASE WHEN size = 0 THEN 1 ELSE floor(log2(size))::BIGINT + 1 END AS bits FROM d
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), n AS (
  SELECT *, row_number() OVER (ORDER BY encode(source) NULLS LAST) AS nth FROM s
), w AS (
  SELECT *, [5, 2, 1][(nth - 1) % 3 + 1]::BIGINT AS weight, source_size * 2 AS cap FROM n
), r AS (
  SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / weight, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS caps,
    coalesce(sum(weight) OVER (ORDER BY cap / weight, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS weights FROM w
), l AS (
  SELECT *, (1.5::DOUBLE * (SELECT sum(source_size)::BIGINT FROM s) - caps::DOUBLE) / ((SELECT sum(weight)::BIGINT FROM w) - weights)::DOUBLE AS level FROM r
), t AS (
  SELECT source, source_size, least(cap::DOUBLE, coalesce((SELECT min_by(level, cap / weight) FROM l WHERE level * weight <= cap) * weight, cap::DOUBLE)) AS target
  FROM w
), c AS (
  SELECT source, bits, sum(size)::BIGINT AS words FROM b GROUP BY ALL HAVING sum(size) > 0
), k AS (
  SELECT c.*, t.target, t.source_size,
    coalesce(sum(words) OVER (PARTITION BY c.source ORDER BY bits DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT * 2 AS above,
    (sum(words * bits) OVER (PARTITION BY c.source) - coalesce(sum(words * bits) OVER (PARTITION BY c.source ORDER BY bits DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS rest
  FROM c JOIN t ON c.source IS NOT DISTINCT FROM t.source
), k2 AS (
  SELECT *, (target - above::DOUBLE) / rest::DOUBLE AS k FROM k
), k3 AS (
  SELECT source, max_by(k, bits) AS k FROM k2 WHERE k * bits <= 2 GROUP BY source
), e AS (
  SELECT k2.source, bits, words, target, CASE WHEN target >= source_size * 2 THEN 2.0::DOUBLE ELSE coalesce(least(2.0::DOUBLE, k3.k * bits), 2.0::DOUBLE) END AS e
  FROM k2 LEFT JOIN k3 ON k2.source IS NOT DISTINCT FROM k3.source
), o AS (
  SELECT *, target - (sum(floor(e)::BIGINT * words) OVER (PARTITION BY source))::DOUBLE AS open FROM e
), q AS (
  SELECT b.doc_id, b.source, b.size, t.source_size, t.target, coalesce(o.e, 0) AS e, o.open,
    CASE WHEN o.e - floor(o.e) > 0 THEN (u / (1.0::DOUBLE - u)) / ((o.e - floor(o.e)) / (1.0::DOUBLE - (o.e - floor(o.e)))) END AS q
  FROM b JOIN t ON b.source IS NOT DISTINCT FROM t.source LEFT JOIN o ON b.source IS NOT DISTINCT FROM o.source AND b.bits = o.bits
), p AS (
  SELECT *, coalesce(sum(size) FILTER (q IS NOT NULL) OVER (PARTITION BY source ORDER BY q NULLS LAST, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM q
)
SELECT doc_id, size, source_size, target,
  ((floor(e)::BIGINT + CASE WHEN q IS NOT NULL AND 2 * before + size <= 2 * open THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM p
"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pareto_mix(docs).select("doc_id", "size", "source_size", "target", "taken")

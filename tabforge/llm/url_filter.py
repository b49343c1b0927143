"""URL filter: host-suffix and path-prefix expressions, met by short hash prefixes and confirmed by full digests.

Every rule is an expression ``host`` + ``path``. A URL is expanded into the expressions that could be rules: its last k labels
joined to the first n characters of its path, for each shape (k, n) that some rule has. The first 32 bits of their SHA-256 meet
the rules' in an equi-join, the whole digests confirm, and the longest confirmed rule decides.

Only built-in functions are used. URLs are cut to what rules can see and made distinct before they are expanded, so a hot host is
one row; the verdicts return to the rows by an equi-join whose hot keys adaptive execution splits.

Defined cases: a null URL, or one without ``://``, has an empty host and path and gets the default verdict; rules with a null or empty
host are left out, a null path counts as empty; of equal expressions with different verdicts ``block`` wins; of fitting rules of one
length the longer host wins; no rules, no pages: default verdicts, no rows. Repeated rows each get their row. Other columns stay;
the added ones replace columns of the same name.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabforge.llm.common import ascii_lower, same
from tabforge.plans.scale import fits


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(_rest(url), r"^[^/?#]*", 0)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _rest(url: Column) -> Column:
    """What follows the first ``://``; null when there is none."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """(host, path, verdict) triples as a table."""
    rows = [F.struct(*[F.lit(v).cast("string").alias(k) for k, v in zip(("host", "path", "verdict"), r)]) for r in rules]
    if not rows:
        return spark.range(0).selectExpr("'' AS host", "'' AS path", "'' AS verdict")
    return spark.range(1).select(F.inline(F.array(*rows)))


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, path), 256)


def url_verdicts(df: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", prefix_chars: int = 8) -> DataFrame:
    """Add ``host``, ``path``, ``rule`` and ``verdict`` to every row."""
    known = rules.select(ascii_lower(F.col("host")).alias("_h"), F.coalesce("path", F.lit("")).alias("_p"), F.col("verdict").alias("_v"))
    known = known.filter(F.col("_h") != "").groupBy("_h", "_p").agg(F.max("_v").alias("_v"))  # 'block' sorts after 'allow'
    known = known.select(
        _digest(F.col("_h"), F.col("_p")).alias("_full"), F.concat("_h", "_p").alias("_rule"), "_v",
        F.length("_h").alias("_hlen"), F.size(F.split("_h", r"\.")).alias("_labels"), F.length("_p").alias("_chars"))
    # shapes, not rules: at most (labels of a host) x (length of a path)
    shapes = [(r[0], r[1]) for r in known.select("_labels", "_chars").distinct().collect()]
    parts = df.drop("host", "path", "rule", "verdict").withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    if not shapes:
        return parts.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    labels, chars = max(k for k, _ in shapes), max(n for _, n in shapes)
    tail, head = F.substring_index("host", ".", -labels), F.left("path", F.lit(chars))
    parts = parts.withColumns({"_tail": tail, "_head": head})
    seen = parts.select("_tail", "_head").distinct()
    have = F.size(F.split("_tail", r"\."))
    shape = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(n).alias("n")) for k, n in sorted(shapes)]))
    grown = seen.withColumn("_labels_here", have).withColumn("_shape", shape)
    grown = grown.filter((F.col("_shape.k") <= F.col("_labels_here")) & (F.col("_shape.n") <= F.length("_head")))
    host = F.expr("substring_index(_tail, '.', -_shape.k)")
    grown = grown.select("_tail", "_head", _digest(host, F.left("_head", F.col("_shape.n"))).alias("_own"))
    grown = grown.withColumn("_short", F.left("_own", F.lit(prefix_chars)))
    known = known.withColumn("_short", F.left("_full", F.lit(prefix_chars))).select("_short", "_full", "_rule", "_v", "_hlen")
    met = grown.join(F.broadcast(known) if fits(known) else known, "_short").filter("_own = _full")
    best = met.groupBy("_tail", "_head").agg(F.max(F.struct(F.length("_rule").alias("n"), "_hlen", "_rule", "_v")).alias("_best"))
    out = same(parts, best, ["_tail", "_head"])
    return out.withColumns({"rule": F.col("_best._rule"), "verdict": F.coalesce("_best._v", F.lit(default))}).drop("_tail", "_head", "_best")


# Fixed values of the registered query.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]

_FITS = "((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))"
_CASES = sorted(RULES, key=lambda r: -len(r[0] + r[1]))
SQL = f"""
WITH rest AS (
  SELECT page_id, CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN '' ELSE substr(url, strpos(url, '://') + 3) END AS r FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest
)
SELECT page_id, host, path,
  CASE {" ".join(f"WHEN {_FITS.format(h=h, p=p)} THEN '{h}{p}'" for h, p, _ in _CASES)} END AS rule,
  CASE {" ".join(f"WHEN {_FITS.format(h=h, p=p)} THEN '{v}'" for h, p, v in _CASES)} ELSE 'allow' END AS verdict
FROM parts
"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return url_verdicts(pages, rule_table(spark, RULES)).select("page_id", "host", "path", "rule", "verdict")

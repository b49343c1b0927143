"""Removal of word windows that occur more than once, by prefix-partitioned suffix trees.

A window is ``window`` consecutive words. Suffixes that start at every word are too many to ship, so they are gathered at anchors: of the
k-word sequences inside a window the one with the least hash (the leftmost of equals) anchors it. Equal windows have equal anchors at
equal places, so nothing is lost, and neighbouring windows mostly share one: a *segment* is the run of windows of one anchor, at most
``window - k + 1`` of them.

Groups. Segments are counted by (anchor, content), with partial results. A segment that occurs twice settles all its windows; so does an anchor
of only one, single segment. What is left are anchors with several different segments: their contents are fetched once per
content, partitioned by the anchor's prefix of k words and turned into a suffix tree per anchor: suffixes in order, neighbours with a common prefix
of ``window`` words share a deep internal node, and every suffix below such a node is a repeat. An anchor of more than
``GROUP_SEGMENTS`` different segments does not fit one tree; its suffixes are partitioned by longer prefixes, up to the whole window, where
a tree is a single node and a count decides. Results return to texts by equi-joins; texts are told apart by a hash of their content, so exact copies are one.

Defined cases: null texts have no words; texts shorter than a window keep everything; repeated rows are copies of each other (all their windows go);
overlapping occurrences inside one text count as different; an empty table gives no rows; only the text is read and ``n_words``,
``n_removed`` and ``kept`` are added, replacing columns of those names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabforge.llm.common import keep
from tabforge.plans.scale import lookup_join

WINDOW = 35
ANCHOR_WORDS = 12
GROUP_SEGMENTS = 4096
_MIX = np.uint64(0x9E3779B97F4A7C15)
_CACHE = 120_000
_known: dict[bytes, int] = {}


def _scramble(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split() if text else []


def hashes_of(words: list[bytes]) -> np.ndarray:
    if len(_known) > _CACHE:
        _known.clear()
    out = []
    for w in words:
        h = _known.get(w)
        if h is None:
            h = _known[w] = xxhash.xxh3_64_intdigest(w)
        out.append(h)
    return np.array(out, dtype=np.uint64)


def text_name(words: list[bytes]) -> int:
    """64-bit name of a word sequence."""
    return int(np.frombuffer(xxhash.xxh3_64_digest(b" ".join(words)), dtype=">i8")[0])


def rolling(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` words."""
    out = np.full(max(0, len(h) - size + 1), size, dtype=np.uint64)
    for j in range(size):
        out = out * _MIX + h[j:j + len(out)]
    return _scramble(out)


def segments(h: np.ndarray, window: int, k: int) -> tuple[np.ndarray, ...]:
    """Anchor hash, segment hash, first window and number of windows of every segment, in text order."""
    if len(h) < window:
        none = np.zeros(0, dtype=np.int64)
        return none.astype(np.uint64), none.astype(np.uint64), none, none
    mers, wide = rolling(h, k), rolling(h, window)
    span = window - k + 1
    at = np.empty(len(wide), dtype=np.int64)
    for low in range(0, len(wide), 1 << 14):
        view = np.lib.stride_tricks.sliding_window_view(mers[low:low + (1 << 14) + span - 1], span)
        at[low:low + len(view)] = view.argmin(axis=1) + np.arange(low, low + len(view))
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    last = np.concatenate((first[1:], [len(at)])) - 1
    # the anchor's place inside the segment belongs to its content
    place = (at[first] - first).astype(np.uint64) * np.uint64(64) + (last - first).astype(np.uint64)
    return mers[at[first]], _scramble((wide[first] * _MIX + wide[last]) * _MIX + place), first, last - first + 1


def _anchored(df: DataFrame, text: str, window: int, k: int) -> DataFrame:
    """``name, anchor, segment, start, windows`` of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                parts = []
                for value in batch.column(0).slice(low, 256).to_pylist():
                    words = words_of(value)
                    if len(words) >= window:
                        found = segments(hashes_of(words), window, k)
                        parts.append((np.full(len(found[0]), text_name(words)), found[0].view(np.int64), found[1].view(np.int64), found[2], found[3]))
                if parts:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(c)) for c in zip(*parts)], names=["name", "anchor", "segment", "start", "windows"])
        _known.clear()

    return df.select(text).mapInArrow(run, "name long, anchor long, segment long, start long, windows long")


def _contents(df: DataFrame, text: str, wanted: DataFrame, window: int, k: int) -> DataFrame:
    """``anchor, segment, windows, words`` for the wanted ``name, start``: the hashes of the words of each segment."""
    places = keep(wanted.groupBy("name").agg(F.collect_set("start").alias("starts")))

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                texts = batch.column(0).slice(low, 256)
                yield pa.RecordBatch.from_arrays([texts, pa.array([text_name(words_of(v)) for v in texts.to_pylist()], pa.int64())], names=["text", "name"])

    rows = df.select(F.col(text).alias("text")).mapInArrow(named, "text string, name long")
    rows = lookup_join(rows, places, "name", "inner").select("name", "text", "starts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()  # one copy of a text is enough for a task
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part, out = batch.slice(low, 256), []
                for name, value, starts in zip(*(part.column(i).to_pylist() for i in range(3))):
                    if name in done:
                        continue
                    done.add(name)
                    h = hashes_of(words_of(value))
                    anchor, segment, first, count = segments(h, window, k)
                    for i in np.flatnonzero(np.isin(first, starts)):
                        out.append((anchor[i].view(np.int64), segment[i].view(np.int64), count[i], h[first[i]:first[i] + count[i] + window - 1].tobytes()))
                if out:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["anchor", "segment", "windows", "words"])

    return rows.mapInArrow(run, "anchor long, segment long, windows long, words binary")


def deep_leaves(texts: list[np.ndarray], window: int) -> list[int]:
    """For each of several word sequences, a mask of the starts whose suffix shares ``window`` words with another suffix.

    The suffixes, cut at ``window`` words, are put in order; neighbours with a common prefix that long hang below one deep internal
    node of the suffix tree, so runs of equal neighbours are its leaves.
    """
    rows = [np.lib.stride_tricks.sliding_window_view(t, window) for t in texts]
    suffixes = np.ascontiguousarray(np.concatenate(rows)).view(f"V{8 * window}").reshape(-1)
    order = np.argsort(suffixes, kind="stable")
    common = suffixes[order[1:]] == suffixes[order[:-1]]
    deep = np.zeros(len(suffixes), dtype=bool)
    deep[order[1:]] |= common
    deep[order[:-1]] |= common
    masks, at = [], 0
    for r in rows:
        masks.append(int((deep[at:at + len(r)] * (1 << np.arange(len(r), dtype=np.int64))).sum()))
        at += len(r)
    return masks


def _trees(contents: DataFrame, window: int) -> DataFrame:
    """``anchor, segment, mask``; rows of an anchor lie together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def grown() -> list[tuple]:
            segs = {s: w for _, s, w in held}
            masks = deep_leaves([np.frombuffer(w, np.uint64) for w in segs.values()], window)
            return [(held[0][0], s, m) for s, m in zip(segs, masks) if m]

        def table(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["anchor", "segment", "mask"])

        out: list[tuple] = []
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if held and held[0][0] != row[0]:
                    out += grown()
                    held = []
                held.append(row)
            if out:
                yield table(out)
                out = []
        if held and (out := grown()):
            yield table(out)

    ordered = contents.select("anchor", "segment", "words").repartition("anchor").sortWithinPartitions("anchor")
    return ordered.mapInArrow(run, "anchor long, segment long, mask long")


def _by_whole_windows(contents: DataFrame, window: int) -> DataFrame:
    """The same for anchors with very many segments: each window is its own prefix, and counts decide."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for anchor, segment, words in zip(*(batch.column(i).to_pylist() for i in range(3))):
                wide = rolling(np.frombuffer(words, np.uint64), window).view(np.int64)
                n = len(wide)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, anchor)), pa.array(np.full(n, segment)), pa.array(wide), pa.array(np.int64(1) << np.arange(n))],
                    names=["anchor", "segment", "wide", "bit"])

    rows = keep(contents.select("anchor", "segment", "words").mapInArrow(run, "anchor long, segment long, wide long, bit long").distinct())
    often = rows.groupBy("anchor", "wide").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return rows.join(often, ["anchor", "wide"]).groupBy("anchor", "segment").agg(F.sum("bit").alias("mask"))


def without_repeats(df: DataFrame, text: str = "text", window: int = WINDOW, k: int = ANCHOR_WORDS) -> DataFrame:
    """Add ``n_words``, ``n_removed`` and ``kept`` (the words left, joined by blanks)."""
    if not 0 < window - k + 1 <= 40:
        raise ValueError("an anchor may serve at most 40 windows")
    df = df.drop("n_words", "n_removed", "kept")
    anchored = keep(_anchored(df, text, window, k))
    # every copy of a text would repeat the same places: the least place stands for a segment's content
    kinds = anchored.groupBy("anchor", "segment").agg(
        F.count(F.lit(1)).alias("_n"), F.min("windows").alias("windows"), F.min("name").alias("name"))
    kinds = keep(kinds)
    anchors = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("_kinds")).filter("_kinds > 1")
    several = keep(kinds.join(anchors, "anchor"))
    whole = kinds.filter("_n > 1").select("anchor", "segment", ((F.call_function("shiftleft", F.lit(1).cast("long"), F.col("windows").cast("int"))) - 1).alias("mask"))

    # where the contents are: the first place of the segment in the text that stands for it
    spots = anchored.join(several.select("anchor", "segment", "name"), ["anchor", "segment", "name"]).groupBy("anchor", "segment", "name").agg(F.min("start").alias("start"))
    contents = keep(_contents(df, text, spots.select("name", "start"), window, k).dropDuplicates(["anchor", "segment"]))
    sizes = several.select("anchor", "_kinds").distinct()
    large = keep(sizes.filter(F.col("_kinds") > GROUP_SEGMENTS).select("anchor"))
    trees = _trees(contents.join(large, "anchor", "left_anti"), window)
    if large.limit(1).count():
        trees = trees.unionByName(_by_whole_windows(contents.join(large, "anchor"), window))
    marked = keep(whole.unionByName(trees).groupBy("anchor", "segment").agg(F.bit_or("mask").alias("mask")))

    found = anchored.join(marked, ["anchor", "segment"]).groupBy("name").agg(
        F.collect_set(F.col("start") * F.lit(1 << 40).cast("long") + F.col("mask")).alias("_marks"))
    found = keep(found)

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.names.index(text)
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                names = pa.array([text_name(words_of(v)) for v in part.column(at).to_pylist()], pa.int64())
                yield pa.RecordBatch.from_arrays([*part.columns, names], names=[*part.schema.names, "_name"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            keepers = [i for i, c in enumerate(names) if c not in ("_name", "_marks")]
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                out = []
                for value, marks in zip(part.column(names.index(text)).to_pylist(), part.column(names.index("_marks")).to_pylist()):
                    words = words_of(value)
                    steps = np.zeros(len(words) + 1, dtype=np.int64)
                    if marks:
                        marks = np.array(marks, dtype=np.int64)
                        start, mask = marks >> 40, marks & ((1 << 40) - 1)
                        for j in range(window - k + 1):
                            hit = start[(mask >> j & 1) == 1] + j
                            np.add.at(steps, hit, 1)
                            np.add.at(steps, hit + window, -1)
                    gone = np.cumsum(steps[:-1]) > 0
                    left = b" ".join([w for w, g in zip(words, gone.tolist()) if not g]).decode("utf-8", "surrogatepass")
                    out.append((len(words), int(gone.sum()), left))
                new = [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.string()))]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in keepers), *new], names=[*(names[i] for i in keepers), "n_words", "n_removed", "kept"])

    rows = df.mapInArrow(named, T.StructType([*df.schema.fields, T.StructField("_name", T.LongType())]))
    marks = found.withColumnRenamed("name", "_name")
    rows = rows.join(marks, "_name", "left").select(*[F.col(f"`{c}`") for c in df.columns], "_marks")
    schema = T.StructType([*df.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())])
    return rows.mapInArrow(cut, schema)


SQL = r"""
WITH w AS (
  SELECT doc_id, row_number() OVER () AS r, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents
), win AS (
  SELECT r, i, array_to_string(ws[i:i + 34], ' ') AS s FROM (SELECT r, ws, unnest(range(1, len(ws) - 33)) AS i FROM w WHERE len(ws) >= 35)
), rep AS (
  SELECT s FROM win GROUP BY s HAVING count(*) > 1
), hit AS (
  SELECT r, i FROM win WHERE s IN (SELECT s FROM rep)
), word AS (
  SELECT r, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS j FROM w
), mark AS (
  SELECT word.r, j, word, max(hit.i) OVER (PARTITION BY word.r ORDER BY j ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone
  FROM word LEFT JOIN hit ON word.r = hit.r AND word.j = hit.i
), k AS (
  SELECT r, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY j) FILTER (NOT gone) AS kept FROM mark GROUP BY r
)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k USING (r)
"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return without_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256"))

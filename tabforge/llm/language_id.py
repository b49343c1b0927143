"""Language identification with error-correcting output codes over character n-grams.

Each learned language gets a codeword of +1 and -1; each column of the code is a two-class problem solved by a naive
Bayes classifier over hashed character trigrams of the lower-cased text (runs of white space as one blank, digits as one
symbol). A text's margin for a bit is the mean log odds of its trigrams, in units of the training texts' margins. Decoding is
loss-weighted: a language costs the sum over bits of log(1 + exp(-SHARPNESS * margin * codeword bit)) times the bit's reliability, its
training accuracy above chance; the cheapest codeword wins. The score is the share of the winner in exp(-cost). A text is
ambiguous when the runner-up costs less than ``AMBIGUOUS`` more.

Training is one distributed count of (language, trigram bucket) over all labelled rows and one pass that measures the bits; the model has
languages x buckets counts at most, whatever the size of the data. Prediction reads whole texts and shuffles nothing.

Defined cases: null texts and texts without a letter are ``und`` with score 0; no labelled rows: everything is ``und``; one language:
it is predicted for every text with a letter; rows with a null or empty language teach nothing; repeated rows count each; an empty
table gives no rows; other columns stay, the added ones (``lang_pred``, ``score``, ``ambiguous``) replace columns of those names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabforge.llm.common import give_back

BUCKET_BITS = 15
BUCKETS = 1 << BUCKET_BITS
SMOOTHING = 0.5
SHARPNESS = 3.0
AMBIGUOUS = 0.5
UNKNOWN = "und"
CHUNK = 1 << 20
_LETTER = regex.compile(r"\p{L}")


def codebook(languages: int) -> np.ndarray:
    """Codewords of +1 and -1, languages x bits.

    Up to six languages: every way to split them in two (2^(L-1) - 1 bits, distance 2^(L-2)). More: the best of fifty random
    codes of 10 log2 L bits, by least distance, from a fixed seed.
    """
    if languages < 2:
        return np.ones((languages, 0), dtype=int)
    if languages <= 6:
        splits = np.arange(1, 1 << (languages - 1))
        return np.array([np.ones(len(splits), dtype=int)] + [1 - 2 * (splits >> k & 1) for k in range(languages - 1)])
    random, best, least = np.random.default_rng(7), None, -1
    for _ in range(50):
        code = random.choice([-1, 1], size=(languages, 10 * int(np.ceil(np.log2(languages)))))
        code = code[:, np.abs(code.sum(axis=0)) < languages]
        distance = min(int((code[i] != code[i + 1:]).sum(axis=1).min()) for i in range(languages - 1))
        if distance > least:
            best, least = code, distance
    return best


def _symbols(text: str) -> np.ndarray:
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    space = np.zeros(len(points), dtype=bool)
    low = points < 128
    space[low] = _SPACE[points[low]]
    points = np.where(space, np.uint32(32), points)
    points = np.where((points >= 48) & (points <= 57), np.uint32(48), points)
    if len(points) > 1:
        points = points[np.concatenate(([True], ~(space[1:] & space[:-1])))]
    return points


_SPACE = np.zeros(128, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def trigrams(text: str) -> np.ndarray:
    """Buckets of the character trigrams of `` text ``."""
    p = np.concatenate(([32], _symbols(text), [32])).astype(np.uint32)
    if len(p) < 3:
        return np.zeros(0, dtype=np.int64)
    h = p[:-2] * np.uint32(0x9E3779B1) + p[1:-1] * np.uint32(0x85EBCA6B) + p[2:] * np.uint32(0xC2B2AE35)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    return (h >> np.uint32(32 - BUCKET_BITS)).astype(np.int64)


def _pieces(text: str) -> Iterator[str]:
    """A long text in parts that share two characters, so that no trigram is lost and memory stays bounded."""
    if len(text) <= CHUNK:
        yield text
        return
    for at in range(0, len(text), CHUNK):
        yield text[max(0, at - 2):at + CHUNK]


@dataclass
class LanguageModel:
    languages: list[str]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # buckets x bits, log odds
    scale: np.ndarray  # bits
    reliability: np.ndarray  # bits

    def margins(self, text: str) -> np.ndarray:
        total, n = np.zeros(self.code.shape[1]), 0
        for piece in _pieces(text):
            grams = trigrams(piece)
            total += self.weights[grams].sum(axis=0, dtype=np.float64)
            n += len(grams)
        return total / max(n, 1)

    def decode(self, margins: np.ndarray) -> tuple[str, float, bool]:
        cost = (np.log1p(np.exp(-SHARPNESS * self.code * (margins / self.scale))) * self.reliability).sum(axis=1)
        order = np.argsort(cost, kind="stable")
        share = np.exp(cost[order[0]] - cost)
        close = len(order) > 1 and cost[order[1]] - cost[order[0]] < AMBIGUOUS
        return self.languages[order[0]], float(1.0 / share.sum()), bool(close)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        if not text or not self.languages or not _LETTER.search(text):
            return UNKNOWN, 0.0, False
        if len(self.languages) == 1:
            return self.languages[0], 1.0, False
        return self.decode(self.margins(text))


def fit(df: DataFrame, text: str = "text", lang: str = "lang") -> LanguageModel:
    """Learn from all rows of ``df`` that have a text and a language."""
    rows = df.select(F.col(lang).alias("lang"), F.col(text).alias("text")).filter("text IS NOT NULL AND lang IS NOT NULL AND lang <> ''")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                part = batch.slice(low, 512)
                for name, value in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    counts = held.setdefault(name, np.zeros(BUCKETS, dtype=np.int64))
                    for piece in _pieces(value):
                        counts += np.bincount(trigrams(piece), minlength=BUCKETS)
        for name, counts in held.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(counts[at])], names=["lang", "bucket", "n"])
        give_back()

    totals = rows.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    table = totals.toPandas()  # at most languages x buckets rows
    languages = sorted(table["lang"].unique())
    code = codebook(len(languages))
    counts = np.zeros((len(languages), BUCKETS))
    counts[[languages.index(x) for x in table["lang"]], table["bucket"].to_numpy(dtype=np.int64)] = table["n"]
    shares = (counts + SMOOTHING) / (counts.sum(axis=1, keepdims=True) + SMOOTHING * BUCKETS)
    bits = code.shape[1]
    weights = np.zeros((BUCKETS, bits), dtype=np.float32)
    for b in range(bits):
        weights[:, b] = np.log(shares[code[:, b] > 0].mean(axis=0)) - np.log(shares[code[:, b] < 0].mean(axis=0))
    # what each language's own trigrams give on average, and how often a trigram is on the right side
    own = (counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)) @ weights
    scale = np.abs(own).mean(axis=0) if bits else np.ones(0)
    scale[scale == 0] = 1.0
    right = np.zeros(bits)
    for k in range(len(languages)):
        share = counts[k] / max(counts[k].sum(), 1)
        right += ((weights * code[k] > 0) * share[:, None]).sum(axis=0) / len(languages)
    return LanguageModel(languages, code, weights, scale, np.clip(2 * right - 1, 0.05, 1.0))


def predict(df: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """Add ``lang_pred``, ``score`` and ``ambiguous``."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # languages x buckets numbers at most

    added = {"lang_pred": pa.string(), "score": pa.float64(), "ambiguous": pa.bool_()}
    df = df.drop(*added)

    def guess(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            at = batch.schema.names.index(text)
            for low in range(0, batch.num_rows, 512):
                part = batch.slice(low, 512)
                found = list(zip(*[own.predict(t) for t in part.column(at).to_pylist()]))
                new = [pa.array(c, kind) for c, kind in zip(found, added.values())]
                yield pa.RecordBatch.from_arrays([*part.columns, *new], names=[*part.schema.names, *added])
        give_back()

    kinds = (T.StringType(), T.DoubleType(), T.BooleanType())
    return df.mapInArrow(guess, T.StructType([*df.schema.fields, *[T.StructField(a, t) for a, t in zip(added, kinds)]]))


def held_out(key: Column, folds: int = 5) -> Column:
    """A row whose key's CRC-32 leaves no remainder; a null key counts as empty text."""
    return F.crc32(F.encode(F.coalesce(key.cast("string"), F.lit("")), "UTF-8")) % folds == 0


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang").withColumn("held_out", held_out(F.col("doc_id")))
    model = fit(docs.filter(~F.col("held_out")))
    return predict(docs.select("doc_id", "text", "held_out"), model).select("doc_id", "held_out", "lang_pred", "score", "ambiguous")

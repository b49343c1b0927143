"""Byte-level BPE encoding and decoding as a monoid tree reduction.

Encoding a piece (one match of the split pattern) of more than ``LEAF`` bytes encodes its halves and joins them. Two neighbouring
tokens are *stable* when their joined bytes encode to just those two tokens; a sequence is the encoding of its bytes exactly when
every neighbouring pair is stable. So a join looks at the seam only: if the pair there is stable the halves are concatenated,
otherwise a window of tokens around it is encoded again, and grows until the pairs at its outer edges are stable. Tokens outside are then proven.

Texts are split by halves too: only the last match of a left half, and those that end fewer than ``LOOKAHEAD`` characters before it ends, can
depend on what follows, so matching starts again there and goes on until it meets a border of the right half. Decoding concatenates the bytes of the halves up the tree.

Pieces repeat, so each worker remembers up to ``CACHE`` encodings; the vocabulary, whose size is fixed, is the only broadcast.

Defined cases: null texts are empty and have no ids; null ids decode to no bytes; an id outside the vocabulary is an error; special tokens are
ordinary text; repeated rows, other columns and empty tables need nothing special (the added column replaces one of its name).
"""

from __future__ import annotations

import base64
import functools
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabforge.llm.common import give_back

LEAF = 24
TEXT_LEAF = 1 << 17
# A split pattern looks at most so many characters past the end of a match (contractions such as "'ll" are the longest).
LOOKAHEAD = 4
CACHE = 300_000
SLICE = 256


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: base64 token and rank per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class _Pieces(dict):
    """Packed ids of pieces. At ``CACHE`` entries the older half goes; pieces in use are carried over."""

    def __init__(self, codec: Codec):
        super().__init__()
        self.codec, self.older = codec, {}

    def forget(self) -> None:
        self.clear()
        self.older = {}

    def __missing__(self, piece: str) -> bytes:
        packed = self.older.get(piece)
        if packed is None:
            packed = np.array(self.codec.encode_piece(piece.encode()), dtype="<u4").tobytes()
        if len(piece) <= 64:
            if len(self) >= CACHE // 2:
                self.older = dict(self)
                self.clear()
            self[piece] = packed
        return packed


class Codec:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.pattern = regex.compile(pattern)
        self.tokens: list[bytes | None] = [None] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.pieces = _Pieces(self)
        self.stable = functools.lru_cache(1 << 16)(self._stable)

    # one piece

    def encode_piece(self, data: bytes) -> list[int]:
        whole = self.ranks.get(data)
        return [whole] if whole is not None else self._tree(data)

    def _tree(self, data: bytes) -> list[int]:
        if len(data) <= LEAF:
            return self._merge(data)
        middle = len(data) // 2
        return self._join(self._tree(data[:middle]), self._tree(data[middle:]))

    def _stable(self, a: int, b: int) -> bool:
        return self._merge(self.tokens[a] + self.tokens[b]) == [a, b]

    def _join(self, left: list[int], right: list[int]) -> list[int]:
        if not left or not right or self.stable(left[-1], right[0]):
            return left + right
        width = 1
        while True:
            i, j = max(0, len(left) - width), min(len(right), width)
            middle = self._merge(b"".join(self.tokens[t] for t in left[i:] + right[:j]))
            before = i == 0 or self.stable(left[i - 1], middle[0])
            after = j == len(right) or self.stable(middle[-1], right[j])
            if before and after:
                return left[:i] + middle + right[j:]
            width *= 2

    def _merge(self, data: bytes) -> list[int]:
        """Merge the pair of lowest rank, the leftmost of equals, until no pair is a token."""
        if len(data) > 96:
            return self._merge_long(data)
        ranks = self.ranks
        parts = [data[i:i + 1] for i in range(len(data))]
        pairs = [ranks.get(parts[i] + parts[i + 1], _NONE) for i in range(len(parts) - 1)]
        while pairs:
            best = min(pairs)
            if best == _NONE:
                break
            i = pairs.index(best)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i:
                pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], _NONE)
            if i < len(pairs):
                pairs[i] = ranks.get(parts[i] + parts[i + 1], _NONE)
        return [ranks[p] for p in parts]

    def _merge_long(self, data: bytes) -> list[int]:
        """The same with a heap over a linked list, for windows that had to grow."""
        n, ranks = len(data), self.ranks
        end, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = []

        def offer(i: int) -> None:
            j = end[i]
            if j < n and (rank := ranks.get(data[i:end[j]])) is not None:
                heapq.heappush(heap, (rank, i, j, end[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, j, k = heapq.heappop(heap)
            if not alive[i] or end[i] != j or not alive[j] or end[j] != k:
                continue
            alive[j] = False
            end[i] = k
            if k < n:
                before[k] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        out, i = [], 0
        while i < n:
            out.append(ranks[data[i:end[i]]])
            i = end[i]
        return out

    # whole texts

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if len(text) <= TEXT_LEAF:
            return b"".join(map(self.pieces.__getitem__, self.pattern.findall(text)))
        return b"".join(packed for _, packed in self._halves(text, 0, len(text)))

    def _halves(self, text: str, start: int, end: int) -> list[tuple[int, bytes]]:
        """(where it starts, ids) of each match in a part of the text."""
        if end - start <= TEXT_LEAF:
            return [(m.start(), self.pieces[m.group()]) for m in self.pattern.finditer(text, start, end)]
        middle = (start + end) // 2
        left, right = self._halves(text, start, middle), self._halves(text, middle, end)
        at = left.pop()[0]
        while left and at > middle - LOOKAHEAD:
            at = left.pop()[0]
        borders = {s: i for i, (s, _) in enumerate(right)}
        while at < end and at not in borders:
            m = self.pattern.match(text, at, end)
            left.append((at, self.pieces[m.group()]))
            at = m.end()
        return left + (right[borders[at]:] if at < end else [])

    def decode(self, ids: bytes | None) -> bytes:
        if not ids:
            return b""
        tokens = self.tokens

        def part(numbers: list[int]) -> bytes:
            if len(numbers) <= 1 << 12:
                return b"".join([tokens[t] for t in numbers])
            middle = len(numbers) // 2
            return part(numbers[:middle]) + part(numbers[middle:])

        return part(np.frombuffer(ids, dtype="<u4").tolist())


_NONE = 1 << 62
_codecs: dict[tuple, Codec] = {}


def _codec(shared, key: tuple) -> Codec:
    """This worker's codec, built once."""
    if key not in _codecs:
        ranks, pattern = shared.value
        _codecs[key] = Codec(ranks, pattern)
    return _codecs[key]


class ByteBpe:
    """Encoding and decoding with one vocabulary. ``ranks_path`` and ``pattern`` are read on the driver and broadcast."""

    def __init__(self, spark: SparkSession, ranks_path: str, pattern: str):
        self._shared = spark.sparkContext.broadcast((read_ranks(ranks_path), pattern))
        self._key = (spark.sparkContext.applicationId, ranks_path, pattern)

    def _mapped(self, df: DataFrame, column: str, added: list[str], work) -> DataFrame:
        """Add binary columns: ``work(codec, value)`` gives one value for each. Batches go in slices, so outputs stay small."""
        shared, key = self._shared, self._key
        df = df.drop(*added)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            codec = _codec(shared, key)
            for batch in batches:
                for at in range(0, batch.num_rows, SLICE):
                    part = batch.slice(at, SLICE)
                    rows = [work(codec, v) for v in part.column(column).to_pylist()]
                    new = [pa.array([r[i] for r in rows], type=pa.binary()) for i in range(len(added))]
                    yield pa.RecordBatch.from_arrays([*part.columns, *new], names=[*part.schema.names, *added])
            codec.pieces.forget()
            give_back()

        return df.mapInArrow(run, T.StructType([*df.schema.fields, *[T.StructField(a, T.BinaryType()) for a in added]]))

    def encode(self, df: DataFrame, text: str = "text", ids: str = "ids") -> DataFrame:
        """Add packed token ids (little-endian unsigned 32-bit integers)."""
        return self._mapped(df, text, [ids], lambda codec, value: (codec.encode(value),))

    def decode(self, df: DataFrame, ids: str = "ids", out: str = "decoded") -> DataFrame:
        """Add the bytes that packed ids stand for."""
        return self._mapped(df, ids, [out], lambda codec, value: (codec.decode(value),))

    def round_trip(self, df: DataFrame, text: str = "text", ids: str = "ids", out: str = "decoded") -> DataFrame:
        """Encode and decode in one pass."""

        def both(codec: Codec, value: str | None) -> tuple[bytes, bytes]:
            packed = codec.encode(value)
            return packed, codec.decode(packed)

        return self._mapped(df, text, [ids, out], both)


def token_count(ids: Column) -> Column:
    return (F.octet_length(ids) / 4).cast("long")


def encoded(df: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """``df`` with ``ids`` and ``decoded``."""
    return ByteBpe(df.sparkSession, ranks_path, pattern).round_trip(df)


def digests(df: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    out = encoded(df.select("doc_id", "text"), ranks_path, pattern)
    return out.select(
        "doc_id", token_count(F.col("ids")).alias("n_tokens"), F.sha2(F.col("ids"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)

"""Secret scan: fixed patterns plus assignment-aware lexing.

Base spans come from three patterns. The lexer adds more: it reads source and configuration syntax (``name = "literal"``,
``"name": "literal"``, ``name: literal``, ``NAME=literal``, ``name := 'x'``, ``key => 'x'``) into name-value pairs, adds up literals joined by ``+``,
carries constants forward (a name that holds literals, assigned to another name), and scores each literal by the most sensitive
name that it reaches and by how much it looks like a key. A bare value that names no constant held so far is itself a literal
(``NAME=literal``), unless it is the target of the next pair (``a = b = 'x'``). Literals that reach ``threshold`` are spans of kind ``literal``.

A text without any sensitive name can give no such literal, so only texts with one are lexed; the test before the lexer takes every spelling that
``sensitivity`` takes (``api_key``, ``api-key``, ``api.key``, ``apiKey``). Literals and keys may have any length. Rows are scanned where they
are; nothing is shuffled.

Spans are ``(kind, start, end, base, score)`` in code points, end exclusive, ordered by start, then kind as listed.

Defined cases: null and empty texts have no spans; repeated rows repeat their spans; an empty table gives no rows; other columns stay, the added
``spans`` replaces one of its name.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabforge.llm.common import give_back

KINDS = ("assign", "access", "hex", "literal")
SPANS = "array<struct<kind:string,start:int,end:int,base:boolean,score:double>>"

# The base patterns and the least lengths of their matches.
ASSIGN = re.compile(r"(?P<name>password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?(?P<value>[A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
ASSIGN_CHARS, ACCESS_CHARS = 6, 20

# Weights of words in a target name, and words of literals that stand for a secret without being one.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.8, "secret": 1.0, "token": 0.9, "apikey": 1.0, "api_key": 1.0, "credential": 0.8,
    "private_key": 1.0, "privatekey": 1.0, "access_key": 1.0, "accesskey": 1.0, "auth_key": 0.9, "authkey": 0.9, "signing_key": 0.9,
    "encryption_key": 0.9, "bearer": 0.7,
}
PLACEHOLDERS = ("example", "changeme", "placeholder", "your_", "your-", "xxxx", "dummy", "<", "${", "{{", "none", "null", "true", "false")
_WORDS = re.compile("|".join(sorted(map(re.escape, SENSITIVE), key=len, reverse=True)))
# For lower-cased texts: what ``sensitivity`` turns into an underscore, or puts one into, may stand between the words.
_GATE = re.compile("|".join(sorted({re.escape(w).replace("_", "[_.-]?") for w in SENSITIVE})))

_NAME = r"[A-Za-z_$][\w$]*+(?:[.\-][A-Za-z_$][\w$]*+)*+"
_STRING = r"\"(?:[^\"\\\n]++|\\.)*+\"|'(?:[^'\\\n]++|\\.)*+'"
_PAIR = re.compile(rf"(?:(?P<quoted>[\"'])(?P<key>[\w.$-]++)(?P=quoted)|(?<![\w$])(?P<name>{_NAME}))(?:\[[^\]\n]*+\])?[ \t]*(?P<sign>:=|=>|==?|:)[ \t]*", re.A)
_TERM = re.compile(rf"(?P<string>{_STRING})|(?P<bare>[^\s\"',;(){{}}\[\]<>#&|]+)", re.A)
_PLUS = re.compile(r"[ \t]*\+[ \t]*(?:\\?\n[ \t]*)?")
_IS_NAME = re.compile(rf"{_NAME}\Z", re.A)


def sensitivity(name: str) -> float:
    plain = re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name).lower().replace("-", "_").replace(".", "_")
    return max((SENSITIVE[w] for w in _WORDS.findall(plain)), default=0.0)


def key_likeness(literal: str) -> float:
    """0 to 1: long, varied, mixed literals look like keys; blanks and stand-ins do not."""
    low = literal.lower()
    if len(literal) < 6 or any(p in low for p in PLACEHOLDERS) or any(c.isspace() for c in literal):
        return 0.0
    counts = Counter(literal)
    bits = -sum(c / len(literal) * math.log2(c / len(literal)) for c in counts.values())
    kinds = sum(any(test(c) for c in literal) for test in (str.islower, str.isupper, str.isdigit, lambda c: not c.isalnum()))
    return min(1.0, 0.2 + bits / 6 + 0.1 * (kinds - 1))


def assignments(text: str) -> Iterator[tuple[str, list[tuple[str, int, int]], list[tuple[str, int, int]]]]:
    """Name, its literals and the bare words that can be names or literals, both with their places, for every assignment in order."""
    at = 0
    while m := _PAIR.search(text, at):
        name, sign = m["key"] or m["name"], m["sign"]
        at = m.end()
        if sign == "==":
            continue
        literals, names, here = [], [], m.end()
        while term := _TERM.match(text, here):
            here = term.end()
            if term["string"]:
                literals.append((term["string"][1:-1], term.start() + 1, term.end() - 1))
            elif _IS_NAME.match(term["bare"]) and sign != ":":
                names.append((term["bare"], term.start(), term.end()))
            else:
                bare = term["bare"].rstrip(".:")
                literals.append((bare, term.start(), term.start() + len(bare)))
            plus = _PLUS.match(text, here)
            if not plus:
                break
            here = plus.end()
        yield name, literals, names
        # a bare name may itself be the target of the next pair ("a = b = 'x'")
        at = here if literals and not names else max(at, m.end())


def lexed(text: str, threshold: float) -> list[tuple[str, int, int, bool, float]]:
    held: dict[str, list[tuple[str, int, int]]] = {}
    best: dict[tuple[int, int], float] = {}
    for name, literals, names in assignments(text):
        reached = list(literals)
        for bare in names:
            if constant := held.get(bare[0]):
                reached += constant
            elif not ((after := _PAIR.match(text, bare[1])) and after["sign"] in ("=", ":=", "=>")):
                reached.append(bare)
        held[name] = list(dict.fromkeys(reached))  # each place once: "a = a + a" does not grow
        weight = sensitivity(name)
        if weight:
            value = "".join(x[0] for x in reached)
            score = weight * key_likeness(value)
            for literal, start, end in reached:
                if literal:
                    best[start, end] = max(best.get((start, end), 0.0), score)
    return [("literal", s, e, False, v) for (s, e), v in best.items() if v >= threshold]


def scan(text: str | None, threshold: float = 0.6) -> list[tuple[str, int, int, bool, float]]:
    if not text:
        return []
    found = []
    if _GATE.search(low := text.lower()):
        if ":" in low or "=" in low:
            found += [("assign", m.start(), m.end(), True, 1.0) for m in ASSIGN.finditer(text) if m.end("value") - m.start("value") >= ASSIGN_CHARS]
            found += lexed(text, threshold)
    if "AKIA" in text:
        found += [("access", m.start(), m.end(), True, 1.0) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_CHARS]
    found += [("hex", m.start(), m.end(), True, 1.0) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def find_secrets(df: DataFrame, text: str = "text", threshold: float = 0.6) -> DataFrame:
    """Add ``spans``."""

    @F.pandas_udf(SPANS)
    def spans(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        names = ("kind", "start", "end", "base", "score")
        for texts in batches:
            yield pd.Series([[dict(zip(names, s)) for s in scan(t, threshold)] for t in texts], dtype=object)

    return df.withColumn("spans", spans(F.col(text)))


def redact(df: DataFrame, text: str = "text", mark: str = "[SECRET]", threshold: float = 0.6) -> DataFrame:
    """Replace every found span (overlapping ones as one) by ``mark``."""

    def cut(value: str | None) -> str | None:
        out, at = [], 0
        for _, start, end, _, _ in scan(value, threshold):
            if start >= at:
                out += [value[at:start], mark]
            at = max(at, end)
        return "".join(out) + value[at:] if out else value

    at = df.columns.index(text)

    def redacted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 512):  # few texts at a time
                part = batch.slice(low, 512)
                columns = list(part.columns)
                columns[at] = pa.array([cut(t) for t in columns[at].to_pylist()], columns[at].type)
                yield pa.RecordBatch.from_arrays(columns, names=part.schema.names)
        give_back()

    return df.mapInArrow(redacted, df.schema)


def span_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_secrets(docs).select("doc_id", "spans")
    number = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["base"])
    return found.select(
        "doc_id", number("assign").alias("n_assign"), number("access").alias("n_access"), number("hex").alias("n_hex"),
        F.sha2(span_text(base), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"))

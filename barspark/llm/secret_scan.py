"""Secrets in texts: keyword automaton, expressions anchored at its hits, and checksums inside tokens.

An Aho-Corasick automaton finds the keywords in one pass; only there the anchored expressions run. Runs of
hexadecimal digits have no keyword and are found by their length. Tokens that embed a CRC-32 (``github``,
``npm``) are reported only if it is right.

Nulls and empty texts have no secrets. Every input row gives one output row, repeated or not. A span never
overlaps another of its kind; spans of different kinds may overlap.
"""

from __future__ import annotations

import re
import zlib
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ascii_lower, map_arrow, with_text_last

#: The kinds in their order, the keywords, and the formats.
BASE_KINDS = ["assign", "access", "hex"]
CHECKED_KINDS = ["github", "npm"]
KINDS = BASE_KINDS + CHECKED_KINDS
ASSIGN_WORDS = ["password", "passwd", "secret", "token", "apikey", "api_key"]
GITHUB_WORDS = ["ghp_", "gho_", "ghu_", "ghs_", "ghr_"]
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
GITHUB = re.compile(r"gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
NPM = re.compile(r"npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
LEAST_VALUE, LEAST_ACCESS = 12, 18

SPANS = T.ArrayType(
    T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
)


@cache
def _automaton() -> ahocorasick.Automaton:
    automaton = ahocorasick.Automaton()
    for kind, words in (("assign", ASSIGN_WORDS), ("access", ["akia"]), ("github", GITHUB_WORDS), ("npm", ["npm_"])):
        for word in words:
            automaton.add_word(word, (kind, len(word)))
    automaton.make_automaton()
    return automaton


def checksum(body: str) -> str:
    """The six characters that end a token: the CRC-32 of its body in base 62."""
    value, digits = zlib.crc32(body.encode()), ""
    while value:
        value, digit = divmod(value, 62)
        digits = BASE62[digit] + digits
    return digits.rjust(6, "0")


def find(text: str | None) -> list[tuple[int, int, int]]:
    """``(start, index of the kind, end)`` of every secret, sorted."""
    if not text:
        return []
    found = [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    hits: dict[str, list[int]] = {}
    for last, (kind, length) in _automaton().iter(ascii_lower(text)):
        hits.setdefault(kind, []).append(last + 1 - length)
    free = 0
    for start in sorted(hits.get("assign", ())):
        if start >= free and (m := ASSIGN.match(text, start)):
            free = m.end()
            if len(m[2]) >= LEAST_VALUE:
                found.append((start, 0, free))
    free = 0
    for start in hits.get("access", ()):
        if start >= free and (m := ACCESS.match(text, start)):
            free = m.end()
            if free - start >= LEAST_ACCESS:
                found.append((start, 1, free))
    for k, (kind, form) in enumerate((("github", GITHUB), ("npm", NPM)), len(BASE_KINDS)):
        for start in hits.get(kind, ()):
            if (m := form.match(text, start)) and checksum(m[1]) == m[2]:
                found.append((start, k, m.end()))
    return sorted(found)


def _span_array(found: list[list[tuple[int, int, int]]]) -> list[list[dict]]:
    return [[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in spans] for spans in found]


def scan(df: DataFrame, text: str = "text", keep: list[str] | None = None, out: str = "secrets") -> DataFrame:
    """Add ``out``, the spans of all secrets in code points (end exclusive), to the columns in ``keep`` (all)."""
    keep = [c for c in (df.columns if keep is None else keep) if c != out]

    def run(batch: pa.RecordBatch):
        texts = batch.column(batch.num_columns - 1).to_pylist()
        yield {c: batch.column(i) for i, c in enumerate(keep)} | {out: _span_array([find(t) for t in texts])}

    wanted = with_text_last(df, keep, text)
    schema = T.StructType([*wanted.schema.fields[:-1], T.StructField(out, SPANS)])
    return map_arrow(wanted, run, schema)


def redact(df: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """Replace the secrets of ``text``; overlapping spans become one mark. Nulls stay null."""
    columns = df.columns
    place = columns.index(text)

    def clean(value: str | None) -> str | None:
        spans, out, free = find(value), [], 0
        if not spans:
            return value
        merged = [list(spans[0][::2])]
        for start, _, end in spans[1:]:
            if start < merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], end)
            else:
                merged.append([start, end])
        for start, end in merged:
            out += [value[free:start], mark]
            free = end
        return "".join([*out, value[free:]])

    def run(batch: pa.RecordBatch):
        yield {c: batch.column(i) for i, c in enumerate(columns)} | {
            text: [clean(t) for t in batch.column(place).to_pylist()]
        }

    return map_arrow(df, run, df.schema)


def of_kinds(spans, kinds: list[str]):
    return F.filter(spans, lambda s: s["kind"].isin(*kinds))


def joined(spans):
    """``kind:start:end`` of the spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(df: DataFrame) -> DataFrame:
    """The result columns of the registered query, from ``doc_id`` and ``secrets``."""
    spans = F.col("secrets")
    counts = [F.size(of_kinds(spans, [k])).cast("long").alias(f"n_{k}") for k in BASE_KINDS]
    base = joined(of_kinds(spans, BASE_KINDS)).cast("binary")
    return df.select("doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), joined(spans).alias("spans"))

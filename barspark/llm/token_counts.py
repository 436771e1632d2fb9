"""Token counts by byte-pair merging, without the ids.

A text is parted at the added tokens of the vocabulary, then into the pieces of the byte-level pattern. Each piece is a
linked list of symbols, one for each byte; a heap holds the adjacent pairs that have a rank. The pair of lowest rank,
leftmost first, is popped and merged until the heap is empty, and the count is that of the initial symbols less the
merges. Words repeat, so that workers remember the counts of short chunks in a cache of bounded size.

Rows stay where they are: nothing is shuffled, and the merge ranks are read from the vocabulary file by each worker.

Null and empty texts have no bytes and no tokens, an empty table gives no rows, and repeated rows and null ids are
counted like any other. Long texts are counted whole, a window of ``WINDOW`` characters at a time where white space
allows. Columns of ``df`` that have the name of a result are replaced by it.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_arrow, with_text_last
from .tokens import BETWEEN_WORDS, NEXT_TO_SPACE

#: The byte-level pattern of the vocabulary's kind (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Below this code point the ``regex`` module and the library agree on letters, numbers and spaces; beyond it some are
#: newer than the library's tables, and its own pre-tokenizer finds the pieces.
AGREED = "\u0530"
#: Characters that are looked at together; chunks in a generation of the cache, and the longest one it holds.
WINDOW, CACHED, CACHED_CHARS = 1_000_000, 400_000, 200
PLACE = 32
PLACE_MASK = (1 << PLACE) - 1


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones themselves, others from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    of = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}
    return [of[b] for b in range(256)]


class Counter:
    """Counts tokens as the ``tokenizers`` library would find them, for byte-level BPE vocabularies in its format."""

    def __init__(self, path: str, cached: int = CACHED) -> None:
        import regex

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, before, added = spec["model"], spec.get("pre_tokenizer") or {}, spec.get("added_tokens") or []
        plain = (
            model.get("type") == "BPE" and before.get("type") == "ByteLevel" and before.get("use_regex", True)
            and not before.get("add_prefix_space") and not spec.get("normalizer")
            and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
            and not any(t.get(k) for t in added for k in ("single_word", "lstrip", "rstrip", "normalized"))
        )
        vocabulary = model.get("vocab") or {}
        letters = byte_letters()
        if not plain or not all(c in vocabulary for c in letters):
            raise ValueError(f"{path} is no plain byte-level BPE vocabulary")
        self.first = [vocabulary[c] for c in letters]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        #: Rank of a pair of symbols, and the symbol that each rank's merge makes.
        self.ranks = {(vocabulary[a] << PLACE) | vocabulary[b]: r for r, (a, b) in enumerate(pairs)}
        self.made = [vocabulary[a + b] for a, b in pairs]
        contents = sorted((t["content"] for t in added), key=len, reverse=True)
        self.added = re.compile("|".join(map(re.escape, contents))) if contents else None
        self.pattern = regex.compile(PATTERN)
        self.path, self.splitter = path, None
        self.cached = cached
        self.known: dict[str | tuple[str], int] = {}
        self.old: dict[str | tuple[str], int] = {}

    def merged(self, piece: bytes) -> int:
        """Tokens of one piece: its bytes less the merges."""
        n = len(piece)
        if n < 2:
            return n
        ranks, made = self.ranks, self.made
        symbol = [self.first[b] for b in piece]
        heap = [
            (r << PLACE) | i
            for i, (a, b) in enumerate(zip(symbol, symbol[1:]))
            if (r := ranks.get((a << PLACE) | b)) is not None
        ]
        if not heap:
            return n
        heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        merges = 0
        while heap:
            top = heappop(heap)
            i, r = top & PLACE_MASK, top >> PLACE
            j = after[i]
            # a pair that has changed since it was pushed has another rank, or none
            if j >= n or symbol[i] < 0 or ranks.get((symbol[i] << PLACE) | symbol[j]) != r:
                continue
            merges += 1
            new = symbol[i] = made[r]
            symbol[j] = -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (s := ranks.get((new << PLACE) | symbol[k])) is not None:
                    heappush(heap, (s << PLACE) | i)
            h = before[i]
            if h >= 0 and (s := ranks.get((symbol[h] << PLACE) | new)) is not None:
                heappush(heap, (s << PLACE) | h)
        return n - merges

    def pieces(self, chunk: str) -> Iterator[str]:
        if chunk.isascii() or max(chunk) < AGREED:
            return (m[0] for m in self.pattern.finditer(chunk))
        if self.splitter is None:
            from tokenizers import Tokenizer

            self.splitter = Tokenizer.from_file(self.path).pre_tokenizer
        return (chunk[a:b] for _, (a, b) in self.splitter.pre_tokenize_str(chunk))

    def _remember(self, key: str | tuple[str], count: int) -> int:
        if len(self.known) >= self.cached:
            self.old, self.known = self.known, {}
        self.known[key] = count
        return count

    def _learn(self, key: str | tuple[str]) -> int:
        """The count of a chunk that the young generation does not hold."""
        count = self.old.get(key)
        if count is not None:
            return self._remember(key, count)
        chunk = " " + key if type(key) is str else key[0]
        total = 0
        for piece in self.pieces(chunk):
            own = piece[1:] if piece[0] == " " and len(piece) > 1 else (piece,)
            count = self.known.get(own)
            if count is None:
                count = self.old.get(own)
            if count is None:
                count = self.merged(piece.encode())
                if len(piece) <= CACHED_CHARS:
                    self._remember(own, count)
            total += count
        return self._remember(key, total) if len(chunk) <= CACHED_CHARS else total

    @staticmethod
    def windows(text: str) -> Iterator[str]:
        """Parts of about ``WINDOW`` characters; each later one begins with a single space between two words."""
        begin = 0
        while len(text) - begin > WINDOW:
            cut = BETWEEN_WORDS.search(text, begin + WINDOW)
            if cut is None:
                break
            yield text[begin : cut.start()]
            begin = cut.start()
        yield text[begin:] if begin else text

    def _plain(self, text: str) -> int:
        """Tokens of a text without added tokens."""
        total = 0
        for window in self.windows(text):
            if not window:
                continue
            if NEXT_TO_SPACE.search(window):
                chunks = BETWEEN_WORDS.split(window)
                keys: list[str | tuple[str]] = [c[1:] for c in chunks]
                keys[0] = (chunks[0],)
            else:
                keys = window.split(" ")
                if keys[0]:
                    keys[0] = (keys[0],)  # not preceded by a space
                else:
                    del keys[0]
            known, learn = self.known, self._learn
            for key in keys:
                count = known.get(key)
                if count is None:
                    count = learn(key)
                    known = self.known
                total += count
        return total

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self.added is None:
            return self._plain(text)
        parts = self.added.split(text) if self.added.search(text) else [text]
        return len(parts) - 1 + sum(map(self._plain, filter(None, parts)))


@lru_cache(maxsize=2)
def counter(path: str, cached: int = CACHED) -> Counter:
    return Counter(path, cached)


def count_tokens(
    df: DataFrame, path: str, text: str = "text", keep: list[str] | None = None, limit: int | None = None,
    cached: int = CACHED,
) -> DataFrame:
    """Add ``n_bytes``, ``n_tokens`` and, with a ``limit``, ``over_limit`` to the columns in ``keep`` (all).

    ``path`` names the vocabulary, a file that every worker can read.
    """
    results = ["n_bytes", "n_tokens"] + ["over_limit"] * (limit is not None)
    keep = [c for c in (df.columns if keep is None else keep) if c not in results]

    def run(batch: pa.RecordBatch):
        tokens = counter(path, cached)
        column = batch.column(batch.num_columns - 1)
        texts = chain.from_iterable(column.slice(a, 512).to_pylist() for a in range(0, len(column), 512))
        lengths = pc.binary_length(column).fill_null(0).cast(pa.int64())
        counts = [tokens.count(t) for t in texts]
        out = {c: batch.column(i) for i, c in enumerate(keep)} | {"n_bytes": lengths, "n_tokens": counts}
        yield out | ({} if limit is None else {"over_limit": [n > limit for n in counts]})

    source = with_text_last(df, keep, text)
    kinds = {"n_bytes": T.LongType(), "n_tokens": T.LongType(), "over_limit": T.BooleanType()}
    schema = T.StructType([*source.schema.fields[:-1], *[T.StructField(c, kinds[c]) for c in results]])
    return map_arrow(source, run, schema)


def totals(counted: DataFrame, by: list[str]) -> DataFrame:
    """``n_docs``, ``n_tokens`` and ``n_over`` (if counted with a limit) of each group, summed before the shuffle."""
    sums = [F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")]
    if "over_limit" in counted.columns:
        sums.append(F.sum(F.col("over_limit").cast("long")).alias("n_over"))
    return counted.groupBy(*by).agg(*sums)

"""Language of texts and of spans in mixed texts: script ranges, word scores, and Viterbi with a switching penalty.

A model holds, by language, the log-probability of hashed character n-grams (1 to ``LONGEST``, word borders included)
and the scripts in use. A word is a run of letters. Its script leaves only the languages that use that script as
candidates, and its score for each is the sum over its n-grams. Viterbi over the words of a text, with ``PENALTY`` for
each change of language, labels every word; the language with most letters is the text's, and its share of the
letters the score.

The fit takes whole texts of at most about ``sample`` documents of each language, chosen by a hash of the id: that is
its documented bound. Counts are summed by Spark and only the table of n-gram buckets comes to the driver, at most
``BUCKETS`` entries for each language. A model holds 0.26 MB for a language; with more than ``LANGUAGES`` of them fewer
texts are scored at a time.

Null texts and texts without a letter are ``und`` with score 0. Without any labelled row all texts are. Ties go to the
language that sorts first. Every input row gives one output row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_arrow, text_slices, with_text_last
from .shingles import GOLD, mix

BITS = 16
BUCKETS = 1 << BITS
LONGEST = 4
LANGUAGES = 256
PENALTY = 8.0
#: Weight of the n-gram sum: its terms overlap.
WEIGHT = 0.5
UNKNOWN = "und"
#: Characters of text that are scored at a time, unless one text is longer.
SLICE = 1_000_000

#: First and last code points of scripts; all else is "other".
SCRIPT_RANGES = [
    ("latin", 0x0041, 0x024F), ("latin", 0x1E00, 0x1EFF), ("greek", 0x0370, 0x03FF), ("cyrillic", 0x0400, 0x052F),
    ("armenian", 0x0530, 0x058F), ("hebrew", 0x0590, 0x05FF), ("arabic", 0x0600, 0x077F),
    ("devanagari", 0x0900, 0x097F), ("bengali", 0x0980, 0x09FF), ("gurmukhi", 0x0A00, 0x0A7F),
    ("gujarati", 0x0A80, 0x0AFF), ("tamil", 0x0B80, 0x0BFF), ("telugu", 0x0C00, 0x0C7F), ("kannada", 0x0C80, 0x0CFF),
    ("malayalam", 0x0D00, 0x0D7F), ("thai", 0x0E00, 0x0E7F), ("georgian", 0x10A0, 0x10FF), ("ethiopic", 0x1200, 0x137F),
    ("hangul", 0x1100, 0x11FF), ("hangul", 0xAC00, 0xD7AF), ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x9FFF),
]
SCRIPTS = list(dict.fromkeys(["other", *(s for s, _, _ in SCRIPT_RANGES)]))
#: The share of a language's letters from which a script counts as used.
USED = 0.005


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the first 65,536 code points: lower case (where it is one code point), letter or not, script."""
    chars = [chr(c) for c in range(0x10000)]
    lower = np.array([ord(x.lower()) if len(x.lower()) == 1 else c for c, x in enumerate(chars)], np.uint32)
    letter = np.array([x.isalpha() for x in chars])
    script = np.zeros(0x10000, np.uint8)
    for name, first, last in SCRIPT_RANGES:
        script[first : last + 1] = SCRIPTS.index(name)
    return lower, letter, script


LOWER, LETTER, SCRIPT = _tables()


class Words:
    """The words of some texts: starts, ends and text numbers, n-gram buckets by position, scripts."""

    def __init__(self, texts: list[str]) -> None:
        joined = "\n".join(texts)
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.array([len(t) + 1 for t in texts])
        low = np.minimum(codes, 0xFFFF)
        letter, codes_lower = LETTER[low], np.where(codes < 0x10000, LOWER[low], codes)
        for c in np.unique(codes[codes >= 0x10000]).tolist():
            letter[codes == c] = chr(c).isalpha()
        edges = np.flatnonzero(np.diff(np.concatenate(([False], letter, [False])).astype(np.int8)))
        self.starts, self.ends = edges[::2], edges[1::2]
        self.begins = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        self.text = np.searchsorted(self.begins, self.starts, "right") - 1
        self.lengths = self.ends - self.starts
        self.scripts = SCRIPT[low[self.starts]]
        # letters of all words, each word followed by one border
        n = len(self.starts)
        self.at = np.concatenate(([0], np.cumsum(self.lengths + 1)))  # where each word begins in ``symbols``
        symbols = np.zeros(int(self.at[-1]) + 1, np.uint64)  # a border first, too
        keep = np.repeat(np.arange(n), self.lengths)
        symbols[1 + np.arange(len(keep)) + keep] = codes_lower[letter]
        self.symbols = symbols
        self.buckets = []
        value = np.zeros(len(symbols), np.uint64)
        for k in range(LONGEST):
            # n-grams of k + 1 symbols that begin at each position; words are never joined, as borders end them
            if k:
                ok = ok[:-1] & ((symbols[k:] != 0) | (symbols[k - 1 : -1] != 0)) & ((symbols[k - 1 : -1] != 0) | (k == 1))
            else:
                ok = np.ones(len(symbols), bool)
            value = (value[: len(symbols) - k] * GOLD) ^ (symbols[k:] + np.uint64(k + 1))
            self.buckets.append(np.where(ok, (mix(value) >> np.uint64(64 - BITS)).astype(np.int64), -1))

    def scores(self, table: np.ndarray) -> np.ndarray:
        """Sums of ``table`` rows (one for each bucket, and a last one of zeros) over the n-grams of each word."""
        if not len(self.starts):
            return np.zeros((0, table.shape[1]), np.float32)
        # a word's n-grams begin at the border before it or at one of its letters; equal words have equal sums
        first, word = self._distinct()
        sizes = self.lengths[first] + 1
        begins = np.cumsum(sizes) - sizes
        positions = np.arange(int(sizes.sum())) + np.repeat(self.at[first] - begins, sizes)
        total = np.zeros((len(positions), table.shape[1]), np.float32)
        for own in self.buckets:
            total += table[np.where(positions < len(own), own[np.minimum(positions, len(own) - 1)], -1)]
        return np.add.reduceat(total, begins, axis=0)[word]

    def _distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """A place of each distinct word, and the number of each word among them; words are told apart by 64-bit hashes."""
        sizes = self.lengths + 1
        place = np.arange(int(self.at[-1])) - np.repeat(self.at[:-1], sizes)
        powers = np.ones(int(place.max()) + 1, np.uint64)
        np.multiply.accumulate(np.full(len(powers) - 1, GOLD | np.uint64(1), np.uint64), out=powers[1:])
        keys = np.add.reduceat(mix(self.symbols[: len(place)] + np.uint64(1)) * powers[place], self.at[:-1])
        _, first, word = np.unique(keys, return_index=True, return_inverse=True)
        return first, word


def viterbi(scores: np.ndarray, text: np.ndarray, texts: int, penalty: float) -> np.ndarray:
    """The best state of each word; ``text`` numbers the words' texts in order. All texts run in lockstep, the longest first,
    and leave when they end.
    """
    states, out = scores.shape[1], np.zeros(len(scores), np.int64)
    counts = np.bincount(text, minlength=texts)
    order = np.argsort(-counts, kind="stable")[: int((counts > 0).sum())]
    first = (np.cumsum(counts) - counts)[order]
    steps = int(counts[order[0]]) if len(order) else 0
    running = np.searchsorted(-counts[order], -np.arange(steps), "left").tolist()  # texts that have a word at each step
    # a row for each state: sums and comparisons then run along the texts
    rows, lane = np.ascontiguousarray(scores.T, np.float32), np.arange(states)[:, None]
    now, least, back = np.zeros((states, len(order)), np.float32), np.float32(-penalty), []
    for t, k in enumerate(running):
        here = now[:, :k]  # the best state is at 0
        back.append(np.where(here >= least, lane, here.argmax(axis=0)).astype(np.int16))
        here = np.maximum(here, least) + rows[:, first[:k] + t]
        here -= here.max(axis=0)
        now[:, :k] = here
    state, column = now.argmax(axis=0), np.arange(len(order))
    for t in range(steps - 1, -1, -1):
        k = running[t]
        out[first[:k] + t] = state[:k]
        state[:k] = back[t][state[:k], column[:k]]
    return out


class Model:
    """``names`` sorted; ``table`` of log-probabilities by bucket; ``uses`` of scripts by language."""

    def __init__(self, counts: dict[str, np.ndarray]) -> None:
        self.names = sorted(counts)
        n = np.array([counts[name][:BUCKETS] for name in self.names], np.float64).T.reshape(BUCKETS, len(self.names))
        p = np.log((n + 0.5) / (n.sum(axis=0) + 0.5 * BUCKETS))
        p -= p.mean(axis=1, keepdims=True)
        self.table = np.vstack([WEIGHT * p, np.zeros((1, p.shape[1]))]).astype(np.float32)
        letters = np.array([counts[name][BUCKETS:] for name in self.names], np.float64)
        self.uses = letters >= USED * np.maximum(letters.sum(axis=1, keepdims=True), 1)

    def label(self, words: Words, texts: int, penalty: float) -> np.ndarray:
        scores = words.scores(self.table)
        allowed = self.uses.T[words.scripts]
        none = ~allowed.any(axis=1)
        scores = np.where(allowed, scores, scores.min(axis=1, keepdims=True) - 2 * penalty)
        scores[none] = 0
        return viterbi(scores.astype(np.float32), words.text, texts, penalty)


def fit(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = 1500) -> Model | None:
    """Learn from rows with a language and a text; ``None`` without any."""
    rows = docs.select(
        F.col(f"`{id}`").alias("i"), F.col(f"`{text}`").cast("string").alias("t"), F.col(f"`{lang}`").cast("string").alias("l")
    ).where("l is not null and t is not null")
    sizes = {r.l: r.n for r in rows.groupBy("l").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None
    unit = (F.abs(F.xxhash64("i", F.lit(11)) % 1_000_000) + 0.5) / 1_000_000
    # a row for each language, of which the driver holds a whole column of the model
    share = docs.sparkSession.createDataFrame([(k, sample / n) for k, n in sizes.items()], "l string, share double")
    rows = rows.join(F.broadcast(share), "l").where(unit < F.col("share"))
    wide = BUCKETS + len(SCRIPTS)

    def run(batch: pa.RecordBatch):
        texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        by: dict[str, np.ndarray] = {}
        for a, b in text_slices(texts, SLICE):
            for name in dict.fromkeys(langs[a:b]):
                words = Words([t for t, x in zip(texts[a:b], langs[a:b]) if x == name])
                total = by.setdefault(name, np.zeros(wide, np.int64))
                for own in words.buckets:
                    total[:BUCKETS] += np.bincount(own[own >= 0], minlength=BUCKETS)
                total[BUCKETS:] += np.bincount(words.scripts, words.lengths, len(SCRIPTS)).astype(np.int64)
        for name, total in by.items():
            used = np.flatnonzero(total)
            yield {"l": [name] * len(used), "k": pa.array(used), "n": pa.array(total[used])}

    counts = map_arrow(rows.select("t", "l"), run, "l string, k bigint, n bigint")
    found = {name: np.zeros(wide, np.int64) for name in sizes}
    table = counts.groupBy("l", "k").agg(F.sum("n").alias("n")).toArrow()
    codes = table["l"].combine_chunks().dictionary_encode() if table.num_rows else None
    keys, ns = table["k"].to_numpy(), table["n"].to_numpy()
    for code, name in enumerate(codes.dictionary.to_pylist() if codes is not None else ()):
        own = codes.indices.to_numpy() == code
        found[name][keys[own]] = ns[own]
    return Model({k: v for k, v in found.items() if v.any()}) if any(v.any() for v in found.values()) else None


SPANS = "array<struct<start: bigint, end: bigint, lang: string>>"


def identify(
    df: DataFrame, model: Model | None, text: str = "text", keep: list[str] | None = None, spans: bool = True,
    penalty: float = PENALTY,
) -> DataFrame:
    """Add ``lang_pred`` and ``score``, and ``lang_spans`` in code points if asked, to the columns in ``keep`` (all)."""
    added = ["lang_pred", "score", "lang_spans"][: 3 if spans else 2]
    keep = [c for c in (df.columns if keep is None else keep) if c not in added]
    source = with_text_last(df, keep, text)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch):
        texts = [t or "" for t in batch.column(batch.num_columns - 1).to_pylist()]
        preds, scores, found = [UNKNOWN] * len(texts), [0.0] * len(texts), [[] for _ in texts]
        own: Model | None = shared.value
        size = SLICE * LANGUAGES // max(LANGUAGES, len(own.names)) if own is not None else 0
        for a, b in text_slices(texts, size) if own is not None else ():
            words = Words(texts[a:b])
            if not len(words.starts):
                continue
            states = own.label(words, b - a, penalty)
            letters = np.zeros((b - a, len(own.names)))
            np.add.at(letters, (words.text, states), words.lengths)
            total = letters.sum(axis=1)
            best = letters.argmax(axis=1)
            for i in np.flatnonzero(total).tolist():
                preds[a + i], scores[a + i] = own.names[best[i]], float(letters[i, best[i]] / total[i])
            if spans:
                cut = np.flatnonzero(np.concatenate(([True], (np.diff(states) != 0) | (np.diff(words.text) != 0))))
                last = np.append(cut[1:], len(states)) - 1
                for p, q in zip(cut.tolist(), last.tolist()):
                    i = int(words.text[p])
                    base = int(words.begins[i])
                    found[a + i].append(
                        {"start": int(words.starts[p]) - base, "end": int(words.ends[q]) - base, "lang": own.names[states[p]]}
                    )
        yield {c: batch.column(i) for i, c in enumerate(keep)} | {"lang_pred": preds, "score": scores, "lang_spans": found}

    extra = T.StructType.fromDDL(f"lang_pred string, score double, lang_spans {SPANS}").fields[: len(added)]
    return map_arrow(source, run, T.StructType([*source.schema.fields[:-1], *extra]))

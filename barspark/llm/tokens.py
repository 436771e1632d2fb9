"""Token ids by the ``tokenizers`` library, with a cache of encoded chunks.

A byte-level tokenizer whose pattern starts a new piece at every single space between two words gives the same ids
whether a text is encoded whole or cut at such spaces, and likewise at a line break between two other characters and
before a full stop, comma or the like that follows a letter. Arrow cuts a slice of texts at the spaces and finds its
distinct chunks; these are looked up, and their ids taken for every place. New chunks of Latin letters, which the pattern
keeps in one piece, go straight to the library's model; others are encoded together, those with line breaks after a
further cut. The cache has two generations: when the young one is full it becomes the old one, and what is used again
comes back. Texts with other white space next to a space are cut one by one. Any other tokenizer, and texts that contain
one of its added tokens, are encoded whole.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from struct import pack

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

BETWEEN_WORDS = re.compile(r"(?<=\S)(?= \S)")
NEXT_TO_SPACE = re.compile(r"\s | \s")
#: The same for Arrow, whose ``\\s`` is ASCII only.
ARROW_NEXT_TO_SPACE = r"[\t-\r\x1c-\x1f\x{85}\p{Z}] | [\t-\r\x1c-\x1f\x{85}\p{Z}]"
#: Chunks in a generation of a worker's cache; characters, and chunks, that are encoded in one call.
CACHED, CALL_CHARS, CALL_KEYS = 400_000, 200_000, 20_000
#: Bytes of text whose chunks are looked up together, for each chunk of a generation, unless one text is longer.
SLICE_BYTES = 20
#: Marks that begin a piece of their own after a letter (fixed values), and the letters for which that is used.
MARKS, LAST_LETTER = frozenset(".,;:!?"), "\u024f"
LETTERS = r"([A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f]+)([.,;:!?]?)"
LATIN = re.compile(rf"{LETTERS}(?:\n{LETTERS})?")
ID = np.dtype("<u4")
#: A chunk without its leading space, or the first chunk of a text in a tuple.
Key = str | tuple[str]


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(others)}


BYTE_LETTERS = _byte_letters()


def text_parts(batch: pa.RecordBatch, column: int, limit: int) -> Iterator[pa.RecordBatch]:
    """A batch in runs of rows with at most ``limit`` bytes of text, or one row with more."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends, begin = np.cumsum(lengths, dtype=np.int64), 0
    while begin < batch.num_rows:
        before = int(ends[begin - 1]) if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield batch.slice(begin, end - begin)
        begin = end


class Encoder:
    def __init__(self, path: str, cached: int = CACHED) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.added = [t["content"] for t in spec.get("added_tokens") or []]
        before = spec.get("pre_tokenizer") or {}
        self.cuts = (
            before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
            and not any(spec.get(k) for k in ("normalizer", "post_processor", "truncation", "padding"))
            and spec["model"].get("type") == "BPE"
        )
        line = self._whole("\n") if self.cuts else b""
        self.line = int(np.frombuffer(line, ID)[0]) if len(line) == ID.itemsize else None
        self.model = self.tokenizer.model
        self.marks = {m: self._whole(m) if m and self.cuts else b"" for m in ("", "\n", *MARKS)}
        self.cached = cached
        self.slice_bytes = SLICE_BYTES * cached
        self.known: dict[Key, bytes] = {}
        self.old: dict[Key, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, ID).tobytes()

    @staticmethod
    def parts(chunk: str) -> list[str]:
        """Parts of a chunk that may be encoded each for itself."""
        lines = chunk.split("\n")
        if len(lines) > 1 and any(not x or x[-1].isspace() or (k and x[0].isspace()) for k, x in enumerate(lines)):
            return [chunk]
        out: list[str] = []
        for k, line in enumerate(lines):
            if k:
                out.append("\n")
            if len(line) > 1 and line[-1] in MARKS and line[-2].isalpha() and line[-2] <= LAST_LETTER:
                out += [line[:-1], line[-1]]
            else:
                out.append(line)
        return out

    def _merge(self, word: str, space: str) -> bytes:
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(BYTE_LETTERS)
        ids = [t.id for t in self.model.tokenize(space + word)]
        return pack(f"<{len(ids)}I", *ids)

    def _encode_letters(self, keys: Iterable[Key], known: dict[Key, bytes]) -> dict[Key, bytes]:
        """Ids of those keys that are Latin letters, a mark behind them, and one more such word on the next line."""
        out: dict[Key, bytes] = {}
        match, merge, marks, space = LATIN.fullmatch, self._merge, self.marks, BYTE_LETTERS[ord(" ")]
        for key in keys:
            first = type(key) is tuple
            if not first and key.isascii() and key.isalpha():
                out[key] = merge(key, space)
                continue
            found = match(key[0] if first else key)
            if found is None:
                continue
            word, mark, below, last = found.groups()
            ids = known.get((word,) if first else word)
            if ids is None:
                ids = merge(word, "" if first else space)
            if mark:
                ids += marks[mark]
            if below:
                more = known.get((below,)) or out.get((below,))
                if more is None:
                    more = out[(below,)] = merge(below, "")
                ids += marks["\n"] + more + marks[last]
            out[key] = ids
        return out

    def _encode_new(self, chunks: list[str]) -> dict[str, bytes]:
        """Ids of distinct chunks: those without line breaks together, parted by them."""
        out: dict[str, bytes] = {}
        together: list[list[str]] = [[]]
        size = 0
        for chunk in chunks:
            if self.line is None or "\n" in chunk or not chunk or chunk[-1].isspace():
                out[chunk] = self._whole(chunk)
                continue
            if size > CALL_CHARS:
                together.append([])
                size = 0
            together[-1].append(chunk)
            size += len(chunk)
        calls = self.tokenizer.encode_batch_fast(["\n".join(c) for c in together], add_special_tokens=False)
        for own, call in zip(together, calls):
            ids = np.array(call.ids, ID)
            ends = np.append(np.flatnonzero(ids == self.line), len(ids))
            if len(ends) != len(own):  # the pattern joined a break with something: encode one by one
                out.update((c, self._whole(c)) for c in own)
                continue
            data, begin = ids.tobytes(), 0
            for chunk, end in zip(own, (ends * ID.itemsize).tolist()):
                out[chunk] = data[begin:end]
                begin = end + ID.itemsize
        return out

    def _encode_plain(self, keys: list[str]) -> dict[Key, bytes]:
        """Ids of keys without any white space, many to a call, parted by line breaks."""
        out: dict[Key, bytes] = {}
        for begin in range(0, len(keys), CALL_KEYS):
            own = keys[begin : begin + CALL_KEYS]
            call = self.tokenizer.encode_batch_fast([" " + "\n ".join(own)], add_special_tokens=False)[0]
            ids = np.array(call.ids, ID)
            ends = np.flatnonzero(ids == self.line)
            if len(ends) != len(own) - 1:  # the pattern joined a break with something: encode one by one
                out.update((k, self._whole(" " + k)) for k in own)
                continue
            data = ids.tobytes()
            stops = [*(ends * ID.itemsize).tolist(), len(data)]
            starts = [0, *(ends * ID.itemsize + ID.itemsize).tolist()]
            out.update(zip(own, [data[i:j] for i, j in zip(starts, stops)]))
        return out

    def _learn(self, new: set[Key], known: dict[Key, bytes]) -> None:
        """Add the ids of new keys to ``known``."""
        again = self.old.keys() & new
        known.update((k, self.old[k]) for k in again)
        new = new - again
        letters = self._encode_letters(new, known)
        known.update(letters)
        new = new.difference(letters)
        plain = [k for k in new if type(k) is str and k.isprintable() and k] if self.line is not None else []
        known.update(self._encode_plain(plain))
        if len(plain) < len(new):
            cut = {k: self.parts(" " + k if type(k) is str else k[0]) for k in new.difference(plain)}
            place = {p: p[1:] if p[:1] == " " else (p,) for parts in cut.values() for p in parts}
            ids_of = {p: ids for p, k in place.items() if (ids := known.get(k)) is not None}
            letters = self._encode_letters([k for p, k in place.items() if p not in ids_of], known)
            ids_of |= {p: letters[k] for p, k in place.items() if k in letters}
            ids_of |= self._encode_new([p for p in place if p not in ids_of])
            known.update((place[p], ids) for p, ids in ids_of.items())
            known.update((key, b"".join([ids_of[p] for p in parts])) for key, parts in cut.items())

    def _know(self, keys: list[Key]) -> dict[Key, bytes]:
        """The cache, with the ids of all these keys in it."""
        new = {k for k in keys if k not in self.known}
        if len(self.known) + len(new) > self.cached:
            self.old, self.known = self.known, {}
            new = set(keys)
        if new:
            self._learn(new, self.known)
        return self.known

    def _alone(self, text: str) -> bytes:
        if any(t in text for t in self.added):
            return self._whole(text)
        first, *others = BETWEEN_WORDS.split(text)
        keys: list[Key] = [(first,), *[c[1:] for c in others]]
        known = self._know(keys)
        return b"".join([known[k] for k in keys])

    def _encode_slice(self, texts: pa.Array) -> list[bytes]:
        alone = pc.match_substring_regex(texts, ARROW_NEXT_TO_SPACE)
        for token in self.added:
            alone = pc.or_(alone, pc.match_substring(texts, token))
        lists = pc.split_pattern(pc.if_else(alone, "", texts), " ")
        counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(counts)
        begins = ends - counts
        chunks = lists.flatten()
        coded = chunks.dictionary_encode()
        place = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        # the first chunk of a text has no space before it, and is a key of its own
        within = np.ones(len(place), bool)
        within[begins] = False
        wanted = np.zeros(len(coded.dictionary), bool)
        wanted[place[within]] = True
        place = (np.cumsum(wanted) - 1)[place]
        keys: list[Key] = coded.dictionary.filter(pa.array(wanted)).to_pylist()
        place[begins] = np.arange(len(keys), len(keys) + len(texts))
        keys += [(c,) for c in chunks.take(pa.array(begins)).to_pylist()]
        known = self._know(keys)
        ids = pa.array([known[k] for k in keys], pa.large_binary()).take(pa.array(place))
        _, offsets, data = ids.buffers()
        bounds = np.frombuffer(offsets, np.int64)[: len(ids) + 1]
        view = memoryview(data or b"")
        out = [view[i:j].tobytes() for i, j in zip(bounds[begins].tolist(), bounds[ends].tolist())]
        for i in np.flatnonzero(alone.to_numpy(zero_copy_only=False)).tolist():
            out[i] = self._alone(texts[i].as_py())
        return out

    def encode(self, texts: list[str | None] | pa.Array) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers; none for null or empty."""
        column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        if not self.cuts:
            return [self._whole(t or "") for t in column.to_pylist()]
        batch = pa.RecordBatch.from_arrays([pc.fill_null(column, "")], ["t"])
        return [ids for some in text_parts(batch, 0, self.slice_bytes) for ids in self._encode_slice(some.column(0))]


@lru_cache(maxsize=4)
def encoder(path: str, cached: int = CACHED) -> Encoder:
    return Encoder(path, cached)

import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from barspark.llm import token_codes as C
from barspark.llm.tokens import ID, Encoder, encoder, text_parts
from barspark.plans import stage_path

from .llm_samples import AWKWARD

PATH = public_tokenizers.path("byte_bpe_50k.json")
PLAIN = Tokenizer.from_file(PATH)


def ids_of(text):
    return PLAIN.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=list("ab c  \n\t.,'s1é漢  \x1c\x85<|endoftext|>"), max_size=60))
def test_chunked_encoding_equals_whole(text):
    assert np.frombuffer(encoder(PATH).encode([text])[0], ID).tolist() == ids_of(text)


def test_awkward_texts_encode_alike():
    together = encoder(PATH).encode([t for _, t in AWKWARD])
    for (_, text), ids in zip(AWKWARD, together):
        assert np.frombuffer(ids, ID).tolist() == ids_of(text)
        assert np.frombuffer(encoder(PATH).encode([text])[0], ID).tolist() == ids_of(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["word", "Été.", "a,b", "x!\n", "\ny", "it's.", "7.", "Ж.", "z;", "\n", "'s", "ﬁ.", "\u3000"]), max_size=12))
def test_parts_encode_alike(pieces):
    text = " ".join(pieces)
    assert np.frombuffer(encoder(PATH).encode([text])[0], ID).tolist() == ids_of(text)


def test_cache_may_overflow():
    own = Encoder(PATH, 50)
    for _, text in AWKWARD * 2:
        assert np.frombuffer(own.encode([text])[0], ID).tolist() == ids_of(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.none() | st.text(alphabet=list("abÉ é.,!\n\t\xa0\u2028漢1'"), max_size=30), max_size=12), st.integers(1, 60))
def test_arrow_texts_encode_alike_in_slices_of_any_size(texts, cached):
    column = pa.array([None, "x y", *texts], pa.string()).slice(1)
    got = Encoder(PATH, cached).encode(column)
    assert [np.frombuffer(x, ID).tolist() for x in got] == [ids_of(t) for t in column.to_pylist()]


def test_latin_words_need_no_pattern_search():
    texts = ["Mot déjà vu, déjà.\nMot nouveau", "vu vu"]
    own = Encoder(PATH)
    own.tokenizer = None  # only the model and the cache are left
    assert [np.frombuffer(x, ID).tolist() for x in own.encode(pa.array(texts))] == [ids_of(t) for t in texts]


@pytest.mark.parametrize("limit", [1, 4, 100])
def test_text_parts_keep_every_row(limit):
    batch = pa.RecordBatch.from_pydict({"t": ["abc", None, "", "é" * 9, "d"]})
    found = list(text_parts(batch, 0, limit))
    assert pa.Table.from_batches(found).to_pylist() == batch.to_pylist()
    sizes = [[len((t or "").encode()) for t in p.column(0).to_pylist()] for p in found]
    assert all(sum(x) <= limit or len(x) == 1 for x in sizes)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=1500), st.sampled_from([8, 16]), st.data())
def test_codes_give_random_access(ids, width, data):
    codes = C.Codes(C.pack(np.array(ids, np.uint32), width))
    assert len(codes) == len(ids) and codes.ids(0, len(ids)).tolist() == ids
    if ids:
        a, b = sorted(data.draw(st.tuples(st.integers(0, len(ids)), st.integers(0, len(ids)))))
        assert codes.ids(a, b).tolist() == ids[a:b]
        at = data.draw(st.integers(0, len(ids) - 1))
        assert codes[at] == ids[at]


def test_round_trip(spark, awkward, empty):
    path = stage_path(spark, "codes-test")
    C.write(awkward, path, PATH, segment=500)
    segments = spark.read.schema(C.SEGMENTS).parquet(path)
    assert segments.count() > 3
    got = C.read(segments).orderBy("start").collect()
    start, rows = 0, sorted(AWKWARD, key=lambda r: (r[0] is not None, r[0] or 0))
    assert len(got) == len(rows)
    for r, (doc, text) in zip(got, rows):
        ids = np.array([*ids_of(text), 2], ID)
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    first = segments.where("part = 0 and seq = 0").first()
    expected = np.concatenate([[*ids_of(t), 2] for _, t in rows])[:3].tolist()
    assert C.tokens_at(segments, first.part, first.seq, [0, 1, 2]) == expected
    assert C.round_trip(empty, PATH).count() == 0

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from barspark.llm import token_counts as C
from barspark.llm.queries import QUERIES

from .llm_samples import AWKWARD

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    "<|endoftext|>", "<|endoftext|><|endoftext|> a  b<|endoftext|>\n", "<|endoftext", "don't we'll'S  \t a b 　 x", " ", "  a", "a  ",
    "՘ x࢏࢏ \U00010940 ꟎b", "漢字 かな 한국 ١٢٣ ½ ²", "x" * 3000, "ab" * 2000, " a\u0085b\x1cc", "A B C\n\n\nD .,;! e.f",
    "é ​‍﻿", "\r\n \r\n", "aaaa bbbb " * 700,
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def wanted(library, text):
    return len(library.encode(text or "", add_special_tokens=False).ids)


def random_texts(n, seed):
    rng = random.Random(seed)
    marks = ["the", "tion", "é", "'s", " ", "  ", "\n", ".", ",", "12", "<|endoftext|>", "ß漢", "q", "\t", "Ωmega", "԰"]
    return ["".join(rng.choices(marks, k=rng.randint(0, 60))) for _ in range(n)]


@pytest.mark.parametrize("cached", [3, 10_000])
@pytest.mark.parametrize("window", [7, 1_000_000])
def test_counts_equal_the_library(library, monkeypatch, cached, window):
    monkeypatch.setattr(C, "WINDOW", window)
    counter = C.Counter(PATH, cached)
    for text in ODD + [t for _, t in AWKWARD] + random_texts(300, 1):
        assert counter.count(text) == wanted(library, text), text[:80] if text else text


def test_merges_of_a_piece_follow_the_ranks(library):
    """Against a scan for the lowest rank before every merge."""
    counter = C.Counter(PATH)
    back = {v: k for k, v in counter.ranks.items()}
    rng = random.Random(4)
    for _ in range(300):
        piece = bytes(rng.choices(b"aeiontrsh\xc3\xa9", k=rng.randint(1, 30)))
        symbols, count = [counter.first[b] for b in piece], len(piece)
        while ranks := [r for p in zip(symbols, symbols[1:]) if (r := counter.ranks.get((p[0] << C.PLACE) | p[1])) is not None]:
            at = next(i for i, p in enumerate(zip(symbols, symbols[1:])) if ((p[0] << C.PLACE) | p[1]) == back[min(ranks)])
            symbols[at : at + 2] = [counter.made[min(ranks)]]
            count -= 1
        assert counter.merged(piece) == count


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError):
        C.Counter(public_tokenizers.path("word_bpe_49k.json"))


def test_awkward_rows(awkward, empty, library):
    got = C.count_tokens(awkward, PATH, limit=512)
    assert got.columns == [*awkward.columns, "n_bytes", "n_tokens", "over_limit"]
    rows = got.collect()
    assert len(rows) == len(AWKWARD)
    for r in rows:
        n = wanted(library, r.text)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((r.text or "").encode()), n, n > 512)
    assert C.count_tokens(empty, PATH).count() == 0
    again = C.count_tokens(got, PATH, keep=["doc_id", "n_tokens"])
    assert again.columns == ["doc_id", "n_bytes", "n_tokens"]
    total = C.totals(got, ["source"]).first()
    assert total.n_docs == len(AWKWARD) and total.n_tokens == sum(r.n_tokens for r in rows)
    assert total.n_over == sum(r.over_limit for r in rows)


def test_query_equals_the_library(spark, library):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in QUERIES["op11_token_counts"](spark, sf).collect():
        assert r.n_tokens == wanted(library, texts[r.doc_id])

import random

import numpy as np
import pytest

from barspark.llm import language as G

from .llm_samples import AWKWARD

STEMS = {"aa": "ka to mi nu sa re", "bb": "szcz ow dzi prz yk ny", "cc": "при ве стро на ко ми"}


def sample(lang, n, seed):
    rng = random.Random(seed)
    return " ".join("".join(rng.choices(STEMS[lang].split(), k=rng.randint(2, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def model(make):
    return G.fit(make([(k, sample(lang, 60, k), lang) for k, lang in enumerate(["aa", "bb", "cc"] * 20)]))


def test_held_out_texts(make, model):
    rows = [(k, sample(lang, 25, 1000 + k), lang) for k, lang in enumerate(["aa", "bb", "cc"] * 10)]
    got = G.identify(make(rows), model, spans=False).collect()
    assert all(r.lang_pred == r.lang and 0 < r.score <= 1 for r in got)


def test_mixed_texts_have_spans(make, model):
    a, b, c = sample("aa", 30, 1), sample("bb", 20, 2), sample("cc", 15, 3)
    text = f"{a}. {b}! {c}"
    r = G.identify(make([(1, text)]), model, keep=["doc_id"]).first()
    assert [(text[s.start : s.end], s.lang) for s in r.lang_spans] == [(a, "aa"), (b, "bb"), (c, "cc")]


def test_awkward_rows(make, awkward, empty, model):
    got = G.identify(awkward, model).collect()
    assert len(got) == len(AWKWARD)
    for r in got:
        none = not any(x.isalpha() for x in r.text or "")
        assert (r.lang_pred == "und") == none and 0 <= r.score <= 1
    assert G.identify(empty, model).count() == 0
    assert G.fit(empty) is None and G.fit(make([(1, None, "aa"), (2, "x", None)])) is None
    assert {r.lang_pred for r in G.identify(awkward, None).collect()} == {"und"}


def test_viterbi_finds_the_best_path():
    rng = np.random.default_rng(0)
    counts = [0, 1, 6, 3, 0, 7]
    scores = rng.normal(0, 3, (sum(counts), 3)).astype(np.float32)
    text = np.repeat(np.arange(len(counts)), counts)
    got = G.viterbi(scores, text, len(counts), 2.0)
    begin = 0
    for n in counts:
        own = scores[begin : begin + n].astype(float)
        best, path = -np.inf, ()
        for code in range(3**n):
            states = [code // 3**k % 3 for k in range(n)]
            value = sum(own[k, s] for k, s in enumerate(states)) - 2.0 * sum(x != y for x, y in zip(states, states[1:]))
            if value > best:
                best, path = value, states
        assert got[begin : begin + n].tolist() == list(path)
        begin += n


def test_word_scores_are_sums_over_their_n_grams(model):
    """Against the sums over all positions of the texts, repeated words included."""
    text = "kato Kato минусаре x kato-szcz kak " + sample("aa", 20, 5)
    words = G.Words([text, "", "kato"])
    got = words.scores(model.table)
    own = [text[a:b].lower() for a, b in zip(words.starts, words.ends) if b <= len(text)] + ["kato"]
    assert len(own) == len(got)
    same = [row for word, row in zip(own, got) if word == "kato"]
    assert len(same) == 4 and all((row == same[0]).all() for row in same)
    plain = np.add.reduceat(
        sum(np.pad(model.table[b], ((0, len(words.buckets[0]) - len(b)), (0, 0))) for b in words.buckets)[: words.at[-1]], words.at[:-1], axis=0
    )
    np.testing.assert_allclose(got, plain, rtol=1e-5, atol=1e-5)


def test_more_languages_than_are_scored_at_once(make):
    rng = random.Random(8)
    letters = [chr(c) for c in range(0x3B1, 0x3C9)] + list("abcdefghijklmnopqrstuvwxyz")
    stems = {f"l{k:03d}": ["".join(rng.choices(letters, k=3)) for _ in range(5)] for k in range(300)}
    texts = {k: " ".join("".join(rng.choices(v, k=2)) for _ in range(40)) for k, v in stems.items()}
    model = G.fit(make([(i, t, k) for i, (k, t) in enumerate(texts.items())]))
    assert len(model.names) == 300
    got = G.identify(make([(i, t, k) for i, (k, t) in enumerate(texts.items())]), model, spans=False).collect()
    assert sum(r.lang_pred == r.lang for r in got) >= 295

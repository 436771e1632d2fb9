import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from barspark.llm import packing as P

from .llm_samples import AWKWARD

PATH = public_tokenizers.path("byte_bpe_50k.json")


def check_bins(lengths, bins, capacity):
    fill = np.bincount(bins, weights=lengths)
    assert fill.max() <= capacity and fill.min() > 0 and len(fill) == bins.max() + 1
    return len(fill)


def test_best_fit_and_swaps():
    rng = np.random.default_rng(0)
    for high in (300, 1200, 2047):
        lengths = rng.integers(1, high, 3000)
        first = P.best_fit(lengths, 2048)
        n = check_bins(lengths, first, 2048)
        better = check_bins(lengths, P.pack_lengths(lengths), 2048)
        assert -(-lengths.sum() // 2048) <= better <= n
    assert P.pack_lengths(np.zeros(0, np.int64)).tolist() == []


def test_swaps_empty_bins_that_best_fit_cannot():
    # by decreasing length 4, 3, 3 | 3, 3, 2 | 2 of 10: an exchange of 4 for 2 twos, or the like, saves a bin
    lengths = np.array([4, 3, 3, 3, 3, 2, 2])
    first = P.best_fit(lengths, 10)
    assert check_bins(lengths, first, 10) == 2
    bins = P.Swaps(lengths, np.array([0, 0, 1, 1, 1, 2, 2]), 10).run()
    assert check_bins(lengths, np.unique(bins, return_inverse=True)[1], 10) == 2


def test_swaps_never_lose_a_piece_or_overfill():
    rng = np.random.default_rng(5)
    for _ in range(20):
        lengths = rng.integers(1, 60, 80)
        bins = P.Swaps(lengths, np.arange(80), 100).run()
        assert len(bins) == 80
        n = check_bins(lengths, np.unique(bins, return_inverse=True)[1], 100)
        assert n <= -(-lengths.sum() // 100) + 3


def test_packed_documents(awkward, empty):
    tokenizer = Tokenizer.from_file(PATH)
    got = P.pack_documents(awkward, PATH, with_ids=True).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for doc, text in AWKWARD:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        copies = sum(d == doc for d, _ in AWKWARD)
        rows = sorted(by_doc[doc], key=lambda r: r.piece)
        assert sum(r.length for r in rows) == copies * len(ids)
        for r in rows:
            own = ids[r.start : r.start + r.length].tobytes()
            assert zlib.crc32(own) == r.ids_crc32 and bytes(r.ids) == own
            assert r.length == 2048 or r.piece == 0
    for rows in by_sequence.values():
        place = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == place
            place += r.length
        assert place <= 2048
    assert len(by_sequence) == -(-sum(r.length for r in got) // 2048)
    assert P.pack_documents(empty, PATH).count() == 0

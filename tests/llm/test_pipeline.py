import numpy as np
import pytest

import corpus_pipeline as P
from barspark.llm import decontaminate, secret_scan

from .llm_samples import AWKWARD, CLASHING, words
from .test_near_dedup import brute, family
from .test_toxicity import toxic

SECRET = " password=abcdefghijklmnop "
ITEM = words(30, 5000)


@pytest.fixture(scope="module")
def folder(spark, make, tmp_path_factory):
    rows = AWKWARD + family(80, 12, 2, 2000)
    rows += [(10_000 + k, toxic(k)) for k in range(400)] + [(20_000 + k, words(60, 3000 + k)) for k in range(300)]
    rows += [(30_000, words(40, 1) + SECRET + words(40, 2)), (30_001, words(40, 6) + " " + ITEM + " " + words(40, 7)), (30_002, ITEM)]
    path = str(tmp_path_factory.mktemp("tables"))
    make(rows).write.parquet(f"{path}/documents.parquet")
    labels = [(10_000 + k, 1) for k in range(330)] + [(20_000 + k, 0) for k in range(250)]
    spark.createDataFrame(labels, "doc_id bigint, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (2, None)], "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages(spark, folder):
    docs = P.read(spark, folder, "documents")
    columns = docs.columns
    before = docs.collect()

    name, step = P.STAGES[0]
    clean = step(spark, docs, folder)
    assert clean.columns == columns and set(CLASHING) <= set(columns)
    left = clean.collect()
    kept = [r.doc_id for r in left]
    through = sum(10_000 <= (k or 0) < 10_400 for k in kept)
    assert through <= 4
    assert len(left) == len(before) - 400 + through

    single = P.STAGES[1][1](spark, clean, folder)
    groups = brute([(r.doc_id, r.text) for r in left], P.WIDTH)
    expected = sorted(d for d, (c, _) in groups.items() if c == d)
    assert single.columns == columns
    got = sorted(r.doc_id for r in single.collect() if r.doc_id is not None)
    assert got == expected

    bare = P.STAGES[2][1](spark, single, folder)
    texts = {r.doc_id: r for r in bare.collect()}
    assert bare.columns == columns and 30_002 not in texts
    assert texts[30_001].text == words(40, 6) + "  " + words(40, 7) and texts[30_001].n_chars == len(texts[30_001].text)
    hits = decontaminate.find_hits(bare, P.read(spark, folder, "benchmark"))
    assert hits.where("size(hits) > 0").count() == 0

    safe = P.STAGES[3][1](spark, bare, folder)
    assert safe.columns == columns
    assert not any(secret_scan.find(r.text) for r in safe.collect())
    unchanged = {r.doc_id: r.text for r in safe.collect()}
    assert all(unchanged[d] == words(60, d - 17_000) for d in range(20_000, 20_300))

    packed = P.STAGES[4][1](spark, safe, folder).collect()
    assert {r.doc_id for r in packed} == set(unchanged)
    fill = {}
    for r in packed:
        fill[r.sequence_id] = fill.get(r.sequence_id, 0) + r.length
    assert max(fill.values()) <= 2048 and len(fill) <= np.ceil(sum(fill.values()) / 2048) + 1


def test_near_copies_keep_one_row_of_each_text_and_null_ids(spark, make, folder):
    a, b = words(60, 41), words(60, 42)
    rows = [(5, a), (5, b), (5, b), (None, a), (None, b), (None, ""), (None, " "), (1, ""), (1, ""), (None, words(60, 43)), (None, words(60, 43))]
    got = P.drop_near_copies(spark, make(rows), folder)
    assert sorted((r.doc_id or 0, r.text) for r in got.collect()) == sorted(
        [(5, a), (5, b), (0, ""), (0, " "), (1, ""), (0, words(60, 43))]
    )


def test_run_gives_the_result_of_the_last_stage(spark, folder):
    assert P.run(spark, folder).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def test_empty_tables(spark, empty, folder):
    docs = empty
    for _, step in P.STAGES:
        docs = step(spark, docs, folder)
    assert docs.count() == 0

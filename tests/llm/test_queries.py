"""The registered queries: their columns, and a row for each document, on the smallest tables."""

import os
import zlib

import duckdb
import pytest

import __spark_entry__ as entry_module
from barspark.llm.queries import ORACLES, QUERIES
from check import TABLES, compare

FOLDER = "/root/testdata/sf0.001"
COLUMNS = {
    "op1": ["doc_id bigint", "n_assign bigint", "n_access bigint", "n_hex bigint", "base_sha256 string", "spans string"],
    "op2": ["doc_id bigint", "start bigint", "n_tokens bigint", "ids_crc32 bigint"],
    "op3": ["doc_id bigint", "n_bytes bigint", "n_removed bigint", "n_spans bigint", "kept_sha256 string"],
    "op4": ["doc_id bigint", "n_shingles bigint", "component_id bigint", "kept boolean"],
    "op5": ["doc_id bigint", "piece int", "start bigint", "length bigint", "ids_crc32 bigint", "sequence_id bigint", "offset bigint"],
    "op6": ["doc_id bigint", "n_words bigint", "n_hit bigint", "n_items bigint", "items_sha256 string", "contaminated boolean"],
    "op7": ["doc_id bigint", "n_bytes bigint", "n_removed bigint", "n_spans bigint", "kept_sha256 string"],
    "op8": ["doc_id bigint", "held_out boolean", "lang_pred string", "score double"],
    "op9": ["query_id bigint", "rank int", "vec_id bigint", "score double"],
    "op11": ["doc_id bigint", "n_bytes bigint", "n_tokens bigint", "over_limit boolean"],
    "op12": [
        "doc_id bigint", "leaf string", "subroot string", "root string", "proof_sha256 string", "folded_root string",
        "verified boolean",
    ],
    "op13": [
        "doc_id bigint", "n_runs bigint", "start bigint", "length bigint", "period bigint", "exponent_milli bigint",
        "runs_sha256 string", "collapsed_sha256 string",
    ],
    "op10": ["doc_id bigint", "held_out boolean", "score double", "predicted int"],
}


def test_all_are_registered():
    names = entry_module.queries()
    assert set(QUERIES) | {"pipeline"} <= set(names)
    assert sorted(n.split("_")[0] for n in QUERIES) == sorted(COLUMNS)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    got = QUERIES[name](spark, FOLDER)
    assert [f"{c} {t}" for c, t in got.dtypes] == COLUMNS[name.split("_")[0]]
    rows = got.collect()
    documents = {r.doc_id for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id").collect()}
    if name.startswith("op9"):
        assert {r.query_id for r in rows} == set(range(0, 500, 20)) and len(rows) == 25 * 20
        return
    assert {r.doc_id for r in rows} == documents
    if not name.startswith("op5"):
        assert len(rows) == len(documents)
    if name.startswith("op8"):
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    if name.startswith("op10"):
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
        assert all(r.predicted == int(r.score >= 0.5) for r in rows)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    db = duckdb.connect()
    for table in TABLES:
        db.sql(f"create view {table} as select * from '{FOLDER}/{table}.parquet'")
    assert compare(QUERIES[name](spark, FOLDER).toPandas(), db.sql(ORACLES[name]).df()) == "ok"

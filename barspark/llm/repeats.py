"""A bitmap of hashes that occur more than once, bounded in size whatever the number of hashes.

It only spares work: a hash that shares its bit with another by chance goes on in vain, and none is lost. With more
hashes than bits nearly all go on, and results stay the same.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The bitmap has about ``BITS_EACH`` bits for each hash, within these bounds.
BITS_EACH, LEAST_BITS, MOST_BITS = 64, 1 << 20, 1 << 30
CHUNK = 1 << 20
#: Bitmaps of at most so many bits come to the driver at once, larger ones a partition at a time.
COLLECTED = 1 << 27


def bitmap_of(hashes: DataFrame, count: int) -> np.ndarray:
    """Bits for the hashes, built in chunks."""
    size = LEAST_BITS
    while size < MOST_BITS and size < BITS_EACH * count:
        size *= 2
    shift = 64 - size.bit_length() + 1

    def run(key: tuple, table: pa.Table) -> pa.Table:
        bits = np.zeros(CHUNK, bool)
        bits[table["bit"].to_numpy() % CHUNK] = True
        return pa.table({"chunk": [key[0].as_py()], "bits": [np.packbits(bits, bitorder="little").tobytes()]})

    # distinct bits first, so a chunk gets CHUNK rows at most
    bits = hashes.select(F.shiftrightunsigned("h", shift).alias("bit")).distinct()
    chunks = bits.withColumn("chunk", F.shiftright("bit", CHUNK.bit_length() - 1)).groupBy("chunk")
    found = chunks.applyInArrow(run, "chunk bigint, bits binary")
    out = np.zeros(size // 8, np.uint8)
    for r in found.collect() if size <= COLLECTED else found.toLocalIterator():
        out[r.chunk * CHUNK // 8 : (r.chunk + 1) * CHUNK // 8] = np.frombuffer(r.bits, np.uint8)
    return out


def listed(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes >> np.uint64(64 - (8 * len(bitmap)).bit_length() + 1)
    return bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1 == 1


def split_rows(rows: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` (``doc_id``, ``text_key``, ...) that may be among the texts of ``wanted``, and those that aren't.

    Only the first need a shuffle to meet ``wanted``, a written table; some of them meet nothing.
    """
    hashes = wanted.select(F.xxhash64("doc_id", "text_key").alias("h"))
    bitmap = rows.sparkSession.sparkContext.broadcast(bitmap_of(hashes, wanted.count()))

    def test(h: pd.Series) -> pd.Series:
        return pd.Series(listed(bitmap.value, h.to_numpy().view(np.uint64)))

    among = F.pandas_udf(test, "boolean")(F.xxhash64("doc_id", "text_key"))
    return rows.where(among), rows.where(~among)

"""The corpus pipeline: from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; ``run`` writes the result of each
to the shared folder and reads it back for the next. All but the last return the columns of ``docs``; a stage that
changes a text sets ``n_chars`` to its length if there is such a column.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barspark.llm import decontaminate, near_dedup, packing, secret_scan, toxicity
from barspark.llm.common import read
from barspark.plans import stage

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
#: Words in a shingle of the near-duplicate stage.
WIDTH = 5
#: Token chunks that a worker remembers; it also holds what earlier stages left.
CACHED = 150_000
#: Scores from which a document is rejected.
TOXIC = 0.5


def _counted(docs: DataFrame) -> DataFrame:
    """``n_chars`` of the texts as they are now."""
    if "n_chars" not in docs.columns:
        return docs
    kind = docs.schema["n_chars"].dataType
    return docs.withColumn("n_chars", F.coalesce(F.length("text").cast(kind), "n_chars"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score below ``TOXIC``, by a model of the labelled ones among them; others go."""
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model, out="_toxicity")
    return scored.where(F.col("_toxicity") < TOXIC).drop("_toxicity")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id (then hash of the text).

    Rows that repeat an id and a text are one document; rows of one id with different texts are documents of their own.
    Rows without words stay, those with a null id all of them.
    """
    found = near_dedup.near_duplicates(docs, width=WIDTH)
    chosen = found.where("chosen").select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).distinct()
    text = F.col("text").cast("string")
    blank = F.col("doc_id").isNull() & ~F.coalesce(text, F.lit("")).rlike(near_dedup.HAS_WORD)
    same = F.col("doc_id").cast("bigint").eqNullSafe(F.col("_id")) & (F.xxhash64(text) == F.col("_key"))
    single = docs.where(~blank).join(chosen, same).dropDuplicates(["_id", "_key"]).drop("_id", "_key")
    return single.unionByName(docs.where(blank))


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without the passages of the benchmark; those that hold nothing else go."""
    return _counted(decontaminate.remove_spans(docs, read(spark, sf_dir, "benchmark")))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with a mark in place of each secret."""
    return _counted(secret_scan.redact(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in sequences of 2048 tokens."""
    return packing.pack_documents(docs, VOCABULARY, cached=CACHED)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("decontamination", remove_benchmark),
    ("secrets", redact_secrets),
    ("packing", pack),
]
#: No SQL has the models, signatures and token ids of the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

"""Small helpers that several operators share."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words of the near-duplicate contract: anything between ASCII white space.
SPACED_WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Words of the decontamination contract: ASCII digits and letters, and everything beyond ASCII.
PLAIN_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ascii_lower(text: str) -> str:
    """Lower-case A-Z only; every code point keeps its place."""
    if text.isascii():
        return text.lower()
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def map_arrow(
    df: DataFrame,
    fn: Callable[[pa.RecordBatch], Iterable[dict[str, list | pa.Array]]],
    schema: T.StructType | str,
) -> DataFrame:
    """Run ``fn`` over the Arrow batches of ``df``; it yields columns by name for each output batch."""
    spark_schema = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        wanted = to_arrow_schema(spark_schema)
        for batch in batches:
            for columns in fn(batch):
                yield pa.RecordBatch.from_arrays(
                    [
                        c if isinstance(c, pa.Array) and c.type == field.type
                        else c.cast(field.type) if isinstance(c, pa.Array)
                        else pa.array(c, type=field.type)
                        for field in wanted
                        for c in [columns[field.name]]
                    ],
                    schema=wanted,
                )

    return df.mapInArrow(run, spark_schema)


def with_text_last(df: DataFrame, keep: list[str], text: str) -> DataFrame:
    """The columns in ``keep``, and ``text`` as a string once more, last and under a name of its own."""
    name = "_text"
    while name in keep:
        name += "_"
    return df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias(name))


def text_slices(texts: list[str], limit: int) -> Iterator[tuple[int, int]]:
    """Cut a batch into runs of rows with about ``limit`` characters, one row at least."""
    begin = size = 0
    for i, text in enumerate(texts):
        if i > begin and size + len(text) > limit:
            yield begin, i
            begin, size = i, 0
        size += len(text)
    if begin < len(texts):
        yield begin, len(texts)


def parts(batch: pa.RecordBatch, rows: int = 512) -> Iterator[pa.RecordBatch]:
    """A batch in parts, where what is made of its texts is larger than these."""
    for begin in range(0, batch.num_rows, rows):
        yield batch.slice(begin, rows)


def id_crc(column: str):
    """The CRC-32 of an id as text, by which the held-out rows are chosen; a null id counts as 0."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(0))

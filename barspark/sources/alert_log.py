"""An alert log that a stream writes each alert to exactly once.

Tasks write their rows as JSON lines under ``data``; the commit of an epoch names the files in ``commits/<epoch>``, written aside
and moved into place. Only files named there count. An epoch that is run again after its commit changes nothing, and the
files of a task or an epoch that failed are dropped or, if that fails too, never named.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, WriterCommitMessage

FORMAT = "alert_log"


def _plain(value) -> str:
    return value.astimezone(timezone.utc).isoformat() if isinstance(value, datetime) else str(value)


@dataclass
class Written(WriterCommitMessage):
    """A task's file, or none if it had no rows."""

    name: str | None


class AlertWriter(DataSourceStreamWriter):
    def __init__(self, path: str) -> None:
        self.path = path

    def _root(self):
        from pyarrow import fs

        files, root = fs.FileSystem.from_uri(self.path)
        return files, root.rstrip("/")

    def write(self, iterator: Iterator[Row]) -> Written:
        files, root = self._root()
        first = next(iterator, None)
        if first is None:
            return Written(None)
        files.create_dir(f"{root}/data", recursive=True)
        name = f"{uuid.uuid4().hex}.json"
        with files.open_output_stream(f"{root}/data/{name}") as out:
            row: Row | None = first
            while row is not None:
                out.write(json.dumps(row.asDict(), default=_plain, ensure_ascii=False).encode() + b"\n")
                row = next(iterator, None)
        return Written(name)

    def commit(self, messages: list[WriterCommitMessage | None], batchId: int) -> None:
        from pyarrow import fs

        files, root = self._root()
        place = f"{root}/commits/{batchId}"
        if files.get_file_info(place).type != fs.FileType.NotFound:
            with files.open_input_stream(place) as done:
                kept = set(done.read().decode().split())
            self.abort([m for m in messages if not (isinstance(m, Written) and m.name in kept)], batchId)
            return
        files.create_dir(f"{root}/commits", recursive=True)
        aside = f"{root}/commits/_{uuid.uuid4().hex}"
        names = [m.name for m in messages if isinstance(m, Written) and m.name]
        with files.open_output_stream(aside) as out:
            out.write("".join(f"{n}\n" for n in names).encode())
        files.move(aside, place)

    def abort(self, messages: list[WriterCommitMessage | None], batchId: int) -> None:
        files, root = self._root()
        for message in messages:
            if isinstance(message, Written) and message.name:
                files.delete_file(f"{root}/data/{message.name}")


class AlertLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def streamWriter(self, schema, overwrite: bool) -> AlertWriter:
        return AlertWriter(self.options["path"])


def start_alerts(alerts: DataFrame, path: str, checkpoint: str, every: str | None = None):
    """Write a stream of alerts to the log in ``path``, a folder that driver and executors share."""
    alerts.sparkSession.dataSource.register(AlertLog)
    trigger = {"processingTime": every} if every else {"availableNow": True}
    writer = alerts.writeStream.format(FORMAT).outputMode("append").option("checkpointLocation", checkpoint)
    return writer.trigger(**trigger).start(path)


def read_alerts(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The alerts of all committed epochs."""
    named = spark.read.text(f"{path}/commits").select(F.col("value").alias("_name"))
    rows = spark.read.schema(schema).json(f"{path}/data").select("*", F.col("_metadata.file_name").alias("_name"))
    return rows.join(named, "_name", "left_semi").drop("_name")

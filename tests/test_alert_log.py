import os
from datetime import datetime

from pyspark.sql import Row

from barspark.sources import alert_log as al

SCHEMA = "symbol string, ts timestamp, message string"


def alerts(*texts):
    return iter([Row(symbol="A", ts=datetime(2024, 1, 1, 5), message=t) for t in texts])


def texts(spark, path):
    return sorted(r.message for r in al.read_alerts(spark, path, SCHEMA).collect())


def test_epochs_that_fail_or_come_again(spark, tmp_path):
    path = f"{tmp_path}/log"
    writer = al.AlertWriter(path)
    first = [writer.write(alerts("a", "b\nc")), writer.write(alerts()), writer.write(alerts("é"))]
    writer.commit(first, 0)
    assert texts(spark, path) == ["a", "b\nc", "é"]
    assert first[1].name is None
    lost = [writer.write(alerts("x")), None]  # one task failed: the epoch is given up
    writer.write(alerts("written, but its task never ended"))
    writer.abort(lost, 1)
    again = [writer.write(alerts("x", "y"))]
    writer.commit(again, 1)
    writer.commit([writer.write(alerts("x", "y"))], 1)  # run again after its commit
    writer.commit(again, 1)  # committed twice with the same files
    assert texts(spark, path) == ["a", "b\nc", "x", "y", "é"]
    assert len(os.listdir(f"{path}/data")) == 4
    writer.commit([writer.write(alerts())], 2)
    assert len(texts(spark, path)) == 5


def test_a_stream_writes_each_alert_once(spark, tmp_path):
    source, path, check = (f"{tmp_path}/{x}" for x in ("in", "log", "check"))

    def run():
        stream = spark.readStream.schema(SCHEMA).json(source)
        al.start_alerts(stream, path, check).awaitTermination()

    for k in range(2):
        spark.createDataFrame([("A", datetime(2024, 1, 1, k), f"m{k}{i}") for i in range(3)], SCHEMA).write.mode("append").json(source)
        run()
    want = [f"m{k}{i}" for k in range(2) for i in range(3)]
    assert texts(spark, path) == want
    # as after a failure between the log's commit and that of the stream
    commits = sorted(f for f in os.listdir(f"{check}/commits") if f.isdigit())
    for name in (commits[-1], f".{commits[-1]}.crc"):
        if os.path.exists(f"{check}/commits/{name}"):
            os.unlink(f"{check}/commits/{name}")
    run()
    assert texts(spark, path) == want
    rows = al.read_alerts(spark, path, SCHEMA).orderBy("message").collect()
    assert [r.ts for r in rows[:4]] == [datetime(2024, 1, 1, 0)] * 3 + [datetime(2024, 1, 1, 1)]

"""The carriage counts as a stream: equal to the batch where nothing is late, late rows dropped."""

import datetime

from lateralis.streaming.carriage import carriage

DAY = datetime.datetime(2024, 1, 1)
SCHEMA = "ts timestamp, kind string"


def rows(*days):
    return [(DAY + datetime.timedelta(days=d, hours=1), k) for d, k in days]


def test_stream_equals_batch_and_drops_late_rows(spark, tmp_path):
    parts = [rows((0, "a"), (0, "a"), (1, "b")), rows((2, "a"), (20, "a")), rows((1, "b"), (21, "b")), rows((60, "z"))]
    source = tmp_path / "in"
    source.mkdir()
    stream = carriage(spark.readStream.schema(SCHEMA).parquet(str(source)), "ts", "kind", "1 day", "7 days")
    for part in parts:  # one batch each; the third holds a row that is late by then
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(source))
        run = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option(
            "checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start()
        assert run.awaitTermination(120) is True and run.exception() is None
    found = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()))
    on_time = [r for part in parts for r in part if r != rows((1, "b"))[0] or part is parts[0]]
    batch = carriage(spark.createDataFrame(on_time, SCHEMA), "ts", "kind", "1 day")
    assert found == sorted(tuple(r) for r in batch.collect() if r.kind != "z")  # the last window is still open

from conftest import SF
from pyspark.sql import functions as F

from isoreach.streaming.departures import windowed_departures


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").select("ts", (F.col("user_id") % 40).alias("stop_id"))
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    batch = {tuple(r) for r in windowed_departures(events).collect()}
    stream = windowed_departures(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.outputMode("update").format("memory").queryName("departures").option("checkpointLocation", str(tmp_path / "state")).start()
    q.processAllAvailable()
    q.stop()
    assert {tuple(r) for r in spark.sql("SELECT * FROM departures").collect()} == batch

import numpy as np
from brute import sample
from pyspark.sql import functions as F

from millrace.params import SGDLearn, SGDUpdate
from millrace.plans.sgd import train_sgd
from millrace.streaming.ftrl import StreamTrainer, windowed_counts

ROWS = "row_id bigint, label double, features array<struct<idx: bigint, val: double>>"


def test_a_stream_trains_as_batches_do(spark, tmp_path):
    df = spark.createDataFrame(sample(), ROWS)
    for i in range(2):
        df.filter(F.floor(F.col("row_id") / 20) == i).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{i}"))
    p = SGDUpdate(l1=0.01, lr=0.5)
    trainer = StreamTrainer(spark, str(tmp_path / "out"), p)
    stream = spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    trainer.start(stream, str(tmp_path / "check"), once=True).awaitTermination()
    got = {r.fid: r.w for r in trainer.model(1).collect()}
    want = {r.fid: r.w for r in train_sgd(df, SGDLearn(batch_size=20, num_jobs_per_epoch=1, shuffle=0, max_num_epochs=1), p).model.collect()}
    assert got.keys() == want.keys() and all(np.isclose(got[k], want[k]) for k in got)
    assert [r.rows for r in spark.read.parquet(str(tmp_path / "out" / "progress")).orderBy("batch").collect()] == [20, 20]
    before = sorted(trainer.model(1).collect(), key=lambda r: r.fid)
    trainer.step(df.filter("row_id >= 20"), 1)
    assert sorted(trainer.model(1).collect(), key=lambda r: r.fid) == before


def test_windows_over_a_stream(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-01 00:01:00", [(1, 1.0), (4097, 1.0)]), ("2024-01-01 00:04:59", [(8192, None)]), ("2024-01-01 00:05:00", [(0, 1.0)]), ("2024-01-01 00:07:00", None)], "at string, features array<struct<idx: bigint, val: double>>").withColumn("at", F.to_timestamp("at"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    want = sorted((str(r.begins), r.grp, r.nnz) for r in windowed_counts(rows, "at").collect())
    assert [x[1:] for x in want] == [(0, 1), (1, 2), (0, 1)]
    stream = windowed_counts(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), "at")
    q = stream.writeStream.format("memory").queryName("counted").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((str(r.begins), r.grp, r.nnz) for r in spark.table("counted").collect()) == want

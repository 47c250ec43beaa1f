"""A stream of files gives the rows of the batch."""

import random

import numpy as np

from contigra import streaming


def test_streams_give_the_rows_of_batches(spark, tmp_path):
    def network(tokens):
        x = (tokens % 3 == 1).mean(axis=1)
        return np.stack([x, 1 - x, x * 0], axis=1)

    rng = random.Random(3)
    rows = [(f"s{i}", "".join(rng.choice("ACGTN") for _ in range(rng.choice([30, 2600, 9000, 14_000])))) for i in range(24)]
    folder = f"file://{tmp_path}/in"
    for part in (rows[:10], rows[10:]):
        spark.createDataFrame(part, "seq_name string, seq string").coalesce(1).write.mode("append").parquet(folder)
    batch = spark.read.parquet(folder)
    for name, make in (("scores", lambda df: streaming.window_scores(df, network)), ("described", streaming.described)):
        stream = make(spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(folder))
        run = stream.writeStream.format("parquet").option("path", f"file://{tmp_path}/{name}").option("checkpointLocation", f"file://{tmp_path}/{name}-state").trigger(availableNow=True).start()
        assert run.awaitTermination(120) and len({p["batchId"] for p in run.recentProgress}) >= 2
        got = spark.read.parquet(f"file://{tmp_path}/{name}").collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, make(batch).collect())) and len(got) >= len(rows)

from collections import Counter

from tokenloom.streaming.counts import latest, write_counts


def test_counts_arrive_batch_by_batch(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    docs = ["the cat sat", "", None, "the dog"]
    expected = Counter()
    for k in range(2):
        spark.createDataFrame([(d,) for d in docs], "text string").coalesce(1).write.mode("append").parquet(source)
        expected += Counter(w for d in docs if d for w in d.split())
        stream = spark.readStream.schema("text string").parquet(source)
        write_counts(stream, out, str(tmp_path / "state")).awaitTermination()
        assert {r["token"]: r["n"] for r in latest(spark.read.parquet(out)).collect()} == expected

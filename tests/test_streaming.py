from pyspark.sql import functions as F

from marginalia.operators.phrase_search import search_phrases
from marginalia.plans.model import PhraseModel
from marginalia.streaming import search


def test_stream_equals_batch(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i} of the harbour mastr") for i in range(30)], "doc_id long, text string")
    docs.repartition(5).write.parquet(str(tmp_path / "in"))
    model = PhraseModel(["harbour master"])
    matches = search.stream_matches(search.stream_documents(spark, str(tmp_path / "in"), files_per_trigger=2), model)
    search.write_matches(matches, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    key = lambda df: sorted((r.doc_id, r.offset, r.string) for r in df.collect())
    assert key(spark.read.parquet(str(tmp_path / "out"))) == key(search_phrases(docs, model))


def test_windowed_counts(spark, tmp_path):
    rows = [(1, "p", "2024-01-01 00:01:00"), (2, "p", "2024-01-01 00:09:00"), (3, "p", "2024-01-01 00:11:00")]
    spark.createDataFrame(rows, "doc_id long, phrase string, ts string").select("doc_id", "phrase", F.to_timestamp("ts").alias("ts")).write.parquet(str(tmp_path / "in"))
    stream = search.stream_documents(spark, str(tmp_path / "in"), "doc_id long, phrase string, ts timestamp")
    q = search.windowed_counts(stream, "ts").writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.matches for r in spark.table("counted").collect()) == [1, 2]

"""What grows with the table is not broadcast: it would pass through the driver."""

from pyspark.sql import functions as F

from filelake.llm import simhash


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_simhash_broadcasts_no_keys_and_no_groups(spark, tmp_path):
    nodes = spark.range(50).select((F.col("id") * 0x9E3779B97F4A7).alias("fp"), (F.col("id") * 0x9E3779B97F4A7).alias("node"))
    assert "Broadcast" not in plan(simhash.links(nodes))
    assert "Broadcast" not in plan(simhash.near_groups(nodes.select(F.lit(1).cast("long").alias("doc_id"), "fp", F.lit(0).cast("long").alias("uid"))))
    spark.createDataFrame([(1, "a b c d e"), (2, "a b c d e")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert "Broadcast" not in plan(simhash.op5_simhash(spark, str(tmp_path)))


def test_near_copies_go_without_a_broadcast(spark):
    docs = spark.createDataFrame([(1, "a b c d e"), (2, "a b c d e"), (None, "else")], "doc_id long, text string")
    kept = simhash.drop_near_duplicates(docs)
    assert "Broadcast" not in plan(kept) and sorted(r.text for r in kept.collect()) == ["a b c d e", "else"]

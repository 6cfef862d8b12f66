from pyspark.sql import functions as F

from tallywick.streaming.refresh import daily_revenue_stream, rollup_stream


def test_rollup_and_days_follow_the_stream(spark, tmp_path):
    rows = [("a", "2024-01-01", 1.0), ("a", "2024-01-03", 2.0), ("b", "2024-01-03", 4.0)]
    df = spark.createDataFrame(rows, "customer_id string, order_date string, amount double").withColumn("order_date", F.col("order_date").cast("timestamp_ntz"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    for name, made in (("per_customer", rollup_stream(stream)), ("per_day", daily_revenue_stream(stream))):
        q = made.writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None
    assert {(r.customer_id, r.frequency, r.monetary) for r in spark.table("per_customer").collect()} == {("a", 2, 3.0), ("b", 1, 4.0)}
    assert sorted(r.revenue for r in spark.table("per_day").collect()) == [1.0, 6.0]

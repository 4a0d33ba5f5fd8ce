from pyspark.sql import functions as F

from citeloom.streaming import drops


def test_redelivery_is_dropped(spark, sf, tmp_path):
    one = spark.read.parquet(f"{sf}/bib_entries.parquet").withColumn("loaded_at", F.to_timestamp(F.lit("2024-01-01 00:00:00")))
    src = str(tmp_path / "in")
    one.write.parquet(src)
    one.withColumn("loaded_at", F.to_timestamp(F.lit("2024-01-02 00:00:00"))).write.mode("append").parquet(src)
    stream = drops.new_entries(drops.deliveries(spark, src, one.schema))
    out = str(tmp_path / "out")
    drops.append_to(stream, out, str(tmp_path / "cp")).awaitTermination(120)
    assert spark.read.parquet(out).count() == one.select("entry_id").distinct().count()


def test_counts(spark, sf, tmp_path):
    one = spark.read.parquet(f"{sf}/bib_entries.parquet")
    src = str(tmp_path / "in")
    one.write.parquet(src)
    counts = drops.delivery_counts(drops.deliveries(spark, src, one.schema).withColumn("loaded_at", F.col("loaded_at").cast("timestamp")))
    q = counts.writeStream.format("memory").queryName("deliveries").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("deliveries").agg(F.sum("n")).first()[0] == one.count()

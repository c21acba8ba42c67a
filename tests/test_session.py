"""What the planner knows of a table whose lineage was cut."""

from pyspark.sql import functions as F

from claimloom.session import cut_lineage


def size_seen(df):
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def test_a_cut_table_is_sized_by_its_files(spark):
    table = cut_lineage(spark.range(2000).withColumn("x", F.col("id") % 5))
    begun = size_seen(table)
    assert 2000 * 2 < begun < 2000 * 400
    for _ in range(6):
        # a join's size is estimated as a product: after six rounds it had 64 times the digits
        table = cut_lineage(table.join(table.select("id", F.col("x").alias("y")), "id").select("id", "x"))
    assert table.count() == 2000 and size_seen(table) < 2 * begun


def test_a_cut_table_is_not_sized_too_low_after_an_explode(spark):
    grown = spark.range(1, 20, 1, 1).select(F.explode(F.sequence(F.lit(1), F.lit(5000))).alias("x"), F.xxhash64("id").alias("h"))
    cut = cut_lineage(grown.select("x", F.xxhash64("h", "x").alias("h")))
    assert size_seen(cut) > 19 * 5000 * 16


def test_joins_with_an_empty_cut_table_do_not_seem_empty(spark):
    empty = cut_lineage(spark.range(0).toDF("id"))
    assert size_seen(spark.range(1000).join(empty, "id", "left")) >= 8000 and empty.isEmpty()

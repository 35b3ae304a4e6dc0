"""The cuts of a string dimension are quantiles of all rows."""

from pyspark.sql import functions as F

from tessera.llm import sharding


def test_cuts_of_strings_come_from_all_rows(spark):
    rows = 30_011
    value = F.format_string("source-%05d", (F.col("id") * F.col("id")) % 20_011)
    keyed = spark.range(rows).select(F.when(F.col("id") % 3 == 0, "source-00500").otherwise(value).alias("__0"), F.xxhash64("id").alias("text_key"))
    own = sorted(x["__0"] for x in keyed.select("__0").collect())
    want = [own[-(-k * rows // 64) - 1] for k in range(1, 64)]
    assert sharding._cuts(keyed.unionByName(keyed.limit(1).select(F.lit(None).cast("string").alias("__0"), "text_key")), "__0") == want
    assert sharding._cuts(keyed.limit(0), "__0") == []
    few = spark.createDataFrame([("a",)] * 3 + [("b",)], "`__0` string").withColumn("text_key", F.lit(1))
    assert sharding._cuts(few, "__0") == ["a"] * 48 + ["b"] * 15

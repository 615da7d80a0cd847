"""Details folded in for many products that name the same few values."""

from pyspark.sql import functions as F

from ledgerlight.operators import catalog


def test_products_that_name_one_value_are_dealt_not_broadcast(spark):
    red = F.concat(F.lit("Color: red; n"), F.col("id") % 2)
    features = F.when(F.col("id") % 5 == 0, F.lit(None)).otherwise(F.array(red, F.lit("100% cotton"), F.lit("odd sole")))
    own = F.when(F.col("id") % 2 == 0, F.array(F.struct(F.lit("material").alias("key"), F.lit("cotton").alias("value"))))
    items = spark.range(600).select("id", features.alias("features"), own.alias("details"))
    keyed = catalog.known_keyed_values(catalog.keyed_pairs(items))
    assert [tuple(r) for r in keyed.collect()] == [("color", "red")]
    known = spark.createDataFrame([("cotton",), ("wool",)], "token string")
    out = catalog.folded_details(items, known, spark.createDataFrame([("color", "red")], "attribute string, value string"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan  # rows of products are as many as the products
    cotton, color = ("material", "cotton"), ("color", "red")
    for r in out.collect():
        had = [cotton] if r["id"] % 2 == 0 else []
        told = [] if r["id"] % 5 == 0 else [d for d in (cotton, color) if d not in had]
        assert [tuple(d) for d in r["details"]] == had + told
    assert out.count() == 600

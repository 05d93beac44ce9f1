"""Queries that answer for every row of their tables."""

from pyspark.sql import functions as F

from nodelake.plans import registry

SF01 = "/root/testdata/sf0.01"


def test_strides_reach_every_row(spark):
    n = spark.read.parquet(f"{SF01}/embeddings.parquet").count()
    found = registry.QUERIES["n_strides_all"](spark, SF01)
    assert n > 50 and sorted(r["flat"] for r in found.collect()) == list(range(n * 64))


def test_documents_have_all_three_kinds_of_line(spark):
    found = registry.QUERIES["s_documents_all"](spark, SF01)
    kinds = {r["kind"]: r["count"] for r in found.groupBy(F.get_json_object("line", "$.name").alias("kind")).count().collect()}
    orders, items = (spark.read.parquet(f"{SF01}/{t}.parquet") for t in ("orders", "lineitem"))
    own = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
    assert kinds == {"start": orders.count(), "descriptor": own.select("l_orderkey", "l_linestatus").distinct().count(), "stop": own.select("l_orderkey").distinct().count()}


def test_runs_are_all_there_newest_first(spark):
    found = [(r["time"], r["uid"]) for r in registry.QUERIES["l_runs_all"](spark, SF01).select("time", "uid").collect()]
    assert len(found) == spark.read.parquet(f"{SF01}/orders.parquet").count() > 20
    assert [t for t, _ in found] == sorted((t for t, _ in found), reverse=True)

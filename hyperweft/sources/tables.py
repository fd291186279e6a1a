"""Hypergraphs from star-schema tables: incidence(edge_id, node_id), weights and fixed clusterings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def order_incidence(spark: SparkSession, folder: str) -> DataFrame:
    """Parts as nodes, orders as hyperedges."""
    return table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("edge_id"), F.col("l_partkey").alias("node_id")).distinct()


def order_weights(spark: SparkSession, folder: str) -> DataFrame:
    """(edge_id, weight): an order's quantity."""
    return table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("edge_id")).agg(F.sum("l_quantity").cast("long").alias("weight"))


def mixed_incidence(spark: SparkSession, folder: str) -> DataFrame:
    """Users as nodes; a dense hyperedge per day d, and sparse ones 1000 + 5 d + r per day and rank r of event type."""
    events = table(spark, folder, "events")
    first = events.agg(F.min(F.to_date("ts")).alias("first"))
    types = events.select("event_type").distinct()
    # Event types are a handful of names; their rank is a count of smaller ones.
    ranks = types.alias("a").join(F.broadcast(types.alias("b")), F.col("b.event_type") < F.col("a.event_type"), "left")
    ranks = ranks.groupBy(F.col("a.event_type").alias("event_type")).agg(F.count("b.event_type").alias("r"))
    e = events.select("user_id", "event_type", F.to_date("ts").alias("day")).join(F.broadcast(first)).join(F.broadcast(ranks), "event_type")
    d = F.datediff("day", "first").cast("long")
    return e.select(F.explode(F.array(d, 1000 + 5 * d + F.col("r"))).alias("edge_id"), F.col("user_id").alias("node_id")).distinct()


def mixed_node_clusters(inc: DataFrame) -> DataFrame:
    return inc.select("node_id").distinct().withColumn("rc", F.col("node_id") % 10)


def mixed_edge_clusters(inc: DataFrame) -> DataFrame:
    """Day edges by day modulo 7, typed ones apart from them by 7 + id modulo 15."""
    e = F.col("edge_id")
    return inc.select("edge_id").distinct().withColumn("cc", F.when(e < 1000, e % 7).otherwise(7 + e % 15))

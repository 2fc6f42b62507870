"""A small customer dataset that is made from its ids alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def pick(key, cases: dict, other):
    out = None
    for k, v in cases.items():
        out = F.when(key == k, v) if out is None else out.when(key == k, v)
    return out.otherwise(other)


def tables(spark: SparkSession, n: int = 48) -> dict[str, DataFrame]:
    ids = spark.range(1, n + 1).withColumnRenamed("id", "customer_id")
    i = F.col("customer_id")
    customers = ids.select(
        "customer_id",
        F.concat(F.lit("Customer "), i.cast("string")).alias("name"),
        pick(i % 4, {0: "APAC", 1: "EMEA", 2: "AMER"}, "LATAM").alias("region"),
        (2018 + i % 6).alias("signup_year"),
        F.when(i % 5 == 0, "Churned").otherwise("Active").alias("status"),
    )
    subscriptions = customers.select(
        i.alias("subscription_id"), "customer_id", pick(i % 3, {0: "Enterprise", 1: "Basic"}, "Pro").alias("plan"), pick(i % 3, {0: 100, 1: 10}, 30).alias("monthly_fee"), (F.col("status") == "Active").alias("active")
    )
    each = ids.select("customer_id", F.explode(F.sequence(F.lit(1).cast("long"), i % 3 + 1)).alias("k"))
    tickets = each.select(
        F.row_number().over(Window.orderBy("customer_id", "k")).cast("long").alias("ticket_id"), "customer_id", pick(i % 3, {0: "high", 1: "low"}, "medium").alias("priority"), (i % 2 == 0).alias("resolved")
    )
    regions = spark.createDataFrame([("APAC", "Singapore"), ("EMEA", "Germany"), ("AMER", "United States"), ("LATAM", "Brazil")], "region string, country string")
    return {"regions": regions, "customers": customers, "subscriptions": subscriptions, "support_tickets": tickets}


def export(spark: SparkSession, folder: str, n: int = 48) -> None:
    for name, df in tables(spark, n).items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")

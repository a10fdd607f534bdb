"""Driver-table readers and the entity x period panel views built from them."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def money(c) -> F.Column:
    """Money aggregated exactly: decimal(18,2), never a float sum."""
    return F.col(c).cast("decimal(18,2)") if isinstance(c, str) else c.cast("decimal(18,2)")


def customer_year_panel(orders: DataFrame) -> DataFrame:
    """Long panel: one row per (customer, order year) with order totals.

    A map-side partial aggregate collapses a hot customer before any shuffle.
    """
    return (orders.groupBy(F.col("o_custkey"), F.year("o_orderdate").alias("o_year"))
            .agg(F.sum(money("o_totalprice")).alias("total"),
                 F.count(F.lit(1)).alias("n_orders")))

"""Extensions across calls: break points, success templates, cubes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def breakpoints(checklist: DataFrame) -> DataFrame:
    """Per check: how many calls met it, missed it, and lost it first (the first hard check that was not met)."""
    hard_miss = (F.col("tier") == "hard") & (F.col("status") == "not_met")
    first = F.min(F.when(hard_miss, F.col("seq"))).over(Window.partitionBy("call_id"))
    return checklist.withColumn("first", first).groupBy("id").agg(F.count_if(F.col("status") == "met").alias("met"), F.count_if(F.col("status") == "not_met").alias("missed"), F.count_if(F.col("seq") == F.col("first")).alias("broke_here"))


def success_template(checklist: DataFrame) -> DataFrame:
    """Per check: the share of calls that met it among deals and among the rest, 4 decimals."""
    deal = F.max(F.when(F.col("id") == "deal", F.col("status") == "met")).over(Window.partitionBy("call_id"))
    met = F.when(F.col("status") == "met", 1.0).otherwise(0.0)
    return checklist.withColumn("deal", F.coalesce(deal, F.lit(False))).filter(F.col("status") != "na").groupBy("id").agg(F.round(F.avg(F.when(F.col("deal"), met)), 4).alias("met_in_deals"), F.round(F.avg(F.when(~F.col("deal"), met)), 4).alias("met_elsewhere"))


def status_cube(checklist: DataFrame) -> DataFrame:
    return checklist.cube("tier", "status").agg(F.count("*").alias("rows"), F.countDistinct("call_id").alias("calls"))

"""Rank columns over a window partition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def min_rank(value: Column, by: list[str], descending: bool = True) -> Column:
    """1 for the first; ties share the least rank."""
    return F.rank().over(Window.partitionBy(*by).orderBy(value.desc() if descending else value.asc()))


def mid_rank(value: Column, by: list[str], descending: bool = False) -> Column:
    """Ties share the mean of their ranks."""
    ties = F.count(F.lit(1)).over(Window.partitionBy(*by, value))
    return min_rank(value, by, descending) + (ties - 1) / F.lit(2.0)


def tied(value: Column, by: list[str]) -> Column:
    return F.count(F.lit(1)).over(Window.partitionBy(*by, value)) > 1


def with_bh(df: DataFrame, p: str, by: list[str], name: str = "p_adj") -> DataFrame:
    """``df`` with Benjamini-Hochberg adjusted ``p`` over each family ``by``; nulls stay null and don't count."""
    family = Window.partitionBy(*by)
    known = F.col(p).isNotNull()
    out = df.withColumn("_bh_m", F.count(p).over(family)).withColumn("_bh_r", F.row_number().over(family.orderBy(F.col(p).asc_nulls_last())))
    down = family.orderBy(F.col("_bh_r").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = out.withColumn(name, F.when(known, F.least(F.lit(1.0), F.min(F.when(known, F.col(p) * F.col("_bh_m") / F.col("_bh_r"))).over(down))))
    return out.drop("_bh_m", "_bh_r")


def tie_term(value: Column, by: list[str]) -> Column:
    """Per row t² - 1 of its tie group, so that the sum over a partition is the sum of t³ - t over groups."""
    t = F.count(F.lit(1)).over(Window.partitionBy(*by, value)).cast("double")
    return t * t - 1

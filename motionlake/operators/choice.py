"""Choices among sources by what a whole group of rows is like: one shuffle for all sources, whatever their number."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_usable(sources: list[DataFrame], keys: list[str], usable: Column, mock: DataFrame | None = None) -> DataFrame:
    """Each key's rows of the first source in which any of its rows is usable, with place (of the source, from 0) and mock.

    Keys that no source serves take the mock's rows, if there are any, else they have none. Sources may lack columns.
    """
    ranked = [df.withColumns({"place": F.lit(k), "mock": F.lit(False), "usable": F.coalesce(usable, F.lit(False))}) for k, df in enumerate(sources)]
    if mock is not None:
        ranked.append(mock.withColumns({"place": F.lit(len(sources)), "mock": F.lit(True), "usable": F.lit(True)}))
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), ranked)
    best = F.min(F.when(F.col("usable"), F.col("place"))).over(Window.partitionBy(*keys))
    return rows.withColumn("best", best).where("place = best").drop("best", "usable")


def replaced(rows: DataFrame, better: DataFrame, keys: list[str], part: Column) -> DataFrame:
    """rows, but for keys that have better rows, these instead of the rows of that part; other rows stay."""
    both = rows.withColumn("is_better", F.lit(False)).unionByName(better.withColumn("is_better", F.lit(True)), allowMissingColumns=True)
    any_better = F.max("is_better").over(Window.partitionBy(*keys))
    stays = F.col("is_better") | ~any_better | ~F.coalesce(part, F.lit(False))
    return both.withColumn("stays", stays).where("stays").drop("stays", "is_better")

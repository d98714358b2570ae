"""Joins that hold whatever share of the rows one key has."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def joined_by_weight(rows: DataFrame, table: DataFrame, key: list[str], weight: str, share: int = 1000) -> DataFrame:
    """rows with the other columns of table, which has one row per key and, as weight, how many rows have it.

    A key of at least one in share rows is heavy; there are share of those at
    most, so they are broadcast. The others meet by shuffle, to which heavy rows
    go spread out. Null keys are equal. A row whose key is not in table is dropped.
    """
    total = table.agg(F.sum(weight)).first()[0] or 0
    rest = F.struct(*[c for c in table.columns if c not in key])
    heavy = F.col(weight) * share >= total
    same = lambda side: [F.col(k).eqNullSafe(F.col(f"_{side}_{k}")) for k in key]
    side = lambda name, which: table.where(which).select(*[F.col(k).alias(f"_{name}_{k}") for k in key], rest.alias(f"_{name}"))
    met = rows.join(F.broadcast(side("heavy", heavy)), same("heavy"), "left")
    met = met.withColumn("_spread", F.when(F.col("_heavy").isNotNull(), F.xxhash64(*rows.columns)).otherwise(F.lit(0).cast("long")))
    light = side("light", ~heavy).withColumn("_zero", F.lit(0).cast("long"))
    met = met.join(light, [*same("light"), F.col("_spread") == F.col("_zero")], "left").withColumn("_met", F.coalesce("_heavy", "_light"))
    return met.where("_met is not null").select(*rows.columns, "_met.*")

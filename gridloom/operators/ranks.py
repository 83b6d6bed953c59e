"""Places and quantiles by a sort dealt to ranges: no key's values are ever in one buffer or one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.store import keep
from gridloom.operators.joins import small


def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with their ``place`` from 0 in an order: sorted in ranges, each of which counts on from where the one before ends."""
    part = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    part = keep(part.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at")), "placed")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # a row for each range
    sizes = part.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    return part.join(F.broadcast(sizes.drop("_n")), "_part").withColumn("place", F.col("_at") - F.col("_first") + F.col("_before")).drop("_part", "_at", "_first", "_before")


def joined(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join on equal keys where a null equals a null; the keys are the left ones."""
    there = right.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    return left.join(there, [left[k].eqNullSafe(there[f"_k_{k}"]) for k in keys], how).drop(*[f"_k_{k}" for k in keys])


def quantiles(rows: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Exact quantiles, linear between values, of each key's values that are not null: a column for each name in ``shares``."""
    sorted_ = placed(rows.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v")), [*by, "_v"])
    ends = sorted_.groupBy(*by).agg(F.min("place").alias("_from"), F.count("*").alias("_n"))
    at = {name: F.lit(float(p)) * (F.col("_n") - 1) for name, p in shares.items()}
    ranked = joined(sorted_, small(ends), by).withColumn("_rank", F.col("place") - F.col("_from"))
    # two values are needed for each share
    some = ranked.where(reduce(lambda a, b: a | b, [F.col("_rank").isin(F.floor(x), F.ceil(x)) for x in at.values()]))
    low = {n: F.max(F.when(F.col("_rank") == F.floor(x), F.col("_v"))).alias(f"_l{n}") for n, x in at.items()}
    high = {n: F.max(F.when(F.col("_rank") == F.ceil(x), F.col("_v"))).alias(f"_h{n}") for n, x in at.items()}
    out = some.groupBy(*by).agg(F.max("_n").alias("_n"), *low.values(), *high.values())
    return out.select(*by, *[(F.col(f"_l{n}") + (F.col(f"_h{n}") - F.col(f"_l{n}")) * (x - F.floor(x))).alias(n) for n, x in at.items()])

"""Exact quantiles without a task that sees all values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.runtime import materialize

BUCKETS = 65_536


def exact_quantiles(rows: DataFrame, value: Column, fractions: list[float], group: str, buckets: int = BUCKETS) -> DataFrame:
    """``(group, n, q)``: per group the number of values and the array of its exact, linearly interpolated quantiles.

    Values are counted in equal-width buckets between the group's extremes (partial sums, at most ``buckets`` rows a group are
    shuffled); only the buckets in which a wanted rank falls are sorted, each in a task of its own. Null and NaN values do
    not count; a group without values has no row.
    """
    v = rows.select(F.col(group).alias("g"), value.cast("double").alias("v")).where("v is not null and not isnan(v)")
    v = materialize(v, "quantile-values")
    bounds = v.groupBy("g").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    share = (F.col("v") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0))
    placed = v.alias("v").join(bounds.alias("x"), F.expr("v.g <=> x.g")).select("v.g", "v", "n", F.least(F.lit(buckets - 1), F.coalesce(F.floor(share * buckets), F.lit(0))).cast("int").alias("b"))
    hist = placed.groupBy("g", "n", "b").agg(F.count("*").alias("c"))
    before = F.sum("c").over(Window.partitionBy("g").orderBy("b").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("c")
    at = [F.lit(f) * (F.col("n") - 1) for f in fractions]
    ranks = F.array_distinct(F.array(*[f(p).cast("bigint") for p in at for f in (F.floor, F.ceil)]))
    wanted = hist.withColumns({"before": before, "ranks": ranks})
    wanted = wanted.withColumn("ranks", F.filter("ranks", lambda r: (r >= F.col("before")) & (r < F.col("before") + F.col("c")))).where(F.size("ranks") > 0)
    near = placed.alias("p").join(wanted.alias("w"), F.expr("p.g <=> w.g and p.b = w.b")).select("p.g", "p.n", "p.b", "p.v", "w.before", "w.ranks")
    rank = F.row_number().over(Window.partitionBy("g", "b").orderBy("v")) - 1 + F.col("before")
    hit = near.withColumn("r", rank).where(F.array_contains("ranks", F.col("r")))
    found = hit.groupBy("g", "n").agg(F.map_from_entries(F.collect_list(F.struct("r", "v"))).alias("m"))

    def between(p: Column) -> Column:
        low, high = F.element_at("m", F.floor(p).cast("bigint")), F.element_at("m", F.ceil(p).cast("bigint"))
        return low + (p - F.floor(p)) * (high - low)

    return found.select(F.col("g").alias(group), "n", F.array(*[between(p) for p in at]).alias("q"))

"""Score cutoffs that keep a target fraction of each source.

The cutoff of a source with n scores is its k-th largest score, k = ceil(keep_pct * n / 100): the order statistic that
minimises the convex pinball loss F(t) = sum(max(v - t, 0)) + (k - 1/2) t. A cutting-plane search keeps, per source, a
point on either side of the minimum with its loss and subgradient, evaluates the loss where the two tangents meet, and
snaps to the exact neighbouring score as soon as one score is left between them. One pass over the (source, score,
count) table moves all sources at once; only aggregates leave the executors, however large a source is.

Defined cases: scores that are missing take no part; a source without scores has no cutoff; ``keep_pct`` above 100
counts as 100 and one that needs no record keeps those of the highest score; null or unlisted ``keep_pct`` -> the ``*``
row's, and without one no cutoff; scores equal to the cutoff are all kept; empty input -> empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.contributor_cap import with_target
from corpusloom.runtime import broadcast_if_small, materialize

_STATE = ["source", "n", "k", "cutoff", "a", "fa", "ga", "above", "b", "fb", "gb", "below", "turn"]


def _step(hist: DataFrame, state: DataFrame) -> DataFrame:
    """One evaluation of loss and subgradient for every source that has no cutoff yet."""
    # where the tangents meet; each third turn, and where rounding leaves the bracket, the middle of the scores left
    meet = (F.col("fb") - F.col("fa") + F.col("ga") * F.col("a") - F.col("gb") * F.col("b")) / (F.col("ga") - F.col("gb"))
    middle = F.col("above") + (F.col("below") - F.col("above")) / 2
    t = F.when((F.col("turn") % 3 < 2) & (meet >= F.col("above")) & (meet <= F.col("below")), meet).otherwise(middle)
    trial = state.where("cutoff is null").withColumn("t", t)
    v, c, tt = F.col("v"), F.col("c"), F.col("t")
    seen = (
        hist.join(trial.select(F.col("source").alias("_s"), "t"), F.col("source") == F.col("_s"))
        .groupBy("source")
        .agg(
            F.sum(F.when(v > tt, c).otherwise(0)).alias("over"),
            F.sum(F.when(v >= tt, c).otherwise(0)).alias("at_least"),
            F.sum(F.when(v > tt, c * (v - tt)).otherwise(0.0)).alias("excess"),
            F.max(F.when(v < tt, v)).alias("prev"),
            F.min(F.when(v > tt, v)).alias("next"),
        )
    )
    k = F.col("k")
    loss = F.col("excess") + (k - 0.5) * tt
    up = F.col("over") >= k  # the minimum lies above t
    down = F.col("at_least") < k
    moved = trial.join(seen.withColumnRenamed("source", "_s"), F.col("source") == F.col("_s")).select(
        "source",
        "n",
        "k",
        F.when(~up & ~down, tt).alias("cutoff"),
        F.when(up, tt).otherwise(F.col("a")).alias("a"),
        F.when(up, loss).otherwise(F.col("fa")).alias("fa"),
        F.when(up, k - 0.5 - F.col("over")).otherwise(F.col("ga")).alias("ga"),
        F.when(up, F.col("next")).otherwise(F.col("above")).alias("above"),
        F.when(down, tt).otherwise(F.col("b")).alias("b"),
        F.when(down, loss).otherwise(F.col("fb")).alias("fb"),
        F.when(down, k - 0.5 - F.col("at_least")).otherwise(F.col("gb")).alias("gb"),
        F.when(down, F.col("prev")).otherwise(F.col("below")).alias("below"),
        (F.col("turn") + 1).alias("turn"),
    )
    snapped = moved.withColumn("cutoff", F.coalesce("cutoff", F.when(F.col("above") == F.col("below"), F.col("above"))))
    return snapped.select(*_STATE)


def score_cutoffs(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """``(source, cutoff, n, wanted, kept)`` per source; ``rows`` has ``source`` and ``score``, one row per record."""
    hist = materialize(
        rows.where("source is not null and score is not null").groupBy("source", F.col("score").alias("v")).agg(F.count("*").alias("c")),
        "score-counts",
    )
    bounds = hist.groupBy("source").agg(
        F.sum("c").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.sum(F.col("c") * F.col("v")).alias("_sum")
    )
    pct = F.least(F.col("target"), F.lit(100))
    k = F.greatest(F.floor((pct * F.col("n") + 99) / 100).cast("bigint"), F.lit(1))
    start = with_target(bounds, targets, "keep_pct", "source").where("target is not null").withColumn("k", k)
    a, b = F.col("lo") - 1, F.col("hi") + 1
    state = start.select(
        "source",
        "n",
        "k",
        F.when(F.col("lo") == F.col("hi"), F.col("lo")).alias("cutoff"),
        a.alias("a"),
        (F.col("_sum") - F.col("n") * a + (F.col("k") - 0.5) * a).alias("fa"),
        (F.col("k") - 0.5 - F.col("n")).cast("double").alias("ga"),
        F.col("lo").alias("above"),
        b.alias("b"),
        ((F.col("k") - 0.5) * b).cast("double").alias("fb"),
        (F.col("k") - 0.5).cast("double").alias("gb"),
        F.col("hi").alias("below"),
        F.lit(0).alias("turn"),
    )
    found = []
    while True:
        state = materialize(state, "cutoff-state")
        found.append(state.where("cutoff is not null"))
        if state.where("cutoff is null").isEmpty():
            break
        state = _step(hist, state)
    cut = found[0]
    for part in found[1:]:
        cut = cut.unionByName(part)
    cut = materialize(cut.select("source", "cutoff", "n", F.col("k").alias("wanted")), "cutoffs")
    side = broadcast_if_small(cut.select(F.col("source").alias("_s"), "cutoff"))
    kept = hist.join(side, F.col("source") == F.col("_s")).where("v >= cutoff").groupBy("source").agg(F.sum("c").alias("kept"))
    return cut.join(kept, "source")


def kept_by_cutoff(rows: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """Rows whose score reaches their source's cutoff."""
    side = broadcast_if_small(cutoffs.select(F.col("source").alias("_s"), F.col("cutoff").alias("_t")))
    return rows.join(side, F.col("source") == F.col("_s")).where(F.col("score") >= F.col("_t")).select(*rows.columns)

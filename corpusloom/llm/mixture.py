"""Mixing sources to target weights.

1. Documents of a listed source are ordered by a seeded hash within shards and cut into blocks of about ``block`` tokens.
2. Sainte-Lague apportionment hands out the mixture's tokens in equal portions (``block``, or a 10,000th of the mixture where
   that is less): one after the other to the highest quotient weight / (2 * given + 1), as long as the source has tokens
   left, repeats included. The same rule gives each source's portions to its shards, with the shards' tokens as weights.
3. A shard takes whole rounds of all its documents as often as its quota holds them, then blocks of lowest seeded hash as long
   as they fit whole. Of the next blocks, the edge, it takes those documents that together come nearest to what is left, never above.

Unless a size is given, the mixture is the largest in which every source that has documents reaches its share.

Defined cases: sources not listed (null included) are left out; a listed source without tokens, or of weight 0 or null,
is reported with 0; ``max_repeats`` null or below 1 allows none; documents without tokens are never drawn; repeated
identifiers count as separate documents; empty input -> a report of zeros and no documents.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.runtime import broadcast_if_small, materialize

SHARD_DOCS = 20_000
BLOCK = 4_096
PORTIONS = 10_000  # into which a mixture is handed out at least
EDGE = 4  # blocks beyond the need from which a shard's last documents are picked


def sainte_lague(weights: list[float], limits: list[int], seats: int) -> list[int]:
    """Seats per weight, to the highest quotients, none beyond its limit; fewer in all when the limits are reached.

    Whole multiples are given at once where no rounding can differ, the rest one by one.
    """
    given = [0] * len(weights)
    total = sum(w for w, most in zip(weights, limits) if most > 0)
    if total <= 0:
        return given
    for i, (w, most) in enumerate(zip(weights, limits)):
        given[i] = max(0, min(most, int(seats * w / total) - len(weights)))
    heap = [(-w / (2 * g + 1), i) for i, (w, g, most) in enumerate(zip(weights, given, limits)) if w > 0 and g < most]
    heapq.heapify(heap)
    for _ in range(max(0, seats - sum(given))):
        if not heap:
            break
        _, i = heapq.heappop(heap)
        given[i] += 1
        if given[i] < limits[i]:
            heapq.heappush(heap, (-weights[i] / (2 * given[i] + 1), i))
    return given


def _shard_quotas(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("shard")
    portion = int(rows["portion"].iloc[0])
    quota = sainte_lague(rows["tokens"].tolist(), (rows["tokens"] * rows["repeats"] // portion).tolist(), int(rows["seats"].iloc[0]))
    quota = pd.Series(quota, index=rows.index, dtype="int64") * portion
    return rows.assign(rounds=quota // rows["tokens"], rest=quota % rows["tokens"])[["source", "shard", "rounds", "rest"]]


def _last_documents(rows: pd.DataFrame) -> pd.DataFrame:
    """Of a shard's edge the documents whose tokens sum up nearest to, and not above, what its whole blocks leave open."""
    rows = rows.sort_values(["turn", "id"])
    room = int(rows["room"].iloc[0])
    whole, reach = (1 << room + 1) - 1, [1]
    for n in rows["tokens"].tolist():
        reach.append(reach[-1] | (reach[-1] << n & whole) if n <= room else reach[-1])
    left, taken = reach[-1].bit_length() - 1, []
    for i in range(len(rows) - 1, -1, -1):
        take = not reach[i] >> left & 1
        taken.append(take)
        left -= int(rows["tokens"].iloc[i]) if take else 0
    return rows[taken[::-1]][["id"]]


def mix(docs: DataFrame, targets: DataFrame, seed: int = 7, size: int | None = None, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """The mixture ``(id, source, tokens, times)`` and the report per listed source; ``docs`` has ``id, source, tokens``."""
    spark = docs.sparkSession
    listed = targets.where("source is not null").groupBy("source").agg(
        F.coalesce(F.max("weight_pct"), F.lit(0)).cast("double").alias("weight"), F.greatest(F.coalesce(F.max("max_repeats"), F.lit(0)), F.lit(0)).alias("repeats")
    )
    side = broadcast_if_small(listed)
    here = docs.where("tokens > 0").join(side, "source").select("id", "source", "tokens")
    shards = max(1, -(-docs.count() // SHARD_DOCS))
    draw = F.xxhash64(F.col("id"), F.lit(seed))
    place = Window.partitionBy("source", "shard").orderBy("draw", "id")
    cut = here.withColumns({"draw": draw, "shard": F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")})
    before = F.sum("tokens").over(place.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("tokens")
    blocks = materialize(cut.withColumn("block", F.floor(before / F.lit(block))).drop("draw"), "mixture-blocks")
    per_block = blocks.groupBy("source", "shard", "block").agg(F.sum("tokens").alias("tokens"))
    per_shard = per_block.groupBy("source", "shard").agg(F.sum("tokens").alias("tokens"))

    # a row per listed source: what the target table bounds
    sums = {r.source: r.tokens for r in per_shard.groupBy("source").agg(F.sum("tokens").alias("tokens")).collect()}
    active = [r for r in listed.sort("source").collect() if r.weight > 0 and r.repeats > 0 and r.source in sums]
    weight = sum(r.weight for r in active)
    if size is None:
        size = int(min((sums[r.source] * r.repeats * weight / r.weight for r in active), default=0))
    portion = max(1, min(block, size // PORTIONS))
    given = sainte_lague([r.weight for r in active], [sums[r.source] * r.repeats // portion for r in active], size // portion)
    seats = [(r.source, g, int(r.repeats), portion) for r, g in zip(active, given) if g] or [("", 0, 0, 1)]
    seated = spark.createDataFrame(seats, "source string, seats bigint, repeats int, portion bigint")
    quota = per_shard.join(broadcast_if_small(seated), "source").groupBy("source").applyInPandas(_shard_quotas, "source string, shard int, rounds bigint, rest bigint")

    turns = Window.partitionBy("source", "shard").orderBy(F.xxhash64("shard", "block", F.lit(seed)), "block")
    numbered = per_block.withColumns({"turn": F.row_number().over(turns), "upto": F.sum("tokens").over(turns.rowsBetween(Window.unboundedPreceding, Window.currentRow))})
    placed = numbered.join(quota, ["source", "shard"])
    shard = Window.partitionBy("source", "shard")
    fit = F.col("upto") <= F.col("rest")
    edges = placed.withColumns({"full": F.count_if(fit).over(shard), "room": F.col("rest") - F.coalesce(F.max(F.when(fit, F.col("upto"))).over(shard), F.lit(0))})
    # the edge: blocks to fill the room once, and EDGE more; blocks of a document that is longer than the room do not count
    spare = F.when(~fit & (F.col("tokens") <= F.col("room")), F.col("tokens")).otherwise(0)
    edges = edges.withColumn("spare", F.coalesce(F.sum(spare).over(shard.orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    near = ~fit & (F.col("room") > 0) & (F.col("spare") < F.col("room") + EDGE * block)
    edges = edges.withColumns({"times": F.col("rounds") + fit.cast("int"), "edge": near}).where("times > 0 or edge")
    chosen = materialize(blocks.join(edges.select("source", "shard", "block", "turn", "times", "edge", "room"), ["source", "shard", "block"]), "mixture-chosen")
    last = chosen.where("edge").groupBy("source", "shard").applyInPandas(_last_documents, chosen.select("id").schema)
    # few of all documents: the edges hold some blocks a shard and source
    added = broadcast_if_small(materialize(last.select(F.col("id").alias("_last")).distinct(), "mixture-edges"))
    drawn = chosen.join(added, F.col("edge") & (F.col("id") == F.col("_last")), "left")
    drawn = drawn.select("id", "source", "tokens", (F.col("times") + F.col("_last").isNotNull().cast("int")).alias("times")).where("times > 0")
    got = drawn.groupBy("source").agg(F.sum(F.col("tokens") * F.col("times")).alias("drawn"), F.count("*").alias("documents"), F.max("times").alias("most_repeats"))
    have = per_shard.groupBy("source").agg(F.sum("tokens").alias("available"))
    totals = listed.join(have, "source", "left").join(got, "source", "left")
    everything = totals.agg(F.sum("weight").alias("_weights"), F.sum("drawn").alias("_drawn"))  # one row
    report = totals.crossJoin(everything).select(
        "source",
        "available",
        (100 * F.col("weight") / F.col("_weights")).alias("wanted_pct"),
        F.coalesce("drawn", F.lit(0)).alias("drawn_tokens"),
        F.coalesce(100 * F.col("drawn") / F.col("_drawn"), F.lit(0.0)).alias("actual_pct"),
        F.coalesce("documents", F.lit(0)).alias("documents"),
        "most_repeats",
    )
    return drawn, report

"""Train, validation and test splits that keep related records together.

1. Components: records that share a value in any of the key columns belong together. With one key column that is the
   key itself; with several, the smallest label travels along shared values, with pointer jumping, until nothing changes.
2. Largest differencing: parts of about PART components each combine theirs into ``BINS`` bins by repeatedly pairing the
   two partial solutions of the largest spread, large bins against small ones. Partial solutions are themselves such
   tuples, so FAN of them at a time are combined by the same step, level by level, on the executors, until one is left.
3. Whole bins go to the splits by target proportion, heaviest first, each to the split that lacks most; exchanges of
   whole bins then bring the sizes nearer still.

Defined cases: a record without any key value is a component of its own; a component heavier than a bin stays whole;
repeated rows of a record count once; shares are taken relative to their sum; without targets (or none above zero)
nothing can be assigned and the result is empty; empty input -> empty result.
"""

from __future__ import annotations

import heapq
import itertools

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.runtime import broadcast_if_small, materialize

BINS = 400
PART = 20_000  # components that are differenced together
FAN = 32  # partial solutions that are combined at once


def components(rows: DataFrame, keys: list[str], ident: str = "id") -> DataFrame:
    """``rows`` with the label ``component``; null keys connect nothing."""
    own = F.concat(F.lit("record:"), F.col(ident))
    if len(keys) == 1:
        return rows.withColumn("component", F.coalesce(F.concat(F.lit("key:"), F.col(keys[0])), own))
    nodes = [F.when(F.col(k).isNotNull(), F.concat(F.lit(f"{k}:"), F.col(k))) for k in keys]
    tied = rows.select(F.col(ident).alias("_id"), F.array_compact(F.array(*nodes)).alias("_nodes"))
    # edges between the first value of a record and its others; records themselves are no nodes
    edges = materialize(
        tied.select(F.explode("_nodes").alias("u"), F.element_at("_nodes", 1).alias("w")).where("u <> w").distinct(), "split-edges"
    )
    both = edges.unionByName(edges.select(F.col("w").alias("u"), F.col("u").alias("w")))
    labels = materialize(both.groupBy("u").agg(F.least(F.min("w"), F.min("u")).alias("label")), "split-labels")
    while True:
        near = both.join(labels.select(F.col("u").alias("w"), "label"), "w").groupBy("u").agg(F.min("label").alias("near"))
        stepped = labels.join(near, "u").select("u", F.least("label", "near").alias("label"), (F.col("near") < F.col("label")).alias("moved"))
        # jump: a label is itself a node, whose own label is nearer to the root
        root = stepped.select(F.col("u").alias("label"), F.col("label").alias("root"))
        jumped = stepped.join(root, "label", "left").select(
            "u", F.least("label", F.coalesce("root", "label")).alias("label"), (F.col("moved") | (F.col("root") < F.col("label"))).alias("moved")
        )
        labels = materialize(jumped, "split-labels")
        if labels.where("moved").isEmpty():
            break
    first = tied.select("_id", F.get("_nodes", F.lit(0)).alias("u")).join(labels.select("u", "label"), "u", "left")
    named = first.select(F.col("_id"), F.coalesce("label", "u").alias("component"))
    return rows.join(named, rows[ident] == named["_id"]).select(*rows.columns, F.coalesce("component", own).alias("component"))


def component_weights(rows: DataFrame) -> DataFrame:
    """Per component its weight in records and the splits they lie in now; ``rows`` has ``component`` and ``split``."""
    per = rows.groupBy("component", "split").agg(F.count("*").alias("c"))  # two steps: a hot component is combined map-side
    return per.groupBy("component").agg(F.sum("c").alias("weight"), F.count("split").alias("splits"))


def difference(items: list[tuple[int, object]], bins: int) -> list[tuple[int, list]]:
    """Largest differencing of ``(weight, name)`` into ``bins`` bins: their weights and names, heaviest first.

    A partial solution is the list of its non-empty bins, heaviest first; the empty ones are implied. Equal weights go by name.
    """
    order = itertools.count()
    heap = [(-w, next(order), [(w, [name])]) for w, name in sorted(items, key=lambda x: (-x[0], x[1]))]
    heapq.heapify(heap)
    while len(heap) > 1:
        x, y = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        shared = len(x) + len(y) - bins
        if shared <= 0:
            both = x + y
        else:  # the empty bins of either take the heaviest of the other; of the rest the heavy meet the light
            both, alone = x[: len(x) - shared], y[: len(y) - shared]
            for (wx, nx), (wy, ny) in zip(x[len(x) - shared :], reversed(y[len(y) - shared :])):
                if len(nx) < len(ny):
                    nx, ny = ny, nx
                nx.extend(ny)
                both.append((wx + wy, nx))
            both = both + alone
        both.sort(key=lambda s: -s[0])
        spread = both[0][0] - (both[-1][0] if len(both) == bins else 0)
        heapq.heappush(heap, (-spread, next(order), both))
    return heap[0][2] if heap else []


def _part_bins(bins: int):
    """One part's components in bins: a row per component."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        items = list(zip(rows["weight"].tolist(), rows["component"].tolist()))
        out = [(c, i, w) for i, (w, names) in enumerate(difference(items, bins)) for c in names]
        return pd.DataFrame(out, columns=["component", "bin", "bin_weight"]).assign(part=int(rows["part"].iloc[0]))

    return run


def _combined(bins: int, fan: int):
    """The bins of up to ``fan`` parts in the bins of one: a row per bin taken in."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        up = int(rows["part"].iloc[0]) // fan
        taken = difference([(w, (p, b)) for w, p, b in zip(rows["w"].tolist(), rows["part"].tolist(), rows["bin"].tolist())], bins)
        out = [(p, b, up, i, w) for i, (w, names) in enumerate(taken) for p, b in names]
        return pd.DataFrame(out, columns=["part", "bin", "up", "up_bin", "up_w"])

    return run


def allocate(bins: list[tuple[int, list]], shares: list[tuple[str, float]]) -> dict[int, str]:
    """Bin number -> split: heaviest bin first, each to the split furthest below its share of the whole.

    Then whole bins are exchanged, or moved, between the fullest and the emptiest split as long as that brings the sizes
    nearer to the shares.
    """
    weights = [w for w, _ in bins]
    whole, total = sum(weights), sum(s for _, s in shares)
    lack = {name: whole * s / total for name, s in sorted(shares)}
    out = {}
    for i in sorted(range(len(bins)), key=lambda i: (-weights[i], i)):
        out[i] = max(lack, key=lack.__getitem__)
        lack[out[i]] -= weights[i]
    while len(lack) > 1:
        full, bare = min(lack, key=lack.__getitem__), max(lack, key=lack.__getitem__)
        give = {weights[i]: i for i, name in out.items() if name == full}
        take = {weights[i]: i for i, name in out.items() if name == bare} | {0: None}
        error = abs(lack[full]) + abs(lack[bare])
        moves = ((abs(lack[full] + g - t) + abs(lack[bare] - g + t), g, t) for g in give for t in take if g > t)
        best = min(moves, default=(error, 0, 0))
        if best[0] >= error - 1e-9:
            break
        _, g, t = best
        out[give[g]] = bare
        if take[t] is not None:
            out[take[t]] = full
        lack[full] += g - t
        lack[bare] -= g - t
    return out


def assign_splits(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """``rows`` (one per record, with ``component``) and the column ``new_split``.

    The driver sees the ``BINS`` weights of the last level, nothing per component or part. The same rows give the same splits.
    """
    spark = rows.sparkSession
    shares = [(r[0], float(r[1])) for r in targets.where("split is not null and share_pct > 0").select("split", "share_pct").distinct().sort("split").collect()]
    if not shares:
        return rows.withColumn("new_split", F.lit(None).cast("string")).where("false")
    weights = materialize(rows.groupBy("component").agg(F.count("*").alias("weight")), "split-weights")
    parts = max(1, -(-weights.count() // PART))
    placed = weights.withColumn("part", F.pmod(F.xxhash64("component"), F.lit(parts)).cast("int"))
    local = materialize(placed.groupBy("part").applyInPandas(_part_bins(BINS), "component string, bin int, bin_weight bigint, part int"), "split-bins")
    bins = local.groupBy("part", "bin").agg(F.max("bin_weight").alias("w"))
    where = local.select("component", "part", "bin")
    while parts > 1:
        level = materialize(bins.groupBy(F.floor(F.col("part") / FAN)).applyInPandas(_combined(BINS, FAN), "part int, bin int, up int, up_bin int, up_w bigint"), "split-level")
        bins = level.groupBy(F.col("up").alias("part"), F.col("up_bin").alias("bin")).agg(F.max("up_w").alias("w"))
        taken = broadcast_if_small(level.select("part", "bin", "up", "up_bin"))
        where = where.join(taken, ["part", "bin"]).select("component", F.col("up").alias("part"), F.col("up_bin").alias("bin"))
        parts = -(-parts // FAN)
    last = sorted((-r.w, r.bin) for r in bins.collect())
    to = allocate([(-w, []) for w, _ in last], shares)
    if not last:
        return rows.withColumn("new_split", F.lit(None).cast("string"))
    plan = F.broadcast(spark.createDataFrame([(b, to[i]) for i, (_, b) in enumerate(last)], "bin int, new_split string"))  # BINS rows
    named = materialize(where.join(plan, "bin").select(F.col("component").alias("_c"), "new_split"), "split-of-component")
    return rows.join(broadcast_if_small(named), rows["component"] == F.col("_c")).select(*rows.columns, "new_split")

"""Filling fixed-capacity containers with items.

Items are spread over shards of about SHARD items by a hash; every shard is packed on its own. Bin completion: the
largest item left opens a container, which is completed with each of its undominated fillings in turn, fullest first, found
lazily by reachable sums, however many items they hold; a branch ends where its waste exceeds what a packing better than
the incumbent may have. A filling is dominated when an item left out can take the place of some of its items (or of none)
and still fit. The incumbent is best-fit decreasing. The search is exhaustive, hence optimal, unless it meets the
lower bound before or has looked at ``nodes`` fillings beyond one for each container of the incumbent; then the best packing
found so far holds, which is complete in any case.
An item is cut only if it alone exceeds a container: into full containers and a rest that is packed like any item.

Defined cases: items of size null or 0 (null, empty texts) take no space and are in no container; repeated identifiers
are items of their own only if the caller passes them; ties are broken by identifier; empty input -> empty result; a
capacity that is null or below 1 gets no container.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARD = 4_000
NODES = 500


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[list[int]]:
    """Containers as lists of sizes; ``sizes`` falling."""
    open_: list[tuple[int, int]] = []  # room left, container
    out: list[list[int]] = []
    for s in sizes:
        i = bisect_left(open_, (s, -1))
        if i < len(open_):
            room, k = open_.pop(i)
            out[k].append(s)
        else:
            room, k = capacity, len(out)
            out.append([s])
        if room - s:
            insort(open_, (room - s, k))
    return out


def lower_bound(sizes: list[int], capacity: int) -> int:
    """Containers that any packing needs: items above half a container never meet, and small ones need the room that is left.

    For each limit, items that leave less room than the limit are alone; those of at least the limit share what the others leave.
    """
    falling = sorted(sizes, reverse=True)
    prefix = [0]
    for s in falling:
        prefix.append(prefix[-1] + s)
    negative = [-s for s in falling]
    big = bisect_left(negative, -capacity / 2)  # items above half the capacity
    best = -(-prefix[-1] // capacity)
    for limit in {0, *(s for s in falling if 2 * s <= capacity)}:
        alone = bisect_left(negative, -(capacity - limit)) if limit else 0
        upto = bisect_left(negative, 0.5 - limit)  # items of at least the limit
        shared = big - alone
        room = shared * capacity - (prefix[big] - prefix[alone])
        small = prefix[upto] - prefix[big] if upto > big else 0
        best = max(best, alone + shared + max(0, -(-(small - room) // capacity)))
    return best


def _smeared(sums: int, low: int, high: int) -> int:
    """The sums moved up by each of low..high."""
    if high < low:
        return 0
    done, width = sums << low, 1
    while width < high - low + 1:
        step = min(width, high - low + 1 - width)
        done |= done << step
        width += step
    return done


def _dominated(filling: tuple[int, ...], slack: int, left: Counter) -> bool:
    none, one, more = 1, 0, 0  # sums of no, one, several of the filling's items, as bits
    for s in filling:
        more |= (more << s) | (one << s)
        one |= 1 << s
    hits = _smeared(none, 1, slack) | _smeared(one, 1, slack) | more | _smeared(more, 1, slack)
    used = Counter(filling)
    return any(hits >> k & 1 for k, n in left.items() if n > used[k] and k <= hits.bit_length())


def fillings(room: int, left: Counter) -> Iterator[tuple[int, ...] | None]:
    """The undominated fillings of ``room`` by sizes of ``left``, fullest first, and None for each dominated one met on the way."""
    kinds = sorted((k for k, n in left.items() if n and k <= room), reverse=True)
    whole = (1 << room + 1) - 1
    reach = [1]  # sums that the kinds from here on can have, as bits
    for k in reversed(kinds):
        sums, copies, take = reach[-1], min(left[k], room // k), 1
        while copies > 0:
            take = min(take, copies)
            sums |= sums << k * take & whole
            copies -= take
            take *= 2
        reach.append(sums)
    reach.reverse()

    def filled(i: int, rest: int) -> Iterator[tuple[int, ...]]:
        if not rest:
            yield ()
            return
        for j in range(i, len(kinds)):
            k = kinds[j]
            if k > rest:
                continue
            if not reach[j] >> rest & 1:
                return
            for n in range(min(left[k], rest // k), 0, -1):
                if reach[j + 1] >> rest - n * k & 1:
                    for others in filled(j + 1, rest - n * k):
                        yield (k,) * n + others

    sums = reach[0]
    while sums:
        total = sums.bit_length() - 1
        sums ^= 1 << total
        for filling in filled(0, total):
            yield None if _dominated(filling, room - total, left) else filling


def bin_completion(sizes: list[int], capacity: int, nodes: int = NODES) -> list[list[int]]:
    """The best packing found: optimal when it meets the lower bound or the search ends within ``nodes``."""
    sizes = sorted(sizes, reverse=True)
    best = best_fit_decreasing(sizes, capacity)
    bound = lower_bound(sizes, capacity)
    if len(best) <= bound:
        return best
    total, budget = sum(sizes), nodes + len(best)
    left = Counter(sizes)
    falling = sorted(left, reverse=True)
    stack: list[tuple[int, int, Iterator]] = []  # a frame per container: place of its largest size, that size, the fillings not tried
    packed: list[list[int]] = []
    waste = 0

    def open_container(start: int) -> None:
        while not left[falling[start]]:
            start += 1
        x = falling[start]
        left[x] -= 1
        stack.append((start, x, fillings(capacity - x, left)))

    open_container(0)
    placed = 0
    while stack and len(best) > bound:
        start, x, options = stack[-1]
        if len(packed) == len(stack):  # come back from below: take the last filling out
            content = packed.pop()
            waste -= capacity - sum(content)
            placed -= len(content)
            for s in content[1:]:
                left[s] += 1
        filling = None
        for option in options:
            budget -= 1
            if option is not None or budget <= 0:
                filling = option
                break
        if budget <= 0:
            break
        if filling is None or waste + capacity - x - sum(filling) > (len(best) - 1) * capacity - total:
            stack.pop()  # nothing left to try, or only what wastes too much
            left[x] += 1
            continue
        for s in filling:
            left[s] -= 1
        packed.append([x, *filling])
        waste += capacity - x - sum(filling)
        placed += len(filling) + 1
        if placed == len(sizes):
            if len(packed) < len(best):
                best = [list(c) for c in packed]
        else:
            open_container(start)
    return best


def _pack(capacities: list[tuple[int, int]]):
    def run(key: tuple, items: pd.DataFrame) -> pd.DataFrame:
        shard = int(key[0])
        items = items.sort_values(["tokens", "id"], ascending=[False, True])
        ids, sizes = items["id"].tolist(), items["tokens"].tolist()
        out = []
        for spec, capacity in capacities:
            parts: dict[int, list] = {}
            number = 0
            for i, n in zip(ids, sizes):
                whole, rest = divmod(n, capacity)
                for piece in range(whole):
                    out.append((spec, shard, number, i, piece, capacity))
                    number += 1
                if rest:
                    parts.setdefault(rest, []).append((i, whole))
            for content in bin_completion([s for s, p in parts.items() for _ in p], capacity) if parts else []:
                for s in content:
                    i, piece = parts[s].pop()
                    out.append((spec, shard, number, i, piece, s))
                number += 1
        return pd.DataFrame(out, columns=["spec_id", "shard", "container", "id", "piece", "tokens"])

    return run


def pack(items: DataFrame, specs: DataFrame) -> DataFrame:
    """``(spec_id, shard, container, id, piece, tokens)``; ``items`` has ``id`` and ``tokens``, ``specs`` is a small table.

    A container is named by spec, shard and number; ``piece`` counts the cuts of an item from 0.
    """
    wanted = specs.where("spec_id is not null and capacity_tokens >= 1").select("spec_id", "capacity_tokens").distinct()
    capacities = [(int(r[0]), int(r[1])) for r in wanted.collect()]
    sized = items.where("tokens > 0").select(F.col("id").cast("bigint").alias("id"), F.col("tokens").cast("bigint").alias("tokens"))
    shards = max(1, -(-items.count() // SHARD))
    return (
        sized.withColumn("_shard", F.pmod(F.xxhash64("id"), F.lit(shards)))
        .repartition(min(shards, 20_000), "_shard")  # shards are small but dear: rows are no measure of the work
        .groupBy("_shard")
        .applyInPandas(_pack(capacities), "spec_id int, shard int, container int, id bigint, piece int, tokens bigint")
    )


def packing_report(packed: DataFrame, specs: DataFrame) -> DataFrame:
    """Per spec: containers, tokens, the least number of containers that could do, and the share of space unused."""
    per = packed.groupBy("spec_id", "shard", "container").agg(F.sum("tokens").alias("used"))
    sums = per.groupBy("spec_id").agg(F.count("*").alias("containers"), F.sum("used").alias("tokens"), F.max("used").alias("fullest"))
    cap = F.col("capacity_tokens")
    return sums.join(specs.select("spec_id", cap), "spec_id").select(
        "spec_id",
        cap,
        "containers",
        "tokens",
        "fullest",
        F.ceil(F.col("tokens") / cap).alias("at_least"),
        (1 - F.col("tokens") / (F.col("containers") * cap)).alias("unused_share"),
    )

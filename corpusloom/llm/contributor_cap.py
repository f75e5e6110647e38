"""Capping records per dominant contributor.

Mergeable bounded heaps (kept as sorted lists): every partition keeps, per contributor, only the cap's best (score,
identifier) entries; the small heaps are merged in a tree, at most MERGE_FAN of them at once and cut to the cap each time,
so no merge holds more than MERGE_FAN times the cap; the kept identifiers then meet the full records in a semi-join. A
contributor that owns a third of all rows costs each partition no more than ``cap`` entries.

Defined cases: no contributor -> never capped; no cap listed and no ``*`` row, or a null cap -> never capped; a cap
below 1 -> everything of that contributor goes; missing scores rank last; ties go to the identifier that is smaller in
binary order; repeated rows of an identifier count once (an identifier fills one heap entry); empty input -> empty
results. Extra columns of the input are ignored, so their names cannot clash.
"""

from __future__ import annotations

from bisect import insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.runtime import broadcast_if_small, materialize

_ENTRY = "array<struct<a:double,b:double,id:string>>"
_HEAPS = f"contributor string, cap bigint, heap {_ENTRY}"
MERGE_FAN = 32


def with_target(rows: DataFrame, targets: DataFrame, value: str, key: str = "contributor", target_key: str = "speaker_id") -> DataFrame:
    """``rows`` with the target's ``value`` as ``target``; the target row ``*`` stands for keys not listed."""
    listed = targets.select(F.col(target_key).alias("_k"), F.col(value).cast("bigint").alias("_v")).groupBy("_k").agg(F.min("_v").alias("_v"))
    star = listed.where("_k = '*'").select("_v").head()
    named = broadcast_if_small(listed.where("_k <> '*'").withColumn("_listed", F.lit(True)))
    default = F.lit(star[0] if star else None).cast("bigint")
    return rows.join(named, rows[key] == named["_k"], "left").select(
        *rows.columns, F.when(F.col("_listed"), F.col("_v")).otherwise(default).alias("target")
    )


def _bounded_heaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    heaps: dict[str, list] = {}
    caps: dict[str, int] = {}
    for batch in batches:
        who, cap, a, b, ident = (batch.column(i).to_pylist() for i in range(5))
        for w, c, *entry in zip(who, cap, a, b, ident):
            heap = heaps.get(w)
            if heap is None:
                heap, caps[w] = heaps.setdefault(w, []), c
            entry = tuple(entry)
            if len(heap) < c:
                insort(heap, entry)
            elif c > 0 and entry < heap[-1]:
                heap.pop()
                insort(heap, entry)
    names = list(heaps)
    for i in range(0, len(names), 2000):
        part = names[i : i + 2000]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(part, pa.string()),
                pa.array([caps[w] for w in part], pa.int64()),
                pa.array(
                    [[{"a": x, "b": y, "id": z} for x, y, z in heaps[w]] for w in part],
                    pa.list_(pa.struct([("a", pa.float64()), ("b", pa.float64()), ("id", pa.string())])),
                ),
            ],
            names=["contributor", "cap", "heap"],
        )


def _capped(rows: DataFrame, targets: DataFrame) -> DataFrame:
    needed = rows.where("contributor is not null").select("id", "contributor", "score", "penalty")
    return with_target(needed, targets, "max_records").where("target is not null")


def best_records(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """Kept ``(contributor, id)`` of capped contributors.

    ``rows`` has ``id``, ``contributor``, ``score`` (more is better) and ``penalty`` (less is better), one row per id.
    """
    ranked = _capped(rows, targets).select(
        "contributor",
        "target",
        F.coalesce(-F.col("score"), F.lit(float("inf"))).alias("a"),
        F.coalesce(F.col("penalty"), F.lit(float("inf"))).alias("b"),
        "id",
    )
    heaps = materialize(ranked.mapInArrow(_bounded_heaps, _HEAPS).withColumn("_leaf", F.spark_partition_id()), "bounded-heaps")
    leaves = (heaps.agg(F.max("_leaf")).first()[0] or 0) + 1
    merged = F.slice(F.array_sort(F.flatten(F.collect_list("heap"))), 1, F.greatest(F.max("cap").cast("int"), F.lit(0))).alias("heap")
    while True:
        heaps = heaps.groupBy("contributor", F.floor(F.col("_leaf") / MERGE_FAN).alias("_leaf")).agg(merged, F.max("cap").alias("cap"))
        leaves = -(-leaves // MERGE_FAN)
        if leaves == 1:
            break
    return heaps.select("contributor", F.explode("heap").alias("_e")).select("contributor", F.col("_e.id").alias("id"))


def cut_records(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """``(id, contributor)`` of the records beyond their contributor's cap."""
    capped = _capped(rows, targets)
    kept = best_records(rows, targets).select(F.col("id").alias("_kept"))
    return capped.join(kept, capped["id"] == kept["_kept"], "left_anti").select("id", "contributor")


def kept_records(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """The records that stay: those of no capped contributor, and of the others those in a heap."""
    named = with_target(rows.select("id", "contributor", F.struct("*").alias("_row")), targets, "max_records")
    capped = F.col("contributor").isNotNull() & F.col("target").isNotNull()
    kept = best_records(rows, targets).select(F.col("id").alias("_kept"))
    stay = named.where(capped).join(kept, F.col("id") == F.col("_kept"), "left_semi")
    return named.where(~capped).unionByName(stay).select("_row.*")

"""Training-set sampling and batching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.runtime import materialize

BOS, EOS, IGNORE = 8192, 8193, -100
_BLOCK = 10_000


def indexed(rows: DataFrame, order: list[str], groups: list[str] | None = None, out: str = "pos") -> DataFrame:
    """``rows`` with their 0-based position in ``order`` (within ``groups``), without sorting in one task.

    Rows are range-partitioned and sorted in place; partition sizes give each partition its offset.
    """
    groups = groups or []
    ranged = rows.repartitionByRange(*groups, *order).sortWithinPartitions(*groups, *order).withColumn("_p", F.spark_partition_id())
    fixed = materialize(ranged, "indexed")
    sizes = fixed.groupBy(*groups, "_p").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*groups).orderBy("_p")
    offsets = sizes.withColumn("_before", F.sum("_n").over(before) - F.col("_n")).drop("_n")  # a row per partition and group
    within = F.row_number().over(Window.partitionBy(*groups, "_p").orderBy(*order)) - 1
    keys = [*groups, "_p"]
    return fixed.withColumn("_w", within).join(offsets, keys).withColumn(out, F.col("_w") + F.col("_before")).select(*rows.columns, out)


def interleave(rows: DataFrame, source: str, order: list[str]) -> DataFrame:
    """Round-robin over sources: row i comes from source i % L at position (i // L) % length, for max(length) * L rows.

    Every row knows where it lands: position, position + length, ... up to the longest source. So short sources repeat by
    an explode in blocks, and nothing is joined with a range. Sources are numbered in their order.
    """
    placed = indexed(rows.where(F.col(source).isNotNull()), order, [source])
    sizes = placed.groupBy(source).agg(F.count("*").alias("_len"))
    every = Window.partitionBy()
    named = sizes.withColumns(  # a row per source
        {"_s": F.row_number().over(Window.partitionBy().orderBy(source)) - 1, "_l": F.count("*").over(every), "_max": F.max("_len").over(every)}
    )
    times = F.floor((F.col("_max") - 1 - F.col("pos")) / F.col("_len"))
    blocks = F.sequence(F.lit(0), F.floor(times / _BLOCK))
    joined = placed.join(named, source).withColumn("_t", times).withColumn("_k", F.explode(blocks))
    turns = F.sequence(F.col("_k") * _BLOCK, F.least(F.col("_t"), F.col("_k") * _BLOCK + _BLOCK - 1))
    spread = joined.withColumn("_m", F.explode(turns))
    row = (F.col("pos") + F.col("_m") * F.col("_len")) * F.col("_l") + F.col("_s")
    return spread.withColumn("i", row).select("i", *rows.columns, "pos")


def batches(rows: DataFrame, order: list[str], size: int, drop_last: bool) -> DataFrame:
    """``rows`` with ``batch`` and ``slot``: consecutive batches of ``size``; an unfilled last one is kept or dropped."""
    placed = indexed(rows, order)
    numbered = placed.withColumns({"batch": F.floor(F.col("pos") / size), "slot": F.col("pos") % size})
    if not drop_last:
        return numbered.drop("pos")
    whole = placed.agg((F.floor(F.count("*") / size)).alias("_whole"))
    return numbered.crossJoin(F.broadcast(whole)).where("batch < _whole").drop("pos", "_whole")


def seeded(ident: Column, seed: int) -> Column:
    """48 bits of md5(ident:seed): a draw that is the same in every run and engine."""
    return F.conv(F.substring(F.md5(F.concat(ident, F.lit(f":{seed}"))), 1, 12), 16, 10).cast("bigint")


def shards(ident: Column, ranks: int, seed: int) -> Column:
    """Rank of a record: a seeded hash, the same in every run."""
    return (seeded(ident, seed) % ranks).cast("int")


def even_shards(rows: DataFrame, order: list[str], ranks: int) -> DataFrame:
    """``rows`` with ``rank``: dealt out in turn, and the rows that do not fill a round dropped, so that all ranks have as many."""
    placed = indexed(rows, order)
    rounds = placed.agg(F.floor(F.count("*") / ranks).alias("_rounds"))
    return placed.crossJoin(F.broadcast(rounds)).where(F.col("pos") < F.col("_rounds") * ranks).withColumn("rank", (F.col("pos") % ranks).cast("int")).drop("pos", "_rounds")


def pick(items: Column, ident: Column, seed: int) -> Column:
    """One element of an array, by a seeded hash of the record; null of an empty one."""
    at = (seeded(ident, seed) % F.greatest(F.size(items), F.lit(1))).cast("int")
    return F.get(items, at)


def crop_start(length: Column, window: int, ident: Column, seed: int) -> Column:
    """First sample of a crop of ``window``: 0 when the clip is shorter."""
    return F.when(length <= window, F.lit(0)).otherwise(seeded(ident, seed) % (length - window + 1)).cast("bigint")


def keep_with_probability(ident: Column, p: float, seed: int) -> Column:
    """Bernoulli choice by a seeded hash: conditional dropout and prompt masking, reproducible."""
    return seeded(ident, seed) % 1_000_000 < F.lit(int(p * 1_000_000))


def admitted(tokens: Column, text_length: Column | None = None, max_tokens: int = 1520, max_text: int = 520, vocabulary: int = 8192) -> Column:
    """Length and range gates: 0 < tokens <= max_tokens, text < max_text, ids below the vocabulary."""
    ok = (F.size(tokens) > 0) & (F.size(tokens) <= max_tokens) & F.coalesce(F.array_max(tokens) < vocabulary, F.lit(False))
    return ok if text_length is None else ok & (text_length < max_text)


def inputs_of(tokens: Column) -> Column:
    return F.concat(F.array(F.lit(BOS).cast("bigint")), tokens, F.array(F.lit(EOS).cast("bigint")))


def targets_of(tokens: Column) -> Column:
    """Shifted by one: what follows each input; nothing follows the end."""
    return F.concat(tokens, F.array(F.lit(EOS).cast("bigint"), F.lit(IGNORE).cast("bigint")))


def padded(items: Column, to: Column, value: Column) -> Column:
    return F.concat(items, F.array_repeat(value, (to - F.size(items)).cast("int")))


def length_mask(length: Column, to: Column) -> Column:
    """``to`` booleans, true for the first ``length``."""
    return F.concat(F.array_repeat(F.lit(True), F.least(length, to).cast("int")), F.array_repeat(F.lit(False), F.greatest(to - length, F.lit(0)).cast("int")))


def joined_mask(text: Column, tokens: Column, to: Column) -> Column:
    """Mask of the joined input: a speaker place, ``text`` places, and ``tokens`` with their begin and end marks."""
    return length_mask(1 + text + tokens + 2, to)


def cleaned_tokens(raw: Column, last: int = 8191) -> Column:
    """Generated ids without begin and end marks, clamped to the codebook."""
    return F.transform(F.filter(raw, lambda x: (x != BOS) & (x != EOS)), lambda x: F.least(x, F.lit(last).cast("bigint")))


def pad_batches(rows: DataFrame, tokens: str = "tokens") -> DataFrame:
    """Per batch the padded inputs, targets and masks, in slot order; ``rows`` has batch, slot, tokens."""
    longest = F.max(F.size("_in")).over(Window.partitionBy("batch"))
    shaped = rows.withColumns({"_in": inputs_of(F.col(tokens)), "_out": targets_of(F.col(tokens))}).withColumn("_w", longest)
    line = F.struct(
        "slot",
        padded(F.col("_in"), F.col("_w"), F.lit(EOS).cast("bigint")).alias("inputs"),
        padded(F.col("_out"), F.col("_w"), F.lit(IGNORE).cast("bigint")).alias("targets"),
        length_mask(F.size("_in"), F.col("_w")).alias("mask"),
    )
    lines = F.array_sort(F.collect_list("_line"))
    return shaped.withColumn("_line", line).groupBy("batch").agg(lines.alias("_lines")).select(
        "batch", *[F.col(f"_lines.{c}").alias(c) for c in ("inputs", "targets", "mask")]
    )

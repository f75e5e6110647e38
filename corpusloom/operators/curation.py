"""Corpus curation as one lazy plan: admission with reasons, group filters, reference clips, splits, report.

Comparisons with NaN are false, as in IEEE arithmetic (Spark orders NaN above all numbers): a NaN metric passes a limit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.config import Thresholds
from corpusloom.functions.text import clean_text, first_filled
from corpusloom.functions.blanks import strip_blanks
from corpusloom.operators.quantiles import exact_quantiles


def over(c: Column, limit: float) -> Column:
    return (c > limit) & ~F.isnan(c)


def under(c: Column, limit: float) -> Column:
    return c < limit


def latest(rows: DataFrame, key: str, at: str) -> DataFrame:
    """One row per key, the one taken in last; hot keys are combined map-side, nothing is sorted per key."""
    others = [c for c in rows.columns if c not in (key, at)]
    return rows.groupBy(key).agg(F.max_by(F.struct(*others), F.struct(at, *others)).alias("_r"), F.max(at).alias(at)).select(
        key, *[F.col(f"_r.{c}").alias(c) for c in others], at
    )


def with_norm_text(rows: DataFrame, field: str = "text_normalized", fallback: str = "text") -> DataFrame:
    return rows.withColumn("norm_text", clean_text(first_filled(F.col(field), F.col(fallback))))


def quality_reason(t: Thresholds = Thresholds()) -> Column:
    """First failed test of the admission rule, or null; reads norm_text, cer, duration, clipping, multi_speaker, dnsmos, snr_db, sr."""
    c = F.col
    return (
        F.when(c("norm_text") == "", "empty_text")
        .when(c("cer").isNull(), "cer_missing")
        .when(over(c("cer"), t.max_cer), "cer")
        .when(c("duration").isNull(), "duration_missing")
        .when(under(c("duration"), t.min_seconds), "too_short")
        .when(over(c("duration"), t.max_seconds), "too_long")
        .when(over(c("clipping"), t.max_clipping), "clipping")
        .when(F.lit(not t.allow_multi_speaker) & c("multi_speaker"), "multi_speaker")
        .when(under(c("dnsmos"), t.min_dnsmos), "dnsmos")
        .when(c("dnsmos").isNull() & (c("snr_db").isNull() | under(c("snr_db"), t.min_snr_db)), "snr")
        .when(c("sr") < t.min_sample_rate, "sample_rate")
        .when(over(c("duration") * t.frames_per_second, t.max_frames), "semantic_too_long")
    )


def admission_reason(t: Thresholds = Thresholds()) -> Column:
    """Audio first, then quality, then speaker: the order decides which reason is reported."""
    return (
        F.when(F.coalesce(F.col("audio_path"), F.lit("")) == "", "audio_missing")
        .otherwise(F.coalesce(quality_reason(t), F.when(F.coalesce(F.col("speaker_id"), F.lit("")) == "", "speaker_missing")))
    )


def packaged_reason(t: Thresholds) -> Column:
    """Reason order of the packaged corpus; reads tier, wav_exists, norm_text, speaker_id, duration, sr."""
    c = F.col
    return (
        F.when(~c("tier").isin(*t.tiers) | c("tier").isNull(), F.concat(F.lit("tier_"), F.coalesce(F.nullif(c("tier"), F.lit("")), F.lit("missing"))))
        .when(~c("wav_exists"), "audio_missing")
        .when(c("norm_text") == "", "empty_text")
        .when(F.coalesce(c("speaker_id"), F.lit("")) == "", "speaker_missing")
        .when(c("duration").isNull(), "duration_missing")
        .when(under(c("duration"), t.min_seconds), "too_short")
        .when(over(c("duration"), t.max_seconds) | over(c("duration") * t.frames_per_second, t.max_frames), "too_long")
        .when(c("sr") < t.min_sample_rate, "sample_rate")
    )


def quality_score() -> Column:
    """dnsmos in tenths, or the SNR up to 40 dB, less a hundred times the character error rate; null where a metric it needs is NaN."""
    acoustic = F.when(F.col("dnsmos").isNotNull(), F.col("dnsmos") * 10.0).otherwise(
        F.when(F.isnan("snr_db"), F.col("snr_db")).otherwise(F.least(F.coalesce("snr_db", F.lit(0.0)), F.lit(40.0)))
    )
    score = acoustic - F.lit(100.0) * F.coalesce("cer", F.lit(0.0))
    return F.when(~F.isnan(score), score)


def small_groups(rows: DataFrame, key: str, least: int) -> DataFrame:
    """Keys with fewer than ``least`` rows and their sizes; one partial aggregate, no window over a hot key."""
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") < least)


def drop_small_groups(rows: DataFrame, key: str, least: int) -> DataFrame:
    return rows.join(small_groups(rows, key, least), key, "left_anti")  # its size is seen at run time, which decides whether it is broadcast


def top_clips(rows: DataFrame, k: int) -> DataFrame:
    """Per speaker the k+1 best clips of the reference length and the k+1 best of the others: enough to leave a clip itself out.

    ``rows`` has ``ranged``. The rank limit is pushed below the shuffle, so a hot speaker sends 2k+2 rows per task. Clips without
    a score (null or NaN) come last; ``clips`` is sorted by score and id.
    """
    last = F.coalesce(F.when(~F.isnan("score"), F.col("score")), F.lit(float("-inf")))
    scored = rows.select("speaker_id", F.coalesce("ranged", F.lit(False)).alias("ranged"), (-last).alias("_last"), "id", "path")
    best = scored.withColumn("_rank", F.row_number().over(Window.partitionBy("speaker_id", "ranged").orderBy("_last", "id"))).where(F.col("_rank") <= k + 1)
    return best.groupBy("speaker_id").agg(F.array_sort(F.collect_list(F.struct("_last", "id", "path", "ranged"))).alias("clips"))


def pick_references(rows: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """``rows`` with ``refs`` (paths of the best other clips of the speaker) and ``ref_source``.

    Clips of the reference length come first; only where there is none, any other clip of the speaker does (never to top
    up a short list); without one, ``ref_source`` is ``none``. ``rows`` has id, speaker_id, duration, score, path.
    """
    ranged = F.col("duration").between(t.ref_min_seconds, t.ref_max_seconds)
    pools = top_clips(rows.withColumn("ranged", ranged), t.num_refs).withColumnRenamed("clips", "_clips")
    joined = rows.join(pools, "speaker_id", "left")

    def paths(clips: Column) -> Column:
        return F.transform(F.slice(clips, 1, t.num_refs), lambda x: x.path)

    mine = F.coalesce(F.filter("_clips", lambda x: x.id != F.col("id")), F.filter("_clips", lambda x: F.lit(False)))
    picked = joined.withColumn("_clips", mine).withColumns({"_a": paths(F.filter("_clips", lambda x: x.ranged)), "_b": paths(F.col("_clips"))})
    source = F.when(F.size("_a") > 0, "range").when(F.size("_b") > 0, "fallback").otherwise("none")
    refs = F.when(F.size("_a") > 0, F.col("_a")).otherwise(F.coalesce("_b", F.array().cast("array<string>")))
    return picked.withColumns({"refs": refs, "ref_source": source}).drop("_clips", "_a", "_b")


def split_from_field(c: Column) -> Column:
    """``train`` stays, any other filled value is ``val``, null and blank are ``train``."""
    s = F.lower(strip_blanks(F.coalesce(c, F.lit(""))))
    return F.when(s.isin("", "train"), "train").otherwise("val")


def val_size(n: Column, ratio: float) -> Column:
    """Validation clips of a speaker with n clips: a share, rounded half to even, from 10 on; 1 from 4 on; else none."""
    return F.when(n >= 10, F.greatest(F.lit(1), F.bround(n * F.lit(ratio)).cast("int"))).when(n >= 4, 1).otherwise(0)


def split_by_hash(rows: DataFrame, ratio: float, seed: int) -> DataFrame:
    """``rows`` with ``split``: of every speaker the ``val_size`` clips with the smallest md5(id, seed) are ``val``.

    A hash prefix cuts every speaker into up to 65,536 buckets, and ranks are counted within a bucket on top of the sizes of
    those before it, so no task sorts a whole speaker.
    """
    h = F.md5(F.concat(F.col("id"), F.lit(f":{seed}")))
    hashed = rows.withColumn("_h", h).withColumn("_b", F.substring("_h", 1, 4))
    buckets = hashed.groupBy("speaker_id", "_b").agg(F.count("*").alias("_n"))
    by_speaker = Window.partitionBy("speaker_id")
    placed = buckets.withColumns(
        {"_before": F.sum("_n").over(by_speaker.orderBy("_b")) - F.col("_n"), "_want": val_size(F.sum("_n").over(by_speaker), ratio)}
    )
    cut = placed.where((F.col("_want") > 0) & (F.col("_before") < F.col("_want")))
    joined = hashed.join(cut.select("speaker_id", "_b", "_before", "_want"), ["speaker_id", "_b"], "left")
    rank = F.row_number().over(Window.partitionBy("speaker_id", "_b").orderBy("_h", "id"))
    val = F.coalesce(F.col("_before") + rank <= F.col("_want"), F.lit(False))
    return joined.withColumn("split", F.when(val, "val").otherwise("train")).select(*rows.columns, "split")


def hours(seconds: Column) -> Column:
    return F.round(F.coalesce(F.sum(seconds), F.lit(0.0)) / 3600, 3)


def summary(accepted: DataFrame, rejected: DataFrame) -> DataFrame:
    """One row: sizes and hours over all and per split. ``accepted`` has speaker_id, duration, split; ``rejected`` reason, n."""
    val, train = F.col("split") == "val", F.col("split") == "train"
    main = accepted.agg(
        F.count("*").alias("accepted"),
        F.count_distinct("speaker_id").alias("speakers"),
        hours(F.col("duration")).alias("hours_total"),
        F.count_if(train).alias("train_utts"),
        hours(F.when(train, F.col("duration"))).alias("train_hours"),
        F.count_if(val).alias("val_utts"),
        hours(F.when(val, F.col("duration"))).alias("val_hours"),
    )
    return main.crossJoin(F.broadcast(rejected.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rejected"), F.count("*").alias("reasons"))))


def report_rows(accepted: DataFrame, rejected: DataFrame) -> DataFrame:
    """The report as rows ``(section, name, value)``: totals, clips per reason, clips per speaker (as many rows as speakers)."""
    totals = summary(accepted, rejected)
    parts = [totals.select(F.lit("total").alias("section"), F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in totals.columns]
    parts.append(rejected.select(F.lit("rejected"), "reason", F.col("n").cast("double")))
    parts.append(accepted.groupBy("speaker_id").agg(F.count("*").cast("double").alias("n")).select(F.lit("speaker"), "speaker_id", "n"))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def nested_summary(accepted: DataFrame, rejected: DataFrame) -> DataFrame:
    """As ``summary``, with the reasons as a map: the report document. Clips per speaker are rows of ``report_rows``."""
    reasons = rejected.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("reason", "n")))).alias("rejected"))
    return summary(accepted, rejected).drop("rejected", "reasons").crossJoin(F.broadcast(reasons))  # one row: a reason is one of a fixed list


def median_rate(tokens: DataFrame, expected: float = 50.0) -> DataFrame:
    """Exact median of tokens per second and whether it is more than a fifth off; ``tokens`` has n, duration."""
    rate = F.col("n") / F.col("duration")
    q = exact_quantiles(tokens.where("duration > 0 and n > 0").withColumn("_all", F.lit(0)), rate, [0.5], "_all")
    return q.select(F.get("q", F.lit(0)).alias("median_rate"), F.col("n").alias("clips")).withColumn("alarm", F.abs(F.col("median_rate") - expected) / expected > 0.2)

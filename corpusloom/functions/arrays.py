"""Array, vector and signal kernels as higher-order functions: no row leaves the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)`` with ``value`` computed once: a plain Column would be inlined, and recomputed, in every lambda below."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _sum(items: Column) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Null where a vector has no length."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def l2_normalized(v: Column) -> Column:
    return let(F.greatest(norm(v), F.lit(1e-12)), lambda n: F.transform(v, lambda x: x / n))


def scaled(v: Column, by: Column) -> Column:
    return F.transform(v, lambda x: x * by)


def blend(a: Column, b: Column, share: float) -> Column:
    """share * a + (1 - share) * b, element by element."""
    return F.zip_with(a, b, lambda x, y: F.lit(share) * x + F.lit(1 - share) * y)


def zscore(v: Column, mean: Column, var: Column) -> Column:
    centred = F.zip_with(v, mean, lambda x, m: x - m)
    return F.zip_with(centred, var, lambda x, s: x / F.sqrt(s))


def log_clamped(v: Column, least: float = 1e-5) -> Column:
    return F.transform(v, lambda x: F.log(F.greatest(x.cast("double"), F.lit(least))))


def mean_subtracted(frames: Column) -> Column:
    """Frames (array of arrays, time by dimension) less their mean over time."""
    zero = F.transform(F.get(frames, F.lit(0)), lambda x: F.lit(0.0))
    total = F.aggregate(frames, zero, lambda s, f: F.zip_with(s, f, lambda x, y: x + y))
    n = F.size(frames)
    return let(F.transform(total, lambda x: x / n), lambda mean: F.transform(frames, lambda f: F.zip_with(f, mean, lambda x, m: x - m)))


def softmax(v: Column) -> Column:
    shifted = let(F.array_max(v), lambda top: F.transform(v, lambda x: F.exp(x - top)))
    return let(shifted, lambda e: let(_sum(e), lambda total: F.transform(e, lambda x: x / total)))


def pooled_stats(values: Column, scores: Column, least: float = 1e-12) -> Column:
    """Attentive pooling of one channel: softmax-weighted mean and clamped deviation."""

    def stats(w: Column) -> Column:
        def spread(mean: Column) -> Column:
            var = _sum(F.zip_with(w, values, lambda p, x: p * (x - mean) * (x - mean)))
            return F.struct(mean.alias("mean"), F.sqrt(F.greatest(var, F.lit(least))).alias("std"))

        return let(dot(w, values), spread)

    return let(softmax(scores), stats)


def ema(values: Column, decay: float) -> Column:
    """Exponential moving average of an ordered array, started at its first element."""
    return F.aggregate(
        F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0))),
        F.get(values, F.lit(0)).cast("double"),
        lambda s, x: F.lit(decay) * s + F.lit(1 - decay) * x,
    )


def _steps(n: Column, f: Callable[[Column], Column], kind: str = "double") -> Column:
    """``f(0) .. f(n - 1)``; the empty array for n = 0."""
    empty = F.array().cast(f"array<{kind}>")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n.cast("int") - 1), f)).otherwise(empty)


def nearest_resampled(v: Column, to: Column, kind: str = "double") -> Column:
    """Nearest-neighbour resampling to ``to`` elements: element floor(i * n / to)."""
    return let(v, lambda a: _steps(to, lambda i: F.get(a, F.floor(i * F.size(a) / to).cast("int")), kind))


def frames_of(tokens: Column, ratio: float = 1.72) -> Column:
    """Target length of a token count: the double product, truncated."""
    return F.floor(tokens * F.lit(ratio)).cast("int")


def ramp(n: Column, down: bool) -> Column:
    """n weights from 0 to 1 (or down); a single one is the start value."""
    last = F.greatest(n - 1, F.lit(1))
    return _steps(n, lambda i: (F.lit(1.0) - i / last) if down else i / last)


def _tail(v: Column, n: Column) -> Column:
    return F.slice(v, F.size(v) - n + 1, n)


def _head(v: Column, n: Column) -> Column:
    return F.slice(v, F.lit(1), n)


def faded(v: Column, head: Column, tail: Column) -> Column:
    """First ``head`` samples faded in, last ``tail`` faded out."""

    def weigh(bound: Column) -> Column:
        n, h, t = F.get(bound, F.lit(0)), F.get(bound, F.lit(1)), F.get(bound, F.lit(2))
        a, b = F.greatest(h - 1, F.lit(1)), F.greatest(t - 1, F.lit(1))
        return F.transform(v, lambda x, i: x * F.when(i < h, i / a).otherwise(1.0) * F.when(i >= n - t, F.lit(1.0) - (i - (n - t)) / b).otherwise(1.0))

    return let(F.array(F.size(v), head, tail), weigh)


def silence(n: Column) -> Column:
    return F.array_repeat(F.lit(0.0), n.cast("int"))


def fade_and_pad(v: Column, rate: int, fade: float = 0.1, pad: float = 0.1) -> Column:
    k = F.least(F.lit(int(fade * rate)), F.floor(F.size(v) / 2).cast("int"))
    quiet = silence(F.lit(int(pad * rate)))
    return F.when(F.size(v) == 0, v).otherwise(F.concat(quiet, faded(v, k, k), quiet))


def joined_with_silence(chunks: Column, rate: int, seconds: float = 0.3) -> Column:
    """Chunks in order: a third of ``seconds`` each for fade-out, silence and fade-in; a single chunk is left as it is."""
    third = int(seconds * rate) // 3

    def add(done: Column, chunk: Column) -> Column:
        out = F.least(F.lit(third), F.size(done))
        into = F.least(F.lit(third), F.size(chunk))
        return F.concat(faded(done, F.lit(0), out), silence(F.lit(third)), faded(chunk, into, F.lit(0)))

    rest = F.slice(chunks, 2, F.greatest(F.size(chunks) - 1, F.lit(0)))
    return F.aggregate(rest, F.get(chunks, F.lit(0)), add)


def crossfaded(tail: Column, chunk: Column) -> Column:
    """Linear cross-fade of a held tail into the start of the next chunk."""
    n = F.least(F.size(tail), F.size(chunk))  # sizes only: cheap to repeat
    mixed = F.zip_with(
        F.zip_with(_head(tail, n), ramp(n, True), lambda x, w: x * w), F.zip_with(_head(chunk, n), ramp(n, False), lambda x, w: x * w), lambda x, y: x + y
    )
    return F.concat(mixed, F.slice(chunk, n + 1, F.greatest(F.size(chunk) - n, F.lit(0))))


def pcm16(v: Column) -> Column:
    """Samples clipped to [-1, 1] as 16-bit values, truncated towards zero."""
    return F.transform(v, lambda x: (F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x)) * 32767).cast("smallint"))


def mono(channels: Column) -> Column:
    """Mean over channels (array of arrays, channel by time)."""
    n = F.size(channels)
    zero = F.transform(F.get(channels, F.lit(0)), lambda x: F.lit(0.0))
    total = F.aggregate(channels, zero, lambda s, c: F.zip_with(s, c, lambda x, y: x + y))
    return F.transform(total, lambda x: x / n)


def crop(v: Column, start: Column, n: int) -> Column:
    return F.slice(v, (start + 1).cast("int"), F.lit(n))


def penalized(scores: Column, generated: Column, penalty: float) -> Column:
    """Repetition penalty on the ids generated so far only: negative scores times, positive ones by the penalty."""
    return F.transform(
        scores, lambda s, i: F.when(~F.array_contains(generated, i), s).otherwise(F.when(s < 0, s * penalty).otherwise(s / penalty))
    )


def nucleus(scores: Column, k: int, p: float, temperature: float = 1.0) -> Column:
    """Ids kept by top-k and then top-p: the likeliest until their probability before them reaches p; a lower temperature sharpens."""
    cooled = F.transform(scores, lambda s: s / temperature)
    ranked = F.slice(F.array_sort(F.transform(softmax(cooled), lambda q, i: F.struct((-q).alias("q"), i.alias("i")))), 1, k)
    kept = F.aggregate(
        ranked,
        F.struct(F.lit(0.0).alias("mass"), F.array().cast("array<int>").alias("ids")),
        lambda s, x: F.struct(
            (s.mass - x.q).alias("mass"), F.when(s.mass < p, F.concat(s.ids, F.array(x.i))).otherwise(s.ids).alias("ids")
        ),
    )
    return kept.ids


def cross_entropy(scores: Column, target: Column, ignore: int = -100) -> Column:
    """Negative log-likelihood of ``target`` under the softmax of ``scores``; null where the target is the ignored one."""
    return F.when(target != ignore, -F.log(F.get(softmax(scores), target)))


def masked_mean(value: Column, mask: Column) -> Column:
    """Aggregate: mean of ``value`` where ``mask`` holds; null where it never does."""
    return F.sum(F.when(mask, value.cast("double"))) / F.nullif(F.count_if(mask), F.lit(0))


def gathered_mean(items: DataFrame, ident: str, positions: str, table: DataFrame, key: str, vector: str, size: int) -> DataFrame:
    """Mean of the table's vectors at an item's positions (embedding lookup): an item's equal positions are counted first, then weigh."""
    at = items.select(ident, F.explode(positions).alias("_k")).groupBy(ident, "_k").agg(F.count("*").alias("_c"))
    hit = at.join(table.select(F.col(key).alias("_k"), F.col(vector).alias("_v")), "_k")
    means = [(F.sum(F.get("_v", F.lit(i)) * F.col("_c")) / F.sum(F.when(F.get("_v", F.lit(i)).isNotNull(), F.col("_c")))).alias(f"_{i}") for i in range(size)]
    return hit.groupBy(ident).agg(F.sum("_c").alias("found"), *means).select(ident, "found", F.array(*[f"_{i}" for i in range(size)]).alias("mean"))


def calibrated_scale(norms: Callable[[float], float], target: float, low: float = 0.3, high: float = 2.0, steps: int = 24) -> float:
    """Bisection for the scale at which the monotone ``norms(scale)`` (an aggregate over a cached table) meets ``target``."""
    for _ in range(steps):
        middle = (low + high) / 2
        low, high = (low, middle) if norms(middle) > target else (middle, high)
    return (low + high) / 2

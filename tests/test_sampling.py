import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import arrays as A
from corpusloom.operators import sampling as S


def test_interleave_follows_the_round_robin(spark):
    sources = {"a": 5, "b": 2, "c": 1}
    rows = [(s, f"{s}{i}") for s, n in sources.items() for i in range(n)]
    got = S.interleave(spark.createDataFrame(rows, "src string, id string"), "src", ["id"]).sort("i").collect()
    names = sorted(sources)
    want = [f"{names[i % 3]}{(i // 3) % sources[names[i % 3]]}" for i in range(5 * 3)]
    assert [r.id for r in got] == want and [r.i for r in got] == list(range(15))


def test_interleave_repeats_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(S, "_BLOCK", 3)
    rows = [("a", f"{i:03d}") for i in range(20)] + [("b", "x")]
    got = S.interleave(spark.createDataFrame(rows, "src string, id string"), "src", ["id"])
    assert got.where("src = 'b'").count() == 20 and got.select("i").distinct().count() == 40


def test_index_is_dense_over_partitions(spark):
    df = spark.range(1000).select(F.format_string("%05d", F.col("id")).alias("k")).repartition(7)
    got = S.indexed(df, ["k"]).sort("pos").collect()
    assert [r.pos for r in got] == list(range(1000)) and [r.k for r in got] == sorted(r.k for r in got)
    assert S.indexed(df.where("false"), ["k"]).count() == 0


def test_batches(spark):
    df = spark.range(70).select(F.format_string("%02d", F.col("id")).alias("k"))
    assert S.batches(df, ["k"], 32, drop_last=True).count() == 64
    assert S.batches(df, ["k"], 32, drop_last=False).groupBy("batch").count().count() == 3


def test_padding_and_shift(spark):
    df = spark.createDataFrame([(0, 0, [1, 2, 3]), (0, 1, [4]), (1, 0, [])], "batch int, slot int, tokens array<bigint>")
    got = {r.batch: r for r in S.pad_batches(df).collect()}
    assert got[0].inputs == [[8192, 1, 2, 3, 8193], [8192, 4, 8193, 8193, 8193]]
    assert got[0].targets == [[1, 2, 3, 8193, -100], [4, 8193, -100, -100, -100]]
    assert got[0].mask == [[True] * 5, [True] * 3 + [False] * 2] and got[1].inputs == [[8192, 8193]]


def test_seeded_choices(spark):
    df = spark.range(4000).select(F.col("id").cast("string").alias("id"), F.array(F.lit("x"), F.lit("y")).alias("a"))
    got = df.select(S.pick("a", "id", 3).alias("p"), S.shards("id", 4, 3).alias("r"), S.keep_with_probability(F.col("id"), 0.2, 3).alias("k")).agg(
        F.count_if(F.col("p") == "x"), F.count_distinct("r"), F.count_if("k")
    ).first()
    assert 1800 < got[0] < 2200 and got[1] == 4 and 700 < got[2] < 900
    assert df.select(S.pick(F.array().cast("array<string>"), F.col("id"), 1).alias("p")).where("p is not null").count() == 0


def one(spark, *columns, **arrays):
    df = spark.createDataFrame([tuple([float(x) for x in v] for v in arrays.values())], ", ".join(f"{n} array<double>" for n in arrays))
    row = df.select(*columns).first()
    return row[0] if len(columns) == 1 else tuple(row)


V = [0.5, -1.0, 2.0, 0.25]


def test_vector_kernels(spark):
    v, w = F.col("v"), F.col("w")
    n, c, z = one(spark, A.norm(v), A.cosine(v, w), A.zscore(v, w, w), v=V, w=[1.0, 2.0, 4.0, 1.0])
    assert n == pytest.approx(np.linalg.norm(V)) and c == pytest.approx(np.dot(V, [1, 2, 4, 1]) / np.linalg.norm(V) / np.linalg.norm([1, 2, 4, 1]))
    assert z == pytest.approx((np.array(V) - [1, 2, 4, 1]) / np.sqrt([1, 2, 4, 1]))
    e = np.exp(np.array(V)) / np.exp(V).sum()
    assert one(spark, A.softmax(v), v=V) == pytest.approx(e)
    mean = (e * V).sum()
    assert tuple(one(spark, A.pooled_stats(v, v), v=V)) == pytest.approx((mean, np.sqrt((e * (np.array(V) - mean) ** 2).sum())))
    assert one(spark, A.cosine(v, w), v=[0.0], w=[1.0]) is None


def test_signal_kernels(spark):
    v, w = F.col("v"), F.col("w")
    assert one(spark, A.nearest_resampled(v, F.lit(6)), v=V) == [V[i * 4 // 6] for i in range(6)]
    assert one(spark, A.nearest_resampled(v, F.lit(0)), v=V) == []
    assert one(spark, A.pcm16(v), v=[1.5, -1.5, 0.5, -0.00002]) == [32767, -32767, 16383, 0]
    assert one(spark, A.ema(v, 0.5), v=[1.0, 2.0, 4.0]) == pytest.approx(2.75)
    fade = np.concatenate([np.array(V[:3]) * [1, 0.5, 0] + np.array([4.0, 5.0, 6.0]) * [0, 0.5, 1], [7.0]])
    assert one(spark, A.crossfaded(F.slice("v", 1, 3), w), v=V, w=[4.0, 5.0, 6.0, 7.0]) == pytest.approx(fade)
    chunks = F.array(v, w)
    want = np.concatenate([np.array([1.0, 1, 1, 1]) * [1, 1, 1, 0], [0, 0], np.array([2.0, 2, 2, 2]) * [0, 1, 1, 1]])
    assert one(spark, A.joined_with_silence(chunks, 20), v=[1.0] * 4, w=[2.0] * 4) == pytest.approx(want)
    assert one(spark, A.joined_with_silence(F.array(v), 20), v=V, w=V) == V


def test_frame_count_is_the_truncated_product(spark):
    rows = spark.range(1, 2001).select("id", A.frames_of(F.col("id")).alias("n")).collect()
    assert all(r.n == int(r.id * 1.72) for r in rows)


def test_penalty_and_nucleus(spark):
    scores = [2.0, 1.0, -1.0, 0.5]
    assert one(spark, A.penalized(F.col("v"), F.array(F.lit(0), F.lit(2)), 2.0), v=scores) == [1.0, 1.0, -2.0, 0.5]
    e = np.exp(scores) / np.exp(scores).sum()
    assert one(spark, A.nucleus(F.col("v"), 3, e[0] + 1e-9), v=scores) == [0, 1]
    assert one(spark, A.nucleus(F.col("v"), 1, 1.0), v=scores) == [0]


def test_bisection():
    assert A.calibrated_scale(lambda s: 3 * s, 3.6) == pytest.approx(1.2, abs=1e-6)


def test_even_shards_drop_what_fills_no_round(spark):
    df = spark.createDataFrame([(f"i{k:02d}",) for k in range(11)], "id string")
    got = S.even_shards(df, ["id"], 4).collect()
    assert sorted((r.id, r.rank) for r in got) == [(f"i{k:02d}", k % 4) for k in range(8)]
    assert S.even_shards(df.where("false"), ["id"], 4).count() == 0


def test_cross_entropy_ignores_its_mark(spark):
    import math

    df = spark.createDataFrame([([0.0, 0.0], 1), ([0.0, math.log(3.0)], 1), ([1.0, 2.0], -100)], "v array<double>, t int")
    got = [r.l for r in df.select(A.cross_entropy(F.col("v"), F.col("t")).alias("l")).collect()]
    assert got[0] == pytest.approx(math.log(2)) and got[1] == pytest.approx(math.log(4 / 3)) and got[2] is None


def test_joined_mask_and_temperature(spark):
    row = spark.range(1).select(S.joined_mask(F.lit(2), F.lit(1), F.lit(8)).alias("m"), *[A.nucleus(F.array(*map(F.lit, (0.0, 1.0, 2.0))), 3, 0.6, t).alias(f"n{i}") for i, t in enumerate((0.1, 10.0))]).first()
    assert row.m == [True] * 6 + [False] * 2 and row.n0 == [2] and row.n1 == [2, 1]


def test_scratch_tables_are_released(spark):
    from corpusloom import runtime

    runtime.release_scratch(spark)
    kept = runtime.materialize(spark.range(3), "kept")
    path = kept.inputFiles()[0]
    assert kept.count() == 3 and runtime.release_scratch(spark) == 1
    assert not __import__("os").path.exists(path.removeprefix("file://")) and runtime.release_scratch(spark) == 0

import math

from pyspark.sql import functions as F

from corpusloom.config import PACKAGED, Thresholds
from corpusloom.operators import curation as C

T = Thresholds()
SCHEMA = "id string, audio_path string, speaker_id string, multi_speaker boolean, duration double, norm_text string, cer double, snr_db double, dnsmos double, clipping double, sr int"
GOOD = dict(id="a", audio_path="x.wav", speaker_id="s", multi_speaker=False, duration=5.0, norm_text="t", cer=0.01, snr_db=30.0, dnsmos=3.5, clipping=0.0, sr=44100)


def reasons(spark, *changes):
    rows = [tuple((GOOD | c).values()) for c in changes]
    return [r[0] for r in spark.createDataFrame(rows, SCHEMA).select(C.admission_reason(T)).collect()]


def test_reason_of_each_test(spark):
    cases = [
        ({}, None), (dict(audio_path=""), "audio_missing"), (dict(norm_text=""), "empty_text"), (dict(cer=None), "cer_missing"), (dict(cer=0.03), "cer"),
        (dict(duration=None), "duration_missing"), (dict(duration=1.9), "too_short"), (dict(duration=13.1), "too_long"), (dict(clipping=0.01), "clipping"),
        (dict(multi_speaker=True), "multi_speaker"), (dict(dnsmos=2.9), "dnsmos"), (dict(dnsmos=None, snr_db=None), "snr"), (dict(dnsmos=None, snr_db=19.0), "snr"),
        (dict(sr=16000), "sample_rate"), (dict(speaker_id=" ".strip()), "speaker_missing"),
    ]
    assert reasons(spark, *[c for c, _ in cases]) == [r for _, r in cases]


def test_limits_pass_and_first_reason_wins(spark):
    exact = dict(cer=0.02, duration=2.0, clipping=0.001, dnsmos=3.0, sr=22050)
    assert reasons(spark, exact, dict(duration=13.0), dict(dnsmos=None, snr_db=20.0)) == [None, None, None]
    assert reasons(spark, dict(cer=0.5, duration=0.1), dict(norm_text="", speaker_id=None)) == ["cer", "empty_text"]


def test_nan_passes_a_limit_and_null_fields_pass_where_allowed(spark):
    nan = math.nan
    assert reasons(spark, dict(cer=nan, clipping=nan, dnsmos=nan), dict(clipping=None, sr=None, multi_speaker=None)) == [None, None]


def test_packaged_reasons(spark):
    schema = "tier string, wav_exists boolean, norm_text string, speaker_id string, duration double, sr int"
    rows = [("C", True, "t", "s", 5.0, None), ("", True, "t", "s", 5.0, None), ("A", False, "t", "s", 5.0, None), ("A", True, "t", "", 5.0, None), ("A", True, "t", "s", 31.0, None), ("B", True, "t", "s", 30.0, None)]
    got = [r[0] for r in spark.createDataFrame(rows, schema).select(C.packaged_reason(PACKAGED)).collect()]
    assert got == ["tier_C", "tier_missing", "audio_missing", "speaker_missing", "too_long", None]


def test_references_exclude_self_break_ties_and_fall_back(spark):
    rows = [("a", "s", 5.0, 1.0, "pa"), ("b", "s", 5.0, 1.0, "pb"), ("c", "s", 5.0, 9.0, "pc"), ("d", "s", 5.0, 0.0, "pd"), ("e", "s", 99.0, 50.0, "pe"),
            ("f", "t", 1.0, 1.0, "pf"), ("g", "t", 1.0, math.nan, "pg"), ("h", "u", 5.0, 1.0, "ph")]
    df = spark.createDataFrame(rows, "id string, speaker_id string, duration double, score double, path string")
    got = {r.id: (r.refs, r.ref_source) for r in C.pick_references(df, T).collect()}
    assert got["a"] == (["pc", "pb", "pd"], "range") and got["c"] == (["pa", "pb", "pd"], "range")
    assert got["e"] == (["pc", "pa", "pb"], "range")
    assert got["f"] == (["pg"], "fallback") and got["g"] == (["pf"], "fallback") and got["h"] == ([], "none")


def test_validation_sizes(spark):
    sizes = spark.createDataFrame([(3,), (4,), (9,), (10,), (30,), (50,), (125,)], "n int").select(C.val_size(F.col("n"), 0.02))
    assert [r[0] for r in sizes.collect()] == [0, 1, 1, 1, 1, 1, 2]


def test_hash_split_matches_ranking_by_hash(spark):
    import hashlib

    rows = [(f"id{i}", "hot" if i % 3 else f"s{i % 7}") for i in range(600)]
    got = {r.id: r.split for r in C.split_by_hash(spark.createDataFrame(rows, "id string, speaker_id string"), 0.1, 5).collect()}
    by: dict = {}
    for i, s in rows:
        by.setdefault(s, []).append(i)
    for ids in by.values():
        n = len(ids)
        want = max(1, round(n * 0.1)) if n >= 10 else int(n >= 4)
        ranked = sorted(ids, key=lambda i: (hashlib.md5(f"{i}:5".encode()).hexdigest(), i))
        assert [got[i] for i in ranked] == ["val"] * want + ["train"] * (n - want)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "id string, speaker_id string, duration double, score double, path string")
    assert C.pick_references(empty, T).count() == 0
    assert C.drop_small_groups(empty, "speaker_id", 2).count() == 0
    total = C.summary(empty.withColumn("split", F.lit("train")), spark.createDataFrame([], "reason string, n bigint")).first()
    assert (total.accepted, total.hours_total, total.rejected) == (0, 0.0, 0)


def test_quantiles_are_exact(spark):
    import random

    import numpy as np

    from corpusloom.operators.quantiles import exact_quantiles

    rnd = random.Random(1)
    rows = [(g, rnd.choice([rnd.gauss(0, 1), rnd.gauss(0, 1), 0.5, None, math.nan])) for g in ["a", "b", None] * 400] + [("one", 2.0), ("none", None), ("flat", 1.0), ("flat", 1.0)]
    df = spark.createDataFrame(rows, "g string, x double")
    got = {r.g: (r.n, list(r.q)) for r in exact_quantiles(df, F.col("x"), [0.0, 0.1, 0.5, 1.0], "g", buckets=16).collect()}
    assert set(got) == {"a", "b", None, "one", "flat"}
    for g, (n, q) in got.items():
        values = [x for k, x in rows if k == g and x is not None and not math.isnan(x)]
        assert n == len(values) and np.allclose(q, np.quantile(values, [0.0, 0.1, 0.5, 1.0]))
    assert exact_quantiles(df.where("false"), F.col("x"), [0.5], "g").count() == 0


def test_score_of_a_metric_that_is_no_number(spark):
    rows = [(3.0, None, None), (math.nan, None, None), (None, math.nan, None), (None, 50.0, 0.1), (3.0, math.nan, 0.1), (3.0, None, math.nan)]
    got = [r.s for r in spark.createDataFrame(rows, "dnsmos double, snr_db double, cer double").select(C.quality_score().alias("s")).collect()]
    assert got == [30.0, None, None, 30.0, 20.0, None]


def test_report_has_a_row_per_speaker_and_reason(spark):
    done = spark.createDataFrame([("a", 3600.0, "train"), ("a", 0.0, "val"), ("b", 0.0, "train")], "speaker_id string, duration double, split string")
    gone = spark.createDataFrame([("cer", 4), ("snr", 1)], "reason string, n bigint")
    got = {(r.section, r.name): r.value for r in C.report_rows(done, gone).collect()}
    assert got["total", "accepted"] == 3 and got["total", "hours_total"] == 1 and got["rejected", "cer"] == 4 and got["speaker", "a"] == 2
    assert C.nested_summary(done, gone).first().rejected == {"cer": 4, "snr": 1}

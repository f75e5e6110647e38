import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.config import Thresholds, load_config
from corpusloom.operators.models import apply_model, factory_of, register
from corpusloom.sources import files as R
from corpusloom.sources import sinks as K


def test_manifest_reports_malformed_lines(spark, tmp_path):
    p = tmp_path / "m.jsonl"
    p.write_text('{"id": "a", "cer": NaN, "duration": 2.5}\n\n{broken\n{"id": "b", "speaker_id": null}\n')
    good, bad = R.read_manifest(spark, str(p))
    assert sorted(r.id for r in good.collect()) == ["a", "b"] and bad.count() == 1
    assert np.isnan(good.where("id = 'a'").first().cer)


def test_metadata_csv(spark, tmp_path):
    p = tmp_path / "metadata.csv"
    p.write_text(",".join(R.METADATA) + '\nwav/val/x.wav,"a, ""b""\nc",,spk ,1.5,a,nan,None,0.01,,8000,TRUE,raw/x, Val \nwav/y.wav,t,n,,null,,x,1,2,3,,no,,\n')
    rows = {r.id: r for r in R.packaged_records(R.read_metadata(spark, str(p))).collect()}
    x, y = rows["x"], rows["y"]
    assert (x.text, x.norm_text, x.tier, x.split, x.multi_speaker, x.snr_db, x.dnsmos) == ('a, "b"\nc', "a, b c", "A", "val", True, None, None)
    assert (y.norm_text, y.tier, y.split, y.duration, y.snr_db) == ("n", "", "train", None, None)


def test_training_tsv_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("vi", "w1", '"quoted', "s1", ["r1", "r2"]), ("en", "w2", "plain", "s2", [])], "lang string, wav_path string, norm_text string, semantic_ids_path string, ref_audio_paths array<string>")
    K.write_training(rows, str(tmp_path / "t"))
    back = {r.wav_path: r for r in R.read_training(spark, str(tmp_path / "t")).collect()}
    assert back["w1"].norm_text == '"quoted' and back["w1"].ref_audio_paths == ["r1", "r2"] and back["w2"].ref_audio_paths == []
    with pytest.raises(Exception, match="tab or line break"):
        K.write_training(rows.withColumn("norm_text", F.lit("a\tb")), str(tmp_path / "u"))
    with pytest.raises(Exception, match="comma"):
        K.write_training(rows.withColumn("ref_audio_paths", F.array(F.lit("a,b"))), str(tmp_path / "v"))


def test_dictionary_sets_and_sentences(spark, tmp_path):
    (tmp_path / "d.tsv").write_text("a\t1\nb\t 2 \na\t3\nbroken\n\t4\n")
    (tmp_path / "s.txt").write_text("# no\n\n Hello World \nhello\n")
    assert R.read_dictionary(spark, str(tmp_path / "d.tsv")) == {"a": "1", "b": "2"}
    assert sorted(r.word for r in R.read_word_set(spark, str(tmp_path / "s.txt")).collect()) == ["#", "hello", "no", "world"]
    assert [r.sentence for r in R.read_sentences(spark, str(tmp_path / "s.txt")).collect()] == ["Hello World", "hello"]


def test_npy_round_trip_and_resume(spark, tmp_path):
    rows = spark.createDataFrame([("a", [1, 2, 3]), ("b", []), ("c", [8191])], "id string, tokens array<bigint>")
    assert K.write_npy(rows, str(tmp_path / "npy")).where("error is not null").count() == 0
    (tmp_path / "npy" / "bad.npy").write_bytes(b"no")
    back = {r.id: r for r in R.read_npy(spark, str(tmp_path / "npy")).collect()}
    assert back["a"].tokens == [1, 2, 3] and back["b"].n == 0 and back["bad"].error
    assert [r.id for r in K.pending(spark.createDataFrame([("a",), ("z",)], "id string"), rows).collect()] == ["z"]


def test_audio_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("a", [0.0, 0.5, -1.0, 2.0])], "id string, s array<double>")
    (tmp_path / "a.wav").write_bytes(bytes(K.wav_bytes(rows, "s", 16000).first().wav))
    (tmp_path / "b.wav").write_bytes(b"RIFF")
    got = {r.path.rsplit("/", 1)[-1]: r for r in R.read_audio(spark, str(tmp_path / "*.wav")).collect()}
    assert got["a.wav"].samples == pytest.approx([0.0, 0.5, -1.0, 1.0], abs=1e-4) and got["a.wav"].sr == 16000 and got["b.wav"].error
    assert len(R.read_audio(spark, str(tmp_path / "a.wav"), 8000).first().samples) == 2


def test_existing_paths_and_checkpoints(spark):
    rows = spark.createDataFrame([("1", "/x/a", "/y/a"), ("2", "/x/b", "/y/b"), ("3", None, "/y/c")], "id string, p string, q string")
    files = spark.createDataFrame([("/y/a",), ("/x/b",), ("/y/b",)], "path string")
    got = {r.id: r.path for r in R.existing(rows, files, [F.col("p"), F.col("q")]).collect()}
    assert got == {"1": "/y/a", "2": "/x/b", "3": None}
    ck = spark.createDataFrame([("r/step_9.ckpt",), ("r/step_10.ckpt",), ("s/last.ckpt",), ("s/step_99.ckpt",), ("s/x.txt",)], "path string")
    assert {r.folder: r.path for r in R.newest_checkpoint(ck).collect()} == {"r": "r/step_10.ckpt", "s": "s/last.ckpt"}


def test_upload_and_export(spark):
    df = spark.createDataFrame([("a.WAV", 5), ("a.txt", 5), ("a.mp3", 0), ("b.ogg", 10**9)], "p string, n bigint")
    assert [r[0] for r in df.select(R.upload_error(F.col("p"), F.col("n"))).collect()] == [None, "suffix", "empty", "too_large"]
    table = spark.createDataFrame([("model.w", [1.0]), ("other.w", [2.0])], "key string, value array<double>")
    assert [(r.key, r.value) for r in K.exported(table, "model.").collect()] == [("w", [1.0])]


def test_reports_logs_and_config(spark, tmp_path):
    K.write_report(spark.createDataFrame([(1, {"a": 2})], "n int, m map<string,int>"), str(tmp_path / "r.json"))
    assert json.loads((tmp_path / "r.json").read_text()) == {"n": 1, "m": {"a": 2}}
    for _ in range(2):
        K.append_log(spark.createDataFrame([("x", None)], "a string, error string"), str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 2
    (tmp_path / "a.json").write_text('{"max_cer": 0.5, "seed": 1}')
    (tmp_path / "b.json").write_text('{"seed": 2}')
    t = Thresholds().overlay(load_config(str(tmp_path / "a.json"), str(tmp_path / "b.json")))
    assert (t.max_cer, t.seed) == (0.5, 2)
    with pytest.raises(ValueError):
        t.overlay({"nope": 1})


def test_model_contract_isolates_bad_rows(spark):
    def fake_tokenizer():
        def run(paths):
            if any(p == "bad" for p in paths):
                raise ValueError("unreadable")
            return [[len(p)] for p in paths]

        return run

    register("fake", fake_tokenizer)
    with pytest.raises(ValueError):
        register("fake", fake_tokenizer)
    with pytest.raises(KeyError):
        factory_of("none")
    rows = spark.createDataFrame([("1", "aa"), ("2", "bad"), ("3", "b")], "id string, path string")
    got = {r.id: (r.output, r.error) for r in apply_model(rows, "id", "path", factory_of("fake"), "array<bigint>").collect()}
    assert got["1"] == ([2], None) and got["3"] == ([1], None) and got["2"] == (None, "ValueError: unreadable")
    assert apply_model(rows.where("false"), "id", "path", fake_tokenizer, "array<bigint>").count() == 0


def test_one_tensor_of_a_sharded_file(spark, tmp_path):
    a, b = np.arange(6, dtype="<f4").reshape(2, 3), np.arange(4, dtype="<i8")
    header = json.dumps({"a": {"dtype": "F32", "shape": [2, 3], "data_offsets": [0, 24]}, "b": {"dtype": "I64", "shape": [4], "data_offsets": [24, 56]}, "h": {"dtype": "BF16", "shape": [1], "data_offsets": [56, 58]}}).encode()
    (tmp_path / "s1").write_bytes(len(header).to_bytes(8, "little") + header + a.tobytes() + b.tobytes() + b"\x80\x3f")
    (tmp_path / "model.safetensors.index.json").write_text(json.dumps({"weight_map": {"a": "s1", "b": "s1", "h": "s1"}}))
    assert (R.read_tensor(str(tmp_path), "a") == a).all() and (R.read_tensor(str(tmp_path), "b") == b).all() and R.read_tensor(str(tmp_path), "h")[0] == 1.0
    assert R.vector_table(spark, a).sort("id").collect()[1].v == [3.0, 4.0, 5.0]
    (tmp_path / "s1").write_bytes((tmp_path / "s1").read_bytes()[:-3])
    with pytest.raises(ValueError, match="cut short"):
        R.read_tensor(str(tmp_path), "h")


def test_packaged_records_strip_all_blanks_and_look_for_audio(spark):
    schema = "file_name string, " + ", ".join(f"{c} string" for c in R.METADATA[1:])
    row = dict.fromkeys(R.METADATA) | dict(speaker_id="\tS1 ", tier=" a\t", split="Val\t", duration="\t1.5 ", multi_speaker=" YES\n")
    meta = spark.createDataFrame([tuple((row | {"file_name": f"wav/{x}.wav"}).values()) for x in "ab"], schema)
    files = spark.createDataFrame([("/root/wav/a.wav",)], "path string")
    got = {r.id: r for r in R.packaged_records(meta, files, ("/root/", ""), spark.createDataFrame([("a", 16000)], "id string, sr int")).collect()}
    assert (got["a"].wav_exists, got["a"].sr, got["b"].wav_exists, got["b"].sr) == (True, 16000, False, None)
    assert (got["a"].speaker_id, got["a"].tier, got["a"].split, got["a"].duration, got["a"].multi_speaker) == ("S1", "A", "val", 1.5, True)
    assert all(r.wav_exists for r in R.packaged_records(meta).collect())


def test_packaged_manifest(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text('{"id": "a", "audio_path": "x/a.wav", "tier": " b\\t", "text": "t"}\n{"id": "b", "audio_path": "/abs/b.wav", "split": "TEST"}\n{"id": "c"}\nnot json\n')
    files = spark.createDataFrame([("/data/x/a.wav",), ("/abs/b.wav",)], "path string")
    rows, malformed = R.read_packaged_manifest(spark, str(tmp_path / "m.jsonl"), files, ("/data/",))
    got = {r.id: r for r in rows.collect()}
    assert (got["a"].audio_path, got["a"].wav_exists, got["a"].tier, got["a"].split, got["a"].norm_text) == ("/data/x/a.wav", True, "B", "train", "t")
    assert got["b"].wav_exists and got["b"].split == "test" and not got["c"].wav_exists and malformed.count() == 1

import json

import pytest
from pyspark.sql import functions as F

from corpusloom.operators.sampling import EOS
from corpusloom.streaming.chunks import CHUNK_SCHEMA, Windows, _Sequence, chunk_bounds, last_snapshot, pause_samples, replayed_chunks, stream_chunks, with_pauses, write_apart

SNAPSHOT = "seq_id string, step int, raw array<bigint>, is_end boolean"


def direct(snapshots, w=Windows()):
    seq, out = _Sequence(), []
    for raw, end in snapshots:
        out += seq.advance(raw, end, w)
    return out


def test_boundaries_use_the_length_at_emission():
    assert direct([(list(range(n)), n == 80) for n in range(1, 81)]) == [(0, 0, 25, False), (1, 15, 75, False), (2, 65, 80, True)]
    assert direct([(list(range(30)), False), (list(range(60)), False), (list(range(80)), True)]) == [(0, 0, 30, False), (1, 20, 80, False)]
    assert direct([(list(range(25)), True)]) == [(0, 0, 25, False)]  # ends on a boundary: nothing to flush
    assert direct([([], True)]) == [] and direct([([1, EOS], True)]) == [(0, 0, 1, True)]


@pytest.mark.parametrize("n", [0, 1, 24, 25, 26, 75, 76, 125, 300])
def test_batch_twin(spark, n):
    steps = [(list(range(k)), k == n) for k in range(1, n + 1)]
    got = spark.range(1).select(F.explode(chunk_bounds(F.lit(n))).alias("c")).select("c.*").collect()
    assert [tuple(r) for r in got] == direct(steps)


def test_stream_survives_a_restart(spark, tmp_path):
    source, sink, check = tmp_path / "in", tmp_path / "out", tmp_path / "check"
    source.mkdir()

    def feed(name, rows):
        part = tmp_path / name
        part.write_text("\n".join(json.dumps(r) for r in rows))
        part.rename(source / name)

    def drain():
        stream = spark.readStream.schema(SNAPSHOT).json(str(source))
        query = (
            stream_chunks(stream).writeStream.format("json").option("path", str(sink)).option("checkpointLocation", str(check)).trigger(availableNow=True).outputMode("append").start()
        )
        query.awaitTermination()

    row = lambda s, k, end: dict(seq_id=s, step=k, raw=list(range(k)), is_end=end)
    feed("a.json", [row("x", k, False) for k in (10, 20, 30)] + [row("y", 5, False)])
    drain()
    feed("b.json", [row("x", 20, False), row("x", 60, False), row("x", 85, True), row("y", 7, True)])  # one row comes again
    drain()
    got = sorted((r.seq_id, r.chunk_idx, r.start, r.end, r.is_final) for r in spark.read.schema(CHUNK_SCHEMA).json(str(sink)).collect())
    assert got == [("x", 0, 0, 30, False), ("x", 1, 20, 85, False), ("y", 0, 0, 7, True)]


def test_last_snapshot_and_pauses(spark):
    df = spark.createDataFrame([("x", 1, [1], False), ("x", 2, [1, 2], True)], SNAPSHOT)
    assert last_snapshot(df).first().raw == [1, 2]
    audio = spark.createDataFrame([("x", s, 0, [1.0]) for s in range(3)], "seq_id string, segment int, chunk int, samples array<double>")
    played = with_pauses(audio, 100).sort("segment", "chunk").collect()
    assert [len(r.samples) for r in played] == [1, 10, 1, 10, 1] and pause_samples(22050) == 2205


def test_replayed_sequences_and_errors_apart(spark, tmp_path):
    df = spark.createDataFrame([("a", list(range(130))), ("b", []), ("c", [7] * 10)], "id string, tokens array<bigint>")
    got = sorted(tuple(r) for r in replayed_chunks(df, 40).collect())
    assert got == [("a", 0, 0, 40, False), ("a", 1, 30, 120, False), ("a", 2, 110, 130, True), ("c", 0, 0, 10, True)]
    rows = spark.createDataFrame([("x", None), ("y", "broken")], "id string, error string")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    write_apart(stream, str(tmp_path / "data"), str(tmp_path / "errors"), str(tmp_path / "state")).awaitTermination()
    assert [r.id for r in spark.read.parquet(str(tmp_path / "data")).collect()] == ["x"]
    assert [(r.id, r.error) for r in spark.read.parquet(str(tmp_path / "errors")).collect()] == [("y", "broken")]

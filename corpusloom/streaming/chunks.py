"""Count-triggered windows over growing token sequences, batch and streaming.

A sequence arrives as snapshots: every step repeats all tokens so far. The first chunk is due at FIRST tokens, the next
ones STEP tokens after the length at the last emission; a chunk is the whole prefix, of which the part from OVERLAP
tokens before the last emission is new work. The end flushes what is left as the final chunk; a sequence that ends on
a boundary has none.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corpusloom.operators.sampling import BOS, EOS
from corpusloom.runtime import scratch_dir

CHUNK_SCHEMA = "seq_id string, chunk_idx int, start int, end int, is_final boolean"
_STATE_SCHEMA = "seen int, total int, emitted int, chunks int, step int"


@dataclass(frozen=True)
class Windows:
    first: int = 25
    step: int = 50
    overlap: int = 10


@dataclass
class _Sequence:
    """What has to be remembered of a sequence: raw tokens seen, clean tokens, length at the last emission, chunks, step."""

    seen: int = 0
    total: int = 0
    emitted: int = 0
    chunks: int = 0
    step: int = -1

    def advance(self, raw: Iterable[int], is_end: bool, w: Windows) -> Iterator[tuple[int, int, int, bool]]:
        tokens = list(raw)
        while tokens and tokens[-1] == EOS:
            tokens.pop()
        self.total += sum(t not in (BOS, EOS) for t in tokens[self.seen :])
        self.seen = max(self.seen, len(tokens))
        if self.total >= (w.first if self.emitted == 0 else self.emitted + w.step):
            yield self._emit(False, w)
        if is_end and self.total > self.emitted:
            yield self._emit(True, w)

    def _emit(self, final: bool, w: Windows) -> tuple[int, int, int, bool]:
        out = (self.chunks, max(0, self.emitted - w.overlap), self.total, final)
        self.emitted, self.chunks = self.total, self.chunks + 1
        return out


def stream_chunks(snapshots: DataFrame, w: Windows = Windows()) -> DataFrame:
    """Streaming: ``(seq_id, step, raw, is_end)`` -> chunks. State of a sequence is dropped with its end row.

    Snapshots that arrive again or late (a step not above the last one) change nothing.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seq = _Sequence(*state.get) if state.exists else _Sequence()
        rows = pd.concat(list(batches)).sort_values("step")
        out, ended = [], False
        for step, raw, is_end in zip(rows["step"], rows["raw"], rows["is_end"]):
            if ended or step <= seq.step:
                continue
            seq.step, ended = int(step), bool(is_end)
            out += [(key[0], *chunk) for chunk in seq.advance(raw if raw is not None else [], ended, w)]
        if ended:
            state.remove()
        else:
            state.update((seq.seen, seq.total, seq.emitted, seq.chunks, seq.step))
        yield pd.DataFrame(out, columns=["seq_id", "chunk_idx", "start", "end", "is_final"])

    return snapshots.groupBy("seq_id").applyInPandasWithState(run, CHUNK_SCHEMA, _STATE_SCHEMA, "append", GroupStateTimeout.NoTimeout)


def chunk_bounds(n: Column, w: Windows = Windows()) -> Column:
    """Batch twin for sequences that grew token by token: array of (chunk_idx, start, end, is_final) from the length alone."""
    empty = F.array().cast("array<int>")
    full = F.when(n >= w.first, F.sequence(F.lit(w.first), n.cast("int"), F.lit(w.step))).otherwise(empty)
    last = F.coalesce(F.get(full, F.size(full) - 1), F.lit(0))
    ends = F.when(n > last, F.concat(full, F.array(n.cast("int")))).otherwise(full)
    return F.transform(
        ends,
        lambda end, i: F.struct(
            i.alias("chunk_idx"),
            F.greatest(F.lit(0), F.coalesce(F.get(ends, i - 1), F.lit(0)) - w.overlap).alias("start"),
            end.alias("end"),
            (end > last).alias("is_final"),
        ),
    )


def last_snapshot(snapshots: DataFrame) -> DataFrame:
    """Only the last snapshot of every sequence, for consumers that do not stream."""
    return snapshots.groupBy("seq_id").agg(F.max_by("raw", "step").alias("raw"), F.max("step").alias("step"))


def pause_samples(rate: int, seconds: float = 0.3) -> int:
    """Samples of silence between the segments of a text."""
    return int(seconds * rate) // 3


def with_pauses(chunks: DataFrame, rate: int) -> DataFrame:
    """Audio chunks ``(seq_id, segment, chunk, samples)`` and a silent row between segments, in playing order."""
    last = chunks.groupBy("seq_id").agg(F.max("segment").alias("_last"))
    gaps = chunks.select("seq_id", "segment").distinct().join(last, "seq_id").where("segment < _last").select(
        "seq_id", "segment", F.lit(2**31 - 1).alias("chunk"), F.array_repeat(F.lit(0.0), pause_samples(rate)).alias("samples")
    )
    return chunks.select("seq_id", "segment", "chunk", "samples").unionByName(gaps)


def replayed_chunks(sequences: DataFrame, step: int) -> DataFrame:
    """Whole sequences ``(id, tokens)`` played as a stream of snapshots that grow by ``step`` tokens, to its end: the chunks.

    Snapshots, state and chunks are in the session's shared scratch folder.
    """
    spark = sequences.sparkSession
    root = f"{scratch_dir(spark)}/replay-{uuid.uuid4().hex}"
    n = F.size("tokens")
    last = F.greatest(F.ceil(n / step).cast("int"), F.lit(1))
    grown = sequences.select(F.col("id").alias("seq_id"), "tokens", F.explode(F.sequence(F.lit(1), last)).alias("step"), last.alias("_last"))
    snapshots = grown.select("seq_id", "step", F.slice("tokens", F.lit(1), F.col("step") * step).alias("raw"), (F.col("step") == F.col("_last")).alias("is_end"))
    snapshots.write.parquet(f"{root}/in")
    stream = spark.readStream.schema(snapshots.schema).parquet(f"{root}/in")
    query = stream_chunks(stream).writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state")
    query.trigger(availableNow=True).outputMode("append").start().awaitTermination()
    return spark.read.schema(CHUNK_SCHEMA).parquet(f"{root}/out")


def write_apart(chunks: DataFrame, data: str, errors: str, checkpoint: str):
    """Starts a stream whose rows with a null ``error`` go to ``data`` and whose others go to ``errors``: a failure never stands among the data."""

    def write(batch: DataFrame, number: int) -> None:
        kept = batch.persist()
        kept.where("error is null").drop("error").withColumn("batch", F.lit(number)).write.mode("append").parquet(data)
        kept.where("error is not null").withColumn("batch", F.lit(number)).write.mode("append").parquet(errors)
        kept.unpersist()

    return chunks.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

"""Writers: training TSV, JSON lines, reports, token files, PCM, append logs, checkpoint export."""

from __future__ import annotations

import io
import json
import wave
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.arrays import pcm16
from corpusloom.sources.files import TRAINING


def tsv_line(row: dict[str, Column]) -> Column:
    """One line without quoting; a tab or line break inside a field is an error, not a broken row."""
    fields = [F.coalesce(row[c], F.lit("")) for c in TRAINING]
    bad = F.lit(False)
    for f in fields:
        bad = bad | f.rlike("[\\t\\r\\n]")
    return F.when(bad, F.raise_error(F.concat(F.lit("tab or line break in a TSV field of "), F.coalesce(row["wav_path"], F.lit("?"))))).otherwise(
        F.concat_ws("\t", *fields)
    )


def write_training(rows: DataFrame, path: str) -> None:
    """Header-less five-column TSV; ``ref_audio_paths`` is an array. Commas inside paths cannot be told apart and are refused."""
    joined = F.when(
        F.exists("ref_audio_paths", lambda x: x.contains(",")), F.raise_error(F.lit("comma in a reference path"))
    ).otherwise(F.concat_ws(",", "ref_audio_paths"))
    columns = {c: F.col(c) for c in TRAINING} | {"ref_audio_paths": joined}
    rows.select(tsv_line(columns).alias("value")).write.mode("overwrite").text(path)


def write_json_lines(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def write_report(summary: DataFrame, path: str) -> str:
    """A one-row summary as one JSON document on the driver."""
    text = summary.select(F.to_json(F.struct("*")).alias("j")).first().j
    Path(path).write_text(json.dumps(json.loads(text), indent=2, ensure_ascii=False), encoding="utf-8")
    return text


def pending(rows: DataFrame, done: DataFrame, key: str = "id", overwrite: bool = False) -> DataFrame:
    """Rows whose output is not there yet: what a resumed run still has to do."""
    return rows if overwrite else rows.join(done.select(key).distinct(), key, "left_anti")


def write_npy(rows: DataFrame, folder: str) -> DataFrame:
    """One int64 .npy per row (id, tokens) under ``folder``, which all executors share: (id, path, error).

    A file is written under a temporary name and moved, so a lost executor leaves no half file.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        root = Path(folder.removeprefix("file://"))
        root.mkdir(parents=True, exist_ok=True)
        for batch in batches:
            out = []
            for ident, tokens in zip(batch["id"], batch["tokens"]):
                target = root / f"{ident}.npy"
                try:
                    buffer = io.BytesIO()
                    np.save(buffer, np.asarray(tokens, np.int64))
                    part = target.with_suffix(".part")
                    part.write_bytes(buffer.getvalue())
                    part.replace(target)
                    out.append((ident, str(target), None))
                except Exception as e:
                    out.append((ident, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["id", "path", "error"])

    return rows.select("id", "tokens").mapInPandas(run, "id string, path string, error string")


def _wav(samples: np.ndarray, rate: int) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(np.asarray(samples, "<i2").tobytes())
    return out.getvalue()


def wav_bytes(rows: DataFrame, samples: str, rate: int, out: str = "wav") -> DataFrame:
    """``rows`` with 16-bit WAV bytes of the samples; quantization stays in the JVM, only the container is Python."""
    quantized = rows.withColumn("_q", pcm16(F.col(samples)))
    names = rows.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch[out] = [None if q is None else _wav(q, rate) for q in batch.pop("_q")]
            yield batch[[*names, out]]

    return quantized.mapInPandas(run, rows.withColumn(out, F.lit(None).cast("binary")).schema)


def append_log(rows: DataFrame, path: str) -> None:
    """Append-only JSON log; per-mode fields are nullable columns, failures are rows with an error."""
    rows.write.mode("append").json(path)


def exported(table: DataFrame, prefix: str, kind: str = "array<float>") -> DataFrame:
    """Checkpoint export: entries (key, value) under a key prefix, the prefix taken off, the value cast."""
    return table.where(F.col("key").startswith(prefix)).select(F.substring("key", len(prefix) + 1, 2**30).alias("key"), F.col("value").cast(kind).alias("value"))

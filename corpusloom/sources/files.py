"""Readers: manifests, packaged metadata, training TSV, dictionaries, sentences, audio, checkpoints, uploads."""

from __future__ import annotations

import io
import json
import wave
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions.blanks import blank_to_null, strip_blanks
from corpusloom.functions.text import as_bool, as_float, clean_text, file_stem, first_filled
from corpusloom.runtime import broadcast_if_small, materialize

MANIFEST = (
    "id string, audio_path string, speaker_id string, multi_speaker boolean, duration double, text string, text_normalized string,"
    " cer double, snr_db double, dnsmos double, clipping double, sr int, tier string, split string"
)
METADATA = [
    "file_name", "text", "text_normalized", "speaker_id", "duration", "tier", "snr_db", "dnsmos", "cer", "clipping", "bandwidth_hz",
    "multi_speaker", "source_path", "split",
]
TRAINING = ["lang", "wav_path", "norm_text", "semantic_ids_path", "ref_audio_paths"]


def read_manifest(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """JSON lines as (records, malformed lines). Blank lines are skipped; a malformed line is reported, never fatal."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt", "allowNonNumericNumbers": "true"}
    lines = spark.read.text(path).where("trim(value) <> ''")
    parsed = lines.select("value", F.from_json("value", MANIFEST + ", _corrupt string", options).alias("r"))
    return parsed.where("r._corrupt is null").select("r.*").drop("_corrupt"), parsed.where("r._corrupt is not null").select(F.col("value").alias("line"))


def packaged_records(meta: DataFrame, files: DataFrame | None = None, roots: tuple[str, ...] = ("",), rates: DataFrame | None = None) -> DataFrame:
    """Metadata strings as records: id from the file name, numbers, booleans, tier upper, split lower (blank: train).

    ``wav_exists`` says whether the file name under one of ``roots`` is in the listing ``files`` (column path; without a listing
    all exist); ``rates`` (id, sr) gives sample rates, which the metadata lacks.
    """
    c = F.col
    if files is not None:
        meta = existing(meta, files, [F.concat(F.lit(r), c("file_name")) for r in roots], "_path").withColumn("wav_exists", c("_path").isNotNull()).drop("_path")
    else:
        meta = meta.withColumn("wav_exists", F.lit(True))
    meta = meta.withColumn("_id", file_stem(c("file_name")))
    if rates is not None:
        meta = meta.join(rates.select(c("id").alias("_id"), "sr"), "_id", "left")
    else:
        meta = meta.withColumn("sr", F.lit(None).cast("int"))
    numbers = {n: as_float(c(n)).alias(n) for n in ("duration", "snr_db", "dnsmos", "cer", "clipping")}
    return meta.select(
        c("_id").alias("id"),
        c("file_name").alias("audio_path"),
        strip_blanks(c("speaker_id")).alias("speaker_id"),
        as_bool(c("multi_speaker")).alias("multi_speaker"),
        *numbers.values(),
        "text",
        "text_normalized",
        F.upper(strip_blanks(F.coalesce("tier", F.lit("")))).alias("tier"),
        F.lower(F.coalesce(blank_to_null(c("split")), F.lit("train"))).alias("split"),
        clean_text(first_filled(c("text_normalized"), c("text"))).alias("norm_text"),
        "sr",
        "wav_exists",
        *[x for x in meta.columns if x not in (*METADATA, "_id", "sr", "wav_exists")],
    )


def read_packaged_manifest(spark: SparkSession, path: str, files: DataFrame, roots: tuple[str, ...] = ("",)) -> tuple[DataFrame, DataFrame]:
    """The packaged manifest as (records, malformed lines): tier upper, split lower (blank: train), and where its audio is.

    The path as given and under each of ``roots`` is looked up in the listing ``files``; ``audio_path`` becomes the first that is
    there, and ``wav_exists`` says whether one is.
    """
    rows, malformed = read_manifest(spark, path)
    given = F.col("audio_path")
    found = existing(rows, files, [given, *[F.concat(F.lit(r), given) for r in roots]], "_path")
    return found.withColumns(
        {
            "tier": F.upper(strip_blanks(F.coalesce("tier", F.lit("")))),
            "split": F.lower(F.coalesce(blank_to_null(F.col("split")), F.lit("train"))),
            "wav_exists": F.col("_path").isNotNull(),
            "audio_path": F.coalesce("_path", "audio_path"),
            "norm_text": clean_text(first_filled(F.col("text_normalized"), F.col("text"))),
        }
    ).drop("_path"), malformed


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """CSV with header, quoted fields with commas and line breaks; every column a string."""
    schema = T.StructType([T.StructField(n, T.StringType()) for n in METADATA])
    return spark.read.schema(schema).csv(path, header=True, multiLine=True, escape='"', quote='"', emptyValue="", enforceSchema=False)


def read_training(spark: SparkSession, *paths: str) -> DataFrame:
    """Header-less TSV files, each one source: quotes mean nothing, the reference list becomes an array."""
    schema = T.StructType([T.StructField(n, T.StringType()) for n in TRAINING])
    rows = spark.read.schema(schema).csv(list(paths), sep="\t", quote="", escape="", emptyValue="")
    return rows.withColumns({"ref_audio_paths": reference_list(F.col("ref_audio_paths")), "source": F.input_file_name()})


def reference_list(c: Column) -> Column:
    return F.filter(F.split(F.coalesce(c, F.lit("")), ","), lambda x: x != "")


def read_dictionary(spark: SparkSession, path: str) -> dict[str, str]:
    """Two tab-separated columns to a map: trimmed, incomplete lines skipped, the first line of a key wins."""
    parts = F.split("value", "\t", 2)
    lines = spark.read.text(path).select(
        F.trim(F.get(parts, F.lit(0))).alias("k"), F.trim(F.get(parts, F.lit(1))).alias("v"), F.monotonically_increasing_id().alias("at")
    )
    first = lines.where("k <> '' and v <> ''").groupBy("k").agg(F.min_by("v", "at").alias("v"))
    return {r.k: r.v for r in first.collect()}  # a lexicon, broadcast as a literal map


def read_word_set(spark: SparkSession, path: str) -> DataFrame:
    """The distinct lower-case words of a file."""
    return spark.read.text(path).select(F.explode(F.split(F.lower("value"), r"\s+")).alias("word")).where("word <> ''").distinct()


def read_sentences(spark: SparkSession, path: str) -> DataFrame:
    """Lines without blanks around them; blank lines and those that start with # are no sentences."""
    return spark.read.text(path).select(F.trim("value").alias("sentence")).where("sentence <> '' and not startswith(sentence, '#')")


def existing(rows: DataFrame, files: DataFrame, candidates: list[Column], out: str = "path") -> DataFrame:
    """``rows`` with the first of the candidate paths that is in ``files`` (column path), or null."""
    listed = files.select(F.col("path").alias("_f")).distinct()
    numbered = rows.withColumn("_c", F.array(*candidates)).withColumn("_row", F.monotonically_increasing_id())
    tries = materialize(numbered, "path-candidates")  # row numbers must not change when a lost task runs again
    hit = tries.select("_row", F.posexplode("_c").alias("_i", "_f")).join(broadcast_if_small(listed), "_f", "left_semi")
    first = hit.groupBy("_row").agg(F.min_by("_f", "_i").alias(out))
    return tries.join(first, "_row", "left").drop("_c", "_row")


def newest_checkpoint(files: DataFrame) -> DataFrame:
    """Per folder ``last.ckpt``, else the file of the highest ``step_N``; ``files`` has path."""
    parts = files.select(
        "path", F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("folder"), F.regexp_extract("path", r"([^/]*)$", 1).alias("name")
    ).where(F.col("name").endswith(".ckpt"))
    step = F.when(F.col("name") == "last.ckpt", F.lit(2**62)).otherwise(F.regexp_extract("name", r"step_(\d+)", 1).try_cast("bigint"))
    return parts.withColumn("step", step).where("step is not null").groupBy("folder").agg(F.max_by("path", "step").alias("path"))


UPLOAD_SUFFIXES = (".wav", ".flac", ".mp3", ".m4a", ".ogg")


def upload_error(path: Column, length: Column, most: int = 50 * 1024 * 1024) -> Column:
    """Why an uploaded file is refused, or null."""
    suffix = F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))
    return F.when(~suffix.isin(*UPLOAD_SUFFIXES), "suffix").when(length == 0, "empty").when(length > most, "too_large")


def _decode_wav(content: bytes) -> tuple[int, np.ndarray]:
    with wave.open(io.BytesIO(content)) as w:
        width, channels, rate = w.getsampwidth(), w.getnchannels(), w.getframerate()
        raw = w.readframes(w.getnframes())
    if width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] << 8 | b[:, 1] << 16 | b[:, 2] << 24) >> 8) / 2**23
    else:
        kind, zero = {1: (np.uint8, 128), 2: (np.int16, 0), 4: (np.int32, 0)}[width]
        x = (np.frombuffer(raw, kind).astype(np.float64) - zero) / float(2 ** (8 * width - 1))
    return rate, x.reshape(-1, channels).mean(axis=1)


def _resampled(x: np.ndarray, rate: int, to: int) -> np.ndarray:
    """Linear interpolation at the target's sample times."""
    if rate == to or not len(x):
        return x
    n = int(len(x) * to / rate)
    return np.interp(np.arange(n) * rate / to, np.arange(len(x)), x)


def read_audio(spark: SparkSession, path: str, rate: int = 16_000, max_seconds: float | None = None) -> DataFrame:
    """WAV files as mono samples of one rate: (path, sr, samples, error); what cannot be decoded has an error and no samples."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for p, content in zip(batch["path"], batch["content"]):
                try:
                    sr, x = _decode_wav(bytes(content))
                    x = x[: int(max_seconds * sr)] if max_seconds else x
                    out.append((p, sr, _resampled(x, sr, rate).astype(np.float32), None))
                except Exception as e:  # one bad file must not end the job
                    out.append((p, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["path", "sr", "samples", "error"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "path string, sr int, samples array<float>, error string")


def read_npy(spark: SparkSession, path: str) -> DataFrame:
    """Token files (.npy): (id, tokens, n, error), id being the file's stem."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for p, content in zip(batch["path"], batch["content"]):
                stem = p.rsplit("/", 1)[-1].removesuffix(".npy")
                try:
                    tokens = np.load(io.BytesIO(bytes(content)), allow_pickle=False).reshape(-1).astype(np.int64)
                    out.append((stem, tokens, len(tokens), None))
                except Exception as e:
                    out.append((stem, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["id", "tokens", "n", "error"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(path).select("path", "content")
    return files.mapInPandas(run, "id string, tokens array<bigint>, n int, error string")


_KINDS = {"F64": "<f8", "F32": "<f4", "F16": "<f2", "I64": "<i8", "I32": "<i4", "I16": "<i2", "I8": "<i1", "U8": "<u1"}


def read_tensor(folder: str, name: str, index: str = "model.safetensors.index.json") -> np.ndarray:
    """One tensor out of sharded tensor files: the index names the file, its header the byte range; nothing else is read."""
    shard = json.loads(Path(folder, index).read_text(encoding="utf-8"))["weight_map"][name]
    with open(Path(folder, shard), "rb") as f:
        size = int.from_bytes(f.read(8), "little")
        entry = json.loads(f.read(size))[name]
        begin, end = entry["data_offsets"]
        f.seek(8 + size + begin)
        raw = f.read(end - begin)
    if len(raw) != end - begin:
        raise ValueError(f"{shard} is cut short: {len(raw)} of {end - begin} bytes of {name}")
    if entry["dtype"] == "BF16":
        values = (np.frombuffer(raw, "<u2").astype(np.uint32) << 16).view(np.float32)
    else:
        values = np.frombuffer(raw, _KINDS[entry["dtype"]])
    return values.reshape(entry["shape"])


def vector_table(spark: SparkSession, rows: np.ndarray) -> DataFrame:
    """A matrix as the table (id, v), by Arrow batches."""
    vectors = pa.array(list(np.asarray(rows, np.float32)), pa.list_(pa.float32()))
    return spark.createDataFrame(pa.table({"id": pa.array(np.arange(len(rows))), "v": vectors}))


def with_input_pos(rows: DataFrame) -> DataFrame:
    """``rows`` with ``input_pos``, rising in input order: what breaks ties as a stable sort would."""
    return rows.withColumn("input_pos", F.monotonically_increasing_id())


def first_of_key(rows: DataFrame, key: str, order: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return rows.withColumn("_rank", rank).where("_rank = 1").drop("_rank")

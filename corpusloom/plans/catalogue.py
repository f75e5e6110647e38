"""Queries of the core operators: name -> callable(spark, sf_dir), and the equivalent SQL (see ``oracles``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.config import PACKAGED, Thresholds
from corpusloom.functions import arrays as A
from corpusloom.functions import text as X
from corpusloom.functions.audio import log_mel_udf, speech_fbank_udf
from corpusloom.functions.blanks import strip_blanks
from corpusloom.functions.vi_numbers import vi_number as vi_number_udf
from corpusloom.functions.vi_rules import vi_normalize_udf
from corpusloom.operators import curation as C
from corpusloom.operators import sampling as S
from corpusloom.operators import segmentation as G
from corpusloom.operators.quantiles import exact_quantiles
from corpusloom.plans.oracles import ORACLES, VI_CASES  # noqa: F401
from corpusloom.runtime import broadcast_if_small, materialize, table
from corpusloom.sources.files import newest_checkpoint, packaged_records, reference_list, upload_error
from corpusloom.sources.sinks import pending, tsv_line
from corpusloom.streaming.chunks import chunk_bounds

T = Thresholds()
QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


_JUDGED = ["id", "audio_path", "speaker_id", "multi_speaker", "duration", "cer", "snr_db", "dnsmos", "clipping", "sr", "tier", "split", "ingested_at"]


def manifest(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """One record per id, the one ingested last; only the columns asked for are shuffled."""
    rows = C.with_norm_text(table(spark, d, "manifest"))
    return C.latest(rows.select(*dict.fromkeys(["id", *columns, "ingested_at"])), "id", "ingested_at")


def judged(spark: SparkSession, d: str) -> DataFrame:
    """Records with score and reason. Of the text only its first character is carried along: the rule asks whether there is one."""
    rows = C.with_norm_text(table(spark, d, "manifest")).withColumn("norm_text", F.substring("norm_text", 1, 1))
    kept = C.latest(rows.select(*_JUDGED, "norm_text"), "id", "ingested_at")
    return kept.withColumn("score", C.quality_score()).withColumn("reason", C.admission_reason(T))


def accepted(spark: SparkSession, d: str, rows: DataFrame | None = None) -> DataFrame:
    return C.drop_small_groups((rows or judged(spark, d)).where("reason is null"), "speaker_id", T.min_utterances)


# ---- curation


@query
def clean_text(spark, d):
    return C.with_norm_text(table(spark, d, "manifest")).select("id", "norm_text", F.length("norm_text").alias("chars")).distinct()


@query
def reject_reason(spark, d):
    return judged(spark, d).select("id", F.coalesce("reason", F.lit("accepted")).alias("reason"))


@query
def reason_counts(spark, d):
    return judged(spark, d).groupBy(F.coalesce("reason", F.lit("accepted")).alias("reason")).agg(F.count("*").alias("n"))


@query
def tier_filter(spark, d):
    meta = C.latest(table(spark, d, "metadata"), "file_name", "exported_at")
    reason = F.coalesce(C.packaged_reason(PACKAGED), F.lit("accepted"))
    files = table(spark, d, "train").select(F.col("wav_path").alias("path"))  # the audio that is there
    records = packaged_records(meta, files, ("/srv/tts/s8_package/dataset/", ""), manifest(spark, d, "sr"))
    return records.select("id", "tier", "wav_exists", "sr", reason.alias("reason"))


@query
def packaged_coercion(spark, d):
    meta = C.latest(table(spark, d, "metadata"), "file_name", "exported_at")
    return packaged_records(meta).select("id", "duration", "snr_db", "dnsmos", "cer", "clipping", "multi_speaker", "tier", "split")


@query
def small_speaker_drop(spark, d):
    rows = judged(spark, d).where("reason is null")
    small = broadcast_if_small(C.small_groups(rows, "speaker_id", T.min_utterances).select("speaker_id", F.lit(True).alias("small")))
    return rows.join(small, "speaker_id", "left").groupBy("speaker_id").agg(F.count("*").alias("n"), F.coalesce(F.max("small"), F.lit(False)).alias("dropped"))


@query
def tier_speaker_counts(spark, d):
    rows = manifest(spark, d, "tier", "speaker_id").withColumn("tier", F.upper(strip_blanks(F.col("tier"))))
    return rows.groupBy("tier").agg(F.count("*").alias("n"), F.count_distinct("speaker_id").alias("speakers"))


@query
def quality_score(spark, d):
    return manifest(spark, d, "dnsmos", "snr_db", "cer").select("id", F.round(C.quality_score(), 6).alias("score"))


def _referenced(spark, d, rows=None):
    clips = accepted(spark, d, rows).select("id", "speaker_id", "duration", "score", F.col("audio_path").alias("path"), "split")
    return C.pick_references(clips, T)


@query
def pick_refs(spark, d):
    return _referenced(spark, d).select("id", F.concat_ws("|", "refs").alias("refs"), "ref_source")


@query
def pick_refs_fallback(spark, d):
    return _referenced(spark, d).groupBy("ref_source").agg(F.count("*").alias("n"), F.sum(F.size("refs")).alias("refs"))


@query
def split_field(spark, d):
    return manifest(spark, d, "split").groupBy(C.split_from_field(F.col("split")).alias("split")).agg(F.count("*").alias("n"))


@query
def split_hash(spark, d):
    return C.split_by_hash(accepted(spark, d).select("id", "speaker_id"), T.val_ratio, T.seed)


@query
def split_sizes(spark, d):
    n = accepted(spark, d).groupBy("speaker_id").agg(F.count("*").alias("n"))
    return n.select("speaker_id", "n", C.val_size(F.col("n"), 0.05).alias("val"))


def _final(spark, d):
    """Accepted clips with references, and the reasons of all others; the judged records are written once and read by every branch."""
    rows = materialize(judged(spark, d).drop("norm_text"), "judged")
    done = materialize(_referenced(spark, d, rows), "referenced")
    passed = rows.where("reason is null")
    small = broadcast_if_small(C.small_groups(passed, "speaker_id", T.min_utterances))
    reasons = (
        rows.where("reason is not null").select("reason")
        .unionByName(passed.join(small, "speaker_id", "left_semi").select(F.lit("speaker_too_few_utts").alias("reason")))
        .unionByName(done.where("ref_source = 'none'").select(F.lit("no_reference").alias("reason")))
    )
    out = done.where("ref_source <> 'none'").withColumn("split", C.split_from_field(F.col("split")))
    return out, reasons.groupBy("reason").agg(F.count("*").alias("n"))


@query
def curation_summary(spark, d):
    return C.summary(*_final(spark, d))


@query
def curation_report(spark, d):
    return C.report_rows(*_final(spark, d)).select("section", "name", F.round("value", 3).alias("value"))


@query
def training_lines(spark, d):
    rows, _ = _final(spark, d)
    joined = rows.join(manifest(spark, d, "norm_text").select("id", "norm_text"), "id")
    columns = {
        "lang": F.lit("vi"), "wav_path": F.col("path"), "norm_text": F.col("norm_text"),
        "semantic_ids_path": F.concat(F.lit("semantic/"), "id", F.lit(".npy")), "ref_audio_paths": F.concat_ws(",", "refs"),
    }
    return joined.select("id", tsv_line(columns).alias("line"))


@query
def median_token_rate(spark, d):
    tokens = table(spark, d, "token_seqs").select("id", "n")
    return C.median_rate(manifest(spark, d, "duration").select("id", "duration").join(tokens, "id")).select(F.round("median_rate", 6).alias("median_rate"), "clips", "alarm")


@query
def resume_antijoin(spark, d):
    return pending(manifest(spark, d).select("id"), table(spark, d, "token_seqs"))


@query
def existing_audio(spark, d):
    files = table(spark, d, "metadata").select(F.concat(F.lit("/srv/tts/s8_package/dataset/"), "file_name").alias("wav_path"))
    train = table(spark, d, "train").select("wav_path").distinct()
    return train.join(files, "wav_path", "left_semi").agg(F.count("*").alias("present")).crossJoin(train.agg(F.count("*").alias("listed")))


@query
def text_mismatches(spark, d):
    """Full comparison id by id: manifest ids whose packaged text is missing or different."""
    packaged = C.latest(table(spark, d, "metadata").select("file_name", "text", "exported_at"), "file_name", "exported_at").select(X.file_stem(F.col("file_name")).alias("id"), F.col("text").alias("other"), F.lit(True).alias("there"))
    joined = manifest(spark, d, "text").select("id", "text").join(packaged, "id", "left")
    return joined.where(~F.col("text").eqNullSafe(F.col("other"))).select("id", F.coalesce("there", F.lit(False)).alias("packaged"))


@query
def newest_checkpoints(spark, d):
    """Of the semantic files named in train, treated as checkpoints of their folder, the newest."""
    files = table(spark, d, "train").select(F.concat(F.lit("runs/"), "lang", F.lit("/step_"), F.regexp_extract("wav_path", r"_(\d{8})_\d{8}", 1), F.lit(".ckpt")).alias("path")).distinct()
    return newest_checkpoint(files)


@query
def upload_checks(spark, d):
    files = C.latest(table(spark, d, "metadata").select("file_name", "source_path", "duration", "exported_at"), "file_name", "exported_at").select(F.col("source_path").alias("path"), (X.as_float(F.col("duration")) * 4_000_000).cast("bigint").alias("length"))
    return files.groupBy(F.coalesce(upload_error(F.col("path"), F.coalesce("length", F.lit(0))), F.lit("ok")).alias("error")).agg(F.count("*").alias("n"))


# ---- sampling and batching


@query
def interleave_langs(spark, d):
    rows = table(spark, d, "train").select("lang", "wav_path").distinct()
    return S.interleave(rows, "lang", ["wav_path"]).select("i", "lang", "wav_path")


@query
def val_batches(spark, d):
    rows = manifest(spark, d, "split").where(C.split_from_field(F.col("split")) == "val").select("id")
    return S.batches(rows, ["id"], 32, drop_last=False).select("id", "batch", "slot")


@query
def train_batches(spark, d):
    rows = manifest(spark, d, "split").where(C.split_from_field(F.col("split")) == "train").select("id")
    return S.batches(rows, ["id"], 32, drop_last=True).groupBy("batch").agg(F.count("*").alias("n"), F.min("id").alias("first"), F.max("id").alias("last"))


@query
def token_gate(spark, d):
    return table(spark, d, "token_seqs").select("id", "n", S.admitted(F.col("tokens")).alias("admitted"))


def _label_rows(spark, d):
    return S.batches(table(spark, d, "token_seqs").where(S.admitted(F.col("tokens"))).select("id", "tokens"), ["id"], 8, drop_last=False)


@query
def pad_mask(spark, d):
    padded = S.pad_batches(_label_rows(spark, d))
    return padded.select(
        "batch",
        F.size("inputs").alias("rows"),
        F.size(F.get("inputs", F.lit(0))).alias("width"),
        F.aggregate("mask", F.lit(0), lambda s, m: s + F.size(F.filter(m, lambda x: x))).alias("real"),
        F.aggregate("targets", F.lit(0), lambda s, t: s + F.size(F.filter(t, lambda x: x != S.IGNORE))).alias("labelled"),
    )


@query
def label_shift(spark, d):
    shaped = table(spark, d, "token_seqs").select("id", S.inputs_of(F.col("tokens")).alias("inputs"), S.targets_of(F.col("tokens")).alias("targets"))
    zipped = shaped.select("id", F.posexplode(F.arrays_zip("inputs", "targets")).alias("pos", "p"))
    return zipped.select("id", "pos", F.col("p.inputs").alias("input"), F.col("p.targets").alias("target"))


@query
def cleaned_tokens(spark, d):
    raw = F.concat(F.array(F.lit(S.BOS).cast("bigint")), F.transform("tokens", lambda x: x + 700), F.array(F.lit(S.EOS).cast("bigint")))
    done = table(spark, d, "token_seqs").select("id", S.cleaned_tokens(raw).alias("t"))
    return done.select("id", F.size("t").alias("n"), F.array_max("t").alias("top"), F.aggregate("t", F.lit(0).cast("bigint"), lambda s, x: s + x).alias("total"))


@query
def reference_choice(spark, d):
    rows = table(spark, d, "train").select("wav_path", reference_list(F.col("ref_audio_paths")).alias("refs")).distinct()
    picked = rows.select("wav_path", "refs", S.pick(F.col("refs"), F.col("wav_path"), 7).alias("ref"), S.shards(F.col("wav_path"), 4, 7).alias("rank"))
    return picked.groupBy("rank").agg(F.count("*").alias("n"), F.count("ref").alias("with_ref"), F.count_if(F.array_contains("refs", F.col("ref"))).alias("valid"))


@query
def masked_accuracy(spark, d):
    """Accuracy of 'the next token is even as this one' over the labelled positions."""
    shaped = table(spark, d, "token_seqs").select("id", F.explode(F.arrays_zip(S.inputs_of(F.col("tokens")).alias("x"), S.targets_of(F.col("tokens")).alias("y"))).alias("p"))
    seen = F.col("p.y") != S.IGNORE
    hit = (F.col("p.x") % 2 == F.col("p.y") % 2).cast("int")
    return shaped.groupBy("id").agg(F.round(A.masked_mean(hit, seen), 6).alias("accuracy"), F.round(A.masked_mean(F.abs(F.col("p.x") - F.col("p.y")), seen), 6).alias("l1"))


@query
def runs_by_mode(spark, d):
    modes = F.broadcast(spark.createDataFrame([("clone",), ("continue",)], "mode string"))
    texts = table(spark, d, "train").select("lang", "norm_text").distinct()
    return texts.crossJoin(modes).groupBy("mode", "lang").agg(F.count("*").alias("n"))


@query
def speaker_sets(spark, d):
    """Speakers of manifest and metadata as set operations."""
    a, b = (table(spark, d, t).select(F.lower(strip_blanks(F.col("speaker_id"))).alias("s")).where("s <> ''").distinct() for t in ("manifest", "metadata"))
    both = a.intersect(b).agg(F.count("*").alias("n")).select(F.lit("both").alias("part"), "n")
    only = a.subtract(b).agg(F.count("*").alias("n")).select(F.lit("manifest only").alias("part"), "n")
    return both.unionByName(only)


# ---- text


@query
def detect_lang(spark, d):
    rows = table(spark, d, "manifest").where("text is not null").select("id", "text").distinct()
    return rows.select("id", X.detect_language(F.col("text")).alias("lang"), X.only_punctuation(F.col("text")).alias("marks_only"))


@query
def chinese_form(spark, d):
    rows = C.with_norm_text(table(spark, d, "manifest")).where(X.contains_han(F.col("norm_text"))).select("id", "norm_text").distinct()
    return rows.select("id", X.chinese_form(F.col("norm_text")).alias("form"))


@query
def english_numbers(spark, d):
    rows = table(spark, d, "train").where("lang = 'en'").select("wav_path", "norm_text").distinct()
    return rows.select("wav_path", X.spell_out_numbers(F.col("norm_text")).alias("form"))


@query
def prompts(spark, d):
    rows = table(spark, d, "train").select("lang", "wav_path", "norm_text").distinct()
    return rows.select("wav_path", X.prompt(F.col("lang"), F.col("norm_text")).alias("prompt"), F.coalesce(X.request_error(F.col("norm_text"), F.col("lang")), F.lit("ok")).alias("request"))


@query
def continuation_prompts(spark, d):
    """A row's text behind the whole transcript of its first reference clip."""
    rows = table(spark, d, "train").select("wav_path", "norm_text", F.get(reference_list(F.col("ref_audio_paths")), F.lit(0)).alias("ref")).distinct()
    spoken = rows.groupBy(F.col("wav_path").alias("ref")).agg(F.min("norm_text").alias("spoken"))
    joined = rows.join(spoken, "ref")
    return joined.select("wav_path", X.join_prompt_and_target(F.col("spoken"), F.col("norm_text")).alias("prompt")).distinct()


@query
def tokens_per_word(spark, d):
    words = F.size(X.words_of(F.col("norm_text")))
    rows = manifest(spark, d, "norm_text").join(table(spark, d, "token_seqs").select("id", "n"), "id")
    return rows.select("id", words.alias("words"), F.round(F.col("n") / F.greatest(words, F.lit(1)), 6).alias("rate"))


@query
def vi_number(spark, d):
    """The numbers of up to 18 digits in the training texts, each once."""
    found = table(spark, d, "train").select(F.explode(F.regexp_extract_all("norm_text", F.lit("([0-9]+)"), 1)).alias("n")).where("length(n) <= 18")
    numbers = found.select(F.col("n").cast("bigint").alias("n")).distinct()
    return numbers.select("n", vi_number_udf("n").alias("reading"))


@query
def vi_normalize(spark, d):
    rows = table(spark, d, "train").where("lang = 'vi'").select("wav_path", "norm_text").distinct()
    # a text costs a millisecond: rows are spread by number, which their few bytes would not do
    spread = rows.repartition(2 * spark.sparkContext.defaultParallelism)
    return spread.select("wav_path", vi_normalize_udf()("norm_text").alias("reading"))


@query
def vi_normalize_cases(spark, d):
    """Texts of known reading (see ``oracles.VI_CASES``)."""
    texts = spark.createDataFrame([(t,) for t in VI_CASES], "text string")
    return texts.select("text", vi_normalize_udf()("text").alias("reading"))


@query
def normalize_by_language(spark, d):
    """The dispatch over the languages of the training texts: each text's language and what the dispatch makes of the text."""
    rows = table(spark, d, "train").select("wav_path", "norm_text", "lang").distinct()
    rows = rows.where("norm_text is not null").repartition(2 * spark.sparkContext.defaultParallelism)
    language = X.normalization_language(F.col("norm_text"), F.col("lang"))
    done = rows.select("lang", language.alias("language"), (X.normalize(F.col("norm_text"), F.col("lang"), vi_normalize_udf()).rlike("[0-9]")).alias("digits"))
    return done.groupBy("lang", "language").agg(F.count("*").alias("n"), F.count_if((F.col("language") == "en") & F.col("digits")).alias("english_with_digits"))


@query
def segment_zh(spark, d):
    text = F.col("text")
    cut = G.whole_if_empty(G.segments_by_chars(text), text)
    return table(spark, d, "documents").where(X.contains_han(text)).select("doc_id", F.posexplode(cut).alias("position", "segment"))


@query
def segment_words(spark, d):
    """Every page with a text, cut by the language it is in."""
    rows = table(spark, d, "documents").where("text is not null")
    cut = G.segment_by_language_udf()
    return rows.select("doc_id", F.posexplode(cut(F.col("text"), X.detect_language(F.col("text")))).alias("position", "segment"))


# ---- vectors


def _vectors(spark, d):
    return table(spark, d, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))


@query
def l2_cosine(spark, d):
    rows = _vectors(spark, d)
    mean = rows.select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("m"))
    centre = mean.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda p: p.m).alias("c"))
    return rows.join(centre, "label").select("vec_id", F.round(A.norm(F.col("v")), 6).alias("norm"), F.round(A.cosine(F.col("v"), F.col("c")), 6).alias("cosine"))


@query
def norm_quantiles(spark, d):
    rows = _vectors(spark, d).select("label", A.norm(F.col("v")).alias("norm"))
    q = exact_quantiles(rows, F.col("norm"), [0.1, 0.5, 0.9], "label").join(rows.groupBy("label").agg(F.avg("norm").alias("m")), "label")
    return q.select("label", *[F.round(F.get("q", F.lit(i)), 6).alias(a) for i, a in enumerate(("p10", "p50", "p90"))], F.round("m", 6).alias("mean"))


@query
def zscore(spark, d):
    rows = _vectors(spark, d)
    stats = rows.select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m"), F.var_pop("x").alias("s"))
    one = stats.agg(F.array_sort(F.collect_list(F.struct("i", "m", "s"))).alias("a")).select(F.transform("a", lambda p: p.m).alias("mean"), F.transform("a", lambda p: p.s).alias("var"))
    scored = rows.crossJoin(F.broadcast(one)).select("vec_id", A.zscore(F.col("v"), F.col("mean"), F.col("var")).alias("z"))
    return scored.select("vec_id", F.posexplode("z").alias("i", "z")).select("vec_id", "i", F.round("z", 6).alias("z"))


@query
def blend(spark, d):
    rows = _vectors(spark, d)
    mean_norm = rows.agg(F.avg(A.norm(F.col("v"))).alias("target"))
    mixed = rows.withColumn("b", A.blend(F.col("v"), F.reverse("v"), 0.5)).crossJoin(F.broadcast(mean_norm))
    rescaled = mixed.withColumn("r", A.scaled(F.col("b"), F.col("target") / F.greatest(A.norm(F.col("b")), F.lit(1e-8))))
    return rescaled.select("vec_id", F.round(F.get("r", F.lit(0)), 6).alias("first"), F.round(A.norm(F.col("r")), 6).alias("norm"))


@query
def mean_subtraction(spark, d):
    """A vector as eight frames of eight: mean over time taken off, then the clamped logarithm of the magnitudes."""
    frames = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda t: F.slice("v", t * 8 + 1, 8))
    done = _vectors(spark, d).select("vec_id", A.mean_subtracted(frames).alias("f"))
    flat = done.select("vec_id", F.posexplode(F.flatten("f")).alias("i", "x"))
    return flat.select("vec_id", "i", F.round("x", 6).alias("x"), F.round(F.log(F.greatest(F.abs("x"), F.lit(1e-5))), 5).alias("log"))


@query
def pooled_stats(spark, d):
    s = A.pooled_stats(F.col("v"), F.transform("v", lambda x: x * 3))
    return _vectors(spark, d).select("vec_id", s.alias("s")).select("vec_id", F.round("s.mean", 6).alias("mean"), F.round("s.std", 6).alias("std"))


@query
def ema(spark, d):
    return _vectors(spark, d).select("vec_id", F.round(A.ema(F.col("v"), 0.9), 6).alias("ema"))


@query
def nearest_resample(spark, d):
    n = A.frames_of(F.size("v"))
    rows = _vectors(spark, d).select("vec_id", F.posexplode(A.nearest_resampled(F.col("v"), n)).alias("i", "x"))
    return rows.select("vec_id", "i", F.round("x", 6).alias("x"))


@query
def pcm_quantize(spark, d):
    return _vectors(spark, d).select("vec_id", F.posexplode(A.pcm16(A.scaled(F.col("v"), F.lit(2.0)))).alias("i", "sample"))


@query
def crossfade(spark, d):
    """Quarters of a vector joined with fades and silence, and its halves cross-faded."""
    quarters = F.array(*[F.slice("v", 16 * i + 1, 16) for i in range(4)])
    joined, mixed = A.joined_with_silence(quarters, 20), A.crossfaded(F.slice("v", 1, 12), F.slice("v", 13, 52))
    edged = A.fade_and_pad(F.col("v"), 30)
    return _vectors(spark, d).select(
        "vec_id", *[F.size(x).alias(f"{n}_n") for n, x in (("joined", joined), ("mixed", mixed), ("edged", edged))],
        *[F.round(F.aggregate(x, F.lit(0.0), lambda s, y: s + y), 5).alias(f"{n}_sum") for n, x in (("joined", joined), ("mixed", mixed), ("edged", edged))],
    )


@query
def nucleus(spark, d):
    scores = A.penalized(F.col("v"), F.array(*[F.lit(i) for i in range(0, 64, 7)]), 1.3)
    return _vectors(spark, d).select("vec_id", A.nucleus(scores, 20, 0.3).alias("ids")).select("vec_id", F.size("ids").alias("kept"), F.get("ids", F.lit(0)).alias("likeliest"))


@query
def gathered_mean(spark, d):
    """Token sequences through the embedding table (ids folded onto its rows): mean vector per sequence."""
    rows = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    size = rows.count()
    items = table(spark, d, "token_seqs").where("n > 0").select("id", F.transform("tokens", lambda x: x % size).alias("rows"))
    done = A.gathered_mean(items, "id", "rows", rows, "vec_id", "v", 64)
    return done.select("id", "found", F.round(F.get("mean", F.lit(0)), 6).alias("m0"), F.round(F.get("mean", F.lit(63)), 6).alias("m63"))


@query
def calibrated_scale(spark, d):
    """The scale that brings the mean norm of one half of the table to that of the other, by bisection on the halves' means."""
    halves = _vectors(spark, d).groupBy((F.col("vec_id") % 2).alias("odd")).agg(F.avg(A.norm(F.col("v"))).alias("m"))
    mean = {r.odd: r.m for r in halves.collect()}
    scale = A.calibrated_scale(lambda s: s * mean[1], mean[0])  # a mean of norms is linear in the scale
    return spark.createDataFrame([(round(scale, 4),)], "scale double")


@query
def vector_bytes(spark, d):
    """Parameters and bytes of the embedding table as 32-bit floats, in all and per label."""
    rows = table(spark, d, "embeddings").select("label", F.size("embedding").cast("bigint").alias("n"))
    per = rows.groupBy("label").agg(F.sum("n").alias("parameters"))
    total = rows.agg(F.sum("n").alias("parameters")).select(F.lit(None).cast("int").alias("label"), "parameters")
    return per.select(F.col("label").cast("int").alias("label"), "parameters").unionByName(total).withColumn("bytes", F.col("parameters") * 4)


@query
def cross_entropy(spark, d):
    """Mean negative log-likelihood of each vector's label under the softmax of its first ten values; labels above nine are ignored."""
    rows = _vectors(spark, d).select("vec_id", F.slice("v", 1, 10).alias("v"), "label")
    loss = A.cross_entropy(F.col("v"), F.when(F.col("label") < 10, F.col("label")).otherwise(-100))
    return rows.agg(F.round(F.avg(loss), 6).alias("loss"), F.count(loss).alias("counted"))


# ---- chunks


def _chunks(spark, d):
    return table(spark, d, "token_seqs").select("id", "n", F.explode(chunk_bounds(F.col("n"))).alias("c")).select("id", "n", "c.*")


@query
def count_chunks(spark, d):
    return _chunks(spark, d).groupBy("id", "n").agg(F.count("*").alias("chunks"), F.count_if("is_final").alias("final"))


@query
def overlap_slices(spark, d):
    return _chunks(spark, d).select("id", "chunk_idx", "start", "end", A.frames_of(F.col("end") - F.col("start")).alias("frames"))


@query
def final_flush(spark, d):
    return _chunks(spark, d).where("is_final").select("id", "start", "end")


@query
def streamed_chunks(spark, d):
    """The token series as a stream of growing snapshots through the stateful operator, to its end: the windows it emits."""
    from corpusloom.streaming.chunks import replayed_chunks

    return replayed_chunks(table(spark, d, "token_seqs").select("id", "tokens"), 40)


# ---- audio


@query
def mel_frames(spark, d):
    """How many log-mel and filter-bank frames the token series have when read as waveforms."""
    wave = table(spark, d, "token_seqs").select("id", F.transform("tokens", lambda x: x / 8192.0 - 0.5).alias("w"))
    mel, bank = log_mel_udf(n_fft=256, hop=64, bands=20), speech_fbank_udf(bands=20)
    return wave.select("id", mel("w").alias("m"), bank("w").alias("f")).select(
        "id", F.size("m").alias("mel_frames"), F.size("f").alias("bank_frames"), F.forall("m", lambda x: F.size(x) == 20).alias("whole")
    )

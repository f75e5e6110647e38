"""Queries of the training-data operators: name -> callable(spark, sf_dir)."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.llm import bin_packing, contributor_cap, crosssplit, grouped_split, junk_pages, mixture, quantile_cut, textforms, tokens
from corpusloom.llm.corpus import load, read_columns, records
from corpusloom.runtime import materialize

EVALUATION = ["val", "test"]


def _scored(spark, d):
    return records(load(spark, d, "metadata"), "speaker", "dnsmos", "cer").select(
        F.col("file_name").alias("id"), F.col("speaker").alias("contributor"), F.col("dnsmos").alias("score"), F.col("cer").alias("penalty")
    )


def p1_found(spark, d):
    cut = contributor_cap.cut_records(_scored(spark, d), load(spark, d, "curation_target"))
    return cut.select(F.col("id").alias("file_name"))


def p1_kept_per_speaker(spark, d):
    kept = contributor_cap.kept_records(_scored(spark, d), load(spark, d, "curation_target"))
    return kept.groupBy(F.col("contributor").alias("speaker_id")).agg(F.count("*").alias("kept"))


def _coded(spark, d):
    read = read_columns(meta := load(spark, d, "metadata"))
    rows = meta.select("file_name", read["split"].alias("split"), read["text"].alias("text")).where("file_name is not null")
    return crosssplit.coded_texts(rows, "file_name", "split", "text")


def p2_found(spark, d):
    pairs = crosssplit.overlaps(_coded(spark, d), EVALUATION)
    return pairs.select(F.least("train_file", "eval_file").alias("file_name_a"), F.greatest("train_file", "eval_file").alias("file_name_b")).distinct()


def p2_overlap_report(spark, d):
    pairs = crosssplit.overlaps(_coded(spark, d), EVALUATION)
    read = read_columns(meta := load(spark, d, "metadata"))
    source = meta.select(F.col("file_name").alias("eval_file"), read["source_path"].alias("source_path")).distinct()
    return (
        pairs.join(source, "eval_file")
        .groupBy(F.col("eval_split").alias("split"), "source_path")
        .agg(F.count_distinct("eval_file").alias("records"), F.count_distinct("eval_file", "train_file").alias("pairs"))
    )


def _cutoffs(spark, d):
    rows = records(load(spark, d, "metadata"), "speaker", "dnsmos").select(
        F.col("file_name").alias("id"), F.col("speaker").alias("source"), F.col("dnsmos").alias("score")
    )
    rows = materialize(rows.where("source is not null and score is not null"), "scored-records")  # read by the counts and by the result
    return rows, quantile_cut.score_cutoffs(rows, load(spark, d, "curation_target"))


def p3_found(spark, d):
    return quantile_cut.kept_by_cutoff(*_cutoffs(spark, d)).select(F.col("id").alias("file_name"))


def p3_cutoffs(spark, d):
    return _cutoffs(spark, d)[1].select(F.col("source").alias("speaker_id"), "cutoff", "n", "wanted", "kept")


def _components(spark, d):
    rows = records(load(spark, d, "metadata"), "speaker", "split").select(F.col("file_name").alias("id"), "speaker", "split")
    return grouped_split.components(rows, ["speaker"])


def p4_found(spark, d):
    weights = grouped_split.component_weights(_components(spark, d))
    return weights.where("component like 'key:%' and splits > 1").select(F.substring("component", 5, 1_000_000).alias("speaker_id"))


def p4_new_splits(spark, d):
    placed = grouped_split.assign_splits(_components(spark, d), load(spark, d, "split_target"))
    return placed.select(F.col("id").alias("file_name"), F.col("speaker").alias("speaker_id"), "split", "new_split")


def p4_split_shares(spark, d):
    placed = grouped_split.assign_splits(_components(spark, d), load(spark, d, "split_target"))
    target = load(spark, d, "split_target").select(F.col("split").alias("new_split"), F.col("share_pct").alias("wanted_pct"))
    sizes = placed.groupBy("new_split").agg(F.count("*").alias("n"), F.count_distinct("speaker").alias("speakers"))
    total = sizes.agg(F.sum("n").alias("total"))
    return sizes.join(target, "new_split", "full").crossJoin(total).select(
        F.col("new_split").alias("split"), "wanted_pct", F.coalesce("n", F.lit(0)).alias("n"), "speakers", (100 * F.coalesce("n", F.lit(0)) / F.col("total")).alias("share_pct")
    )


def p4_split_checks(spark, d):
    """What must hold of the new splits: every record placed, no speaker in two, no split off its share by a percent of the records."""
    placed = materialize(grouped_split.assign_splits(_components(spark, d), load(spark, d, "split_target")), "new-splits")
    torn = placed.where("speaker is not null").groupBy("speaker").agg(F.count_distinct("new_split").alias("k")).where("k > 1").agg(F.count("*").alias("torn_speakers"))
    target = load(spark, d, "split_target").select(F.col("split").alias("new_split"), "share_pct")
    sizes = placed.groupBy("new_split").agg(F.count("*").alias("n")).join(target, "new_split", "full")
    total = placed.agg(F.count("*").alias("records"))
    off = sizes.crossJoin(total).agg(F.count_if(F.abs(F.coalesce("n", F.lit(0)) - F.col("share_pct") * F.col("records") / 100) > 0.01 * F.col("records")).alias("missed_shares"))
    return total.crossJoin(torn).crossJoin(off)


def p5_found(spark, d):
    return textforms.same_look_pairs(load(spark, d, "manifest"), "id", "text_normalized", load(spark, d, "train"), "wav_path", "norm_text")


def p5_unified_text(spark, d):
    formed = textforms.add_form(load(spark, d, "manifest").select("id", "text_normalized").distinct(), "text_normalized", "unified")
    return formed.groupBy("unified").agg(F.count_distinct("text_normalized").alias("spellings"), F.count_distinct("id").alias("ids")).where("spellings > 1")


def _sized(spark, d, *others):
    docs = load(spark, d, "documents")
    return materialize(tokens.count_tokens(docs, "doc_id", "text", list(others)).withColumnRenamed("doc_id", "id"), "token-counts")


def p6_containers(spark, d):
    packed = bin_packing.pack(_sized(spark, d), load(spark, d, "pack_spec"))
    return packed.withColumnRenamed("id", "doc_id").withColumn("tokenizer", F.lit(tokens.TOKENIZER))


def p6_packing_report(spark, d):
    specs = load(spark, d, "pack_spec")
    return bin_packing.packing_report(bin_packing.pack(_sized(spark, d), specs), specs).withColumn("tokenizer", F.lit(tokens.TOKENIZER))


def p6_packing_checks(spark, d):
    """What must hold of the containers of each spec: none overfull, each document there, cut only where it exceeds one, all tokens placed."""
    sized, specs = _sized(spark, d), load(spark, d, "pack_spec")
    packed = materialize(bin_packing.pack(sized, specs), "packed")
    per = packed.groupBy("spec_id", "shard", "container").agg(F.sum("tokens").alias("used")).join(specs, "spec_id")
    full = per.groupBy("spec_id").agg(F.count_if(F.col("used") > F.col("capacity_tokens")).alias("overfull"))
    by_doc = packed.groupBy("spec_id", "id").agg(F.count("*").alias("pieces"), F.sum("tokens").alias("placed")).join(specs, "spec_id").join(sized.select("id", "tokens"), "id")
    docs = by_doc.groupBy("spec_id").agg(
        F.count("*").alias("documents"),
        F.count_if(F.col("placed") != F.col("tokens")).alias("changed"),
        F.count_if(F.col("pieces") != F.ceil(F.col("tokens") / F.col("capacity_tokens"))).alias("cut_too_often"),
    )
    return full.join(docs, "spec_id")


def p7_mixture(spark, d):
    drawn, _ = mixture.mix(_sized(spark, d, "source"), load(spark, d, "mix_target"))
    return drawn.withColumnRenamed("id", "doc_id").withColumn("tokenizer", F.lit(tokens.TOKENIZER))


def p7_share_report(spark, d):
    _, report = mixture.mix(_sized(spark, d, "source"), load(spark, d, "mix_target"))
    return report.withColumn("tokenizer", F.lit(tokens.TOKENIZER))


def p7_share_checks(spark, d):
    """What must hold of the mixture: a row per listed source, no document above its repeats, no share off by 0.2 points
    of what the sources with documents can have (sources of under 20 documents are as near as whole documents allow)."""
    sized, target = _sized(spark, d, "source"), load(spark, d, "mix_target")
    drawn, report = mixture.mix(sized, target)
    over = drawn.join(target.select("source", "max_repeats"), "source").groupBy("source").agg(F.count_if(F.col("times") > F.col("max_repeats")).alias("over"))
    there = report.where("available > 0 and wanted_pct > 0").agg(F.sum("wanted_pct").alias("there"))
    off = F.abs(F.col("actual_pct") - F.when(F.col("available") > 0, 100 * F.col("wanted_pct") / F.col("there")).otherwise(0)) > 0.2
    few = sized.where("tokens > 0").groupBy("source").agg(F.count("*").alias("held"))
    joined = report.crossJoin(there).join(over, "source", "left").join(few, "source", "left")
    return joined.select("source", F.round("wanted_pct", 6).alias("wanted_pct"), (off & (F.coalesce("held", F.lit(20)) >= 20)).alias("off"), F.coalesce("over", F.lit(0)).alias("over"))


def p8_found(spark, d):
    return junk_pages.junk_pages(load(spark, d, "documents"), hint="lang").select("doc_id").distinct()


def p8_junk_by_source(spark, d):
    docs = load(spark, d, "documents")
    shares = junk_pages.junk_shares(docs, hint="lang")
    return docs.select("doc_id", "source").join(shares, "doc_id").groupBy("source", "lang").agg(
        F.count("*").alias("pages"), F.count_if(F.col("junk_share") > 0.5).alias("junk"), F.avg("junk_share").alias("mean_junk_share")
    )


QUERIES = {
    "p1_found": p1_found,
    "p1_kept_per_speaker": p1_kept_per_speaker,
    "p2_found": p2_found,
    "p2_overlap_report": p2_overlap_report,
    "p3_found": p3_found,
    "p3_cutoffs": p3_cutoffs,
    "p4_found": p4_found,
    "p4_new_splits": p4_new_splits,
    "p4_split_shares": p4_split_shares,
    "p4_split_checks": p4_split_checks,
    "p5_found": p5_found,
    "p5_unified_text": p5_unified_text,
    "p6_containers": p6_containers,
    "p6_packing_report": p6_packing_report,
    "p6_packing_checks": p6_packing_checks,
    "p7_mixture": p7_mixture,
    "p7_share_report": p7_share_report,
    "p7_share_checks": p7_share_checks,
    "p8_found": p8_found,
    "p8_junk_by_source": p8_junk_by_source,
}

from corpusloom.llm.oracles import ORACLES  # noqa: E402, F401

"""The queries of the training-data problems: each runs an operator, with production parameters, over its whole tables."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumiscript.llm import confusables, consensus, cutoff, langid, leakage, packing, pairs, repetition, scans, subjects
from lumiscript.llm.common import checkpointed, table


@lru_cache(maxsize=4)
def fitted_languages(spark: SparkSession, sf_dir: str) -> langid.LangModel:
    samples = table(spark, sf_dir, "subject_samples").select("text", "lang")
    corpus = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", "lang")
    return langid.fit_languages(samples, corpus)


def language_model(spark: SparkSession, sf_dir: str) -> langid.LangModel:
    """Fitted once a session for each set of tables."""
    return fitted_languages(spark, sf_dir)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = language_model(spark, sf_dir)
    docs = langid.document_languages(table(spark, sf_dir, "documents"), model, ["doc_id", "lang"])
    docs = langid.mislabelled(docs, "lang").select(F.lit("documents").alias("tbl"), F.col("doc_id").alias("rec_id"), "langs")
    gens = langid.document_languages(table(spark, sf_dir, "generations"), model, ["gen_id"], "output")
    gens = gens.filter((F.size("langs") > 1) | (F.col("main") != "vi") & (F.col("n_words") >= langid.MIN_WORDS - 1e-6)).select(F.lit("generations").alias("tbl"), F.col("gen_id").alias("rec_id"), "langs")
    return docs.unionByName(gens).select("tbl", "rec_id", F.explode("langs").alias("lang")).distinct()


def p1_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = language_model(spark, sf_dir)
    docs = langid.language_segments(table(spark, sf_dir, "documents"), model, ["doc_id"]).withColumn("tbl", F.lit("documents")).withColumnRenamed("doc_id", "rec_id")
    gens = table(spark, sf_dir, "generations").select("gen_id", "output").dropDuplicates(["gen_id"])
    gens = langid.language_segments(gens, model, ["gen_id"], "output").withColumn("tbl", F.lit("generations")).withColumnRenamed("gen_id", "rec_id")
    return docs.unionByName(gens).select("tbl", "rec_id", "seg", F.round("n_words", 1).alias("n_words"), "lang", F.round("confidence", 6).alias("confidence"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, _ = consensus.consensus(table(spark, sf_dir, "labels"))
    return items.filter("holds").select("id", "tag", "code")


def p2_reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, annotators = consensus.consensus(table(spark, sf_dir, "labels"))
    return annotators.select("annotator", "code", F.round("sensitivity", 4).alias("sensitivity"), F.round("specificity", 4).alias("specificity"))


def p2_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consensus.agreement(table(spark, sf_dir, "labels"))


def p3_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Redelivered rows are equal, so they are dropped after the map, when no text is left."""
    rows = table(spark, sf_dir, "generations").select("gen_id", "output")
    return repetition.repetitive(checkpointed(repetition.repetition_measures(rows, ["gen_id"], "output").distinct()))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By the posterior alone."""
    return p3_measures(spark, sf_dir).filter("repetitive >= 0.5").select("gen_id").distinct()


def p3_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = p3_measures(spark, sf_dir)
    return m.select("gen_id", "n_words", "copy_words", *[F.round(c, 6).alias(c) for c in ("repeat_share", "sentence_share", "line_share", "paragraph_share", "phrase_share", "repetitive")])


def scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [table(spark, sf_dir, t).select(F.lit(t).alias("tbl"), "unit_id", "text") for t in ("articles", "procedures")]
    return parts[0].unionByName(parts[1])


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["tbl", "unit_id"]
    return scans.noise_kinds(scans.noise(scanned(spark, sf_dir), keys), keys)


def p4_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, keys = scanned(spark, sf_dir), ["tbl", "unit_id"]
    return scans.repaired(df, scans.noise(df, keys), keys)


LOOKALIKE_FIELDS = (("articles", "unit_id", "text"), ("qa_items", "id", "question"), ("generations", "gen_id", "output"))


def lookalike_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [table(spark, sf_dir, t).select(F.lit(t).alias("tbl"), F.col(k).cast("string").alias("rec_id"), F.col(c).alias("text")).filter("rec_id IS NOT NULL") for t, k, c in LOOKALIKE_FIELDS]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return confusables.lookalike_records(lookalike_fields(spark, sf_dir), ["tbl", "rec_id"])


def p5_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lookalike_fields(spark, sf_dir).groupBy("tbl", "rec_id").agg(F.max("text").alias("text"))  # redelivered rows are equal
    return confusables.consistent_form(rows, ["tbl", "rec_id"])


def answer_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Redelivered rows are equal but for their arrival, so each gives the same defects."""
    g = table(spark, sf_dir, "generations").filter("gen_id IS NOT NULL").select(F.concat(F.lit("generations:"), F.col("gen_id")).alias("key"), F.col("prompt").alias("q"), F.col("output").alias("a"), "finish_reason")
    q = table(spark, sf_dir, "qa_items").filter("id IS NOT NULL").select(F.concat(F.lit("qa_items:"), F.col("id")).alias("key"), F.col("question").alias("q"), F.col("answer_reference").alias("a"), F.lit(None).cast("string").alias("finish_reason"))
    return g.unionByName(q)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    voted = pairs.voted_pairs(answer_pairs(spark, sf_dir), language_model(spark, sf_dir), "key", "q", "a", "finish_reason")
    found = pairs.defective_pairs(voted, "key")
    return found.select(F.substring_index("key", ":", 1).alias("tbl"), F.expr("substring(key, instr(key, ':') + 1)").alias("rec_id"), "defect")


def outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "generations").filter("gen_id IS NOT NULL").select("gen_id", "tag", "output")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cutoff.cut_off(outputs(spark, sf_dir)).select("gen_id").distinct()


def p7_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = outputs(spark, sf_dir)
    return cutoff.cut_rates(rows, cutoff.cut_off(rows))


#: Sources that don't share a container: the calibration mix and text that nobody has reviewed.
APART = (("calib_mix", "forum"), ("calib_mix", "news"))


def p8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pack_sizes"), apart=APART)


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def subject_model(spark: SparkSession, sf_dir: str) -> subjects.SubjectModel:
    return subjects.fit_subjects(table(spark, sf_dir, "subject_samples"), table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subjects.document_subjects(table(spark, sf_dir, "documents"), subject_model(spark, sf_dir), ["doc_id"]).select("doc_id", "subject").distinct()


def p10_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The composition of each source by subject."""
    docs = subjects.document_subjects(table(spark, sf_dir, "documents"), subject_model(spark, sf_dir), ["doc_id", "source"])
    return docs.groupBy("source", "subject").agg(F.count("*").alias("n_docs"), F.round(F.sum("share"), 4).alias("weight"), F.round(F.avg("score"), 6).alias("mean_score"))


QUERIES = {f.__name__: f for f in (p1_found, p1_segments, p2_found, p2_reliability, p2_agreement, p3_found, p3_share, p4_found, p4_repaired, p5_found, p5_text, p6_found, p7_found, p7_rates, p8_pack, p9_found, p10_found, p10_composition)}

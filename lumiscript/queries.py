"""The queries of the core operators over the driver's tables; ``oracle`` has their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumiscript.functions import segment
from lumiscript.functions import text as T
from lumiscript.operators import agreement, amend, citations, corpus, detect, parse, retrieval, sample, stats
from lumiscript.plans import jobs
from lumiscript.sources.files import missing_from

CODES = list(detect.CODES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generations without redelivered rows (they are equal but for the arrival)."""
    return table(spark, sf_dir, "generations").drop("ingested_at").dropDuplicates(["gen_id"])


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles without redelivered rows."""
    return table(spark, sf_dir, "articles").drop("collected_at").dropDuplicates(["unit_id"])


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "qa_items").drop("created_at").dropDuplicates(["id"])


def r6(c) -> object:
    return F.round(c, 6)


# --- text -------------------------------------------------------------------


def text_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words are cut out once, in a projection of their own that the measures share."""
    t, w = F.col("text"), F.col("w")
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", T.words(F.lower(t)).alias("w"))
    return rows.select("doc_id", F.size(w).cast("bigint").alias("n_words"), r6(T.diacritic_ratio(t)).alias("diacritic_ratio"), r6(F.when(t.isNotNull(), T.ngram_share(w))).alias("max_ngram_repeat"), r6(T.max_line_repeat(t)).alias("max_line_repeat"), F.size(T.english_runs_of(w)).cast("bigint").alias("n_english_runs"), F.size(T.foreign_script_hits(t)).cast("bigint").alias("n_foreign"), T.looks_truncated(t).alias("truncated"))


def flagged_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """gen_id, tag, the flags and confusion terms of each output; redelivered rows are equal, so they are dropped when no text is left to shuffle."""
    sig = detect.signals(table(spark, sf_dir, "generations"), ["gen_id", "tag"], "output", "finish_reason")
    return detect.with_flags(sig).select("gen_id", "tag", *CODES, "confusion_terms").dropDuplicates(["gen_id"])


def text_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flagged_outputs(spark, sf_dir).select("gen_id", "tag", "E2", "E5", "E6", detect.needs_review().alias("review"), detect.primary_flag().alias("primary_flag"))


def flag_rate_by_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.flag_rates(flagged_outputs(spark, sf_dir), "tag").select("tag", "n", *[F.col(c).alias(f"pct_{c.lower()}") for c in ("E2", "E5", "E6")])


def fold_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    lex = detect.lexicon(questions(spark, sf_dir), "question")
    return lex.groupBy("folded").agg(F.count("*").alias("n_surfaces"), F.sum("cnt").alias("cnt"), F.max("surface").alias("last_surface"))


def tone_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    lex = detect.lexicon(articles(spark, sf_dir))
    found = detect.tone_loss(outputs(spark, sf_dir), lex, ["gen_id"], "output")
    return found.select("gen_id", F.size("tokens").cast("bigint").alias("n_tokens"), F.element_at("tokens", 1).alias("first_token"), F.element_at("tokens", -1).alias("last_token"))


def glue_ratio_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("source", T.glue_ratio(F.col("text")).alias("g"))
    return d.groupBy("source").agg(F.count("*").alias("n"), r6(F.avg("g")).alias("mean_glue"), r6(F.max("g")).alias("max_glue"))


def clean_pdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return articles(spark, sf_dir).filter("text IS NOT NULL").select("unit_id", T.clean_pdf_text(F.col("text")).alias("text"))


def clean_pasted(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "procedures").drop("collected_at").dropDuplicates(["unit_id"])
    return p.select("unit_id", T.clean_pasted(F.col("text")).alias("c")).select("unit_id", F.length("c.text").cast("bigint").alias("n_chars"), "c.nav_lines_dropped", "c.tail_chars_cut")


def mojibake_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = T.mojibake_hits(F.col("output"))
    kind = lambda k: F.size(F.filter(hits, lambda x: F.startswith(x, F.lit(k)))).cast("bigint")
    rows = outputs(spark, sf_dir).filter("output IS NOT NULL")
    return rows.select("gen_id", kind("bigram ").alias("n_bigrams"), kind("lead ").alias("n_leads"), kind("U+FFFD").alias("has_replacement"), F.size(T.foreign_script_hits(F.col("output"))).cast("bigint").alias("n_foreign"))


def confusion_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = outputs(spark, sf_dir).select("tag", F.explode(T.confusion_terms(F.col("output"))).alias("term"))
    return terms.groupBy("tag", "term").agg(F.count("*").alias("n"))


def scan_triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, pages = F.col("text"), F.ceil(F.length("text") / 1800.0)
    rows = table(spark, sf_dir, "procedures").drop("collected_at").dropDuplicates(["unit_id"])
    return rows.groupBy(T.triage(t, pages).alias("verdict")).agg(F.count("*").alias("n"))


def question_crosscheck(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By the first sixteen characters of the questions, so that sources share some."""
    rows = questions(spark, sf_dir).withColumn("question", F.left("question", F.lit(16)))
    return corpus.hash_crosscheck(rows, "source_of_question", "question", "question_type")


def chunks_basic(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.chunks(F.col("text"))).alias("chunk", "text"))
    return rows.select("doc_id", "chunk", F.length("text").cast("bigint").alias("n_chars"))


def desegment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles glued by the removal of blanks, split again with the syllables of the articles."""
    a = articles(spark, sf_dir).filter("text IS NOT NULL")
    known = segment.syllables(a)
    out = segment.desegmented(a.select("unit_id", F.regexp_replace("text", r"(\p{L}) (?=\p{L})", "$1").alias("text")), known)
    return out.select("unit_id", r6("glue_before").alias("glue_before"), r6("glue_after").alias("glue_after"), F.size(T.words(F.col("text"))).cast("bigint").alias("n_words"))


# --- parsing and citations ---------------------------------------------------


def parse_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = parse.parse_articles(table(spark, sf_dir, "documents"))
    points = F.aggregate(F.transform("khoan", lambda k: F.size(k["diem"])), F.lit(0), lambda x, y: x + y)
    return a.select("doc_id", "ord", "dieu", F.size("khoan").cast("bigint").alias("n_clauses"), points.cast("bigint").alias("n_points"), F.size("bienbao").cast("bigint").alias("n_signs")).withColumn("ord", F.col("ord").cast("bigint"))


def parse_procedures(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "procedures").select(F.col("unit_id").alias("doc_id"), "text").distinct()
    return parse.parse_procedures(p).select(F.col("doc_id").alias("unit_id"), "ma", "ten", F.length("text").cast("bigint").alias("n_chars"))


def citation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = outputs(spark, sf_dir).select("gen_id", F.inline(citations.citations(F.col("output"))))
    return rows.groupBy("gen_id", "kind").agg(F.count("*").alias("n"), F.min("value").alias("first_value"))


def citation_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = citations.citation_index(articles(spark, sf_dir))
    g = citations.gate(outputs(spark, sf_dir).filter("output IS NOT NULL"), index, ["gen_id"], "output")
    return g.select("gen_id", "total", "unknown", "ok", r6("rate").alias("rate"))


def retrieval_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a bound of 600 characters, so that articles of the test data are cut into clauses."""
    return parse.retrieval_units(articles(spark, sf_dir), 600)


def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.corpus_stats(articles(spark, sf_dir))


def corpus_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.corpus_check(table(spark, sf_dir, "articles"))


def without_sevenths(a: DataFrame) -> DataFrame:
    return a.filter(~F.coalesce(F.col("dieu").rlike("^[0-9]+$") & (F.expr("try_cast(dieu AS bigint)") % 7 == 0), F.lit(False)))


def numbering_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without every seventh article, so that there are gaps."""
    return corpus.numbering_gaps(without_sevenths(table(spark, sf_dir, "articles")))


def qa_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = questions(spark, sf_dir).select("id", corpus.validation_errors().alias("e"))
    return e.filter(F.size("e") > 0).select("id", F.size("e").cast("bigint").alias("n_errors"), F.array_join("e", "; ").alias("errors"))


def qa_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.question_stats(questions(spark, sf_dir))


def gold_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cited articles that an index without every seventh article lacks."""
    return retrieval.gold_gaps(corpus.gold_units(questions(spark, sf_dir)), without_sevenths(articles(spark, sf_dir)))


def mcq_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "eval_items").filter("suite = 'mcq'").select("item_id", "subject", F.array_join(F.filter(F.split("text", "\n"), lambda x: x.rlike(r"^[A-E]\. ")), "\n").alias("choices"))
    c = corpus.choices(e)
    return e.select("item_id", "subject", F.size(c).cast("bigint").alias("n_choices"), F.element_at(c, 1).alias("first_choice"))


def random_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.random_baseline(mcq_items(spark, sf_dir)).select(r6("baseline").alias("baseline"))


def answer_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = questions(spark, sf_dir).groupBy("question_type").agg(F.count("*").alias("n"))
    return q.select("question_type", "n", r6(F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1)))).alias("share"))


def probe_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.repeated_ids(table(spark, sf_dir, "generations"), "gen_id")


def resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generations that have no signals yet."""
    return missing_from(outputs(spark, sf_dir).select("gen_id", "id", "tag"), table(spark, sf_dir, "signals"), ["id", "tag"])


# --- retrieval ---------------------------------------------------------------


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set: the test items whose id is divisible by 100."""
    return table(spark, sf_dir, "eval_items").filter("item_id % 100 = 0").select(F.col("item_id").alias("query_id"), "text")


def bm25_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.lexical_index(articles(spark, sf_dir)).terms


def lexical_run(spark: SparkSession, sf_dir: str, text: str = "text", k: int = 30) -> DataFrame:
    return retrieval.lexical_search(retrieval.lexical_index(articles(spark, sf_dir), text=text), asked(spark, sf_dir), k=k)


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_run(spark, sf_dir, k=20).select("query_id", "unit_id", r6("score").alias("score"), "rank")


def rrf_fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = retrieval.fuse([lexical_run(spark, sf_dir), lexical_run(spark, sf_dir, "title")])
    return f.filter("rank <= 30").select("query_id", "unit_id", F.round("score", 9).alias("score"), "rank")


def dynamic_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.dynamic_cut(lexical_run(spark, sf_dir)).select("query_id", "unit_id", "rank")


def context_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = retrieval.context(lexical_run(spark, sf_dir), articles(spark, sf_dir))
    return c.select("query_id", "n_units", F.length("context").cast("bigint").alias("n_chars"), F.md5("context").alias("digest"))


def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("unit_id"), F.col("embedding").alias("vector"))
    run = retrieval.dense_search(e, e.filter("unit_id % 100 = 0").withColumnRenamed("unit_id", "query_id"), k=10)
    return run.select("query_id", "unit_id", F.round("score", 5).alias("score"))


def retrieval_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dense run against the rows of the query's label."""
    e = table(spark, sf_dir, "embeddings")
    v = e.select(F.col("vec_id").alias("unit_id"), F.col("embedding").alias("vector"))
    q = e.filter("vec_id % 100 = 0")
    run = retrieval.dense_search(v, q.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), k=10)
    gold = q.select(F.col("vec_id").alias("query_id"), "label").join(e.select(F.col("vec_id").alias("unit_id"), "label"), "label").select("query_id", "unit_id")
    return retrieval.precision_recall(run, gold).select("query_id", r6("precision").alias("precision"), r6("recall").alias("recall"), r6("f_beta").alias("f_beta"))


def amendment_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document that refers to a law, as an amendment of the law's article of the document's number."""
    d = table(spark, sf_dir, "documents").filter("law_ref IS NOT NULL")
    no = (F.pmod("doc_id", F.lit(40)) + 1).cast("string")
    return d.select(F.concat(F.lit("doc-"), "doc_id").alias("source_doc"), F.lit("1").alias("source_dieu"), F.col("law_ref").alias("target_doc"), no.alias("target_dieu"), F.lit("").alias("title"), F.left("text", F.lit(10**9)).alias("text"), F.date_format("published_at", "yyyy-MM-dd").alias("effective_date"), F.concat("law_ref", F.lit("::dieu-"), no).alias("target_unit_id"))


def amend_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = amend.effective(articles(spark, sf_dir), amendment_rows(spark, sf_dir), "2031-08-01")
    return a.groupBy("unit_id").agg(F.count("*").alias("n"), F.max("effective_date").alias("last_date"), F.max(F.md5("text")).alias("digest"))


# --- statistics --------------------------------------------------------------


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, model, precision, ok and the primary prediction of each output: right unless it looks cut or repeats itself."""
    t = F.col("output")
    rows = outputs(spark, sf_dir).filter("output IS NOT NULL")
    bad = T.looks_truncated(t) | (T.max_ngram_repeat(t) >= 0.15)
    pred = F.when(T.max_ngram_repeat(t) >= 0.15, "B").when(T.looks_truncated(t), "C").when(T.diacritic_ratio(t) < 0.1, "D").otherwise("A")
    return rows.select("id", T.model_of(F.col("tag")).alias("model"), T.precision_of(F.col("tag")).alias("precision"), (~bad).alias("ok"), pred.alias("pred")).groupBy("id", "model", "precision").agg(F.max("ok").alias("ok"), F.max("pred").alias("pred"))


def judged_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = judged(spark, sf_dir)
    ref = j.filter("precision = 'bf16'").select("id", "model", F.col("ok").alias("ref"), F.col("pred").alias("ref_pred"))
    return j.filter("precision <> 'bf16'").join(ref, ["id", "model"]).select("id", "model", "precision", "ref", F.col("ok").alias("cmp"), "ref_pred", F.col("pred").alias("cmp_pred"))


def mcnemar_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = stats.mcnemar(judged_pairs(spark, sf_dir), ["model", "precision"])
    return m.select("model", "precision", "n", r6("acc_ref").alias("acc_ref"), r6("acc").alias("acc"), "flip_down", "flip_up", r6("statistic").alias("statistic"), r6("p_value").alias("p_value"), "exact")


def holm_bh(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = stats.mcnemar(judged_pairs(spark, sf_dir), ["model", "precision"]).select(F.concat_ws("@", "model", "precision").alias("label"), "p_value")
    return stats.benjamini_hochberg(stats.holm(m, "label"), "label").select("label", r6("p_holm").alias("p_holm"), "significant_holm", r6("p_bh").alias("p_bh"), "significant_bh")


def floor_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = judged(spark, sf_dir).groupBy("model", "precision").agg(F.count("*").alias("n"), F.avg(F.col("ok").cast("int")).alias("acc"))
    return stats.floor_check(g, baseline=0.7).select("model", "precision", "n", r6("acc").alias("acc"), r6("z").alias("z"), r6("p_floor").alias("p_floor"), "at_floor", "floor_note", r6("floor_accuracy").alias("floor_accuracy"))


def degradation(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = judged(spark, sf_dir).groupBy("model", "precision").agg(F.avg(F.col("ok").cast("int")).alias("value"))
    return stats.degradation(g).select("model", "precision", r6("value").alias("value"), r6("delta_abs").alias("delta_abs"), r6("delta_rel_pct").alias("delta_rel_pct"))


def flip_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.flip_rate(judged_pairs(spark, sf_dir), ["model", "precision"]).withColumn("flip_rate", r6("flip_rate"))


def flip_directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.flip_directions(judged_pairs(spark, sf_dir), ["model"]).select("model", "direction", "n", "rank")


def flip_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = judged_pairs(spark, sf_dir)
    return stats.flip_by_group(p, "model", least=30).select(F.col("model").alias("grp"), "n", "n_flip", r6("flip_rate").alias("flip_rate"))


def proxy_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = judged_pairs(spark, sf_dir).withColumn("gold", F.lit("A"))
    return stats.validate_proxy(p, ["model", "precision"]).select("model", "precision", "n", "flip_down", "flip_up", r6("harmful_share").alias("harmful_share"), r6("harmful_expected").alias("harmful_expected"), r6("p_value").alias("p_value"), "verdict")


def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.paired_bootstrap(judged_pairs(spark, sf_dir), ["model", "precision"])


def paired_significance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.paired_significance(judged(spark, sf_dir), "id").select("model", "precision", "note", "n", r6("p_value").alias("p_value"), r6("p_holm").alias("p_holm"), "ci_low", "ci_high")


def sampling_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = judged(spark, sf_dir).groupBy("model").agg(F.count("*").cast("double").alias("population"))
    return g.select("model", r6(stats.sampling_error(F.floor(F.col("population") / 3).cast("double"), F.col("population"))).alias("margin"), r6(stats.margin_of_error(F.col("population"))).alias("detectable"))


def latency_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").filter("value IS NOT NULL").select("event_type", F.round(F.col("value"), 3).alias("ttft_ms"), F.round(F.col("value") * 3 + 50, 3).alias("total_ms"), (F.pmod("event_id", F.lit(50)) + 2).alias("n_output_tokens"))
    return stats.latency_summary(e, "event_type")


def machine_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("model"), F.lit("x").alias("precision"), F.col("event_type").alias("machine"))
    return stats.mixed_machines(e)


# --- labels and samples ------------------------------------------------------


def named(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "labels").filter("labels IS NOT NULL AND tag <> 'qa'")
    return l.withColumn("annotator", F.upper(F.trim("annotator")))


def agreement_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = agreement.paired_labels(named(spark, sf_dir), F.col("annotator") == "A01", F.col("annotator") != "A01", CODES)
    a = agreement.agreement(p, ["code"]).join(agreement.prevalence(p), "code")
    return a.select("code", "n_items", r6("percent_agreement").alias("percent_agreement"), r6("ac1").alias("ac1"), r6("kappa").alias("kappa"), r6("prevalence").alias("prevalence"), agreement.interpret(F.col("ac1")).alias("interpretation"))


def agreement_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agreement.agreement_bounds(agreement.paired_labels(named(spark, sf_dir), F.col("annotator") == "A01", F.col("annotator") != "A01", CODES), ["code"])


def detector_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weak signals' flags of foreign text and repetition against the merged labels."""
    s = table(spark, sf_dir, "signals")
    flag = F.explode(F.array(F.struct(F.lit("E5").alias("code"), (F.coalesce(F.size("english_runs"), F.lit(0)) > 0).alias("flag")), F.struct(F.lit("E6").alias("code"), (F.coalesce("max_ngram_repeat", F.lit(0.0)) >= 0.15).alias("flag"))))
    machine = s.select("tag", "id", flag.alias("f")).groupBy("tag", "id", "f.code").agg(F.bool_or("f.flag").alias("flag"))
    m = agreement.merged_labels(named(spark, sf_dir), ["E5", "E6"])
    truth = m.select("tag", "id", F.inline(F.array(*[F.struct(F.lit(c).alias("code"), F.col(c).alias("label")) for c in ("E5", "E6")])))
    return agreement.calibration(truth, machine, ["tag", "id"]).select("code", "tp", "fp", "fn", r6("precision").alias("precision"), r6("recall").alias("recall"))


def error_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = agreement.merged_labels(named(spark, sf_dir), CODES)
    return agreement.error_distribution(m, CODES)


def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    flagged = flagged_outputs(spark, sf_dir)
    return detect.review_queue(flagged.filter("E2 OR E5 OR E6").withColumn("E1", F.lit(False)), ["gen_id"]).select("gen_id", "tag", "stratum")


def review_queue_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole queue: every flag and the confusion terms, with the lexicon and the citation index of the articles."""
    arts = articles(spark, sf_dir)
    return jobs.sample_queue(jobs.probe_errors(outputs(spark, sf_dir), arts, arts)).select("id", "tag", "stratum")


def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    s = sample.stratified_sample(d, "source", "doc_id", 300)
    return s.groupBy("source").agg(F.count("*").alias("n"))


def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well the documents with a law cover the sources."""
    d = table(spark, sf_dir, "documents").select("source", "law_ref")
    return sample.coverage(d.filter("law_ref IS NOT NULL"), d, "source").withColumn("share_deviation", r6("share_deviation"))


def calibration_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "source", F.coalesce(F.col("source") == "gazette", F.lit(False)).alias("legal"))
    return sample.class_mix(d, "doc_id", "legal").select("doc_id", "source")


def screening(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("output")
    rows = outputs(spark, sf_dir).filter("output IS NOT NULL")
    g = rows.groupBy("tag").agg(F.avg((~T.looks_truncated(t)).cast("int")).alias("acc"), F.avg(T.diacritic_ratio(t)).alias("d"), F.sum(F.when(F.contains(t, F.lit("�")), 1).otherwise(0)).alias("m"), F.sum(F.size(T.foreign_script_hits(t))).alias("f"))
    return g.select("tag", r6("acc").alias("acc"), r6("d").alias("diacritic"), F.col("m").cast("bigint").alias("n_broken"), detect.screening_verdict(F.col("acc"), F.col("d"), F.col("m"), F.col("f")).alias("verdict"))


QUERIES = {
    f.__name__: f
    for f in (
        text_profile, text_flags, flag_rate_by_tag, fold_vocab, tone_loss, glue_ratio_by_source, clean_pdf, clean_pasted, mojibake_counts, confusion_counts, scan_triage, question_crosscheck, chunks_basic, desegment,
        parse_articles, parse_procedures, citation_counts, citation_gate, retrieval_units, corpus_stats, corpus_verify, numbering_gaps, qa_validate, qa_stats, gold_coverage, mcq_items, random_baseline, answer_balance, probe_check, resume,
        bm25_stats, bm25_topk, rrf_fused, dynamic_cut, context_budget, dense_topk, retrieval_prf, amend_as_of,
        mcnemar_pairs, holm_bh, floor_check, degradation, flip_rates, flip_directions, flip_by_group, proxy_validation, bootstrap_ci, paired_significance, sampling_error, latency_summary, machine_consistency,
        agreement_pairs, agreement_bounds, detector_calibration, error_distribution, review_queue, review_queue_full, stratified_sample, coverage, calibration_mix, screening,
    )
}

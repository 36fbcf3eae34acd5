"""Queries that show the sources and sinks, the composite jobs and the remaining operators; ``more_oracle`` has their SQL.

What is read from files is written from a test table first, into a folder that
all executors share, and read back.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumiscript.functions import segment
from lumiscript.functions import text as T
from lumiscript.operators import agreement, amend, citations, corpus, detect, parse, retrieval, sample, stats
from lumiscript.plans import jobs
from lumiscript.queries import CODES, amendment_rows, articles, asked, judged, judged_pairs, lexical_run, named, outputs, questions, r6, table
from lumiscript.sources import files


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for ``name`` where all executors read and write."""
    path = f"{files.shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    fs, p = files.file_system(spark, path)
    fs.deleteOnExit(p)  # when the session's JVM ends
    return path


# --- sources and sinks -------------------------------------------------------


def jsonl_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "articles")
    files.write_jsonl(articles(spark, sf_dir), path)
    size = lambda c: F.coalesce(F.greatest(F.size(c), F.lit(0)), F.lit(0)).cast("bigint")
    return files.read_articles(spark, path).select("unit_id", "doc_id", "dieu", "title", F.md5("text").alias("digest"), size("khoan").alias("n_clauses"), size("bienbao").alias("n_signs"))


def jsonl_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "questions")
    files.write_jsonl(questions(spark, sf_dir), path)
    return files.read_questions(spark, path).select("id", "question", "difficulty", "resolved", F.get("citations.doc", F.lit(0)).alias("first_doc"))


def mcq_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The multiple-choice items with their question, choices and an answer that goes round the forms it may have."""
    lines = F.split("text", "\n")
    forms = F.array(*[F.lit(x) for x in ("A", "b", "C", "2", "-1", "", "D")])
    rows = table(spark, sf_dir, "eval_items").filter("suite = 'mcq'").select(F.concat(F.lit("mcq-"), "item_id").alias("id"), "subject", F.filter(lines, lambda x: x.rlike("^[A-E]\\. ")).alias("choices"), F.array_join(F.filter(lines, lambda x: ~x.rlike("^[A-E]\\. ")), "\n").alias("question"), F.get(forms, F.pmod("item_id", F.lit(7)).cast("int")).alias("answer"))
    return rows


def jsonl_mcq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Choices written as a list and as columns come back as the same choices."""
    rows, path = mcq_parts(spark, sf_dir), scratch(spark, "mcq")
    files.write_jsonl(rows.filter("answer = 'A'"), f"{path}/list")
    files.write_jsonl(rows.filter("answer <> 'A'").select("id", "question", "subject", "answer", *[F.get("choices", F.lit(i)).alias(c) for i, c in enumerate(corpus.LETTERS)]), f"{path}/columns")
    back = files.read_mcq(spark, [f"{path}/list", f"{path}/columns"])
    c = corpus.choices(back)
    return back.select("id", corpus.subject_of(back).alias("subject"), F.size(c).cast("bigint").alias("n_choices"), F.element_at(c, 1).alias("first_choice"), corpus.answer_index(back).cast("bigint").alias("answer"), F.md5(corpus.item_prompt(back)).alias("prompt"))


def mcq_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The subject from the id where no column has it."""
    rows = mcq_parts(spark, sf_dir).select("id", "answer")
    return rows.groupBy(corpus.subject_of(rows).alias("subject")).agg(F.count("*").alias("n"))


def mcq_answerable(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mcq_parts(spark, sf_dir).select(F.col("subject").alias("split"), F.col("answer").alias("gold"))
    return corpus.answerable(rows)


def whole_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The procedures of each document written as one file, read as one text, joined with a table of settings."""
    path = scratch(spark, "texts")
    p = table(spark, sf_dir, "procedures").drop("collected_at").dropDuplicates(["unit_id"]).filter("text IS NOT NULL")
    own = p.select(F.replace("doc_id", F.lit("/"), F.lit("_")).alias("name"), F.replace("text", F.lit("\n"), F.lit(" ")).alias("value"))
    files.write_named(own, path, "name", ".txt")
    settings = p.select(F.concat(F.replace("doc_id", F.lit("/"), F.lit("_")), F.lit(".txt")).alias("file"), F.lit("procedure").alias("kind")).distinct()
    back = files.read_texts(spark, f"{path}/*.txt", settings)
    return back.select("file", "kind", F.length("text").cast("bigint").alias("n_chars"))


def yaml_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    import tempfile

    with tempfile.NamedTemporaryFile("w", suffix=".yaml", encoding="utf-8") as f:  # configuration is read by the driver
        f.write("sources:\n  - {file: a.txt, doc_id: Luật 1, pages: 3}\n  - {file: b.txt, doc_id: Luật 2, tags: [x, y]}\n")
        f.flush()
        return files.read_yaml_rows(spark, f.name, "sources")


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outputs(spark, sf_dir).groupBy("tag").agg(F.count("*").alias("n"), F.max("gen_id").alias("last"))


def result_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result file for each tag, one of them broken, found again by its place in the tree."""
    base = scratch(spark, "results")
    body = F.concat(F.lit('{"results": {"probe": {"n,none": '), "n", F.lit(', "last,none": '), "last", F.lit(', "alias": "p"}}, "config": {}}'))
    files.write_named(tags(spark, sf_dir).select(F.concat("tag", F.lit("/deep/results_1")).alias("name"), body.alias("value")), base, "name", ".json")
    files.write_text(spark, f"{base}/broken@x/results_2.json", "{not json")
    return files.read_results(spark, base).select("model_tag", "task", "metric", "value")


def sample_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items of each tag in each form that they may have, and a second file that isn't read."""
    base = scratch(spark, "samples")
    ok = F.when(T.looks_truncated(F.coalesce("output", F.lit(""))), "0.0").otherwise("1.0")
    item = F.concat(F.lit('{"doc_id": '), "gen_id")
    k = F.pmod("gen_id", F.lit(4))
    line = F.when(k == 0, F.concat(item, F.lit(', "acc": '), ok, F.lit("}"))).when(k == 1, F.concat(item, F.lit(', "exact_match": '), ok, F.lit("}"))).when(k == 2, F.concat(item, F.lit("}"))).otherwise(F.concat(item, F.lit(', "filtered_resps": ["A"]}')))
    rows = outputs(spark, sf_dir)
    files.write_named(rows.select(F.concat("tag", F.lit("/samples_a")).alias("name"), line.alias("value")), base, "name", ".jsonl")
    files.write_named(tags(spark, sf_dir).select(F.concat("tag", F.lit("/samples_b")).alias("name"), F.lit('{"doc_id": 1, "acc": 1.0}\nbroken').alias("value")), base, "name", ".jsonl")
    return files.read_samples(spark, base)


def hardware_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The machine of each tag as its file says; no file that is broken names one."""
    base = scratch(spark, "hardware")
    body = F.when(F.length("tag") % 3 == 0, F.lit("{broken")).when(F.length("tag") % 3 == 1, F.lit('{"host": "h1", "runner": "r", "gpu": "g1", "sm": "89"}')).otherwise(F.lit('{"host": "h2", "gpu": ""}'))
    files.write_named(tags(spark, sf_dir).select(F.concat("tag", F.lit("/hardware")).alias("name"), body.alias("value")), base, "name", ".json")
    return files.read_hardware(spark, base).select("model_tag", files.machine_key().alias("machine"))


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two appends to a log."""
    path = scratch(spark, "log")
    for stage in ("first", "second"):
        files.append_log(tags(spark, sf_dir).select(F.lit(stage).alias("stage"), "tag", "n"), path)
    return spark.read.schema("stage string, tag string, n bigint, logged_at timestamp").json(path).filter("logged_at IS NOT NULL").groupBy("stage").agg(F.count("*").alias("n_rows"), F.sum("n").alias("n"))


PRECISIONS = ["bf16", "w8a8", "w4a16", "q3"]


def json_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "report") + "/report.json"
    files.write_report(tags(spark, sf_dir).select("tag", "n"), path)
    return spark.read.schema("tag string, n bigint").option("multiLine", "true").json(path)


def markdown_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distribution of errors by model and precision as the lines of a Markdown table."""
    lines = files.markdown(jobs.error_distribution(named(spark, sf_dir), PRECISIONS)).split("\n")
    return spark.createDataFrame(list(enumerate(lines)), "no bigint, line string")


def stored_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search in an index that was written down, as any search at scale does."""
    path = scratch(spark, "index")
    files.write_index(retrieval.lexical_index(articles(spark, sf_dir)), path)
    run = retrieval.lexical_search(files.read_index(spark, path), asked(spark, sf_dir), k=20)
    return run.select("query_id", "unit_id", r6("score").alias("score"), "rank")


def label_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of labels but the one that is the output."""
    path = scratch(spark, "labels")
    rows = table(spark, sf_dir, "labels").filter("labels IS NOT NULL").select(F.concat(F.lit("labels_"), F.length("id") % 2, F.lit("_"), F.length("tag") % 2).alias("name"), F.to_json(F.struct("id", "tag", "annotator")).alias("value"))
    files.write_named(rows, path, "name", ".jsonl")
    back = files.read_matching(spark, f"{path}/labels_*.jsonl", "id string, tag string, annotator string", without="labels_0_0.jsonl")
    return back.groupBy("file").agg(F.count("*").alias("n"), F.countDistinct("tag").alias("n_tags"))


# --- text --------------------------------------------------------------------


def demojibake_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outputs whose broken encoding can be undone: those broken here, and those that came so."""
    t = F.col("output")
    broken = F.decode(F.encode(F.left(t, F.lit(10**9)), "UTF-8"), "ISO-8859-1")
    rows = outputs(spark, sf_dir).filter("output IS NOT NULL").select("gen_id", F.when(F.pmod("gen_id", F.lit(2)) == 0, broken).otherwise(t).alias("t"))
    return rows.select("gen_id", F.md5(T.demojibake(F.col("t"))).alias("digest")).filter("digest IS NOT NULL")


def secret_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return questions(spark, sf_dir).select("id", T.mask(F.coalesce("notes", "id")).alias("masked"))


def syllable_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The syllables of the articles with a list of the caller's."""
    known = segment.syllables(articles(spark, sf_dir), seed=["Nghiêng", "đường"])
    return spark.createDataFrame([(s, len(s)) for s in sorted(known)], "syllable string, n_chars bigint")


def article_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units of clauses counted by their article."""
    u = parse.retrieval_units(articles(spark, sf_dir), 600)
    return u.groupBy(T.article_of(F.col("unit_id")).alias("article")).agg(F.count("*").alias("n"))


def corpus_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole articles and procedures in one table of units."""
    p = table(spark, sf_dir, "procedures").drop("collected_at").dropDuplicates(["unit_id"])
    whole = parse.retrieval_units(articles(spark, sf_dir), whole_only=True).unionByName(parse.procedure_units(p))
    return whole.select("unit_id", F.md5("text").alias("digest"))


def choice_of_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of two extractions of each article, one glued, that with fewer glued words and the longest."""
    a = articles(spark, sf_dir).select(F.col("unit_id").alias("file"), "text", F.regexp_replace("text", r"(\p{L}) (?=\p{L})", "$1").alias("glued")).filter("text <> glued")
    both = a.select("file", "text", F.lit("a").alias("engine")).unionByName(a.select("file", F.col("glued").alias("text"), F.lit("b").alias("engine")))
    least = corpus.best_extraction(both).select("file", F.col("engine").alias("least_glued"))
    longest = corpus.best_extraction(both, by="length").select("file", F.col("engine").alias("longest"))
    return least.join(longest, "file").groupBy("least_glued", "longest").agg(F.count("*").alias("n"))


# --- parsing -----------------------------------------------------------------


def parsed_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles and texts of the articles in the documents."""
    a = parse.parse_articles(table(spark, sf_dir, "documents"))
    return a.select("doc_id", F.col("ord").cast("bigint").alias("ord"), "dieu", "title", F.md5("text").alias("digest"), F.get("khoan.khoan", F.lit(0)).alias("first_clause"))


def parsed_procedures(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "procedures").select(F.col("unit_id").alias("doc_id"), "text").distinct()
    return parse.parse_procedures(p).select(F.col("doc_id").alias("unit_id"), "ma", "ten", F.md5("text").alias("digest"))


def amending_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with articles, whose titles are made to amend one article by name or those of their body."""
    title = F.when(F.pmod("doc_id", F.lit(2)) == 0, "Điều $1. Sửa đổi khoản 2, điểm a khoản 11 và khoản 3 Điều $1 về hồ sơ").otherwise("Điều $1. Bổ sung một số điều")
    d = table(spark, sf_dir, "documents").filter("law_ref IS NOT NULL AND text IS NOT NULL")
    return d.select(F.concat(F.lit("doc-"), "doc_id").alias("source_doc"), F.col("law_ref").alias("target_doc"), F.date_format("published_at", "yyyy-MM-dd").alias("effective_date"), F.regexp_replace("text", F.lit(r"(?m)^Điều (\d+)\.$"), title).alias("text"))


def parsed_amendments(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, _ = jobs.build_amendments(amending_documents(spark, sf_dir))
    return a.select("source_doc", "source_dieu", "target_dieu", "target_unit_id", "title", F.length("text").cast("bigint").alias("n_chars"), F.array_join("khoan", ",").alias("khoan"), F.array_join("diem", ",").alias("diem"))


def amendment_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, s = jobs.build_amendments(amending_documents(spark, sf_dir))
    return s


def amended_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return amend.affected_units(amendment_rows(spark, sf_dir))


def corpus_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles of the documents and the procedures in one table, counted by kind."""
    p = table(spark, sf_dir, "procedures").select(F.col("unit_id").alias("doc_id"), "text").distinct()
    c = jobs.build_corpus(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text"), p)
    return c.groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_docs"))


def corpus_expected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The check of a corpus against the numbers of articles that it should have."""
    a = articles(spark, sf_dir)
    expected = a.groupBy("doc_id").agg((F.countDistinct("dieu") + F.length("doc_id") % 2).alias("n_expected"))
    return jobs.verify_corpus(a, expected).select("doc_id", "n_articles", "n_expected", "ok")


# --- detection and review ----------------------------------------------------


def probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    arts = articles(spark, sf_dir)
    return jobs.probe_errors(outputs(spark, sf_dir), arts, arts)


def probe_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All flags of each output, with lexicon, citation index and the drop against the reference precision."""
    f = probe(spark, sf_dir)
    return f.select("id", "tag", F.size("tone_loss_tokens").cast("bigint").alias("n_tone"), "n_citations", F.size("unknown_citations").cast("bigint").alias("n_unknown"), r6("ref_ratio").alias("ref_ratio"), *CODES)


def probe_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.flag_rates(probe(spark, sf_dir), "tag").select("tag", "n", *[F.col(c).alias(f"pct_{c.lower()}") for c in CODES])


def machine_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every flag of the machine against the merged labels."""
    f = probe(spark, sf_dir)
    machine = f.select("tag", "id", F.inline(F.array(*[F.struct(F.lit(c).alias("code"), F.col(c).alias("flag")) for c in CODES])))
    m = agreement.merged_labels(named(spark, sf_dir), CODES)
    truth = m.select("tag", "id", F.inline(F.array(*[F.struct(F.lit(c).alias("code"), F.col(c).alias("label")) for c in CODES])))
    return agreement.calibration(truth, machine, ["tag", "id"]).select("code", "tp", "fp", "fn", r6("precision").alias("precision"), r6("recall").alias("recall"))


# --- retrieval ---------------------------------------------------------------


def hybrid_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pools of two retrievers, fused and cut on the fused scores."""
    index = retrieval.lexical_index(articles(spark, sf_dir))
    second = lexical_run(spark, sf_dir, "title")
    run = retrieval.retrieve(index, asked(spark, sf_dir), second)
    return run.select("query_id", "unit_id", F.round("score", 9).alias("score"), "rank")


def letter_vector(t):
    """A user's vectors: counts of six letters."""
    return F.array(*[F.length(t) - F.length(F.replace(t, F.lit(c), F.lit(""))) for c in "nhtgci"]).cast("array<double>")


def encoded_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense search with vectors by a function of the user's."""
    units = retrieval.encoded(articles(spark, sf_dir).filter("text IS NOT NULL"), letter_vector)
    asks = retrieval.encoded(asked(spark, sf_dir), letter_vector)
    return retrieval.dense_search(units, asks, k=10).select("query_id", "unit_id", F.round("score", 5).alias("score"))


def question_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean scores of each variant over the stated set of questions, those whose number is divisible by 100, with the units that they cite."""
    arts = articles(spark, sf_dir)
    index = retrieval.lexical_index(arts)
    scores, _ = jobs.evaluate_retrieval(index, arts, questions(spark, sf_dir).filter("question IS NOT NULL AND size(citations) > 0 AND try_cast(regexp_extract(id, '([0-9]+)$', 1) AS bigint) % 100 = 0"))
    return scores.select("variant", "n_queries", *[F.round(c, 4).alias(c) for c in ("precision", "recall", "f_beta", "mean_k")])


def amended_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The context of each query with the amendments in force on a day."""
    c = amend.augmented_context(lexical_run(spark, sf_dir), articles(spark, sf_dir), amendment_rows(spark, sf_dir), "2031-03-01", 60_000)
    return c.select("query_id", "n_units", F.md5("context").alias("digest"))


def context_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queries whose context changed between two days."""
    a = articles(spark, sf_dir).select("unit_id", "text")
    return jobs.context_change(lexical_run(spark, sf_dir, k=10), a, amendment_rows(spark, sf_dir), "2031-02-01", "2031-09-01")


def assistant_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions answered by a function of the user's and let through only with citations that exist."""
    arts = articles(spark, sf_dir)
    generate = lambda prompt: F.concat(F.lit("Theo Điều "), F.regexp_extract(prompt, r"(\d+)", 1), F.lit(" thì làm như sau."))
    out = jobs.answer_questions(asked(spark, sf_dir), arts, retrieval.lexical_index(arts), generate, citations.citation_index(arts))
    return out.select("query_id", "answer", "blocked", "reason")


# --- statistics --------------------------------------------------------------


def evaluation_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scores of each precision against the reference, with their floors, from rows as result files give them."""
    j = judged(spark, sf_dir)
    rows = j.groupBy(F.concat_ws("@", "model", "precision").alias("model_tag")).agg(F.avg(F.col("ok").cast("int")).alias("value")).select("model_tag", F.lit("acc,none").alias("metric"), "value", F.lit("p").alias("path"))
    scores, _ = jobs.evaluation_table(rows, j.select(F.concat_ws("@", "model", "precision").alias("model_tag"), F.col("id").alias("item"), "ok"), baseline=0.7, n=400)
    return scores.select("model", "precision", r6("value").alias("value"), r6("delta_abs").alias("delta_abs"), r6("z").alias("z"), r6("p_floor").alias("p_floor"), "at_floor")


def matched_judgements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sides that have to have the same items: each output against itself as the reference's."""
    j = judged(spark, sf_dir).filter("precision = 'bf16'")
    pairs = stats.matched_pairs(j.select("id", "model", F.col("ok").alias("ref")), j.select("id", "model", F.col("ok").alias("cmp")), ["id", "model"])
    return pairs.groupBy("model").agg(F.count("*").alias("n"), F.count_if(F.col("ref") == F.col("cmp")).alias("n_same"))


def agreement_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement by code with bounds, prevalence and its reading."""
    t, _ = jobs.agreement_report(named(spark, sf_dir), F.col("annotator") == "A01", F.col("annotator") != "A01", CODES, times=500)
    return t.select("code", "n_items", r6("ac1").alias("ac1"), (F.col("ac1_low") <= F.col("ac1")).alias("low_ok"), (F.col("ac1_high") >= F.col("ac1")).alias("high_ok"), "interpretation")


def flip_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of change with bounds that hold them."""
    b = stats.flip_bootstrap(judged_pairs(spark, sf_dir), ["model", "precision"], times=500)
    return b.select("model", "precision", "n", r6("flip_rate").alias("flip_rate"), ((F.col("ci_low") <= F.col("flip_rate")) & (F.col("flip_rate") <= F.col("ci_high"))).alias("inside"))


def own_statistic_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds of a statistic of the user's: the ratio of changes for the worse."""
    down, up = F.col("ref") & ~F.col("cmp"), ~F.col("ref") & F.col("cmp")
    b = stats.cell_bootstrap(judged_pairs(spark, sf_dir), ["model"], {"down": down, "up": up, "same": ~down & ~up}, lambda x: x[:, 0] / (x[:, 0] + x[:, 1] + 1e-9), times=500)
    return b.select("model", (F.col("ci_low") <= F.col("ci_high")).alias("ordered"), F.col("ci_low").between(0, 1).alias("low_ok"), F.col("ci_high").between(0, 1).alias("high_ok"))


def mix_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce("source", F.lit("none")).alias("source"), F.coalesce(F.col("source") == "gazette", F.lit(False)).alias("legal"))
    s = sample.mix_stats(sample.class_mix(d, "doc_id", "legal"), "text", "source")
    return s.select("source", "n", F.col("chars_median").cast("bigint").alias("chars_median"), F.col("chars_max").cast("bigint").alias("chars_max"), "diacritic_ratio_mean")


def calibration_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The calibration set of texts that aren't glued."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return jobs.calibration_set(d, F.coalesce(F.col("source") == "gazette", F.lit(False))).select("doc_id", "chunk", F.length("text").cast("bigint").alias("n_chars"), "is_legal")


def sample_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How a stratified sample covers the sources: its quotas and shares."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    _, c = jobs.sampling_report(d, "source", "doc_id", 300)
    return c.select("stratum", "n_population", "n_sample", r6("share_deviation").alias("share_deviation"))


MORE = {
    f.__name__: f
    for f in (
        jsonl_articles, jsonl_questions, jsonl_mcq, mcq_subjects, mcq_answerable, whole_texts, yaml_settings, result_tree, sample_files, hardware_files, run_log, json_report, markdown_report, stored_index, label_files,
        demojibake_text, secret_masks, syllable_vocabulary, article_units, corpus_units, choice_of_extraction, parsed_articles, parsed_procedures, parsed_amendments, amendment_summary, amended_units, corpus_build, corpus_expected,
        probe_flags, probe_rates, machine_calibration, hybrid_retrieval, encoded_search, question_retrieval, amended_context, context_change, assistant_answers,
        evaluation_scores, matched_judgements, agreement_table, flip_bounds, own_statistic_bounds, mix_summary, calibration_chunks, sample_coverage,
    )
}

"""The composite jobs: each is one lazy plan over the operators; sinks are the caller's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumiscript.functions.text import chunks, glue_ratio, model_of, precision_of
from lumiscript.operators import agreement, amend, citations, corpus, detect, parse, retrieval, sample, stats


def build_corpus(laws: DataFrame, procedures: DataFrame | None = None) -> DataFrame:
    """Articles and procedures of raw texts (doc_id, text) in one table, with their kind."""
    a = parse.parse_articles(laws).drop("ord").withColumn("kind", F.lit("article"))
    if procedures is None:
        return a
    p = parse.parse_procedures(procedures)
    kinds = {f.name: f.dataType for f in a.schema.fields}
    return a.unionByName(p.select("unit_id", "doc_id", F.col("ma").alias("dieu"), F.col("ten").alias("title"), "text", F.array().cast(kinds["khoan"]).alias("khoan"), F.array().cast(kinds["bienbao"]).alias("bienbao"), F.lit("procedure").alias("kind")))


def build_amendments(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    a = parse.parse_amendments(texts)
    return a, amend.amendment_stats(a)


def verify_corpus(articles: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    out = corpus.corpus_check(articles)
    return out if expected is None else out.join(corpus.expected_counts(articles, expected).select("doc_id", "n_expected", "ok"), "doc_id", "left")


def build_index(articles: DataFrame, max_chars: int = 6000, whole_only: bool = False) -> tuple[DataFrame, retrieval.LexicalIndex]:
    units = parse.retrieval_units(articles, max_chars, whole_only)
    return units, retrieval.lexical_index(units)


VARIANTS = {"dynamic": (1, 10, 0.55), "top5": (5, 5, 0.0), "top10": (10, 10, 0.0)}


def evaluate_retrieval(index: retrieval.LexicalIndex, units: DataFrame, items: DataFrame, by_article: bool = True) -> tuple[DataFrame, DataFrame]:
    """(mean scores by variant, gold units that the index lacks)."""
    gold = corpus.gold_units(items)
    run = retrieval.lexical_search(index, items, "id", "question", 30)
    if by_article:
        run = run.withColumn("unit_id", parse.to_articles(F.col("unit_id")))
        units = units.withColumn("unit_id", parse.to_articles(F.col("unit_id")))
    return retrieval.evaluate_variants(run, gold, VARIANTS), retrieval.gold_gaps(gold, units)


def probe_errors(generations: DataFrame, clean: DataFrame | None = None, articles: DataFrame | None = None, per_model: bool = True) -> DataFrame:
    """id, tag, signals and flags of each output; E2 is relative to the same prompt's reference precision."""
    lex = detect.lexicon(clean) if clean is not None else None
    index = citations.citation_index(articles) if articles is not None else None
    sig = detect.signals(generations, ["id", "tag"], "output", "finish_reason", lex, index).withColumn("model", model_of(F.col("tag")))
    ref = detect.reference_ratios(sig, per_model=per_model)
    return detect.with_flags(sig.join(ref, ["id", "model"] if per_model else ["id"], "left"), reference_ratio="ref_ratio")


def sample_queue(flagged: DataFrame, k: int = 8, most: int = 250, seed: int = sample.SEED) -> DataFrame:
    return detect.review_queue(flagged, ["id", "tag"], k=k, most=most, seed=seed)


def agreement_report(labels: DataFrame, first: Column, second: Column, codes: list[str] = list(detect.CODES), machine: DataFrame | None = None, times: int = 2000) -> tuple[DataFrame, DataFrame | None]:
    """(agreement by code with bounds and prevalence, calibration of the machine's flags)."""
    pairs = agreement.paired_labels(labels, first, second, codes)
    table = agreement.agreement(pairs, ["code"]).join(agreement.agreement_bounds(pairs, ["code"], times=times), "code").join(agreement.prevalence(pairs), "code").withColumn("interpretation", agreement.interpret(F.col("ac1")))
    truth = pairs.select("tag", "id", "code", (F.col("a") | F.col("b")).alias("label"))
    return table, None if machine is None else agreement.calibration(truth, machine, ["tag", "id"])


def error_distribution(labels: DataFrame, order: list[str], codes: list[str] = list(detect.CODES)) -> DataFrame:
    return agreement.ordered_tags(agreement.error_distribution(agreement.merged_labels(labels, codes), codes), order)


def evaluation_table(results: DataFrame, samples: DataFrame, metric: str = "acc,none", baseline: float = 0.2532, n: int = 1047) -> tuple[DataFrame, DataFrame]:
    """(degradation with floors, paired tests with corrections) from result files and item files."""
    split = lambda d: d.withColumn("model", model_of(F.col("model_tag"))).withColumn("precision", precision_of(F.col("model_tag")))
    last = split(results.filter(F.col("metric") == metric)).groupBy("model", "precision").agg(F.max_by("value", "path").alias("value"))
    degraded = stats.degradation(last).withColumn("n", F.lit(n))
    return stats.floor_check(degraded, "value", "n", baseline), stats.paired_significance(split(samples), "item")


def sampling_report(population: DataFrame, stratum: str, key: str, target: int = 2000, least: int = 5, seed: int = sample.SEED) -> tuple[DataFrame, DataFrame]:
    drawn = sample.stratified_sample(population, stratum, key, target, least, seed)
    return drawn, sample.coverage(drawn, population, stratum)


def verify_sources(items: DataFrame, source: str = "source", question: str = "question", answer: str = "answer") -> DataFrame:
    return corpus.hash_crosscheck(items, source, question, answer)


def calibration_set(texts: DataFrame, is_legal: Column, n: int = 256, share: float = 0.7, glued: float = 0.25, seed: int = sample.SEED) -> DataFrame:
    """Chunks of the texts that aren't glued, in the mix of legal and general ones."""
    rows = texts.filter(glue_ratio(F.col("text")) < glued).select("doc_id", is_legal.alias("is_legal"), F.posexplode(chunks(F.col("text"))).alias("chunk", "text"))
    rows = rows.withColumn("key", F.concat_ws("#", "doc_id", "chunk"))
    return sample.class_mix(rows, "key", "is_legal", n, share, seed)


def answer_questions(questions: DataFrame, units: DataFrame, index: retrieval.LexicalIndex, generate, known: DataFrame, amendments: DataFrame | None = None, as_of: str | None = None, budget: int = 6000) -> DataFrame:
    """query_id, context, answer, ok, unknown, blocked, reason: retrieve, build the context, generate by a user's vectorised function of a prompt column, and gate.

    With ``amendments`` the context has those in force at ``as_of``.
    """
    run = retrieval.retrieve(index, questions)
    ctx = retrieval.context(run, units, budget) if amendments is None else amend.augmented_context(run, units, amendments, as_of, budget)
    rows = questions.select("query_id", F.col("text").alias("question")).join(ctx, "query_id", "left")
    prompt = F.concat(F.lit("NGỮ CẢNH:\n"), F.coalesce("context", F.lit("")), F.lit("\n\nCÂU HỎI: "), "question")
    rows = rows.withColumn("answer", F.when(F.col("context").isNotNull(), generate(prompt)))
    verdict = citations.gate(rows.filter("answer IS NOT NULL"), known, ["query_id"], "answer")
    out = rows.join(verdict, "query_id", "left")
    reason = F.when(F.col("context").isNull(), "nothing found").when(F.col("unknown") > 0, "citations that don't exist").when(~F.col("ok"), "no citation")
    return out.withColumn("reason", reason).withColumn("blocked", reason.isNotNull())


def context_change(run: DataFrame, units: DataFrame, amendments: DataFrame, before: str, after: str) -> DataFrame:
    """query_id of the questions whose context differs between two dates."""
    a = amend.augmented_context(run, units, amendments, before).select("query_id", F.col("context").alias("a"))
    b = amend.augmented_context(run, units, amendments, after).select("query_id", F.col("context").alias("b"))
    return a.join(b, "query_id", "full").filter(~F.col("a").eqNullSafe(F.col("b"))).select("query_id")

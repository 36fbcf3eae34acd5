"""Statistics and checks of a corpus, of question sets and of multiple-choice items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumiscript.functions.text import is_syllable, let, question_hash, strip, words

QUESTION_TYPES = ("muc_phat", "thu_tuc", "y_nghia_bien_bao", "dieu_kien")
DIFFICULTIES = ("single_hop", "multi_hop")
SOURCES = ("real_forum", "synthesized")
LETTERS = ("A", "B", "C", "D", "E")


def corpus_stats(articles: DataFrame, by: list[str] | None = None) -> DataFrame:
    size = lambda c: F.sum(F.greatest(F.size(c), F.lit(0))).cast("bigint")
    points = F.aggregate(F.transform("khoan", lambda k: F.greatest(F.size(k["diem"]), F.lit(0))), F.lit(0), lambda a, b: a + b)
    main = articles.groupBy(*(by or [])).agg(F.countDistinct("doc_id").alias("n_docs"), F.count("*").alias("n_articles"), size("khoan").alias("n_clauses"), F.coalesce(F.sum(points), F.lit(0)).cast("bigint").alias("n_points"), F.round(F.avg(F.length("text")), 1).alias("mean_chars"))
    signs = articles.select(*(by or []), F.explode_outer("bienbao").alias("b")).groupBy(*(by or [])).agg(F.countDistinct("b").alias("n_signs"))
    return main.join(signs, by) if by else main.crossJoin(F.broadcast(signs))


def corpus_check(articles: DataFrame, thin: int = 80) -> DataFrame:
    """By document: articles, repeated numbers, thin articles, gaps in the numbering, glued words, mean length.

    Numbers are kept as a set of each document, so a document's row stays as
    small as its numbering, however often its articles were delivered.
    """
    length = F.coalesce(F.length("text"), F.lit(0))
    sizes = let(words(F.coalesce("text", F.lit(""))), lambda w: F.struct(F.size(w).cast("bigint").alias("w"), F.size(F.filter(w, lambda x: ~is_syllable(x))).cast("bigint").alias("odd")))
    rows = articles.select("doc_id", "dieu", "text", sizes.alias("_s")).select("doc_id", "dieu", "text", F.col("_s.w").alias("_w"), F.col("_s.odd").alias("_odd"))
    per = rows.groupBy("doc_id", "dieu").agg(F.count("*").alias("n"), F.count_if(length < thin).alias("thin"), F.sum(length).alias("chars"), F.sum("_w").alias("words"), F.sum("_odd").alias("odd"))
    number = F.coalesce(F.try_to_number(F.nullif(F.regexp_extract("dieu", r"^(\d{1,6})", 1), F.lit("")), F.lit("999999")).cast("int"), F.lit(0))
    g = per.groupBy("doc_id").agg(F.sum("n").alias("n_articles"), F.count_if(F.col("n") > 1).alias("n_dups"), F.sum("thin").alias("n_thin"), F.min(number).alias("low"), F.max(number).alias("high"), F.countDistinct(number).alias("n_numbers"), F.round(F.sum("chars") / F.sum("n"), 1).alias("avg_chars"), F.round(F.coalesce(F.try_divide(F.sum("odd").cast("double"), F.sum("words")), F.lit(0.0)), 3).alias("glue_ratio"))
    return g.withColumn("n_gaps", (F.col("high") - F.col("low") + 1 - F.col("n_numbers")).cast("bigint")).drop("n_numbers")


def numbering_gaps(articles: DataFrame, most: int = 20) -> DataFrame:
    """doc_id, gap: the first ``most`` missing numbers of each document, by neighbours rather than by ranges."""
    n = F.try_to_number(F.nullif(F.regexp_extract("dieu", r"^(\d{1,6})", 1), F.lit("")), F.lit("999999")).cast("int")
    rows = articles.select("doc_id", n.alias("n")).filter("n IS NOT NULL").distinct()
    prev = F.lag("n").over(Window.partitionBy("doc_id").orderBy("n"))
    gaps = rows.withColumn("p", prev).filter(F.col("n") > F.col("p") + 1).select("doc_id", F.explode(F.sequence(F.col("p") + 1, F.least(F.col("n") - 1, F.col("p") + most))).alias("gap"))
    w = Window.partitionBy("doc_id").orderBy("gap")
    return gaps.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= most).drop("rn")


def expected_counts(articles: DataFrame, expected: DataFrame) -> DataFrame:
    """doc_id, n_expected, n_found, ok for a table (doc_id, n_expected)."""
    found = articles.groupBy("doc_id").agg(F.countDistinct("dieu").alias("n_found"))
    return expected.join(found, "doc_id", "left").withColumn("n_found", F.coalesce("n_found", F.lit(0))).withColumn("ok", F.col("n_found") == F.col("n_expected"))


def blank(c: Column) -> Column:
    return F.coalesce(strip(c), F.lit("")) == ""


def validation_errors() -> Column:
    """The errors of a question item, in order; empty for a valid one."""
    cites = F.coalesce(F.col("citations"), F.array().cast("array<struct<doc:string,dieu:string,khoan:string,diem:string>>"))
    outside = lambda c, allowed: ~F.coalesce(F.col(c).isin(*allowed), F.lit(False))
    checks = [F.when(blank(F.col(c)), f"missing {c}") for c in ("id", "question", "answer_reference")]
    checks += [F.when(outside(c, v), f"bad {c}") for c, v in (("question_type", QUESTION_TYPES), ("difficulty", DIFFICULTIES), ("source_of_question", SOURCES))]
    checks.append(F.when(F.size(cites) == 0, "no citation"))
    each = F.flatten(F.transform(cites, lambda c, i: F.array(F.when(blank(c["doc"]), F.concat(F.lit("citations["), i.cast("string"), F.lit("] without doc"))), F.when(blank(c["dieu"]), F.concat(F.lit("citations["), i.cast("string"), F.lit("] without dieu"))))))
    tail = [F.when((F.col("difficulty") == "multi_hop") & (F.size(cites) < 2), "multi_hop with one citation"), F.when((F.coalesce("question", F.lit("")) != "") & ~F.coalesce(F.regexp_replace("question", r"(?U)\s+$", "").endswith("?"), F.lit(False)), "no question mark")]
    return F.array_compact(F.concat(F.array(*checks), each, F.array(*tail)))


def question_stats(items: DataFrame) -> DataFrame:
    """dimension, value, n: the counts by type, difficulty and source in one pass over the items."""
    dims = ["question_type", "difficulty", "source_of_question"]
    rows = items.select(F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.coalesce(F.col(d), F.lit("null")).alias("value")) for d in dims])).alias("d"), F.coalesce(F.size("citations"), F.lit(0)).alias("c"), F.coalesce("resolved", F.lit(False)).alias("r"))
    return rows.groupBy("d.dimension", "d.value").agg(F.count("*").alias("n"), F.round(F.avg(F.greatest("c", F.lit(0)).cast("double")), 4).alias("mean_citations"), F.round(100 * F.avg(F.col("r").cast("double")), 4).alias("pct_resolved"))


def gold_units(items: DataFrame) -> DataFrame:
    """query_id, unit_id of the articles that an item cites."""
    return items.select(F.col("id").alias("query_id"), F.explode("citations").alias("c")).select("query_id", F.concat("c.doc", F.lit("::dieu-"), "c.dieu").alias("unit_id")).distinct()


def repeated_ids(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")


def hash_crosscheck(items: DataFrame, source: str, question: str, answer: str) -> DataFrame:
    """a, b, n_common, n_agree, rate, verdict over every two sources; the last answer by order of text stands within a source."""
    key = items.select(F.col(source).alias("s"), question_hash(F.col(question)).alias("k"), F.col(answer).alias("v")).filter("s IS NOT NULL AND k IS NOT NULL AND v IS NOT NULL AND v <> ''").groupBy("s", "k").agg(F.max("v").alias("v"))
    left, right = key.select(F.col("s").alias("a"), "k", F.col("v").alias("va")), key.select(F.col("s").alias("b"), "k", F.col("v").alias("vb"))
    both = left.join(right, "k").filter(F.col("a") < F.col("b"))
    g = both.groupBy("a", "b").agg(F.count("*").alias("n_common"), F.count_if(F.col("va") == F.col("vb")).alias("n_agree"))
    rate = F.col("n_agree") / F.col("n_common")
    return g.withColumn("rate", F.round(rate, 4)).withColumn("verdict", F.when(rate >= 0.99, "match").when(rate >= 0.95, "slight mismatch").otherwise("mismatch"))


def choices(frame: DataFrame) -> Column:
    """The choices of an item from a list, a text of lines or columns A to E, without their letters."""
    kinds = dict(frame.dtypes)
    if kinds.get("choices", "").startswith("array"):
        raw = F.col("choices")
    else:
        lines = F.filter(F.transform(F.split(F.col("choices"), r"\R"), lambda x: strip(x)), lambda x: x != "") if "choices" in kinds else F.lit(None).cast("array<string>")
        cols = F.array_compact(F.array(*[F.col(c).cast("string") if c in kinds else F.lit(None).cast("string") for c in LETTERS]))
        raw = F.coalesce(lines, cols)
    letters = F.array(*[F.lit(x) for x in LETTERS])
    return F.transform(raw, lambda c, i: strip(F.regexp_replace(strip(c), F.concat(F.lit("^"), F.coalesce(F.get(letters, i), F.lit("$")), F.lit(r"[.)]\s*")), F.lit(""))))


def answer_index(frame: DataFrame) -> Column:
    """The index of the right choice, from a letter or a number."""
    kinds = dict(frame.dtypes)
    given = [F.nullif(strip(F.col(c).cast("string")), F.lit("")) for c in ("answer", "answer_key", "gold", "label", "correct") if c in kinds]
    a = F.upper(F.coalesce(*given)) if given else F.lit(None).cast("string")
    at = F.array_position(F.array(*[F.lit(x) for x in LETTERS]), F.left(a, F.lit(1)))
    return F.when(at > 0, at - 1).otherwise(F.when(a.rlike(r"^\d+$"), a.cast("bigint")))


def has_answer(frame: DataFrame) -> Column:
    i = answer_index(frame)
    return i.isNotNull() & (i >= 0)


def answerable(frame: DataFrame, split: str = "split") -> DataFrame:
    """split, n, n_answered: how many items of each split have a right choice."""
    return frame.withColumn("_h", has_answer(frame)).groupBy(split).agg(F.count("*").alias("n"), F.count_if(F.coalesce("_h", F.lit(False))).alias("n_answered"))


def item_prompt(frame: DataFrame) -> Column:
    c = choices(frame)
    letters = F.array(*[F.lit(x) for x in LETTERS])
    lines = F.transform(c, lambda x, i: F.concat(F.coalesce(F.get(letters, i), F.lit("?")), F.lit(". "), x))
    return F.concat_ws("\n", F.concat(F.lit("Câu hỏi: "), strip(F.col("question"))), F.array_join(lines, "\n"), F.lit("Đáp án:"))


def subject_of(frame: DataFrame, candidates: tuple[str, ...] = ("subject", "category", "topic", "field")) -> Column:
    """The first column of the candidates that there is, else the id up to a hyphen; raises without either."""
    for c in candidates:
        if c in frame.columns:
            return F.coalesce(F.col(c).cast("string"), F.lit("UNKNOWN"))
    if "id" not in frame.columns:
        raise ValueError(f"no column of {candidates} and no id")
    return F.split_part(F.col("id").cast("string"), F.lit("-"), F.lit(1))


def random_baseline(n_choices: DataFrame, n: str = "n_choices", default: float = 0.25) -> DataFrame:
    return n_choices.agg(F.coalesce(F.avg(F.when(F.col(n) > 0, 1.0 / F.col(n))), F.lit(default)).alias("baseline"))


def best_extraction(versions: DataFrame, key: str = "file", text: str = "text", by: str = "glue") -> DataFrame:
    """Of several extractions of a file, the one with the least glued words (``glue``) or the longest (``length``); ties go to the longer and then to the first text."""
    from lumiscript.functions.text import glue_ratio

    order = glue_ratio(F.col(text)) if by == "glue" else -F.length(text)
    return versions.groupBy(key).agg(F.min_by(F.struct(*[c for c in versions.columns if c != key]), F.struct(order, -F.length(text), F.col(text))).alias("_b")).select(key, "_b.*")



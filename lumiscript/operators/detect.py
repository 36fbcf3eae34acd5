"""Signals of damaged text, the flags they raise, and the queue for human review."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumiscript.functions import text as T

CODES = ("E1", "E2", "E3", "E4", "E5", "E6")


@dataclass(frozen=True)
class Thresholds:
    diacritic_floor: float = 0.10
    diacritic_drop: float = 0.25
    tone_loss_tokens: int = 2
    ngram_ceiling: float = 0.15
    least_words: int = 40
    line_ceiling: float = 0.30


def lexicon(texts: DataFrame, text: str = "text") -> DataFrame:
    """folded, surface, cnt: the spellings of each word, counted map-side first."""
    w = texts.select(F.explode(T.words(F.lower(F.col(text)))).alias("surface"))
    return w.groupBy("surface").agg(F.count("*").alias("cnt")).select(T.fold(F.col("surface")).alias("folded"), "surface", "cnt")


def suspicious_tokens(lex: DataFrame, least: int = 2) -> DataFrame:
    """token: bare spellings that a corpus only knows with marks."""
    marked = F.col("surface") != F.col("folded")
    per = lex.groupBy("folded").agg(F.bool_or(marked).alias("has_marked"), F.max(F.when(~marked, F.col("cnt"))).alias("bare"))
    return per.filter(F.col("has_marked") & (F.coalesce("bare", F.lit(0)) < least)).select(F.col("folded").alias("token"))


def tone_loss(texts: DataFrame, lex: DataFrame, keys: list[str], text: str = "text", least: int = 2, small: int = 200_000) -> DataFrame:
    """keys, tokens: the suspicious tokens of each text in order, repeats kept; texts without any are left out.

    The suspicious tokens are words of one language that always have marks, and
    few; up to ``small`` of them go to the texts, so no token of a text is
    shuffled. Beyond that the tokens are joined where they lie.
    """
    rows = suspicious_tokens(lex, least).limit(small + 1).collect()
    if len(rows) <= small:
        suspects = F.broadcast(lex.sparkSession.createDataFrame([(r.token,) for r in rows], "token string"))
    else:
        suspects = suspicious_tokens(lex, least)
    w = texts.select(*keys, F.posexplode(T.words(F.col(text))).alias("pos", "word")).withColumn("token", F.lower("word"))
    hit = w.join(suspects, "token")
    return hit.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda s: s["word"]).alias("tokens"))


def text_signals(text: Column, finish_reason: Column | None = None) -> dict[str, Column]:
    """The signals that a text has in itself, each one expression in the row."""
    return {
        "n_chars": F.length(text).cast("bigint"),
        "n_words": F.size(T.words(text)).cast("bigint"),
        "diacritic_ratio": T.diacritic_ratio(text),
        "mojibake_hits": T.mojibake_hits(text),
        "confusion_terms": T.confusion_terms(text),
        "foreign_script": T.foreign_script_hits(text),
        "english_runs": T.english_runs(text),
        "max_ngram_repeat": T.max_ngram_repeat(text),
        "max_line_repeat": T.max_line_repeat(text),
        "truncated": T.looks_truncated(text),
        "hit_length_limit": F.coalesce(finish_reason == "length", F.lit(False)) if finish_reason is not None else F.lit(False),
    }


def signals(rows: DataFrame, keys: list[str], text: str, finish_reason: str | None = None, lex: DataFrame | None = None, index: DataFrame | None = None) -> DataFrame:
    """All signals of each text; those on tones and citations join the lexicon and the index, where given."""
    from lumiscript.operators.citations import checked_citations

    none = F.array().cast("array<string>")
    out = rows.select(*keys, F.col(text).alias("_t"), *[c.alias(n) for n, c in text_signals(F.col(text), F.col(finish_reason) if finish_reason else None).items()])
    if lex is not None:
        out = out.join(tone_loss(rows.select(*keys, text), lex, keys, text).withColumnRenamed("tokens", "tone_loss_tokens"), keys, "left")
    else:
        out = out.withColumn("tone_loss_tokens", none)
    if index is not None:
        per = checked_citations(rows.select(*keys, text), index, keys, text).groupBy(*keys).agg(F.count("*").alias("n_citations"), F.sort_array(F.collect_list(F.when(~F.col("known"), F.col("raw")))).alias("unknown_citations"))
        out = out.join(per, keys, "left")
    else:
        out = out.withColumn("n_citations", F.lit(0)).withColumn("unknown_citations", none)
    return out.drop("_t").withColumns({"tone_loss_tokens": F.coalesce("tone_loss_tokens", none), "unknown_citations": F.coalesce("unknown_citations", none), "n_citations": F.coalesce("n_citations", F.lit(0)).cast("bigint")})


def flag_columns(th: Thresholds = Thresholds(), reference_ratio: Column | None = None) -> dict[str, Column]:
    """E1 to E6 from the signal columns; null signals raise nothing."""
    some = lambda c: F.coalesce(F.size(c) > 0, F.lit(False))
    yes = lambda c: F.coalesce(c, F.lit(False))
    e2 = yes(F.size("tone_loss_tokens") >= th.tone_loss_tokens) | yes((F.col("n_words") > 0) & (F.col("diacritic_ratio") < th.diacritic_floor))
    if reference_ratio is not None:
        e2 = e2 | yes(F.try_divide(reference_ratio - F.col("diacritic_ratio"), F.nullif(reference_ratio, F.lit(0.0))) >= th.diacritic_drop)
    e6 = yes(F.col("truncated") & ~F.col("hit_length_limit")) | yes((F.col("n_words") >= th.least_words) & (F.col("max_ngram_repeat") >= th.ngram_ceiling)) | yes(F.col("max_line_repeat") >= th.line_ceiling)
    return {"E1": some("mojibake_hits"), "E2": e2, "E3": some("unknown_citations"), "E4": F.lit(False), "E5": some("foreign_script") | some("english_runs"), "E6": e6}


def with_flags(sig: DataFrame, th: Thresholds = Thresholds(), reference_ratio: str | None = None) -> DataFrame:
    return sig.withColumns(flag_columns(th, F.col(reference_ratio) if reference_ratio else None))


def reference_ratios(sig: DataFrame, key: str = "id", tag: str = "tag", precision: str = "bf16", per_model: bool = True) -> DataFrame:
    """key, (model,) ref_ratio: the ratio of the reference precision; of one model each, or of the last model by name for all."""
    ref = sig.filter(T.precision_of(F.col(tag)) == precision).withColumn("model", T.model_of(F.col(tag)))
    if per_model:
        return ref.groupBy(key, "model").agg(F.max_by("diacritic_ratio", F.struct(tag)).alias("ref_ratio"))
    return ref.groupBy(key).agg(F.max_by("diacritic_ratio", F.struct("model", tag)).alias("ref_ratio"))


def needs_review() -> Column:
    flags = F.lit(False)
    for code in CODES:
        flags = flags | F.col(code)
    return flags | F.coalesce(F.size("confusion_terms") > 0, F.lit(False))


def primary_flag() -> Column:
    out = F.lit("none")
    for code in reversed(CODES):
        out = F.when(F.col(code), code).otherwise(out)
    return out


def drawn(seed: int | str, *keys: str) -> Column:
    """A draw that depends on the seed and the keys only, never on partitions."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))


def review_queue(flagged: DataFrame, keys: list[str], tag: str = "tag", k: int = 8, most: int = 250, seed: int = 20260825) -> DataFrame:
    """At most k drawn rows for each tag and primary flag, then at most ``most`` in all."""
    rows = flagged.filter(needs_review()).withColumn("stratum", primary_flag()).withColumn("draw", drawn(seed, *keys))
    w = Window.partitionBy(tag, "stratum").orderBy("draw", *keys)
    picked = rows.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= k)
    return picked.orderBy("draw", *keys).limit(most)


def flag_rates(flagged: DataFrame, by: str) -> DataFrame:
    """Percent of rows with each flag."""
    return flagged.groupBy(by).agg(F.count("*").alias("n"), *[F.round(100 * F.avg(F.col(c).cast("double")), 4).alias(c) for c in CODES])


def screening_verdict(accuracy: Column, diacritic: Column, mojibake: Column, foreign: Column, baseline: float = 0.2532, headroom: float = 0.10, least_diacritic: float = 0.15) -> Column:
    return F.when(accuracy - baseline < headroom, "REJECT_FLOOR").when(diacritic < least_diacritic, "REJECT_MARKS").when((mojibake > 0) | (foreign > 2), "CONSIDER").otherwise("USE")

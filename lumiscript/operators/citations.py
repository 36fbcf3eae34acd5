"""Legal citations: extraction, the index of what exists, and the gate on answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumiscript.functions.text import collapse, norm_doc

# The forms of citations.
KINDS = r"(?iu)(?U)\b(Nghị\s*định|Luật|Thông\s*tư|Quyết\s*định|QCVN)\s*(?:số\s*)?(\d+[/:]\d{2,4}(?:/[A-ZĐ0-9\-]+)?)"
KINDS_LETTERS = KINDS.replace("0-9", "")
DIEU = r"(?iu)(?U)\bĐiều\s+(\d+[a-zA-Z]?)"
KHOAN = r"(?iu)(?U)\bkhoản\s+(\d+)"
DIEM = r"(?iu)(?U)\bđiểm\s+([a-zA-Zđ])\b"
BIENBAO = r"(?U)\b[PBWRISDE]\.\d{1,3}[a-z]?\b"
VERIFIABLE = ("doc", "dieu", "bienbao")


def citations(text: Column, letters_only: bool = False) -> Column:
    """kind, value, raw of every citation, by kind and then in the order of the text.

    ``letters_only`` ends a document's number before digits in its last part,
    as older outputs do.
    """
    pattern = KINDS_LETTERS if letters_only else KINDS

    def found(kind: str, p: str, value) -> Column:
        raw = F.regexp_extract_all(text, F.lit(p), F.lit(0))
        return F.transform(raw, lambda r: F.struct(F.lit(kind).alias("kind"), value(r).alias("value"), r.alias("raw")))

    doc = lambda r: norm_doc(F.concat(collapse(F.regexp_extract(r, pattern, 1)), F.lit(" "), F.regexp_extract(r, pattern, 2)))
    return F.concat(
        found("doc", pattern, doc),
        found("dieu", DIEU, lambda r: F.lower(F.regexp_extract(r, DIEU, 1))),
        found("khoan", KHOAN, lambda r: F.regexp_extract(r, KHOAN, 1)),
        found("diem", DIEM, lambda r: F.lower(F.regexp_extract(r, DIEM, 1))),
        found("bienbao", BIENBAO, lambda r: r),
    )


def citation_index(articles: DataFrame) -> DataFrame:
    """kind, value: the distinct documents, article numbers and signs of a corpus."""
    docs = articles.select(F.lit("doc").alias("kind"), norm_doc(F.col("doc_id")).alias("value"))
    numbers = articles.select(F.lit("dieu").alias("kind"), F.lower(F.trim("dieu")).alias("value"))
    signs = articles.select(F.lit("bienbao").alias("kind"), F.explode("bienbao").alias("value")).select("kind", F.upper("value").alias("value"))
    return docs.unionByName(numbers).unionByName(signs).filter("value IS NOT NULL AND value <> ''").distinct()


def checked_citations(answers: DataFrame, index: DataFrame, keys: list[str], text: str, letters_only: bool = False) -> DataFrame:
    """keys, kind, value, raw, known: each verifiable citation; kinds without any entry in the index always pass."""
    rows = answers.select(*keys, F.inline(citations(F.col(text), letters_only))).filter(F.col("kind").isin(*VERIFIABLE))
    look = rows.withColumn("_v", F.when(F.col("kind") == "bienbao", F.upper("value")).otherwise(F.col("value")))
    kinds = index.select("kind").distinct().withColumn("_checked", F.lit(True))  # three rows at most
    known = index.select("kind", F.col("value").alias("_v")).withColumn("_known", F.lit(True))
    out = look.join(F.broadcast(kinds), "kind", "left").join(known, ["kind", "_v"], "left")
    return out.select(*keys, "kind", "value", "raw", (F.col("_known").isNotNull() | F.col("_checked").isNull()).alias("known"))


def gate(answers: DataFrame, index: DataFrame, keys: list[str], text: str, require: bool = True, letters_only: bool = False) -> DataFrame:
    """keys, total, unknown, ok, rate: the verdict on each answer."""
    per = checked_citations(answers, index, keys, text, letters_only).groupBy(*keys).agg(F.count("*").alias("total"), F.count_if(~F.col("known")).alias("unknown"))
    rows = answers.select(*keys).distinct().join(per, keys, "left")
    total, unknown = F.coalesce("total", F.lit(0)), F.coalesce("unknown", F.lit(0))
    ok = (unknown == 0) & ((total > 0) if require else F.lit(True))
    return rows.select(*keys, total.alias("total"), unknown.alias("unknown"), ok.alias("ok"), F.coalesce(F.try_divide(unknown.cast("double"), total), F.lit(0.0)).alias("rate"))

"""Date-effective amendments over base texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumiscript.functions.text import article_of


def effective(units: DataFrame, amendments: DataFrame, as_of: str | None = None, by_article: bool = True) -> DataFrame:
    """unit_id and each amendment in force at ``as_of`` (an ISO date, compared as text; none: all; '' is always in force).

    Units of clauses look up their article unless ``by_article`` is off.
    """
    rows = amendments if as_of is None else amendments.filter((F.coalesce("effective_date", F.lit("")) == "") | (F.col("effective_date") <= as_of))
    key = article_of(F.col("unit_id")) if by_article else F.col("unit_id")
    return units.select("unit_id", key.alias("target_unit_id")).distinct().join(rows, "target_unit_id").select("unit_id", *[c for c in rows.columns])


def rendered(amendments: DataFrame) -> DataFrame:
    """Adds ``block``: what a reader sees of an amendment."""
    when = F.when(F.coalesce("effective_date", F.lit("")) != "", F.concat(F.lit(", hiệu lực từ "), F.col("effective_date"))).otherwise("")
    head = F.concat(F.lit("[SỬA ĐỔI bởi "), "source_doc", F.lit(" Điều "), "source_dieu", when, F.lit("]"))
    return amendments.withColumn("block", F.concat_ws("\n", head, "text"))


def augmented_context(run: DataFrame, units: DataFrame, amendments: DataFrame, as_of: str | None = None, budget: int = 6000) -> DataFrame:
    """query_id, context, n_units: each unit with its amendments in force as one block, in rank order within the budget.

    The lengths of blocks count, the separators between them don't.
    """
    asked = run.select("unit_id").distinct()
    own = rendered(effective(asked, amendments, as_of)).groupBy("unit_id").agg(F.array_sort(F.collect_list(F.struct("source_doc", "source_dieu", "block"))).alias("_a"))
    texts = units.select("unit_id", "text").filter("text IS NOT NULL AND text <> ''").join(own, "unit_id", "left")
    blocks = F.concat(F.array("text"), F.coalesce(F.transform("_a", lambda s: s["block"]), F.array().cast("array<string>")))
    rows = run.join(texts.select("unit_id", F.array_join(blocks, "\n\n").alias("chunk")), "unit_id")
    total = F.sum(F.length("chunk")).over(Window.partitionBy("query_id").orderBy("rank"))
    kept = rows.withColumn("total", total).filter(F.col("total") <= budget)
    parts = F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk"))), lambda s: s["chunk"])
    return kept.groupBy("query_id").agg(F.array_join(parts, "\n\n---\n\n").alias("context"), F.count("*").alias("n_units"))


def affected_units(amendments: DataFrame) -> DataFrame:
    """target_unit_id, n: the units that amendments are about, with how many each has; a count, so a much amended unit is one row."""
    return amendments.filter("target_unit_id IS NOT NULL").groupBy("target_unit_id").agg(F.count("*").alias("n"))


def amendment_stats(amendments: DataFrame) -> DataFrame:
    return amendments.agg(F.count("*").alias("n_amendments"), F.countDistinct("target_unit_id").alias("n_targets"))

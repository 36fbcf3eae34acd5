"""What the named methods decide on the test tables: the rows with each method and with it switched off."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lumiscript.llm import pairs, queries, repetition, subjects

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="the test tables aren't here")


def test_repetition_posterior(spark):
    """Share of all copies: a check only. The posterior finds what no function finds by itself."""
    m = queries.p3_measures(spark, SF).cache()
    found = {r.gen_id for r in m.filter("repetitive >= 0.5").select("gen_id").distinct().collect()}
    exact = {r.gen_id for r in m.filter(F.col("repeat_share") >= repetition.SHARE).select("gen_id").distinct().collect()}
    assert len(exact) > 50 and len(found & exact) >= 0.98 * len(exact) and len(found - exact) <= 0.02 * len(exact)
    for v in repetition.VOTES:
        own = {r.gen_id for r in m.filter(f"{v} = 1").select("gen_id").distinct().collect()}
        print(v, len(own), len(found), len(own ^ found))
        assert len(own ^ found) >= 3


def test_pair_defects_need_the_model(spark):
    """No labelling function gives the rows of its defect by itself, but that no answer here is as short as one that says nothing."""
    voted = pairs.voted_pairs(queries.answer_pairs(spark, SF), queries.language_model(spark, SF), "key", "q", "a", "finish_reason").cache()
    rows = pairs.defective_pairs(voted, "key").collect()
    for defect, votes in pairs.DEFECTS.items():
        found = {r.key for r in rows if r.defect == defect}
        off = {v: len({r.key for r in voted.filter(f"{v} = 1").select("key").distinct().collect()} ^ found) for v in votes}
        print(defect, len(found), off)
        assert found and min(n for v, n in off.items() if v != "e_short") >= 1


def test_subject_rules_of_several_words(spark):
    """Without the sets that FP-growth mines, a tenth of the rows and more is lost."""
    docs, model = queries.table(spark, SF, "documents"), queries.subject_model(spark, SF)
    single = subjects.SubjectModel(model.subjects, [r for r in model.rules if len(r[0]) == 1], model.scale)
    full, less = (subjects.document_subjects(docs, m, ["doc_id"]).select("doc_id", "subject").distinct().count() for m in (model, single))
    print(full, less)
    assert less < 0.9 * full

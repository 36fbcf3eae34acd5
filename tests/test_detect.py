import pytest
from pyspark.sql import functions as F

from lumiscript.operators import agreement, corpus, detect
from lumiscript.plans import jobs

CLEAN = "Người dân nộp hồ sơ tại phường. Điều khoản được áp dụng đầy đủ."


def generations(spark, rows):
    return spark.createDataFrame(rows, "id string, tag string, output string, finish_reason string")


def test_flags(spark):
    rows = [("1", "m@bf16", CLEAN, "stop"), ("2", "m@bf16", "Nguoi dan nop ho so tai phuong nay.", None), ("3", "m@bf16", "vỡ á» chữ.", None), ("4", "m@bf16", "Trả lời 中文.", None), ("5", "m@bf16", "chưa xong", "stop"), ("6", "m@bf16", "chưa xong", "length"), ("7", "m@bf16", None, None), ("8", "m@bf16", "", None), ("9", "m@bf16", "Theo Điều 99 đã rõ.", None)]
    arts = spark.createDataFrame([("L", "1", [])], "doc_id string, dieu string, bienbao array<string>")
    clean = spark.createDataFrame([(CLEAN,)], "text string")
    f = {r.id: [c for c in detect.CODES if r[c]] for r in jobs.probe_errors(generations(spark, rows), clean, arts).collect()}
    assert f == {"1": [], "2": ["E2"], "3": ["E1"], "4": ["E5"], "5": ["E6"], "6": [], "7": [], "8": ["E6"], "9": ["E3"]}


def test_relative_drop(spark):
    rows = [("1", "m@bf16", "được được được", None), ("1", "m@int4", "được duoc duoc", None), ("1", "n@bf16", "duoc", None)]
    got = {r.tag: r.E2 for r in jobs.probe_errors(generations(spark, rows)).collect()}
    assert got == {"m@bf16": False, "m@int4": True, "n@bf16": True}


def test_tone_loss(spark):
    lex = detect.lexicon(spark.createDataFrame([("được được và Trung tâm",)], "text string"))
    df = spark.createDataFrame([(1, "Duoc va duoc trung"), (2, "được"), (3, None)], "i int, text string")
    assert {r.i: r.tokens for r in detect.tone_loss(df, lex, ["i"]).collect()} == {1: ["Duoc", "va", "duoc"]}


def test_queue(spark):
    rows = [(str(i), f"m@{i % 3}", "chưa xong" if i % 2 else "中文.", "stop") for i in range(200)]
    flagged = jobs.probe_errors(generations(spark, rows))
    q = jobs.sample_queue(flagged, k=4, most=20)
    assert q.count() == 20 and q.groupBy("tag", "stratum").count().agg(F.max("count")).first()[0] <= 4
    assert {r.id for r in q.collect()} == {r.id for r in jobs.sample_queue(flagged.repartition(7), k=4, most=20).collect()}
    r = detect.flag_rates(flagged, "tag").orderBy("tag").first()
    assert r.n == 67 and 45 < r.E5 < 55


def test_validation(spark):
    ok = ("1", "Hỏi gì?", "đáp", [("L", "5", "", "")], "thu_tuc", "single_hop", "real_forum")
    rows = [ok, ("2", "Hỏi gì", " ", [("L", "", "", "")], "khac", "multi_hop", None), (None, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "id string, question string, answer_reference string, citations array<struct<doc:string,dieu:string,khoan:string,diem:string>>, question_type string, difficulty string, source_of_question string")
    got = [r[0] for r in df.select(corpus.validation_errors()).collect()]
    assert got[0] == [] and got[1] == ["missing answer_reference", "bad question_type", "bad source_of_question", "citations[0] without dieu", "multi_hop with one citation", "no question mark"] and "no citation" in got[2]


def test_labels(spark):
    rows = [("i1", "t", "A", {"E1": True}, 1), ("i1", "t", "B", {"E1": False, "E2": True}, 1), ("i2", "t", "A", {"E2": True}, 1), ("i3", "t", "B", None, 1)]
    df = spark.createDataFrame(rows, "id string, tag string, annotator string, labels map<string,boolean>, labelled_at int")
    p = agreement.paired_labels(df, F.col("annotator") == "A", F.col("annotator") == "B", ["E1", "E2"])
    assert sorted((r.code, r.a, r.b) for r in p.collect()) == [("E1", True, False), ("E2", False, True)]
    m = agreement.merged_labels(df, ["E1", "E2"])
    assert {r.id: (r.E1, r.E2) for r in m.collect()} == {"i1": (True, True), "i2": (False, True), "i3": (False, False)}
    d = agreement.error_distribution(m, ["E1", "E2"], least=3).first()
    assert (d.n, d.E1, d.E2) == (3, "33.3", "66.7") and agreement.error_distribution(m, ["E1"]).first().E1 == "n<15"
    truth = spark.createDataFrame([("a", "E1", True), ("b", "E1", False), ("c", "E1", True)], "id string, code string, label boolean")
    machine = spark.createDataFrame([("a", "E1", True), ("b", "E1", True)], "id string, code string, flag boolean")
    r = agreement.calibration(truth, machine, ["id"]).first()
    assert (r.tp, r.fp, r.fn, r.precision, r.recall) == (1, 1, 1, 0.5, 0.5)
    table, none = jobs.agreement_report(df, F.col("annotator") == "A", F.col("annotator") == "B", ["E1"], times=100)
    assert table.count() == 1 and none is None
    tags = spark.createDataFrame([("m@zz",), ("m@int8",), ("m@bf16",), ("a@int8",)], "tag string")
    assert [r.tag for r in agreement.ordered_tags(tags, ["bf16", "int8"]).collect()] == ["a@int8", "m@bf16", "m@int8", "m@zz"]


def test_whole_review_queue(spark, tmp_path):
    """Broken encoding alone, confusion terms alone, unknown citations and lost tones all reach the queue."""
    from lumiscript.queries import QUERIES

    fine = "Người dân nộp hồ sơ ở phường trước ngày mười lăm và chờ trả lời."
    rows = [("ok", fine), ("e1", fine + " Má»\x8d."), ("e1e6", fine + " Má»\x8d. Người dân nộp"), ("e2", fine + " Nguoi dan phuong nguoi."), ("e3", fine + " Theo Điều 99."), ("conf", fine + " Mức phạt tiền là cao."), ("null", None)]
    df = spark.createDataFrame([(i, k, "m@bf16", "hỏi", t, "stop", 0) for i, (k, t) in enumerate(rows)], "gen_id long, id string, tag string, prompt string, output string, finish_reason string, ingested_at long")
    df.union(df.filter("id = 'e1'")).write.parquet(f"{tmp_path}/generations.parquet")
    arts = [("x::dieu-1", "x", "1", fine, ["P.1"], 0)] * 3
    spark.createDataFrame([(f"{u}{i}", *v) for i, (u, *v) in enumerate(arts)], "unit_id string, doc_id string, dieu string, text string, bienbao array<string>, collected_at long").write.parquet(f"{tmp_path}/articles.parquet")
    got = {r.id: r.stratum for r in QUERIES["review_queue_full"](spark, str(tmp_path)).collect()}
    assert got == {"e1": "E1", "e1e6": "E1", "e2": "E2", "e3": "E3", "conf": "none"}


def test_crosscheck(spark):
    rows = [("a", "Một?", "A"), ("b", " một? ", "A"), ("a", "Hai?", "B"), ("b", "hai?", "C"), ("c", "Ba?", None)]
    df = spark.createDataFrame(rows, "source string, question string, answer string")
    assert [tuple(r) for r in jobs.verify_sources(df).collect()] == [("a", "b", 2, 1, 0.5, "mismatch")]


def test_calibration_set(spark):
    body = "Người dân nộp hồ sơ. " * 15
    df = spark.createDataFrame([(i, body + str(i)) for i in range(30)] + [(99, "nguoidannophoso" * 40)], "doc_id int, text string")
    got = jobs.calibration_set(df, F.col("doc_id") < 10, n=20)
    assert got.count() == 20 and got.filter("doc_id = 99").count() == 0 and got.filter("is_legal").count() == 10


def test_screening(spark):
    df = spark.createDataFrame([(0.3, 0.3, 0, 0), (0.6, 0.1, 0, 0), (0.6, 0.3, 1, 0), (0.6, 0.3, 0, 2)], "a double, d double, m int, f int")
    got = [r[0] for r in df.select(detect.screening_verdict(F.col("a"), F.col("d"), F.col("m"), F.col("f"))).collect()]
    assert got == ["REJECT_FLOOR", "REJECT_MARKS", "CONSIDER", "USE"]


def test_extraction_choice(spark):
    df = spark.createDataFrame([("f", "x", "chữ rõ ràng"), ("f", "y", "chữrõràng dínhliền"), ("g", "x", "ngắn"), ("g", "y", "dài hơn nhiều")], "file string, tool string, text string")
    assert {r.file: r.tool for r in corpus.best_extraction(df).collect()}["f"] == "x"
    assert {r.file: r.tool for r in corpus.best_extraction(df, by="length").collect()} == {"f": "y", "g": "y"}
    with pytest.raises(Exception):
        corpus.best_extraction(df.drop("text")).collect()

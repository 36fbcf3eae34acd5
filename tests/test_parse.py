from pyspark.sql import functions as F

from lumiscript.operators import amend, citations, corpus, parse
from lumiscript.plans import jobs

LAW = """Lời đầu
Điều 1. Phạm vi
Đoạn dẫn của điều
1. Khoản một có biển W.201
tiếp dòng
a) điểm a
b) điểm b
còn nữa
2. Khoản hai
Điều 2.
Tên ở dòng dưới
x) không phải điểm vì chưa có khoản
Điều 3a. Cuối
Chỉ có đoạn B.7a và W.201, W.201
"""


def test_articles(spark):
    df = spark.createDataFrame([("Luật 1", LAW), ("rỗng", ""), ("null", None), ("Luật 1 bis", "không có gì")], "doc_id string, text string")
    rows = {r.dieu: r for r in parse.parse_articles(df).collect()}
    assert sorted(rows) == ["1", "2", "3a"]
    a = rows["1"]
    assert a.unit_id == "Luật 1::dieu-1" and a.title == "Phạm vi" and a.bienbao == ["W.201"]
    assert [(k.khoan, k.text) for k in a.khoan] == [("1", "Khoản một có biển W.201 tiếp dòng"), ("2", "Khoản hai")]
    assert [(d.diem, d.text) for d in a.khoan[0].diem] == [("a", "điểm a"), ("b", "điểm b còn nữa")]
    assert a.text.startswith("Đoạn dẫn của điều 1. Khoản") and a.text.count("Đoạn dẫn") == 1
    assert rows["2"].title == "Tên ở dòng dưới" and rows["2"].khoan == []
    assert rows["3a"].bienbao == ["B.7a", "W.201"]
    twice = {r.dieu: r.text for r in parse.parse_articles(df, repeat_preamble=True).collect()}
    assert twice["1"].count("Đoạn dẫn") == 2


def test_procedures(spark):
    text = "Cấp giấy\nMã thủ tục\n1.001\nLĩnh vực\nA\nĐổi giấy\nMã thủ tục\n2.002\nB"
    df = spark.createDataFrame([("TTHC", text), ("x", "không có"), ("y", None)], "doc_id string, text string")
    rows = sorted((r.ma, r.ten, r.text) for r in parse.parse_procedures(df).collect())
    assert rows == [("1.001", "Cấp giấy", "Cấp giấy\nMã thủ tục\n1.001\nLĩnh vực\nA"), ("2.002", "Đổi giấy", "Đổi giấy\nMã thủ tục\n2.002\nB")]


AMENDING = """Điều 1. Sửa đổi khoản 2, điểm a khoản 10 của Điều 6
nội dung "trích Điều 99"
Điều 2. Bổ sung một số cụm từ
tại Điều 12 và Điều 3 của Nghị định, thêm “theo Điều 50” vào Điều này
Điều 3. Hiệu lực thi hành
từ hôm nay
"""


def test_amendments(spark):
    df = spark.createDataFrame([("N2", "N1", "2026-08-15", AMENDING)], "source_doc string, target_doc string, effective_date string, text string")
    a = parse.parse_amendments(df)
    rows = sorted((r.source_dieu, r.target_unit_id, tuple(r.khoan), tuple(r.diem)) for r in a.collect())
    assert rows == [("1", "N1::dieu-6", ("2", "10"), ("a",)), ("2", "N1::dieu-12", (), ()), ("2", "N1::dieu-3", (), ())]
    units = spark.createDataFrame([("N1::dieu-6", "Điều sáu"), ("N1::dieu-3::khoan-1", "Khoản"), ("N1::dieu-9", "Không")], "unit_id string, text string")
    count = lambda d: amend.effective(units, a, d).count()
    assert (count("2026-08-01"), count("2026-08-20"), count(None)) == (0, 2, 2)
    assert amend.effective(units, a, None, by_article=False).count() == 1
    run = spark.createDataFrame([("q", "N1::dieu-6", 2.0, 1), ("q", "N1::dieu-9", 1.0, 2)], "query_id string, unit_id string, score double, rank int")
    before = amend.augmented_context(run, units, a, "2026-08-01").first()
    after = amend.augmented_context(run, units, a, "2026-08-20").first()
    assert before.context == "Điều sáu\n\n---\n\nKhông" and after.context.startswith("Điều sáu\n\n[SỬA ĐỔI bởi N2")
    assert amend.augmented_context(run, units, a, "2026-08-01", budget=10).first().n_units == 1
    assert [r.query_id for r in jobs.context_change(run, units, a, "2026-08-01", "2026-08-20").collect()] == ["q"]


def test_units(spark):
    long_ = [("L::dieu-1", "L", "1", "Tên", "x" * 50, [("1", "một", [("a", "điểm")]), ("2", "hai", [])], []), ("L::dieu-2", "L", "2", None, "ngắn", None, None)]
    df = spark.createDataFrame(long_, "unit_id string, doc_id string, dieu string, title string, text string, khoan array<struct<khoan:string,text:string,diem:array<struct<diem:string,text:string>>>>, bienbao array<string>")
    got = {r.unit_id: r.text for r in parse.retrieval_units(df, 20).collect()}
    assert got == {"L::dieu-1::khoan-1": "L — Điều 1. Tên\nKhoản 1. một a) điểm", "L::dieu-1::khoan-2": "L — Điều 1. Tên\nKhoản 2. hai", "L::dieu-2": "L — Điều 2. \nngắn"}
    assert {r.unit_id for r in parse.retrieval_units(df, 20, whole_only=True).collect()} == {"L::dieu-1", "L::dieu-2"}
    s = corpus.corpus_stats(df).first()
    assert (s.n_docs, s.n_articles, s.n_clauses, s.n_points, s.n_signs) == (1, 2, 2, 1, 0)


def test_citations(spark):
    text = "Theo Luật 36/2024/QH15, Nghị  định số 168/2024/NĐ-CP tại điểm a khoản 3 Điều 6 và Điều 7b, biển P.106a."
    df = spark.createDataFrame([(text,)], "t string")
    got = [(c.kind, c.value) for c in df.select(citations.citations(F.col("t"))).first()[0]]
    assert got == [("doc", "luật 36/2024/qh15"), ("doc", "nghị định 168/2024/nđ-cp"), ("dieu", "6"), ("dieu", "7b"), ("khoan", "3"), ("diem", "a"), ("bienbao", "P.106a")]
    old = [c.value for c in df.select(citations.citations(F.col("t"), letters_only=True)).first()[0]]
    assert old[0] == "luật 36/2024/qh"


def test_gate(spark):
    arts = spark.createDataFrame([("Luật 36/2024/QH15", "6", ["P.106a"])], "doc_id string, dieu string, bienbao array<string>")
    answers = spark.createDataFrame([(1, "Điều 6 Luật 36/2024/QH15"), (2, "Điều 60"), (3, "không căn cứ"), (4, None), (5, "biển P.106a và W.999")], "id int, a string")
    got = {r.id: (r.total, r.unknown, r.ok) for r in citations.gate(answers, citations.citation_index(arts), ["id"], "a").collect()}
    assert got == {1: (2, 0, True), 2: (1, 1, False), 3: (0, 0, False), 4: (0, 0, False), 5: (2, 1, False)}
    without_signs = arts.withColumn("bienbao", F.array().cast("array<string>"))
    assert {r.id: r.unknown for r in citations.gate(answers, citations.citation_index(without_signs), ["id"], "a").collect()}[5] == 0


def test_checks(spark):
    rows = [("L", "1", "x" * 100), ("L", "4", "ngắn"), ("L", "4", "ngắn"), ("T", "1.001", None)]
    df = spark.createDataFrame(rows, "doc_id string, dieu string, text string")
    got = {r.doc_id: r for r in corpus.corpus_check(df).collect()}
    assert (got["L"].n_articles, got["L"].n_dups, got["L"].n_thin, got["L"].n_gaps) == (3, 1, 2, 2)
    assert [(r.doc_id, r.gap) for r in corpus.numbering_gaps(df).orderBy("gap").collect()] == [("L", 2), ("L", 3)]
    want = spark.createDataFrame([("L", 2), ("Z", 1)], "doc_id string, n_expected int")
    assert {r.doc_id: r.ok for r in corpus.expected_counts(df, want).collect()} == {"L": True, "Z": False}


def test_build_corpus(spark):
    laws = spark.createDataFrame([("L", LAW)], "doc_id string, text string")
    procs = spark.createDataFrame([("T", "Tên\nMã thủ tục\n1.1\nx")], "doc_id string, text string")
    assert sorted((r.kind, r.dieu) for r in jobs.build_corpus(laws, procs).collect()) == [("article", "1"), ("article", "2"), ("article", "3a"), ("procedure", "1.1")]

import json

import pytest
from pyspark.sql import functions as F

from lumiscript import schemas
from lumiscript.operators import retrieval
from lumiscript.plans import jobs
from lumiscript.sources import files
from lumiscript.streaming import signals


def test_jsonl(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"unit_id":"L::dieu-1","doc_id":"L","dieu":"1","title":"Tên","text":"chữ","khoan":[{"khoan":"1","text":"một","diem":[]}],"bienbao":[]}\n\nnot json\n', encoding="utf-8")
    df = files.read_articles(spark, str(p))
    assert [r.unit_id for r in df.collect()] == ["L::dieu-1"] and df.first().khoan[0].text == "một"
    out = str(tmp_path / "out")
    files.write_jsonl(df, out)
    assert files.read_articles(spark, out).collect() == df.collect()
    q = tmp_path / "m.jsonl"
    q.write_text('{"id":"s-1","question":"?","choices":["A. một","B. hai"],"answer":"A"}\n{"id":"s-2","question":"?","A":"x","answer":1}\n', encoding="utf-8")
    assert [r.choices for r in files.read_mcq(spark, str(q)).orderBy("id").collect()] == ["A. một\nB. hai", None]


def test_texts_and_config(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "luat.txt").write_text("Điều 1. A\nnội dung", encoding="utf-8")
    config = spark.createDataFrame([("luat.txt", "Luật 1")], "file string, doc_id string")
    rows = files.read_texts(spark, str(tmp_path / "t"), config).collect()
    assert [(r.doc_id, r.text) for r in rows] == [("Luật 1", "Điều 1. A\nnội dung")]


def test_yaml(spark, tmp_path):
    pytest.importorskip("yaml")
    p = tmp_path / "c.yaml"
    p.write_text("docs:\n  - {doc_id: L, format: law}\n  - {doc_id: T, n: 5}\n", encoding="utf-8")
    assert sorted((r.doc_id, r.n) for r in files.read_yaml_rows(spark, str(p), "docs").collect()) == [("L", None), ("T", "5")]


def tree(base):
    def put(path, text):
        p = base / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text, encoding="utf-8")

    for tag, acc, oks in (("m@bf16", 0.6, (1, 1, 0)), ("m@int8", 0.5, (1, 0, 0))):
        put(f"{tag}/inner__path/results_1.json", json.dumps({"results": {"task": {"acc,none": acc, "alias": "x"}}}))
        put(f"{tag}/inner__path/samples_1.jsonl", "\n".join(json.dumps({"doc_id": i, "acc": a}) for i, a in enumerate(oks)) + "\nbroken\n" + json.dumps({"doc_id": 8, "filtered_resps": ["x"]}) + "\n" + json.dumps({"doc_id": 9}))
        put(f"{tag}/hardware.json", json.dumps({"runner": "hf", "gpu": "L4" if tag == "m@bf16" else "T4", "sm": "8.9"}))
    put("m@bf16/inner__path/results_0.json", "{broken")


def test_result_tree(spark, tmp_path):
    tree(tmp_path)
    base = str(tmp_path)
    got = {(r.model_tag, r.metric): r.value for r in files.read_results(spark, base).collect()}
    assert got == {("m@bf16", "acc,none"): 0.6, ("m@int8", "acc,none"): 0.5}
    s = files.read_samples(spark, base)
    assert sorted((r.model_tag, r.item, r.ok) for r in s.collect())[:4] == [("m@bf16", "0", True), ("m@bf16", "1", True), ("m@bf16", "2", False), ("m@bf16", "9", False)]
    table, tests = jobs.evaluation_table(files.read_results(spark, base), s)
    row = {r.precision: r for r in table.collect()}["int8"]
    assert row.delta_abs == pytest.approx(-0.1) and not row.at_floor
    assert tests.first().flip_down == 1
    hw = files.read_hardware(spark, base).withColumn("machine", files.machine_key()).withColumn("model", F.split_part("model_tag", F.lit("@"), F.lit(1))).withColumn("precision", F.split_part("model_tag", F.lit("@"), F.lit(2)))
    from lumiscript.operators.stats import mixed_machines

    assert mixed_machines(hw).first().n_machines == 2


def test_resume_log_reports(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (1, "b")], "id int, tag string")
    sink = spark.createDataFrame([(1, "a")], "id int, tag string")
    assert sorted(map(tuple, files.missing_from(rows, sink, ["id", "tag"]).collect())) == [(1, "b"), (2, "a")]
    log = str(tmp_path / "log")
    files.append_log(sink, log)
    files.append_log(sink, log)
    assert spark.read.json(log).count() == 2
    assert files.markdown(sink) == "| id | tag |\n|---|---|\n| 1 | a |"
    files.write_report(sink, str(tmp_path / "r.json"))
    assert json.loads((tmp_path / "r.json").read_text()) == [{"id": 1, "tag": "a"}]
    (tmp_path / "q_1.jsonl").write_text('{"id":"1"}\n')
    (tmp_path / "q_out.jsonl").write_text('{"id":"2"}\n')
    assert [r.id for r in files.read_matching(spark, str(tmp_path / "q_*.jsonl"), "id string", "q_out.jsonl").collect()] == ["1"]


def test_index_round_trip(spark, tmp_path):
    units = spark.createDataFrame([("a", "xe máy"), ("b", "ô tô")], "unit_id string, text string")
    index = retrieval.lexical_index(units)
    files.write_index(index, str(tmp_path / "i"))
    q = spark.createDataFrame([(1, "xe")], "query_id int, text string")
    assert retrieval.lexical_search(files.read_index(spark, str(tmp_path / "i")), q).collect() == retrieval.lexical_search(index, q).collect()


def test_stream(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    rows = [{"id": str(i), "tag": "m@x", "prompt": "?", "output": t, "finish_reason": "stop", "generated_at": f"2030-01-01T0{i}:00:00"} for i, t in enumerate(["xong câu này.", "chưa xong", "中文。"])]
    (src / "a.json").write_text("\n".join(json.dumps(r, ensure_ascii=False) for r in rows), encoding="utf-8")
    flagged = signals.flagged_stream(signals.generation_stream(spark, str(src))).select("id", "tag", "generated_at", "E1", "E2", "E5", "E6")
    signals.write_stream(flagged, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    got = {r.id: (r.E5, r.E6) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {"0": (False, False), "1": (False, True), "2": (True, True)}
    q = signals.windowed_rates(flagged).writeStream.outputMode("complete").format("memory").queryName("rates").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("rates").count() == 3


def test_schemas_parse(spark):
    for name in ("ARTICLES", "PROCEDURES", "QA_ITEMS", "MCQ_ITEMS", "GENERATIONS", "LABELS", "AMENDMENTS", "RUNS"):
        assert spark.createDataFrame([], getattr(schemas, name)).count() == 0

"""Schemas of the raw, intermediate and result tables; sources declare them and never infer."""

from __future__ import annotations

POINT = "struct<diem:string,text:string>"
CLAUSE = f"struct<khoan:string,text:string,diem:array<{POINT}>>"
CITATION_REF = "struct<doc:string,dieu:string,khoan:string,diem:string>"

ARTICLES = f"unit_id string, doc_id string, dieu string, title string, text string, khoan array<{CLAUSE}>, bienbao array<string>"
PROCEDURES = "unit_id string, doc_id string, ma string, ten string, text string"
QA_ITEMS = f"id string, question string, answer_reference string, citations array<{CITATION_REF}>, question_type string, difficulty string, source_of_question string, annotator_a string, annotator_b string, resolved boolean, notes string"
MCQ_ITEMS = "id string, question string, choices string, A string, B string, C string, D string, E string, answer string, subject string"
PROBES = "id string, prompt string"
GENERATIONS = "id string, prompt string, output string, finish_reason string"
LABELS = "id string, tag string, annotator string, labels map<string,boolean>, note string"
AMENDMENTS = "source_doc string, source_dieu string, target_doc string, target_dieu string, title string, text string, effective_date string, khoan array<string>, diem array<string>, target_unit_id string"
RUNS = "query_id string, unit_id string, score double, rank int"
SAMPLES = "doc_id string, acc double, exact_match double, filtered_resps string"

"""SQL for ``more_queries``."""

from __future__ import annotations

from lumiscript.oracle import CITES, CODES, DENSE, ERFC, FLAGS, JUDGED, LABELS, MERGED, ONCE_ART, ONCE_GEN, ONCE_PROC, ONCE_QA, PAIRS, SEED, SPACE, SQL, SYLLABLE, WORD, fold, glue, lexical, ratio, strip, truncated, words

NL = "chr(10)"
MCQ = f"""m AS (SELECT item_id, subject, list_filter(string_split(text, {NL}), lambda x: regexp_matches(x, '^[A-E]\\. ')) AS l, array_to_string(list_filter(string_split(text, {NL}), lambda x: NOT regexp_matches(x, '^[A-E]\\. ')), {NL}) AS q,
 ['A', 'b', 'C', '2', '-1', '', 'D'][item_id % 7 + 1] AS answer FROM eval_items WHERE suite = 'mcq'), c AS (SELECT *, list_transform(l, lambda x: trim(regexp_replace(x, '^[A-E][.)]\\s*', ''))) AS c FROM m)"""
TAGS = f"t AS (SELECT tag, count(*) AS n, max(gen_id) AS last FROM {ONCE_GEN} GROUP BY tag)"
#: The articles of each document as pieces of its text: a line that is a head begins one.
PIECES = r"""l AS (SELECT *, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS ln FROM src), h AS (SELECT *, regexp_matches(line, '{head}') AS head FROM l),
 a AS (SELECT *, sum(CAST(head AS INT)) OVER (PARTITION BY key ORDER BY ln) AS art FROM h), p AS (SELECT key, art, string_agg(line, chr(10) ORDER BY ln) || CASE WHEN art < max(art) OVER (PARTITION BY key) THEN chr(10) ELSE '' END AS p FROM a WHERE art > 0 GROUP BY key, art)"""
ARTICLE = r"^\s*Điều\s+(\d+[a-zA-Z]?)\s*[.．:]?\s*(.*)"
AMENDING = r"^\s*Điều\s+(\d+[a-zA-Z]?)\s*[.．:]\s*(.*)"
AMENDED = r"""WITH src AS (SELECT 'doc-' || doc_id AS key, law_ref, strftime(published_at, '%Y-%m-%d') AS d, CASE WHEN doc_id % 2 = 0 THEN regexp_replace(text, '(?m)^Điều (\d+)\.$', 'Điều \1. Sửa đổi khoản 2, điểm a khoản 11 và khoản 3 Điều \1 về hồ sơ', 'g')
 ELSE regexp_replace(text, '(?m)^Điều (\d+)\.$', 'Điều \1. Bổ sung một số điều', 'g') END AS text FROM documents WHERE law_ref IS NOT NULL AND text IS NOT NULL), """ + PIECES.format(head=r"^\s*Điều\s+\d+[a-zA-Z]?\s*[.．:]") + rf""",
 r AS (SELECT key, regexp_extract(p, '{AMENDING}', 1) AS dieu, {strip(f"regexp_extract(p, '{AMENDING}', 2)")} AS title, substr(p, length(regexp_extract(p, '{AMENDING}', 0)) + 1) AS body FROM p WHERE regexp_matches(p, '{AMENDING}')),
 s AS (SELECT *, regexp_extract_all(title, 'Điều\s+(\d+[a-zA-Z]?)', 1) AS own, list_distinct(regexp_extract_all(regexp_replace(regexp_replace(body, '"[^"]*"|“[^”]*”', ' ', 'g'), '(?i)Điều\s+này', '', 'g'), 'Điều\s+(\d+[a-zA-Z]?)', 1)) AS refs
  FROM r WHERE list_bool_or(list_transform(['sửa đổi', 'bổ sung', 'thay thế', 'bãi bỏ', 'bỏ cụm từ'], lambda w: contains(lower(title), w)))),
 t AS (SELECT *, unnest(CASE WHEN len(own) > 0 THEN [own[len(own)]] ELSE refs END) AS target FROM s),
 am AS (SELECT t.key AS source_doc, dieu AS source_dieu, target AS target_dieu, law_ref || '::dieu-' || target AS target_unit_id, title, length({strip(f"regexp_replace(title || {NL} || body, '{chr(92)}n{{3,}}', {NL} || {NL}, 'g')")}) AS n_chars,
  array_to_string(list_transform(list_sort(list_transform(list_distinct(regexp_extract_all(title, '(?i)khoản\s+(\d+[a-zA-Z]?)', 1)), lambda x: {{'n': length(x), 'x': x}})), lambda z: z.x), ',') AS khoan,
  array_to_string(list_sort(list_distinct(regexp_extract_all(title, '(?i)điểm\s+([a-zđ]\d?)(?:[^\p{{L}}\p{{N}}_]|$)', 1))), ',') AS diem FROM t JOIN src ON src.key = t.key)"""
TONES = f"""w AS (SELECT unnest({words('lower(text)')}) AS surface FROM {ONCE_ART}), lx AS (SELECT {fold('surface')} AS folded, surface, count(*) AS cnt FROM w GROUP BY ALL),
 su AS (SELECT folded AS token FROM lx GROUP BY folded HAVING bool_or(surface <> folded) AND coalesce(max(cnt) FILTER (surface = folded), 0) < 2),
 tw AS (SELECT gen_id, unnest({words('output')}) AS word FROM {ONCE_GEN}), tn AS (SELECT gen_id, count(*) AS n_tone FROM tw JOIN su ON lower(word) = token GROUP BY gen_id)"""
KNOWN = """i AS (SELECT 'doc' AS kind, lower(regexp_replace(trim(doc_id), '\\s+', ' ', 'g')) AS value FROM articles WHERE doc_id <> '' UNION SELECT 'dieu', lower(trim(dieu)) FROM articles WHERE dieu <> '' UNION SELECT 'bienbao', upper(x) FROM (SELECT unnest(bienbao) AS x FROM articles)),
 v AS (SELECT gen_id, i.value IS NOT NULL OR c.kind NOT IN (SELECT kind FROM i) AS known FROM c LEFT JOIN i ON c.kind = i.kind AND CASE WHEN c.kind = 'bienbao' THEN upper(c.value) ELSE c.value END = i.value WHERE c.kind IN ('doc', 'dieu', 'bienbao')),
 ci AS (SELECT gen_id, count(*) AS n_citations, count(*) FILTER (NOT known) AS n_unknown FROM v GROUP BY gen_id)"""
PROBE = f"""{CITES}, {KNOWN}, {TONES}, f AS (SELECT f.*, g.id, coalesce(n_tone, 0) AS n_tone, coalesce(n_citations, 0) AS n_citations, coalesce(n_unknown, 0) AS n_unknown, split_part(f.tag, '@', 1) AS model FROM ({FLAGS}) f JOIN {ONCE_GEN} g ON f.gen_id = g.gen_id LEFT JOIN tn ON tn.gen_id = f.gen_id LEFT JOIN ci ON ci.gen_id = f.gen_id),
 rf AS (SELECT id, model, max(d) AS ref_ratio FROM f WHERE regexp_extract(tag, '@(.*)$', 1) = 'bf16' GROUP BY ALL),
 pr AS (SELECT f.id, f.tag, n_tone, n_citations, n_unknown, ref_ratio, E1, n_tone >= 2 OR E2 OR coalesce((ref_ratio - d) / nullif(ref_ratio, 0) >= 0.25, false) AS E2, n_unknown > 0 AS E3, false AS E4, E5, E6 FROM f LEFT JOIN rf ON f.id = rf.id AND f.model = rf.model)"""
AMENDS = "am AS (SELECT 'doc-' || doc_id AS source_doc, law_ref || '::dieu-' || (doc_id % 40 + 1) AS target, text, strftime(published_at, '%Y-%m-%d') AS d FROM documents WHERE law_ref IS NOT NULL)"


def amended_context(name: str, run: str, day: str, budget: int) -> str:
    """CTEs that end in ``name``(query_id, n_units, context)."""
    return f"""{name}_b AS (SELECT target, string_agg(concat_ws({NL}, '[SỬA ĐỔI bởi ' || source_doc || ' Điều 1' || CASE WHEN coalesce(d, '') <> '' THEN ', hiệu lực từ ' || d ELSE '' END || ']', text), {NL} || {NL} ORDER BY source_doc) AS b FROM am WHERE coalesce(d, '') = '' OR d <= '{day}' GROUP BY target),
 {name}_u AS (SELECT unit_id, text || coalesce({NL} || {NL} || b, '') AS chunk FROM {ONCE_ART} u LEFT JOIN {name}_b ON target = unit_id WHERE text IS NOT NULL AND text <> ''),
 {name}_t AS (SELECT query_id, rank, chunk, sum(length(chunk)) OVER (PARTITION BY query_id ORDER BY rank) AS total FROM {run} JOIN {name}_u USING (unit_id)),
 {name} AS (SELECT query_id, count(*) AS n_units, string_agg(chunk, {NL} || {NL} || '---' || {NL} || {NL} ORDER BY rank) AS context FROM {name}_t WHERE total <= {budget} GROUP BY query_id)"""


def variant(name: str, least: int, most: int, drop: float) -> str:
    return f"""SELECT '{name}' AS variant, count(*) AS n_queries, avg(p) AS precision, avg(r) AS recall, avg(coalesce(5 * p * r / nullif(4 * p + r, 0), 0)) AS f_beta, avg(CAST(n_got AS DOUBLE)) AS mean_k FROM (
 SELECT coalesce(g.query_id, k.query_id) AS query_id, count(k.unit_id) AS n_got, coalesce(count(*) FILTER (g.unit_id IS NOT NULL AND k.unit_id IS NOT NULL) / CAST(nullif(count(k.unit_id), 0) AS DOUBLE), 0) AS p, coalesce(count(*) FILTER (g.unit_id IS NOT NULL AND k.unit_id IS NOT NULL) / CAST(nullif(count(g.query_id), 0) AS DOUBLE), 0) AS r
 FROM gold g FULL JOIN (SELECT DISTINCT query_id, unit_id FROM best WHERE rank <= {most} AND (rank <= {least} OR score / top >= {drop})) k ON g.query_id = k.query_id AND g.unit_id = k.unit_id GROUP BY 1)"""


LETTERS = "[" + ", ".join(f"CAST(length({{t}}) - length(replace({{t}}, '{c}', '')) AS DOUBLE)" for c in "nhtgci") + "]"
NAVIGATION = "|".join((
    r"(?:Toàn văn|Thuộc tính|Lịch sử|VB liên quan|Lược đồ|Bản PDF|Tải về|Bản in|Xem nhanh)\s*", r"CSDL\s*(?:quốc gia|Bộ|Trung ương).*", r"(?:Văn bản pháp luật|CƠ SỞ DỮ LIỆU QUỐC GIA VỀ VĂN BẢN PHÁP LUẬT)\s*»?\s*",
    r"(?:Hiệu lực|Ngày có hiệu lực|Ngày ban hành|Người ký|Cơ quan ban hành|Loại văn bản|Số hiệu)\s*:.*", r"(?:Mở|Đóng) tất cả các khối.*", r"(?:Quốc hội|Chính phủ|Thủ tướng Chính phủ|Các Bộ, cơ quan ngang Bộ|Các cơ quan khác)\s*",
    r"(?:Hiến pháp|Bộ luật|Pháp lệnh|Lệnh|Nghị quyết liên tịch|Thông tư liên tịch|Chỉ thị)\s*", r"\d{4}\s*đến\s*\d{4}\s*", r"(?:Năm ban hành|Loại văn bản)\s*", r"This div, which you should delete.*", r"(?:In trang|Chia sẻ|Gửi email|Lưu|Đánh giá).*",
))
SPLIT_WORD = lambda t, a, b, w: f"regexp_replace({t}, '(^|[^\\p{{L}}\\p{{N}}_]){a}{SPACE}+{b}($|[^\\p{{L}}\\p{{N}}_])', '\\1{w}\\2', 'g')"
PASTED = rf"""WITH t AS (SELECT unit_id, string_split(regexp_replace(replace(replace(text, chr(65279), ''), chr(160), ' '), '\r\n|\r', {NL}, 'g'), {NL}) AS l FROM {ONCE_PROC}), k AS (SELECT unit_id, l, list_filter(l, lambda x: NOT regexp_matches(x, '(?i)^\s*(?:{NAVIGATION})$')) AS k FROM t),
 j AS (SELECT unit_id, len(l) - len(k) AS n, array_to_string(list_transform(k, lambda x: regexp_replace(x, '{SPACE}+$', '')), {NL}) AS j FROM k), b AS (SELECT *, regexp_replace(j, '(?ims)^[ \t]*Nơi nhận[ \t]*:.*', '') AS b FROM j)
 SELECT unit_id, CAST(length({strip(SPLIT_WORD(SPLIT_WORD(f"regexp_replace(regexp_replace(regexp_replace(b, '(?m)^{chr(92)}s*{chr(92)}d{{1,4}}{chr(92)}s*$', '', 'g'), '[ {chr(92)}t]+', ' ', 'g'), '{chr(92)}n{{3,}}', {NL} || {NL}, 'g')", 'Đi', 'ều', 'Điều'), 'kho', 'ản', 'khoản'))}) AS BIGINT) AS n_chars, CAST(n AS BIGINT) AS nav_lines_dropped, CAST(length(j) - length(b) AS BIGINT) AS tail_chars_cut FROM b"""
QUOTAS = """RECURSIVE g AS (SELECT coalesce(source, 'UNKNOWN') AS s, count(*) AS n FROM documents GROUP BY 1), t AS (SELECT list(s ORDER BY s) AS s, list(n ORDER BY s) AS n, sum(n) AS total FROM g),
 steps AS (SELECT s, n, list_transform(n, lambda x: CAST(least(x, greatest(5, least(x, round_even(300 * x / CAST(total AS DOUBLE), 0)))) AS BIGINT)) AS q FROM t UNION ALL
  SELECT s, n, CASE WHEN list_sum(q) > 300 THEN list_transform(q, lambda x, i: x - CASE WHEN i = list_position(list_transform(q, lambda y, j: CASE WHEN y > least(5, n[j]) THEN y ELSE -1 END), list_max(list_transform(q, lambda y, j: CASE WHEN y > least(5, n[j]) THEN y ELSE -1 END))) THEN 1 ELSE 0 END)
   ELSE list_transform(q, lambda x, i: x + CASE WHEN i = list_position(list_transform(q, lambda y, j: CASE WHEN y < n[j] THEN y / CAST(n[j] AS DOUBLE) ELSE 9 END), list_min(list_transform(q, lambda y, j: CASE WHEN y < n[j] THEN y / CAST(n[j] AS DOUBLE) ELSE 9 END))) THEN 1 ELSE 0 END) END AS q FROM steps WHERE list_sum(q) <> 300),
 quota AS (SELECT unnest(s) AS s, unnest(n) AS n, unnest(q) AS q FROM steps WHERE list_sum(q) = 300)"""
GLUED = r"regexp_replace(regexp_replace(text, '(\p{L}) (\p{L})', '\1\2', 'g'), '(\p{L}) (\p{L})', '\1\2', 'g')"
MIX = SQL["calibration_mix"].replace("SELECT doc_id, source FROM r, x", "SELECT doc_id FROM r, x")
PLACE = "coalesce(nullif(list_position(['bf16', 'w8a8', 'w4a16', 'q3'], coalesce(nullif(regexp_extract(tag, '@(.*)$', 1), ''), 'unknown')), 0), 99)"

MORE_SQL = {
    "jsonl_articles": f"SELECT unit_id, doc_id, dieu, title, md5(text) AS digest, CAST(coalesce(len(khoan), 0) AS BIGINT) AS n_clauses, CAST(coalesce(len(bienbao), 0) AS BIGINT) AS n_signs FROM {ONCE_ART}",
    "jsonl_questions": f"SELECT id, question, difficulty, resolved, citations[1].doc AS first_doc FROM {ONCE_QA}",
    "jsonl_mcq": f"""WITH {MCQ} SELECT 'mcq-' || item_id AS id, subject, CAST(len(c) AS BIGINT) AS n_choices, c[1] AS first_choice, CAST(CASE answer WHEN 'A' THEN 0 WHEN 'b' THEN 1 WHEN 'C' THEN 2 WHEN '2' THEN 2 WHEN 'D' THEN 3 END AS BIGINT) AS answer,
 md5('Câu hỏi: ' || trim(q) || {NL} || array_to_string(list_transform(c, lambda x, i: ['A', 'B', 'C', 'D', 'E'][i] || '. ' || x), {NL}) || {NL} || 'Đáp án:') AS prompt FROM c""",
    "mcq_subjects": "SELECT 'mcq' AS subject, count(*) AS n FROM eval_items WHERE suite = 'mcq'",
    "mcq_answerable": "SELECT subject AS split, count(*) AS n, count(*) FILTER (item_id % 7 NOT IN (4, 5)) AS n_answered FROM eval_items WHERE suite = 'mcq' GROUP BY subject",
    "whole_texts": f"SELECT replace(doc_id, '/', '_') || '.txt' AS file, 'procedure' AS kind, CAST(sum(length(text) + 1) AS BIGINT) AS n_chars FROM {ONCE_PROC} WHERE text IS NOT NULL GROUP BY doc_id",
    "yaml_settings": """SELECT 'Luật 1' AS doc_id, 'a.txt' AS file, '3' AS pages, NULL AS tags UNION ALL SELECT 'Luật 2', 'b.txt', NULL, '["x", "y"]'""",
    "result_tree": f"WITH {TAGS} SELECT tag AS model_tag, 'probe' AS task, 'n,none' AS metric, CAST(n AS DOUBLE) AS value FROM t UNION ALL SELECT tag, 'probe', 'last,none', CAST(last AS DOUBLE) FROM t",
    "sample_files": f"SELECT tag AS model_tag, CAST(gen_id AS VARCHAR) AS item, CASE WHEN gen_id % 4 IN (0, 1) THEN NOT {truncated(chr(99) + 'oalesce(output, ' + chr(39) * 2 + ')')} ELSE false END AS ok FROM {ONCE_GEN} WHERE gen_id % 4 <> 3",
    "hardware_files": f"WITH {TAGS} SELECT tag AS model_tag, CASE length(tag) % 3 WHEN 0 THEN 'unknown' WHEN 1 THEN 'r/g1/sm89' ELSE '?/cpu/sm?' END AS machine FROM t",
    "run_log": f"WITH {TAGS}, s AS (SELECT unnest(['first', 'second']) AS stage) SELECT stage, count(*) AS n_rows, CAST(sum(n) AS BIGINT) AS n FROM t, s GROUP BY stage",
    "json_report": f"WITH {TAGS} SELECT tag, n FROM t",
    "markdown_report": f"""WITH e AS ({SQL['error_distribution']}), r AS (SELECT *, row_number() OVER (ORDER BY split_part(tag, '@', 1), {PLACE}, tag) AS k FROM e)
 SELECT CAST(0 AS BIGINT) AS no, '| tag | n | {" | ".join(CODES)} |' AS line UNION ALL SELECT 1, '|{"---|" * (len(CODES) + 2)}' UNION ALL SELECT k + 1, '| ' || concat_ws(' | ', tag, n, {", ".join(CODES)}) || ' |' FROM r""",
    "stored_index": SQL["bm25_topk"],
    "label_files": "SELECT 'labels_' || length(id) % 2 || '_' || length(tag) % 2 || '.jsonl' AS file, count(*) AS n, count(DISTINCT tag) AS n_tags FROM labels WHERE labels IS NOT NULL AND (length(id) % 2 = 1 OR length(tag) % 2 = 1) GROUP BY 1",
    "demojibake_text": f"""WITH t AS (SELECT gen_id, output FROM {ONCE_GEN} WHERE output IS NOT NULL), u AS (SELECT gen_id, output, try(decode(unhex(array_to_string(list_transform(string_split(output, ''), lambda c: printf('%02x', unicode(c))), '')))) AS fixed FROM t WHERE gen_id % 2 = 1 AND regexp_matches(output, '^[\\x{{0}}-\\x{{FF}}]+$'))
 SELECT gen_id, md5(output) AS digest FROM t WHERE gen_id % 2 = 0 AND regexp_matches(output, '[^\\x{{0}}-\\x{{7F}}]') UNION ALL SELECT gen_id, md5(fixed) FROM u WHERE fixed <> output""",
    "secret_masks": f"SELECT id, CASE WHEN length(coalesce(notes, id)) > 12 THEN left(coalesce(notes, id), 6) || '...' || right(coalesce(notes, id), 4) || ' (' || length(coalesce(notes, id)) || ')' ELSE '*** (' || length(coalesce(notes, id)) || ')' END AS masked FROM {ONCE_QA}",
    "syllable_vocabulary": f"SELECT syllable, CAST(length(syllable) AS BIGINT) AS n_chars FROM (SELECT DISTINCT syllable FROM (SELECT unnest({words('lower(text)')}) AS syllable FROM {ONCE_ART}) WHERE length(syllable) <= 7 AND regexp_matches(syllable, '{SYLLABLE}') UNION SELECT unnest(['nghiêng', 'đường']))",
    "article_units": f"SELECT split_part(unit_id, '::khoan-', 1) AS article, count(*) AS n FROM ({SQL['retrieval_units']}) GROUP BY 1",
    "corpus_units": f"""SELECT unit_id, md5({strip("doc_id || ' — Điều ' || dieu || '. ' || coalesce(title, '') || chr(10) || coalesce(text, '')")}) AS digest FROM {ONCE_ART} UNION ALL SELECT unit_id, md5({strip("doc_id || ' — Thủ tục ' || ma || ': ' || coalesce(ten, '') || chr(10) || coalesce(text, '')")}) FROM {ONCE_PROC}""",
    "choice_of_extraction": f"""WITH a AS (SELECT text, {GLUED} AS g FROM {ONCE_ART} WHERE text IS NOT NULL), b AS (SELECT {glue('text')} AS ga, {glue('g')} AS gb, length(text) AS la, length(g) AS lb FROM a WHERE text <> g)
 SELECT CASE WHEN ga <= gb THEN 'a' ELSE 'b' END AS least_glued, CASE WHEN la >= lb THEN 'a' ELSE 'b' END AS longest, count(*) AS n FROM b GROUP BY ALL""",
    "parsed_articles": "WITH src AS (SELECT doc_id AS key, text FROM documents WHERE text IS NOT NULL), " + PIECES.format(head=r"^\s*Điều\s+\d") + rf""", r AS (SELECT *, substr(p, length(regexp_extract(p, '{ARTICLE}', 0)) + 1) AS b FROM p)
 SELECT key AS doc_id, CAST(art - 1 AS BIGINT) AS ord, regexp_extract(p, '{ARTICLE}', 1) AS dieu, {strip(f"regexp_extract(p, '{ARTICLE}', 2)")} AS title, md5(regexp_replace({strip('b')}, '{SPACE}+', ' ', 'g')) AS digest,
 nullif(regexp_extract(list_filter(list_transform(string_split(b, {NL}), lambda x: {strip('x')}), lambda x: regexp_matches(x, '^\d+[ \t]*[.．)][ \t]+\S'))[1], '^(\d+)', 1), '') AS first_clause FROM r""",
    "parsed_procedures": SQL["parse_procedures"].replace("CAST(length(", "md5(", 1).replace(") AS BIGINT) AS n_chars", ") AS digest", 1),
    "parsed_amendments": AMENDED + " SELECT source_doc, source_dieu, target_dieu, target_unit_id, title, CAST(n_chars AS BIGINT) AS n_chars, khoan, diem FROM am",
    "amendment_summary": AMENDED + " SELECT count(*) AS n_amendments, count(DISTINCT target_unit_id) AS n_targets FROM am",
    "amended_units": "SELECT law_ref || '::dieu-' || (doc_id % 40 + 1) AS target_unit_id, count(*) AS n FROM documents WHERE law_ref IS NOT NULL GROUP BY 1",
    "corpus_build": f"SELECT 'article' AS kind, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM ({SQL['parse_articles']}) UNION ALL SELECT 'procedure', count(*), count(DISTINCT unit_id) FROM ({SQL['parse_procedures']})",
    "corpus_expected": f"SELECT doc_id, count(*) AS n_articles, CAST(count(DISTINCT dieu) + length(doc_id) % 2 AS BIGINT) AS n_expected, length(doc_id) % 2 = 0 AS ok FROM {ONCE_ART} GROUP BY doc_id",
    "probe_flags": PROBE + " SELECT id, tag, n_tone, n_citations, n_unknown, round(ref_ratio, 6) AS ref_ratio, E1, E2, E3, E4, E5, E6 FROM pr",
    "probe_rates": PROBE + f" SELECT tag, count(*) AS n, {', '.join(f'round(100 * avg(CAST({c} AS DOUBLE)), 4) AS pct_{c.lower()}' for c in CODES)} FROM pr GROUP BY tag",
    "machine_calibration": PROBE + f""", tr AS ({' UNION ALL '.join(f"SELECT tag, id, '{c}' AS code, {c} AS label FROM ({MERGED})" for c in CODES)}), mc AS ({' UNION ALL '.join(f"SELECT tag, id, '{c}' AS code, {c} AS flag FROM pr" for c in CODES)}),
 g AS (SELECT tr.code, count(*) FILTER (label AND coalesce(flag, false)) AS tp, count(*) FILTER (NOT label AND coalesce(flag, false)) AS fp, count(*) FILTER (label AND NOT coalesce(flag, false)) AS fn FROM tr LEFT JOIN mc ON tr.tag = mc.tag AND tr.id = mc.id AND tr.code = mc.code GROUP BY tr.code)
 SELECT code, tp, fp, fn, round(tp / CAST(nullif(tp + fp, 0) AS DOUBLE), 6) AS precision, round(tp / CAST(nullif(tp + fn, 0) AS DOUBLE), 6) AS recall FROM g""",
    "review_queue_full": PROBE + f""", f2 AS (SELECT pr.*, CASE WHEN E1 THEN 'E1' WHEN E2 THEN 'E2' WHEN E3 THEN 'E3' WHEN E5 THEN 'E5' WHEN E6 THEN 'E6' ELSE 'none' END AS stratum, md5('{SEED}|' || pr.id || '|' || pr.tag) AS draw FROM pr JOIN f ON pr.id = f.id AND pr.tag = f.tag WHERE E1 OR pr.E2 OR E3 OR E5 OR E6 OR n_terms > 0),
 k AS (SELECT *, row_number() OVER (PARTITION BY tag, stratum ORDER BY draw, id, tag) AS rn FROM f2) SELECT id, tag, stratum FROM k WHERE rn <= 8 ORDER BY draw, id, tag LIMIT 250""".replace("WHERE E1 OR pr.E2 OR E3 OR E5 OR E6", "WHERE pr.E1 OR pr.E2 OR pr.E3 OR pr.E5 OR pr.E6").replace("CASE WHEN E1 THEN 'E1' WHEN E2 THEN 'E2' WHEN E3 THEN 'E3' WHEN E5 THEN 'E5' WHEN E6", "CASE WHEN pr.E1 THEN 'E1' WHEN pr.E2 THEN 'E2' WHEN pr.E3 THEN 'E3' WHEN pr.E5 THEN 'E5' WHEN pr.E6"),
    "hybrid_retrieval": f"""WITH {lexical('text', 'r', 30)}, {lexical('title', 's', 30)}, f AS (SELECT query_id, unit_id, sum(1.0 / (60 + rank)) AS score, min(run * 1000 + rank) AS seen FROM (SELECT 0 AS run, * FROM r UNION ALL SELECT 1, * FROM s) GROUP BY ALL),
 k AS (SELECT query_id, unit_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, seen) AS INT) AS rank, max(score) OVER (PARTITION BY query_id) AS best FROM f) SELECT query_id, unit_id, round(score, 9) AS score, rank FROM k WHERE rank <= 10 AND (rank <= 1 OR score / best >= 0.55)""",
    "encoded_search": f"""WITH q AS (SELECT item_id AS query_id, {LETTERS.format(t='text')} AS e FROM eval_items WHERE item_id % 100 = 0), x AS (SELECT unit_id, {LETTERS.format(t='text')} AS e FROM {ONCE_ART} WHERE text IS NOT NULL),
 s AS (SELECT query_id, unit_id, CASE WHEN list_sum(x.e) = 0 THEN 0.0 ELSE list_cosine_similarity(q.e, x.e) END AS score FROM q, x) SELECT query_id, unit_id, round(score, 5) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, unit_id) AS rank FROM s) WHERE rank <= 10""",
    "question_retrieval": f"""WITH qq AS (SELECT * FROM {ONCE_QA} WHERE question IS NOT NULL AND len(citations) > 0 AND TRY_CAST(regexp_extract(id, '([0-9]+)$', 1) AS BIGINT) % 100 = 0), {lexical('text', 'r', 30).replace('SELECT item_id AS query_id', 'SELECT id AS query_id').replace(f"unnest({chr(108)}ist_concat", "unnest(list_concat").replace('FROM eval_items WHERE item_id % 100 = 0', 'FROM (SELECT id, question AS text FROM qq)')},
 gold AS (SELECT DISTINCT id AS query_id, c.doc || '::dieu-' || c.dieu AS unit_id FROM (SELECT id, unnest(citations) AS c FROM qq)), best AS (SELECT *, max(score) OVER (PARTITION BY query_id) AS top FROM r),
 v AS ({variant('dynamic', 1, 10, 0.55)} UNION ALL {variant('top5', 5, 5, 0.0)} UNION ALL {variant('top10', 10, 10, 0.0)}) SELECT variant, n_queries, round(precision, 4) AS precision, round(recall, 4) AS recall, round(f_beta, 4) AS f_beta, round(mean_k, 4) AS mean_k FROM v""",
    "amended_context": f"WITH {lexical('text', 'r', 30)}, {AMENDS}, {amended_context('c', 'r', '2031-03-01', 60000)} SELECT query_id, n_units, md5(context) AS digest FROM c",
    "context_change": f"WITH {lexical('text', 'r', 10)}, {AMENDS}, {amended_context('b', 'r', '2031-02-01', 6000)}, {amended_context('c', 'r', '2031-09-01', 6000)} SELECT coalesce(b.query_id, c.query_id) AS query_id FROM b FULL JOIN c ON b.query_id = c.query_id WHERE b.context IS DISTINCT FROM c.context",
    "assistant_answers": f"""WITH {lexical('text', 'r', 30)}, k AS (SELECT * FROM (SELECT *, max(score) OVER (PARTITION BY query_id) AS best FROM r) WHERE rank <= 10 AND (rank <= 1 OR score / best >= 0.55)),
 x AS (SELECT query_id, rank, text, sum(length(text)) OVER (PARTITION BY query_id ORDER BY rank) AS total FROM k JOIN {ONCE_ART} a USING (unit_id) WHERE text IS NOT NULL AND text <> ''), c AS (SELECT query_id, string_agg(text, {NL} || {NL} ORDER BY rank) AS context FROM x WHERE total <= 6000 GROUP BY query_id),
 q AS (SELECT item_id AS query_id, regexp_extract('NGỮ CẢNH:' || {NL} || context || {NL} || {NL} || 'CÂU HỎI: ' || text, '(\\d+)', 1) AS no, context IS NULL AS missed FROM eval_items LEFT JOIN c ON item_id = query_id WHERE item_id % 100 = 0),
 v AS (SELECT query_id, CASE WHEN NOT missed THEN 'Theo Điều ' || no || ' thì làm như sau.' END AS answer, CASE WHEN missed THEN 'nothing found' WHEN no = '' THEN 'no citation' WHEN no NOT IN (SELECT lower(trim(dieu)) FROM articles WHERE dieu IS NOT NULL) THEN 'citations that don''t exist' END AS reason FROM q)
 SELECT query_id, answer, reason IS NOT NULL AS blocked, reason FROM v""",
    "evaluation_scores": f"""WITH g AS (SELECT model, precision, avg(CAST(ok AS INT)) AS value FROM ({JUDGED}) GROUP BY ALL), r AS (SELECT *, value - max(CASE WHEN precision = 'bf16' THEN value END) OVER (PARTITION BY model) AS delta, (value - 0.7) / sqrt(0.7 * (1 - 0.7) / 400) AS z FROM g),
 p AS (SELECT *, CASE WHEN z >= 0 THEN 0.5 * {ERFC.format(x="abs(z) / sqrt(2)")} ELSE 1 - 0.5 * {ERFC.format(x="abs(z) / sqrt(2)")} END AS p FROM r) SELECT model, precision, round(value, 6) AS value, round(delta, 6) AS delta_abs, round(z, 6) AS z, round(p, 6) AS p_floor, p >= 0.05 AS at_floor FROM p""",
    "matched_judgements": f"SELECT model, count(*) AS n, count(*) AS n_same FROM ({JUDGED}) WHERE precision = 'bf16' GROUP BY model",
    "agreement_table": f"SELECT code, n_items, ac1, true AS low_ok, true AS high_ok, interpretation FROM ({SQL['agreement_pairs']})",
    "flip_bounds": f"SELECT model, precision, n, flip_rate, true AS inside FROM ({SQL['flip_rates']})",
    "own_statistic_bounds": f"SELECT DISTINCT model, true AS ordered, true AS low_ok, true AS high_ok FROM ({SQL['flip_rates']})",
    "mix_summary": f"""WITH s AS (SELECT coalesce(source, 'none') AS source, length(text) AS len, {ratio('text')} AS d FROM documents WHERE doc_id IN ({MIX})), o AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY len NULLS FIRST) - 1 AS k, count(*) OVER (PARTITION BY source) AS n FROM s)
 SELECT source, count(*) AS n, CAST(max(CASE WHEN k = n // 2 THEN len END) AS BIGINT) AS chars_median, CAST(max(len) AS BIGINT) AS chars_max, round(avg(d), 4) AS diacritic_ratio_mean FROM o GROUP BY source""",
    "sample_coverage": f"WITH {QUOTAS} SELECT s AS stratum, n AS n_population, q AS n_sample, round(abs(n / CAST(sum(n) OVER () AS DOUBLE) - q / CAST(sum(q) OVER () AS DOUBLE)), 6) AS share_deviation FROM quota",
    "stratified_sample": f"WITH {QUOTAS} SELECT nullif(s, 'UNKNOWN') AS source, q AS n FROM quota",
    "clean_pasted": PASTED,
}

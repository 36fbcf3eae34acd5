"""SQL that DuckDB runs on the same tables, for each core query that SQL can express."""

from __future__ import annotations

import unicodedata

# Fixed values, written out here so that a wrong one in the operators shows.
CODES = ("E1", "E2", "E3", "E4", "E5", "E6")
SEED = 20260825
MARKED = "àáảãạăằắẳẵặâầấẩẫậèéẻẽẹêềếểễệìíỉĩịòóỏõọôồốổỗộơờớởỡợùúủũụưừứửữựỳýỷỹỵđ"
BROKEN_LEAD = "ÃÂÆÄÅÐÑ"
ENGLISH = ("the", "and", "of", "to", "in", "is", "are", "that", "this", "with", "for", "as", "was", "be", "have", "has", "you", "your", "which", "according", "therefore", "however", "please", "note", "answer", "question", "based", "following", "must", "should", "can", "will")
CONFUSED = ("cấp đổi", "cấp lại", "tạm giữ", "tước quyền sử dụng", "phạt tiền", "phạt bổ sung", "giấy phép lái xe", "giấy đăng ký xe", "đăng ký lần đầu", "đăng ký sang tên", "kiểm định", "đăng kiểm lại", "biển số định danh", "biển số trúng đấu giá")
ONSETS = ("nghi", "ngh", "ch", "gh", "gi", "kh", "ng", "nh", "ph", "qu", "th", "tr", "b", "c", "d", "đ", "g", "h", "k", "l", "m", "n", "p", "r", "s", "t", "v", "x")
VOWELS = "aàáảãạăằắẳẵặâầấẩẫậeèéẻẽẹêềếểễệiìíỉĩịoòóỏõọôồốổỗộơờớởỡợuùúủũụưừứửữựyỳýỷỹỵ"
CODAS = ("ch", "ng", "nh", "c", "m", "n", "p", "t")
COMBINING = "\u0300\u0301\u0303\u0309\u0323\u0302\u0306\u031b"


def unmarked(c: str) -> str:
    """A letter without the eight marks of Vietnamese."""
    left = "".join(x for x in unicodedata.normalize("NFD", c) if x not in COMBINING)
    return unicodedata.normalize("NFC", left).replace("đ", "d").replace("Đ", "D")


LETTERS = [c for c in map(chr, range(0xC0, 0x1F00)) if len(unmarked(c)) == 1 and unmarked(c) != c and unicodedata.normalize("NFC", c) == c]
ONCE_GEN = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY gen_id ORDER BY ingested_at) AS rn FROM generations) WHERE rn = 1)"
ONCE_ART = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY unit_id ORDER BY collected_at) AS rn FROM articles) WHERE rn = 1)"
ONCE_PROC = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY unit_id ORDER BY collected_at) AS rn FROM procedures) WHERE rn = 1)"
ONCE_QA = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY created_at) AS rn FROM qa_items) WHERE rn = 1)"
FOREIGN = r"[\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7AF}\x{0400}-\x{04FF}\x{0E00}-\x{0E7F}\x{0600}-\x{06FF}]"
WORD = r"[\p{L}\p{Nl}\p{No}]+"
SPACE = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
ENGLISH_LIST = ", ".join(f"'{w}'" for w in ENGLISH)


def words(t: str) -> str:
    return f"regexp_extract_all({t}, '{WORD}')"


def strip(t: str) -> str:
    return f"regexp_replace({t}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def ratio(t: str) -> str:
    return f"coalesce(length(regexp_replace({t}, '[^{MARKED}{MARKED.upper()}]', '', 'g')) / CAST(nullif(length(regexp_replace({t}, '\\P{{L}}', '', 'g')), 0) AS DOUBLE), CASE WHEN {t} IS NOT NULL THEN 0.0 END)"


def most(items: str) -> str:
    """The count of the most frequent element of a list."""
    return f"(SELECT max(n) FROM (SELECT count(*) AS n FROM unnest({items}) AS u(x) GROUP BY x))"


def ngram_repeat(t: str) -> str:
    k = words(f"lower({t})")
    grams = f"list_transform(range(1, len({k}) - 3), lambda i: array_to_string(({k})[i:i+4], ' '))"
    return f"CASE WHEN len({k}) >= 10 THEN {most(grams)} / CAST(len({k}) - 4 AS DOUBLE) ELSE 0.0 END"


def line_repeat(t: str) -> str:
    lines = f"list_filter(list_transform(string_split({t}, chr(10)), lambda x: {strip('x')}), lambda x: x <> '')"
    return f"CASE WHEN len({lines}) >= 5 THEN {most(lines)} / CAST(len({lines}) AS DOUBLE) ELSE 0.0 END"


def english_runs(t: str) -> str:
    kept = f"array_to_string(list_transform({words(t)}, lambda w: CASE WHEN lower(w) IN ({ENGLISH_LIST}) THEN lower(w) ELSE '|' END), ' ')"
    return f"len(list_filter(list_transform(string_split({kept}, '|'), lambda p: trim(p)), lambda p: p <> '' AND len(string_split(p, ' ')) >= 3))"


def truncated(t: str) -> str:
    r = f"regexp_replace({t}, '{SPACE}+$', '')"
    return f"({r} = '' OR right({r}, 1) NOT IN ('.', '!', '?', ':', ';', ')', '\"', '''', '”', '’', '…'))"


def fold(t: str) -> str:
    return f"lower(translate({t}, '{''.join(LETTERS) + COMBINING}', '{''.join(map(unmarked, LETTERS))}'))"


SYLLABLE = f"(?i)^(?:{'|'.join(ONSETS)})?[{VOWELS}]{{1,3}}(?:{'|'.join(CODAS)})?$"


def odd_words(t: str) -> str:
    return f"len(list_filter({words(t)}, lambda x: NOT (length(x) <= 7 AND regexp_matches(lower(x), '{SYLLABLE}'))))"


def glue(t: str) -> str:
    return f"CASE WHEN len({words(t)}) > 0 THEN {odd_words(t)} / CAST(len({words(t)}) AS DOUBLE) ELSE 0.0 END"


SIGNALS = f"""SELECT gen_id, tag, len({words('output')}) AS n_words, {ratio('output')} AS d, {ngram_repeat('output')} AS g, {line_repeat('output')} AS l,
 len(regexp_extract_all(output, '{FOREIGN}')) AS n_foreign, {english_runs('output')} AS n_runs, {truncated('output')} AS cut, coalesce(finish_reason = 'length', false) AS hit,
 len(list_filter([{', '.join(f"'{c}'" for c in CONFUSED)}], lambda p: contains(lower(output), p))) AS n_terms, output
 FROM {ONCE_GEN}"""
FLAGS = f"""SELECT *, coalesce(n_words > 0 AND d < 0.10, false) AS E2, coalesce(n_foreign > 0, false) OR coalesce(n_runs > 0, false) AS E5,
 coalesce(cut AND NOT hit, false) OR coalesce(n_words >= 40 AND g >= 0.15, false) OR coalesce(l >= 0.30, false) AS E6,
 coalesce(length(output) - length(replace(output, chr(65533), '')) > 0 OR regexp_matches(output, '[\\x{{0}}-\\x{{8}}\\x{{B}}\\x{{C}}\\x{{E}}-\\x{{1F}}\\x{{7F}}-\\x{{9F}}]') OR regexp_matches(output, '[{MARKED}{MARKED.upper()}{BROKEN_LEAD}][\\x{{A0}}-\\x{{BF}}]') OR regexp_matches(output, '[{BROKEN_LEAD}][\\x{{A0}}-\\x{{BF}}\\x{{80}}-\\x{{9F}}]'), false) AS E1
 FROM ({SIGNALS})"""
JUDGED = f"""SELECT id, split_part(tag, '@', 1) AS model, coalesce(nullif(regexp_extract(tag, '@(.*)$', 1), ''), 'unknown') AS precision,
 bool_or(NOT ({truncated('output')} OR {ngram_repeat('output')} >= 0.15)) AS ok,
 max(CASE WHEN {ngram_repeat('output')} >= 0.15 THEN 'B' WHEN {truncated('output')} THEN 'C' WHEN {ratio('output')} < 0.1 THEN 'D' ELSE 'A' END) AS pred
 FROM {ONCE_GEN} WHERE output IS NOT NULL GROUP BY ALL"""
PAIRS = f"""WITH j AS MATERIALIZED ({JUDGED}), p AS (SELECT c.id, c.model, c.precision, r.ok AS ref, c.ok AS cmp, r.pred AS ref_pred, c.pred AS cmp_pred
 FROM j c JOIN j r ON c.id = r.id AND c.model = r.model AND r.precision = 'bf16' WHERE c.precision <> 'bf16')"""
SIGN = r"(?:^|[^\p{L}\p{N}_])([PBWRISDE]\.\d{1,3}[a-z]?)(?:[^\p{L}\p{N}_]|$)"
SPLIT_WORD = lambda t, a, b, w: f"regexp_replace({t}, '(^|[^\\p{{L}}\\p{{N}}_]){a}{SPACE}+{b}($|[^\\p{{L}}\\p{{N}}_])', '\\1{w}\\2', 'g')"
#: erfc(x) of x >= 0 by the same series of positive terms.
ERFC = "(1 - least(1.0, 1.1283791670955126 * exp(-least({x}, 6.0) * least({x}, 6.0)) * list_sum(list_transform(range(0, 241), lambda n: exp(n * ln(2) + (2 * n + 1) * ln(greatest(least({x}, 6.0), 1e-300)) - (lgamma(2 * n + 2) - n * ln(2) - lgamma(n + 1)))))))"
TESTS = f"""{PAIRS}, g AS (SELECT model, precision, count(*) AS n, avg(CAST(ref AS INT)) AS acc_ref, avg(CAST(cmp AS INT)) AS acc, count(*) FILTER (ref AND NOT cmp) AS b, count(*) FILTER (cmp AND NOT ref) AS c FROM p GROUP BY ALL),
 s AS (SELECT *, b + c < 25 AS exact, CASE WHEN b + c < 25 THEN CAST(least(b, c) AS DOUBLE) ELSE pow(abs(b - c) - 1.0, 2) / (b + c) END AS statistic FROM g),
 t AS (SELECT *, CASE WHEN b + c = 0 THEN 1.0 WHEN exact THEN least(1.0, 2 * list_sum(list_transform(range(0, least(b, c) + 1), lambda i: exp(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) - (b + c) * ln(2))))) ELSE {ERFC.format(x="sqrt(statistic / 2)")} END AS p_value FROM s)"""
LABELS = "(SELECT * REPLACE (upper(trim(annotator)) AS annotator) FROM labels WHERE labels IS NOT NULL AND tag <> 'qa')"
MERGED = "SELECT tag, id, " + ", ".join(f"coalesce(bool_or(element_at(labels, '{c}')[1]), false) AS {c}" for c in CODES) + f" FROM {LABELS} GROUP BY tag, id"
TOKENS = lambda t: f"list_concat(list_transform({words(t)}, lambda x: lower(x)), list_filter(list_transform(list_transform({words(t)}, lambda x: lower(x)), lambda x: nullif({fold('x')}, x)), lambda x: x IS NOT NULL))"


def lexical(text: str, name: str, k: int) -> str:
    """CTEs that end in ``name``(query_id, unit_id, score, rank)."""
    return f"""{name}_u AS (SELECT unit_id, {TOKENS(f"coalesce({text}, '')")} AS t FROM {ONCE_ART}),
 {name}_w AS (SELECT unit_id, len(t) AS dl, unnest(t) AS term FROM {name}_u), {name}_p AS (SELECT unit_id, term, count(*) AS tf, any_value(dl) AS dl FROM {name}_w GROUP BY unit_id, term),
 {name}_d AS (SELECT term, count(*) AS df FROM {name}_p GROUP BY term), {name}_n AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM {name}_u),
 {name}_q AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT item_id AS query_id, unnest({TOKENS('text')}) AS term FROM eval_items WHERE item_id % 100 = 0) GROUP BY ALL),
 {name}_s AS (SELECT query_id, unit_id, sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.5) / (tf + 1.5 * (0.25 + 0.75 * dl / CASE WHEN avgdl > 0 THEN avgdl ELSE 1.0 END))) AS score FROM {name}_q JOIN {name}_d USING (term) JOIN {name}_p USING (term), {name}_n GROUP BY query_id, unit_id),
 {name} AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, unit_id) AS INT) AS rank FROM {name}_s WHERE score > 0) WHERE rank <= {k})"""


DENSE = """q AS (SELECT vec_id AS query_id, embedding AS e, label FROM embeddings WHERE vec_id % 100 = 0),
 s AS (SELECT query_id, vec_id AS unit_id, list_cosine_similarity(CAST(q.e AS DOUBLE[]), CAST(x.embedding AS DOUBLE[])) AS score, q.label AS ql, x.label AS xl FROM q, embeddings x),
 run AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, unit_id) AS rank FROM s) WHERE rank <= 10)"""
BLANK = lambda c: f"coalesce({strip(c)}, '') = ''"
WORD_END = r"(?:[^\p{L}\p{N}_]|$)"
CITES = r"""WITH t AS (SELECT gen_id, output FROM {gen} WHERE output IS NOT NULL),
 c AS (
  SELECT gen_id, 'doc' AS kind, lower(regexp_replace(regexp_extract(r, '(?i)(Nghị\s*định|Luật|Thông\s*tư|Quyết\s*định|QCVN)\s*(?:số\s*)?(\d+[/:]\d{{2,4}}(?:/[A-ZĐ0-9\-]+)?)$', 1), '\s+', ' ', 'g') || ' ' || regexp_extract(r, '(\d+[/:]\d{{2,4}}(?:/[^/]+)?)$', 1)) AS value
  FROM (SELECT gen_id, unnest(regexp_extract_all(output, '(?i)(?:^|[^\p{{L}}\p{{N}}_])((?:Nghị\s*định|Luật|Thông\s*tư|Quyết\s*định|QCVN)\s*(?:số\s*)?\d+[/:]\d{{2,4}}(?:/[A-ZĐ0-9\-]+)?)', 1)) AS r FROM t)
  UNION ALL SELECT gen_id, 'dieu', lower(unnest(regexp_extract_all(output, '(?i)(?:^|[^\p{{L}}\p{{N}}_])Điều{s}+(\d+[a-zA-Z]?)', 1))) FROM t
  UNION ALL SELECT gen_id, 'khoan', unnest(regexp_extract_all(output, '(?i)(?:^|[^\p{{L}}\p{{N}}_])khoản{s}+(\d+)', 1)) FROM t
  UNION ALL SELECT gen_id, 'diem', lower(unnest(regexp_extract_all(output, '(?i)(?:^|[^\p{{L}}\p{{N}}_])điểm{s}+([a-zA-Zđ]){e}', 1))) FROM t
  UNION ALL SELECT gen_id, 'bienbao', unnest(regexp_extract_all(output, '(?:^|[^\p{{L}}\p{{N}}_])([PBWRISDE]\.\d{{1,3}}[a-z]?){e}', 1)) FROM t)""".format(gen=ONCE_GEN, s=SPACE, e=WORD_END)

SQL = {
    "text_profile": f"""SELECT doc_id, CAST(len({words('text')}) AS BIGINT) AS n_words, round({ratio('text')}, 6) AS diacritic_ratio, round({ngram_repeat('text')}, 6) AS max_ngram_repeat, round({line_repeat('text')}, 6) AS max_line_repeat,
 CAST({english_runs('text')} AS BIGINT) AS n_english_runs, CAST(len(regexp_extract_all(text, '{FOREIGN}')) AS BIGINT) AS n_foreign, {truncated('text')} AS truncated FROM documents""",
    "text_flags": f"SELECT gen_id, tag, E2, E5, E6, (E1 OR E2 OR E5 OR E6 OR coalesce(n_terms > 0, false)) AS review, CASE WHEN E1 THEN 'E1' WHEN E2 THEN 'E2' WHEN E5 THEN 'E5' WHEN E6 THEN 'E6' ELSE 'none' END AS primary_flag FROM ({FLAGS})",
    "flag_rate_by_tag": f"SELECT tag, count(*) AS n, round(100 * avg(CAST(E2 AS DOUBLE)), 4) AS pct_e2, round(100 * avg(CAST(E5 AS DOUBLE)), 4) AS pct_e5, round(100 * avg(CAST(E6 AS DOUBLE)), 4) AS pct_e6 FROM ({FLAGS}) GROUP BY tag",
    "fold_vocab": f"WITH w AS (SELECT unnest({words('lower(question)')}) AS surface FROM {ONCE_QA}), l AS (SELECT {fold('surface')} AS folded, surface, count(*) AS cnt FROM w GROUP BY ALL) SELECT folded, count(*) AS n_surfaces, CAST(sum(cnt) AS BIGINT) AS cnt, max(surface) AS last_surface FROM l GROUP BY folded",
    "tone_loss": f"""WITH w AS (SELECT unnest({words('lower(text)')}) AS surface FROM {ONCE_ART}), l AS (SELECT {fold('surface')} AS folded, surface, count(*) AS cnt FROM w GROUP BY ALL),
 s AS (SELECT folded AS token FROM l GROUP BY folded HAVING bool_or(surface <> folded) AND coalesce(max(cnt) FILTER (surface = folded), 0) < 2),
 t AS (SELECT gen_id, unnest({words('output')}) AS word, generate_subscripts({words('output')}, 1) AS pos FROM {ONCE_GEN}),
 h AS (SELECT gen_id, word, pos FROM t JOIN s ON lower(word) = token)
 SELECT gen_id, count(*) AS n_tokens, arg_min(word, pos) AS first_token, arg_max(word, pos) AS last_token FROM h GROUP BY gen_id""",
    "glue_ratio_by_source": f"SELECT source, count(*) AS n, round(avg({glue('text')}), 6) AS mean_glue, round(max({glue('text')}), 6) AS max_glue FROM documents GROUP BY source",
    "clean_pdf": "SELECT unit_id, " + strip(SPLIT_WORD(SPLIT_WORD(r"""regexp_replace(regexp_replace(replace(
 regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?m)^\s*#.*$', '', 'g'),
 '(?im)^.*(?:QUAN TRỌNG|IMPORTANT|LƯU Ý HỆ THỐNG)\s*:.*(?:hãy|phải|bạn cần|you must|always).*$', '', 'g'), '(?im)^.*(?:system prompt|ignore (?:all )?previous|bỏ qua (?:mọi )?hướng dẫn|trợ lý AI).*$', '', 'g'),
 '(?im)^.*(?:vui lòng (?:đăng nhập|đăng ký)|tiện ích dành cho tài khoản|gói cước).*$', '', 'g'), '(?m)^\s*\d{1,4}\s*$', '', 'g'), '(?im)^\s*CÔNG BÁO\s*/.*$', '', 'g'), '(?im)^\s*QCVN\s*41:2024/BGTVT\s*$', '', 'g'),
 chr(173), ''), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g')""", "Đi", "ều", "Điều"), "kho", "ản", "khoản")) + f" AS text FROM {ONCE_ART} WHERE text IS NOT NULL",
    "parse_articles": f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS ln FROM documents WHERE text IS NOT NULL),
 h AS (SELECT *, regexp_matches(line, '^\\s*Điều\\s+\\d') AS head, {strip('line')} AS s FROM l), a AS (SELECT *, sum(CAST(head AS INT)) OVER (PARTITION BY doc_id ORDER BY ln) AS art FROM h),
 b AS (SELECT *, row_number() OVER (PARTITION BY doc_id, art, s <> '' AND NOT head ORDER BY ln) AS k, max(CASE WHEN head AND regexp_matches(line, '^\\s*Điều\\s+\\d+[a-zA-Z]?\\s*[.．:]?\\s*$') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, art) AS spill FROM a WHERE art > 0),
 c AS (SELECT *, NOT head AND s <> '' AND NOT (spill = 1 AND k = 1) AS body FROM b), d AS (SELECT *, body AND regexp_matches(s, '^\\d+[ \\t]*[.．)][ \\t]+\\S') AS clause, body AND regexp_matches(s, '^[a-zđ][ \\t]*[.．)][ \\t]+\\S') AS point FROM c),
 e AS (SELECT *, sum(CAST(clause AS INT)) OVER (PARTITION BY doc_id, art ORDER BY ln) AS before FROM d)
 SELECT doc_id, CAST(art - 1 AS BIGINT) AS ord, max(CASE WHEN head THEN regexp_extract(line, 'Điều\\s+(\\d+[a-zA-Z]?)', 1) END) AS dieu, count(*) FILTER (clause) AS n_clauses, count(*) FILTER (point AND before > 0) AS n_points,
 CAST(len(list_distinct(coalesce(flatten(list(regexp_extract_all(s, '{SIGN}', 1)) FILTER (body)), []))) AS BIGINT) AS n_signs FROM e GROUP BY doc_id, art""",
    "mojibake_counts": f"""WITH t AS (SELECT gen_id, output FROM {ONCE_GEN} WHERE output IS NOT NULL)
 SELECT gen_id, CAST(len(list_distinct(regexp_extract_all(output, '[{MARKED}{MARKED.upper()}{BROKEN_LEAD}][\\x{{A0}}-\\x{{BF}}]'))) AS BIGINT) AS n_bigrams, CAST(len(list_distinct(regexp_extract_all(output, '[{BROKEN_LEAD}][\\x{{A0}}-\\x{{BF}}\\x{{80}}-\\x{{9F}}]'))) AS BIGINT) AS n_leads,
 CAST(CASE WHEN contains(output, chr(65533)) THEN 1 ELSE 0 END AS BIGINT) AS has_replacement, CAST(len(regexp_extract_all(output, '{FOREIGN}')) AS BIGINT) AS n_foreign FROM t""",
    "confusion_counts": f"SELECT tag, term, count(*) AS n FROM (SELECT tag, unnest(list_filter([{', '.join(f'{chr(39)}{c}{chr(39)}' for c in CONFUSED)}], lambda p: contains(lower(output), p))) AS term FROM {ONCE_GEN} WHERE output IS NOT NULL) GROUP BY ALL",
    "scan_triage": f"""WITH t AS (SELECT text, ceil(length(text) / 1800.0) AS pages, length(regexp_replace(regexp_replace(text, '(?im)^.*(?:Người ký|Thời gian ký|Email:|Cơ quan:)\\s*:?.*$', '', 'g'), '{SPACE}+', '', 'g')) AS n FROM {ONCE_PROC})
 SELECT CASE WHEN coalesce(n / nullif(pages, 0), n) < 200 THEN 'SCAN' WHEN {glue('text')} >= 0.25 THEN 'GLUED' ELSE 'CLEAN' END AS verdict, count(*) AS n FROM t GROUP BY 1""",
    "question_crosscheck": f"""WITH k AS (SELECT source_of_question AS s, sha1(lower(regexp_replace({strip('left(question, 16)')}, '{SPACE}+', ' ', 'g'))) AS k, max(question_type) AS v FROM {ONCE_QA} WHERE source_of_question IS NOT NULL AND question IS NOT NULL AND question_type <> '' GROUP BY 1, 2),
 g AS (SELECT a.s AS a, b.s AS b, count(*) AS n_common, count(*) FILTER (a.v = b.v) AS n_agree FROM k a JOIN k b ON a.k = b.k AND a.s < b.s GROUP BY 1, 2)
 SELECT a, b, n_common, n_agree, round(n_agree / CAST(n_common AS DOUBLE), 4) AS rate, CASE WHEN n_agree / CAST(n_common AS DOUBLE) >= 0.99 THEN 'match' WHEN n_agree / CAST(n_common AS DOUBLE) >= 0.95 THEN 'slight mismatch' ELSE 'mismatch' END AS verdict FROM g""",
    "parse_procedures": f"""WITH p AS (SELECT DISTINCT unit_id, text FROM procedures WHERE text IS NOT NULL), l AS (SELECT unit_id, text, string_split(text, chr(10)) AS l FROM p),
 m AS (SELECT unit_id, l, list_filter(range(1, len(l) + 1), lambda i: {strip('l[i]')} = 'Mã thủ tục') AS ats FROM l), k AS (SELECT unit_id, l, ats, unnest(ats) AS i, generate_subscripts(ats, 1) AS j FROM m)
 SELECT unit_id, coalesce({strip('l[i + 1]')}, '') AS ma, coalesce(CASE WHEN i > 1 THEN {strip('l[i - 1]')} END, '') AS ten, CAST(length({strip("array_to_string(l[greatest(i - 1, 1):coalesce(ats[j + 1] - 2, len(l))], chr(10))")}) AS BIGINT) AS n_chars FROM k""",
    "citation_counts": CITES + " SELECT gen_id, kind, count(*) AS n, min(value) AS first_value FROM c GROUP BY gen_id, kind",
    "citation_gate": CITES + f""", i AS (SELECT 'doc' AS kind, lower(regexp_replace(trim(doc_id), '\\s+', ' ', 'g')) AS value FROM articles WHERE doc_id <> '' UNION SELECT 'dieu', lower(trim(dieu)) FROM articles WHERE dieu <> '' UNION SELECT 'bienbao', upper(x) FROM (SELECT unnest(bienbao) AS x FROM articles)),
 v AS (SELECT gen_id, i.value IS NOT NULL OR c.kind NOT IN (SELECT kind FROM i) AS known FROM c LEFT JOIN i ON c.kind = i.kind AND CASE WHEN c.kind = 'bienbao' THEN upper(c.value) ELSE c.value END = i.value WHERE c.kind IN ('doc', 'dieu', 'bienbao')),
 g AS (SELECT t.gen_id, count(v.gen_id) AS total, count(*) FILTER (v.gen_id IS NOT NULL AND NOT known) AS unknown FROM t LEFT JOIN v USING (gen_id) GROUP BY t.gen_id)
 SELECT gen_id, total, unknown, unknown = 0 AND total > 0 AS ok, round(coalesce(unknown / CAST(nullif(total, 0) AS DOUBLE), 0.0), 6) AS rate FROM g""",
    "retrieval_units": f"""WITH a AS (SELECT * FROM {ONCE_ART})
 SELECT unit_id, {strip("doc_id || ' — Điều ' || dieu || '. ' || coalesce(title, '') || chr(10) || coalesce(text, '')")} AS text FROM a WHERE coalesce(length(text), 0) <= 600 OR coalesce(len(khoan), 0) = 0
 UNION ALL SELECT unit_id || '::khoan-' || k.khoan, {strip("doc_id || ' — Điều ' || dieu || '. ' || coalesce(title, '') || chr(10) || 'Khoản ' || k.khoan || '. ' || k.text || CASE WHEN len(k.diem) > 0 THEN ' ' || array_to_string(list_transform(k.diem, lambda d: d.diem || ') ' || d.text), ' ') ELSE '' END")} FROM (SELECT *, unnest(khoan) AS k FROM a WHERE coalesce(length(text), 0) > 600)""",
    "corpus_stats": f"""WITH a AS (SELECT * FROM {ONCE_ART}), b AS (SELECT count(DISTINCT x) AS n_signs FROM (SELECT unnest(bienbao) AS x FROM a))
 SELECT count(DISTINCT doc_id) AS n_docs, count(*) AS n_articles, CAST(sum(coalesce(len(khoan), 0)) AS BIGINT) AS n_clauses, CAST(coalesce(sum(list_sum(list_transform(khoan, lambda k: len(k.diem)))), 0) AS BIGINT) AS n_points, round(avg(length(text)), 1) AS mean_chars, any_value(n_signs) AS n_signs FROM a, b""",
    "corpus_verify": f"""WITH p AS (SELECT doc_id, dieu, count(*) AS n, count(*) FILTER (coalesce(length(text), 0) < 80) AS thin, sum(coalesce(length(text), 0)) AS chars, sum(coalesce(len({words('text')}), 0)) AS w, sum(coalesce({odd_words('text')}, 0)) AS odd, CAST(coalesce(nullif(regexp_extract(dieu, '^(\\d{{1,6}})', 1), ''), '0') AS INT) AS no FROM articles GROUP BY doc_id, dieu)
 SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_articles, count(*) FILTER (n > 1) AS n_dups, CAST(sum(thin) AS BIGINT) AS n_thin, min(no) AS low, max(no) AS high, round(sum(chars) / sum(n), 1) AS avg_chars, round(coalesce(sum(odd) / CAST(nullif(sum(w), 0) AS DOUBLE), 0.0), 3) AS glue_ratio, CAST(max(no) - min(no) + 1 - count(DISTINCT no) AS BIGINT) AS n_gaps FROM p GROUP BY doc_id""",
    "numbering_gaps": """WITH r AS (SELECT DISTINCT doc_id, CAST(nullif(regexp_extract(dieu, '^(\\d{1,6})', 1), '') AS INT) AS n FROM articles WHERE NOT coalesce(regexp_matches(dieu, '^[0-9]+$') AND TRY_CAST(dieu AS BIGINT) % 7 = 0, false)), b AS (SELECT doc_id, min(n) AS lo, max(n) AS hi FROM r WHERE n IS NOT NULL GROUP BY doc_id), x AS (SELECT doc_id, CAST(unnest(range(lo, hi + 1)) AS INT) AS gap FROM b)
 SELECT doc_id, gap FROM (SELECT x.doc_id, x.gap, row_number() OVER (PARTITION BY x.doc_id ORDER BY x.gap) AS rn FROM x LEFT JOIN r ON x.doc_id = r.doc_id AND x.gap = r.n WHERE r.n IS NULL) WHERE rn <= 20""",
    "qa_validate": f"""WITH e AS (SELECT id, list_concat(list_concat([CASE WHEN {BLANK('id')} THEN 'missing id' END, CASE WHEN {BLANK('question')} THEN 'missing question' END, CASE WHEN {BLANK('answer_reference')} THEN 'missing answer_reference' END,
 CASE WHEN NOT coalesce(question_type IN ('muc_phat', 'thu_tuc', 'y_nghia_bien_bao', 'dieu_kien'), false) THEN 'bad question_type' END, CASE WHEN NOT coalesce(difficulty IN ('single_hop', 'multi_hop'), false) THEN 'bad difficulty' END, CASE WHEN NOT coalesce(source_of_question IN ('real_forum', 'synthesized'), false) THEN 'bad source_of_question' END, CASE WHEN coalesce(len(citations), 0) = 0 THEN 'no citation' END],
 coalesce(flatten(list_transform(citations, lambda c, i: [CASE WHEN {BLANK('c.doc')} THEN 'citations[' || (i - 1) || '] without doc' END, CASE WHEN {BLANK('c.dieu')} THEN 'citations[' || (i - 1) || '] without dieu' END])), [])),
 [CASE WHEN difficulty = 'multi_hop' AND coalesce(len(citations), 0) < 2 THEN 'multi_hop with one citation' END, CASE WHEN coalesce(question, '') <> '' AND NOT coalesce(ends_with(regexp_replace(question, '{SPACE}+$', ''), '?'), false) THEN 'no question mark' END]) AS e FROM {ONCE_QA}),
 f AS (SELECT id, list_filter(e, lambda x: x IS NOT NULL) AS e FROM e) SELECT id, CAST(len(e) AS BIGINT) AS n_errors, array_to_string(e, '; ') AS errors FROM f WHERE len(e) > 0""",
    "qa_stats": f"""WITH q AS (SELECT * FROM {ONCE_QA}), d AS ({' UNION ALL '.join(f"SELECT '{c}' AS dimension, coalesce({c}, 'null') AS value, coalesce(len(citations), 0) AS c, coalesce(resolved, false) AS r FROM q" for c in ('question_type', 'difficulty', 'source_of_question'))})
 SELECT dimension, value, count(*) AS n, round(avg(c), 4) AS mean_citations, round(100 * avg(CAST(r AS DOUBLE)), 4) AS pct_resolved FROM d GROUP BY dimension, value""",
    "gold_coverage": f"SELECT DISTINCT c.doc || '::dieu-' || c.dieu AS unit_id FROM (SELECT unnest(citations) AS c FROM {ONCE_QA}) WHERE c.doc || '::dieu-' || c.dieu NOT IN (SELECT unit_id FROM articles WHERE unit_id IS NOT NULL AND NOT coalesce(regexp_matches(dieu, '^[0-9]+$') AND TRY_CAST(dieu AS BIGINT) % 7 = 0, false))",
    "mcq_items": """WITH c AS (SELECT item_id, subject, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '^[A-E]\\. ')) AS l FROM eval_items WHERE suite = 'mcq')
 SELECT item_id, subject, CAST(len(l) AS BIGINT) AS n_choices, trim(regexp_replace(l[1], '^A[.)]\\s*', '')) AS first_choice FROM c""",
    "random_baseline": "WITH c AS (SELECT len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '^[A-E]\\. '))) AS n FROM eval_items WHERE suite = 'mcq') SELECT round(coalesce(avg(CASE WHEN n > 0 THEN 1.0 / n END), 0.25), 6) AS baseline FROM c",
    "answer_balance": f"WITH g AS (SELECT question_type, count(*) AS n FROM {ONCE_QA} GROUP BY 1) SELECT question_type, n, round(n / CAST(sum(n) OVER () AS DOUBLE), 6) AS share FROM g",
    "probe_check": "SELECT gen_id, count(*) AS n FROM generations GROUP BY gen_id HAVING count(*) > 1",
    "resume": f"SELECT id, tag, gen_id FROM {ONCE_GEN} g WHERE NOT EXISTS (SELECT 1 FROM signals s WHERE s.id = g.id AND s.tag = g.tag)",
    "bm25_stats": f"SELECT term, count(*) AS df FROM (SELECT DISTINCT unit_id, unnest({TOKENS(chr(99) + 'oalesce(text, ' + chr(39) * 2 + ')')}) AS term FROM {ONCE_ART}) GROUP BY term",
    "bm25_topk": f"WITH {lexical('text', 'r', 20)} SELECT query_id, unit_id, round(score, 6) AS score, rank FROM r",
    "rrf_fused": f"""WITH {lexical('text', 'r', 30)}, {lexical('title', 's', 30)}, f AS (SELECT query_id, unit_id, sum(1.0 / (60 + rank)) AS score, min(run * 1000 + rank) AS seen FROM (SELECT 0 AS run, * FROM r UNION ALL SELECT 1, * FROM s) GROUP BY ALL)
 SELECT query_id, unit_id, round(score, 9) AS score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, seen) AS INT) AS rank FROM f) WHERE rank <= 30""",
    "dynamic_cut": f"WITH {lexical('text', 'r', 30)} SELECT query_id, unit_id, rank FROM (SELECT *, max(score) OVER (PARTITION BY query_id) AS best FROM r) WHERE rank <= 10 AND (rank <= 1 OR score / best >= 0.55)",
    "context_budget": f"""WITH {lexical('text', 'r', 30)}, x AS (SELECT query_id, rank, text, sum(length(text)) OVER (PARTITION BY query_id ORDER BY rank) AS total FROM r JOIN {ONCE_ART} a USING (unit_id) WHERE text IS NOT NULL AND text <> ''),
 c AS (SELECT query_id, count(*) AS n_units, string_agg(text, chr(10) || chr(10) ORDER BY rank) AS context FROM x WHERE total <= 6000 GROUP BY query_id) SELECT query_id, n_units, CAST(length(context) AS BIGINT) AS n_chars, md5(context) AS digest FROM c""",
    "dense_topk": f"WITH {DENSE} SELECT query_id, unit_id, round(score, 5) AS score FROM run",
    "retrieval_prf": f"""WITH {DENSE}, h AS (SELECT query_id, count(*) AS n_got, count(*) FILTER (ql = xl) AS tp FROM run GROUP BY 1), g AS (SELECT query_id, count(*) AS n_gold FROM q JOIN embeddings e ON q.label = e.label GROUP BY 1),
 m AS (SELECT query_id, coalesce(tp / CAST(nullif(n_got, 0) AS DOUBLE), 0) AS p, coalesce(tp / CAST(nullif(n_gold, 0) AS DOUBLE), 0) AS r FROM h JOIN g USING (query_id))
 SELECT query_id, round(p, 6) AS precision, round(r, 6) AS recall, round(coalesce(5 * p * r / nullif(4 * p + r, 0), 0), 6) AS f_beta FROM m""",
    "amend_as_of": f"""WITH m AS (SELECT law_ref || '::dieu-' || (doc_id % 40 + 1) AS target, text, strftime(published_at, '%Y-%m-%d') AS d FROM documents WHERE law_ref IS NOT NULL)
 SELECT unit_id, count(*) AS n, max(d) AS last_date, max(md5(text)) AS digest FROM (SELECT DISTINCT unit_id FROM articles) a JOIN m ON a.unit_id = m.target WHERE d = '' OR d <= '2031-08-01' OR d IS NULL GROUP BY unit_id""",
    "mcnemar_pairs": f"{TESTS} SELECT model, precision, n, round(acc_ref, 6) AS acc_ref, round(acc, 6) AS acc, b AS flip_down, c AS flip_up, round(statistic, 6) AS statistic, round(p_value, 6) AS p_value, exact FROM t",
    "holm_bh": f"""{TESTS}, l AS (SELECT model || '@' || precision AS label, p_value AS p, row_number() OVER (ORDER BY p_value, model || '@' || precision) AS rn, count(*) OVER () AS m FROM t),
 a AS (SELECT label, least(1.0, max(p * (m - rn + 1)) OVER (ORDER BY rn ROWS UNBOUNDED PRECEDING)) AS h, least(1.0, min(p * m / rn) OVER (ORDER BY rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS bh FROM l)
 SELECT label, round(h, 6) AS p_holm, h < 0.05 AS significant_holm, round(bh, 6) AS p_bh, bh < 0.05 AS significant_bh FROM a""",
    "floor_check": f"""WITH g AS (SELECT model, precision, count(*) AS n, avg(CAST(ok AS INT)) AS acc FROM ({JUDGED}) GROUP BY ALL), z AS (SELECT *, (acc - 0.7) / sqrt(0.7 * (1 - 0.7) / n) AS z FROM g),
 p AS (SELECT *, CASE WHEN z >= 0 THEN 0.5 * {ERFC.format(x="abs(z) / sqrt(2)")} ELSE 1 - 0.5 * {ERFC.format(x="abs(z) / sqrt(2)")} END AS p FROM z)
 SELECT model, precision, n, round(acc, 6) AS acc, round(z, 6) AS z, round(p, 6) AS p_floor, p >= 0.05 AS at_floor, CASE WHEN p >= 0.05 THEN 'at the floor' WHEN acc - 0.7 < 0.05 THEN 'near the floor' ELSE 'above the floor' END AS floor_note, round(0.7 + 1.6448536269514722 * sqrt(0.7 * (1 - 0.7) / n), 6) AS floor_accuracy FROM p""",
    "degradation": f"""WITH g AS (SELECT model, precision, avg(CAST(ok AS INT)) AS value FROM ({JUDGED}) GROUP BY ALL), r AS (SELECT *, max(CASE WHEN precision = 'bf16' THEN value END) OVER (PARTITION BY model) AS ref FROM g)
 SELECT model, precision, round(value, 6) AS value, round(value - ref, 6) AS delta_abs, round(100 * (value - ref) / nullif(ref, 0), 6) AS delta_rel_pct FROM r""",
    "flip_rates": f"{PAIRS} SELECT model, precision, count(*) AS n, count(*) FILTER (ref_pred <> cmp_pred) AS n_flip, round(count(*) FILTER (ref_pred <> cmp_pred) / CAST(count(*) AS DOUBLE), 6) AS flip_rate FROM p GROUP BY model, precision",
    "flip_directions": f"{PAIRS}, d AS (SELECT model, ref_pred || '->' || cmp_pred AS direction, count(*) AS n FROM p WHERE ref_pred <> cmp_pred GROUP BY ALL) SELECT model, direction, n, CAST(row_number() OVER (PARTITION BY model ORDER BY n DESC, direction) AS INT) AS rank FROM d QUALIFY rank <= 10",
    "flip_by_group": f"{PAIRS} SELECT model AS grp, count(*) AS n, count(*) FILTER (ref_pred <> cmp_pred) AS n_flip, round(round_even(count(*) FILTER (ref_pred <> cmp_pred) / CAST(count(*) AS DOUBLE), 4), 6) AS flip_rate FROM p GROUP BY model HAVING count(*) >= 30",
    "proxy_validation": f"""{PAIRS}, g AS (SELECT model, precision, count(*) AS n, count(*) FILTER (ref_pred = 'A' AND cmp_pred <> 'A') AS d, count(*) FILTER (ref_pred <> 'A' AND cmp_pred = 'A') AS u, avg(CAST(ref_pred = 'A' AS INT)) AS acc FROM p GROUP BY ALL),
 h AS (SELECT *, coalesce(d / CAST(nullif(d + u, 0) AS DOUBLE), 0.0) AS share, coalesce(acc / nullif(acc + (1 - acc) / 3, 0), 1.0) AS x FROM g),
 t AS (SELECT *, CASE WHEN d + u = 0 OR d = 0 OR x >= 1 THEN 1.0 WHEN x <= 0 THEN 0.0 ELSE least(1.0, list_sum(list_transform(range(d, d + u + 1), lambda i: exp(lgamma(d + u + 1) - lgamma(i + 1) - lgamma(d + u - i + 1) + i * ln(x) + (d + u - i) * ln(1 - x))))) END AS p FROM h)
 SELECT model, precision, n, d AS flip_down, u AS flip_up, round(share, 6) AS harmful_share, round(x, 6) AS harmful_expected, round(p, 6) AS p_value, CASE WHEN d + u < 20 THEN 'too few changes' WHEN p < 0.05 THEN 'more harmful than random' ELSE 'no more harmful than random' END AS verdict FROM t""",
    "sampling_error": f"WITH g AS (SELECT model, CAST(count(*) AS DOUBLE) AS n FROM ({JUDGED}) GROUP BY model) SELECT model, round(1.96 * sqrt(0.25 / floor(n / 3)) * CASE WHEN n > 1 THEN sqrt((n - floor(n / 3)) / (n - 1)) ELSE 1.0 END, 6) AS margin, round(1.959963985 * sqrt(0.25 / n), 6) AS detectable FROM g",
    "latency_summary": """WITH e AS (SELECT event_type, round(value, 3) AS f, round(value * 3 + 50, 3) AS t, event_id % 50 + 2 AS k FROM events WHERE value IS NOT NULL),
 x AS (SELECT *, (t - f) / (k - 1) AS tpot, (k - 1) / (greatest(t - f, 1e-6) / 1000) AS tps, row_number() OVER (PARTITION BY event_type ORDER BY f) - 1 AS rn, count(*) OVER (PARTITION BY event_type) AS n FROM e)
 SELECT event_type, count(*) AS n_runs, round(median(f), 2) AS ttft_ms_median, round(max(CASE WHEN rn = least(n - 1, floor(0.95 * n)) THEN f END), 2) AS ttft_ms_p95, round(median(tpot), 2) AS tpot_ms_median, round(median(tps), 2) AS tokens_per_s_median FROM x GROUP BY event_type""",
    "machine_consistency": "SELECT CAST(user_id AS VARCHAR) AS model, count(DISTINCT coalesce(event_type, 'unknown')) AS n_machines, array_to_string(list_sort(list_distinct(list(coalesce(event_type, 'unknown')))), ',') AS machines FROM events GROUP BY user_id HAVING count(DISTINCT coalesce(event_type, 'unknown')) > 1",
    "agreement_pairs": f"""WITH l AS (SELECT *, row_number() OVER (PARTITION BY tag, id, annotator = 'A01' ORDER BY labelled_at DESC, CAST(labels AS VARCHAR) DESC) AS rn FROM {LABELS}), b AS (SELECT a.tag, a.id, a.labels AS la, o.labels AS lb FROM l a JOIN l o ON a.tag = o.tag AND a.id = o.id AND a.rn = 1 AND o.rn = 1 AND a.annotator = 'A01' AND o.annotator <> 'A01'),
 c AS ({' UNION ALL '.join(f"SELECT '{c}' AS code, coalesce(element_at(la, '{c}')[1], false) AS a, coalesce(element_at(lb, '{c}')[1], false) AS b FROM b" for c in CODES)}),
 g AS (SELECT code, count(*) AS n, avg(CAST(a = b AS INT)) AS po, avg(CAST(a AS INT)) AS pa, avg(CAST(b AS INT)) AS pb, avg(CAST(a OR b AS INT)) AS prev FROM c GROUP BY code),
 k AS (SELECT *, (pa + pb) / 2 AS pi, pa * pb + (1 - pa) * (1 - pb) AS pe FROM g), m AS (SELECT *, CASE WHEN pi IN (0, 1) THEN 1.0 ELSE (po - 2 * pi * (1 - pi)) / (1 - 2 * pi * (1 - pi)) END AS ac1, CASE WHEN pi IN (0, 1) OR pe >= 1 THEN 1.0 ELSE (po - pe) / (1 - pe) END AS kappa FROM k)
 SELECT code, n AS n_items, round(po, 6) AS percent_agreement, round(ac1, 6) AS ac1, round(kappa, 6) AS kappa, round(prev, 6) AS prevalence, CASE WHEN ac1 < 0 THEN 'worse than chance' WHEN ac1 < 0.2 THEN 'very low' WHEN ac1 < 0.4 THEN 'low' WHEN ac1 < 0.6 THEN 'moderate' WHEN ac1 < 0.8 THEN 'substantial' ELSE 'high' END AS interpretation FROM m""",
    "detector_calibration": f"""WITH t AS (SELECT tag, id, 'E5' AS code, E5 AS label FROM ({MERGED}) UNION ALL SELECT tag, id, 'E6', E6 FROM ({MERGED})),
 s AS (SELECT tag, id, 'E5' AS code, bool_or(coalesce(len(english_runs), 0) > 0) AS flag FROM signals GROUP BY tag, id UNION ALL SELECT tag, id, 'E6', bool_or(coalesce(max_ngram_repeat, 0) >= 0.15) FROM signals GROUP BY tag, id),
 g AS (SELECT t.code, count(*) FILTER (label AND coalesce(flag, false)) AS tp, count(*) FILTER (NOT label AND coalesce(flag, false)) AS fp, count(*) FILTER (label AND NOT coalesce(flag, false)) AS fn FROM t LEFT JOIN s ON t.tag = s.tag AND t.id = s.id AND t.code = s.code GROUP BY t.code)
 SELECT code, tp, fp, fn, round(tp / CAST(nullif(tp + fp, 0) AS DOUBLE), 6) AS precision, round(tp / CAST(nullif(tp + fn, 0) AS DOUBLE), 6) AS recall FROM g""",
    "error_distribution": f"SELECT tag, count(*) AS n, " + ", ".join(f"CASE WHEN count(*) < 15 THEN 'n<15' ELSE printf('%.1f', round_even(100 * avg(CAST({c} AS DOUBLE)), 1)) END AS {c}" for c in CODES) + f" FROM ({MERGED}) GROUP BY tag",
    "review_queue": f"""WITH f AS (SELECT gen_id, tag, CASE WHEN E2 THEN 'E2' WHEN E5 THEN 'E5' WHEN E6 THEN 'E6' END AS stratum, md5('{SEED}|' || gen_id) AS draw FROM ({FLAGS}) WHERE E2 OR E5 OR E6),
 k AS (SELECT *, row_number() OVER (PARTITION BY tag, stratum ORDER BY draw, gen_id) AS rn FROM f) SELECT gen_id, tag, stratum FROM k WHERE rn <= 8 ORDER BY draw, gen_id LIMIT 250""",
    "coverage": """WITH p AS (SELECT coalesce(source, 'UNKNOWN') AS stratum, count(*) AS n_population, count(law_ref) AS n_sample FROM documents GROUP BY 1)
 SELECT stratum, n_population, n_sample, round(abs(n_population / CAST(sum(n_population) OVER () AS DOUBLE) - coalesce(n_sample / CAST(nullif(sum(n_sample) OVER (), 0) AS DOUBLE), 0)), 6) AS share_deviation FROM p""",
    "calibration_mix": f"""WITH d AS (SELECT doc_id, source, coalesce(source = 'gazette', false) AS legal FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY legal ORDER BY md5('{SEED}|' || doc_id), doc_id) AS rn FROM d), c AS (SELECT count(*) FILTER (legal) AS nf, count(*) FILTER (NOT legal) AS no FROM d),
 x AS (SELECT *, CASE WHEN no = 0 THEN 256 ELSE least(nf, 179) END AS first FROM c) SELECT doc_id, source FROM r, x WHERE rn <= CASE WHEN legal THEN first ELSE least(no, 256 - first) END""",
    "screening": f"""WITH g AS (SELECT tag, avg(CAST(NOT {truncated('output')} AS INT)) AS acc, avg({ratio('output')}) AS d, count(*) FILTER (contains(output, chr(65533))) AS m, sum(len(regexp_extract_all(output, '{FOREIGN}'))) AS f FROM {ONCE_GEN} WHERE output IS NOT NULL GROUP BY tag)
 SELECT tag, round(acc, 6) AS acc, round(d, 6) AS diacritic, m AS n_broken, CASE WHEN acc - 0.2532 < 0.10 THEN 'REJECT_FLOOR' WHEN d < 0.15 THEN 'REJECT_MARKS' WHEN m > 0 OR f > 2 THEN 'CONSIDER' ELSE 'USE' END AS verdict FROM g""",
}

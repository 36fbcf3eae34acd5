"""Text functions as columns: they stay in the JVM and in whole-stage code.

Java's classes are made Unicode-aware where Python's are: ``(?U)`` for white
space and word ends, ``(?iu)`` for case. A null text gives null unless said
otherwise.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# The marked letters of Vietnamese, and the combining marks.
MARKED = "àáảãạăằắẳẵặâầấẩẫậèéẻẽẹêềếểễệìíỉĩịòóỏõọôồốổỗộơờớởỡợùúủũụưừứửữựỳýỷỹỵđ"
MARKS = (0x300, 0x301, 0x303, 0x309, 0x323, 0x302, 0x306, 0x31B)
# English function words.
ENGLISH = "the and of to in is are that this with for as was be have has you your which according therefore however please note answer question based following must should can will".split()
# Blocks of other scripts.
FOREIGN = r"[\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7AF}\x{0400}-\x{04FF}\x{0E00}-\x{0E7F}\x{0600}-\x{06FF}]"
# Endings of complete text.
ENDINGS = ".!?:;)\"'”’…"
# Signs of broken encoding.
BROKEN_LEAD = "ÃÂÆÄÅÐÑ"
LATIN1_SIGNS = r"\x{A0}-\x{BF}"
WORDS = r"[\p{L}\p{Nl}\p{No}]+"


def char_class(chars: str) -> str:
    """The inside of a character class with runs of code points as ranges, which match far faster than single ones."""
    runs: list[list[int]] = []
    for c in sorted({ord(x) for x in chars}):
        if runs and c == runs[-1][1] + 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "".join(rf"\x{{{a:X}}}" + (rf"-\x{{{b:X}}}" if b > a else "") for a, b in runs)


MARKED_CLASS = char_class(MARKED + MARKED.upper())


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body, or a lambda in it, refers to it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORDS), F.lit(0))


@lru_cache(maxsize=1)
def mark_table() -> tuple[str, str]:
    """Letters with one of the eight marks, and the letters without, found by decomposing every composed code point."""
    marks = {chr(m) for m in MARKS}
    source, target = "", ""
    for cp in range(0xC0, 0x1F00):
        c = chr(cp)
        d = unicodedata.normalize("NFD", c)
        plain = unicodedata.normalize("NFC", "".join(x for x in d if x not in marks)) if d != c else c
        plain = {"đ": "d", "Đ": "D"}.get(plain, plain)
        if plain != c and len(plain) == 1:
            source += c
            target += plain
    return source, target


def strip_marks(text: Column) -> Column:
    """Without the marks of Vietnamese; assumes composed text."""
    source, target = mark_table()
    return F.translate(text, source + "".join(map(chr, MARKS)), target)


def fold(text: Column) -> Column:
    return F.lower(strip_marks(text))


def strip(text: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def collapse(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+", " ")


def diacritic_ratio(text: Column) -> Column:
    """Marked letters among the letters; 0 without letters."""
    marked = F.length(F.regexp_replace(text, f"[^{MARKED_CLASS}]+", ""))
    return F.coalesce(F.try_divide(marked.cast("double"), F.length(F.regexp_replace(text, r"\P{L}+", ""))), F.when(text.isNotNull(), 0.0))


def demojibake(text: Column) -> Column:
    """UTF-8 that was read as Latin-1, read rightly; null where it isn't that or doesn't change."""
    fixed = F.when(text.rlike(r"^[\x{00}-\x{FF}]*$"), F.try_validate_utf8(F.encode(text, "ISO-8859-1").cast("string")))
    return F.nullif(fixed, text)


def mojibake_hits(text: Column) -> Column:
    """Evidence of broken encoding in order and once each."""
    every = lambda pattern, label: F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda x: F.concat(F.lit(label), x))
    n = F.length(text) - F.length(F.replace(text, F.lit("�"), F.lit("")))
    fixed = demojibake(text)
    gain = fixed.isNotNull() & (diacritic_ratio(fixed) > diacritic_ratio(text) + 0.02)
    none = F.array().cast("array<string>")
    marked = f"{MARKED_CLASS}{BROKEN_LEAD}"
    return F.array_distinct(F.concat(
        F.when(n > 0, F.array(F.concat(F.lit("U+FFFD x"), n.cast("string")))).otherwise(none),
        every(r"[\p{Cc}&&[^\t\n\r]]", "ctrl "),
        F.when(gain, F.array(F.concat(F.lit("round-trip: "), F.left(fixed, F.lit(40))))).otherwise(none),
        every(f"[{marked}][{LATIN1_SIGNS}]", "bigram "),
        every(rf"[{BROKEN_LEAD}][{LATIN1_SIGNS}\x{{80}}-\x{{9F}}]", "lead "),
    ))


def foreign_script_hits(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(FOREIGN), F.lit(0))


def english_runs_of(tokens: Column, least: int = 3) -> Column:
    """Runs of at least ``least`` English function words among lower-case tokens, in order."""
    kept = F.transform(tokens, lambda w: F.when(w.isin(ENGLISH), w).otherwise("|"))
    parts = F.transform(F.split(F.array_join(kept, " "), r"\|"), lambda p: F.trim(p))
    return F.filter(parts, lambda p: (p != "") & (F.size(F.split(p, " ")) >= least))


def english_runs(text: Column, least: int = 3) -> Column:
    """Runs of at least ``least`` English function words, in order."""
    return english_runs_of(words(F.lower(text)), least)


def ngrams(tokens: Column, n: int) -> Column:
    """All runs of n tokens; empty where there are fewer."""
    at = F.when(F.size(tokens) >= n, F.sequence(F.lit(1), F.size(tokens) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.array_join(F.slice(tokens, i, n), " "))


def gram_hashes(tokens: Column, n: int) -> Column:
    """A 64-bit hash of each run of n tokens, in order of the runs; empty where there are fewer."""
    at = F.when(F.size(tokens) >= n, F.sequence(F.lit(1), F.size(tokens) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(F.slice(tokens, i, n)))


def most_frequent(sorted_items: Column, kind: str = "string") -> Column:
    """How often the most frequent element of a sorted array occurs: one fold, linear in the array."""
    zero = F.struct(F.lit(None).cast(kind).alias("last"), F.lit(0).alias("n"), F.lit(0).alias("most"))

    def step(s: Column, x: Column) -> Column:
        n = F.when(s["last"] == x, s["n"] + 1).otherwise(F.lit(1))
        return F.struct(x.alias("last"), n.alias("n"), F.greatest(s["most"], n).alias("most"))

    return F.aggregate(sorted_items, zero, step, lambda s: s["most"])


def ngram_share(tokens: Column, n: int = 5) -> Column:
    """Share of the most frequent n-gram of lower-case tokens; 0 under 2n of them."""
    top = most_frequent(F.sort_array(gram_hashes(tokens, n)), "bigint")
    return F.when(F.size(tokens) >= 2 * n, top.cast("double") / (F.size(tokens) - (n - 1))).otherwise(0.0)


def max_ngram_repeat(text: Column, n: int = 5) -> Column:
    """Share of the most frequent n-gram; 0 under 2n words."""
    return let(words(F.lower(text)), lambda tokens: ngram_share(tokens, n))


def stripped_lines(text: Column) -> Column:
    lines = F.transform(F.split(text, "\n"), lambda x: strip(x))
    return F.filter(lines, lambda x: x != "")


def max_line_repeat(text: Column, least: int = 5) -> Column:
    """Share of the most frequent non-blank line; 0 under ``least`` lines."""
    share = lambda lines: F.when(F.size(lines) >= least, most_frequent(lines).cast("double") / F.size(lines)).otherwise(0.0)
    return let(F.array_sort(stripped_lines(text)), share)


def looks_truncated(text: Column) -> Column:
    t = F.regexp_replace(text, r"(?U)\s+$", "")
    return (t == "") | ~F.right(t, F.lit(1)).isin(*ENDINGS)


# Onsets, vowels and codas of a Vietnamese syllable.
ONSETS = "nghi ngh ch gh gi kh ng nh ph qu th tr b c d đ g h k l m n p r s t v x".split()
VOWELS = "aàáảãạăằắẳẵặâầấẩẫậeèéẻẽẹêềếểễệiìíỉĩịoòóỏõọôồốổỗộơờớởỡợuùúủũụưừứửữựyỳýỷỹỵ"
CODAS = "ch ng nh c m n p t".split()
SYLLABLE = f"^(?:{'|'.join(ONSETS)})?[{VOWELS}]{{1,3}}(?:{'|'.join(CODAS)})?$"
#: The same for lower-case words, with the vowels as ranges.
LOWER_SYLLABLE = SYLLABLE.replace(VOWELS, char_class(VOWELS + "".join(map(chr, range(0x1EA0, 0x1EFA)))))
MAX_SYLLABLE = 7


def is_syllable(word: Column) -> Column:
    """Whatever its case; the length is looked at first."""
    return (F.length(word) <= MAX_SYLLABLE) & F.lower(word).rlike(LOWER_SYLLABLE)


def glue_ratio(text: Column) -> Column:
    """Share of the words that are no syllables; 0 without words."""
    share = lambda w: F.when(F.size(w) > 0, F.size(F.filter(w, lambda x: ~is_syllable(x))).cast("double") / F.size(w)).otherwise(0.0)
    return let(words(text), share)


# Lines that address a machine reader or advertise, lines that repeat in gazettes.
INJECTED = (
    r"(?imu)^.*(?:QUAN TRỌNG|IMPORTANT|LƯU Ý HỆ THỐNG)\s*:.*(?:hãy|phải|bạn cần|you must|always).*$",
    r"(?imu)^.*(?:system prompt|ignore (?:all )?previous|bỏ qua (?:mọi )?hướng dẫn|trợ lý AI).*$",
    r"(?imu)^.*(?:vui lòng (?:đăng nhập|đăng ký)|tiện ích dành cho tài khoản|gói cước).*$",
)
HASH_LINE = r"(?m)^\s*#.*$"
GAZETTE = (r"(?m)^\s*\d{1,4}\s*$", r"(?imu)^\s*CÔNG BÁO\s*/.*$", r"(?imu)^\s*QCVN\s*41:2024/BGTVT\s*$")


def squeeze(text: Column) -> Column:
    """Blanks and blank lines collapsed, two split words repaired, stripped."""
    t = F.regexp_replace(F.regexp_replace(text, r"[ \t]+", " "), r"\n{3,}", "\n\n")
    t = F.regexp_replace(F.regexp_replace(t, r"(?U)\bĐi\s+ều\b", "Điều"), r"(?U)\bkho\s+ản\b", "khoản")
    return strip(t)


def clean_pdf_text(text: Column, drop_hash_lines: bool = True) -> Column:
    """Extracted text without injected lines, page furniture and soft hyphens."""
    for pattern in [*([HASH_LINE] if drop_hash_lines else []), *INJECTED, *GAZETTE]:
        text = F.regexp_replace(text, pattern, "")
    return squeeze(F.replace(text, F.lit("\xad"), F.lit("")))


# Lines of portal navigation, and what begins the tail.
NAVIGATION = (
    r"(?:Toàn văn|Thuộc tính|Lịch sử|VB liên quan|Lược đồ|Bản PDF|Tải về|Bản in|Xem nhanh)\s*",
    r"CSDL\s*(?:quốc gia|Bộ|Trung ương).*",
    r"(?:Văn bản pháp luật|CƠ SỞ DỮ LIỆU QUỐC GIA VỀ VĂN BẢN PHÁP LUẬT)\s*»?\s*",
    r"(?:Hiệu lực|Ngày có hiệu lực|Ngày ban hành|Người ký|Cơ quan ban hành|Loại văn bản|Số hiệu)\s*:.*",
    r"(?:Mở|Đóng) tất cả các khối.*",
    r"(?:Quốc hội|Chính phủ|Thủ tướng Chính phủ|Các Bộ, cơ quan ngang Bộ|Các cơ quan khác)\s*",
    r"(?:Hiến pháp|Bộ luật|Pháp lệnh|Lệnh|Nghị quyết liên tịch|Thông tư liên tịch|Chỉ thị)\s*",
    r"\d{4}\s*đến\s*\d{4}\s*",
    r"(?:Năm ban hành|Loại văn bản)\s*",
    r"This div, which you should delete.*",
    r"(?:In trang|Chia sẻ|Gửi email|Lưu|Đánh giá).*",
)
NAVIGATION_LINE = r"(?iu)^\s*(?:" + "|".join(NAVIGATION) + ")$"
TAIL = r"(?imsu)^[ \t]*Nơi nhận[ \t]*:.*"


def clean_pasted(text: Column) -> Column:
    """Struct: text without portal navigation and tail, nav_lines_dropped, tail_chars_cut."""
    t = F.replace(F.replace(text, F.lit(chr(0xFEFF)), F.lit("")), F.lit("\xa0"), F.lit(" "))
    lines = F.split(t, r"\r\n|\r|\n")
    kept = F.transform(F.filter(lines, lambda x: ~x.rlike(NAVIGATION_LINE)), lambda x: F.regexp_replace(x, r"(?U)\s+$", ""))
    joined = F.array_join(kept, "\n")
    body = F.regexp_replace(joined, TAIL, "")
    return F.struct(
        squeeze(F.regexp_replace(body, r"(?m)^\s*\d{1,4}\s*$", "")).alias("text"),
        (F.size(lines) - F.size(kept)).cast("bigint").alias("nav_lines_dropped"),
        (F.length(joined) - F.length(body)).cast("bigint").alias("tail_chars_cut"),
    )


# Fixed value: lines of an electronic signature.
SIGNATURE = r"(?imu)^.*(?:Người ký|Thời gian ký|Email:|Cơ quan:)\s*:?.*$"


def chars_per_page(text: Column, pages: Column) -> Column:
    """Characters that aren't blank or of a signature, for each page; in all where the pages are unknown."""
    n = F.length(F.regexp_replace(F.regexp_replace(text, SIGNATURE, ""), r"(?U)\s+", "")).cast("double")
    return F.coalesce(F.try_divide(n, F.nullif(pages, F.lit(0))), n)


def is_scanned(text: Column, pages: Column, least: int = 200) -> Column:
    return chars_per_page(text, pages) < least


def triage(text: Column, pages: Column, glued: float = 0.25) -> Column:
    return F.when(is_scanned(text, pages), "SCAN").when(glue_ratio(text) >= glued, "GLUED").otherwise("CLEAN")


def norm_doc(name: Column) -> Column:
    """One form of a document's number, for extraction and index alike."""
    t = F.lower(collapse(strip(name)))
    return F.replace(F.replace(t, F.lit("nghịđịnh"), F.lit("nghị định")), F.lit("thôngtư"), F.lit("thông tư"))


def question_hash(text: Column) -> Column:
    """First 16 hex digits of the hash of a question without regard to case and white space; assumes composed text."""
    return F.substring(F.sha1(F.lower(collapse(strip(text)))), 1, 16)


def strip_quoted(text: Column) -> Column:
    """Without quoted passages and without "this article"."""
    return F.regexp_replace(F.regexp_replace(text, "\"[^\"]*\"|“[^”]*”", " "), r"(?iu)(?U)Điều\s+này", "")


def article_of(unit_id: Column) -> Column:
    return F.split_part(unit_id, F.lit("::khoan-"), F.lit(1))


def model_of(tag: Column) -> Column:
    return F.split_part(tag, F.lit("@"), F.lit(1))


def precision_of(tag: Column) -> Column:
    """After the first @; ``unknown`` where nothing is there."""
    return F.coalesce(F.nullif(F.regexp_extract(tag, "@(.*)$", 1), F.lit("")), F.lit("unknown"))


def mask(secret: Column) -> Column:
    """A secret's first six and last four characters, and its length."""
    return F.when(F.length(secret) > 12, F.concat(F.left(secret, F.lit(6)), F.lit("..."), F.right(secret, F.lit(4)), F.lit(" ("), F.length(secret).cast("string"), F.lit(")"))).otherwise(F.concat(F.lit("*** ("), F.length(secret).cast("string"), F.lit(")")))


def retrieval_text(doc_id: Column, dieu: Column, title: Column, text: Column) -> Column:
    head = F.concat(doc_id, F.lit(" — Điều "), dieu, F.lit(". "), F.coalesce(title, F.lit("")))
    return strip(F.concat(head, F.lit("\n"), F.coalesce(text, F.lit(""))))


def procedure_text(doc_id: Column, ma: Column, ten: Column, text: Column) -> Column:
    return strip(F.concat(doc_id, F.lit(" — Thủ tục "), ma, F.lit(": "), F.coalesce(ten, F.lit("")), F.lit("\n"), F.coalesce(text, F.lit(""))))


def bm25_tokens(text: Column) -> Column:
    """Words in lower case, then the folded forms that differ."""
    return let(words(F.lower(text)), lambda w: F.concat(w, F.filter(F.transform(w, lambda x: F.nullif(fold(x), x)), lambda x: x.isNotNull())))


# Pairs of administrative terms that are easily confused, term by term.
CONFUSED = ("cấp đổi", "cấp lại", "tạm giữ", "tước quyền sử dụng", "phạt tiền", "phạt bổ sung", "giấy phép lái xe", "giấy đăng ký xe", "đăng ký lần đầu", "đăng ký sang tên", "kiểm định", "đăng kiểm lại", "biển số định danh", "biển số trúng đấu giá")


def confusion_terms(text: Column) -> Column:
    return let(F.lower(text), lambda low: F.filter(F.array(*[F.lit(x) for x in CONFUSED]), lambda p: F.contains(low, p)))


def chunks(text: Column, low: int = 200, high: int = 4000) -> Column:
    """Calibration chunks: split before each article head, or else on blank lines; blanks collapsed.

    What is over ``high`` characters is cut, again and again, at the last full
    stop between the bounds, or else at ``high``; what is under ``low`` is dropped.
    """
    heads = F.split(text, r"(?m)(?=^\s*Điều\s+\d)")
    parts = F.when(F.size(heads) >= 3, heads).otherwise(F.split(text, r"\n\s*\n"))
    flat = F.filter(F.transform(parts, lambda p: strip(collapse(p))), lambda p: F.length(p) >= low)

    def step(s: Column, _: Column) -> Column:
        rest = s["rest"]
        window = F.substr(rest, F.lit(low + 1), F.lit(high - low))
        back = F.instr(F.reverse(window), " .")
        cut = F.when(back > 0, low + F.length(window) - back).otherwise(F.lit(high))
        more = F.struct(strip(F.substr(rest, cut + 1)).alias("rest"), F.concat(s["out"], F.array(strip(F.left(rest, cut)))).alias("out"))
        last = F.struct(F.lit("").alias("rest"), F.when(F.length(rest) >= low, F.concat(s["out"], F.array(rest))).otherwise(s["out"]).alias("out"))
        return F.when(F.length(rest) > high, more).otherwise(last)

    def pieces(p: Column) -> Column:
        zero = F.struct(p.alias("rest"), F.array().cast("array<string>").alias("out"))
        return F.aggregate(F.sequence(F.lit(0), F.floor(F.length(p) / low).cast("int")), zero, step, lambda s: s["out"])

    return F.flatten(F.transform(flat, pieces))

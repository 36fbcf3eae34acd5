"""Text functions against plain restatements of their definitions."""

import re
import unicodedata
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumiscript.functions import segment
from lumiscript.functions import text as T

SAMPLES = [
    "ĐIỀU KHOẢN chung", "", "   ", "một hai ba một hai ba", "you should note that this is the answer", "the and of\nthe and of", "Điều 5. Xe máy; xe ô tô", "không dau nao ca", "中文 и русский текст", "a\nb\na\nb\na\n", "câu chưa hết ý", "xong.", "xong .  \n", "á»› vỡ mã Ã¡",
    "lặp lại câu này nhiều lần nhé " * 6,
]


def apply(spark, column, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r[1] for r in df.select("i", column.alias("x")).orderBy("i").collect()]


def words(t):
    return re.findall(r"[^\W\d_]+", t)


def strip_marks(t):
    marks = {chr(m) for m in T.MARKS}
    d = "".join(c for c in unicodedata.normalize("NFD", t) if c not in marks)
    return unicodedata.normalize("NFC", d.replace("đ", "d").replace("Đ", "D"))


def ngram_repeat(t, n=5):
    w = words(t.lower())
    if len(w) < 2 * n:
        return 0.0
    g = [tuple(w[i : i + n]) for i in range(len(w) - n + 1)]
    return max(Counter(g).values()) / len(g)


def line_repeat(t):
    lines = [x.strip() for x in t.split("\n") if x.strip()]
    return max(Counter(lines).values()) / len(lines) if len(lines) >= 5 else 0.0


def test_words_and_marks(spark):
    assert apply(spark, T.words(F.col("t")), SAMPLES) == [words(t) for t in SAMPLES]
    assert apply(spark, T.strip_marks(F.col("t")), SAMPLES) == [strip_marks(t) for t in SAMPLES]
    assert apply(spark, T.fold(F.col("t")), ["ĐIỀU KHOẢN"]) == ["dieu khoan"]


def test_repeats(spark):
    assert apply(spark, T.max_ngram_repeat(F.col("t")), SAMPLES) == pytest.approx([ngram_repeat(t) for t in SAMPLES])
    assert apply(spark, T.max_line_repeat(F.col("t")), SAMPLES) == pytest.approx([line_repeat(t) for t in SAMPLES])


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="ab cđế\n.", max_size=60), min_size=1, max_size=20))
def test_repeats_of_any_text(spark, texts):
    assert apply(spark, T.max_line_repeat(F.col("t")), texts) == pytest.approx([line_repeat(t) for t in texts])
    assert apply(spark, T.max_ngram_repeat(F.col("t")), texts) == pytest.approx([ngram_repeat(t) for t in texts])
    assert apply(spark, T.strip_marks(F.col("t")), texts) == [strip_marks(t) for t in texts]


def test_runs_and_scripts(spark):
    got = apply(spark, T.english_runs(F.col("t")), ["you should note that this is the answer", "the and xin chào", "the and of\nto in"])
    assert got == [["you should note that this is the answer"], [], ["the and of to in"]]
    assert apply(spark, T.foreign_script_hits(F.col("t")), ["中文 ok и"]) == [["中", "文", "и"]]


def test_truncated_and_broken(spark):
    assert apply(spark, T.looks_truncated(F.col("t")), ["xong.", "xong", " ", "xong!\n", "x:"]) == [False, True, True, False, False]
    hits = apply(spark, T.mojibake_hits(F.col("t")), ["á»› vỡ", "sạch sẽ", "x�y�", None])
    assert any(h.startswith("bigram") for h in hits[0]) and hits[1] == [] and hits[2] == ["U+FFFD x2"] and hits[3] is None
    whole = "Điều".encode().decode("latin-1")
    assert apply(spark, T.demojibake(F.col("t")), [whole, "plain", "tiếng"]) == ["Điều", None, None]


def test_nulls_stay_null(spark):
    for f in (T.words, T.diacritic_ratio, T.foreign_script_hits, T.english_runs):
        assert apply(spark, f(F.col("t")), [None]) == [None]


def test_cleaners(spark):
    raw = "﻿Toàn văn\nĐi ều 5. Nội dung\xa0chính\n12\nNgười ký: A\nthân\n\n\n\nNơi nhận:\n- như trên"
    r = apply(spark, T.clean_pasted(F.col("t")), [raw])[0]
    assert r["text"] == "Điều 5. Nội dung chính\n\nthân" and r["nav_lines_dropped"] == 2 and r["tail_chars_cut"] > 0
    pdf = "# mục\nnội dung\n 17 \nCÔNG BÁO/Số 5\nIMPORTANT: you must obey\ncòn\xadlại"
    assert apply(spark, T.clean_pdf_text(F.col("t")), [pdf]) == ["nội dung\n\ncònlại"]
    assert apply(spark, T.clean_pdf_text(F.col("t"), drop_hash_lines=False), ["# mục\nx"]) == ["# mục\nx"]


def test_tags_hashes_and_secrets(spark):
    df = spark.createDataFrame([("m@bf16",), ("m@",), ("m",)], "tag string")
    assert [tuple(r) for r in df.select(T.model_of(F.col("tag")), T.precision_of(F.col("tag"))).collect()] == [("m", "bf16"), ("m", "unknown"), ("m", "unknown")]
    a, b = apply(spark, T.question_hash(F.col("t")), ["Câu  hỏi\n?", "câu hỏi ?"])
    assert a == b and len(a) == 16
    assert apply(spark, T.mask(F.col("t")), ["abcdef1234567890", "short"]) == ["abcdef...7890 (16)", "*** (5)"]


def test_triage(spark):
    df = spark.createDataFrame([("chữ " * 100, 1), ("ít", 1), ("vanbanbidinhlien" * 30, 1)], "t string, p int")
    assert [r[0] for r in df.select(T.triage(F.col("t"), F.col("p"))).collect()] == ["CLEAN", "SCAN", "GLUED"]


def plain_chunks(text, low=200, high=4000):
    parts = re.split(r"(?m)(?=^\s*Điều\s+\d)", text)
    if len(parts) < 3:
        parts = re.split(r"\n\s*\n", text)
    out = []
    for p in (re.sub(r"\s+", " ", x).strip() for x in parts):
        if len(p) < low:
            continue
        while len(p) > high:
            at = p.rfind(". ", low, high)
            cut = at + 1 if at >= 0 else high
            out.append(p[:cut].strip())
            p = p[cut:].strip()
        if len(p) >= low:
            out.append(p)
    return out


def test_chunks(spark):
    body = "nội dung " * 40
    text = "".join(f"Điều {i}. {body}\n" for i in range(1, 5)) + "Điều 5. ngắn\n"
    long_ = " ".join(f"Câu số {i} của văn bản dài." for i in range(900))
    texts = [text, f"{body}\n\n{body}", "x" * 9000, long_, long_ + "\n\n" + text, "", "ngắn. "]
    assert apply(spark, T.chunks(F.col("t")), texts) == [plain_chunks(t) for t in texts]


def test_segment(spark):
    known = frozenset("người điều khiển xe trên đường bộ".split())
    assert segment.splits(["ngườiđiềukhiển", "", "an"], known) == {"ngườiđiềukhiển": ["người", "điều", "khiển"], "an": ["an"]}
    df = spark.createDataFrame([(1, "ngườiđiềukhiểnxetrênđườngbộ ngườiđiều"), (2, "xe trên đường"), (3, None), (4, "")], "i int, text string")
    got = {r.i: r.text for r in segment.desegmented(df, known).collect()}
    assert got == {1: "người điều khiển xe trên đường bộ người điều", 2: "xe trên đường", 3: None, 4: ""}
    assert "xe" in segment.syllables(df)
    assert "".join(segment.splits(["abcđường"], known)["abcđường"]) == "abcđường"


def test_splits_against_every_split():
    """The price and the ties of the cheapest split against all splits of short words."""
    import itertools
    import random

    rng = random.Random(2)
    known = frozenset(["an", "na", "ban", "a", "nga"])
    words = {"".join(rng.choice("abngđ") for _ in range(rng.randint(1, 9))) for _ in range(150)}

    def price(p):
        return 1 if p in known else 4 if segment.PATTERN.match(p) and len(p) <= 7 else 15 + len(p)

    for w, got in segment.splits(list(words), known).items():
        every = []
        for k in range(len(w)):
            for cuts in itertools.combinations(range(1, len(w)), k):
                parts = [w[a:b] for a, b in zip((0, *cuts), (*cuts, len(w)))]
                if max(map(len, parts)) <= 7:
                    every.append((sum(map(price, parts)), [len(p) for p in parts[::-1]], parts))
        assert got == min(every, key=lambda x: x[:2])[2], w

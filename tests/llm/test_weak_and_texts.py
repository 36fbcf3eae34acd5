"""Repetition, pairs, cut-offs and the label model."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumiscript.llm import cutoff, langid, pairs, repetition, weak

WORDS = "hồ sơ thủ tục người dân nộp giấy phép cơ quan trả lời trong ngày làm việc theo quy định mới của xã phường thôn bản".split()
CLASH = {"k": "x", "a": 1, "n": 2, "kind": "y", "_t": "z", "lang": "q", "row": 3, "reason": "r", "s": "s"}


def clash(df):
    for c, v in CLASH.items():
        if c not in df.columns:
            df = df.withColumn(c, F.lit(v))
    return df


def sentence(rng, n=12):
    return " ".join(rng.choice(WORDS) for _ in range(n)).capitalize() + "."


def test_label_model_learns_accuracies():
    rng = np.random.default_rng(1)
    y = rng.random(20000) < 0.2
    acc = (0.95, 0.8, 0.7)
    votes = np.stack([np.where(rng.random(len(y)) < 0.2, -1, np.where(rng.random(len(y)) < a, y, ~y)) for a in acc], 1)
    p, n = np.unique(votes, axis=0, return_counts=True)
    m = weak.fit_patterns(p, n.astype(float), ["a", "b", "c"], trust=0.8)
    assert abs(m.prior - 0.2) < 0.05
    assert m.accuracy[0][0] > m.accuracy[1][0] > m.accuracy[2][0] - 0.02


def test_label_model_on_frames(spark):
    df = spark.createDataFrame([(1, 1), (1, None), (0, 0), (None, 0), (None, None)], "a int, b int")
    m = weak.fit_label_model(df, ["a", "b"])
    got = [r[0] for r in df.select(m.posterior()).collect()]
    assert got[0] > got[1] > got[4] > got[2] and all(0 < x < 1 for x in got)
    assert weak.fit_label_model(df.limit(0), ["a", "b"]).prior > 0


def brute_share(text):
    """Copies of lines after the first among the words, where a line occurs three times or more."""
    lines = [x for x in text.lower().split("\n") if x.strip()]
    total = sum(len(repetition.WORD.findall(x)) for x in lines)
    extra = sum(len(repetition.WORD.findall(x)) for i, x in enumerate(lines) if lines.count(x) >= 3 and x in lines[:i])
    return extra / total


def test_repeat_share(spark):
    rng = random.Random(3)
    plain = [sentence(rng) for _ in range(9)]
    looped = "\n".join([plain[0], plain[1], plain[0], plain[2], plain[0]])
    assert repetition.measure(looped)[6] == pytest.approx(brute_share(looped))
    numbered = f"1. {plain[0]}\n2. {plain[0].upper()}\n3) {plain[0]}"
    assert repetition.measure(numbered)[6] == pytest.approx(2 / 3)
    phrase = " ".join(plain[:2]) + " " + "một hai ba " * 8
    assert repetition.measure(phrase)[5] > 0.4
    assert repetition.measure(" ".join(plain))[6] == 0
    opening = "\n".join(f"Mức phạt là {i} triệu đồng nếu {x}" for i, x in enumerate(WORDS))
    assert repetition.measure(opening)[6] == 0
    dirty = looped.replace("o", "о", 1)  # a Cyrillic letter
    assert repetition.measure(dirty)[6] == pytest.approx(brute_share(looped))
    assert repetition.measure("dài " * 50_000)[6] > 0.99


def brute_back_to_back(ids, least=6):
    out = [False] * len(ids)
    for p in range(1, len(ids) // 2 + 1):
        a = 0
        while a < len(ids) - p:
            b = a
            while b < len(ids) - p and ids[b] == ids[b + p]:
                b += 1
            if b - a >= max(least, 2 * p):
                out[a + p : b + p] = [True] * (b - a)
            a = max(b, a + 1)
    return out


def test_long_periods():
    rng = random.Random(8)
    block = [f"w{i}" for i in range(130)]
    assert repetition.measure(" ".join(block * 4))[6] == pytest.approx(3 / 4)
    assert repetition.measure(" ".join(["đầu", *block * 3, "cuối"]))[6] == pytest.approx(260 / 392)
    assert repetition.measure(" ".join(block * 2))[6] == 0
    for k in range(60):
        part = lambda n, most=40: [rng.randrange(most) for _ in range(n)]
        inner = part(rng.choice((1, 7, 30))) * rng.choice((3, 9, 40)) if k % 3 else part(50)
        block = (part(rng.randint(1, 60)) + inner + part(rng.randint(0, 60), 3))[:200]
        ids = part(rng.randint(0, 90)) + block * rng.randint(2, 5) + block[: rng.randint(0, len(block))] + part(rng.randint(0, 90))
        assert repetition.back_to_back(np.array(ids)).tolist() == brute_back_to_back(ids), k
    assert repetition.measure("dài " * 50_000 + "hết bài")[6] > 0.99


def test_repetition_edges(spark):
    rng = random.Random(5)
    rows = [(i, "\n".join(sentence(rng) for _ in range(6))) for i in range(60)]
    rows += [(100 + i, "\n".join([sentence(rng)] * 6)) for i in range(8)] + [(200, None), (201, ""), (202, " \n"), (203, rows[0][1]), (203, rows[0][1])]
    df = clash(spark.createDataFrame(rows, "gen_id int, output string"))
    m = repetition.repetition_measures(df, ["gen_id"], "output").cache()
    got = {r.gen_id: (r.repetitive, r.repeat_share) for r in repetition.repetitive(m).collect()}
    assert m.count() == len(rows)
    assert all(got[100 + i][0] > 0.5 for i in range(8)) and all(got[i][0] < 0.5 for i in range(60))
    assert got[200] == got[201] == got[202] == (0.0, 0.0)
    assert repetition.repetitive(m.limit(0)).count() == 0


def corpus(n=300, seed=1):
    rng = random.Random(seed)
    forms = ("Hồ sơ của {} được nộp tại {} trong {} ngày.", "Mức phạt đối với {} ở {} là {} triệu đồng.", "Người dân muốn {} thì hỏi {} sau {} giờ.")
    nouns, places = ("giấy phép xây dựng", "đất nông nghiệp", "xe mô tô", "khai sinh quá hạn"), ("phường Hòa", "xã Bình An", "thôn Đông")
    return [" ".join(rng.choice(forms).format(rng.choice(nouns), rng.choice(places), rng.randint(2, 90)) for _ in range(4)) for _ in range(n)]


def test_cut_off(spark):
    texts = corpus()
    rows = [(i, t, "m@a") for i, t in enumerate(texts)]
    cut = {1000: texts[0][:-4], 1001: texts[1].rsplit(" ", 3)[0], 1002: texts[2][:40], 1003: texts[3] + " Hồ sơ của giấy phép xây d", 1004: texts[4] + " Mức�"}
    rows += [(k, t, "m@b") for k, t in cut.items()]
    rows += [(2000 + i, t + "\nTrân trọng", "m@a") for i, t in enumerate(texts[:8])]
    rows += [(3000, None, "m@a"), (3001, "", None), (3002, "...", "m@a"), (3003, texts[5], "m@a"), (3003, texts[5], "m@a")]
    df = clash(spark.createDataFrame(rows, "gen_id int, output string, tag string"))
    got = {r.gen_id for r in cutoff.cut_off(df).collect()}
    assert {1002, 1003, 1004} <= got and not {x for x in got if x < 1000 or x >= 2000}
    rates = {r.tag: (r.n_texts, r.n_cut) for r in cutoff.cut_rates(df, cutoff.cut_off(df)).collect()}
    assert rates["m@b"][0] == 5 and rates["m@a"] == (309, 0)
    assert cutoff.cut_off(df.limit(0)).count() == 0


def test_recurring_torn_endings(spark):
    """A torn ending in many texts, or in copies of one, is no closing phrase; one of whole words is."""
    texts = corpus()
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(1000 + i, t + " Mức phạ") for i, t in enumerate(texts[:8])] + [(1100 + i, t + " Ngườ") for i, t in enumerate(texts[:8])]
    rows += [(1200 + i, texts[9] + " Riêng giấy phép xây dựng nộp hồ sơ của") for i in range(8)]
    rows += [(2000 + i, t + "\nKính chào xã") for i, t in enumerate(texts[:8])]
    df = spark.createDataFrame(rows, "gen_id int, output string")
    got = {r.gen_id for r in cutoff.cut_off(df).collect()}
    assert got == {*range(1000, 1008), *range(1100, 1108), *range(1200, 1208)}


@pytest.fixture(scope="module")
def languages(spark):
    from tests.llm.texts import LANGUAGE_SAMPLES

    df = spark.createDataFrame([(t, k) for k, ts in LANGUAGE_SAMPLES.items() for t in ts], "text string, lang string")
    return langid.fit_languages(df)


def test_pairs(spark, languages):
    rng = random.Random(7)
    qs = [f"Muốn nộp {rng.choice(WORDS)} {rng.choice(WORDS)} tại xã Bình An số {i} thì hỏi ở đâu?" for i in range(200)]
    rows = [(f"k{i}", q, t) for i, (q, t) in enumerate(zip(qs, corpus(200, 2)))]
    bad = {
        "e1": (qs[0], None), "e2": (qs[0], " \n"), "e3": (qs[0], "Trả lời:"), "e4": (qs[0], "..."),
        "r1": (qs[1], "Xin lỗi, tôi không thể hỗ trợ yêu cầu này."), "r2": (qs[1], "Rất tiếc, phần này xin được miễn bình luận."),
        "c1": (qs[2], qs[2].upper()), "c2": (qs[3], f'Bạn hỏi: "{qs[3]}"'),
        "o1": (qs[4], "The office will check the request within ten days after the paper has been sent to the clerk of the village."),
    }
    good = {"g1": (qs[5], "Xin lỗi vì trả lời chậm. " + corpus(1, 9)[0]), "g2": (qs[6], qs[6] + "\n" + corpus(1, 10)[0]), "g3": (None, corpus(1, 11)[0])}
    rows += [(k, *v) for k, v in (bad | good).items()] + [("e1", *bad["e1"])]
    df = clash(spark.createDataFrame(rows, "key string, q string, answer string"))
    found = pairs.defective_pairs(pairs.voted_pairs(df, languages, "key", "q", "answer"), "key").collect()
    got = {(r.key, r.defect) for r in found}
    want = {(k, {"e": "empty", "r": "refusal", "c": "copy", "o": "other_language"}[k[0]]) for k in bad}
    assert want <= got
    assert {(k, d) for k, d in got if d != "truncated"} == want and len(found) == len(got)
    empty = pairs.defective_pairs(pairs.voted_pairs(df.limit(0), languages, "key", "q", "answer"), "key")
    assert empty.count() == 0


def test_languages(spark, languages):
    from tests.llm.texts import HELD_OUT

    m = languages
    for lang, text in HELD_OUT:
        s = m.segments([text])
        assert [langid.LANGS[i] for i in s["lang"]] == [lang], (lang, text)
    mixed = HELD_OUT[0][1] + " " + HELD_OUT[1][1]
    rows = [(1, mixed, "vi-VN"), (2, HELD_OUT[0][1], "EN"), (3, HELD_OUT[0][1], "VI"), (4, None, "vi"), (5, "", None), (6, "123 45", "vi"), (7, HELD_OUT[1][1], "unknown"), (8, HELD_OUT[0][1] + " computer", "vie"), (3, HELD_OUT[0][1], "VI")]
    df = clash(spark.createDataFrame(rows, "doc_id int, text string, label string"))
    found = langid.document_languages(df, m, ["doc_id", "label"])
    got = {r.doc_id: (r.main, sorted(r.langs)) for r in langid.mislabelled(found, "label").collect()}
    assert got == {1: ("vi", ["en", "vi"]), 2: ("vi", ["vi"]), 7: ("en", ["en"])}
    seg = langid.language_segments(df, m, ["doc_id"]).filter("doc_id = 1").orderBy("seg").collect()
    assert [r.lang for r in seg] == ["vi", "en"] and all(0.5 < r.confidence <= 1 for r in seg)
    assert langid.language_segments(df.limit(0), m, ["doc_id"]).count() == 0
    with pytest.raises(ValueError):
        langid.fit_languages(spark.createDataFrame([("một hai", "vi")], "text string, lang string"))
    labels = ["vi", "VI", "vi-VN", "vi_VN", "vie", "unknown", "und", "", None, " en ", "english"]
    got = [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(labels)], "i int, x string").orderBy("i").select(langid.normal_label(F.col("x"))).collect()]
    assert got == ["vi"] * 5 + [None] * 4 + ["en", None]

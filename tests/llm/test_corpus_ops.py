"""Consensus, scans, look-alikes, packing, leakage and subjects."""

import itertools
import random
import unicodedata

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lumiscript.llm import confusables, consensus, leakage, packing, scans, subjects
from tests.llm.test_weak_and_texts import clash, corpus

# --- consensus ----------------------------------------------------------------


def label_rows(seed=3, items=400):
    rng = random.Random(seed)
    truth, rows = {}, []
    skill = {"A1": 0.95, "A2": 0.95, "A3": 0.93, "B1": 0.5, "B2": 0.4}
    for i in range(items):
        truth[i] = rng.random() < 0.3
        for a in rng.sample(sorted(skill), 3):
            v = truth[i] if rng.random() < skill[a] else not truth[i]
            rows.append((f"i{i}", "m@x", rng.choice([a, a.lower(), a + " "]), {"E1": v}, i))
    return truth, rows


LABELS = "id string, tag string, annotator string, labels map<string,boolean>, t int"


def labels_frame(spark, rows):
    return spark.createDataFrame(rows, LABELS).withColumn("labelled_at", F.timestamp_seconds(F.col("t"))).drop("t")


def test_consensus_beats_majority(spark):
    truth, rows = label_rows()
    df = labels_frame(spark, rows)
    items, people = consensus.consensus(clash(df))
    got = {int(r.id[1:]): r.holds for r in items.collect()}
    votes = {}
    for i, _, _, m, _ in rows:
        votes.setdefault(int(i[1:]), []).append(m["E1"])
    major = {i: sum(v) * 2 > len(v) for i, v in votes.items()}
    right = lambda d: sum(d[i] == truth[i] for i in truth)
    assert right(got) >= right(major) + 10 and right(got) > 0.9 * len(truth)
    s = {r.annotator: (r.sensitivity + r.specificity) / 2 for r in people.collect()}
    assert min(s["A1"], s["A2"], s["A3"]) > 0.85 > 0.7 > max(s["B1"], s["B2"])


def test_consensus_edges(spark):
    q = lambda v: {"a": v == "a", "b": v == "b"}
    rows = [("1", "qa", "X", q("a"), 1), ("1", "qa", "Y", q("b"), 1), ("2", "qa", "X", q("a"), 1), ("2", "qa", "X", q("b"), 2), ("2", "qa", "X", q("b"), 2), ("3", "m@x", "X", None, 1), (None, "m@x", "X", {"E1": True}, 1), ("4", None, "X", {"E1": True}, 1), ("5", "m@x", " ", {"E1": True}, 1), ("6", "m@x", "X", {"E1": None}, 1), ("7", "m@x", "X", {"E1": True}, 1), ("7", "m@x", "Y", {"E1": True, "E2": False}, 1)]
    items, _ = consensus.consensus(labels_frame(spark, rows))
    got = {(r.id, r.code) for r in items.filter("holds").collect()}
    assert len([x for x in got if x[0] == "1"]) == 1 and ("2", "b") in got and ("2", "a") not in got and ("7", "E1") in got
    assert {r.id for r in items.collect()} == {"1", "2", "7"}
    none, people = consensus.consensus(labels_frame(spark, rows).limit(0))
    assert none.count() == 0 and people.count() == 0 and consensus.agreement(labels_frame(spark, rows).limit(0)).count() == 0


# --- scans --------------------------------------------------------------------


def scanned_corpus():
    texts = [(f"u{i}", t) for i, t in enumerate(corpus(200, 4))]
    header = "CÔNG BÁO SỐ 12 - TRANG LUẬT"
    bad = [
        ("h1", f"Hồ sơ của giấy phép xây dựng được nộp tại phư-\nờng Hòa trong 5 ngày."),
        ("p1", "Hồ sơ của xe mô tô được nộp tại\ntr. 12\nphường Hòa trong 6 ngày."),
        ("r1", f"Hồ sơ của xe mô tô được nộp tại\n{header} | 14\nphường Hòa trong 7 ngày."), ("r2", f"Hồ sơ của xe mô tô được\n{header}\nnộp tại phường Hòa trong 7 ngày."), ("r3", f"{header}\nHồ sơ của xe mô tô được nộp tại phường Hòa trong 9 ngày."),
        ("m1", "Hồ sơ của giấy pliép xây dựng được riộp tại phường Hòa trong 8 ngày."),
        ("own", "Theo quyết định 5/NĐ-\nCP hồ sơ của xe mô tô được nộp tại phường Hòa trong 3 ngày."),
    ]
    tables = [(f"t{i}", f"Hồ sơ của xe mô tô được nộp tại phường Hòa trong 4 ngày.\nBản chính:\n{i}\nBản sao:\n2") for i in range(6)]
    return texts + bad + tables + [("n", None), ("e", ""), ("b", " \n "), ("h1", bad[0][1])]


def test_scans(spark):
    df = clash(spark.createDataFrame(scanned_corpus(), "unit_id string, text string"))
    found = scans.noise(df, ["unit_id"])
    got = {(r.unit_id, r.kind) for r in scans.noise_kinds(found, ["unit_id"]).collect()}
    assert got == {("h1", "hyphen_break"), ("p1", "page_number"), ("r1", "running_header"), ("r1", "page_number"), ("r2", "running_header"), ("r3", "running_header"), ("m1", "misread")}
    text = {r.unit_id: r.text for r in scans.repaired(df, found, ["unit_id"]).collect()}
    assert text["h1"] == "Hồ sơ của giấy phép xây dựng được nộp tại phường Hòa trong 5 ngày."
    assert text["p1"] == "Hồ sơ của xe mô tô được nộp tại phường Hòa trong 6 ngày."
    assert text["r1"] == "Hồ sơ của xe mô tô được nộp tại phường Hòa trong 7 ngày." and text["r2"] == text["r1"]
    assert text["m1"] == "Hồ sơ của giấy phép xây dựng được nộp tại phường Hòa trong 8 ngày."
    assert "5/NĐ-" in text["own"] and "Bản chính:\n3" in text["t3"]
    assert text["n"] is None and text["e"] == "" and text["b"] == " \n "


def test_scans_of_nothing(spark):
    df = spark.createDataFrame([], "unit_id string, text string")
    found = scans.noise(df, ["unit_id"])
    assert scans.noise_kinds(found, ["unit_id"]).count() == 0 and scans.repaired(df, found, ["unit_id"]).count() == 0


def test_glyph_edits():
    """Edits in any number are counted, and texts that edits lead from one to the other are spelt alike."""
    assert scans.glyph_edits("pliép", "phép") == 1 and scans.glyph_edits("rnuốri", "muốn") == 2 and scans.glyph_edits("phép", "pliép") is None
    assert scans.glyph_edits("xyz", "xyz") == 0 and scans.glyph_edits("", "a") is None
    rng = random.Random(3)
    for _ in range(300):
        word = "".join(rng.choice("mnhđdươêôâwutcgoilsb") for _ in range(rng.randint(1, 40)))
        token, n = "", 0
        for c in word:
            wrong = [a for a, b in scans.GLYPHS if b == c]
            if wrong and rng.random() < 0.6:
                token, n = token + rng.choice(wrong), n + 1
            else:
                token += c
        assert token.translate(scans.SPELLING) == word.translate(scans.SPELLING) and scans.glyph_edits(token, word) <= n


def test_context_chooses_among_candidates(spark):
    """Of two candidates the one that suits the neighbours is taken, and one that its context speaks against is none."""
    notes = spark.createDataFrame([("u1", "odd", "cliện", ["đèn"]), ("u2", "odd", "cliện", ["mặt"]), ("u3", "odd", "rnai", ["mặt"]), ("u4", "odd", "rnai", None)], "unit_id string, kind string, a string, context array<string>")
    links = spark.createDataFrame([("cliện", "điện", 10, 1), ("cliện", "diện", 90, 1), ("rnai", "mai", 50, 1)], "token string, word string, word_n bigint, edits int")
    vectors = spark.createDataFrame([("đèn", [1.0, 0.0]), ("mặt", [0.0, 1.0]), ("điện", [1.0, 0.0]), ("diện", [0.0, 1.0]), ("mai", [0.6, -0.8])], "w string, vector array<double>")
    got = {r.unit_id: r.word for r in scans.corrections(notes, links, vectors, ["unit_id"]).collect()}
    assert got == {"u1": "điện", "u2": "diện", "u4": "mai"}


# --- look-alikes --------------------------------------------------------------

DIRTY = {
    "nfd": (unicodedata.normalize("NFD", "Điều kiện nộp hồ sơ"), "Điều kiện nộp hồ sơ"),
    "order": ("tiệ̂n".replace("ê", "e"), unicodedata.normalize("NFC", "tiện")),
    "wide": ("số ２３ và ｐｈố", "số 23 và phố"),
    "zero": ("ph​ường xã", "phường xã"),
    "nbsp": ("một\xa0hai ba", "một hai ba"),
    "hyphen": ("TT‑BGX", "TT-BGX"),
    "cyrillic": ("gіữa năm сhở", "giữa năm chở"),
    "greek": ("Τhủ tục", "Thủ tục"),
    "eth": ("ðồng", "đồng"),
    "alone": ("đi а về", "đi a về"),
    "comma": ("năm 2031， nộp", "năm 2031, nộp"),
}
CLEAN = {"vi": "Điều 5 – nộp “hồ sơ” 12 m² tại xã…", "ru": "Нужно хранить документ", "word": "một закон mới", "zh": "根据说明，两种文件并不相同。", "broken": "Ã\xa0 vỡ má»\xa0", "fr": "déjà vu à l'été", "empty": "", "null": None}


def test_lookalikes(spark):
    rows = [(k, v[0]) for k, v in DIRTY.items()] + list(CLEAN.items()) + [("nfd", DIRTY["nfd"][0])]
    df = clash(spark.createDataFrame(rows, "rec_id string, text string"))
    got = {r.rec_id for r in confusables.lookalike_records(df, ["rec_id"]).collect()}
    assert got == {*DIRTY}
    text = {r.rec_id: r.text for r in confusables.consistent_form(df.distinct(), ["rec_id"]).collect()}
    assert all(text[k] == want for k, (_, want) in DIRTY.items())
    assert all(text[k] == v for k, v in CLEAN.items())
    assert confusables.lookalike_records(df.limit(0), ["rec_id"]).count() == 0


def test_composition_is_unicode_nfc(spark):
    """Against the standard library, for texts of composable letters in any order of their marks."""
    rng = random.Random(2)
    marks = "̛̣̀́̂̆̉̃"
    rows = [(i, "".join(rng.choice("aeoubc ") + "".join(rng.sample(marks, rng.randint(0, 3))) for _ in range(12))) for i in range(80)]
    df = spark.createDataFrame(rows, "i int, text string")
    got = {r.i: r.text for r in confusables.consistent_form(df, ["i"]).collect()}
    assert all(got[i] == unicodedata.normalize("NFC", t) for i, t in rows)


def test_long_token(spark):
    df = spark.createDataFrame([(1, "x" * 3000 + "а" + "y" * 3000)], "i int, text string")
    assert confusables.consistent_form(df, ["i"]).first().text == "x" * 3000 + "a" + "y" * 3000


# --- packing ------------------------------------------------------------------


def test_best_fit_constraints():
    rng = np.random.default_rng(1)
    size = rng.integers(1, 400, 3000)
    cluster = np.where(rng.random(3000) < 0.05, rng.integers(0, 40, 3000), np.arange(3000) + 100)
    source = rng.integers(0, 4, 3000)
    box = packing.best_fit(size, source, cluster, 512, {1: 1 << 2, 2: 1 << 1})
    fill = np.bincount(box, size)
    assert fill.max() <= 512 and fill.sum() / (512 * len(fill)) > 0.98
    for b in range(len(fill)):
        own = box == b
        assert len(set(cluster[own])) == own.sum() and not {1, 2} <= set(source[own].tolist())


def test_best_fit_is_tight_on_small_cases():
    for items in itertools.product((2, 3, 5), repeat=5):
        size = np.array(items)
        box = packing.best_fit(size, np.zeros(5, int), np.arange(5), 10)
        assert np.bincount(box, size).max() <= 10 and box.max() + 1 <= -(-size.sum() // 10) + 1


def test_hot_cluster():
    size, cluster = np.full(900, 50), np.where(np.arange(900) < 300, 7, np.arange(900) + 10)
    box = packing.best_fit(size, np.zeros(900, int), cluster, 500)
    n = np.bincount(box[cluster == 7], minlength=box.max() + 1)
    assert box.max() + 1 <= 92 and n.max() <= 4


def test_packing(spark):
    rows = [(i, t, "s%d" % (i % 3)) for i, t in enumerate(corpus(120, 6))] + [(500, "từ " * 3000, "s1"), (501, None, "s1"), (502, "", None), (503, corpus(1, 6)[0], None)]
    df = clash(spark.createDataFrame(rows, "doc_id int, text string, source string"))
    packs = spark.createDataFrame([(1, "a", 256), (2, "b", 1024), (3, "zero", 0), (4, "null", None)], "pack_id int, pack_name string, capacity_tokens long")
    out = packing.packed(df, packs, block_items=40).toPandas()
    assert set(out.pack_id) == {1, 2} and not {501, 502} & set(out.doc_id)
    for pack, cap in ((1, 256), (2, 1024)):
        p = out[out.pack_id == pack]
        assert p.groupby("container_id").n_tokens.sum().max() <= cap
        total = p.groupby("doc_id").n_tokens.sum()
        enc = packing.encoding(packing.TOKENIZER)
        assert all(total[i] == len(enc.encode_ordinary(t)) for i, t, _ in rows if t)
        split = p.groupby("doc_id").size()
        assert all(split[i] == -(-total[i] // cap) for i in split.index)
    assert packing.packed(df.limit(0), packs).count() == 0 and packing.packed(df, packs.limit(0)).count() == 0


# --- leakage ------------------------------------------------------------------


def edit(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, d[0] = d[0], i
        for j, y in enumerate(b, 1):
            prev, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, prev + (x != y))
    return d[-1]


def brute_leak(item, doc, part=28, one_in=9):
    a, b = leakage.word_list(item), leakage.word_list(doc)
    need = min(len(a), part)
    e = need // one_in
    if not a:
        return False
    return any(edit(a[s : s + need], b[t : t + n]) <= e for s in range(len(a) - need + 1) for n in range(need - e, need + e + 1) for t in range(0, max(0, len(b) - n) + 1))


def test_leaks_against_brute_force(spark):
    rng = random.Random(11)
    vocab = [f"tu{i}" for i in range(40)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice((5, 12, 20, 34))))) for i in range(6)]
    docs = []
    for k in range(60):
        w = rng.choice(items)[1].split()
        n = rng.choice((len(w), 28, 26, 20))
        s = rng.randint(0, max(0, len(w) - n))
        w = w[s : s + n]
        for _ in range(rng.randint(0, 5)):
            p = rng.randrange(len(w))
            w = rng.choice((w[:p] + w[p + 1 :], w[:p] + ["moi"] + w[p:], w[:p] + ["khac"] + w[p + 1 :]))
        docs.append((k, " ".join([rng.choice(vocab) for _ in range(6)] + w + [rng.choice(vocab) for _ in range(6)])))
    d = clash(spark.createDataFrame(docs, "doc_id int, text string"))
    it = spark.createDataFrame(items, "item_id int, text string")
    got = {(r.doc_id, r.item_id) for r in leakage.leaked_items(d, it).collect()}
    assert got == {(k, i) for k, t in docs for i, x in items if brute_leak(x, t)}
    assert got == {(r.doc_id, r.item_id) for r in leakage.leaked_items(d, it, blocks=3).collect()}


def test_long_parts_have_more_edits():
    """One edit in nine of the whole part, against brute force over parts of every length."""
    rng = random.Random(5)
    item = [f"tu{i}" for i in range(60)]
    docs = []
    for k in range(120):
        n = rng.choice((36, 37, 40, 45, 50, 54, 60))
        s = rng.randint(0, 60 - n)
        w = item[s : s + n]
        edits = n // 9 + rng.randint(0, 1)
        for p in sorted(rng.sample(range(1, n - 1), edits) if k % 2 else [round((j + 1) * n / (edits + 1)) for j in range(edits)], reverse=True):
            w[p : p + 1] = rng.choice((["khac"], [], [w[p], "moi"]))
        docs.append(" ".join(w))
    docs.append(" ".join("khac" if i in (9, 15, 21, 26) else w for i, w in enumerate(item[:36])))
    index = leakage.ItemIndex([(1, " ".join(item))])
    got = set(leakage.find(index, docs)[0].tolist())

    def leak(b, first=28):
        """The edit distance to the nearest part of the document, for each end of a part of the item from each place on."""
        for s in range(len(item) - first + 1):
            d = [0] * (len(b) + 1)
            for i, x in enumerate(item[s:], 1):
                prev, d[0] = d[0], i
                for j, y in enumerate(b, 1):
                    prev, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, prev + (x != y))
                if i >= first and min(d) <= i // 9:
                    return True
        return False

    assert got == {k for k, t in enumerate(docs) if leak(t.split())} and len(docs) - 1 in got and len(got) < len(docs)


def test_leak_forms(spark):
    item = " ".join(f"Chữ{i} đẹp" for i in range(20)) + "."
    docs = [(1, "mở đầu, " + item.upper().replace(".", " !") + " hết"), (2, leakage.folded(item).replace(" ", "\n  ")), (3, " ".join(item.split()[:20])), (4, None), (5, ""), (1, "mở đầu, " + item.upper())]
    d = spark.createDataFrame(docs, "doc_id int, text string")
    it = spark.createDataFrame([(7, item), (8, None), (9, ""), (7, item)], "item_id int, text string")
    assert sorted(tuple(r) for r in leakage.leaked_items(d, it).collect()) == [(1, 7), (2, 7)]
    assert leakage.leaked_items(d.limit(0), it).count() == 0 and leakage.leaked_items(d, it.limit(0)).count() == 0
    with pytest.raises(ValueError):
        leakage.leaked_items(d, spark.createDataFrame([(i, f"chữ {i}") for i in range(5)], "item_id int, text string"), item_rows=3).count()


# --- subjects -----------------------------------------------------------------

TOPICS = {"sport": ("đội bóng đá", "vận động viên", "huy chương vàng", "trận chung kết"), "tax": ("hoàn thuế", "hóa đơn điện tử", "mã số thuế", "tờ khai thuế"), "land": ("đất nông nghiệp", "sổ địa chính", "thửa ruộng lúa", "ranh giới đất")}
FRAMES = ("Theo báo cáo năm nay, {} và {} tăng so với năm trước.", "Người dân ở xã hỏi về {} trước khi nộp {}.", "Cán bộ phường kiểm tra {} cùng với {} trong tuần.")


def topic_text(rng, topic, n):
    return " ".join(rng.choice(FRAMES).format(*rng.sample(TOPICS[topic], 2)) for _ in range(n))


def test_subjects(spark):
    rng = random.Random(4)
    samples = spark.createDataFrame([(topic_text(rng, t, 3), t, "vi") for t in TOPICS for _ in range(8)], "text string, subject string, lang string")
    docs, want = [], {}
    for i in range(90):
        own = rng.sample(sorted(TOPICS), rng.choice((1, 1, 2)))
        docs.append((i, " ".join(topic_text(rng, t, 6) for t in own)))
        want[i] = {*own}
    docs += [(200, "Xin cảm ơn đã ghé thăm trang này. Nội dung đang chờ bổ sung thêm nữa."), (201, None), (202, ""), (203, topic_text(rng, "tax", 11) + " " + topic_text(rng, "sport", 1)), (0, docs[0][1])]
    df = spark.createDataFrame(docs, "doc_id int, text string")
    model = subjects.fit_subjects(samples, df.withColumnRenamed("doc_id", "id"))
    out = subjects.document_subjects(clash(df), model, ["doc_id"])
    got = {}
    for r in out.collect():
        got.setdefault(r.doc_id, set()).add(r.subject)
    right = sum(got.get(i) == w for i, w in want.items())
    assert right >= 0.95 * len(want) and got[203] == {"tax"} and not {200, 201, 202} & set(got)
    assert subjects.document_subjects(df.limit(0), model, ["doc_id"]).count() == 0
    none = subjects.fit_subjects(samples.limit(0), df.withColumnRenamed("doc_id", "id"))
    assert subjects.document_subjects(df, none, ["doc_id"]).count() == 0


def test_spread_counts_every_text_once(spark):
    """Against the slow way, over more texts than the bounded sample has, one of them in many copies."""
    rng = random.Random(9)
    texts = [topic_text(rng, rng.choice(sorted(TOPICS)), 3) for _ in range(300)] + ["Tiêu đề\nMột hai ba bốn năm. Hai.", "根据说明，两种文件并不相同。今年共有许多材料。", ""]
    items = {i for t in texts[:200] + texts[300:] for w in subjects.sentences(t) for i in w}
    want = subjects.Counter(i for t in {*texts} for i in {i for w in subjects.sentences(t) for i in w} & items)
    df = spark.createDataFrame([(t,) for t in texts + [texts[0]] * 100 + [None]], "text string")
    assert subjects.text_spread(df, items) == want and subjects.text_spread(df, set()) == {}
    assert subjects.text_spread(df.limit(0), items) == {}


def test_matching_against_brute_force():
    """A rule matches a sentence if one of its runs has all the rule's words."""
    rng = random.Random(5)
    words = [f"w{i}" if i % 2 else chr(97 + i) * 2 for i in range(12)]
    words = [w.translate(str.maketrans("0123456789", "abcdefghij")) for w in words]
    rules = [(tuple(sorted(rng.sample(words, k))), rng.randrange(2), 1.0) for k in (1, 2, 3) for _ in range(25)]
    model = subjects.SubjectModel(["a", "b"], rules)
    texts = [" ".join(" ".join(rng.choice(words) for _ in range(rng.randint(4, 17))) + "." for _ in range(3)) for _ in range(40)] + ["", None, "Một dòng\n"]
    row, score, count = model.evidence(texts, matches=True)
    want = []
    for i, t in enumerate(texts):
        for s in subjects.sentences(t) if t else ():
            own = [{*r} for r in subjects.runs(s)]
            want.append((i, [sum(any({*items} <= r for r in own) for items, x, _ in {*rules} if x == k) for k in (0, 1)]))
    assert row.tolist() == [i for i, _ in want] and (count <= score + 1e-9).all()
    assert [[int(v) for v in c] for c in count] == [c for _, c in want]


def test_chunks_are_looked_up_once_a_batch():
    """What stands between blanks is looked up once for all its occurrences; the numbers are those of each text read by itself."""

    class Counted(dict):
        looked = 0

        def get(self, *key):
            Counted.looked += 1
            return super().get(*key)

    model = subjects.SubjectModel(["a"], [((w,), 0, 1.0) for w in ("mot", "hai", "file", "本")])
    texts = ["", None, "Một hai ba. Số 1.900.000 và 12. Hai", "Tiêu đề một\nMột hai\tba bốn năm.\n", "Mo\u0323\u0302t hai. \u0301hai mot", "这本书很好。 本…", "  hai  . mot?! 3.. 7/5/2034\n\n"] * 60
    texts += ["file"] * 500
    model.numbers(["."])
    model.memo = Counted(model.memo)
    want = [(v, i) for i, t in enumerate(texts) for v in (*model.chunk_numbers(subjects.composed(t)), subjects.LINE if t and "\n" in t else subjects.STOP)]
    assert [*zip(*(x.tolist() for x in model.numbers(texts)))] == want
    chunks = [c for t in texts if t for c in t.replace("\n", " \n ").split(" ")]
    assert Counted.looked <= 2 * len({*chunks}) + 2 < len(chunks) / 20
    batch = pa.array(["mot.", *texts, "hai."])
    assert [x.tolist() for x in model.numbers(batch.slice(1, len(texts)))] == [x.tolist() for x in model.numbers(texts)]
    assert [len(x) for x in model.numbers([])] == [0, 0]
    assert subjects.sorted_distinct(np.array([3, 1, 3, 2, 1])).tolist() == [1, 2, 3] and len(subjects.sorted_distinct(np.zeros(0, np.int64))) == 0


def test_subject_keys_stay_whole(spark):
    """Large numbers beside a null key aren't rounded."""
    model = subjects.SubjectModel(["a"], [((w,), 0, 6.0) for w in ("mot", "hai", "ba", "bon")])
    keys = [2**60 + 1, None, 2**53 + 1]
    df = spark.createDataFrame([(k, "một hai ba bốn. một hai ba bốn.") for k in keys], "doc_id bigint, text string").coalesce(1)
    rows = subjects.document_subjects(df, model, ["doc_id"]).collect()
    assert {(r.doc_id, r.subject, r.share, r.n_sentences) for r in rows} == {(k, "a", 1.0, 2) for k in keys}


def test_too_many_rules_raise(spark):
    rows = [["\0" + s, f"{s}{i % 4}", f"{s}{i % 3}x"] for s in ("a", "b") for i in range(24)]
    frame = spark.createDataFrame([(r,) for r in rows], "items array<string>")
    n = len(subjects.mine(frame, 2, 0.55, 1000))
    assert n > 2 and len(subjects.mine(frame, 2, 0.55, n)) == n
    with pytest.raises(ValueError):
        subjects.mine(frame, 2, 0.55, n - 1)
    assert subjects.mine(frame.limit(0), 2, 0.55, 10) == []


def test_redundant_rules_are_pruned():
    odds = {(("a",), "x"): (0.9, 2.0), (("a", "b"), "x"): (0.93, 2.2), (("b", "c"), "x"): (0.97, 3.0), (("b",), "x"): (0.8, 1.0), (("a", "b", "c"), "x"): (0.99, 4.0)}
    assert {r[0] for r in subjects.pruned(odds, 10)} == {("a",), ("b",), ("b", "c")}

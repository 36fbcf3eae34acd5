"""Problem 6: broken prompt and response pairs, each with its defects.

For every defect several noisy labelling functions vote or abstain on a pair;
none of them sees the whole of a defect. An expectation-maximization label model
(see ``weak``) weighs them, and a pair keeps every defect whose posterior reaches
the defect's cutoff. The cutoff is validated on a held-out half: the model of one
half of the pairs judges the other half, and the cutoff with the best F1 there,
by what the other half's own model believes, is taken.

The votes on a pair are one map over the rows; those on truncation come from
the corpus statistics of ``cutoff``. Only the counts of vote patterns go to the
driver, from one aggregate for all defects.

Defined results: a null or blank response is ``empty`` and has no other defect;
a null or blank prompt leaves ``copy`` and ``other_language`` undecided (no
vote); repeated rows give a defect once.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumiscript.llm.common import FOLD, bounded_rows, checkpointed, folded
from lumiscript.llm.confusables import plain_text
from lumiscript.llm.cutoff import cut_off
from lumiscript.llm.langid import LANGS, LangModel
from lumiscript.llm.weak import LabelModel, fit_patterns

DEFECTS = {
    "empty": ["e_blank", "e_label", "e_short", "e_marks"],
    "truncated": ["t_trie", "t_torn", "t_short", "t_rare", "t_stop", "t_reason"],
    "refusal": ["r_unable", "r_policy", "r_open", "r_share", "r_brief", "r_topic"],
    "copy": ["c_bag", "c_new", "c_pairs", "c_length"],
    "other_language": ["o_first", "o_last", "o_whole", "o_marks", "o_script"],
}
#: The rates that EM starts from.
PRIORS = {"empty": 0.03, "truncated": 0.12, "refusal": 0.03, "copy": 0.03, "other_language": 0.05}

#: The functions on truncation by the reasons of ``cutoff``.
CUT_REASONS = {"t_trie": ("inside a word",), "t_torn": ("torn character", "open punctuation"), "t_short": ("short sentence",), "t_rare": ("rare ending",)}

# Fixed values, folded: labels that say nothing, marks of a refusal, openings of one.
LABELS = re.compile(r"\b(?:tra loi|dap an|cau tra loi|answer|response|output|ket qua|noi dung|n\s*/?\s*a|null|none|khong co|nan)\b\s*[:.]?")
UNABLE = re.compile(
    r"khong the (?:ho tro|tra loi|giup|cung cap|thuc hien|dap ung|tu van|dua ra|giai dap|ban)|khong co kha nang|khong du kha nang|khong tien|minh chiu\b"
    r"|(?:can\s?not|can't|unable to|not able to|won't) ?(?:help|assist|answer|provide|give|comply|respond|discuss|do)?|je ne peux pas|no puedo|не могу|无法|不便"
)
POLICY = re.compile(
    r"khong (?:duoc phep|tra loi|cung cap|giai dap|tu van|ban toi|ban den|ho tro)|chua duoc phep|tu choi|khuoc tu|(?:nam )?ngoai pham vi|mien (?:binh luan|tra loi|ban)|bo qua nhung cau|khong phai viec|dung o day|khong di vao noi dung|xin phep khong"
    r"|(?:not allowed to|must decline|have to decline|decline to|refuse to) ?(?:help|assist|answer|provide|give|comply|respond|discuss|do)?|outside (?:of )?my scope|je refuse|me niego|отказываюсь|不能提供|拒绝"
)
OPEN = re.compile(r"^\W*(?:xin loi|rat tiec|thanh that xin loi|voi vai tro|toi xin phep|that tiec|tiec la|i am sorry|i'm sorry|sorry|unfortunately|as an? (?:ai|assistant|language)|desole|lo siento|извините|к сожалению|抱歉|对不起|很遗憾)")
SENTENCE = re.compile(r"(?<=[.!?…])\s+|(?<=[。！？])|\n+")
WORDS = re.compile(r"[㐀-鿿]|[^\W_㐀-鿿]+")
MARKED = re.compile("[" + "".join(sorted(chr(c) for c in FOLD if chr(c).isalpha())) + "]")
NOT_LATIN = re.compile("[^\x00-\u024f\u0300-\u036f\u1e00-\u1eff\u2010-\u2026]")
OTHER_SCRIPT = re.compile("[\u0370-\u1cff\u2e80-\ud7ff\uf900-\ufaff]")
STOPPED = re.compile(r"[.!?。！？…]$")
NUMBER_STOP = re.compile(r"\d\.$")


def plainly(text: str) -> str:
    """Folded; a text in Latin letters takes the short way over its decomposition."""
    low = text.lower()
    if NOT_LATIN.search(low):
        return folded(low)
    return unicodedata.normalize("NFD", low.replace("đ", "d").replace("…", "...")).encode("ascii", "ignore").decode()


def between(value: float, high: float, low: float) -> int | None:
    """1 from ``high`` on, 0 up to ``low``, else no vote."""
    return 1 if value >= high else 0 if value <= low else None


@lru_cache(maxsize=20_000)
def prompt_words(prompt: str) -> tuple[list[str], frozenset[str], frozenset[tuple[str, str]]]:
    """The words of a prompt, the different ones, and its pairs; a prompt is asked of many models."""
    q = WORDS.findall(plainly(plain_text(prompt)))
    return q, frozenset(q), frozenset(zip(q, q[1:]))


def pair_votes(prompt: str | None, response: str | None) -> dict:
    """The votes that need the two texts only; missing or null ones abstain."""
    a = plain_text(response) if response else ""
    f = plainly(a)
    words = WORDS.findall(f)
    if not words:
        return {"e_blank": 1, "e_marks": 1, "e_short": 1}
    v: dict[str, int | None] = {"e_blank": 0}
    rest = WORDS.findall(LABELS.sub(" ", f)) if len(words) < 12 else words
    v["e_label"] = int(not rest)
    v["e_short"] = between(-len(words), -6, -10)
    v["e_marks"] = between(-sum(map(len, words)) / len(re.sub(r"\s+", "", f)), -0.5, -0.9)
    # Refusal: what counts is how much of the response refuses, not that it apologises.
    unable, policy = bool(UNABLE.search(f)), bool(POLICY.search(f))
    opened = bool(OPEN.match(f))
    v["r_unable"], v["r_policy"], v["r_open"] = (1 if x else None for x in (unable, policy, opened))
    refusing = sum(len(WORDS.findall(x)) for x in SENTENCE.split(f) if UNABLE.search(x) or POLICY.search(x)) if unable or policy else 0
    v["r_share"] = between(refusing / len(words), 0.6, 0.4)
    v["r_brief"] = 0 if len(words) > 40 else 1 if opened else None
    q, own, pairs = prompt_words(prompt) if prompt else ((), frozenset(), frozenset())
    if len(q) >= 3:
        extra = sum(w not in own for w in words)
        cover = 1 - extra / len(words)
        v["r_topic"] = 0 if cover >= 0.5 else None  # it takes the question up
        v["c_bag"] = between(cover, 0.7, 0.6)
        v["c_new"] = between(-extra, -4, -7)
        v["c_pairs"] = between(len(pairs.intersection(zip(words, words[1:]))) / max(1, len(pairs)), 0.6, 0.3)
        v["c_length"] = 0 if len(words) > 1.6 * len(q) + 4 else 1 if len(words) >= 0.4 * len(q) else None
    return v


def script_of(text: str, marked: int) -> int:
    """The prevailing script of a text with ``marked`` letters of Vietnamese: 0 Latin, 1 Latin with those marks, 2 another; -1 without letters."""
    n = sum(map(str.isalpha, text))
    if not n:
        return -1
    return 2 if len(OTHER_SCRIPT.findall(text)) > 0.5 * n else int(marked >= 0.08 * n)


def language_votes(model: LangModel, prompts: list[str], responses: list[str]) -> list[dict]:
    """Votes on whether the response is mainly in another language than the prompt: by its halves, the whole, its marks and its script."""
    n = len(prompts)
    lang, margin, size = model.halves([*prompts, *responses])
    out = []
    vi = LANGS.index("vi")
    for i in range(n):
        v: dict[str, int] = {}
        j = n + i
        if size[i] >= 3 and size[j] >= 3 and margin[i, 2] >= 0.1:
            own = lang[i, 2]
            for name, k, least in (("o_first", 0, 0.1), ("o_last", 1, 0.1), ("o_whole", 2, 0.3)):
                if margin[j, k] >= least:
                    v[name] = int(lang[j, k] != own)
            texts = (prompts[i], responses[i])
            marked = [len(MARKED.findall(t)) for t in texts]
            marks = [k / max(1, len(t)) for k, t in zip(marked, texts)]
            if marks[0] >= 0.08:  # Vietnamese with its marks
                if marks[1] >= 0.08:
                    v["o_marks"] = 0
                elif marks[1] < 0.04 and lang[j, 2] != vi:
                    v["o_marks"] = 1
            if any(map(OTHER_SCRIPT.search, texts)):
                a, b = (script_of(t, k) for t, k in zip(texts, marked))
                if max(a, b) == 2:
                    v["o_script"] = int(a != b)
        out.append(v)
    return out


def voted_pairs(df: DataFrame, model: LangModel, key: str, prompt: str, response: str, reason: str | None = None) -> DataFrame:
    """key and a column for each labelling function (null: it abstains); one row per row of ``df``."""
    bc = df.sparkSession.sparkContext.broadcast(model)
    names = [x for k in ("empty", "refusal", "copy", "other_language") for x in DEFECTS[k]] + ["t_stop", "t_reason"]
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        m = bc.value
        for pdf in batches:
            for lo in range(0, len(pdf), 500):
                p = pdf.iloc[lo : lo + 500]
                q, a = [x or "" for x in p["q"]], [x or "" for x in p["a"]]
                votes = [x | y for x, y in zip(map(pair_votes, q, a), language_votes(m, q, a))]
                for v, t, f in zip(votes, a, p["f"]):
                    t = t.rstrip()
                    if STOPPED.search(t) and not NUMBER_STOP.search(t):
                        v["t_stop"] = 0
                    if f in ("length", "stop"):
                        v["t_reason"] = int(f == "length")
                yield pd.DataFrame({"k": p["k"].to_numpy()} | {x: pd.array([v.get(x) for v in votes], "Int8") for x in names})

    rows = df.select(F.col(key).alias("k"), F.col(prompt).alias("q"), F.col(response).alias("a"), (F.lower(reason) if reason else F.lit(None).cast("string")).alias("f"))
    voted = rows.mapInPandas(run, f"k {kind}, " + ", ".join(f"{x} tinyint" for x in names))
    cut = cut_off(df, key, response).groupBy(F.col(key).alias("k")).agg(F.min("reason").alias("r"))
    votes = voted.join(cut, "k", "left")
    # The function of the reason votes for it; the others, asked after it, abstain.
    for name, reasons in CUT_REASONS.items():
        votes = votes.withColumn(name, F.when(F.col("r").isNull(), 0).when(F.col("r").isin(*reasons), 1))
    return votes.drop("r").withColumnRenamed("k", key)


def posteriors(model: LabelModel, patterns: np.ndarray) -> np.ndarray:
    z = np.full(len(patterns), np.log(model.prior / (1 - model.prior)))
    for f, (zero, one, none) in enumerate(model.odds):
        z += np.select([patterns[:, f] == 1, patterns[:, f] == 0], [one, zero], none)
    return 1 / (1 + np.exp(-np.clip(z, -700, 700)))


def best_cutoff(judged: np.ndarray, belief: np.ndarray, n: np.ndarray) -> float:
    """The cutoff of ``judged`` posteriors with the best F1 by the ``belief`` of another model, n rows each; midway to the next lower posterior."""
    values = np.unique(judged)
    best = (-1.0, 0.5)
    for i, c in enumerate(values):
        own = judged >= c
        tp, all_true, size = (n * belief)[own].sum(), (n * belief).sum(), n[own].sum()
        f1 = 2 * tp / (size + all_true) if size + all_true > 0 else 0.0
        best = max(best, (f1, float((c + values[i - 1]) / 2 if i else c)))
    return best[1]


def fit_defects(voted: DataFrame, key: str) -> dict[str, tuple[LabelModel, float]]:
    """A label model and a cutoff for each defect, from one aggregate: the counts of all vote patterns in each half of the keys."""
    votes = lambda names: F.concat_ws(",", *[F.coalesce(F.col(v).cast("string"), F.lit("-1")) for v in names])
    said = F.coalesce(F.col("e_blank") == 0, F.lit(True)) & ~F.coalesce(F.col("e_label") == 1, F.lit(False))
    each = F.array(*[F.struct(F.lit(d).alias("d"), F.when(F.lit(d == "empty") | said, votes(names)).alias("p")) for d, names in DEFECTS.items()])
    counts = voted.select(F.pmod(F.xxhash64(F.col(key)), F.lit(2)).alias("half"), F.inline(each)).filter("p IS NOT NULL").groupBy("d", "half", "p").count()
    rows = bounded_rows(counts, 2 * sum(3 ** len(x) for x in DEFECTS.values()), "the table of vote patterns")
    out = {}
    for defect, names in DEFECTS.items():
        seen = sorted({r.p for r in rows if r.d == defect}) or [",".join(["-1"] * len(names))]
        patterns = np.array([[int(x) for x in p.split(",")] for p in seen])
        n = np.zeros((2, len(seen)))
        for r in rows:
            if r.d == defect:
                n[r.half, seen.index(r.p)] = r["count"]
        one, other, both = (fit_patterns(patterns, x, names, PRIORS[defect], trust=0.95, strength=50.0) for x in (n[0], n[1], n.sum(0)))
        out[defect] = (both, best_cutoff(posteriors(one, patterns), posteriors(other, patterns), n[1]))
    return out


def defective_pairs(voted: DataFrame, key: str) -> DataFrame:
    """key, defect, posterior: every defect whose posterior reaches its cutoff; ``voted`` is written down once and read in one pass."""
    voted = checkpointed(voted)
    fitted = fit_defects(voted, key)
    for defect, (model, _) in fitted.items():
        voted = voted.withColumn(f"p_{defect}", model.posterior())
    no_answer = F.col("p_empty") >= fitted["empty"][1]
    found = F.array(*[F.struct(F.lit(d).alias("defect"), F.when((F.col(f"p_{d}") >= cutoff) & (F.lit(d == "empty") | ~no_answer), F.col(f"p_{d}")).alias("posterior")) for d, (_, cutoff) in fitted.items()])
    return voted.select(key, F.inline(found)).filter("posterior IS NOT NULL").groupBy(key, "defect").agg(F.max("posterior").alias("posterior"))

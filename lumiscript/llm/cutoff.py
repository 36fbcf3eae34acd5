"""Problem 7: texts cut off inside a word or sentence, and how often each source cuts.

The corpus gives a vocabulary trie, kept as a table of its nodes (the prefixes
of the words, each after the word before it), so that it is built and searched
by shuffles and has no size limit. A value is cut where its final token, after
the word before it, is unknown but a proper prefix of known words. Length
evidence decides where the last word is whole: the last sentence is shorter
than the complete ones with the same opening, or its final words rarely end
one although it has no stop. Closing phrases that a share of the different
texts without a final stop end with are complete, but never a torn word.

Defined results: null, blank and wordless texts are no case; redelivered rows
(equal but for their arrival) count once; a null source has a rate of its own.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumiscript.llm.common import checkpointed, folded

WORDS = re.compile(r"\d+(?:[.,/:]\d+)*|[㐀-鿿]|(?:[^\W\d_㐀-鿿][\u0300-\u036f]*)+")
#: Sentences end at a stop before white space, at Chinese stops, and at lines.
SENTENCES = re.compile(r"(?<=[.!?…])\s+|(?<=[。！？])\s*|\s*\n\s*")
HIDDEN = re.compile("[\xad\u200b-\u200f\u2060\ufeff]")
STOP = re.compile(r"[.!?…。！？;；:：)\]\"”’»']$")
#: A stop that a number or the number of a list may have of its own.
NUMBERED = re.compile(r"(?:\d[.,:]|(?:^|\n)\s*(?:\d{1,3}|[^\W\d_])[.)])$")
NUMBER = re.compile(r"\d[.,]$")
#: What no text ends with: open punctuation, a gap, a part of a date or amount.
OPEN = re.compile(r"[,(\[“‘«–—/-]$|\d/\d{1,2}/\d{1,3}$|\.\d{3}\.\d{1,2}$")
GAP = re.compile(r"[^\s.!?…。！？;:] $")
#: A word pair ends sentences rarely if under this share of its occurrences do; pairs and words under ``SEEN`` say nothing.
RARE_END, SEEN = 0.012, 20
#: A closing phrase ends at least this share of the different texts without a final stop.
CLOSING = 0.005


def sentences(text: str) -> list[list[str]]:
    """The sentences and lines as lower-case words; numbers are one word, Han characters are words."""
    out = []
    for part in SENTENCES.split(text):
        w = ["#" if x[0].isdigit() else x for x in WORDS.findall(part.lower())]
        if w:
            out.append(w)
    return out


def text_hash(units: list[list[str]]) -> int:
    """A 64-bit hash of a text's words, the same for copies in other case, spelling of marks or spacing."""
    words = folded("\n".join(" ".join(w) for w in units))
    return int.from_bytes(hashlib.blake2b(words.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def opening(w: list[str]) -> str:
    """The first two words, without the number of a list."""
    return " ".join(w[1:3] if len(w) > 3 and w[0] == "#" else w[:2])


def cut_notes(df: DataFrame, key: str, text: str) -> DataFrame:
    """One pass over the texts: their unstopped ends, and the corpus's counts summed within each batch.

    kind ``pair``: a, b, n, ends; ``opening``: a, n, size; ``end``: k, torn,
    open, number, the last words a and b, the sentence s, its opening o, size,
    the hash h of the whole text.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        for pdf in batches:
            pairs, ends, opened = Counter(), Counter(), Counter()
            rows = []
            for k, raw in zip(pdf["k"], pdf["_t"]):
                t = HIDDEN.sub("", raw).rstrip()
                torn = t.endswith("\ufffd")
                units = sentences(t.rstrip("\ufffd"))
                if not units:
                    continue
                stopped = bool(STOP.search(t)) and not NUMBERED.search(t)
                for i, w in enumerate(units):
                    whole = stopped or i < len(units) - 1
                    # The last word of an unstopped text may be torn and is no evidence of a word.
                    known = w if whole else w[:-1]
                    pairs.update(zip(["", *known], known))
                    if whole:
                        ends[(known[-2] if len(known) > 1 else "", known[-1])] += 1
                        if len(w) >= 2:
                            opened[opening(w), len(w)] += 1
                if not stopped:
                    w = units[-1]
                    rows.append(("end", k, w[-2] if len(w) > 1 else "", w[-1], folded(" ".join(w)), opening(w), len(w), torn, bool(OPEN.search(t) or GAP.search(raw)), bool(NUMBER.search(t)), 1, 0, text_hash(units)))
            rows += [("pair", None, a, b, None, None, 0, False, False, False, n, ends[a, b], 0) for (a, b), n in pairs.items()]
            rows += [("opening", None, o, None, None, None, size, False, False, False, n, 0, 0) for (o, size), n in opened.items()]
            yield pd.DataFrame(rows, columns=["kind", "k", "a", "b", "s", "o", "size", "torn", "open", "number", "n", "ends", "h"]).astype({"k": object})

    rows = df.select(F.col(key).alias("k"), F.col(text).alias("_t")).filter("_t IS NOT NULL")
    return rows.mapInPandas(run, f"kind string, k {kind}, a string, b string, s string, o string, size bigint, torn boolean, open boolean, number boolean, n bigint, ends bigint, h bigint")


def cut_off(df: DataFrame, key: str = "gen_id", text: str = "output", min_support: int = 5) -> DataFrame:
    """key, reason: the cut texts of ``df``, judged by the texts of ``df`` as the corpus; one row per key and reason."""
    notes = checkpointed(cut_notes(df, key, text))
    bigrams = checkpointed(notes.filter("kind = 'pair'").groupBy("a", "b").agg(F.sum("n").alias("n_all"), F.sum("ends").alias("n_end")))
    known = bigrams.groupBy("b").agg(F.sum("n_all").alias("w_all"), F.sum("n_end").alias("w_end"))
    # The nodes of the trie: every proper prefix of the words after each word.
    node = lambda c: F.explode(F.transform(F.sequence(F.lit(1), F.length(c) - 1), lambda i: F.substr(c, F.lit(1), i)))
    trie = bigrams.filter("n_all >= 2 AND length(b) > 1").select("a", node(F.col("b")).alias("b"), "n_all").groupBy("a", "b").agg(F.sum("n_all").alias("below"))
    word_trie = known.filter("w_all >= 2 AND length(b) > 1").select(node(F.col("b")).alias("b"), "w_all").groupBy("b").agg(F.sum("w_all").alias("w_below"))
    sizes = notes.filter("kind = 'opening'").groupBy(F.col("a").alias("o"), "size").agg(F.sum("n").alias("n"))
    openings = sizes.groupBy("o").agg(F.sum("n").alias("o_n"), F.percentile("size", F.lit(0.01), F.col("n")).alias("o_min"), F.max("size").alias("o_max"))
    final = notes.filter("kind = 'end'").select("k", "torn", "open", "number", "a", "b", "s", "o", F.col("size").alias("len"), "h")
    # Copies of one text are one text here, however many there are.
    texts = final.select("s", "h").distinct()
    enough = F.greatest(F.lit(min_support), CLOSING * F.col("texts"))
    closings = texts.groupBy("s").agg(F.count("*").alias("s_n")).crossJoin(F.broadcast(texts.agg(F.count("*").alias("texts")))).filter(F.col("s_n") >= enough).drop("texts")
    x = final.join(bigrams, ["a", "b"], "left").join(trie, ["a", "b"], "left").join(known, "b", "left").join(word_trie, "b", "left").join(openings, "o", "left").join(closings, "s", "left")
    n_all, n_end, below = (F.coalesce(F.col(c), F.lit(0)) for c in ("n_all", "n_end", "below"))
    w_all, w_end, w_below, s_n = (F.coalesce(F.col(c), F.lit(0)) for c in ("w_all", "w_end", "w_below", "s_n"))
    letters = F.col("b").rlike(r"^[\p{L}\p{M}&&[^\p{IsHan}]]")
    inside_word = letters & (w_all < 2) & (w_below > 0)
    inside_pair = letters & (n_all < 2) & (below >= 2) & (below > 20 * n_end)
    # A closing phrase: whole texts end with it in a whole word, and nothing else goes on from it. Its last pair may be found there only.
    closing = (s_n > 0) & (~letters | (w_all >= 2)) & (F.col("len") >= F.coalesce("o_max", F.lit(0))) & (n_all * 4 <= s_n)
    # A stop after a number may be the number's own; only clear cases count then.
    short = (F.col("o_n") >= min_support) & (F.col("len") < F.col("o_min")) & ((F.col("len") < 0.6 * F.col("o_min")) | (~F.col("number") & (n_end < 0.25 * n_all)))
    rare = F.when(n_all >= SEEN, n_end < RARE_END * n_all).otherwise((w_all >= SEEN) & (w_end < RARE_END * w_all)) & ~(F.col("number") & (F.col("len") > 60))
    reason = (
        F.when(F.col("torn"), "torn character")
        .when(F.col("open"), "open punctuation")
        .when(inside_word | inside_pair, "inside a word")
        .when(closing & ~F.col("number"), F.lit(None))
        .when(short, "short sentence")
        .when(rare, "rare ending")
    )
    return x.select(F.col("k").alias(key), reason.alias("reason")).filter("reason IS NOT NULL").distinct()


def cut_rates(df: DataFrame, cut: DataFrame, key: str = "gen_id", source: str = "tag", text: str = "output") -> DataFrame:
    """source, n_texts (that aren't blank), n_cut, cut_rate over the distinct keys."""
    rows = df.filter(F.col(text).rlike(r"[\p{L}\p{N}]")).select(F.col(key).alias("k"), F.col(source).alias("s")).distinct()
    hit = cut.select(F.col(key).alias("k"), F.lit(1).alias("c")).distinct()
    out = rows.join(hit, "k", "left").groupBy("s").agg(F.count("*").alias("n_texts"), F.count("c").alias("n_cut"))
    return out.select(F.col("s").alias(source), "n_texts", "n_cut", F.round(F.col("n_cut") / F.col("n_texts"), 6).alias("cut_rate"))

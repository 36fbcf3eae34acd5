"""Problem 5: one consistent form for text that looks the same.

A text is cut into chunks at spaces and line ends. A chunk with a code point
outside plain text (a small character class, run in the scan) is dirty; the
distinct dirty chunks, with the script of their neighbours, are exploded to
positioned code points and joined with two broadcast tables made from the
Unicode data: decompositions with look-alikes, and combining classes. Combining
marks are ordered by class within their base, each base with its marks is
recomposed by a join with the compositions (the longest run of marks that
composes), and the chunk is rebuilt in order.

Only the dirty chunks, once each, are exploded: nothing grows with the texts
that are in order, and no text is shuffled to find the dirty records.

What is ordinary: composed letters, the plain space and hyphen, and the word's
own alphabet. A look-alike letter counts where its word has letters of the
other alphabet, or consists of look-alikes only among words of it. Full-width
punctuation next to Chinese is ordinary, and so is what broken encoding left
(a no-break space or soft hyphen after its lead letters).

Defined results: null and empty texts stay as they are and are no case;
repeated rows give one case; a text of one dirty word only has no neighbours
and keeps whole words of another alphabet.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumiscript.llm.common import checkpointed

# Cyrillic, Greek and Armenian letters that look like a Latin letter.
CYRILLIC_PLAIN = {"а": "a", "в": None, "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l", "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "І": "I", "Ј": "J", "Ѕ": "S", "Ԛ": "Q", "Ԝ": "W", "Ӏ": "I"}
GREEK_PLAIN = {"ο": "o", "ν": "v", "α": "a", "ρ": "p", "υ": "u", "ι": "i", "κ": "k", "χ": "x", "γ": "y", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X"}
ARMENIAN_PLAIN = {"օ": "o", "ս": "u", "հ": "h", "ո": "n", "Օ": "O"}
FOREIGN = {k: v for k, v in (CYRILLIC_PLAIN | GREEK_PLAIN | ARMENIAN_PLAIN).items() if v}
#: Look-alikes whatever their word: Latin letters of other languages, hyphens.
ALWAYS = {"ð": "đ", "Ð": "Đ", "Ɖ": "Đ", "ɖ": "đ", "ı": "i", "ɑ": "a", "ɡ": "g", "‐": "-", "‑": "-", "﹣": "-"}
SPACES = "".join(map(chr, (0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000)))
LINES = "".join(map(chr, (0x85, 0x2028, 0x2029)))
# Code points that can't be seen.
HIDDEN = [(0x00, 0x08), (0x0B, 0x0C), (0x0E, 0x1F), (0x7F, 0x7F), (0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180E), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0xE0000, 0xE0FFF)]
#: Compatibility forms that look like the plain ones (not superscripts, circles and fractions, which differ).
SAME_LOOK = {"<wide>", "<narrow>", "<font>", "<noBreak>"}
CHINESE_PUNCTUATION = "！（），．：；？［］｛｝～＂＇＂／％＋－＝＆＊＠＃"
HAN = r"\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}"
#: What broken encoding leaves before a no-break space or soft hyphen.
BROKEN = r"[ÂÃÄÅÆáâº»][\x{A0}\x{AD}]"


@lru_cache(maxsize=1)
def mapping() -> list[tuple[str, str, str]]:
    """(code point, what it stands for, kind): kind says when it counts."""
    out = {}
    for cp in range(0xA0, 0x30000):
        c = chr(cp)
        d = unicodedata.decomposition(c)
        if not d or 0xAC00 <= cp <= 0xD7A3:
            continue
        tag = d.split()[0] if d[0] == "<" else ""
        if tag in SAME_LOOK or tag == "<compat>" and (0x2E80 <= cp <= 0x2FDF or 0xFB00 <= cp <= 0xFB06 or 0x2160 <= cp <= 0x217F):
            out[c] = (unicodedata.normalize("NFKD", c), "chinese" if c in CHINESE_PUNCTUATION else "always")
        elif not tag:
            whole = unicodedata.normalize("NFD", c)
            out[c] = (whole, "canonical")
    for c, v in FOREIGN.items():
        out[c] = (v, "foreign")
    for c, v in ALWAYS.items():
        out[c] = (unicodedata.normalize("NFD", v), "always")
    for c in SPACES:
        out[c] = (" ", "always")
    for c in LINES:
        out[c] = ("\n", "always")
    for a, b in HIDDEN:
        for cp in range(a, min(b, 0xE01EF) + 1):
            out[chr(cp)] = ("", "always")
    return [(c, v, k) for c, (v, k) in sorted(out.items())]


@lru_cache(maxsize=1)
def compositions() -> list[tuple[str, str]]:
    """(base with ordered marks, composed code point) for all that compose."""
    out = []
    for cp in range(0xA0, 0x20000):
        c = chr(cp)
        d = unicodedata.normalize("NFD", c)
        if len(d) > 1 and not 0xAC00 <= cp <= 0xD7A3 and unicodedata.normalize("NFC", d) == c:
            out.append((d, c))
    return out


@lru_cache(maxsize=1)
def classes() -> list[tuple[str, int]]:
    return [(chr(cp), unicodedata.combining(chr(cp))) for cp in range(0x300, min(sys.maxunicode, 0x1F000)) if unicodedata.combining(chr(cp))]


def ranges(points: list[int]) -> str:
    """A regular-expression class of these code points."""
    out, points = [], sorted({*points})
    for p in points:
        if out and p == out[-1][1] + 1:
            out[-1][1] = p
        else:
            out.append([p, p])
    return "".join(rf"\x{{{a:X}}}" + (rf"-\x{{{b:X}}}" if b > a else "") for a, b in out)


#: A code point outside plain text: the scan looks for one before anything else. What it finds beyond the mapping stays as it is.
UNUSUAL = r"[^\n\x20-\x7E¡-¬®-ÏÑ-ïñ-ÿĂăĐđĨĩŨũƠơƯư\x{1EA0}-\x{1EF9}–—‘’“”…]"


def small(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table of a fixed size as a literal, to be broadcast."""
    names = [x.split()[0] for x in schema.split(", ")]
    return F.broadcast(spark.createDataFrame(pd.DataFrame(rows, columns=names), schema))


def composed_by_library(text: Column) -> Column:
    @F.pandas_udf("string")
    def nfc(s: pd.Series) -> pd.Series:
        return s.map(lambda x: unicodedata.normalize("NFC", x))

    return nfc(text)


#: Chunks end with a space or line; a longer run is cut, between letters and never before their marks.
CHUNKS = r"[^ \n]{1,256}\p{M}*[ \n]?|[ \n]"


def chunks_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(CHUNKS), F.lit(0))


FOREIGN_OWN = rf"[\x{{370}}-\x{{3FF}}\x{{400}}-\x{{52F}}&&[^{ranges([ord(c) for c in FOREIGN])}]]"


def dirty_chunks(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, pos, chunk (without its end), own: whether a neighbour is of another alphabet than Latin."""
    chunk = F.regexp_replace("_c", r"[ \n]$", "")
    rows = df.select(*keys, F.col(text).alias("_t")).filter(F.col("_t").rlike(UNUSUAL))
    rows = rows.select(*keys, chunks_of(F.col("_t")).alias("_all"))
    rows = rows.select(*keys, "_all", F.posexplode("_all").alias("_pos", "_c"))
    near = F.concat_ws(" ", F.when(F.col("_pos") > 0, F.get("_all", F.col("_pos") - 1)), F.get("_all", F.col("_pos") + 1))
    own = F.when(near.rlike(FOREIGN_OWN), "foreign").when(near.rlike(r"[A-Za-zÀ-ÿĂăĐđĨĩŨũƠơƯư\x{1EA0}-\x{1EF9}]"), "latin").otherwise("none")
    return rows.filter(F.col("_c").rlike(UNUSUAL)).select(*keys, F.col("_pos").alias("pos"), chunk.alias("chunk"), own.alias("near"))


def rebuilt_chunks(chunks: DataFrame) -> DataFrame:
    """chunk, near, plain: the consistent form of each distinct chunk that differs from it."""
    spark = chunks.sparkSession
    table = small(spark, mapping(), "cp string, plain string, kind string")
    ccc = small(spark, classes(), "mark string, ccc int")
    composed = small(spark, compositions(), "parts string, whole string")
    latin = F.col("chunk").rlike(r"[A-Za-zÀ-ÿĂăĐđĨĩŨũƠơƯư\x{1EA0}-\x{1EF9}\x{FF21}-\x{FF3A}\x{FF41}-\x{FF5A}]")
    foreign_word = F.col("chunk").rlike(FOREIGN_OWN)
    # A foreign letter is a look-alike in a word with Latin letters but none of the foreign alphabet only, or among Latin words.
    counts = (latin & ~foreign_word) | (~latin & ~foreign_word & (F.col("near") == "latin"))
    base = chunks.select("chunk", "near").distinct()
    # In a word of the other alphabet, the Latin look-alikes are the odd ones.
    back = {v: k for k, v in CYRILLIC_PLAIN.items() if v}
    mixed = F.when(latin & F.col("chunk").rlike(r"[\x{400}-\x{52F}&&[^" + ranges([ord(c) for c in CYRILLIC_PLAIN]) + "]]"), F.translate("chunk", "".join(back), "".join(back.values()))).otherwise(F.col("chunk"))
    base = base.select("chunk", "near", counts.alias("_counts"), F.col("chunk").rlike(f"[{HAN}]").alias("_han"), F.regexp_replace(mixed, BROKEN, "").alias("_clean"), F.col("chunk").rlike(BROKEN).alias("_broken"), mixed.alias("_mixed"))
    points = base.select("chunk", "near", "_counts", "_han", "_broken", F.posexplode(F.split("_mixed", "")).alias("i", "cp"), "_mixed")
    # What broken encoding left keeps its code points.
    left = F.col("_broken") & F.col("cp").isin("\xa0", "\xad") & F.expr("substring(_mixed, i, 1)").rlike("[ÂÃÄÅÆáâº»]")
    points = points.join(table, "cp", "left")
    plain = F.when(left, F.col("cp")).when((F.col("kind") == "foreign") & ~F.col("_counts"), F.col("cp")).when((F.col("kind") == "chinese") & F.col("_han"), F.col("cp")).otherwise(F.coalesce("plain", "cp"))
    # A stand-in of several code points (a decomposition) is exploded in its turn.
    points = points.select("chunk", "near", "i", F.posexplode(F.split(plain, "")).alias("j", "p")).filter("p <> ''")
    points = points.join(ccc, points.p == ccc.mark, "left").select("chunk", "near", "i", "j", "p", F.coalesce("ccc", F.lit(0)).alias("ccc"))
    marks = F.sort_array(F.collect_list(F.struct("ccc", "i", "j", "p")))
    # Bases number the clusters; the chunks are short, so one task sorts each.
    from pyspark.sql import Window

    order = Window.partitionBy("chunk", "near").orderBy("i", "j")
    cluster = points.withColumn("g", F.sum((F.col("ccc") == 0).cast("int")).over(order)).groupBy("chunk", "near", "g").agg(F.transform(marks, lambda x: x["p"]).alias("a"))
    n = F.size("a")
    prefix = cluster.filter(n > 1).select("chunk", "near", "g", "a", F.explode(F.sequence(F.lit(2), n)).alias("k")).withColumn("parts", F.array_join(F.slice("a", 1, F.col("k")), ""))
    best = prefix.join(composed, "parts").groupBy("chunk", "near", "g").agg(F.max_by("whole", "k").alias("whole"), F.max("k").alias("k"))
    found = cluster.join(best, ["chunk", "near", "g"], "left")
    done = found.filter((n == 1) | (F.col("k") == n)).select("chunk", "near", "g", F.coalesce("whole", F.array_join("a", "")).alias("s"))
    # Marks that compose past one that doesn't are few, and settled by the library.
    rest = found.filter((n > 1) & (F.col("k").isNull() | (F.col("k") < n))).select("chunk", "near", "g", composed_by_library(F.array_join("a", "")).alias("s"))
    single = done.unionByName(rest)
    whole = single.groupBy("chunk", "near").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("g", "s"))), lambda x: x["s"]), "").alias("plain"))
    out = base.select("chunk", "near").join(whole, ["chunk", "near"], "left").select("chunk", "near", F.coalesce("plain", F.lit("")).alias("plain"))
    return out.filter(F.col("plain") != F.col("chunk"))


def lookalike_records(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Distinct keys of the records whose text has a look-alike or hidden code point."""
    chunks = checkpointed(dirty_chunks(df, keys, text))
    changed = rebuilt_chunks(chunks).select("chunk", "near")
    return chunks.join(changed, ["chunk", "near"], "left_semi").select(*keys).distinct()


def consistent_form(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys, text in its one form, changed (how many chunks); the keys have to be unique.

    Records in order are passed through; only the keys and replacements of the
    dirty ones are grouped, and joined back to their texts.
    """
    chunks = checkpointed(dirty_chunks(df, keys, text))
    swaps = chunks.join(rebuilt_chunks(chunks), ["chunk", "near"]).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("pos", F.struct("chunk", "plain")))).alias("_swap"))
    rows = df.select(*keys, F.col(text).alias("_t")).join(swaps, keys, "left")
    end = lambda x, old, new: F.concat(new, F.substr(x, F.length(old) + 1))
    parts = F.transform(chunks_of(F.col("_t")), lambda x, i: F.coalesce(end(x, F.col("_swap")[i]["chunk"], F.col("_swap")[i]["plain"]), x))
    return rows.select(*keys, F.when(F.col("_swap").isNull(), F.col("_t")).otherwise(F.array_join(parts, "")).alias(text), F.coalesce(F.size("_swap"), F.lit(0)).cast(T.LongType()).alias("changed"))


@lru_cache(maxsize=1)
def plain_table() -> tuple[dict[int, str], dict[int, str]]:
    return {ord(c): unicodedata.normalize("NFC", v) for c, v, kind in mapping() if kind == "always"}, {ord(c): v for c, v in FOREIGN.items()}


UNUSUAL_RE = re.compile("[^\n\x20-\x7e\xa1-\xac\xae-\xcf\xd1-\xef\xf1-\xffĂăĐđĨĩŨũƠơƯư\u1ea0-\u1ef9–—‘’“”…]")
FOREIGN_RE = re.compile("[" + "".join(FOREIGN) + "]")
OTHER_RE = re.compile("[\u0370-\u052f\u4e00-\u9fff]")


def plain_text(text: str) -> str:
    """The consistent form of one text, for operators that compare texts within a map: as above, but judged by the whole text's script."""
    if not UNUSUAL_RE.search(text):
        return text
    always, foreign = plain_table()
    out = text.translate(always)
    if FOREIGN_RE.search(out):
        letters = sum(map(str.isalpha, out))
        if len(OTHER_RE.findall(out)) < 0.3 * letters:
            out = out.translate(foreign)
    return out if unicodedata.is_normalized("NFC", out) else unicodedata.normalize("NFC", out)

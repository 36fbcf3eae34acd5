"""Helpers shared by the training-data operators.

Every operator selects the columns it needs before anything else, so extra
columns, even ones that clash with an operator's own names, never reach it.
"""

from __future__ import annotations

import unicodedata
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumiscript.sources.files import shared_folder

#: The eight combining marks of Vietnamese in decomposed text.
MARKS = "̛̣̀́̃̉̂̆"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts the lineage in the shared folder that the cluster names; sets one only where none is set."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def bounded_rows(df: DataFrame, most: int, what: str) -> list:
    """The rows of a table that has to be small; raises instead of collecting a large one."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{what} has over {most} rows and isn't collected")
    return rows


def bounded_sample(df: DataFrame, key: str, rows: int, where: str = "true", distinct: bool = False) -> list:
    """At most ``rows`` rows that meet ``where``, the first in the order of the key's hash; ``distinct``: different ones.

    The rows are counted without reading a column, and a cut on the hash leaves
    about as many as are asked for before anything is ordered, compared or
    collected, so the table is read once. Where the condition or copies leave too
    few, the cut is widened.
    """
    n = df.count()
    share = 1.0 if n <= rows else min(1.0, 1.3 * rows / n + 20 / n)
    while True:
        own = df if share >= 1 else df.filter(F.pmod(F.xxhash64(key), F.lit(1 << 30)) < int(share * (1 << 30)))
        own = own.filter(where)
        got = (own.distinct() if distinct else own).orderBy(F.xxhash64(key), key).limit(rows).collect()
        if len(got) >= 0.5 * rows or share >= 1:
            return got
        share = min(1.0, 4 * share)


def crc(text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "surrogatepass"))


def fold_table() -> dict[int, str]:
    """Code points of Latin letters with the marks of Vietnamese to their base letters, built from the Unicode data."""
    out = {}
    for c in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        plain = "".join(x for x in unicodedata.normalize("NFD", chr(c)) if not unicodedata.combining(x))
        if plain and plain != chr(c):
            out[c] = plain
    out |= {ord(m): None for m in MARKS} | {0x111: "d", 0x110: "D"}
    return out


FOLD = fold_table()


def folded(text: str) -> str:
    return text.lower().translate(FOLD)


def composed(text: str | None) -> str:
    """The text in composed form; most texts are and only get checked."""
    if not text or unicodedata.is_normalized("NFC", text):
        return text or ""
    return unicodedata.normalize("NFC", text)

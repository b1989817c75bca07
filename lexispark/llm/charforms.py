"""One consistent character form for text that looks the same (problem 4).

The form is a confusables skeleton: decompose, replace every character by the prototype it looks
like, decompose again.  Case, punctuation, kinds of dash, marks on letters and digits stay visible,
so two texts share a skeleton only when a reader could not tell them apart.

Defined results: null stays null, an empty text stays empty, a text of invisible characters only
becomes empty.  Rows are never dropped or merged by the column functions.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Letters of other scripts and the Latin letter each one looks like.
LOOKALIKES = {
    # Cyrillic capitals
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T",
    "У": "Y", "Х": "X", "Ѕ": "S", "І": "I", "Ј": "J", "Ԛ": "Q", "Ԝ": "W", "Ү": "Y", "Ӏ": "I", "Ԍ": "G",
    # Cyrillic small letters
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j",
    "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ѵ": "v", "ү": "y", "ӏ": "l",
    # Greek capitals
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O",
    "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J",
    # Greek small letters
    "α": "a", "ι": "ı", "ν": "v", "ο": "o", "ρ": "p", "ϲ": "c", "ϳ": "j",
    # Armenian
    "Լ": "L", "Օ": "O", "Տ": "S", "Ս": "U", "հ": "h", "ո": "n", "ս": "u", "օ": "o", "ց": "g",
    # Latin letters of phonetic alphabets
    "ɑ": "a", "ɡ": "g",
    # Cherokee
    "Ꭺ": "A", "Ᏼ": "B", "Ꮯ": "C", "Ꭰ": "D", "Ꭼ": "E", "Ꮐ": "G", "Ꮋ": "H", "Ꭻ": "J", "Ꮶ": "K", "Ꮮ": "L",
    "Ꮇ": "M", "Ꮲ": "P", "Ꮪ": "S", "Ꭲ": "T", "Ꮩ": "V", "Ꮃ": "W", "Ꮓ": "Z",
    # Lisu
    "ꓮ": "A", "ꓐ": "B", "ꓚ": "C", "ꓓ": "D", "ꓰ": "E", "ꓝ": "F", "ꓖ": "G", "ꓧ": "H", "ꓲ": "I", "ꓙ": "J",
    "ꓗ": "K", "ꓡ": "L", "ꓟ": "M", "ꓠ": "N", "ꓳ": "O", "ꓑ": "P", "ꓣ": "R", "ꓢ": "S", "ꓔ": "T", "ꓴ": "U",
    "ꓦ": "V", "ꓪ": "W", "ꓫ": "X", "ꓬ": "Y", "ꓜ": "Z",
}

#: Decompositions that only change how a character is stored, not how it reads.
_SAME_SHAPE = {"<wide>", "<narrow>", "<font>", "<noBreak>"}


def _is_invisible(ch: str) -> bool:
    cp = ord(ch)
    return unicodedata.category(ch) == "Cf" or cp == 0x034F or 0xFE00 <= cp <= 0xFE0F or 0x180B <= cp <= 0x180E


def _prototype(cp: int) -> str | int:
    """What a code point looks like, by rule from the Unicode data plus ``LOOKALIKES``; itself if nothing else."""
    ch = chr(cp)
    cat = unicodedata.category(ch)
    if ch in LOOKALIKES:
        return LOOKALIKES[ch]
    if cp < 0x80 or cat in ("Cn", "Co", "Cs"):
        return cp
    if _is_invisible(ch):
        return ""
    if cat == "Zs":
        return " "
    parts = unicodedata.decomposition(ch).split()
    if parts and parts[0][0] == "<" and ch != "ſ":
        if parts[0] in _SAME_SHAPE or parts[0] == "<compat>" and cat in ("Ll", "Lu", "Lt", "Nl"):
            # a prototype may itself consist of look-alikes (a wide or styled letter of another script)
            return "".join(LOOKALIKES.get(c, c) for c in unicodedata.normalize("NFKD", ch))
    return cp


class _Prototypes(dict):
    """Code point -> prototype, worked out when a code point is first met: a worker need not go through all of Unicode."""

    def __missing__(self, cp: int) -> str | int:
        self[cp] = out = _prototype(cp)
        return out


_PROTOTYPES = _Prototypes()


@lru_cache(maxsize=1)
def _special() -> re.Pattern[str]:
    """Matches the first character that may need replacing; a text without any is its own form."""
    plain = [c for c in map(chr, range(0x180)) if _PROTOTYPES[ord(c)] == ord(c) and unicodedata.normalize("NFC", c) == c]
    return re.compile(f"[^{re.escape(''.join(plain))}–—‘’“”…]")


_DOTTED = re.compile("[iıj]̇")


def skeleton(text: str | None) -> str | None:
    """The confusables skeleton of a text, composed again so that it reads as ordinary text."""
    if text is None or not _special().search(text):
        return text
    out = unicodedata.normalize("NFD", text).translate(_PROTOTYPES)
    out = unicodedata.normalize("NFD", out)
    if "̇" in out:  # a dot over a letter that already has one cannot be seen
        out = _DOTTED.sub(lambda m: "j" if m[0][0] == "j" else "i", out)
    return unicodedata.normalize("NFC", out)


def lower_tr(text: str) -> str:
    """Lower case by Turkish rules."""
    return text.replace("İ", "i").replace("I", "ı").lower()


_WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    """Runs of letters and digits of the skeleton, lower case by Turkish rules."""
    return _WORD.findall(lower_tr(skeleton(text))) if text else []


@F.pandas_udf(T.StringType())
def _skeleton_udf(s: pd.Series) -> pd.Series:
    return s.map(skeleton, na_action="ignore")


def canonical(col: Column) -> Column:
    """Column form of ``skeleton``; null in, null out."""
    return _skeleton_udf(col)


def look_alike_forms(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id``, ``class_id`` (hash of the skeleton) and ``form`` (hash of the text as stored) of every distinct row.

    Only hashes leave the scan, whatever the length of the texts.  Null ids and null texts have no form.
    """
    return (
        rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("_text"))
        .where("id is not null and _text is not null")
        .select("id", F.sha2(canonical(F.col("_text")), 256).alias("class_id"), F.sha2("_text", 256).alias("form"))
        .dropDuplicates()
    )


def look_alike_pairs(forms: DataFrame, within: list[str]) -> DataFrame:
    """Pairs of ids of one class whose texts are stored differently: ``id_a`` < ``id_b``.

    Forms are paired before ids are, so copies of one stored text never meet each other however many there are.
    ``within`` names further columns that both rows must share.
    """
    by = [*within, "class_id"]
    kinds = forms.select(*by, "form").distinct()
    several = kinds.groupBy(*by).agg(F.count("*").alias("k")).where("k > 1").select(*by)
    kinds = kinds.join(several, by, "left_semi")
    two = kinds.withColumnRenamed("form", "f1").join(kinds.withColumnRenamed("form", "f2"), by).where("f1 < f2")
    first = forms.select(*by, F.col("form").alias("f1"), F.col("id").alias("i1"))
    second = forms.select(*by, F.col("form").alias("f2"), F.col("id").alias("i2"))
    return (
        two.join(first, [*by, "f1"]).join(second, [*by, "f2"]).where("i1 <> i2")
        .select(*within, F.least("i1", "i2").alias("id_a"), F.greatest("i1", "i2").alias("id_b"))
        .distinct()
    )

"""Problem 1: one spelling for text that looks the same in print.

Every letter run is resolved to the scripts in which all of its letters can be spelled (the intersection of the
scripts of each letter's look-alikes).  A run with letters of several scripts, or wholly in a script that imitates
another, is respelled in the first script of that intersection; invisible characters go, width and compatibility
forms, ligatures, radicals and kinds of space are folded, and accents are composed.  Letter case, superscripts,
circled forms and line structure stay, because they are visible.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docquarry.storage import materialize

# Letters that are drawn like Latin letters, by script.
LOOKALIKES = {
    "Cyrillic": {
        "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "ӏ": "l", "о": "o", "р": "p", "ԛ": "q",
        "ѕ": "s", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y", "А": "A", "В": "B", "С": "C", "Е": "E", "Ԍ": "G", "Н": "H",
        "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ԛ": "Q", "Ѕ": "S", "Т": "T", "Ѵ": "V", "Ԝ": "W",
        "Х": "X", "У": "Y",
    },
    "Greek": {
        "ο": "o", "ρ": "p", "ν": "v", "ϲ": "c", "ϳ": "j", "Α": "A", "Β": "B", "Ϲ": "C", "Ε": "E", "Η": "H", "Ι": "I",
        "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Χ": "X", "Υ": "Y", "Ζ": "Z",
    },
    "Armenian": {"օ": "o", "ս": "u", "հ": "h", "ո": "n", "Օ": "O", "Ս": "U", "Լ": "L"},
    "Cherokee": {
        "Ꭰ": "D", "Ꭱ": "R", "Ꭲ": "T", "Ꭺ": "A", "Ꭻ": "J", "Ꭼ": "E", "Ꮃ": "W", "Ꮇ": "M", "Ꮋ": "H", "Ꮐ": "G", "Ꮓ": "Z", "Ꮪ": "S",
        "Ꮩ": "V", "Ꮮ": "L", "Ꮯ": "C", "Ꮲ": "P", "Ꮶ": "K", "Ᏼ": "B",
    },
    "Lisu": {
        "ꓐ": "B", "ꓑ": "P", "ꓓ": "D", "ꓔ": "T", "ꓖ": "G", "ꓗ": "K", "ꓙ": "J", "ꓚ": "C", "ꓜ": "Z", "ꓝ": "F", "ꓟ": "M", "ꓠ": "N",
        "ꓡ": "L", "ꓢ": "S", "ꓣ": "R", "ꓦ": "V", "ꓧ": "H", "ꓪ": "W", "ꓫ": "X", "ꓬ": "Y", "ꓮ": "A", "ꓰ": "E", "ꓲ": "I", "ꓳ": "O", "ꓴ": "U",
    },
    "Coptic": {"Ⲏ": "H", "Ⲓ": "I", "Ⲕ": "K", "Ⲙ": "M", "Ⲛ": "N", "Ⲟ": "O", "Ⲣ": "P", "Ⲥ": "C", "Ⲧ": "T", "Ⲭ": "X", "ⲟ": "o", "ⲣ": "p", "ⲥ": "c"},
    "Latin": {"ɑ": "a", "ɡ": "g", "ı": "i"},
}
SCRIPTS = ("Latin", "Cyrillic", "Greek", "Armenian", "Cherokee", "Lisu", "Coptic")
# Radicals without a decomposition that print like a character.
RADICALS = dict(zip("⺠⻁⻅⻆⻉⻋⻓⻔⻘⻙⻚⻛⻜⻝⻢⻣⻤⻥⻦⻧⻨⻩⻬⻮⻰", "民虎见角贝车长门青韦页风飞食马骨鬼鱼鸟卤麦黄齐齿龙"))
# Compatibility tags whose forms print like the plain character.
_SAME_IN_PRINT = ("<wide>", "<narrow>", "<noBreak>", "<compat>")
_HYPHENS = "\u2010\u2011"
# Default-ignorable ranges (invisible in print).
_INVISIBLE = "\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180f\u200b-\u200f\u202a-\u202e\u2060-\u206f\u3164\ufe00-\ufe0f\ufeff\uffa0\ufff0-\ufff8\U000e0000-\U000e0fff"

# The full-width marks of ordinary Chinese text, replaced first because they are frequent.
_OFTEN = [(chr(ord(c) + 0xFEE0), c) for c in ",;:()!?"]
_RETURN = re.compile("\r\n?")
_SHY_AT_BREAK = re.compile("\u00ad(?=[\r\n])")
_GONE = re.compile(f"[\u00ad{_INVISIBLE}]+")
_ODD = re.compile("[^\n -~\u4e00-\u9fff\u3002\u3001\u3010\u3011\u300a\u300b\u201c\u201d\u2018\u2019]")
_ALIKE = "\u0131\u0251\u0261\u0370-\u03ff\u0400-\u052f\u0530-\u058f\u13a0-\u13ff\u2c80-\u2cff\ua4d0-\ua4ff"
_LETTER = f"[A-Za-z\u00c0-\u02af\u0300-\u036f\u1e00-\u1eff{_ALIKE}]"
_RUN = re.compile(f"{_LETTER}*[{_ALIKE}]{_LETTER}*")

_CLASS: dict[str, dict[str, str]] = {}
for _script, _letters in LOOKALIKES.items():
    for _letter, _latin in _letters.items():
        _class = _CLASS.setdefault(_latin, {"Latin": _latin})
        if _script != "Latin":
            _class[_script] = _letter
        _CLASS[_letter] = _class


def _script_of(letter: str) -> str:
    name = unicodedata.name(letter, "")
    return next((s for s in SCRIPTS if name.startswith(s.upper())), "Other")


@lru_cache(maxsize=65536)
def _plain_form(char: str) -> str:
    """The form of one character without width, spacing and ligature variants."""
    if char in _HYPHENS:
        return "-"
    if char in RADICALS:
        return RADICALS[char]
    if unicodedata.category(char) == "Zs":
        return " "
    parts = unicodedata.decomposition(char).split()
    if not parts:
        return char
    if parts[0].startswith("<"):
        if parts[0] not in _SAME_IN_PRINT and not "\U0001d400" <= char <= "\U0001d7ff":  # the mathematical alphabets
            return char
        return "".join(_plain_form(chr(int(x, 16))) for x in parts[1:])
    return unicodedata.normalize("NFC", char)


@lru_cache(maxsize=200_000)
def resolve_run(run: str) -> str:
    """Respell one run of letters in the first script that has a look-alike for each of them.

    The choice depends only on how the letters look, so runs that look alike come out equal.  Where no single script
    has all letters (a genuinely mixed run), each letter takes the first script that has it.
    """
    letters = unicodedata.normalize("NFD", run)
    spell = [_CLASS.get(c) or {_script_of(c): c} for c in letters if not unicodedata.combining(c)]
    shared = set(SCRIPTS).intersection(*spell) if spell else set()
    order = [s for s in SCRIPTS if s in shared] or SCRIPTS
    out, k = [], 0
    for c in letters:
        if unicodedata.combining(c):
            out.append(c)
            continue
        forms = spell[k]
        k += 1
        out.append(next((forms[s] for s in order if s in forms), c))
    return unicodedata.normalize("NFC", "".join(out))


def plain_marks(text: str) -> str:
    """``text`` with the full-width marks of ordinary Chinese text replaced."""
    for wide, plain in _OFTEN:
        text = text.replace(wide, plain)
    return text


def canonical(text: str | None) -> str | None:
    """The one form of ``text``; None stays None, the empty string stays empty."""
    if text is None:
        return None
    s = plain_marks(text)
    if not _ODD.search(s):
        return s
    s = _SHY_AT_BREAK.sub("-", _RETURN.sub("\n", s))
    s = _GONE.sub("", s)
    s = _ODD.sub(lambda m: _plain_form(m[0]), s)
    s = unicodedata.normalize("NFC", s)
    return _RUN.sub(lambda m: resolve_run(m[0]), s)


@F.pandas_udf(T.StringType())
def _canonical_udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield s.map(canonical, na_action="ignore").astype(object)


def canonical_text(text: Column) -> Column:
    """``text`` in its one printed form (Arrow UDF)."""
    return _canonical_udf(text)


def keyed_texts(tables: dict[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """Rows (src, key, text) of several tables: name -> (table, key column, text column)."""
    parts = [
        df.select(F.lit(src).alias("src"), F.col(key).cast("bigint").alias("key"), F.col(text).alias("text"))
        for src, (df, key, text) in tables.items()
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def look_alike_pairs(rows: DataFrame) -> DataFrame:
    """Pairs of rows of one source whose texts print alike but are different strings.

    Input (src, key, text); output (src, key_a, key_b), key_a < key_b, once each.  Null texts pair with nothing; rows
    with equal strings are no pair; an empty text pairs only with a text of invisible characters.  Only groups that
    hold two spellings are joined, on digests, so a text copied a million times in one spelling costs one grouped row;
    a hot group with two spellings is split by the adaptive skew join.
    """
    digests = materialize(
        rows.where(F.col("text").isNotNull()).select(
            "src", "key", F.unhex(F.md5(canonical_text(F.col("text")))).alias("form"), F.unhex(F.md5("text")).alias("spelling")
        ),
        "print-forms",
    )
    several = (
        digests.groupBy("src", "form")
        .agg(F.min("spelling").alias("lo"), F.max("spelling").alias("hi"))
        .where("lo <> hi")
        .select("src", "form")
    )
    mixed = materialize(digests.join(several, ["src", "form"], "left_semi"), "print-mixed")
    a = mixed.select("src", "form", F.col("key").alias("key_a"), F.col("spelling").alias("spelling_a"))
    b = mixed.select("src", "form", F.col("key").alias("key_b"), F.col("spelling").alias("spelling_b"))
    return (
        a.join(b, ["src", "form"])
        .where("key_a < key_b and spelling_a <> spelling_b")
        .select("src", "key_a", "key_b")
        .distinct()
    )

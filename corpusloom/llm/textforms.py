"""Texts that look the same but differ in their characters, brought to one form.

``unified`` is the form for comparisons: compatibility normalisation (NFKC), default-ignorable characters removed, white
space mapped to single spaces, look-alike letters brought to the script of their word, full case folding.
``appearance`` is the stricter form of what a reader sees: letter case and inner white space stay visible.

Both run once per distinct value of an Arrow batch. Null stays null; a text of blanks becomes the empty string.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values (Unicode Character Database): Default_Ignorable_Code_Point.
_IGNORABLE = re.compile(
    "[\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180f\u200b-\u200f\u202a-\u202e\u2060-\u206f\u3164"
    "\ufe00-\ufe0f\ufeff\uffa0\ufff0-\ufff8\U0001bca0-\U0001bca3\U0001d173-\U0001d17a\U000e0000-\U000e0fff]"
)
_BLANKS = re.compile(r"\s+")
# Fixed values (Unicode confusables): letters whose glyphs are those of Latin letters, by script.
_CYRILLIC_LOOKS = ("асеорхуіѕјһԁԛԝАВЕКМНОРСТХІЅЈ", "aceopxyisjhdqwABEKMHOPCTXISJ")
_GREEK_LOOKS = ("αγικνορυχϲϳΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹϺ", "ayikvopuxcjABEZHIKMNOPTYXCM")
_OTHER_LOOKS = (
    # eth and African D, dotless i, script a and g, iota, Latin upsilon, small capitals
    "ÐƉıɑɡɩʋᴄᴏᴠᴡᴢ"
    # palochka, Cyrillic we and pe with forms of their own, Armenian
    "ӀӏԌԍҮүցհոսօՏՍՕ"
    # Cherokee
    "ᎪᏴᏟᎠᎬᎻᎫᏦᏞᎷᏢᏒᏚᎢᏙᎳᏃ",
    "ĐĐiagivcovwzIlGgYyghnuoSUOABCDEHJKLMPRSTVWZ",
)

_TO_LATIN = str.maketrans(*("".join(x) for x in zip(_CYRILLIC_LOOKS, _GREEK_LOOKS, _OTHER_LOOKS)))
_TO_CYRILLIC = str.maketrans(_CYRILLIC_LOOKS[1] + "oABEHKMOPTX", _CYRILLIC_LOOKS[0] + "оАВЕНКМОРТХ")
_TO_CYRILLIC |= str.maketrans("αορχΑΒΕΗΚΜΟΡΤΧ", "аорхАВЕНКМОРТХ")
_LOOKS = _CYRILLIC_LOOKS[0] + _GREEK_LOOKS[0] + _OTHER_LOOKS[0]
# the letters themselves, and those that are composed of one and a mark
_LOOKALIKE = re.compile(f"[{_LOOKS}{''.join(c for c in map(chr, (*range(0x370, 0x530), *range(0x1F00, 0x2000))) if unicodedata.normalize('NFD', c)[0] in _LOOKS and c not in _LOOKS)}]")
_LATIN_ONLY = re.compile(f"[^\\W\\d_{_CYRILLIC_LOOKS[1]}{_GREEK_LOOKS[1]}{_OTHER_LOOKS[0][:3]}\u0250-\U0010ffff]")
_CYRILLIC_ONLY = re.compile(f"(?![{_LOOKS}])[\u0400-\u052f]")
_GREEK_ONLY = re.compile(f"(?![{_LOOKS}])[\u0370-\u03ff]")
_WORD = re.compile(r"[^\W\d_]+(?:[\u0300-\u036f][^\W\d_]*)*")


def _bare(text: str) -> str:
    """Compatibility form, composed, without default-ignorable characters."""
    return unicodedata.normalize("NFKC", _IGNORABLE.sub("", text))


def _one_script(text: str) -> str:
    """Look-alike letters in the script of their word, or of the text where the word has no letter of its own script."""
    text = unicodedata.normalize("NFD", text)
    latin_text = len(_LATIN_ONLY.findall(text)) >= len(_CYRILLIC_ONLY.findall(text))

    def word(m: re.Match) -> str:
        w = m[0]
        latin, cyrillic = bool(_LATIN_ONLY.search(w)), bool(_CYRILLIC_ONLY.search(w))
        if latin == cyrillic:
            if not latin and _GREEK_ONLY.search(w):
                return w  # a Greek word
            latin = latin_text
        return w.translate(_TO_LATIN if latin else _TO_CYRILLIC)

    return unicodedata.normalize("NFC", _WORD.sub(word, text))


def unified(text: str) -> str:
    """The one form under which texts that look the same, or differ in case, are equal."""
    if not text.isascii():
        text = _bare(text)
        if _LOOKALIKE.search(text):
            text = _one_script(text)
        text = unicodedata.normalize("NFKC", text.casefold())
    else:
        text = text.lower()
    return _BLANKS.sub(" ", text).strip()


def appearance(text: str) -> str:
    """What a reader sees: as ``unified``, but letter case and inner blanks count. Blanks at the ends do not show."""
    if text.isascii():
        return text.strip()
    text = _bare(text)
    if _LOOKALIKE.search(text):
        text = unicodedata.normalize("NFC", unicodedata.normalize("NFD", text).translate(_TO_LATIN))
    return text.strip()


def per_distinct(column: pa.Array, form: Callable[[str], object], kind: pa.DataType) -> pa.Array:
    """``form`` of every value, called once per distinct value; null stays null."""
    coded = column.dictionary_encode()
    done = pa.array([None if t is None else form(t) for t in coded.dictionary.to_pylist()], kind)
    return done.take(coded.indices)


def add_form(df: DataFrame, column: str, out: str, form: Callable[[str], str] = unified) -> DataFrame:
    """``df`` with the form of ``column`` in ``out``."""
    position, names = df.columns.index(column), [*df.columns, out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, per_distinct(batch.column(position), form, pa.string())], names=names)

    return df.mapInArrow(run, df.withColumn(out, F.lit(None).cast("string")).schema)


def _digest(c) -> tuple:
    """96 bits of a text, for joins in place of the text itself."""
    return F.xxhash64(c), F.hash(c)


def same_look_pairs(left: DataFrame, left_id: str, left_text: str, right: DataFrame, right_id: str, right_text: str) -> DataFrame:
    """Pairs ``(left_id, right_id)`` whose texts look the same but are not equal character by character.

    Distinct texts of either side are brought to the unified form and joined by its digest; the appearance decides. Only
    then are texts expanded to rows, so rows of equal texts, however many, never meet. Where both identifiers have one name,
    the right one is returned as ``<name>_right``.
    """
    right_out = f"{right_id}_right" if right_id == left_id else right_id
    sides = []
    for df, ident, text, side in ((left, left_id, left_text, 0), (right, right_id, right_text, 1)):
        t = F.col(text)
        sides.append(df.where(t.isNotNull()).select(F.col(ident).alias("id"), t.alias("text"), F.lit(side).cast("tinyint").alias("side")))
    members = sides[0].unionByName(sides[1]).withColumns(dict(zip(("h1", "h2"), _digest(F.col("text")))))

    def forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(3)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], per_distinct(texts, unified, pa.string()), per_distinct(texts, appearance, pa.string())],
                names=["h1", "h2", "side", "form", "look"],
            )

    distinct = members.groupBy("h1", "h2", "side").agg(F.first("text").alias("text"))
    formed = distinct.mapInArrow(forms, "h1 bigint, h2 int, side tinyint, form string, look string").where("form <> ''")
    f1, f2 = _digest(F.col("form"))
    l1, l2 = _digest(F.col("look"))
    coded = formed.select("h1", "h2", "side", f1.alias("f1"), f2.alias("f2"), l1.alias("l1"), l2.alias("l2"))
    a = coded.where("side = 0").select("f1", "f2", "l1", "l2", F.col("h1").alias("a1"), F.col("h2").alias("a2"))
    b = coded.where("side = 1").select("f1", "f2", "l1", "l2", F.col("h1").alias("b1"), F.col("h2").alias("b2"))
    same = a.join(b, ["f1", "f2", "l1", "l2"]).where("a1 <> b1 or a2 <> b2").select("a1", "a2", "b1", "b2")
    rows_a = members.where("side = 0").select(F.col("h1").alias("a1"), F.col("h2").alias("a2"), F.col("id").alias(left_id)).distinct()
    rows_b = members.where("side = 1").select(F.col("h1").alias("b1"), F.col("h2").alias("b2"), F.col("id").alias(right_out)).distinct()
    return same.join(rows_a, ["a1", "a2"]).join(rows_b, ["b1", "b2"]).select(left_id, right_out).distinct()

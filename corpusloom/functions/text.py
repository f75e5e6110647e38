"""Text expressions that stay in the JVM, and the two scalar functions Spark has no expression for."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from corpusloom.functions.blanks import strip_blanks

# Unicode white space as Python's str.isspace has it, spelt for Java and RE2 alike.
SPACE_CLASS = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"


def clean_text(c: Column) -> Column:
    """Line breaks, tabs and all other white space to single spaces, straight double quotes dropped; null -> ''."""
    bare = F.regexp_replace(F.coalesce(c, F.lit("")), '"', "")
    spaced = F.regexp_replace(bare, SPACE_CLASS + "+", " ")
    return F.trim(spaced)


def first_filled(*columns: Column) -> Column:
    """The first column that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def as_float(c: Column) -> Column:
    """Packaged number: '', nan, none and null in any case are missing, and so is what cannot be read."""
    s = F.lower(strip_blanks(c))
    v = F.when(~s.isin("", "nan", "none", "null"), s.try_cast("double"))
    return F.when(~F.isnan(v), v)


def as_bool(c: Column) -> Column:
    """True for true, 1 and yes in any case; everything else, null included, is false."""
    return F.coalesce(F.lower(strip_blanks(c)).isin("true", "1", "yes"), F.lit(False))


def file_stem(c: Column) -> Column:
    """File name without folders and without its last suffix."""
    name = F.regexp_extract(c, r"([^/]*)$", 1)
    return F.when(name.rlike(r"^.+\.[^.]*$"), F.regexp_extract(name, r"^(.+)\.[^.]*$", 1)).otherwise(name)


def contains_han(c: Column) -> Column:
    return c.rlike("[\\u4e00-\\u9fff]")


def only_punctuation(c: Column) -> Column:
    """Nothing but punctuation and symbols; the empty text counts."""
    return c.rlike(r"^[\p{P}\p{S}]*$")


@F.pandas_udf(StringType())
def nfc(texts: pd.Series) -> pd.Series:
    """Canonical composition, which Spark has no function for."""
    return texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", t))


# Base letters that carry a Vietnamese mark, lower case, composed.
_VI_MARKS = (
    "ăâđêôơư" "àáảãạằắẳẵặèéẻẽẹìíỉĩịòóỏõọùúủũụỳýỷỹỵ" "ầấẩẫậềếểễệồốổỗộờớởỡợừứửữự"
)


def contains_vietnamese(c: Column) -> Column:
    """Whether a letter with a Vietnamese mark occurs, composed or not, in either case."""
    return F.lower(nfc(c)).rlike(f"[{_VI_MARKS}]")


def detect_language(c: Column) -> Column:
    """``zh`` with a Han character, else ``vi`` with a Vietnamese mark, else ``en``."""
    return F.when(contains_han(c), "zh").when(contains_vietnamese(c), "vi").otherwise("en")


def replace_corner_marks(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("²"), F.lit("平方")), F.lit("³"), F.lit("立方"))


def remove_brackets(c: Column) -> Column:
    return F.replace(F.regexp_replace(c, "[（）【】`]", ""), F.lit("——"), F.lit(" "))


def drop_blanks_between_han(c: Column) -> Column:
    """A space stays only between two ASCII characters that are no spaces themselves."""
    return F.regexp_replace(c, r"(?<![\x21-\x7e\x00-\x1f\x7f]) | (?![\x21-\x7e\x00-\x1f\x7f])", "")


def chinese_form(c: Column) -> Column:
    """The Chinese pre-pass: blanks, corner marks, full stops, dashes, brackets, trailing commas. Reading of numbers is external."""
    t = replace_corner_marks(drop_blanks_between_han(c))
    t = F.replace(F.replace(t, F.lit("."), F.lit("。")), F.lit(" - "), F.lit("，"))
    return F.regexp_replace(remove_brackets(t), "[，,、]+$", "。")


# Language codes and the names the instruction uses.
LANGUAGE_NAMES = dict(
    pair.split(":")
    for pair in """
    zh:中文 ja:日语 ko:韩语 vi:越南语 th:泰语 id:印尼语 ms:马来语 tl:菲律宾语 my:缅甸语 km:高棉语 lo:老挝语 hi:印地语 bn:孟加拉语 ta:泰米尔语
    te:泰卢固语 mr:马拉地语 gu:古吉拉特语 kn:卡纳达语 ml:马拉雅拉姆语 pa:旁遮普语 ur:乌尔都语 ne:尼泊尔语 si:僧伽罗语 en:英文 de:德语 nl:荷兰语 sv:瑞典语
    da:丹麦语 no:挪威语 nb:挪威语 nn:挪威语 is:冰岛语 af:南非荷兰语 lb:卢森堡语 fy:弗里斯兰语 fr:法语 es:西班牙语 pt:葡萄牙语 it:意大利语 ro:罗马尼亚语
    ca:加泰罗尼亚语 gl:加利西亚语 oc:奥克语 la:拉丁语 ru:俄语 uk:乌克兰语 pl:波兰语 cs:捷克语 sk:斯洛伐克语 bg:保加利亚语 sr:塞尔维亚语 hr:克罗地亚语
    sl:斯洛文尼亚语 mk:马其顿语 bs:波斯尼亚语 be:白俄罗斯语 lt:立陶宛语 lv:拉脱维亚语 fi:芬兰语 et:爱沙尼亚语 hu:匈牙利语 ga:爱尔兰语 cy:威尔士语
    gd:苏格兰盖尔语 br:布列塔尼语 el:希腊语 sq:阿尔巴尼亚语 eu:巴斯克语 mt:马耳他语 tr:土耳其语 az:阿塞拜疆语 kk:哈萨克语 uz:乌兹别克语 tk:土库曼语
    ky:吉尔吉斯语 tt:鞑靼语 ar:阿拉伯语 he:希伯来语 am:阿姆哈拉语 fa:波斯语 ps:普什图语 ku:库尔德语 tg:塔吉克语 ka:格鲁吉亚语 hy:亚美尼亚语 sw:斯瓦希里语
    yo:约鲁巴语 ha:豪萨语 ig:伊博语 zu:祖鲁语 xh:科萨语 mn:蒙古语 eo:世界语
    """.split()
)
# Codes the service accepts.
SERVED = ("zh", "en", "ja", "ko", "de", "fr", "th", "id", "vi", "es", "pt", "it", "ru", "ms")


def language_instruction(lang: Column, names: dict[str, str] | None = None) -> Column:
    """The instruction of a known code; an unknown one stands for its own name."""
    known = F.create_map(*[F.lit(x) for pair in (names or LANGUAGE_NAMES).items() for x in pair])
    return F.concat(F.lit("请用"), F.coalesce(F.try_element_at(known, lang), lang), F.lit("朗读接下来的文字"))


def prompt(lang: Column, text: Column, names: dict[str, str] | None = None) -> Column:
    return F.concat(F.lit("You are a helpful assistant. "), language_instruction(lang, names), F.lit(":"), text)


def request_error(text: Column, lang: Column, max_chars: int = 1024) -> Column:
    """Why a request is refused, or null: blank text, over-long text, language not served."""
    return (
        F.when(F.coalesce(F.regexp_replace(text, SPACE_CLASS, ""), F.lit("")) == "", "blank_text")
        .when(F.length(text) > max_chars, "text_too_long")
        .when(~F.coalesce(lang.isin(*SERVED), F.lit(False)), "language_not_served")
    )


def join_prompt_and_target(prompt_text: Column, target: Column, joint: str = " ") -> Column:
    """Prompt transcript, closed with a period unless it ends in punctuation, and the target behind it."""
    p = strip_blanks(prompt_text)
    closed = F.when((p != "") & ~p.rlike(r"[.?!;:。？！]$"), F.concat(p, F.lit("."))).otherwise(p)
    return F.concat(closed, F.lit(joint), strip_blanks(target))


def words_of(c: Column) -> Column:
    """Words between white space; the empty text has none."""
    return F.filter(F.split(c, SPACE_CLASS + "+"), lambda w: w != "")


_SMALL = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
_TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
_SCALES = ["", "thousand", "million", "billion", "trillion", "quadrillion", "quintillion", "sextillion", "septillion", "octillion", "nonillion", "decillion"]


def _below_thousand(n: int) -> str:
    hundreds, rest = divmod(n, 100)
    tail = _SMALL[rest] if rest < 20 else _TENS[rest // 10 - 2] + (f"-{_SMALL[rest % 10]}" if rest % 10 else "")
    if not hundreds:
        return tail
    return f"{_SMALL[hundreds]} hundred" + (f" and {tail}" if rest else "")


def english_number(digits: str) -> str:
    """Cardinal words of a digit run; beyond the named scales the digits are read one by one."""
    n = int(digits) if len(digits) <= 36 else None
    if n is None:
        return " ".join(_SMALL[int(d)] for d in digits)
    if n < 1000:
        return _below_thousand(n)
    groups, scale = [], 0
    while n:
        n, part = divmod(n, 1000)
        if part:
            groups.append(f"{_below_thousand(part)} {_SCALES[scale]}".strip())
        scale += 1
    last_small = int(digits) % 1000
    groups.reverse()
    if 0 < last_small < 100:
        return ", ".join(groups[:-1]) + f" and {groups[-1]}"
    return ", ".join(groups)


@F.pandas_udf(StringType())
def spell_out_numbers(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Digit runs replaced by English words."""
    import re

    run = re.compile(r"\d+")
    for texts in batches:
        yield texts.map(lambda t: None if t is None else run.sub(lambda m: english_number("".join(str(unicodedata.digit(c)) for c in m[0])), t))


_HIRAGANA_TO_KATAKANA = {c: c + 0x60 for c in (*range(0x3041, 0x3097), 0x309D, 0x309E)}


@F.pandas_udf(StringType())
def hiragana_to_katakana(texts: pd.Series) -> pd.Series:
    """Kana only; readings of kanji need a dictionary and are left to a tokenizer UDF."""
    return texts.map(lambda t: None if t is None else t.translate(_HIRAGANA_TO_KATAKANA))


def normalization_language(text: Column, language: Column) -> Column:
    """The language whose rules apply: the one named, by its characters where it is ``auto``; any other is read as English."""
    named = F.lower(language)
    return F.when(named == "auto", detect_language(text)).when(named.isin("zh", "vi", "ja"), named).otherwise("en")


def normalize(text: Column, language: Column, vietnamese) -> Column:
    """White space squeezed, then the rules of the text's language; ``vietnamese`` is the UDF that ``vi_normalize_udf`` makes."""
    t = clean_text(text)
    chosen = normalization_language(t, language)
    return (
        F.when(chosen == "zh", chinese_form(t))
        .when(chosen == "vi", vietnamese(F.when(chosen == "vi", t)))
        .when(chosen == "ja", hiragana_to_katakana(F.when(chosen == "ja", t)))
        .otherwise(spell_out_numbers(F.when(chosen == "en", t)))
    )

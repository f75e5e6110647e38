"""Keyword-stuffed and link-list pages.

A page is cut into windows of WINDOW tokens (words; characters in Chinese and Japanese). Of every window these signals are
measured on the text without disguises: the share of different words, the share of its most frequent content word, the
share of word pairs (four characters in Chinese and Japanese) that occur again in it, the shares of its characters in
links and in tags, the density of list marks (separators) and of codes and numbers, the share of function words, and
whether a whole sentence ends in it. A line or sentence that occurs again is measured once and weighs as often as it
occurs, so songs and drills, which repeat whole sentences, keep the signals of their sentences; where what occurs again is
no sentence (too few function words, and not LONG tokens with a sentence mark at the end), its repeats count in the share of
different words (pages of keyword lines).

Thresholds are relative to the language's own medians over all windows of the corpus. A window is junk when

- its diversity is below DIVERSITY of the median, or is with all repeats where function words are below FUNCTION of theirs,
- its most frequent content word has TOP times the median share and its repeated pairs have the share GRAMS,
- links (one in ten tokens at least) or tags fill it, or
- it is a list: dense in separators or codes, with function words below FUNCTION of the median; in a language whose function
  words are not known, twice as dense and without the end of a sentence.

A window that only links fill counts as far as links and their captions go. A page is junk when more than half of its text is.

The language is the one whose script or function words the page shows, else the one the corpus names for it (``hint``).
Languages of fewer than LEAST_WINDOWS windows are held to the medians over all windows of known languages.

Defined cases: null, empty and blank texts are no junk; pages of an unrecognised language are held to the medians over
all windows; windows of under LEAST words (repeats included, where they count) are not judged by diversity; repeated rows
give repeated results; empty input -> empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.textforms import _LOOKALIKE, _bare, _one_script
from corpusloom.runtime import materialize

WINDOW, LEAST, LONG, LEAST_WINDOWS = 40, 15, 8, 50
DIVERSITY, LINKS, TAGS, SEPARATORS, CODES, FUNCTION, TOP, GRAMS = 0.70, 0.4, 0.4, 0.06, 0.15, 0.5, 3.0, 0.2
LINK_DENSITY = 0.1
CAPTIONS = 1.25  # what links fill with their captions, as a multiple of the links
_VOCABULARY = 500_000  # tokens a task remembers

# The closed word classes (articles, pronouns, prepositions, conjunctions, particles, auxiliaries) of each
# language; for Chinese and Japanese the characters they are written with.
FUNCTION_WORDS = {
    "vi": "và của là có cho một các những được trong với không này đã khi người ở từ để đến ra vào cũng như thì mà rồi lại trên dưới bởi vì nhưng còn sau trước đang sẽ tôi anh chị em bạn ông bà nó họ chúng ta mình đó kia ấy nào gì ai đâu nếu nên hay hoặc tại theo về cùng qua lên xuống ngoài giữa cạnh bên chỉ rất hơi quá lắm đều vẫn do bằng chưa đừng hãy nhé ạ à ừ thế vậy suốt mấy mỗi mọi",
    "en": "the a an and of to in is was for on that with as at by from it its had has have his her their our my your he she they we you i not no but or so if than then when while where before after near behind under over above between through into onto around about during since until because although though however one some any each this these those who which what there here be been being are were am do does did will would can could may might must shall should up down out off again once only very too also all",
    "fr": "le la les un une et de des du à au aux en dans pour par sur sous avec sans chez vers entre pendant depuis avant après devant derrière près est sont était a ont avait que qui dont où se sa son ses leur leurs mon ma mes notre nos votre ce cet cette ces ne pas plus mais ou donc ni car si comme quand lorsque d l s n c j qu il elle ils elles on nous vous je tu y lui même très aussi encore puis alors",
    "de": "der die das den dem des ein eine einer einem einen eines und oder aber doch denn sondern von zu zum zur mit auf im in an am bei nach vor über unter neben zwischen hinter für aus um durch gegen ohne seit bis während wegen trotz ist sind war hat haben hatte wird werden nicht kein keine sehr auch noch schon nur wieder wie als wenn weil dass ob obwohl sich er sie es wir ihr ich du man sein seine seiner ihre ihren ihrem mein dein unser dieser diese dieses",
    "es": "el la los las un una unos unas y e o u ni pero sino de del a al en con por para sin sobre entre hasta desde hacia según durante tras ante bajo cerca que quien donde cuando como porque aunque si se su sus mi mis tu es son era fue ha han había no muy más menos ya también lo le les me te nos él ella ellos este esta estos ese esa mientras antes después junto detrás",
    "ru": "и а но или да в во на с со к ко у о об от до из за по для при без под над перед между через около возле после вокруг среди из-за не ни же бы ли ещё еще уже только очень так как что чтобы если когда хотя потому где куда это этот эта эти тот та то те его ее её их он она оно они мы вы я ты свой своя мой наш был была было были есть будет",
    "zh": "的了在是不和有也就着来从到那这我你他她它们个上下里把被给让与而已地得以为于但或若因所之其都又还很才再向往对等吗呢吧啊",
    "ja": "のをにはがでともたしてるいなかられさまだよねうこそあっけすやへばどりく",
}
_LANGUAGES = list(FUNCTION_WORDS)
_OTHER = len(_LANGUAGES)
_FUNCTION = {k: frozenset(v if k in ("zh", "ja") else v.split()) for k, v in FUNCTION_WORDS.items()}
_LATIN = [i for i, k in enumerate(_LANGUAGES) if k not in ("zh", "ja", "ru")]
_ANY_LATIN = sum(1 << i for i in _LATIN)

_GENERIC = "com|net|org|info|biz|edu|gov|io|co|app|dev|shop|store|online|site|xyz|top|club"
_PATH = r"(?:[/?#][^\s<>()\[\]\"']*)?"
_HIDDEN = r"\s?(?:\[\.\]|\(\.\)|[(\[{]dot[)\]}])\s?|\sdot\s"  # what is written for the dot to hide an address from programs
_ITEM = r",;|•·»›>★☆◆■●▶→*~=+‣/"
_LINK = re.compile(
    r"</?a\b[^<>]*>|(?:https?|hxxps?|ftp):(?://)?[^\s<>()\[\]\"',]+(?:\(dot\)|\[\.\])?[^\s<>()\[\]\"',]*"
    r"|www\.[^\s<>()\[\]\"',]+"
    rf"|(?<![\w-])[\w-]+(?:\.[\w-]+)*(?:(?:\.|\s\.\s)(?:{_GENERIC})\b{_PATH}(?:\s/\s[\w-]+)*"
    rf"|(?:{_HIDDEN})[a-z]{{2,}}\b{_PATH}(?:\s/\s[\w-]+)*|\.[a-z]{{2,}}/[^\s<>()\[\]\"']+|\s\.\s[a-z]{{2,}}\s/\s[\w-]+)"
    # under any other domain a bare name is a link where it is an item of a list
    rf"|(?:(?<=[{_ITEM}]\s)|(?<=[{_ITEM}-])|^)[a-z0-9][\w-]*(?:\.[\w-]+)*(?:\.|\s\.\s)[a-z]{{2,24}}(?=\s*(?:[{_ITEM}]|-\s|$))"
)
_SIGNS = ("://", "www.", "hxxp", "ftp:", "<a", "</a", " . ", "[.]", "(.)", " dot ", "(dot)", "[dot]", "{dot}")
_INNER_DOT = re.compile(r"\.[a-z]{2}")
_TAG = re.compile(r"(?<![\w&])#[^\s#]+")
_LINKED, _TAGGED = "\ue000", "\ue001"  # private characters that stand for a link and a tag, as often as it is long
_PRIVATE = re.compile(f"[{_LINKED}{_TAGGED}]")
_ENDS = ".!?。！？"
_CUT = re.compile(r"[.!?。！？\n]\s*")
_LABEL = re.compile(r"^[^\W_][^\n:：.!?。！？,，#\ue000\ue001]{0,40}[:：](?=\s)", re.MULTILINE)  # who speaks, in a dialogue
_UNIT = re.compile(r"\n+|(?<=[.!?])\s+|(?<=[。！？])\s*")
_CJK = "\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff"
_MARKS = "»›>|·•★☆/;*~=+<←→►▶◆■□●○‣–—"
_OTHERS = rf"{_LINKED}+|{_TAGGED}+|[{_MARKS}]|(?<=\s)-(?=\s)|[.!?]+(?!\w)|[。！？]+|\n"
_TOKEN = re.compile(f"[^\\W_]+|{_OTHERS}")
_HAS_CJK = re.compile(f"[{_CJK}]")
_HAS_VOWEL_SIGNS = re.compile("[\u0900-\u109f\u1780-\u17ff]")  # scripts whose vowel signs are no letters to the expression engine
_VOWEL_SIGN_TOKEN = re.compile(f"(?:[^\\W_]|[\u0900-\u0dff\u0e31\u0e34-\u0e3a\u0e47-\u0e4e\u0eb1-\u0ecd\u1000-\u109f\u1780-\u17d3])+|{_OTHERS}")
_CJK_TOKEN = re.compile(f"[{_CJK}]|[^\\W_{_CJK}]+|{_OTHERS}")
_WORD, _SEPARATOR, _LINK_RUN, _TAG_RUN, _END, _LINE = range(6)
_KINDS = {m: _SEPARATOR for m in _MARKS + "-"} | {_LINKED: _LINK_RUN, _TAGGED: _TAG_RUN, "\n": _LINE} | {m: _END for m in _ENDS}
_SIGNALS = ["diversity", "top", "grams", "function", "link", "tag", "separators", "codes", "sentences", "weight", "repeated", "form"]
_SCHEMA = "lang string, windows array<struct<" + ",".join(f"{s}:float" for s in _SIGNALS) + ">>"


class _Tokens(dict):
    """Token -> number; ``rows`` holds by number its kind, length, script, whether it has a digit, and a bit per language it is a function word of."""

    def __init__(self) -> None:
        self.rows: list[tuple[int, int, int, int, int]] = []

    def __missing__(self, token: str) -> int:
        first = token[0]
        kind = _KINDS.get(first, _WORD)
        script = 1 if "\u3040" <= first <= "\u30ff" else 2 if "\u3400" <= first <= "\u9fff" else 3 if "\u0400" <= first <= "\u04ff" else 4 if first >= "\u0370" and not "\u1e00" <= first <= "\u1eff" else 0
        function = sum(1 << i for i, k in enumerate(_LANGUAGES) if token in _FUNCTION[k])
        self[token] = len(self.rows)
        self.rows.append((kind, len(token), script, kind == _WORD and any(map(str.isdigit, token)), function))
        return self[token]


def _may_link(text: str) -> bool:
    return any(map(text.__contains__, _SIGNS)) or _INNER_DOT.search(text) is not None


def _tokens(text: str) -> tuple[list[str], list[int] | None]:
    """The tokens of the page's different units, and how often each unit occurs where one does again; a line break ends a unit."""
    token = _TOKEN
    if not text.isascii():
        text = _bare(text)
        if _LOOKALIKE.search(text):
            text = _one_script(text)
        if _HAS_CJK.search(text):
            token = _CJK_TOKEN
        elif _HAS_VOWEL_SIGNS.search(text):
            token = _VOWEL_SIGN_TOKEN
    text = _PRIVATE.sub("", text.casefold())
    if _may_link(text):
        text = "\n".join([_LINK.sub(lambda m: f" {_LINKED * len(m[0])} ", line) if _may_link(line) else line for line in text.split("\n")])
    if "#" in text:
        text = _TAG.sub(lambda m: _TAGGED * len(m[0]), text)
    text = _LABEL.sub("", text)
    times = None
    pieces = _CUT.split(text)
    if len(set(pieces)) < len(pieces):
        counts = Counter(filter(None, _UNIT.split(text)))
        if len(counts) < counts.total():
            text, times = "\n".join(counts), list(counts.values())
    return token.findall(text), times


def _longest_runs(rows: np.ndarray) -> np.ndarray:
    """The length of the longest run of equal numbers in every (sorted) row."""
    changes = np.ones(rows.shape, bool)
    changes[:, 1:] = rows[:, 1:] != rows[:, :-1]
    starts = np.nonzero(changes.ravel())[0]
    lengths = np.diff(np.append(starts, rows.size))
    return np.maximum.reduceat(lengths, np.searchsorted(starts, np.arange(len(rows)) * rows.shape[1])) if len(rows) else lengths


def measure(texts: list[str], hints: list[str | None], known: _Tokens) -> tuple[list[str], np.ndarray, dict[str, np.ndarray]]:
    """Language and number of windows of every text, and the signals of all windows (NaN = not judged)."""
    found, times = zip(*map(_tokens, texts)) if texts else ((), ())
    sizes = np.array([len(t) for t in found], np.int64)
    total = int(sizes.sum())
    ids = np.fromiter(map(known.__getitem__, chain.from_iterable(found)), np.int64, total)
    kinds, lengths, scripts, digits, functions = np.array(known.rows, np.int64).reshape(-1, 5).T
    kind, page = kinds[ids], np.repeat(np.arange(len(texts)), sizes)

    # units: up to a sentence mark or line break; a page with repeated units has one a line
    boundary = (kind == _END) | (kind == _LINE)
    plain = np.cumsum(~boundary)
    stops = np.nonzero(boundary)[0]
    before = np.concatenate([[-1], stops[:-1]]) if len(stops) else stops
    since = plain[stops] - np.where(before >= 0, plain[before], 0)  # tokens since the boundary before, the page before included
    first_of_page = np.concatenate([[0], np.cumsum(sizes)[:-1]])[page[stops]] if len(stops) else stops
    in_page = plain[stops] - np.where(first_of_page > 0, plain[first_of_page - 1], 0)
    closing = np.zeros(total, bool)
    closing[stops] = (kind[stops] == _END) & (np.minimum(since, in_page) >= LONG)  # a whole sentence ends here
    mult, counted = np.ones(total, np.int64), np.ones(total, np.int64)
    if any(t is not None for t in times):
        at = np.cumsum(sizes) - sizes
        for p in [p for p, t in enumerate(times) if t is not None]:
            here = slice(at[p], at[p] + sizes[p])
            line = kind[here] == _LINE
            unit = np.cumsum(line) - line  # a line break belongs to the unit it ends
            m = np.array(times[p], np.int64)
            mult[here] = m[unit]
            whole = np.zeros(len(m), bool)
            whole[unit[closing[here]]] = True
            counted[here] = np.where(whole, 1, m)[unit]

    # what follows is about tokens proper
    proper = ~boundary
    ends = np.zeros(total + 1, np.int64)
    ends[1:] = np.cumsum(closing)
    ends_at = ends[:-1][proper]  # sentences that ended before the token
    ids, kind, page, mult, counted = ids[proper], kind[proper], page[proper], mult[proper], counted[proper]
    n = np.bincount(page, minlength=len(texts))
    start = np.cumsum(n) - n
    place = np.arange(len(ids)) - start[page]
    word, script, size = kind == _WORD, scripts[ids], lengths[ids]

    by_page = lambda values: np.bincount(page, weights=values, minlength=len(texts))
    chars = by_page(size)
    kana, han, cyrillic, foreign = (by_page(size * word * (script == s)) for s in (1, 2, 3, 4))
    hits = np.array([by_page((functions[ids] >> i) & 1) for i in range(_OTHER)])
    latin = np.array(_LATIN)[hits[_LATIN].argmax(0)]
    named = np.array([_LANGUAGES.index(h) if h in _LANGUAGES and _LANGUAGES.index(h) in _LATIN else _OTHER for h in hints], np.int64)
    lang = np.where(12 * hits[latin, np.arange(len(texts))] > n, latin, np.where(3 * foreign < chars, named, _OTHER))
    lang = np.where(3 * cyrillic > chars, _LANGUAGES.index("ru"), lang)
    lang = np.where(3 * (kana + han) > chars, np.where(10 * kana > han, _LANGUAGES.index("ja"), _LANGUAGES.index("zh")), lang)

    # windows: the last one of a page takes a rest of under half a window
    windows = np.where(n > 0, np.maximum(1, (n + WINDOW - WINDOW // 2) // WINDOW), 0)
    first = np.cumsum(windows) - windows
    within = np.minimum(place // WINDOW, windows[page] - 1)
    w = first[page] + within
    count = int(windows.sum())
    by_window = lambda values: np.bincount(w, weights=values, minlength=count)
    lang_of = lang[page]
    cjk = (lang_of == _LANGUAGES.index("zh")) | (lang_of == _LANGUAGES.index("ja"))
    size = size + ~cjk
    tokens, whole = by_window(np.ones(len(ids))), by_window(size)
    words = by_window(word)
    flag = functions[ids]
    own = np.where(lang_of < _OTHER, (flag >> np.minimum(lang_of, _OTHER - 1)) & 1, 0)
    form = np.where(lang_of < _OTHER, own, (flag & _ANY_LATIN) > 0)
    with np.errstate(invalid="ignore", divide="ignore"):
        nan = np.nan
        window_lang = np.repeat(lang, windows)
        share = np.where(window_lang < _OTHER, by_window(own * word) / words, nan)
        shape = by_window(form * word) / words
        links = by_window(kind == _LINK_RUN)
        link = np.where(links >= LINK_DENSITY * tokens, by_window(size * (kind == _LINK_RUN)) / whole, 0.0)
        tag = by_window(size * (kind == _TAG_RUN)) / whole

        # words of at most WINDOW tokens, a row per window; other places hold numbers of their own
        column = place - WINDOW * within
        judged = word & (column < WINDOW)
        of, column = w[judged], column[judged]
        empty = -1 - np.arange(WINDOW)
        rows = np.tile(empty, (count, 1))
        rows[of, column] = ids[judged]
        seen = np.bincount(of, minlength=count)
        in_order = np.sort(rows, axis=1)
        different = 1 + (in_order[:, 1:] != in_order[:, :-1]).sum(1) - (WINDOW - seen) if count else seen
        content = rows.copy()
        content[of, column] = np.where(form[judged] > 0, empty[column], ids[judged])
        top = _longest_runs(np.sort(content, axis=1))
        with_repeats = np.bincount(of, weights=counted[judged], minlength=count)
        again = (with_repeats > seen) & (with_repeats >= LEAST)
        # pairs of words (four characters) that occur again
        grams = np.zeros(count)
        glyphs = np.isin(window_lang, [_LANGUAGES.index("zh"), _LANGUAGES.index("ja")])
        for step, chosen in ((2, ~glyphs), (4, glyphs)):
            code = np.zeros((int(chosen.sum()), WINDOW - step + 1), np.uint64)
            for i in range(step):
                code = (code ^ rows[chosen, i : i + code.shape[1]].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
                code ^= code >> np.uint64(29)
            code.sort(axis=1)
            same = code[:, 1:] == code[:, :-1]
            twice = np.zeros(code.shape, bool)
            twice[:, 1:] = same
            twice[:, :-1] |= same
            grams[chosen] = twice.sum(1) / np.maximum(seen[chosen] - step + 1, 1)
        firsts = np.concatenate([np.nonzero(np.diff(w, prepend=-1))[0], [len(ids)]]).astype(np.int64) if len(ids) else np.zeros(1, np.int64)
        all_ends = int(ends[-1])
        reached = np.append(ends_at, all_ends)[firsts]
        out = {
            "diversity": np.where(seen >= LEAST, different / seen, nan),
            "top": np.where(seen >= LEAST, top / seen, nan),
            "grams": grams,
            "function": share,
            "link": link,
            "tag": tag,
            "separators": by_window(kind == _SEPARATOR) / tokens,
            "codes": by_window(digits[ids]) / tokens,
            "sentences": np.diff(reached).astype(float),
            "weight": by_window(size * mult),
            "repeated": np.where(again, different / with_repeats, nan),
            "form": np.where(again, shape, nan),
        }
    return [_LANGUAGES[i] if i < _OTHER else "other" for i in lang.tolist()], windows, out


def page_signals(docs: DataFrame, ident: str, text: str, hint: str | None = None) -> DataFrame:
    """``(ident, lang, windows)`` of every page with a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Tokens()
        for batch in batches:
            for part in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
                if len(known) > _VOCABULARY:
                    known = _Tokens()
                langs, windows, signals = measure(part.column(1).to_pylist(), part.column(2).to_pylist(), known)
                fields = [pa.array(signals[s].astype(np.float32), from_pandas=True) for s in _SIGNALS]
                offsets = pa.array(np.concatenate([[0], np.cumsum(windows)]).astype(np.int32))
                lists = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(fields, names=_SIGNALS))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(langs, pa.string()), lists], names=[ident, "lang", "windows"])

    named = F.col(hint) if hint else F.lit(None).cast("string")
    chosen = docs.where(F.col(text).isNotNull()).select(F.col(ident).alias("_id"), F.col(text).alias("_text"), named.alias("_hint"))
    return chosen.mapInArrow(run, f"`{ident}` {chosen.schema['_id'].dataType.simpleString()}, {_SCHEMA}")


def thresholds(pages: DataFrame) -> DataFrame:
    """Per language (and over all, as ``other``) the medians of diversity, top-word and function-word share over all windows."""
    w = pages.select("lang", F.explode("windows").alias("w")).select(
        "lang", *[F.round(f"w.{s}", 2).alias(a) for s, a in (("diversity", "d"), ("top", "t"), ("function", "f"))]
    )
    counted = w.groupBy("lang", "d", "t", "f").agg(F.count("*").alias("n")).where("lang <> 'other'")  # bounded by the rounding
    every = counted.withColumn("lang", F.lit("other"))
    medians = [F.percentile(c, 0.5, F.col("n")).alias(f"median_{c}") for c in ("d", "t", "f")]
    return counted.unionByName(every).groupBy("lang").agg(F.sum("n").alias("windows_seen"), *medians)


def junk_shares(docs: DataFrame, ident: str = "doc_id", text: str = "text", hint: str | None = None) -> DataFrame:
    """``(ident, lang, junk_share)`` of every page with a token; ``hint`` names a column with the corpus's own language label."""
    pages = materialize(page_signals(docs, ident, text, hint), "page-signals")
    medians = thresholds(pages)
    limits = F.broadcast(medians.where(f"windows_seen >= {LEAST_WINDOWS}").drop("windows_seen"))  # nine languages at most
    general = medians.where("lang = 'other'").select(*[F.col(f"median_{c}").alias(f"general_{c}") for c in "dtf"])
    joined = pages.join(limits, "lang", "left").join(F.broadcast(general), F.lit(True), "left")
    joined = joined.withColumns({f"median_{c}": F.coalesce(f"median_{c}", f"general_{c}") for c in "dtf"})
    no = F.lit(False)

    def share(w):
        low, few = DIVERSITY * F.col("median_d"), FUNCTION * F.col("median_f")
        stuffed = F.coalesce(w.diversity < low, no) | F.coalesce((w.top >= TOP * F.col("median_t")) & (w.grams >= GRAMS), no)
        again = F.coalesce((w.repeated < low) & (w.form < few), no)
        dense = F.greatest(w.separators / SEPARATORS, (w.codes + w.separators) / CODES)
        listed = F.when(w["function"].isNull(), (dense >= 2) & (w.sentences == 0)).otherwise((dense >= 1) & (w["function"] < few))
        return F.when(stuffed | again | (w.tag >= TAGS) | F.coalesce(listed, no), 1.0).when(w.link >= LINKS, F.least(F.lit(1.0), CAPTIONS * w.link)).otherwise(0.0)

    zero = F.lit(0.0)
    bad = F.aggregate("windows", zero, lambda s, w: s + share(w) * w.weight.cast("double"))
    whole = F.aggregate("windows", zero, lambda s, w: s + w.weight.cast("double"))
    return joined.where(F.size("windows") > 0).select(ident, "lang", (bad / whole).alias("junk_share"))


def junk_pages(docs: DataFrame, ident: str = "doc_id", text: str = "text", hint: str | None = None) -> DataFrame:
    """Pages of which more than half the text is junk."""
    return junk_shares(docs, ident, text, hint).where("junk_share > 0.5")

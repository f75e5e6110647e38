"""Text to segments of bounded length.

A segmentation is a choice among the text's cut points: the places behind a sentence mark (or, in a single over-long
piece, behind each word or each ``max_tokens`` characters). ``segment`` walks the points with any tokenizer and backs the UDTF
and the vectorized UDF; ``segments_by_chars`` folds the same points in the JVM for the character metric.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import pairwise

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# Marks that end a piece.
_MARKS = {"zh": "。？！；：.?!;", "vi": ".?!;:…"}
_OTHER_MARKS = ".?!;:"
_ZH_TRAILING = "。；：.;"


@dataclass(frozen=True)
class Limits:
    max_tokens: int = 80
    min_tokens: int = 60
    merge_below: int = 20
    split_on_comma: bool = False


def _marks(language: str, limits: Limits) -> str:
    return _MARKS.get(language, _OTHER_MARKS) + ("，," if limits.split_on_comma or language == "vi" else "")


def _piece(marks: str) -> str:
    """A piece as an expression: one character that may be a mark itself, text, a mark, and a straight quote behind it."""
    escaped = "".join(f"\\{m}" for m in marks)
    return f'[\\s\\S][^{escaped}]*[{escaped}]"?'


def _only_marks(text: str) -> bool:
    return all(unicodedata.category(c)[0] in "PS" for c in text)


def _points(text: str, marks: str, language: str, size: Callable[[str], int], limits: Limits) -> tuple[str, list[int]]:
    """The text to cut and its cut points, the last of which is its end."""
    points = [m.end() for m in re.finditer(_piece(marks), text)]
    if len(points) != 1 or size(text[: points[0]]) <= limits.max_tokens:
        return text, points
    bare = text[: points[0] - 1]
    if language != "vi":
        return bare, [*range(limits.max_tokens, len(bare), limits.max_tokens), len(bare)]
    bare += " "
    ends, start = [m.end() for m in re.finditer(" ", bare)], 0
    kept = []  # of the word ends those at which a line is full
    for before, end in pairwise(ends):
        if before > start + 1 and size(bare[start : end - 1]) > limits.max_tokens:
            kept.append(before)
            start = before
    return bare, [*kept, len(bare)]


def segment(text: str, tokenize: Callable[[str], list] = str.split, language: str = "zh", limits: Limits = Limits()) -> list[str]:
    """Segments of ``text``; its length is measured in characters for Chinese and in tokens otherwise."""
    size = len if language == "zh" else lambda t: len(tokenize(t))
    marks = _marks(language, limits)
    closed = text if not text or text[-1] in marks else text + ("。" if language == "zh" else ".")
    body, points = _points(closed, marks, language, size, limits)
    cuts = [0]
    for before, point in pairwise([0, *points]):
        if size(body[cuts[-1] : point]) > limits.max_tokens and size(body[cuts[-1] : before]) > limits.min_tokens:
            cuts.append(before)
    if len(cuts) > 1 and size(body[cuts[-1] : points[-1]]) < limits.merge_below:
        cuts.pop()
    parts = [body[a:b] for a, b in pairwise([*cuts, *points[-1:]])]
    if language == "zh":
        parts = [p[:-1] if p.endswith(tuple(_ZH_TRAILING)) else p for p in parts]
    return [p for p in parts if not _only_marks(p)]


def segments_or_whole(text: str, tokenize: Callable[[str], list] = str.split, language: str = "zh", limits: Limits = Limits()) -> list[str]:
    """As ``segment``; a text that leaves no segment (marks only) is its own segment, the empty one too."""
    return segment(text, tokenize, language, limits) or [text]


def segment_udf(tokenize: Callable[[str], list] = str.split, language: str = "zh", limits: Limits = Limits()):
    """``segments(string) -> array<string>`` for any tokenizer, vectorized over Arrow batches."""

    @F.pandas_udf(ArrayType(StringType()))
    def segments(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: None if t is None else segments_or_whole(t, tokenize, language, limits))

    return segments


def segment_table(tokenize: Callable[[str], list] = str.split, language: str = "zh", limits: Limits = Limits()):
    """The same as a table function: ``(position, segment)`` rows, for lateral joins."""

    @F.udtf(returnType="position int, segment string")
    class Segments:
        def eval(self, text: str):
            yield from enumerate(segments_or_whole(text, tokenize, language, limits) if text else [])

    return Segments


def segments_by_chars(c: Column, limits: Limits = Limits()) -> Column:
    """The Chinese metric in the JVM: pieces by one regular expression, greedy fold by ``aggregate``."""
    marks = "".join(f"\\{m}" for m in _marks("zh", limits))
    closed = F.when((c != "") & ~c.rlike(f"[{marks}]$"), F.concat(c, F.lit("。"))).otherwise(c)
    pieces = F.regexp_extract_all(closed, F.lit(f"({_piece(_marks('zh', limits))})"), 1)
    single = F.get(pieces, F.lit(0))
    long = F.substring(single, F.lit(1), F.length(single) - 1)
    starts = F.sequence(F.lit(0), F.floor((F.length(long) - 1) / limits.max_tokens).cast("int"))
    slices = F.transform(starts, lambda i: F.substring(long, i * limits.max_tokens + 1, F.lit(limits.max_tokens)))
    pieces = F.when((F.size(pieces) == 1) & (F.length(single) > limits.max_tokens), slices).otherwise(pieces)
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("line"))

    def fold(s: Column, p: Column) -> Column:
        full = (F.length(s.line) + F.length(p) > limits.max_tokens) & (F.length(s.line) > limits.min_tokens)
        return F.struct(
            F.when(full, F.concat(s.done, F.array(s.line))).otherwise(s.done).alias("done"), F.when(full, p).otherwise(F.concat(s.line, p)).alias("line")
        )

    def finish(s: Column) -> Column:
        n = F.size(s.done)
        short = (n > 0) & (F.length(s.line) < limits.merge_below)
        merged = F.concat(F.slice(s.done, F.lit(1), F.greatest(n - 1, F.lit(0))), F.array(F.concat(F.get(s.done, n - 1), s.line)))
        return F.when(s.line == "", s.done).when(short, merged).otherwise(F.concat(s.done, F.array(s.line)))

    folded = F.aggregate(pieces, start, fold, finish)
    bare = F.transform(folded, lambda x: F.regexp_replace(x, f"[{_ZH_TRAILING.replace('.', chr(92) + '.')}]$", ""))
    return F.filter(bare, lambda x: ~x.rlike(r"^[\p{P}\p{S}]*$"))


def whole_if_empty(segments: Column, text: Column) -> Column:
    """A text that leaves no segment is its own."""
    return F.when(F.size(segments) == 0, F.array(text)).otherwise(segments)


def segment_by_language_udf(tokenize: Callable[[str], list] = str.split, limits: Limits = Limits()):
    """``segments(string, language string) -> array<string>``: each text by the marks and the metric of its language."""

    @F.pandas_udf(ArrayType(StringType()))
    def segments(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, languages in batches:
            yield pd.Series([None if t is None else segments_or_whole(t, tokenize, x or "en", limits) for t, x in zip(texts, languages)], dtype=object)

    return segments

import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.functions.vi_numbers import read_int, read_written
from corpusloom.functions.vi_rules import Lexicon, normalizer
from corpusloom.operators.segmentation import Limits, segment, segment_table, segments_by_chars, segments_or_whole

NORMALIZE = normalizer()


def column(spark, f, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r.o for r in df.select("i", f(F.col("t")).alias("o")).sort("i").collect()]


def test_clean_text(spark):
    assert column(spark, X.clean_text, 'a\r\n b\t"c"   d ', None, "", "　") == ["a b c d", "", "", ""]


def test_float_and_bool(spark):
    assert column(spark, X.as_float, " 1.5 ", "", "NaN", "None", "null", "x", None, "2e-3") == [1.5, None, None, None, None, None, None, 0.002]
    assert column(spark, X.as_bool, "TRUE", "1", "yes", "no", "", None) == [True, True, True, False, False, False]


def test_stem_and_language(spark):
    assert column(spark, X.file_stem, "wav/train/a_1.wav", "b", "c.d.wav") == ["a_1", "b", "c.d"]
    assert column(spark, X.detect_language, "你好 xin", "tiếng", "plain", "ĐÔNG") == ["zh", "vi", "en", "vi"]


def test_chinese_form(spark):
    assert column(spark, X.chinese_form, "你 好 a b，", "5² （x）", "a - b.") == ["你好a b。", "5平方x", "a，b。"]
    assert column(spark, X.drop_blanks_between_han, " a b ", "a  b", "你 a") == ["a b", "ab", "你a"]


@pytest.mark.parametrize("n, said", [("0", "zero"), ("21", "twenty-one"), ("105", "one hundred and five"), ("1234", "one thousand, two hundred and thirty-four"), ("1005", "one thousand and five")])
def test_english_number(n, said):
    assert X.english_number(n) == said


@pytest.mark.parametrize(
    "n, said",
    [(0, "không"), (10, "mười"), (15, "mười lăm"), (21, "hai mươi mốt"), (24, "hai mươi tư"), (55, "năm mươi lăm"), (105, "một trăm lẻ năm"), (1001, "một nghìn không trăm lẻ một"),
     (10**9, "một tỷ"), (2_000_005, "hai triệu không trăm lẻ năm"), (-3, "âm ba")],
)
def test_vietnamese_number(n, said):
    assert read_int(n) == said


def test_written_numbers():
    assert read_written("1.234,5") == "một nghìn hai trăm ba mươi tư phẩy năm" == read_written("1,234.5")
    assert read_written("007") == "không không bảy" and read_written("1.2.3") == "một chấm hai chấm ba"
    assert read_written("9" * 5000).split() == ["chín"] * 5000


GOLD = {
    "Căn hộ 45m2": "Căn hộ bốn mươi lăm mét vuông",
    "ngày 3/4/2021": "ngày ba tháng bốn năm hai nghìn không trăm hai mươi mốt",
    "10/31/1999": "ngày ba mươi mốt tháng mười năm một nghìn chín trăm chín mươi chín",
    "lúc 7h15 tối": "lúc bảy giờ mười lăm phút tối",
    "từ 1-3/2022": "từ tháng một đến tháng ba năm hai nghìn không trăm hai mươi hai",
    "rót 1/3 đến 2/3 ly": "rót một phần ba đến hai phần ba ly",
    "lịch chiếu 8/2 đến 9/3": "lịch chiếu ngày tám tháng hai đến ngày chín tháng ba",
    "mở 20/11 - 25/12": "mở ngày hai mươi tháng mười một đến ngày hai mươi lăm tháng mười hai",
    "máy bơm 2 pha": "máy bơm hai pha",
    "7 pg": "bảy pi cô gam",
    "nặng 3kg/m3": "nặng ba ki lô gam trên mét khối",
    "chạy 2tr3": "chạy hai triệu ba",
    "lúc 6g sáng": "lúc sáu giờ sáng",
    "mạng 4g": "mạng bốn g",
    "mã số: A1-23": "mã số: a một hai ba",
    "5 - 3 = 2": "năm - ba bằng hai",
    "gọi 1800-12-34-56": "gọi một tám không không một hai ba bốn năm sáu",
    "thắng 2-0": "thắng hai không",
    "X.Hòa Bình": "xã Hòa Bình",
    "hẻm 12A": "hẻm một hai a",
    "日本 5": "日本 năm",
    "giảm 5%": "giảm năm phần trăm",
    "$20": "hai mươi đô la",
    "Q.3": "quận ba",
    "Chương VII": "Chương VII",
    "chương VII": "chương bảy",
    "thứ IIII": "thứ IIII",
    "10-12 ngày": "mười đến mười hai ngày",
    "T-score -2.5": "T-score âm hai phẩy năm",
    "Android 4.4": "Android bốn chấm bốn",
    "gọi 0987 654 321": "gọi không chín tám bảy sáu năm bốn ba hai một",
    "2000000 người": "hai triệu người",
    "mua 100k": "mua một trăm nghìn",
    "gõ a@b.vn": "gõ a@b.vn",
    "ko": "không",
    "10³": "mười mũ ba",
    "2½ kg": "hai và một phần hai ki lô gam",
    "": "",
}


@pytest.mark.parametrize("text, said", GOLD.items())
def test_vietnamese_rules(text, said):
    assert NORMALIZE(text) == said


def test_rules_are_linear():
    start = time.perf_counter()
    NORMALIZE("Giá 25m2 từ 12/5/2020 đến 15/6, 3,5 triệu đồng. " * 2100)
    assert time.perf_counter() - start < 5


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from([*GOLD, "một", "nhà", ",", ".", "5", "(", ")", "​", "tối 5/6", "12:30", "3m", "XL", "½"]), max_size=6).map(" ".join))
def test_rules_end_composed_and_without_lookalikes(text):
    import unicodedata

    said = NORMALIZE(text)
    assert unicodedata.normalize("NFC", said) == said and not set(said) & set("½²³​")
    assert NORMALIZE(said) == said or "@" in said or "-" in said


def test_missing_word_lists_are_reported(tmp_path):
    (tmp_path / "units.tsv").write_text("xu\txu lẻ\nxu\thai\n\tz\n", encoding="utf-8")
    with pytest.warns(UserWarning):
        lexicon = Lexicon.from_folder(str(tmp_path))
    assert normalizer(lexicon)("5xu") == "năm xu lẻ"


def test_segments_rejoin_and_do_not_glue():
    text = "một hai ba bốn năm. sáu bảy tám, chín mười mười một mười hai mười ba. mười bốn"
    parts = segment(text, language="vi", limits=Limits(6, 3, 2))
    assert "".join(parts) == text + "." and all(p.strip() for p in parts)
    long = segment(" ".join(["từ"] * 50), language="vi", limits=Limits(8, 6, 2))
    assert "".join(long).split() == ["từ"] * 50 and max(len(p.split()) for p in long) <= 8


def test_texts_of_marks_are_their_own_segment():
    assert segment("。！", language="zh") == [] and segments_or_whole("。！", language="zh") == ["。！"]
    assert segments_or_whole("một.", language="vi") == ["một."] and segments_or_whole("") == [""]


@settings(max_examples=200, deadline=None)
@given(st.text("字符。！a, ：\"", max_size=60))
def test_segments_are_bounded_for_single_pieces(text):
    for s in segment(text, limits=Limits(10, 6, 3)):
        assert s


def test_jvm_fold_equals_python_fold(spark):
    texts = ["字" * 30, "一二三四五。六七八九十！甲乙丙丁？", "短", "", "，，，", "甲。" * 20, '他说："好。"她走了。' * 6, "。。开头标点。后文在此处继续下去。" * 3, "a" * 25 + "."]
    limits = Limits(20, 12, 5)
    assert column(spark, lambda c: segments_by_chars(c, limits), *texts) == [segment(t, limits=limits) for t in texts]


def test_segment_table_function(spark):
    spark.udtf.register("segments_vi", segment_table(language="vi", limits=Limits(4, 2, 1)))
    rows = spark.sql("SELECT * FROM segments_vi('một hai ba. bốn năm sáu. bảy')").collect()
    assert [r.position for r in rows] == list(range(len(rows))) and "".join(r.segment for r in rows) == "một hai ba. bốn năm sáu. bảy."


def test_prompt_and_requests(spark):
    df = spark.createDataFrame([("vi", "a"), ("xx", "b"), (None, " "), ("en", "c" * 1025)], "lang string, t string")
    got = df.select(X.prompt(F.col("lang"), F.col("t")), X.request_error(F.col("t"), F.col("lang"))).collect()
    assert got[0][0] == "You are a helpful assistant. 请用越南语朗读接下来的文字:a" and "请用xx朗读" in got[1][0]
    assert [r[1] for r in got] == [None, "language_not_served", "blank_text", "text_too_long"]


def test_normalization_by_language(spark):
    from corpusloom.functions.vi_rules import vi_normalize_udf

    rows = [("có 5 con", "vi"), ("你 有 5 个.", "zh"), ("it has 5", "de"), ("có 5\tcon", "AUTO"), ("5", "auto"), ("ひ", "ja"), (None, "vi"), ("5", None)]
    df = spark.createDataFrame(rows, "t string, lang string")
    got = [r.o for r in df.select(X.normalize(F.col("t"), F.col("lang"), vi_normalize_udf()).alias("o")).collect()]
    assert got == ["có năm con", "你有5个。", "it has five", "có năm con", "five", "ヒ", "", "five"]

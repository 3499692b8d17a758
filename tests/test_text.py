import pytest
from pyspark.sql import functions as F

from siftwell.functions import scores, text


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("numeral,value", [
    ("十", 10), ("三十", 30), ("一百零二", 102), ("一百一十", 110), ("一千二百", 1200), ("二百零一", 201), ("九百九十九", 999),
    ("一千二百六十", 1260), ("两万三千", 23000), ("一万零五", 10005), ("", 0), ("abc", 0),
])
def test_numerals(spark, numeral, value):
    assert one(spark, text.chinese_number(F.lit(numeral))) == value


@pytest.mark.parametrize("heading,parts", [("第一百零二条", (102, 0)), ("第十七条之一", (17, 1)), ("第十七条之二", (17, 2)), ("《第三条》", (3, 0)), ("nothing", (0, 0)), (None, (0, 0))])
def test_article_parts(spark, heading, parts):
    base, sub = text.article_parts(F.lit(heading).cast("string"))
    assert (one(spark, base), one(spark, sub)) == parts


@pytest.mark.parametrize("value,number", [("577", 577), ("第577条", 577), ("", None), ("第十七条之一", 17), (None, None), ("无", None)])
def test_article_number(spark, value, number):
    assert one(spark, text.article_number(F.lit(value).cast("string"))) == number


def test_names(spark):
    assert one(spark, text.normalize(F.lit("A，B。 C！D"))) == "ABCD"
    assert one(spark, text.normalize(F.lit("（甲）《乙》·丙—丁"))) == "甲乙丙丁"
    assert one(spark, text.normalize(F.lit("法释〔2020〕1号"))) == "法释20201号"
    match = lambda a, b: one(spark, text.law_matches(F.lit(a), F.lit(b)))
    assert match("民法典", "《中华人民共和国民法典》") and not match("民法典", "刑法") and not match("", "刑法") and match("刑法", "刑法修正案")


def test_titles_and_labels(spark):
    title = "<em class='highlight'>中华人民共和国</em><em>刑法</em> &amp;  x"
    assert one(spark, text.clean_title(F.lit(title))) == "中华人民共和国刑法 & x"
    label = lambda *a: one(spark, text.citation_label(*[F.lit(x) for x in a]))
    assert label("民法典", "第一条", 4, "x") == "《民法典》第一条（尚未生效）"
    assert label("", "第一条", 3, "民事") == "民事" and label(None, None, 3, None) == "知识库"
    header = text.context_header(F.lit("《刑法》"), F.lit("2020"), F.lit("2021"), F.lit(4), F.lit("第一条"))
    assert one(spark, header) == "《刑法》（2020公布，2021施行，尚未生效）第一条"
    assert one(spark, text.context_header(F.lit("刑法"), F.lit(""), F.lit(None).cast("string"), F.lit(3), F.lit("第一条"))) == "《刑法》第一条"


def test_white_space_is_unicode(spark):
    assert one(spark, text.strip(F.lit("　a b "))) == "a b"
    assert one(spark, text.squeeze(F.lit(" a　\n b "))) == "a b"
    long = one(spark, text.truncated(F.lit("x" * 2500)))
    assert len(long) == 2001 and long.endswith("…")


@pytest.mark.parametrize("question,chat", [("你好！", True), ("你好，你是谁", True), ("你好，劳动合同违约金怎么算？", False), ("", False), (None, False), ("Hello", True), ("盗窃罪怎么判", False)])
def test_intent(spark, question, chat):
    assert one(spark, text.is_chat(F.lit(question).cast("string"))) is chat


@pytest.mark.parametrize("answer,count", [("[来源1][来源2]", 2), ("[来源：关税法第五条]", 1), ("[来源3][来源:x]", 2), ("无", 0)])
def test_citations(spark, answer, count):
    assert one(spark, text.citations(F.lit(answer))) == count


def test_scores(spark):
    assert one(spark, scores.similarity(F.lit(0.5))) == 0.75 and one(spark, scores.similarity(F.lit(0.5), "cosine")) == 0.5
    assert one(spark, scores.cost(F.lit("deepseek-v4-pro"), F.lit(1_000_000), F.lit(1_000_000))) == 50
    assert one(spark, scores.cost(F.lit("?"), F.lit(1_000_000), F.lit(0))) == 2
    assert one(spark, scores.boosted(F.lit(0.9), F.lit(True))) == 1.0 and one(spark, scores.boosted(F.lit(0.5), F.lit(False))) == 0.5
    assert one(spark, text.hyde_query(F.lit("q"), F.lit(" "))) == "q" and one(spark, text.hyde_query(F.lit("q"), F.lit("p"))) == "q\np"


def test_open_metadata_against_python(spark):
    metas = ['{"a": null, "b": "x", "c": 1, "d": 1.5, "e": true, "f": [1, "y", null], "g": {"h": {}}, "": ""}', "{}", None, "{broken", '{"a": 1, "a": 2}']
    rows = spark.createDataFrame([(i, m) for i, m in enumerate(metas)], "i int, m string")
    clean = rows.select("i", F.explode_outer(text.sanitised(F.col("m"))).alias("k", "v")).select("i", "k", F.schema_of_variant("v"), F.variant_get("v", "$", "string"))
    got = {(r[0], r[1]): (r[2], r[3]) for r in clean.collect()}
    want = {"a": ("STRING", ""), "b": ("STRING", "x"), "c": ("BIGINT", "1"), "d": ("DECIMAL(2,1)", "1.5"), "e": ("BOOLEAN", "true"), "f": ("STRING", '[1,"y",null]'), "g": ("STRING", '{"h":{}}'), "": ("STRING", "")}
    assert {k: v for (i, k), v in got.items() if i == 0} == want
    assert {(i, k): v for (i, k), v in got.items() if i} == {(1, None): (None, None), (2, None): (None, None), (3, None): (None, None), (4, "a"): ("BIGINT", "2")}


def test_authority_in_any_of_the_parts(spark):
    bare = ("x", "s", "t", None)
    rows = [(*bare[:i], f"a{word}b", *bare[i + 1 :], True) for word in text.AUTHORITY_WORDS for i in range(4)] + [(*bare, False), (None, None, None, None, False)]
    found = spark.createDataFrame(rows, "text string, source string, title string, category string, want boolean")
    assert found.filter(text.is_authoritative(*(F.col(c) for c in found.columns[:4])) != F.col("want")).count() == 0
    boosted = found.select(scores.boosted(F.lit(0.9), text.is_authoritative(F.col("text"))).alias("x"), text.is_authoritative(F.col("text")).alias("a")).distinct().collect()
    assert {(r["a"], round(r["x"], 6)) for r in boosted} == {(True, 1.0), (False, 0.9)}

import duckdb
from pyspark.sql import functions as F

from siftwell import schemas
from siftwell.operators import segment
from siftwell.plans import catalog


def units(spark, *lines):
    docs = spark.createDataFrame([(1, list(lines))], "doc long, lines array<string>")
    return [r.asDict() for r in segment.articles(docs).orderBy("island").collect()]


def test_articles(spark):
    found = units(spark, "某某法", "2020年1月1日", "第一条 甲。", "第二条　乙，依照", "本法第三百零二条处理。", "第二条之一 丙")
    assert [u["no"] for u in found] == ["第一条", "第二条", "第二条之一"]
    assert [(u["num"], u["sub"]) for u in found] == [(1, 0), (2, 0), (2, 1)]
    assert found[1]["text"] == "乙，依照 本法第三百零二条处理。" and found[0]["chunking"] == "article"


def test_latest_container_and_closing(spark):
    found = units(spark, "第一章 总　则", "目录里的一行", "第一条 甲", "第二章 分 则", "丢弃", "第一节 细 则", "第二条 乙", "第三条")
    assert [u["container"] for u in found] == ["第一章 总 则", "第一节 细 则"]
    assert [u["text"] for u in found] == ["甲", "乙"]


def test_fallbacks(spark):
    enum = units(spark, "决定", "一、甲", "二、乙", "续行", "三、丙")
    assert [(u["no"], u["text"], u["num"]) for u in enum] == [("一", "甲", 1), ("二", "乙 续行", 2), ("三", "丙", 3)] and enum[0]["chunking"] == "enum"
    assert [u["chunking"] for u in units(spark, "（一）甲", "（二）乙")] == ["paren", "paren"]
    body = "正文" * 30
    masthead = units(spark, "标题", "公告" + "字" * 60, "日期", body)
    assert [(u["no"], u["text"], u["chunking"]) for u in masthead] == [("第1段", body, "paragraph")]
    assert units(spark, "一、孤立", body)[0]["chunking"] == "paragraph"
    assert [u["no"] for u in units(spark, "第一条 甲", "一、项", "二、项")] == ["第一条"]
    assert units(spark) == []


def test_packs_and_cuts(spark):
    row = spark.range(1).select(
        segment.greedy(F.split(F.lit("aaa,bb,cccc,d"), ","), 5).alias("g"), segment.hard_cut(F.lit("abcdefg"), 3).alias("h"),
        segment.sentence_pieces(F.lit("甲。乙乙乙。" + "丙" * 7), 5).alias("s"), segment.body_pieces(F.lit("第一句。" * 200), 300).alias("b"),
        segment.body_pieces(F.lit("  "), 300).alias("e"), segment.overlapping(F.lit("\n".join("字" * 300 for _ in range(3)))).alias("o"),
        segment.sections(F.lit("前言\n一、甲\n内容\n第二章 乙")).alias("x"), segment.sections(F.lit(" 无标题 ")).alias("y"),
    ).first()
    assert row["g"] == ["aaabb", "ccccd"] and row["h"] == ["abc", "def", "g"]
    assert row["s"] == ["甲。", "乙乙乙。", "丙" * 5, "丙丙"], row["s"]
    assert len(row["b"]) > 1 and all(len(p) <= 300 for p in row["b"]) and "".join(row["b"]) == "第一句。" * 200 and row["e"] == []
    assert len(row["o"]) == 3 and all(len(c) <= 581 for c in row["o"]) and row["o"][1].startswith("字" * 80 + "\n")
    assert row["x"] == ["前言", "一、甲\n内容", "第二章 乙"] and row["y"] == ["无标题"]


def test_overlap_chunks_against_sql(spark, tmp_path):
    """A tail that begins with a line's end, white space at the ends of lines, sentence ends, and white space that no ASCII class has."""
    texts = ["a" * 369 + "\n" + "b" * 79 + "\n" + "c" * 128, " a\t\n \n\u3000b\x0b", "句。" * 400, "\u2003\nx\u0085", "", None, "d" * 450 + "\n" + "e" * 79 + " \n" + "f" * 900, "g" * 499 + " " * 501 + "g"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in catalog.overlap_chunks(spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert got == sorted(con.execute(catalog.ORACLES["overlap_chunks"]).fetchall())
    last = spark.range(1).select(segment.overlapping(F.lit(texts[0])).alias("c")).first()["c"]
    assert last == ["a" * 369 + "\n" + "b" * 79, "b" * 79 + "\n" + "c" * 128]


def test_chunks(spark):
    law = ("b1", "某法", "民事", None, None, "2020-01-01", None, 4, None, None, None, [("第一条", 1, 0, "第一章", "第一句。" * 300, "article"), ("第二条", 2, 0, "", "短", "article")])
    rows = segment.chunks(spark.createDataFrame([law], schemas.STATUTE)).orderBy("id").collect()
    assert len(rows) >= 3 and {r["article_no"] for r in rows} == {"第一条", "第二条"} and rows[0]["id"] == "b1_chunk_0"
    assert rows[0]["text"].startswith("《某法》（2020-01-01公布，尚未生效）第一条\n") and rows[0]["status_label"] == "尚未生效"

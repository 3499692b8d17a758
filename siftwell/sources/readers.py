"""Readers for statute records, documents, evaluation sets, logs and rewrite tables."""

from __future__ import annotations

import io
import zipfile
from html import unescape
from xml.parsers import expat

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell import schemas

# Questions that no statute in force answers, and their kind.
OUT_OF_DOMAIN = (
    ("欧盟《通用数据保护条例》(GDPR) 对数据跨境传输有哪些要求？", "域外法"),
    ("美国专利法里判断新颖性的标准是什么？", "域外法"),
    ("日本民法典关于法定继承顺位是怎么规定的？", "域外法"),
    ("英美法系下 consideration 对合同成立有什么要求？", "域外法"),
    ("国际货物买卖合同中 CISG 的适用范围是怎样的？", "域外法"),
    ("自动驾驶汽车发生事故时，责任应当由谁承担？", "未立法"),
    ("人工智能生成内容的著作权归属目前是怎么确定的？", "未立法"),
    ("元宇宙里的虚拟财产能否作为遗产继承？", "未立法"),
    ("我给公司起名叫「AI 之神」，能不能通过审核？", "需专业判断"),
    ("我家孩子该上哪所小学？", "非法律"),
    ("这份劳动合同值不值得签，你觉得呢？", "需专业判断"),
    ("你觉得法官会怎么判我这个案子？", "需专业判断"),
)


def statutes(spark: SparkSession, path: str) -> DataFrame:
    """Statute records of ``path``/*/*.json, one file each, with ``file``; unreadable files give no row."""
    read = spark.read.schema(schemas.STATUTE + ", _corrupt string").option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt")
    rows = read.json(f"{path}/*/*.json").withColumn("file", F.col("_metadata.file_path"))
    return rows.filter("_corrupt is null and bbbs is not null").drop("_corrupt")


def _docx(data: bytes) -> list[str]:
    """Non-empty paragraphs of a .docx file, tabs and line breaks included; none for anything else.

    Bytes that are no UTF-8 become replacement characters; what follows a place that is no XML is lost.
    """
    if not zipfile.is_zipfile(io.BytesIO(data)):
        return []
    with zipfile.ZipFile(io.BytesIO(data)) as parts:
        if "word/document.xml" not in parts.namelist():
            return []
        xml = parts.read("word/document.xml").decode("utf-8", "replace")
    found: list[str] = []
    now: list[str] = []
    opened: list[str] = []

    def start(name, _):
        opened.append(name)
        if name in ("w:tab", "w:br"):
            now.append("\t" if name == "w:tab" else "\n")

    def end(name):
        opened.pop()
        if name == "w:p":
            found.extend(x for x in ["".join(now).strip()] if x)
            now.clear()

    parser = expat.ParserCreate("utf-8")
    parser.StartElementHandler, parser.EndElementHandler = start, end
    parser.CharacterDataHandler = lambda x: now.append(x) if opened[-1] == "w:t" else None
    try:
        parser.Parse(xml.encode(), True)
    except expat.ExpatError:
        pass
    return found


def documents(spark: SparkSession, path: str, parsers: dict | None = None) -> DataFrame:
    """(path, format, lines) of binary files; the format is the file's extension.

    ``parsers`` adds functions from bytes to lines for further formats (pdf, doc), or replaces that for docx; a format
    without a parser and a file that its parser fails on give no lines.
    """
    known = {"docx": _docx, **(parsers or {})}

    def parse(batches):
        for rows in batches:
            lines = []
            for kind, data in zip(rows["format"], rows["content"], strict=True):
                try:
                    lines.append(known[kind](data) if kind in known else [])
                except Exception:  # noqa: BLE001  a file that can't be parsed has no lines, whatever its parser raises
                    lines.append([])
            yield pd.DataFrame({"path": rows["path"], "format": rows["format"], "lines": lines})

    files = spark.read.format("binaryFile").load(path)
    kind = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    return files.select("path", kind.alias("format"), "content").mapInPandas(parse, "path string, format string, lines array<string>")


def page_text(pages: DataFrame, first: str, second: str, key: str = "path", order: str = "page") -> DataFrame:
    """(key, text): the pages' texts joined by blank lines, from column ``first``, or ``second`` where that is blank."""
    best = F.coalesce(F.nullif(F.trim(F.col(first)), F.lit("")), F.col(second), F.lit(""))
    parts = pages.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), best.alias("t")))).alias("p"))
    return parts.select(key, F.array_join("p.t", "\n\n").alias("text"))


def eval_items(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation items; raises where one lacks id, question or relevant (the retired schemas do)."""
    items = spark.read.schema(schemas.EVAL_ITEM).option("multiLine", True).json(path)
    lacking = items.filter("id is null or question is null or relevant is null").select("id").limit(5).collect()
    if lacking:
        raise ValueError(f"items need id, question and relevant (a list of law and article); lacking in {[r['id'] for r in lacking]}")
    return items


def qa_items(spark: SparkSession, path: str, source: str) -> DataFrame:
    """A question set of the form {data: [...]} as evaluation items; incomplete triples are dropped."""
    each = spark.read.schema(schemas.QA_SET).option("multiLine", True).json(path).select(F.explode("data").alias("x"))
    question = F.trim(F.get("x.question", F.lit(0)))
    rows = each.select(
        F.col("x.id").alias("id"), question.alias("question"), F.lit("qa").alias("category"), F.lit(None).cast("string").alias("type"),
        F.col("x.question_type").alias("question_type"), F.lit(source).alias("source"), F.lit(None).cast("boolean").alias("expect_refusal"),
        F.array(F.struct(F.col("x.law_type").alias("law"), F.col("x.law_text_num").alias("article"))).alias("relevant"),
    )
    return rows.filter("coalesce(question, '') <> '' and coalesce(relevant[0].law, '') <> '' and coalesce(relevant[0].article, '') <> ''")


def out_of_domain(spark: SparkSession) -> DataFrame:
    """Items without gold that expect a refusal."""
    rows = [(f"ookb_{i:02d}", q, kind, None, None, "out_of_kb", True, []) for i, (q, kind) in enumerate(OUT_OF_DOMAIN, 1)]
    return spark.createDataFrame(rows, schemas.EVAL_ITEM)


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON lines file; malformed and half-written lines are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def rewrites(spark: SparkSession, path: str) -> DataFrame:
    """(question, passage) with a passage."""
    return json_lines(spark, path, schemas.REWRITES).filter("coalesce(passage, '') <> ''")


def titles(rows: DataFrame, column: str) -> DataFrame:
    """``rows`` with all HTML entities of a column decoded, for titles with more than the usual few."""

    @F.pandas_udf("string")
    def decode(s: pd.Series) -> pd.Series:
        return s.map(lambda x: x if x is None else unescape(x))

    return rows.withColumn(column, decode(F.col(column)))

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from siftwell import schemas
from siftwell.operators import index
from siftwell.sources import readers, versions, writers
from siftwell.streaming import jobs


def docx(*paragraphs):
    body = "".join(f'<w:p a="1"><w:r><w:t xml:space="preserve">{p}</w:t></w:r></w:p>' for p in paragraphs)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document>{body}</w:document>".encode("utf-8", "surrogateescape"))
    return out.getvalue()


def test_statutes_skip_broken_files(spark, tmp_path):
    for name, content in (("a/1.json", json.dumps({"bbbs": "b1", "title": "t", "sxx": 3, "articles": [{"no": "第一条", "num": 1, "text": "x"}]})), ("a/2.json", "{broken")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(content, encoding="utf-8")
    rows = readers.statutes(spark, str(tmp_path)).collect()
    assert [r["bbbs"] for r in rows] == ["b1"] and rows[0]["articles"][0]["no"] == "第一条"
    law = readers.statutes(spark, str(tmp_path))
    good, bad = index.parsed(law)
    assert good.count() == 1 and bad.count() == 0 and index.in_force(law).count() == 1


def test_documents_by_format(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(docx("第一条 甲", " ", "A &amp; B"))
    (tmp_path / "b.docx").write_bytes(b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1x")
    (tmp_path / "d.docx").write_bytes(docx("one</w:t><w:tab/><w:t>two", "bad \udcff byte"))
    (tmp_path / "c.txt").write_bytes(b"x\ny")
    found = {r["path"].rsplit("/", 1)[-1]: r["lines"] for r in readers.documents(spark, str(tmp_path), {"txt": lambda b: b.decode().split()}).collect()}
    assert found == {"a.docx": ["第一条 甲", "A & B"], "b.docx": [], "c.txt": ["x", "y"], "d.docx": ["one\ttwo", "bad \ufffd byte"]}


def test_eval_items_are_validated(spark, tmp_path):
    good, bad = tmp_path / "good.json", tmp_path / "bad.json"
    good.write_text(json.dumps([{"id": "1", "question": "q", "relevant": [{"law": "l", "article": "1"}]}]))
    bad.write_text(json.dumps([{"id": "1", "query": "q"}]))
    assert readers.eval_items(spark, str(good)).count() == 1
    with pytest.raises(ValueError, match="relevant"):
        readers.eval_items(spark, str(bad))
    qa = tmp_path / "qa.json"
    qa.write_text(json.dumps({"data": [{"id": "1", "question": ["q", "r"], "law_type": "l", "law_text_num": "5"}, {"id": "2", "question": [], "law_type": "l", "law_text_num": "5"}]}))
    assert [(r["id"], r["question"]) for r in readers.qa_items(spark, str(qa), "s").collect()] == [("1", "q")]
    ood = readers.out_of_domain(spark).collect()
    assert len(ood) == 12 and ood[0]["id"] == "ookb_01" and all(r["expect_refusal"] for r in ood)


def test_page_text_falls_back(spark):
    pages = spark.createDataFrame([("f", 2, " ", "b"), ("f", 1, "a", "x")], "path string, page int, first string, second string")
    assert readers.page_text(pages, "first", "second").first()["text"] == "a\n\nb"


def test_index_is_reused_only_while_it_fits(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b a"), (2, "b")], "doc_id long, text string")
    path = str(tmp_path / "index")
    tables = writers.attach_index(docs, path)
    assert {(r["term"], r["df"]) for r in tables["terms"].collect()} == {("a", 1), ("b", 2)}
    assert writers.load_index(spark, path, docs) is not None and writers.load_index(spark, path, docs.filter("doc_id = 1")) is None
    index.signature(docs).withColumn("version", F.lit(1)).write.mode("overwrite").parquet(f"{path}/manifest")
    assert writers.load_index(spark, path) is None


def test_feedback_log(spark, tmp_path):
    path = str(tmp_path / "log")
    entry = spark.createDataFrame([("t", "up", "rag", "q", "x" * 3000, ["s"] * 30)], schemas.FEEDBACK)
    writers.append_feedback(entry, path)
    writers.append_feedback(entry.withColumn("rating", F.lit("down")), path)
    (tmp_path / "log" / "part-half.json").write_text('{"ts": "t", "rating": "u')
    rows = readers.json_lines(spark, path, schemas.FEEDBACK).filter("rating is not null").collect()
    assert sorted(r["rating"] for r in rows) == ["down", "up"] and len(rows[0]["answer"]) == 2001 and len(rows[0]["sources"]) == 20
    with pytest.raises(ValueError, match="rating"):
        writers.append_feedback(entry.withColumn("rating", F.lit("meh")), path)


def test_replace_sources(spark, tmp_path):
    path = str(tmp_path / "t")
    writers.replace_sources(spark.createDataFrame([(1, "a"), (2, "b")], "x long, source string"), path)
    writers.replace_sources(spark.createDataFrame([(3, "a")], "x long, source string"), path)
    assert sorted((r["x"], r["source"]) for r in spark.read.parquet(path).collect()) == [(2, "b"), (3, "a")]


def test_streams(spark, tmp_path):
    calls = spark.createDataFrame([("2024-01-01T00:01:00", "rag", "deepseek-chat", 1_000_000, 0, 1.0, 0.0, True, None), ("2024-01-01T00:02:00", "rag", "x", 0, 1_000_000, 1.0, 0.0, False, "e")], schemas.LLM_CALL)
    calls.coalesce(1).write.json(str(tmp_path / "calls"))
    stream = jobs.usage_by_window(jobs.json_stream(spark, str(tmp_path / "calls"), jobs.CALLS))
    query = stream.writeStream.outputMode("complete").format("memory").queryName("usage").trigger(availableNow=True).start()
    query.awaitTermination(120)
    row = spark.table("usage").first()
    assert (row["calls"], row["tokens"], row["cost_cny"], row["failures"]) == (2, 2_000_000, 10.0, 1)
    turns = spark.createDataFrame([(1, t, f"x{t}") for t in range(30)], "conv_id long, turn long, text string")
    turns.coalesce(1).write.json(str(tmp_path / "turns"))
    kept = jobs.histories(jobs.json_stream(spark, str(tmp_path / "turns"), "conv_id long, turn long, text string"), 20)
    query = kept.writeStream.outputMode("update").format("memory").queryName("kept").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert spark.table("kept").first()["turns"] == list(range(10, 30))
    rows = spark.createDataFrame([(5, "a")], "x long, source string")
    rows.write.json(str(tmp_path / "chunks"))
    jobs.upsert_stream(jobs.json_stream(spark, str(tmp_path / "chunks"), "x long, source string"), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    assert versions.read(spark, str(tmp_path / "out")).count() == 1
    beats = spark.createDataFrame([("running", 100.0), ("running", 10.0)], "state string, updated_at double")
    assert [r["alive"] for r in jobs.heartbeat(beats, 200.0).collect()] == [True, False]


def test_build_from_files_to_index(spark, tmp_path):
    """Load, deduplicate, filter, cut, replace by source and index; a second build with one law anew keeps the others."""
    def law(name, bbbs, sxx, *texts):
        articles = [{"no": f"第{i}条", "num": i, "text": t} for i, t in enumerate(texts, 1)]
        (tmp_path / "laws/a").mkdir(parents=True, exist_ok=True)
        (tmp_path / f"laws/a/{name}.json").write_text(json.dumps({"bbbs": bbbs, "title": f"法{bbbs}", "sxx": sxx, "articles": articles}), encoding="utf-8")

    law("1", "b1", 3, "alpha beta", "gamma")
    law("2", "b1", 3, "old")
    law("3", "b2", 4, "delta")
    law("4", "b3", 1, "gone")
    law("5", "b4", 3)
    chunks, where = str(tmp_path / "chunks"), str(tmp_path / "index")
    told = writers.build_index(readers.statutes(spark, str(tmp_path / "laws")), chunks, where).first()
    assert told.asDict() == {"laws": 4, "repeated": 1, "effective": 2, "pending": 1, "other_versions": 1, "unparsed": 1, "chunks": 3}
    found = writers.load_index(spark, where)
    assert {r["id"] for r in found["postings"].filter("term in ('beta', 'delta')").collect()} == {"b1_chunk_0", "b2_chunk_0"}
    law("1", "b1", 3, "omega")
    (tmp_path / "laws/a/2.json").unlink()
    told = writers.build_index(readers.statutes(spark, str(tmp_path / "laws")).filter("bbbs = 'b1'"), chunks, where).first()
    assert told["chunks"] == 2 and writers.load_index(spark, where)["postings"].filter("term = 'beta'").count() == 0


def test_curve_and_feedback_files(spark, tmp_path):
    read = lambda name: [json.loads(line) for f in (tmp_path / name).glob("*.json") for line in f.read_text().splitlines()]
    curve = spark.createDataFrame([(0.5, 0.1), (0.0, 0.9), (0.25, None)], "threshold double, hit double").repartition(3)
    writers.save_curve(curve, str(tmp_path / "curve"), sample=50, pool=20)
    assert read("curve") == [{"curve": [{"threshold": 0.0, "hit": 0.9}, {"threshold": 0.25}, {"threshold": 0.5, "hit": 0.1}], "sample": 50, "pool": 20}]
    entries = spark.createDataFrame([("up", "rag"), ("down", "rag"), ("up", None), ("meh", "rag"), (None, "agent")], "rating string, mode string")
    writers.save_feedback_stats(entries, str(tmp_path / "stats"))
    mode = lambda m, up, down: {"mode": m, "total": up + down, "up": up, "down": down, "satisfaction": up / (up + down)}
    assert read("stats") == [{"total": 3, "up": 2, "down": 1, "satisfaction": 2 / 3, "by_mode": [mode("", 1, 0), mode("rag", 1, 1)]}]
    writers.save_feedback_stats(entries.limit(0), str(tmp_path / "none"))
    assert read("none") == [{"total": 0, "up": 0, "down": 0, "satisfaction": 0.0, "by_mode": []}]


def test_statute_files_reports_and_rewrites(spark, tmp_path):
    law = spark.createDataFrame([("b1", "法律", [("第一条", 1, 0, "", "x", "article")]), ("b2", None, None)], f"bbbs string, category string, articles array<{schemas.ARTICLE}>")
    writers.save_statutes(law, str(tmp_path / "laws"))
    back = {r["bbbs"]: r for r in spark.read.json(str(tmp_path / "laws")).collect()}
    assert back["b1"]["category"] == "法律" and back["b1"]["articles"][0]["text"] == "x" and back["b2"]["category"] is None
    writers.save_report(spark.createDataFrame([(1, 0.5, ["long"])], "query_id long, hit double, retrieved array<string>"), str(tmp_path / "report"))
    assert [r.asDict() for r in spark.read.json(str(tmp_path / "report")).collect()] == [{"query_id": 1, "hit": 0.5}]
    (tmp_path / "rewrites.json").write_text('{"question": "q", "passage": "p"}\n{"question": "r", "passage": ""}\n{"question": "s"}\n{"quest', encoding="utf-8")
    assert [tuple(r) for r in readers.rewrites(spark, str(tmp_path / "rewrites.json")).collect()] == [("q", "p")]

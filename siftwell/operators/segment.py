"""Segmentation of documents into articles, sections and chunks, with windows and array folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.functions.text import article_parts, chinese_number, clean_title, context_header, squeeze, status_label, strip

# Headings at the start of a line, sentence ends, masthead words and limits.
ARTICLE = r"(?d)^(第[一二三四五六七八九十百千零〇]+条(?:之[一二三四五六七八九十]+)?)[\s　]*(.*)$"
CONTAINER = r"(?d)^(第[一二三四五六七八九十百千零〇]+(?:编|章|节))[\s　]*(.*)$"
ENUMERATED = r"(?d)^([一二三四五六七八九十]+)、[\s　]*(.*)$"
PARENTHESISED = r"(?d)^([（(][一二三四五六七八九十]+[)）])[\s　]*(.*)$"
SENTENCE_END = r"(?<=[。！？；])"
SECTION = r"(?:^|\n)\s*([一二三四五六七八九十]+[、．.]|[0-9]+[\.、]|第[一二三四五六七八九十0-9]+[章节]|[（(][一二三四五六七八九十0-9]+[)）])"
HEADER_WORDS = r"公告|法释〔|已于|现予公布|予以公布"
BODY_MIN, MASTHEAD_LINES, GROUP_CHARS = 40, 12, 400


def greedy(pieces: Column, limit: int, joiner: str = "") -> Column:
    """Pieces packed in order: one joins the current pack unless that would pass ``limit`` characters; none is cut.

    The joiner does not count towards the limit.
    """
    zero = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("pack"))

    def step(s: Column, x: Column) -> Column:
        full = (s.pack != "") & (F.length(s.pack) + F.length(x) > limit)
        grown = F.when(s.pack == "", x).otherwise(F.concat(s.pack, F.lit(joiner), x))
        return F.struct(
            F.when(full, F.array_append(s.done, s.pack)).otherwise(s.done).alias("done"), F.when(full, x).otherwise(grown).alias("pack")
        )

    return F.aggregate(pieces, zero, step, lambda s: F.when(s.pack != "", F.array_append(s.done, s.pack)).otherwise(s.done))


def _units(lines: DataFrame, opener: str, closer: str | None) -> DataFrame:
    """(doc, island, no, container, body): runs of lines from each opener to the next opener or closer."""
    order = Window.partitionBy("doc").orderBy("pos")
    no = F.regexp_extract("line", opener, 1)
    group = F.regexp_extract("line", closer, 1) if closer else F.lit("")
    title = squeeze(F.regexp_extract("line", closer, 2)) if closer else F.lit("")
    heading = F.when((no == "") & (group != ""), F.concat_ws(" ", group, F.nullif(title, F.lit(""))))
    marked = lines.select("doc", "pos", "line", no.alias("no"), heading.alias("heading"))
    turns = marked.withColumn("island", F.sum(((F.col("no") != "") | F.col("heading").isNotNull()).cast("int")).over(order))
    placed = turns.withColumn("container", F.coalesce(F.last("heading", ignorenulls=True).over(order), F.lit("")))
    body = F.when(F.col("no") != "", F.regexp_extract("line", opener, 2)).otherwise(F.col("line"))
    rows = placed.withColumn("body", body).withColumn("first", F.first("no").over(Window.partitionBy("doc", "island").orderBy("pos")))
    kept = rows.filter(F.col("first") != "").groupBy("doc", "island").agg(
        F.first("first").alias("no"), F.min_by("container", "pos").alias("container"), F.array_sort(F.collect_list(F.struct("pos", "body"))).alias("parts")
    )
    return kept.withColumn("text", squeeze(F.array_join(F.col("parts.body"), "\n"))).filter("text <> ''").drop("parts")


def _paragraphs(lines: DataFrame) -> DataFrame:
    """Numbered groups of paragraphs, after the masthead: the leading lines that are short or hold a masthead word."""
    every = lines.groupBy("doc").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x.line).alias("all"))
    body = F.transform(F.slice("all", 1, MASTHEAD_LINES), lambda x: (F.length(x) >= BODY_MIN) & ~x.rlike(HEADER_WORDS))
    start = F.greatest(F.lit(1), F.array_position(body, True).cast("int"))
    packs = every.select("doc", F.posexplode(greedy(F.slice("all", start, F.greatest(F.lit(1), F.size("all"))), GROUP_CHARS, "\n")).alias("i", "pack"))
    number = F.col("i") + 1
    return packs.select(
        "doc", number.alias("island"), F.concat(F.lit("第"), number.cast("string"), F.lit("段")).alias("no"), F.lit("").alias("container"),
        squeeze(F.col("pack")).alias("text"), number.alias("num"), F.lit(0).alias("sub"), F.lit("paragraph").alias("chunking"),
    )


def articles(docs: DataFrame, key: str = "doc", lines: str = "lines") -> DataFrame:
    """(doc, island, no, num, sub, container, text, chunking) from documents given as arrays of lines.

    Lines that open with an article heading start an article; headings of parts, chapters and sections end it and name
    the container of what follows; other lines continue it; what stands before the first article is dropped. Documents
    without articles fall back to 一、 units, then to （一） units (two at least), then to groups of paragraphs. Null and
    empty arrays give nothing; ``doc`` should be unique.
    """
    each = docs.select(F.col(key).alias("doc"), F.posexplode(lines).alias("pos", "line"))
    main = _units(each, ARTICLE, CONTAINER)
    base, sub = article_parts(F.col("no"))
    main = main.withColumns({"num": base, "sub": sub, "chunking": F.lit("article")})
    rest = each.join(main.select("doc").distinct(), "doc", "left_anti")
    counts = rest.groupBy("doc").agg(F.count_if(F.regexp_extract("line", ENUMERATED, 1) != "").alias("e"), F.count_if(F.regexp_extract("line", PARENTHESISED, 1) != "").alias("p"))
    kind = F.when(F.col("e") >= 2, "enum").when(F.col("p") >= 2, "paren").otherwise("paragraph")
    typed = rest.join(counts.select("doc", kind.alias("kind")), "doc")
    marked = lambda pattern, name: _units(typed.filter(F.col("kind") == name), pattern, None).withColumns({"num": chinese_number(F.col("no")), "sub": F.lit(0), "chunking": F.lit(name)})
    found = main.unionByName(marked(ENUMERATED, "enum")).unionByName(marked(PARENTHESISED, "paren"))
    return found.unionByName(_paragraphs(typed.filter("kind = 'paragraph'")))


def body_pieces(body: Column, limit: int) -> Column:
    """An article body whole if it fits, else its sentences packed; a single long sentence stays whole."""
    bare = strip(body)
    sentences = F.filter(F.split(bare, SENTENCE_END), lambda s: strip(s) != "")
    return F.when(bare == "", F.array().cast("array<string>")).when(F.length(bare) <= limit, F.array(bare)).otherwise(greedy(sentences, limit))


def chunks(statutes: DataFrame, max_chars: int = 800) -> DataFrame:
    """One row for each piece of each article of statute records, with header, metadata columns and chunk id."""
    art = statutes.select("*", F.posexplode("articles").alias("article_pos", "a"))
    piece = art.select("*", F.posexplode(body_pieces(F.col("a.text"), max_chars)).alias("piece_pos", "body"))
    order = Window.partitionBy("bbbs").orderBy("article_pos", "piece_pos")
    blank = lambda c: F.coalesce(c, F.lit(""))
    header = context_header(F.col("title"), F.col("gbrq"), F.col("sxrq"), F.col("sxx"), F.col("a.no"))
    return piece.select(
        F.concat(F.col("bbbs"), F.lit("_chunk_"), (F.row_number().over(order) - 1).cast("string")).alias("id"),
        F.concat(header, F.lit("\n"), F.col("body")).alias("text"), F.col("bbbs").alias("source"), clean_title(F.col("title")).alias("law_title"),
        blank(F.col("bbbs")).alias("bbbs"), F.col("a.no").alias("article_no"), F.col("a.num").alias("article_num"),
        F.coalesce("a.sub", F.lit(0)).alias("article_sub"), blank(F.col("category")).alias("category"), blank(F.col("subcategory")).alias("subcategory"),
        blank(F.col("a.container")).alias("container"), blank(F.col("sxrq")).alias("effective_date"), F.coalesce("sxx", F.lit(3)).alias("status"),
        status_label(F.col("sxx")).alias("status_label"), F.coalesce("a.chunking", F.lit("article")).alias("chunking"),
    )


def sections(text: Column) -> Column:
    """Sections that start with a heading (kept); what stands before the first is one too; without heading, the whole."""
    marked = F.split(F.regexp_replace(text, SECTION, "\u0001$1"), "\u0001")
    found = F.filter(F.transform(marked, strip), lambda s: s != "")
    return F.when(F.size(found) > 0, found).otherwise(F.array(strip(text)))


def hard_cut(text: Column, size: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.length(text), F.lit(1)) - 1) / size).cast("int")), lambda i: F.substring(text, i * size + 1, F.lit(size)))


def sentence_pieces(paragraph: Column, size: int) -> Column:
    """A paragraph's sentences packed to ``size`` characters; a sentence longer than that is cut."""
    sentences = F.filter(F.transform(F.split(paragraph, SENTENCE_END), strip), lambda s: s != "")
    zero = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("pack"))

    def step(s: Column, x: Column) -> Column:
        full = F.length(s.pack) + F.length(x) > size
        closed = F.when(s.pack != "", F.array_append(s.done, s.pack)).otherwise(s.done)
        long = F.length(x) > size
        done = F.when(full & long, F.concat(closed, hard_cut(x, size))).when(full, closed).otherwise(s.done)
        return F.struct(done.alias("done"), F.when(full & long, "").when(full, x).otherwise(F.concat(s.pack, x)).alias("pack"))

    return F.aggregate(sentences, zero, step, lambda s: F.when(s.pack != "", F.array_append(s.done, s.pack)).otherwise(s.done))


def overlapping_packs(text: Column, size: int = 500, overlap: int = 80) -> Column:
    """The chunks of ``overlapping`` as packed: the last may still begin or end with white space of the tail that leads it."""
    paragraphs = F.filter(F.transform(F.split(text, "\n"), strip), lambda p: p != "")
    pieces = F.flatten(F.transform(paragraphs, lambda p: F.when(F.length(p) > size, sentence_pieces(p, size)).otherwise(F.array(p))))
    zero = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("pack"))

    def step(s: Column, x: Column) -> Column:
        full = (s.pack != "") & (F.length(s.pack) + F.length(x) > size)
        tail = F.when(F.length(s.pack) > overlap, F.right(s.pack, F.lit(overlap))).otherwise(s.pack)
        grown = F.when(s.pack == "", x).otherwise(F.concat(s.pack, F.lit("\n"), x))
        return F.struct(
            F.when(full, F.array_append(s.done, s.pack)).otherwise(s.done).alias("done"),
            F.when(full, F.concat(tail, F.lit("\n"), x)).otherwise(grown).alias("pack"),
        )

    return F.aggregate(pieces, zero, step, lambda s: F.when(strip(s.pack) != "", F.array_append(s.done, s.pack)).otherwise(s.done))


def overlapping(text: Column, size: int = 500, overlap: int = 80) -> Column:
    """Chunks of a section: paragraphs packed to ``size`` characters, each new chunk led by the tail of the one before.

    The last is stripped, as its tail may begin with a line's end.
    """
    return F.transform(F.array(overlapping_packs(text, size, overlap)), lambda c: F.transform(c, lambda x, i: F.when(i == F.size(c) - 1, strip(x)).otherwise(x)))[0]

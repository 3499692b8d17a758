"""Text functions as Column expressions: numerals, statute names, titles, tokens, labels and intents.

Patterns that meet Unicode white space start with (?U), so that they agree with engines whose ``\\s`` is not ASCII only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters, prefixes, labels and word lists that results depend on.
DIGITS = {"零": 0, "〇": 0, "一": 1, "二": 2, "两": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}
UNITS = {"十": 10, "百": 100, "千": 1000, "万": 10000}
LAW_PUNCTUATION = r"""(?U)[\s　，。！？；：、（）()【】\[\]《》〈〉〔〕“”‘’"'\-—…·]+"""
LAW_PREFIX = "中华人民共和国"
INTENT_PUNCTUATION = r"""(?U)[\s，。！？!?,.、；;：:（()）【】\[\]"'“”‘’]+"""
CHAT_WORDS = (
    "你好", "嗨", "hello", "hi", "早上好", "下午好", "晚上好", "你是谁", "你叫什么", "介绍一下你自己", "你能做什么",
    "你有什么功能", "谢谢", "感谢", "再见", "拜拜", "bye", "你是什么",
)
AUTHORITY_WORDS = ("访谈录", "官方", "典籍", "国家标准", "行业标准", "专利", "院士")
STATUS_LABELS = {1: "已废止", 2: "已修改", 3: "现行有效", 4: "尚未生效"}
PENDING, NO_SOURCE = "尚未生效", "知识库"
TOKEN = r"[\p{L}\p{N}]+"


def _lookup(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def strip(c: Column) -> Column:
    """Without white space (any Unicode one) at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def squeeze(c: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def chinese_number(c: Column) -> Column:
    """Value of a Chinese numeral below 10 ** 8; other characters are skipped, none gives 0.

    A fold over the characters: a digit waits for its unit, ten alone means 10, and ten thousand closes a section.
    """
    zero = F.struct(F.lit(0).alias("total"), F.lit(0).alias("section"), F.lit(0).alias("digit"))

    def step(state: Column, ch: Column) -> Column:
        digit, unit = F.try_element_at(_lookup(DIGITS), ch), F.try_element_at(_lookup(UNITS), ch)
        grown = F.struct(
            (state.total + (state.section + state.digit) * 10000).alias("total"), F.lit(0).alias("section"), F.lit(0).alias("digit")
        )
        added = F.struct(
            state.total.alias("total"), (state.section + F.greatest(state.digit, F.lit(1)) * unit).alias("section"), F.lit(0).alias("digit")
        )
        held = F.struct(state.total.alias("total"), state.section.alias("section"), digit.alias("digit"))
        return F.when(digit.isNotNull(), held).when(unit == 10000, grown).when(unit.isNotNull(), added).otherwise(state)

    return F.aggregate(F.split(F.coalesce(c, F.lit("")), ""), zero, step, lambda s: s.total + s.section + s.digit)


def article_parts(c: Column) -> tuple[Column, Column]:
    """(base, sub) number of an article heading such as 第十七条之一; (0, 0) for anything else."""
    bare = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)[\s　《》〔〕（）()]+", "")
    heading = r"^第?([一二三四五六七八九十百千零〇]+)条(?:之([一二三四五六七八九十]+))?$"
    return chinese_number(F.regexp_extract(bare, heading, 1)), chinese_number(F.regexp_extract(bare, heading, 2))


def article_number(c: Column) -> Column:
    """The first run of Arabic digits of a string, else its base article number; null if there is neither."""
    digits = F.nullif(F.regexp_extract(c.cast("string"), r"(\d+)", 1), F.lit(""))
    return F.coalesce(digits.try_cast("int"), F.nullif(article_parts(c.cast("string"))[0], F.lit(0)))


def normalize(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), LAW_PUNCTUATION, "")


def normalize_law(c: Column) -> Column:
    return F.regexp_replace(normalize(c), "^" + LAW_PREFIX, "")


def law_matches(a: Column, b: Column) -> Column:
    """Whether two statute names are the same up to punctuation, prefix and abbreviation by containment."""
    x, y = normalize_law(a), normalize_law(b)
    return (x != "") & (y != "") & (x.contains(y) | y.contains(x))


def clean_title(c: Column) -> Column:
    """Without tags; the five XML entities and the no-break space decoded; white space squeezed."""
    bare = F.regexp_replace(F.coalesce(c, F.lit("")), "<[^>]+>", "")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(entity), F.lit(char))
    return squeeze(bare)


def truncated(c: Column, limit: int = 2000) -> Column:
    bare = strip(F.coalesce(c, F.lit("")))
    return F.when(F.length(bare) > limit, F.concat(F.substring(bare, 1, limit), F.lit("…"))).otherwise(bare)


def tokens(c: Column) -> Column:
    """Lower-cased runs of letters and digits, repeats included."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(f"({TOKEN})"), F.lit(1))


def n_tokens(c: Column) -> Column:
    return F.regexp_count(F.lower(F.coalesce(c, F.lit(""))), F.lit(TOKEN))


def cjk_grams(c: Column) -> Column:
    """Runs of 2 to 4 CJK characters: the fallback where no word segmenter is at hand."""
    return F.regexp_extract_all(c, F.lit(r"([一-鿿]{2,4})"), F.lit(1))


def citations(c: Column) -> Column:
    """Source marks in an answer, numbered and named ones."""
    numbered = F.size(F.regexp_extract_all(c, F.lit(r"(\[来源\d+\])"), F.lit(1)))
    return numbered + F.size(F.regexp_extract_all(c, F.lit(r"(\[来源[：:][^\]]+\])"), F.lit(1)))


def is_chat(c: Column) -> Column:
    """Small talk: a chat word without its punctuation, or one followed by at most four characters."""
    bare = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), INTENT_PUNCTUATION, "")
    greets = [bare.startswith(w) & (F.length(bare) <= len(w) + 4) for w in CHAT_WORDS]
    return (bare != "") & reduce(lambda a, b: a | b, greets)


def is_authoritative(*parts: Column) -> Column:
    hay = F.concat_ws(" ", *parts)
    return reduce(lambda a, b: a | b, [hay.contains(w) for w in AUTHORITY_WORDS])


def citation_label(title: Column, article: Column, status: Column, category: Column) -> Column:
    """《title》article（尚未生效）, else the category, else a general label."""
    pending = F.when(status == 4, F.lit(f"（{PENDING}）")).otherwise("")
    named = F.concat(F.lit("《"), title, F.lit("》"), F.coalesce(article, F.lit("")), pending)
    return F.when(F.coalesce(title, F.lit("")) != "", named).otherwise(F.coalesce(F.nullif(category, F.lit("")), F.lit(NO_SOURCE)))


def context_header(title: Column, published: Column, effective: Column, status: Column, article: Column) -> Column:
    """《title》（published公布，effective施行，尚未生效）article; a title already in 《》 gets no second pair."""
    clean = clean_title(title)
    bracket = F.when(clean.startswith("《"), clean).otherwise(F.concat(F.lit("《"), clean, F.lit("》")))
    some = lambda c, word: F.when(F.coalesce(c, F.lit("")) != "", F.concat(c, F.lit(word)))
    bits = F.concat_ws("，", some(published, "公布"), some(effective, "施行"), F.when(status == 4, F.lit(PENDING)))
    return F.concat(bracket, F.when(bits == "", "").otherwise(F.concat(F.lit("（"), bits, F.lit("）"))), article)


def status_label(status: Column) -> Column:
    return F.coalesce(F.try_element_at(_lookup(STATUS_LABELS), F.coalesce(status, F.lit(3))), F.lit(""))


def hyde_query(question: Column, passage: Column) -> Column:
    """Question and generated passage on two lines; the question alone where there is no passage."""
    return F.concat_ws("\n", question, F.nullif(strip(passage), F.lit("")))


def faceted(question: Column, suffix: str) -> Column:
    return F.concat_ws(" ", question, F.lit(suffix))


def context_block(rank: Column, label: Column, text: Column) -> Column:
    return F.concat(F.lit("[来源"), rank.cast("string"), F.lit("]（"), label, F.lit("）"), text)


def sanitised(meta: Column) -> Column:
    """Open metadata, a JSON object, as map<string, variant> of scalars: null becomes the empty text, lists and objects their JSON text.

    Texts, numbers and flags stay as they are. Null for a null or broken object; of a repeated key the last value counts.
    """
    kind = lambda v: F.schema_of_variant(v)
    text = lambda v: v.cast("variant")
    keep = lambda v: F.when(kind(v) == "VOID", text(F.lit(""))).when(kind(v).rlike("^(OBJECT|ARRAY)"), text(F.to_json(v))).otherwise(v)
    return F.transform_values(F.from_json(meta, "map<string,variant>"), lambda _, v: F.coalesce(keep(v), text(F.lit(""))))

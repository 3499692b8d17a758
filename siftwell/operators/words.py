"""Words of texts without blanks: a dictionary from counts or from the texts themselves, and the best path through it.

A run of characters is cut to the words of least total cost, a word's cost being the negative logarithm of its share. The
words that occur in a run are joined to it from the dictionary; where none of them crosses a place the run falls apart, and
each part is solved by a fold over its places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.operators.index import BROADCAST_TERMS
from siftwell.storage import staged

#: Characters of a word at most, texts that a found word needs, its least branching entropy and cohesion (natural logarithms).
LONGEST, LEAST, ENTROPY, COHESION = 16, 5, 2.0, 1.0
#: What an unknown character costs beyond the dearest word.
UNKNOWN = 4.0


def costs(words: DataFrame, word: str = "word") -> DataFrame:
    """(word, cost) of a table with a row for each occurrence: the logarithm of all occurrences over the word's."""
    counted = words.filter(F.length(word) > 0).groupBy(F.col(word).alias("word")).agg(F.count("*").alias("n"))
    total = counted.agg(F.sum("n").alias("total"))
    return counted.crossJoin(F.broadcast(total)).select("word", F.log(F.col("total") / F.col("n")).alias("cost"))  # one row


def _pieces(run: str, longest: Column | int) -> Column:
    """Structs (start, word) of all pieces of a run with up to ``longest`` characters; starts count from 0."""
    n = F.length(run)
    at = lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), n - i)), lambda size: F.struct(i.alias("start"), F.substring(F.col(run), i + 1, size).alias("word")))
    return F.when(n > 0, F.flatten(F.transform(F.sequence(F.lit(0), n - 1), at)))


def found_words(runs: DataFrame, run: str = "run", longest: int = 4, least: int = LEAST, entropy: float = ENTROPY, cohesion: float = COHESION) -> DataFrame:
    """(word, n): pieces of the runs that stand like words, all single characters among them.

    Of two or more characters a piece is taken if it occurs ``least`` times, if what stands before and after it varies by
    ``entropy`` or more, and if it occurs e ** cohesion times as often as chance puts any two parts of it together. All counts
    cover all runs; they come from one count of the pieces, as a neighbour is the rest of a longer piece.
    """
    pieces = staged(runs.select(F.explode(_pieces(run, longest + 1)).alias("p")).groupBy(F.col("p.word").alias("word")).agg(F.count("*").alias("n")))
    total = pieces.filter(F.length("word") == 1).agg(F.sum("n")).first()[0] or 1
    size = F.length("word")

    def varied(rest: Column, name: str) -> DataFrame:
        # a run's end counts as a neighbour of its own, which adds nothing to the sum
        return pieces.filter(size > 1).groupBy(rest.alias("word")).agg(F.sum(F.col("n") * F.log("n")).alias(name))

    after, before = varied(F.substring(F.col("word"), F.lit(1), size - 1), "after"), varied(F.substring(F.col("word"), F.lit(2), size), "before")
    some = pieces.filter((size > 1) & (size <= longest) & (F.col("n") >= least)).join(after, "word", "left").join(before, "word", "left")
    spread = lambda name: F.log("n") - F.coalesce(name, F.lit(0.0)) / F.col("n")
    some = staged(some.filter(F.least(spread("after"), spread("before")) >= entropy).select("word", "n"))
    parts = some.select("word", "n", F.explode(F.sequence(F.lit(1), size - 1)).alias("i"))
    parts = parts.select("word", "n", F.substring(F.col("word"), F.lit(1), F.col("i")).alias("left"), F.substring(F.col("word"), F.col("i") + 1, size).alias("right"))
    known = lambda side: pieces.select(F.col("word").alias(side), F.col("n").alias(f"n_{side}"))
    joined = parts.join(known("left"), "left").join(known("right"), "right")
    loose = F.log(F.col("n") * total / (F.col("n_left") * F.col("n_right")))
    bound = joined.groupBy("word").agg(F.min(loose).alias("cohesion"), F.first("n").alias("n")).filter(F.col("cohesion") >= cohesion)
    return bound.select("word", "n").unionByName(pieces.filter(size == 1).select("word", "n"))


def _best(options: Column) -> Column:
    """Costs and starts of the best word that ends at each place of a part, by a fold over the places' options in order."""
    start = F.array(F.struct(F.lit(0.0).alias("cost"), F.lit(-1).alias("start")))

    def step(done: Column, place: Column) -> Column:
        paths = F.transform(place["options"], lambda o: F.struct((done[o["start"]]["cost"] + o["cost"]).alias("cost"), o["start"].alias("start")))
        return F.concat(done, F.array(F.array_min(paths)))

    return F.aggregate(options, start, step)


def _path(best: Column) -> Column:
    """The starts of the words on the best path, in order."""
    back = F.sequence(F.size(best) - 1, F.lit(1), F.lit(-1))
    first = F.struct((F.size(best) - 1).alias("at"), F.array().cast("array<int>").alias("starts"))

    def step(s: Column, i: Column) -> Column:
        own = best[i]["start"]
        taken = F.struct(own.alias("at"), F.concat(F.array(own), s["starts"]).alias("starts"))
        return F.when(s["at"] == i, taken).otherwise(s)

    return F.aggregate(back, first, step)["starts"]


def segmented(runs: DataFrame, dictionary: DataFrame, key: str = "id", run: str = "run") -> DataFrame:
    """(key, words): every run of ``runs`` cut to the words of least total cost; of equal costs the earlier start, that is the longer last word.

    ``dictionary`` has (word, cost); words of more than LONGEST characters have no part. A character that is no word costs UNKNOWN
    more than the dearest word. At most BROADCAST_TERMS words are broadcast, so only words that a run holds leave their task.
    Null and empty runs have no words; a key must stand once.
    """
    words = dictionary.filter(F.length("word").between(1, LONGEST)).select("word", "cost")
    dearest = words.agg(F.coalesce(F.max("cost"), F.lit(0.0)).alias("dearest"))
    few = words.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS
    slim = runs.select(F.col(key).alias("id"), F.coalesce(run, F.lit("")).alias("run"))
    pieces = slim.select("id", F.explode(_pieces("run", LONGEST)).alias("p")).select("id", "p.start", "p.word")
    held = pieces.join(F.broadcast(words) if few else words, "word").select("id", "start", F.length("word").alias("size"), "cost")
    # each character, known or not, is an option of its own; the minimum takes the known one
    single = slim.filter("run <> ''").select("id", F.explode(F.sequence(F.lit(0), F.length("run") - 1)).alias("start")).crossJoin(F.broadcast(dearest))
    options = held.unionByName(single.select("id", "start", F.lit(1).alias("size"), (F.col("dearest") + UNKNOWN).alias("cost")))
    options = options.groupBy("id", "start").agg(F.collect_list(F.struct("size", "cost")).alias("options"), F.max(F.col("start") + F.col("size")).alias("end"))
    # a part begins where no word of an earlier start reaches beyond
    order = Window.partitionBy("id").orderBy("start")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    parts = options.withColumn("opens", (F.coalesce(reach, F.lit(0)) <= F.col("start")).cast("int")).withColumn("part", F.sum("opens").over(order))
    base = F.min("start").over(Window.partitionBy("id", "part"))
    each = parts.withColumn("base", base).select("id", "base", "start", F.explode("options").alias("o"))
    ends = each.groupBy("id", "base", (F.col("start") + F.col("o.size") - F.col("base")).alias("at")).agg(F.collect_list(F.struct((F.col("start") - F.col("base")).alias("start"), F.col("o.cost").alias("cost"))).alias("options"))
    solved = staged(ends.groupBy("id", "base").agg(F.array_sort(F.collect_list(F.struct("at", "options"))).alias("places")).select("id", "base", _best(F.col("places")).alias("best")))
    starts = solved.select("id", F.transform(_path(F.col("best")), lambda x: x + F.col("base")).alias("starts"))
    whole = starts.groupBy("id").agg(F.array_sort(F.flatten(F.collect_list("starts"))).alias("starts"))
    joined = slim.join(whole, "id", "left")
    cut = F.transform("starts", lambda x, i: F.substring(F.col("run"), x + 1, F.coalesce(F.try_element_at("starts", i + 2), F.length("run")) - x))
    return joined.select(F.col("id").alias(key), F.coalesce(cut, F.array().cast("array<string>")).alias("words"))


def boundaries(words: Column) -> Column:
    """The (start, end) places of words that stand one after the other, as structs."""
    ends = F.aggregate(words, F.array(F.lit(0)), lambda s, w: F.concat(s, F.array(F.element_at(s, -1) + F.length(w))))
    return F.transform(F.slice(ends, 2, F.size(ends)), lambda e, i: F.struct(ends[i].alias("start"), e.alias("end")))


def agreement(found: Column, true: Column) -> Column:
    """The number of words of ``found`` that ``true`` has at the same place; both are words of one run."""
    return F.size(F.array_intersect(boundaries(found), boundaries(true)))

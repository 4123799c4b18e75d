r"""Quality rules with cross-document line frequency, in DataFrame operations only.

Counts over each whole text give the base rules.  Normalised lines are hashed and
counted by the distinct documents of their host that hold them; lines above the host's limits
are boilerplate and are taken out; a document that keeps too small a share of its words is
rejected.

Defined results: a null text has no words and fails the base; a null host is a host of its
own; a document is a host, doc_id and text, so exact copies under ids of their own count each, and repeated
rows of one document count once and get equal results; rows without doc_id take part; an empty table gives
an empty result.  Extra columns, whatever their names, are ignored by ``judge``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, hot_join, spread
from .mixing import words_in

#: A line is boilerplate if more documents of its host hold it than LEAST and than SHARE of them, or, whatever
#: their share, than MOST, as in very large hosts, or in a small host than SMALL and than half of them.
SHARE, LEAST, MOST, SMALL = 0.01, 20, 1000, 4
#: A document that keeps a smaller share of its words is depleted.
KEPT_SHARE = 0.5
SPACE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, "\t\n\x0b\f\r", "     "), " "), "")


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once: a lambda that names an expression would compute it for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _windows(words: Column) -> Column:
    """Hashes of the three-word windows."""
    of = lambda w: F.transform(F.slice(w, F.lit(1), F.greatest(F.size(w) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
    return _let(words, of)


def _covered(words: Column) -> Column:
    """Words inside windows that occur twice or more, the first occurrence included.  Equal
    windows become neighbours when (hash, position) is sorted; texts without any skip the sort."""
    start = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n"))

    def twice(s: Column) -> Column:
        hit = F.transform(s, lambda x, j: F.when((F.get(s, j - 1)["h"] == x["h"]) | (F.get(s, j + 1)["h"] == x["h"]), x["i"]))
        return F.array_sort(F.filter(hit, lambda x: x.isNotNull()))

    def of(window: Column) -> Column:
        paired = F.array_sort(F.transform(window, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        total = F.aggregate(_let(paired, twice), start, lambda a, x: F.struct(x.alias("last"), (a["n"] + F.least(F.lit(3), x - a["last"])).alias("n")))["n"]
        return F.when(F.size(F.array_distinct(window)) < F.size(window), total).otherwise(F.lit(0)).cast("long")

    return _let(_windows(words), of)


def _line_key(line: Column) -> Column:
    """Lower case, runs of white space as one blank, digits alike."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(line)), r"[\x20\x09-\x0D]++", " "), "[0-9]++", "0")


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, source, key (128 bits of host, doc_id and text), lines (hash by host, words) and the base counts, from one pass over the texts."""
    t = docs.select("doc_id", "source", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
    t = t.select("doc_id", "source", "t", _words(F.col("t")).alias("words"), F.filter(F.split("t", "\n"), lambda x: F.length(F.translate(x, SPACE, "")) > 0).alias("full"))
    lines = F.transform("full", lambda x: F.struct(F.xxhash64(F.col("source"), F.col("source").isNull(), _line_key(x)).alias("hash"), words_in(x).alias("words")))
    return t.select(
        "doc_id", "source",
        F.unhex(F.md5(F.concat_ws("\t", F.col("source").isNull().cast("string"), "source", F.col("doc_id").cast("string"), "t").cast("binary"))).alias("key"),
        lines.alias("lines"),
        F.size("words").cast("long").alias("n_words"),
        F.length(F.translate("t", SPACE, "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("full") - F.size(F.array_distinct("full"))).cast("long").alias("n_dup_lines"),
        _covered(F.col("words")).alias("n_repeat_words"),
    )


def judge(docs: DataFrame, scratch: Scratch, share: float = SHARE, least: int = LEAST, most: int = MOST, small: int = SMALL, kept_share: float = KEPT_SHARE) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, boilerplate_words, kept: a row per row."""
    t = scratch.stash(measure(docs), "measures")
    rows = t.select("source", "key", F.explode("lines").alias("l")).select("source", "key", "l.hash", "l.words")
    lines = scratch.stash(rows.groupBy("source", "key", "hash").agg(F.sum("words").alias("all")), "lines")
    copies = scratch.stash(t.groupBy("source", "key").agg(F.count(F.lit(1)).alias("copies")), "rows-by-document")
    hosts = scratch.stash(copies.groupBy("source").agg(F.count(F.lit(1)).alias("documents")).select(F.col("source").alias("host"), "documents"), "hosts")
    counted = lines.groupBy("source", "hash").agg(F.count(F.lit(1)).alias("holding")).where(F.col("holding") > min(least, most, small))
    n = F.col("holding")
    above = ((n > least) & (n > share * F.col("documents"))) | (n > most) | ((n > small) & (n > 0.5 * F.col("documents")))
    often = counted.join(hosts, counted["source"].eqNullSafe(hosts["host"])).where(above).groupBy("hash").agg(F.sum("holding").alias("_n"))
    often = scratch.stash(often, "boilerplate")
    # A document's rows have all been summed; dividing by their number gives the document's words.
    removed = hot_join(lines.select("key", "hash", "all"), often, "hash").groupBy("key").agg(F.sum("all").alias("all")).join(copies.select("key", "copies"), "key")
    removed = scratch.stash(removed.select("key", F.floor(F.col("all") / F.col("copies")).cast("long").alias("boilerplate_words")), "removed")
    out = t.drop("lines", "source").join(removed, "key", "left").fillna({"boilerplate_words": 0})
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    depleted = F.col("n_words") - F.col("boilerplate_words") < kept_share * F.col("n_words")
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "boilerplate_words", (~failed & ~depleted).alias("kept"))


def op8_quality_rules(spark, sf_dir: str) -> DataFrame:
    return judge(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")), Scratch(spark))

"""Lines that many documents of a host share, in DataFrame operations only.

A line is compared in normalised form: trimmed and lower-cased. Blank lines are never
counted or dropped. Copies of a whole text count as one document, so a group of exact copies does not make its own lines
look like boilerplate. A NULL host is the host with the empty name; a NULL text has no lines and stays NULL.

Line hashes are made distinct per text on the map side and then counted per (host, line), so a line that a third of all
documents hold reaches the shuffle as one row per text and the count as one row per task. Lines over a share ``r`` of the
documents of a host are at most (mean lines of a text) / r, so the dropped lines of a host fit one array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.tables import bounded_broadcast, stored

SPACE = " \t\n\x0b\x0c\r"
#: Texts of a line from which it is broadcast.
_HOT = 50_000
BLANKS = "[\\x20\\x09-\\x0D]+"


def line_array(text: Column) -> Column:
    return F.split(text, "\n")


def normal(line: Column) -> Column:
    return F.lower(F.btrim(line, F.lit(SPACE)))


def line_hash(line: Column) -> Column:
    return F.xxhash64(normal(line))


def has_word(line: Column) -> Column:
    return F.length(F.btrim(line, F.lit(SPACE))) > 0


def word_count(text: Column) -> Column:
    """Number of words between white space."""
    trimmed = F.btrim(text, F.lit(SPACE))
    return F.when(F.length(trimmed) > 0, F.size(F.split(trimmed, BLANKS))).otherwise(0)


def shared_lines(docs: DataFrame, min_docs: int, percent: float, host_col="source", text_col="text") -> DataFrame:
    """(host, dropped): hashes of the lines that at least ``min_docs`` texts and ``percent`` % of the texts of a host hold."""
    rows = docs.select(F.coalesce(host_col, F.lit("")).alias("host"), F.col(text_col).alias("t")).where("t IS NOT NULL")
    rows = rows.select("host", F.xxhash64("t").alias("text"), F.array_distinct(F.transform(F.filter(line_array(F.col("t")), has_word), line_hash)).alias("lines"))
    texts = rows.groupBy("host", "text").agg(F.lit(1)).groupBy("host").agg(F.count("*").alias("texts"))
    held = rows.select("host", "text", F.explode("lines").alias("line")).distinct().groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs)
    over = held.join(F.broadcast(texts) if _few(texts) else texts, "host").where(F.col("n") * 100 >= F.col("texts") * percent)
    return over.groupBy("host").agg(F.collect_list("line").alias("dropped"))


def dropped_words(docs: DataFrame, min_docs: int, host_col="source", text_col="text") -> DataFrame:
    """(host, text, gone, lines): hash, words and line hashes of each text in lines that at least ``min_docs`` texts of its host hold.

    Rows of (text, line) meet the shared lines by (host, line). Lines of very many texts are few, as each takes that many
    rows, and are broadcast; so no key of the other join has many rows, and no host meets in one place.
    """
    rows = docs.select(F.coalesce(host_col, F.lit("")).alias("host"), F.col(text_col).alias("t")).where("t IS NOT NULL")
    line = F.transform(F.filter(line_array(F.col("t")), has_word), lambda x: F.struct(line_hash(x).alias("line"), word_count(x).cast("long").alias("w")))
    # a row without a line counts the copies of the text
    copy = F.array(F.struct(F.lit(None).cast("long").alias("line"), F.lit(1).cast("long").alias("w")))
    held = rows.select("host", F.xxhash64("t").alias("text"), F.explode(F.concat(line, copy)).alias("x")).groupBy("host", "text", "x.line").agg(F.sum("x.w").alias("w"))
    held = stored(held, "held-lines")
    lines = held.where("line IS NOT NULL")
    shared = stored(lines.groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs), "shared-lines")
    hot = F.broadcast(shared.where(F.col("n") >= _HOT).select("host", "line"))
    cold = shared.where(F.col("n") < _HOT).select("host", "line")
    cold = bounded_broadcast(cold, cold.count(), 32)
    found = lines.join(hot, ["host", "line"]).unionByName(lines.join(hot, ["host", "line"], "left_anti").join(cold, ["host", "line"]))
    every = found.unionByName(held.where("line IS NULL"))
    copies = F.sum(F.when(F.col("line").isNull(), F.col("w")))
    gone = F.sum(F.when(F.col("line").isNotNull(), F.col("w")))
    marks = every.groupBy("host", "text").agg((gone / copies).cast("long").alias("gone"), F.collect_list("line").alias("lines"))
    return marks.where("gone > 0")


def _few(hosts: DataFrame) -> bool:
    return hosts.count() <= 200_000


def with_dropped(docs: DataFrame, min_docs: int, percent: float, host_col="source", text_col="text") -> DataFrame:
    """``docs`` with ``kept_lines``, ``dropped_lines`` and ``n_lines`` (lines of the text before); NULL for a NULL text."""
    shared = stored(shared_lines(docs, min_docs, percent, host_col, text_col), "lines")
    size = shared.agg(F.count("*").alias("hosts"), F.sum(F.size("dropped")).alias("lines")).first()
    # the dropped lines of all hosts are broadcast while their size is small, else both sides meet by host
    right = bounded_broadcast(shared.toDF("_host", "_dropped"), (size["hosts"] or 0) * 4 + (size["lines"] or 0), 16)
    joined = docs.join(right, F.coalesce(F.col(host_col), F.lit("")) == F.col("_host"), "left")
    goes = lambda line: F.array_contains("_dropped", line_hash(line)) & has_word(line)
    lines = line_array(F.col(text_col))
    kept = F.when(F.col("_dropped").isNull(), lines).otherwise(F.filter(lines, lambda line: ~goes(line)))
    dropped = F.when(F.col("_dropped").isNotNull(), F.filter(lines, goes))
    return joined.withColumns({"kept_lines": kept, "dropped_lines": dropped, "n_lines": F.size(lines)}).drop("_host", "_dropped")


def drop_boilerplate(docs: DataFrame, min_pages: int = 10, percent: float = 2.0, host_col="source", text_col="text") -> DataFrame:
    """Line dedup: ``docs`` with the text without the lines that exceed a share of the pages of its host, n_lines and n_dropped.

    Row order of lines stays; a text of which nothing is left is empty, not NULL. Repeated rows get equal results.
    """
    marked = with_dropped(docs, min_pages, percent, host_col, text_col)
    return marked.withColumns({
        text_col: F.when(F.col(text_col).isNotNull(), F.array_join("kept_lines", "\n")),
        "n_dropped": F.coalesce(F.col("n_lines") - F.size("kept_lines"), F.lit(0)),
        "n_lines": F.coalesce("n_lines", F.lit(0)),
    }).drop("kept_lines", "dropped_lines")

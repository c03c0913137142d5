"""Quality rules of whole texts and cross-document line frequency, in DataFrame operations only.

Base rules: too few words, or too many words in repeated three-word windows. Method: lines that a number of
distinct documents of a host hold, whatever its size, are removed, and a document of which too little is left is rejected.

NULL and empty texts have no words and fail. Repeated rows are judged alike. The windows of a text are hashed, sorted
with their positions and compared with their neighbours, so a text of n words takes n log n steps in its own row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.lines import BLANKS, SPACE, dropped_words, has_word, line_array, line_hash
from tablewright.llm.tables import bounded_broadcast, stored

SYMBOLS = "#*$%&|<>"
#: Bits for the position of a window in its text.
_BITS = 28
_POSITION = (1 << _BITS) - 1


def _at(array: str, k: Column) -> Column:
    return F.get(F.col(array), k)


def text_statistics(docs: DataFrame, text_col="text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words."""
    text = F.coalesce(text_col, F.lit(""))
    solid = F.translate(text, SPACE, "")
    filled = F.filter(line_array(text), has_word)
    trimmed = F.btrim(text, F.lit(SPACE))
    out = docs.withColumns({
        "_words": F.when(F.length(trimmed) > 0, F.split(trimmed, BLANKS)).otherwise(F.array().cast("array<string>")),
        "word_chars": F.length(solid).cast("long"),
        "n_symbols": (F.length(solid) - F.length(F.translate(solid, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": (F.size(filled) - F.size(F.array_distinct(filled))).cast("long"),
    })
    # upper hash bits and position of every window in one number, sorted: windows that may be equal are neighbours
    gram = lambda k: F.xxhash64(_at("_words", k), _at("_words", k + 1), _at("_words", k + 2))
    packed = F.transform(F.sequence(F.lit(0), F.size("_words") - 3), lambda k: gram(k).bitwiseAND(F.lit(~_POSITION)).bitwiseOR(k.cast("long")))
    out = out.withColumns({"n_words": F.size("_words").cast("long"), "_packed": F.when(F.size("_words") >= 3, F.sort_array(packed))})
    near = lambda x, k: F.coalesce(F.shiftrightunsigned(x.bitwiseXOR(_at("_packed", k)), _BITS) == 0, F.lit(False))
    maybe = F.filter("_packed", lambda x, k: near(x, k - 1) | near(x, k + 1))
    # the few that are left are compared by their whole hash
    whole = F.transform(maybe, lambda x: F.struct(gram(x.bitwiseAND(F.lit(_POSITION)).cast("int")).alias("h"), x.bitwiseAND(F.lit(_POSITION)).cast("int").alias("k")))
    out = out.withColumn("_grams", F.sort_array(whole))
    same = lambda x, k: F.coalesce(_at("_grams", k)["h"] == x["h"], F.lit(False))
    out = out.withColumn("_twice", F.sort_array(F.filter("_grams", lambda x, k: same(x, k - 1) | same(x, k + 1))["k"]))
    reach = F.transform("_twice", lambda p, k: F.least(F.lit(3), F.coalesce(_at("_twice", k + 1) - p, F.lit(3))))
    out = out.withColumn("n_repeat_words", F.coalesce(F.aggregate(reach, F.lit(0), lambda a, b: a + b), F.lit(0)).cast("long"))
    return out.drop("_words", "_packed", "_grams", "_twice")


def judge_quality(docs: DataFrame, min_words: int = 50, max_repeat_percent: int = 50, min_docs: int = 20, min_left_percent: int = 50, min_left_words: int = 25, host_col="source", text_col="text") -> DataFrame:
    """``docs`` with the statistics, base_failed, dropped_lines, n_left (words outside them) and kept."""
    marks = stored(dropped_words(docs, min_docs, host_col, text_col).toDF("_host", "_text", "_gone", "_lines"), "marks")
    size = marks.agg(F.count("*").alias("texts"), F.sum(F.size("_lines")).alias("lines")).first()
    marks = bounded_broadcast(marks, size["texts"] * 4 + (size["lines"] or 0), 16)
    # statistics come first, so only what is asked for travels
    judged = text_statistics(docs, text_col).withColumns({"_h": F.coalesce(host_col, F.lit("")), "_t": F.when(F.col(text_col).isNotNull(), F.xxhash64(text_col))})
    judged = judged.join(marks, (F.col("_h") == F.col("_host")) & (F.col("_t") == F.col("_text")), "left")
    goes = lambda line: has_word(line) & F.array_contains("_lines", line_hash(line))
    judged = judged.withColumn("dropped_lines", F.when(F.col("_lines").isNotNull(), F.filter(line_array(F.col(text_col)), goes)))
    failed = (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * max_repeat_percent)
    judged = judged.withColumns({"base_failed": failed, "n_left": F.col("n_words") - F.coalesce("_gone", F.lit(0))})
    judged = judged.drop("_h", "_t", "_host", "_text", "_gone", "_lines")
    enough = (F.col("n_left") * 100 >= F.col("n_words") * min_left_percent) & (F.col("n_left") >= min_left_words)
    return judged.withColumn("kept", ~F.col("base_failed") & enough)

"""Secret scan in DataFrame operations: fixed patterns, and character Markov models for the strings they miss.

Two first-order character models, one of random strings and one of ordinary identifiers, are counted from labelled
samples: values the patterns found, and shorter words of the same alphabet. A longer string of that alphabet is a secret
if the log-likelihood ratio of the two models over its characters is high enough. The samples come from about
``sample_docs`` documents chosen by a hash of their id; the scan covers every whole text.

Positions count code points, the end is exclusive. NULL texts are empty and have no spans. Repeated rows are scanned
alike. Spans of a kind do not overlap; a model's span never touches one of a pattern.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The patterns. Kinds are listed in the order in which spans that start together are written.
KINDS = ("assign", "access", "hex", "markov")
ASSIGN = (
    r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
ALPHABET = "A-Za-z0-9+/_=-"
_LOW, _WIDE = ord("+"), ord("z") - ord("+") + 1
_SPANS = "array<struct<start:int,kind:int,end:int,value:string>>"


@dataclass(frozen=True)
class SecretOptions:
    sample_docs: int = 20_000
    min_value: int = 6
    min_candidate: int = 20
    min_ratio: float = 12.0
    smoothing: float = 0.5


def pattern_spans(text: Column, pattern: str, kind: int, needed: Column) -> Column:
    """Leftmost non-overlapping matches with their places; ``needed`` is a cheap test that rules most texts out."""
    both = F.array(F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("p")))
    empty = F.struct(F.lit(0).alias("at"), F.array().cast(_SPANS).alias("out"))

    def step(acc: Column, k: Column, x: Column) -> Column:
        start = acc["at"] + F.length(F.get(x["p"], k))
        end = start + F.length(F.get(x["m"], k))
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), F.get(x["m"], k).alias("value"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    spans = lambda x: F.when(F.size(x["m"]) > 0, F.aggregate(F.sequence(F.lit(0), F.size(x["m"]) - 1), empty, lambda a, k: step(a, k, x))["out"])
    return F.coalesce(F.when(needed, F.get(F.transform(both, spans), F.lit(0))), F.array().cast(_SPANS))


def base_spans(text: Column, min_value: int) -> Column:
    """Spans of the three patterns, by start and kind."""
    assign = F.filter(pattern_spans(text, ASSIGN, 0, text.rlike(ASSIGN)), lambda s: F.length(F.regexp_extract(s["value"], ASSIGN, 2)) >= min_value)
    access = pattern_spans(text, ACCESS, 1, text.contains("AKIA"))
    return F.sort_array(F.concat(assign, access, pattern_spans(text, HEX, 2, text.rlike(HEX))))


def with_base_spans(docs: DataFrame, options: SecretOptions, text_col="text") -> DataFrame:
    text = F.coalesce(text_col, F.lit(""))
    return docs.withColumn("base", base_spans(text, options.min_value))


def fit_markov(docs: DataFrame, options: SecretOptions, id_col="doc_id", text_col="text") -> list[float]:
    """Log-likelihood ratio of each pair of characters, row by row of the alphabet's code range."""
    n = docs.count()
    share = min(1.0, options.sample_docs / max(n, 1))
    draw = F.xxhash64(F.col(id_col).cast("string"), F.lit("secrets")).cast("double") / F.lit(2.0**64) + F.lit(0.5)
    rows = with_base_spans(docs.select(id_col, text_col).where(draw < share), options, text_col)
    value = lambda s: F.when(s["kind"] == 0, F.regexp_extract(s["value"], ASSIGN, 2)).otherwise(s["value"])
    words = F.regexp_extract_all(F.coalesce(text_col, F.lit("")), F.lit(f"(?<![{ALPHABET}])[A-Za-z_-]{{6,19}}(?![{ALPHABET}])"), F.lit(0))
    samples = rows.select(F.explode(F.transform("base", value)).alias("s"), F.lit(1).alias("y")).union(rows.select(F.explode(words), F.lit(0)))
    chars = samples.select("y", F.split("s", "").alias("c")).where(F.size("c") > 1)
    pairs = chars.select("y", F.explode(F.arrays_zip(F.slice("c", F.lit(1), F.size("c") - 1).alias("a"), F.slice("c", F.lit(2), F.size("c") - 1).alias("b"))).alias("p"))
    counted = pairs.groupBy("y", F.ascii("p.a").alias("a"), F.ascii("p.b").alias("b")).agg(F.count("*").alias("n")).collect()  # at most the alphabet squared, twice
    table = [[[options.smoothing] * _WIDE for _ in range(_WIDE)] for _ in range(2)]
    for r in counted:
        a, b = r["a"] - _LOW, r["b"] - _LOW
        if 0 <= a < _WIDE and 0 <= b < _WIDE:
            table[r["y"]][a][b] += r["n"]
    total = [[sum(row) for row in t] for t in table]
    return [math.log(table[1][a][b] / total[1][a]) - math.log(table[0][a][b] / total[0][a]) for a in range(_WIDE) for b in range(_WIDE)]


def likelihood_ratio(value: Column, ratios: list[float]) -> Column:
    """Sum of the pair ratios over a string of the alphabet."""
    table = F.split(F.lit(",".join(f"{x:.5f}" for x in ratios)), ",").cast("array<double>")
    code = lambda c: F.ascii(c) - _LOW
    total = lambda c: F.aggregate(F.sequence(F.lit(0), F.size(c) - 2), F.lit(0.0), lambda s, k: s + F.get(table, code(F.get(c, k)) * _WIDE + code(F.get(c, k + 1))))
    return F.get(F.transform(F.array(F.split(value, "")), total), F.lit(0))


def find_secrets(docs: DataFrame, ratios: list[float], options: SecretOptions | None = None, text_col="text") -> DataFrame:
    """``docs`` with ``base`` (spans of the patterns) and ``spans`` (these and the model's), arrays of (start, kind, end, value) in order."""
    o = options or SecretOptions()
    text = F.coalesce(text_col, F.lit(""))
    candidate = f"[{ALPHABET}]{{{o.min_candidate},}}"
    out = with_base_spans(docs, o, text_col).withColumn("_long", pattern_spans(text, candidate, 3, text.rlike(candidate)))
    free = lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    found = F.filter("_long", lambda s: free(s) & (likelihood_ratio(s["value"], ratios) >= o.min_ratio))
    return out.withColumn("spans", F.sort_array(F.concat("base", found))).drop("_long")


def written(spans: str) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def kind_count(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("long")

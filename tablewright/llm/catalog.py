"""The registered queries of the subpackage and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm import alignment, archives, decontamination, language_model, lines, neardup, packing, periodic, quality, secrets, tokenfiles, toxicity, urls
from tablewright.llm.tables import fold, read
from tablewright.session import scratch_path


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document; rows of fold 0 are held out from training."""
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    model = toxicity.fit_toxicity(docs, labels.where(fold("doc_id", 5) != 0))
    scored = toxicity.score_toxicity(docs.select("doc_id", "text"), model, score_col="score", passages_col="passages")
    return scored.select(
        "doc_id",
        F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        F.size("passages").alias("n_passages"),
    )


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document over links at 0.8 of two-word shingles; one of each component is kept."""
    found = neardup.near_duplicates(read(spark, sf_dir, "documents"), neardup.NearDupOptions(words=2))
    return found.select(
        F.col("id").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        F.col("component").alias("component_id"),
        F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"),
    )


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in 13-word windows of the benchmark."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontamination.find_contamination(docs, read(spark, sf_dir, "benchmark"))
    names = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["item_id"].cast("string"))))
    return found.select(
        "doc_id",
        "n_words",
        decontamination.n_hit().alias("n_hit"),
        F.size(names).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", names), 256).alias("items_sha256"),
        decontamination.contaminated().alias("contaminated"),
    )


def pack_options() -> packing.PackOptions:
    return packing.PackOptions(public_tokenizers.path("byte_bpe_50k.json"))


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every document in sequences of 1024 tokens."""
    _, pieces = packing.pack(read(spark, sf_dir, "documents").select("doc_id", "text"), pack_options())
    return packing.digest(pieces)


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP6_SQL = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL),
bw AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS l, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
dw AS (
  SELECT doc_id, l, i, array_to_string(w[i:i + l - 1], ' ') AS g
  FROM (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM d, (SELECT DISTINCT l FROM bw) WHERE len(w) >= l)),
m AS (SELECT doc_id, i, l, item_id FROM dw JOIN bw USING (l, g)),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + l)) AS p FROM m) GROUP BY doc_id),
found AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS s
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(s, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN found USING (doc_id)
"""

def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base statistics of every document and the verdict after removing the shared lines of its source."""
    judged = quality.judge_quality(read(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_left", "base_failed", "kept")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that exceed the boilerplate ratio of its source."""
    return lines.drop_boilerplate(read(spark, sf_dir, "documents").select("doc_id", "source", "text"))


def _lines_sql(min_docs: int, percent: float) -> str:
    normal = "lower(trim(l, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)))"
    return rf"""
docs AS (SELECT doc_id, coalesce(source, '') AS host, text FROM documents),
lines AS (
  SELECT doc_id, host, text, k, l, {normal} AS line
  FROM (SELECT doc_id, host, text, unnest(string_split(text, chr(10))) AS l, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS k FROM docs)),
shared AS (
  SELECT host, line FROM lines WHERE line <> '' GROUP BY host, line
  HAVING count(DISTINCT text) >= {min_docs}
     AND count(DISTINCT text) * 100 >= {percent} * (SELECT count(DISTINCT text) FROM docs d WHERE d.host = lines.host)),
marked AS (SELECT lines.*, shared.line IS NOT NULL AS dropped FROM lines LEFT JOIN shared USING (host, line))"""


OP8_SQL = f"""
WITH {_lines_sql(10, 2.0)}
SELECT doc_id, source, CASE WHEN d.text IS NOT NULL THEN coalesce(m.text, '') END AS text,
       CAST(coalesce(n_lines, 0) AS INTEGER) AS n_lines, CAST(coalesce(n_dropped, 0) AS INTEGER) AS n_dropped
FROM documents d LEFT JOIN (
  SELECT doc_id, string_agg(l, chr(10) ORDER BY k) FILTER (NOT dropped) AS text, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped
  FROM marked GROUP BY doc_id) m USING (doc_id)
"""

OP4_SQL = rf"""
WITH {_lines_sql(20, 1.0)},
w AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
grams AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
twice AS (SELECT doc_id, i FROM grams QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
repeats AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY doc_id),
rest AS (
  SELECT doc_id, sum(len(regexp_extract_all(l, '[^\x20\x09-\x0D]+'))) FILTER (NOT dropped) AS n_left,
         count(*) FILTER (line <> '') - count(DISTINCT l) FILTER (line <> '') AS dup
  FROM marked GROUP BY doc_id),
a AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(coalesce(dup, 0) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(n_left, 0) AS BIGINT) AS n_left
  FROM w LEFT JOIN repeats USING (doc_id) LEFT JOIN rest USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM a)
SELECT *, NOT base_failed AND n_left * 100 >= n_words * 50 AND n_left >= 25 AS kept FROM b
"""

#: The rules of the url query.
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on the url of every page."""
    return urls.judge_urls(read(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    options = secrets.SecretOptions()
    found = secrets.find_secrets(docs, secrets.fit_markov(docs, options), options)
    return found.select(
        "doc_id",
        *[secrets.kind_count("base", k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(secrets.written("base"), 256).alias("base_sha256"),
        secrets.written("spans").alias("spans"),
    )


def op10_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every document under a model of orders one to three of the documents of six folds of seven."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found, n = language_model.score_texts(docs, fold("doc_id", 7) != 2, language_model.ModelOptions(order=3))
    return found.select(
        F.col("id").alias("doc_id"),
        F.coalesce(fold("id", 7) == 2, F.lit(False)).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(n).cast("long").alias("train_tokens"),
        "base_score",
        "score",
    )


def op3_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WARC records of every page, converted from legacy archives and read back."""
    found = archives.convert_pages(read(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of the tokens of two tokenizers in every document, and the support of its links in the corpus."""
    options = alignment.AlignOptions(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    found = alignment.align_texts(read(spark, sf_dir, "documents").select("doc_id", "text"), options)
    written = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")
    found = found.withColumn("groups_sha256", written).drop("groups")
    return alignment.link_support(found).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place, size and checksum of the ids of every document, read back from files of fixed-width ids."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    folder = scratch_path(spark, "ids")
    tokenfiles.write_files(docs, folder, tokenfiles.FileOptions(public_tokenizers.path("word_bpe_49k.json")))
    found = tokenfiles.read_documents(spark, folder, docs.schema["doc_id"].dataType.simpleString(), ids=False)
    return tokenfiles.with_starts(found).select(F.col("key").alias("doc_id"), "start", "n_tokens", "ids_crc32")


#: Fixed value: what separates words.
WORD = r"[^\x20\x09-\x0D]+"


def _with_loops(docs: DataFrame) -> DataFrame:
    """The documents of the contract: a tenth of them, by the checksum of the id, repeat some of their words to the end."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    split = docs.select("doc_id", "text", g.alias("g"), F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("w"))
    placed = split.withColumn("n", F.size("w")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    placed = placed.withColumn("p", F.expr("cast(1 + (n - a) div (3 + g % 8) as int)"))
    loop = F.expr("slice(flatten(array_repeat(slice(w, a + 1, p), cast(ceil((n - a) / p) as int))), 1, n - a)")
    looped = F.array_join(F.concat(F.expr("slice(w, 1, a)"), loop), " ")
    return placed.select("doc_id", F.when(F.col("a").isNotNull(), looped).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words of every document."""
    found = periodic.find_runs(_with_loops(read(spark, sf_dir, "documents").select("doc_id", "text")))
    found = found.withColumn("best", periodic.longest_run("runs"))
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")],
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


# crc32 bit by bit: 8 steps for each character of the decimal id
OP11_SQL = rf"""
WITH h AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w,
    xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(8 * len(CAST(doc_id AS VARCHAR))), lambda k: CASE WHEN k % 8 = 0 THEN ord(CAST(doc_id AS VARCHAR)[k // 8 + 1])::BIGINT ELSE 0 END)),
      lambda c, x: xor(xor(c, x) >> 1, 3988292384 * (xor(c, x) & 1)))) AS h
  FROM documents),
a AS (SELECT *, len(w) AS n, h // 10 AS g, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM h),
p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM a),
v AS (SELECT doc_id, n, CASE WHEN a IS NULL THEN w ELSE list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) END AS w FROM p),
e AS (SELECT doc_id, n, unnest(range(n)) AS i, unnest(w) AS word FROM v),
cells AS (SELECT x.doc_id, x.i, x.i - y.i AS q FROM e x JOIN e y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i < x.i AND 4 * (x.i - y.i) <= x.n),
islands AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM cells),
stretches AS (
  SELECT doc_id, q, min(i) - q AS start, count(*) + q AS length FROM islands GROUP BY doc_id, q, island HAVING count(*) + q >= greatest(6, 4 * q)),
runs AS (
  SELECT * FROM stretches s WHERE NOT EXISTS (
    FROM stretches t WHERE t.doc_id = s.doc_id AND t.q < s.q AND t.start <= s.start AND t.start + t.length >= s.start + s.length)),
per AS (
  SELECT doc_id, count(*) AS n_runs, arg_min(struct_pack(start := start, length := length, q := q), struct_pack(l := -length, s := start, q := q)) AS best,
    string_agg(start || ',' || length || ',' || q || chr(10), '' ORDER BY start, q) AS s FROM runs GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + q, start + length)) AS i FROM runs),
left_over AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS s FROM e ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, best.start AS start, best.length AS length, best.q AS period, 1000 * best.length // best.q AS exponent_milli,
       sha256(coalesce(per.s, '')) AS runs_sha256, sha256(coalesce(left_over.s, '')) AS collapsed_sha256
FROM documents d LEFT JOIN per USING (doc_id) LEFT JOIN left_over USING (doc_id)
"""


QUERIES = {
    "op1_packing": op1_packing,
    "op2_url_filter": op2_url_filter,
    "op3_archives": op3_archives,
    "op4_quality": op4_quality,
    "op5_toxicity": op5_toxicity,
    "op6_decontamination": op6_decontamination,
    "op7_near_duplicates": op7_near_duplicates,
    "op8_line_dedup": op8_line_dedup,
    "op9_secrets": op9_secrets,
    "op10_language_model": op10_language_model,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_alignment": op12_alignment,
    "op13_token_files": op13_token_files,
}
SQL: dict[str, str] = {"op4_quality": OP4_SQL, "op6_decontamination": OP6_SQL, "op8_line_dedup": OP8_SQL, "op11_periodic_runs": OP11_SQL}

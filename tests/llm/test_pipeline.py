"""The corpus pipeline on the given tables and on hard rows, each stage held against plain Python."""

from pyspark.sql import functions as F

import corpus_pipeline as p
from tests.conftest import SF
from tests.llm.test_operators import OPTIONS, brute_components, check_pieces, table, word_sets


def test_stages_keep_what_they_should(spark):
    from tokenizers import Tokenizer

    docs = table(spark, "documents").select(*p.COLUMNS)
    toxic = p.drop_toxic(spark, docs, SF)
    assert toxic.columns == p.COLUMNS and 0 < toxic.count() <= docs.count()
    deduped = p.drop_boilerplate(spark, toxic, SF)
    assert deduped.columns == p.COLUMNS and deduped.count() == toxic.count()
    assert deduped.where(F.length("text") != F.col("n_chars")).count() == 0
    rows = [tuple(r) for r in deduped.select("doc_id", "text").collect()]
    roots = brute_components(word_sets(rows, 5))
    single = p.drop_near_duplicates(spark, deduped, SF)
    assert single.columns == p.COLUMNS and sorted(r[0] for r in single.select("doc_id").collect()) == sorted(set(roots.values()))
    clean = p.drop_contaminated(spark, single, SF)
    assert clean.columns == p.COLUMNS and clean.count() <= single.count()
    tokenizer = Tokenizer.from_file(OPTIONS.tokenizer_path)
    check_pieces(p.pack_sequences(spark, clean, SF).collect(), [tuple(r) for r in clean.select("doc_id", "text").collect()], tokenizer)


def test_hard_rows_and_empty_tables(spark):
    rows = [(None, None, None, None, None), (1, None, "en", None, 0), (2, "", None, "s", 0), (3, "same id", "en", "s", 7), (3, "same id", "en", "s", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for given, kept in ((docs, [1, 2, 3]), (docs.limit(0), [])):
        out = given
        for name, stage in p.STAGES:
            out = stage(spark, out, SF)
            if name == "near_duplicates":
                assert sorted(r[0] for r in out.where("doc_id IS NOT NULL").select("doc_id").collect()) == kept
        assert sorted(r[0] for r in out.where("doc_id IS NOT NULL").select("doc_id").collect()) == kept

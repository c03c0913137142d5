import os

import pytest
from pyspark.sql import functions as F

from tablewright.functions.kinds import column_kinds, features_of, select_expected
from tablewright.functions.values import normalised, payload_number, portable
from tablewright.session import materialise, scratch_path, shared_dir
from tablewright.sources.csv import read_csv, read_text_csv
from tablewright.sources.sinks import write_csv
from tablewright.streaming.trend import read_event_stream, start_trend_sink


def put(tmp_path, text, name="t.csv"):
    p = tmp_path / name
    p.write_text(text, encoding="utf-8")
    return str(p)


def test_types_and_null_tokens(spark, tmp_path):
    df = read_csv(spark, put(tmp_path, 'i,f,b,s,gap,id,big\n1,1.5,True,x,1,1d,9223372036854775808\n-2,1e3,false,NULL,N/A,2f,1\n3,inf,TRUE,"a,""b""",7,3,2\n'))
    assert [f.dataType.simpleString() for f in df.schema.fields] == ["bigint", "double", "boolean", "string", "double", "string", "double"]
    rows = df.collect()
    assert rows[1]["s"] is None and rows[1]["gap"] is None and rows[2]["s"] == 'a,"b"' and rows[2]["f"] == float("inf")


def test_all_missing_column(spark, tmp_path):
    df = read_csv(spark, put(tmp_path, "a,b\n1,\n2,NaN\n"))
    assert df.schema["b"].dataType.simpleString() == "double" and df.where("b is null").count() == 2


@pytest.mark.parametrize(
    "text,name,message",
    [
        ("a,b\n1,2\n", "t.txt", "Only CSV"),
        ("", "t.csv", "empty"),
        ("a,b\n", "t.csv", "no data"),
        ("a,a\n1,2\n", "t.csv", "repeats"),
    ],
)
def test_rejected_files(spark, tmp_path, text, name, message):
    with pytest.raises(ValueError, match=message):
        read_csv(spark, put(tmp_path, text, name))


def test_ragged_rows_fail(spark, tmp_path):
    with pytest.raises(Exception):
        read_csv(spark, put(tmp_path, "a,b\n1,2,3\n")).collect()


def test_extension_is_case_insensitive_and_columns_are_pruned(spark, tmp_path):
    df = read_csv(spark, put(tmp_path, "a,b\n1,x\n2,y\n", "T.CSV"), columns=["b"])
    assert df.columns == ["b"] and df.count() == 2


def test_written_csv_comes_back(spark):
    df = spark.createDataFrame([(1, 'say "hi"', None), (2, "line\nbreak, comma", "")], "a int, t string, e string")
    path = scratch_path(spark, "test") + ".csv"
    write_csv(df, path)
    back = {r["a"]: (r["t"], r["e"]) for r in read_csv(spark, path, multiline=True).collect()}
    assert back == {1: ('say "hi"', None), 2: ("line\nbreak, comma", None)}


def test_payload_numbers(spark):
    df = spark.createDataFrame([(" 12 ",), ("-1.5e2",), ("",), ("  ",), ("12d",), ("abc",), (None,)], "t string")
    assert [r[0] for r in df.select(payload_number(F.col("t"))).collect()] == [12.0, -150.0, None, None, None, None, None]


def test_kinds_and_projections(spark):
    df = spark.createDataFrame([(1, "a", True)], "n int, s string, b boolean")
    assert [r["kind"] for r in column_kinds(df).orderBy("position").collect()] == ["numeric", "categorical", "categorical"]
    assert features_of(df, "s").columns == ["n", "b"] and select_expected(df, ["b", "n"]).columns == ["b", "n"]
    with pytest.raises(ValueError, match="x, y"):
        select_expected(df, ["n", "x", "y"])
    with pytest.raises(ValueError, match="does not exist"):
        features_of(df, "zzz")


def test_value_normalisation(spark):
    df = spark.sql("select double('NaN') x, timestamp_ntz'2024-01-02 03:04:05' t, date'2024-01-02' d")
    assert normalised(df).first()["x"] is None
    assert portable(df).first()[1:] == ("2024-01-02T03:04:05", "2024-01-02")


def test_checkpoints_go_to_the_shared_folder(spark):
    folder = shared_dir(spark)
    assert scratch_path(spark, "x").startswith(folder)
    assert materialise(spark.range(3)).count() == 3


def test_no_local_folder_on_a_cluster():
    class Fake:
        class conf:
            get = staticmethod(lambda *_: None)

        class sparkContext:
            master = "yarn"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Fake)
    Fake.sparkContext.master = "local[2]"
    assert "tablewright-" in shared_dir(Fake)


def test_trend_sink_holds_back_open_days(spark, tmp_path):
    """Append mode emits a day once the watermark has passed it; a second run picks up where the first ended."""
    src, out, cp = (str(tmp_path / n) for n in ("src", "out", "cp"))
    os.makedirs(src)
    rows = [("2024-01-01 10:00:00", 2), ("2024-01-01 12:00:00", 3), ("2024-01-05 00:30:00", 7)]
    schema = "created_at string, row_count bigint"
    make = lambda r: spark.createDataFrame(r, schema).withColumn("created_at", F.to_timestamp("created_at"))
    make(rows).coalesce(1).write.mode("append").parquet(src)
    log = lambda: read_event_stream(spark, src, "*.parquet", make(rows).schema)
    start_trend_sink(log(), out, cp).awaitTermination()
    got = {str(r["date"]): r["count"] for r in spark.read.schema("date date, count bigint").parquet(out).collect()}
    assert got == {"2024-01-01": 5}
    make([("2024-01-10 00:00:00", 1)]).coalesce(1).write.mode("append").parquet(src)
    start_trend_sink(log(), out, cp).awaitTermination()
    got = {str(r["date"]): r["count"] for r in spark.read.schema("date date, count bigint").parquet(out).collect()}
    assert got == {"2024-01-01": 5, "2024-01-05": 7}


def test_files_with_another_column_order_are_an_error(spark, tmp_path):
    for name, text in (("a.csv", "x,y\n1,2\n"), ("b.csv", "y,x\n30,3\n")):
        (tmp_path / name).write_text(text)
    both = [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")]
    with pytest.raises(Exception, match="(?i)header"):
        read_text_csv(spark, both).collect()
    assert read_text_csv(spark, both[1:]).select("x").first()["x"] == "3"

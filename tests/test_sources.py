"""Readers, writers and sampling."""

import json

import pytest

from prepflow.sources import tables


def test_read_csv_types_and_missing_tokens(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text(
        'i,x,b,s,quoted,empty\n1,1.5,True,a,"x, ""y""",\nNA,nan,False,N/A,None,NULL\n3,2e3,true,b,plain,\n'
    )
    df = tables.read_table(spark, str(path))
    assert [t for _, t in df.dtypes] == ["bigint", "double", "boolean", "string", "string", "string"]
    rows = [tuple(r) for r in df.collect()]
    assert rows == [
        (1, 1.5, True, "a", 'x, "y"', None),
        (None, None, False, None, None, None),
        (3, 2000.0, True, "b", "plain", None),
    ]
    typed = tables.read_csv(spark, str(path), "i int, x double, b boolean, s string")
    assert typed.columns == ["i", "x", "b", "s"] and typed.first()["i"] == 1


def test_csv_round_trip(spark, tmp_path):
    rows = [(1, "a,b", None), (2, 'say "hi"', 2.5), (3, None, -1.0)]
    df = spark.createDataFrame(rows, "k bigint, s string, x double")
    out = str(tmp_path / "t.csv")
    tables.write_csv(df, out)
    assert sorted(tuple(r) for r in tables.read_table(spark, out).collect()) == rows


def test_read_json_lines_and_array(spark, tmp_path):
    records = [{"a": 1, "b": "x"}, {"a": 2, "b": None}]
    lines, array = tmp_path / "l.json", tmp_path / "a.json"
    lines.write_text("\n".join(json.dumps(r) for r in records))
    array.write_text("\n" + json.dumps(records, indent=1))
    for path in (lines, array):
        got = sorted((r["a"], r["b"]) for r in tables.read_table(spark, str(path)).collect())
        assert got == [(1, "x"), (2, None)]


def test_unsupported_and_broken(spark, tmp_path):
    with pytest.raises(ValueError, match=r"Unsupported format: \.xlsx.*csv, json, parquet"):
        tables.read_table(spark, "/x/Book.XLSX")
    bad = tmp_path / "bad.parquet"
    bad.write_text("not parquet")
    with pytest.raises(ValueError, match="Failed to parse file"):
        tables.read_table(spark, str(bad))


def test_stage_choice():
    assert tables.current_stage("raw") == "raw"
    assert tables.current_stage("raw", "clean") == "clean"
    assert tables.current_stage("raw", "clean", "eng") == "eng"


@pytest.mark.parametrize("parts", [1, 9])
def test_sample_rows_same_everywhere(spark, parts):
    df = spark.range(5000).withColumnRenamed("id", "k").repartition(parts)
    got = {r["k"] for r in tables.sample_rows(df, ["k"], 40).collect()}
    import hashlib

    want = sorted(range(5000), key=lambda k: hashlib.md5(f"|{k}".encode()).hexdigest())[:40]
    assert got == set(want)


def test_sample_rows_takes_all_of_a_small_table(spark):
    assert tables.sample_rows(spark.range(7), ["id"], 40).count() == 7


def test_sample_values_of_sparse_column(spark):
    rows = [(k, None if k % 997 else "rare", float(k)) for k in range(4000)]
    df = spark.createDataFrame(rows, "k int, s string, x double")
    got = tables.sample_values(df, ["k"], ["s", "x"], 3).groupBy("column").count().collect()
    assert {r["column"]: r["count"] for r in got} == {"s": 3, "x": 3}

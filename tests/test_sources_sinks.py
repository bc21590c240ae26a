import json

import pytest
from pyspark.sql import functions as F

from oremill.sources import readers, sinks


def test_json_fails_on_bad_lines(spark, tmp_path):
    good = tmp_path / "good.json"
    good.write_text('{"user_id": "u", "business_id": "b", "stars": 4, "date": "2014-01-01", "text": "x", "other": 1}\n')
    assert readers.read_json(spark, str(good), readers.REVIEW).collect() == [("u", "b", 4.0, "2014-01-01", "x")]
    bad = tmp_path / "bad.json"
    bad.write_text("{not json\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        readers.read_json(spark, str(bad), readers.REVIEW).collect()


def test_csv_drops_every_header(spark, tmp_path):
    path = tmp_path / "p.csv"
    path.write_text("user_id,business_id\nu1,b1\nuser_id,business_id\nu2,b2\nu1,b1\n")
    assert sorted(readers.read_pairs_csv(spark, str(path)).collect()) == [("u1", "b1"), ("u1", "b1"), ("u2", "b2")]


def test_stopwords_and_profiles(spark, tmp_path):
    path = tmp_path / "s.txt"
    path.write_text("The \n a\nthe\n\n")
    assert sorted(r.word for r in readers.read_stopwords(spark, str(path)).collect()) == ["", "a", "the"]
    model = tmp_path / "m.json"
    model.write_text(json.dumps({"Business_profile": {"b": ["x", "y"]}, "User_Profile": {"u": ["x"]}}))
    business, user = readers.read_profiles(spark, str(model))
    assert sorted(business.collect()) == [("b", "x"), ("b", "y")] and user.collect() == [("u", "x")]


def test_sinks_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("b1", "b2", 0.5)], "b1 string, b2 string, sim double")
    sinks.write_json_lines(df, str(tmp_path / "j"))
    assert readers.read_json(spark, str(tmp_path / "j"), readers.ITEM_MODEL).collect() == df.collect()
    sinks.write_csv(df.select("b1", "b2"), str(tmp_path / "c"))
    assert spark.read.csv(str(tmp_path / "c"), header=True).collect() == [("b1", "b2")]
    businesses = spark.createDataFrame([("b1", "x", 0.5, 1), ("b1", "y", 0.25, 2)], "business_id string, word string, score double, rank int")
    users = spark.createDataFrame([("u1", "x", 1)], "user_id string, word string, rank int")
    sinks.write_profiles(businesses, users, str(tmp_path / "p"))
    one, two = readers.read_profiles(spark, str(tmp_path / "p"), "parquet")
    assert sorted(one.collect()) == [("b1", "x"), ("b1", "y")] and two.collect() == [("u1", "x")]
    with pytest.raises(ValueError):
        readers.read_profiles(spark, str(tmp_path / "p"), "csv")
    lines = sinks.betweenness_lines(spark.createDataFrame([("a", "b", 1.0), ("a", "c", 2.5)], "src string, dst string, value double"))
    assert [r.line for r in lines.collect()] == ["('a', 'c'), 2.5", "('a', 'b'), 1.0"]
    sinks.write_text(lines, str(tmp_path / "t"))
    assert spark.read.text(str(tmp_path / "t")).count() == 2


def test_json_document(spark):
    total = spark.createDataFrame([(3,)], "total long")
    tops = spark.createDataFrame([("u", 2)], "user_id string, n long")
    text = sinks.json_document({"A": total, "D": tops, "E": tops.select("user_id")}).first()[0]
    assert text == '{"A": 3, "D": [["u", 2]], "E": ["u"]}'
    rows = spark.createDataFrame([(i * 7 % 20, i) for i in range(20)], "n long, _i int").repartition(5)
    text = sinks.json_document({"z": rows, "a": rows.limit(0)}, {"z": [F.col("_i")]}).first()[0]
    assert text == '{"z": ' + str([i * 7 % 20 for i in range(20)]) + ', "a": []}'

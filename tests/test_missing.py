import pytest
from pyspark.sql import functions as F

from scoreloom.functions import missing as fm
from scoreloom.functions import text, values
from scoreloom.operators import missing


@pytest.fixture
def frame(spark):
    rows = [
        (1, "a", 1.0, 5, None),
        (2, "None", float("nan"), 5, None),
        (3, None, None, -1, None),
        (4, "", 2.0, 5, None),
        (5, "na", 3.0, 5, None),
        (6, "[]", 4.0, 5, None),
    ]
    return spark.createDataFrame(rows, "id long, s string, x double, k int, e string")


def test_forms_of_missing(frame):
    found = {r["column"]: (r["total_missing"], r["missing_fraction"]) for r in missing.missing_table(frame).collect()}
    assert found == {"e": (6, 1.0), "s": (3, 0.5), "x": (2, pytest.approx(1 / 3))}


def test_ingestion_turns_sentinels_into_null(frame):
    clean = fm.null_out(frame, skip=["id"]).orderBy("id").collect()
    assert [r["s"] for r in clean] == ["a", None, None, "", None, None]
    assert [r["x"] for r in clean] == [1.0, None, None, 2.0, 3.0, 4.0]
    assert [r["k"] for r in clean] == [5, 5, None, 5, 5, 5]


def test_drop_by_rate_uses_train_for_both(frame):
    model = missing.DropByMissingRate(0.5).fit(frame)
    assert model.dropped == ["e", "s"]
    assert model.transform(frame.drop("e")).columns == ["id", "x", "k"]


def test_constant_columns(spark):
    df = spark.createDataFrame([(1, "a", None, None), (1, "b", None, 2)], "c int, d string, n int, half int")
    assert missing.DropConstant().fit(df).dropped == ["c", "n"]


def test_replace_values_with_null_pattern(frame):
    out = frame.select(fm.replace_values(frame, "x", [None, 2.0], 0.0).alias("x"), "id").orderBy("id").collect()
    assert [r["x"] for r in out] == [1.0, 0.0, 0.0, 0.0, 3.0, 4.0]


def test_names_and_lists(spark):
    df = spark.createDataFrame(
        [("TP. Đà-Nẵng", "['a', 'b', 'a']"), ("Tuy Hòa", '["it\'s", \'x, y\']'), ("Huyện Mỹ", None), ("Ia", "[1, 2]"), ("Ỷ", "[]")],
        "name string, tags string",
    )
    out = df.select(
        text.normalize_name(F.col("name")).alias("n"),
        text.parse_list(F.col("tags")).alias("t"),
        text.element_count(text.parse_list(F.col("tags")), "a").alias("a"),
    ).collect()
    assert [r["n"] for r in out] == ["tpdanang", "tuihoa", "huienmi", "ia", "i"]
    assert [r["t"] for r in out] == [["a", "b", "a"], ["it's", "x, y"], [], ["1", "2"], []]
    assert [r["a"] for r in out] == [2, 0, 0, 0, 0]


def test_replacements_apply_in_order(spark):
    df = spark.createDataFrame([("abc",)], "s string")
    assert df.select(text.replace_all(F.col("s"), {"ab": "c", "cc": "d"})).first()[0] == "d"


@pytest.mark.parametrize("year", [1, 12, 13, 22])
def test_tenure_borders(spark, year):
    middle = int(365.25 * year) - 13
    days = [middle - 31, middle - 30, middle, middle + 30, middle + 31]
    df = spark.createDataFrame([(d,) for d in days], "d int")
    got = [r[0] for r in df.select(values.tenure_year(F.col("d"))).collect()]
    assert got == [-999, min(12, year), min(12, year), min(12, year), -999]


def test_tenure_special_values(spark):
    df = spark.createDataFrame([(0,), (-1,), (None,), (5,)], "d int")
    assert [r[0] for r in df.select(values.tenure_year(F.col("d"))).collect()] == [0, 0, None, -999]


def test_ordinal_default(spark):
    df = spark.createDataFrame([("I",), ("V",), ("VI",), (None,)], "g string")
    got = [r[0] for r in df.select(values.map_values(F.col("g"), values.ROMAN_GRADES, -1)).collect()]
    assert got == [1, 5, -1, -1]

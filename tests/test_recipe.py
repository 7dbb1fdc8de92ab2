import pytest
from pyspark.sql import functions as F

from scoreloom.plans import credit, jobs, recipe

BOOLEAN = [
    "1", "2", "12", "14", "15", "18", "19", "20", "23", "25", "26", "27", "28", "29", "30", "31", "32", "33", "34", "36", "37", "38", "46",
    "47", "48", "49",
]


def application_rows(n, test=False):
    """A frame in the competition's shape, every cell a text like in its CSV files."""
    names = ["id", "label", "province", "district", "maCv", "age_source1", "age_source2"]
    names += [f"FIELD_{i}" for i in range(1, 58)]
    rows = []
    for i in range(n):
        r = dict.fromkeys(names)
        r.update(id=i, label=(i * 7) % 3 % 2, province="Hà Nội" if i % 2 else None, district="Cầu-Giấy", maCv="Kỹ sư")
        r.update(age_source1=None if i % 4 == 0 else 30.0, age_source2=40.0)
        for c in BOOLEAN:
            r[f"FIELD_{c}"] = ["0", "1", "None"][(i + int(c)) % 3]
        for c in ("8", "9", "13", "39", "17", "24", "42", "43", "44"):
            r[f"FIELD_{c}"] = ["x", "y", "na", "None"][(i + int(c)) % 4]
        r["FIELD_10"] = ["GT", "None", "T1"][i % 3]
        r["FIELD_7"] = ["['GD','HC']", "[]", None, "['GD', 'GD']"][i % 4]
        r["FIELD_35"] = ["Zero", "Two", None][i % 3]
        r["FIELD_41"] = ["I", "V", None][i % 3]
        r["FIELD_12"] = ["0", "1", "77"][i % 3]
        r["FIELD_40"] = str(i % 8)
        for c in ("11", "45", "54", "55", "56", "57"):
            r[f"FIELD_{c}"] = ["1.5", "None", "2"][i % 3]
        r["FIELD_50"] = "3" if i % 10 == 0 else None
        if test:
            r["FIELD_13"] = "only here"
        rows.append(tuple(r[c] for c in names))
    schema = ", ".join(
        f"`{c}` " + ("long" if c == "id" else "int" if c == "label" else "double" if "age" in c else "string") for c in names
    )
    return rows, schema


@pytest.fixture(scope="module")
def pair(spark):
    train = spark.createDataFrame(*application_rows(120)).repartition(3)
    test = spark.createDataFrame(*application_rows(40, test=True)).drop("label")
    return train, test


def test_competition_table(pair, tmp_path):
    train, test = pair
    model = recipe.CleaningRecipe(credit.credit_spec(), test).fit(train)
    assert "50" in model.info["sparse"] and model.info["elements"]["7"] == ["GD", "HC"]
    clean, other = model.transform(train), model.transform(test)
    assert [c for c in clean.columns if c != "label"] == other.columns
    flags = [c for c in other.columns if c.endswith("_ismiss")]
    assert flags == [f for f in flags if f in model.info["indicators"]]
    rows = {r["id"]: r for r in clean.collect()}
    assert rows[0]["province"] == "unk_province"
    assert rows[1]["province"] == "hanoi" and rows[1]["district"] == "hanoi - caugiai"
    assert [rows[i]["7_count"] for i in range(4)] == [2, 0, 0, 2] and rows[3]["7_count_GD"] == 2
    assert [rows[i]["10"] for i in range(3)] == ["gt", "unk_10", "t1"]
    assert [rows[i]["35"] for i in range(3)] == [0, 2, -1]
    assert [rows[i]["12"] for i in range(3)] == [0, 1, None]
    assert [rows[i]["40"] for i in range(8)] == [None, 1, 2, 3, 4, None, 6, None]
    assert [rows[i]["11"] for i in range(3)] == [1.5, None, 2.0]
    assert [rows[i]["age"] for i in range(5)] == [40, 30, 30, 30, 40]
    assert rows[0]["9"] in ("x", "y", "unk_9") and {r["13"] for r in other.collect()} == {"unk_13"}
    means = train.agg(F.avg("label")).first()[0]
    assert sum(r["maCv_te"] for r in rows.values()) / len(rows) == pytest.approx(means)
    model.save(str(tmp_path / "r"))
    again = recipe.CleaningModel.load(str(tmp_path / "r")).transform(test)
    assert again.orderBy("id").collect() == other.orderBy("id").collect()


def test_folds(pair):
    names = ["id", "label", "province", "FIELD_9", "FIELD_11"]
    spec = recipe.CleaningSpec(
        rename_prefix="FIELD_", rename_count=57, names=["province"], unknown=["9"], mean_encoded=["9"], numbers=["11"]
    )
    pairs = jobs.clean_folds(pair[0].select(*names), spec, folds=2, iv_limit=0.0, max_bins=3)
    assert sum(dev.count() for _, dev in pairs) == 120 and len(pairs) == 2
    for train, dev in pairs:
        added = [c for c in dev.columns if c.endswith("_woe")]
        assert added and set(added) <= set(train.columns)
        filled = dev.select(*[F.count(f"`{c}`").alias(c) for c in added]).first()
        assert min(filled) == dev.count()


def test_extraction_model_survives_a_round_trip(spark, tmp_path):
    rows = [(i, float(i % 7) if i % 5 else None, "ab"[i % 2], int(i % 3 == 0)) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, x double, c string, label int")
    model = recipe.ExtractionRecipe(["x", "c"], iv_limit=0.0).fit(df)
    model.save(str(tmp_path / "model"))
    again = recipe.ExtractionModel.load(str(tmp_path / "model"))
    assert sorted(map(tuple, again.transform(df).collect()), key=str) == sorted(map(tuple, model.transform(df).collect()), key=str)

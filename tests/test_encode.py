import pandas as pd
import pytest
from pyspark.sql import functions as F

from scoreloom.operators import encode
from scoreloom.operators.split import hash_fold, stratified_fold

ROWS = [
    (i, ["b", "a", "b", None, "c", "a", "b"][i % 7] if i != 40 else "lonely", i % 3 == 0) for i in range(60)
]


@pytest.fixture(scope="module")
def train(spark):
    return spark.createDataFrame(ROWS, "id long, c string, y boolean").withColumn("y", F.col("y").cast("int"))


@pytest.fixture(scope="module")
def test(spark):
    return spark.createDataFrame([(100, "a"), (101, "new"), (102, None), (103, "lonely")], "id long, c string")


def test_out_of_fold_means_by_hand(train):
    model = encode.KFoldTargetEncoder(["c"], "y", "id").fit(train)
    got = {r["id"]: r["c"] for r in model.transform_train(train).collect()}
    frame = hash_fold(train, "id", 5, 10000).toPandas()
    for r in frame.itertuples():
        if r.c is None:
            assert got[r.id] is None
            continue
        same = frame[frame["c"] == r.c]
        rest = same[same["fold"] != r.fold]
        assert got[r.id] == pytest.approx((rest if len(rest) else same)["y"].mean())


def test_own_label_does_not_leak(train):
    model = encode.KFoldTargetEncoder(["c"], "y", "id").fit(train)
    flipped = train.withColumn("y", F.when(F.col("id") == 5, 1 - F.col("y")).otherwise(F.col("y")))
    other = encode.KFoldTargetEncoder(["c"], "y", "id").fit(flipped)
    before = model.transform_train(train).filter("id = 5").first()["c"]
    assert before == other.transform_train(flipped).filter("id = 5").first()["c"]


def test_other_frames_get_mean_of_encoded(train, test):
    model = encode.KFoldTargetEncoder(["c"], "y", "id").fit(train)
    coded = model.transform_train(train).withColumnRenamed("c", "e").join(train.select("id", "c"), "id").toPandas()
    got = {r["id"]: r["c"] for r in model.transform(test).collect()}
    assert got[100] == pytest.approx(coded[coded["c"] == "a"]["e"].mean())
    assert got[101] == pytest.approx(coded["e"].mean())
    assert got[102] is None


def test_labels_follow_first_appearance(train, test):
    model = encode.LabelEncoder(["c"], "id").fit(train)
    codes = {r["value"]: r["code"] for r in model.tables["codes"].collect()}
    assert codes == {"b": 0, "a": 1, "none": 2, "c": 3, "lonely": 4}
    assert [r["c_labeled"] for r in model.transform(test).orderBy("id").collect()] == [1, -1, 2, 4]


def test_one_hot_columns_and_vectors(train, test):
    wide = encode.OneHotEncoder(["c"], "id").fit(train).transform(test).orderBy("id").toPandas()
    names = [f"c_ohe_{v}" for v in ("a", "b", "c", "lonely", "none")]
    assert wide[names].to_numpy().tolist() == [[1, 0, 0, 0, 0], [0] * 5, [0, 0, 0, 0, 1], [0, 0, 0, 1, 0]]
    narrow = encode.OneHotEncoder(["c"], "id", output="vector").fit(train).transform(test).orderBy("id").collect()
    assert [r["c_ohe"].toArray().tolist() for r in narrow] == [
        [0, 1, 0, 0, 0], [0] * 5, [0, 0, 1, 0, 0], [0, 0, 0, 0, 1],
    ]


def test_frequencies(train, test):
    out = encode.FrequencyEncoder(["c"]).fit(train).transform(test).orderBy("id").collect()
    count = pd.Series([c if c else "none" for _, c, _ in ROWS]).value_counts()
    assert [r["c_freq"] for r in out] == pytest.approx([count["a"] / 60, 0, count["none"] / 60, 1 / 60])


def test_smoothed_means(train, test):
    y = pd.Series([float(y) for *_, y in ROWS])
    c = pd.Series([c if c else "none" for _, c, _ in ROWS])
    grouped = y.groupby(c)
    expected = (grouped.sum() + 5 * y.mean()) / (grouped.count() + 5)
    model = encode.MeanEncoder(["c"], "y", alpha=5, folds=3, id_col="id").fit(train)
    got = [r["c_mean"] for r in model.transform(test).orderBy("id").collect()]
    assert got == pytest.approx([expected["a"], y.mean(), expected["none"], expected["lonely"]])
    folded = stratified_fold(train, "id", "y", 3).toPandas().fillna({"c": "none"})
    coded = {r["id"]: r["c_mean"] for r in model.transform_train(train).collect()}
    for r in folded.itertuples():
        rest = folded[(folded["c"] == r.c) & (folded["fold"] != r.fold)]["y"]
        want = (rest.sum() + 5 * y.mean()) / (len(rest) + 5) if len(rest) else y.mean()
        assert coded[r.id] == pytest.approx(want)


def test_unseen(train, test):
    assert [r["c"] for r in encode.unseen_categories(train, test, "c").collect()] == ["new"]
    masked = encode.mask_unseen(train, test, "c", "unk_c").orderBy("id").collect()
    assert [r["c"] for r in masked] == ["a", "unk_c", None, "lonely"]


def test_saved_encoder(train, test, tmp_path):
    model = encode.MeanEncoder(["c"], "y").fit(train)
    model.save(str(tmp_path / "m"))
    again = encode.MeanModel.load(str(tmp_path / "m"))
    assert again.transform(test).orderBy("id").collect() == model.transform(test).orderBy("id").collect()

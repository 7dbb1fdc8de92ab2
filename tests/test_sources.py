import pytest
from pyspark.sql import types as T

from scoreloom.sources import sinks, tables

SCHEMA = T.StructType(
    [T.StructField("id", T.LongType()), T.StructField("x", T.DoubleType()), T.StructField("label", T.IntegerType())]
)


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame([(i, i / 2, i % 2) for i in range(250)], SCHEMA)


def test_csv_pair_round_trip(spark, frame, tmp_path):
    sinks.write_frame(frame, f"{tmp_path}/train.csv", "csv")
    sinks.write_frame(frame.drop("label"), f"{tmp_path}/test.csv", "csv")
    train, test = tables.read_pair(spark, f"{tmp_path}/train.csv", f"{tmp_path}/test.csv", SCHEMA)
    assert train.dtypes == frame.dtypes and test.columns == ["id", "x"]
    assert sorted(train.collect()) == sorted(frame.collect())
    dev, _ = tables.read_pair(spark, f"{tmp_path}/train.csv", f"{tmp_path}/test.csv", SCHEMA, dev_mode=True)
    assert [r["id"] for r in dev.orderBy("id").collect()] == list(range(100))


def test_fold_round_trip(spark, frame, tmp_path):
    for k in range(3):
        sinks.write_frame(frame.filter(frame["id"] % 3 == k), f"{tmp_path}/dev{k}")
    folded = tables.read_folds(spark, [f"{tmp_path}/dev{k}" for k in range(3)])
    assert tables.fold_part(folded, 1, dev=True).count() == 83
    assert tables.fold_part(folded, 1, dev=False).count() == 167
    sinks.write_frame(folded, f"{tmp_path}/all", by_fold=True)
    back = spark.read.parquet(f"{tmp_path}/all")
    assert sorted(back.select("id", "x", "label", "fold").collect()) == sorted(folded.collect())


def test_submission_check(spark, frame):
    sample = sinks.submission(frame, score="x")
    assert sinks.submission_check(sample, sample).count() == 0
    wrong = sample.filter("id <> 30003").unionByName(spark.createDataFrame([(7, 0.1)], sample.schema))
    found = {r["id"]: (r["submitted_rows"], r["sample_rows"]) for r in sinks.submission_check(wrong, sample).collect()}
    assert found == {30003: (0, 1), 7: (1, 0)}
    with pytest.raises(ValueError):
        sinks.submission_check(frame, sample)


def test_params_are_appended(spark, tmp_path):
    path = f"{tmp_path}/params"
    sinks.append_params(spark, path, "first", {"depth": 3, "loss": "log"}, 0.7)
    sinks.append_params(spark, path, "second", {"depth": 4}, 0.8)
    assert sorted(tuple(r) for r in spark.read.parquet(path).collect()) == [
        ("first", "depth", "3", 0.7), ("first", "loss", '"log"', 0.7), ("second", "depth", "4", 0.8),
    ]


def test_ids_must_be_unique(spark, frame):
    tables.check_unique(frame, "id")
    with pytest.raises(ValueError):
        tables.check_unique(frame.unionByName(frame.limit(1)), "id")


def test_repeated_params_add_nothing(spark, tmp_path):
    path = f"{tmp_path}/params"
    assert sinks.append_params(spark, path, "first", {"depth": 3}, 0.7)
    assert not sinks.append_params(spark, path, "first", {"depth": 5}, 0.9)
    assert [tuple(r) for r in spark.read.parquet(path).collect()] == [("first", "depth", "3", 0.7)]


def test_committed_runs(spark, frame, tmp_path):
    path = f"{tmp_path}/runs of a job"
    with pytest.raises(ValueError):
        sinks.read_committed(spark, path)
    assert sinks.commit_frame(frame, path, "one")
    assert not sinks.commit_frame(frame.filter("id < 9"), path, "one")
    assert sinks.commit_frame(frame.filter("id < 9"), path, "two", by=["label"])
    frame.write.parquet(f"{path}/data/left-by-a-failure")
    back = sinks.read_committed(spark, path)
    assert {r["run"]: r["count"] for r in back.groupBy("run").count().collect()} == {"one": 250, "two": 9}
    one = sinks.read_committed(spark, path, ["one"])
    assert sorted(one.select(frame.columns).collect()) == sorted(frame.collect())
    for bad in ("../x", "", "_a"):
        with pytest.raises(ValueError):
            sinks.commit_frame(frame, path, bad)
    with pytest.raises(ValueError):
        sinks.read_committed(spark, path, ["three"])
    assert sinks.commit_frame(frame.filter("id < 0"), path, "empty", by=["label"])
    assert sinks.read_committed(spark, path, ["empty"]).count() == 0


def test_a_late_attempt_leaves_nothing(spark, frame, tmp_path, monkeypatch):
    path = f"{tmp_path}/late"
    real, calls = sinks._files, []

    class Late:
        """A file system on which another attempt commits while this one writes."""

        def __init__(self, files):
            self.files = files

        def create(self, draft, overwrite):
            if not calls:
                calls.append(1)
                monkeypatch.setattr(sinks, "_files", real)
                assert sinks.commit_frame(frame.filter("id < 5"), path, "one")
            return self.files.create(draft, overwrite)

        def __getattr__(self, name):
            return getattr(self.files, name)

    def watched(session, where):
        files, to_path = real(session, where)
        return Late(files), to_path

    monkeypatch.setattr(sinks, "_files", watched)
    assert not sinks.commit_frame(frame, path, "one")
    assert sinks.read_committed(spark, path).count() == 5
    assert len(list((tmp_path / "late" / "data").iterdir())) == 1

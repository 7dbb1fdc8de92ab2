import numpy as np
import pytest
from pyspark.sql import functions as F

from scoreloom.operators import encode, ordering, split
from scoreloom.operators.lookup import attach, estimated_bytes, hot_keys


@pytest.fixture
def numbers(spark):
    rng = np.random.default_rng(3)
    a = np.round(rng.normal(size=3000), 2)
    a[:1000] = 0.25  # a third of the rows hold one value
    rows = [(i, float(x), float(i % 7) if i % 5 else None) for i, x in enumerate(a)]
    return spark.createDataFrame(rows, "id long, a double, b double").repartition(7)


@pytest.mark.parametrize("rows_per_bucket", [10, 10**9])
def test_quantiles_equal_numpy(numbers, monkeypatch, rows_per_bucket):
    monkeypatch.setattr(ordering, "ROWS_PER_BUCKET", rows_per_bucket)
    fractions = sorted({i / n for n in range(2, 21) for i in range(n + 1)})
    found, counts = ordering.exact_quantiles(numbers, {"a": fractions, "b": fractions})
    frame = numbers.toPandas()
    for c in "ab":
        values = frame[c].dropna().to_numpy()
        assert counts[c] == len(values)
        assert np.allclose([found[c][p] for p in fractions], np.quantile(values, fractions), atol=1e-12)


def test_large_buckets_are_narrowed(spark, monkeypatch):
    rng = np.random.default_rng(8)
    steep = np.round(rng.normal(size=4000) ** 9, 3)  # even cuts of a range leave most rows in one slice
    steep[::3] = 1.5
    df = spark.createDataFrame([(float(x), float(i)) for i, x in enumerate(steep)], "a double, b double").repartition(5)
    passes = []
    count = ordering._count_buckets

    def counted(frame, points):
        passes.append(sum(map(len, points.values())))
        return count(frame, points)

    monkeypatch.setattr(ordering, "ROWS_PER_BUCKET", 5)
    monkeypatch.setattr(ordering, "_count_buckets", counted)
    fractions = [i / 20 for i in range(21)]
    stats = ordering.column_stats(df, ["a", "b"], 4)
    found, _ = ordering.exact_quantiles(df, {"a": fractions, "b": fractions}, stats)
    assert 1 < len(passes) <= 1 + ordering.NARROW_PASSES
    for c, values in (("a", steep), ("b", np.arange(4000.0))):
        assert np.allclose([found[c][p] for p in fractions], np.quantile(values, fractions), rtol=1e-12)


def test_statistics_of_columns(numbers):
    stats = ordering.column_stats(numbers, ["a", "b"], 4)
    frame = numbers.toPandas()
    assert stats.rows == 3000 and stats.counts == {"a": 3000, "b": frame["b"].count()}
    assert (stats.low["a"], stats.high["b"]) == (frame["a"].min(), frame["b"].max())
    assert all(frame["a"].min() <= x <= frame["a"].max() for x in stats.sketch["a"])
    nothing = ordering.column_stats(numbers.filter("id < 0"), ["a"])
    assert nothing.rows == 0 and nothing.counts == {"a": 0} and nothing.points("a") == []


def test_near_quantiles(spark):
    df = spark.range(100_000).select(F.col("id").cast("double").alias("a"), F.lit(None).cast("double").alias("b")).repartition(6)
    found, counts = ordering.near_quantiles(df, ["a", "b"], [0.0, 0.25, 0.5, 1.0])
    assert counts == {"a": 100_000, "b": 0} and set(found["b"].values()) == {None}
    assert (found["a"][0.0], found["a"][1.0]) == (0.0, 99_999.0)
    assert all(abs(found["a"][p] - p * 1e5) < 500 for p in (0.25, 0.5))


def test_quantiles_of_an_empty_column(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, None)], "a double, b double")
    found, counts = ordering.exact_quantiles(df, {"a": [0.5], "b": [0.5]})
    assert found == {"a": {0.5: 1.5}, "b": {0.5: None}} and counts == {"a": 2, "b": 0}


@pytest.mark.parametrize("rows_per_bucket", [10, 10**9])
@pytest.mark.parametrize("descending", [False, True])
def test_running_totals(numbers, monkeypatch, rows_per_bucket, descending):
    monkeypatch.setattr(ordering, "ROWS_PER_BUCKET", rows_per_bucket)
    cells = numbers.withColumn("g", F.col("id") % 2).groupBy("g", "a").agg(F.count(F.lit(1)).alias("n"))
    points = ordering.column_stats(cells, ["a"]).points("a")
    out = ordering.running_totals(cells, "a", ["n"], points, by=["g"], descending=descending).toPandas()
    frame = cells.toPandas().sort_values(["g", "a"], ascending=[True, not descending])
    frame["cum_n"] = frame.groupby("g")["n"].cumsum()
    merged = out.merge(frame, on=["g", "a"], suffixes=("", "_x"))
    assert len(merged) == len(frame)
    assert (merged["cum_n"] == merged["cum_n_x"]).all()
    assert (merged["all_n"] == merged["g"].map(frame.groupby("g")["n"].sum())).all()


def test_row_numbers_follow_the_hash(numbers):
    out = ordering.shuffled_row_number(numbers.withColumn("g", F.col("id") % 3 == 0), "id", 5, by=["g"])
    frame = out.withColumn("h", ordering.row_hash("id", 5)).toPandas()
    for _, group in frame.groupby("g"):
        ordered = group.sort_values("h")
        assert list(ordered["rn"]) == list(range(1, len(group) + 1))


@pytest.mark.parametrize("limit", [0, 10**9])
def test_lookup_is_the_same_beyond_the_broadcast_limit(spark, limit):
    rows = [(i, "hot" if i % 3 == 0 else (None if i % 7 == 0 else f"k{i % 50}")) for i in range(2000)]
    df = spark.createDataFrame(rows, "id long, k string")
    table = (
        df.filter("id < 1500").groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("v"))
    ).filter("k is null or k <> 'k5'")
    assert estimated_bytes(table) > 0
    got = {r["id"]: r["v"] for r in attach(df, table, ["k"], "n", limit_bytes=limit).collect()}
    codes = {r["k"]: r["v"] for r in table.collect()}
    assert got == {i: codes.get(k) for i, k in rows}
    assert attach(df, table, ["k"], "n", limit_bytes=limit).columns == ["id", "k", "v"]


def test_hot_keys_are_found_and_spread(spark):
    rows = [(i, "gone" if i % 3 == 0 else (None if i % 3 == 1 else f"k{i}")) for i in range(30_000)]
    df = spark.createDataFrame(rows, "id long, k string").repartition(6)
    named = {r["h"]: r["k"] for r in df.select("k", F.xxhash64("k").alias("h")).distinct().collect()}
    assert {named[h] for h in hot_keys(df, ["k"])} == {"gone", None}
    assert hot_keys(df.filter("id < 0"), ["k"]) == []
    # The hottest key is not in the table at all; no weight says which keys are hot.
    table = df.filter("k is null or k <> 'gone'").groupBy("k").agg(F.max("id").alias("v"))
    joined = attach(df, table, ["k"], limit_bytes=0)
    codes = {r["k"]: r["v"] for r in table.collect()}
    assert {r["id"]: r["v"] for r in joined.collect()} == {i: codes.get(k) for i, k in rows}
    assert "_spread" in joined._jdf.queryExecution().optimizedPlan().toString()
    with pytest.raises(ValueError):
        attach(df.withColumn("k", F.col("id").cast("int")), df.select(F.col("id").alias("k")), ["k"], limit_bytes=0)


@pytest.mark.parametrize("kind", ["frequency", "label", "mean", "fold mean"])
def test_encoders_beyond_the_broadcast_limit(spark, monkeypatch, kind):
    rows = [
        (i, "hot" if i % 3 == 0 else (None if i % 7 == 0 else f"k{i % 400}"), f"m{i % 300}", i % 5 // 3) for i in range(3000)
    ]
    train = spark.createDataFrame(rows, "id long, c string, d string, y int").repartition(4)
    test = train.withColumn("c", F.when(F.col("id") % 2 == 0, "new and hot").otherwise(F.col("c")))
    made = {
        "frequency": lambda: encode.FrequencyEncoder(["c", "d"]),
        "label": lambda: encode.LabelEncoder(["c", "d"], "id"),
        "mean": lambda: encode.MeanEncoder(["c", "d"], "y", alpha=5, folds=3, id_col="id"),
        "fold mean": lambda: encode.KFoldTargetEncoder(["c", "d"], "y", "id"),
    }[kind]()
    monkeypatch.setattr(encode, "MAP_ENTRIES", 0)
    model = made.fit(train)

    def results():
        frames = [model.transform(test)]
        if hasattr(model, "transform_train"):
            frames.append(model.transform_train(train))
        return [sorted(map(tuple, f.collect()), key=lambda r: r[0]) for f in frames]

    wide = results()
    monkeypatch.setattr(encode, "BROADCAST_BYTES", 0)
    assert results() == wide


def test_samples_are_exact_and_do_not_move_rows(numbers):
    ranked = [r["id"] for r in numbers.withColumn("h", ordering.row_hash("id", 4)).orderBy("h", "id").collect()]
    for rows in (0, 1, 777, 3000, 5000):
        drawn = split.sample_rows(numbers, "id", rows, 4)
        assert sorted(r["id"] for r in drawn.collect()) == sorted(ranked[:rows])
        assert drawn.columns == numbers.columns
    one = numbers.coalesce(1).limit(1)
    assert "Window" not in split.sample_rows(numbers, "id", 10)._jdf.queryExecution().optimizedPlan().toString()
    assert split.sample_rows(one.filter("id < 0"), "id", 3).count() == 0

"""Results do not depend on how the input is stored."""

import pytest

from scoreloom.catalog.base import loans, rounded
from scoreloom.operators import closest, encode, impute, metrics, resample, split, woe

CASES = {
    "folds": lambda df: split.stratified_fold(df, "id", "label").select("id", "fold"),
    "sample": lambda df: split.sample_rows(df, "id", 50).select("id"),
    "target": lambda df: rounded(
        encode.KFoldTargetEncoder(["segment"], "label", "id").fit(df).transform_train(df).select("id", "segment"), "segment"
    ),
    "labels": lambda df: encode.LabelEncoder(["segment", "priority"], "id").fit(df).transform(df).select(
        "id", "segment_labeled", "priority_labeled"
    ),
    "woe": lambda df: rounded(
        woe.WoeBinner(["price", "segment"], "label").fit(df).transform(df).select("id", "price_woe", "segment_woe"),
        "price_woe", "segment_woe",
    ),
    "auc": lambda df: rounded(metrics.auc_gini(split.hash_fold(df, "id"), by=["fold"]), "auc", "gini"),
    "closest": lambda df: closest.closest_fit(df.select("id", "nation", "segment", "priority"), ["nation", "segment", "priority"], "id"),
    "hot deck": lambda df: impute.hot_deck_fill(df, df, ["price"], "id").select("id", "price"),
    "smote": lambda df: resample.smote(df.selectExpr("id", "int(id % 20 = 0) AS label", "amount", "funds"), ["amount", "funds"], "label", "id"),
}


@pytest.mark.parametrize("case", sorted(CASES))
def test_same_result(spark, sf_dir, case):
    df = loans(spark, sf_dir).persist()
    seen = [sorted(map(str, CASES[case](df.repartition(n)).collect())) for n in (1, 4, 17)]
    assert seen[0] == seen[1] == seen[2]
    df.unpersist()

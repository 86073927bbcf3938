"""Models on a small separable table."""

import pytest
from pyspark.sql import functions as F

from calllens.operators import ml
from calllens.session import scratch_dir


@pytest.fixture(scope="module")
def data(spark):
    n = F.col("id")
    x = (n % 30).cast("double")
    return spark.range(300).select(
        n.alias("call_id"), x.alias("a"), (F.hash(n) % 7).cast("double").alias("b"),
        F.when(x < 10, "Cold").when(x < 20, "Warm").otherwise("Hot").alias("lead_class"),
    ).persist()


@pytest.mark.parametrize("kind,options", [("random_forest", {"trees": 10}), ("gradient_boosting", {"rounds": 3})])
def test_train_and_predict(spark, data, kind, options):
    split = ml.stratified_split(data, "lead_class", "call_id")
    model = ml.train_lead_model(split.where("not is_test"), "lead_class", ["a", "b"], kind, **options)
    assert ml.class_names(model) == ["Cold", "Hot", "Warm"]
    pred = ml.predict(model, split.where("is_test"), "v7", keep=("lead_class",)).collect()
    assert len(pred) == 60
    for r in pred:
        assert sum(r.class_probabilities.values()) == pytest.approx(1.0)
        assert r.confidence == pytest.approx(max(r.class_probabilities.values())) and r.model_version == "v7"
        assert r.class_probabilities[r.classification] == pytest.approx(r.confidence)
    assert sum(r.classification == r.lead_class for r in pred) / 60 > 0.9
    weights = {r.feature: r.importance for r in ml.feature_importance(model, spark).collect()}
    assert sum(weights.values()) == pytest.approx(1.0) and weights["a"] > weights["b"]


def test_save_and_load(spark, data):
    model = ml.train_lead_model(data, "lead_class", ["a", "b"], trees=3)
    root = scratch_dir(spark, "model")
    ml.save_model(model, root, "v2", spark, {"accuracy": 1.0})
    loaded, meta = ml.load_model(root, "v2", spark)
    row = meta.first()
    assert (row.version, row.feature_names, row.classes) == ("v2", ["a", "b"], ["Cold", "Hot", "Warm"])
    a = ml.predict(model, data, keep=("call_id",)).orderBy("call_id").collect()
    assert a == ml.predict(loaded, data, keep=("call_id",)).orderBy("call_id").collect()


def test_metrics_identities(spark):
    pairs = spark.createDataFrame(
        [("Hot", "Hot")] * 6 + [("Hot", "Cold")] * 2 + [("Cold", "Cold")] * 3 + [("Warm", "Hot")], "label string, prediction string"
    )
    report = {r["class"]: r for r in ml.classification_report(ml.confusion(pairs)).collect()}
    assert report["Hot"].precision == pytest.approx(6 / 7) and report["Hot"].recall == 0.75
    assert (report["Warm"].precision, report["Warm"].recall, report["Warm"].f1_score) == (0.0, 0.0, 0.0)
    total = ml.evaluate(ml.confusion(pairs)).first()
    assert total.accuracy == pytest.approx(9 / 12) == pytest.approx(total.recall) and total.test_samples == 12


def test_metrics_agree_with_the_evaluator(spark, data):
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator as Evaluator

    pairs = data.select((F.col("a") % 3).alias("label"), (F.col("call_id") % 4 % 3).cast("double").alias("prediction"))
    ours = ml.evaluate(ml.confusion(pairs)).first()
    for name, metric in (("accuracy", "accuracy"), ("f1", "f1_score"), ("weightedPrecision", "precision")):
        assert Evaluator(metricName=name).evaluate(pairs) == pytest.approx(ours[metric])


def test_cross_validation(spark, data):
    rows = ml.cross_validate(data, "lead_class", "call_id", ["a", "b"], k=3, trees=3).collect()
    assert [r.fold for r in rows] == [0, 1, 2]
    assert rows[0].cv_mean == pytest.approx(sum(r.accuracy for r in rows) / 3)


def test_fits_and_folds_use_the_cores(spark, monkeypatch):
    parts = []

    def indexed(df, label, keep=ml.index_labels):
        parts.append(df.rdd.getNumPartitions())
        return keep(df, label)

    monkeypatch.setattr(ml, "index_labels", indexed)
    df = spark.range(24_000, numPartitions=1).selectExpr("id AS call_id", "cast(id % 10 as double) AS a", "if(id % 10 < 5, 'x', 'y') AS y")
    rows = ml.cross_validate(df, "y", "call_id", ["a"], k=2, trees=2).collect()
    assert parts == [2, 2] and [r.accuracy for r in rows] == [1.0, 1.0]


def test_unknown_model_type(data):
    with pytest.raises(ValueError):
        ml.train_lead_model(data, "lead_class", ["a"], "perceptron")


def test_text_classifier(spark):
    rows = [(i, ("great pricing talk" if i % 2 else "no thanks bye") + f" w{i}", "Hot" if i % 2 else "Cold") for i in range(40)]
    df = spark.createDataFrame(rows, "id int, text string, lead_class string")
    pred = ml.train_text_classifier(df, "text", "lead_class", buckets=1 << 10).transform(df)
    assert pred.where("predicted_class = lead_class").count() == 40

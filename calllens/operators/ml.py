"""Lead classification on feature tables with ``pyspark.ml``."""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import (
    IDF,
    HashingTF,
    IndexToString,
    RegexTokenizer,
    StandardScaler,
    StringIndexer,
    VectorAssembler,
)
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from calllens.operators.boosting import BoostedModel, fit_boosting, load_boosting, save_boosting
from calllens.operators.ordered import running_totals
from calllens.session import spread

TREES, DEPTH, MIN_SPLIT = 100, 10, 5
ROUNDS, RATE, BOOST_DEPTH = 100, 0.1, 5


def _shuffled_rank(df: DataFrame, label: str, key: str, seed: int) -> DataFrame:
    """Place of each row in a seeded order of its class, as ``_rank`` of ``_rank_all``.

    The order is the md5 of seed and key; its leading digits are the buckets, so
    even a class with most of the rows is ranked by thousands of tasks.
    """
    hashed = df.withColumn("_h", F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))))
    return running_totals(
        hashed, [label], [F.col("_h"), F.col(key)], F.substring("_h", 1, 3),
        {"_rank": F.lit(1).cast("bigint")},
    ).drop("_h")


def stratified_split(
    df: DataFrame, label: str, key: str, test: float = 0.2, seed: int = 42
) -> DataFrame:
    """Add ``is_test``: exactly ``ceil(test x n)`` rows of each class."""
    ranked = _shuffled_rank(df, label, key, seed)
    return ranked.select(
        *df.columns, (F.col("_rank") <= F.ceil(F.col("_rank_all") * F.lit(test))).alias("is_test")
    )


def fold_column(df: DataFrame, label: str, key: str, k: int, seed: int = 42) -> DataFrame:
    """Add ``fold`` in [0, k), each class spread evenly."""
    ranked = _shuffled_rank(df, label, key, seed)
    return ranked.select(*df.columns, (F.col("_rank") % k).cast("int").alias("fold"))


def assemble_scale(features) -> list:
    """Stages giving the standardised ``features`` vector.

    Divides by the sample deviation, where some libraries use the population one;
    tree models are unaffected.
    """
    return [
        VectorAssembler(inputCols=list(features), outputCol="_raw_features", handleInvalid="keep"),
        StandardScaler(inputCol="_raw_features", outputCol="features", withMean=True, withStd=True),
    ]


def index_labels(df: DataFrame, label: str):
    """Fitted indexer with classes in alphabetical order."""
    return StringIndexer(
        inputCol=label, outputCol="label", stringOrderType="alphabetAsc", handleInvalid="error"
    ).fit(df)


def _classifier(kind: str, seed: int, trees: int):
    if kind == "random_forest":
        # a node of fewer than MIN_SPLIT rows must not split; the nearest setting
        # here is the smallest child size, half of that
        return RandomForestClassifier(
            numTrees=trees, maxDepth=DEPTH, minInstancesPerNode=MIN_SPLIT // 2, seed=seed
        )
    raise ValueError(f"unknown model type: {kind!r}")


def train_lead_model(
    train: DataFrame,
    label: str,
    features,
    kind: str = "random_forest",
    seed: int = 42,
    trees: int = TREES,
    rounds: int = ROUNDS,
) -> PipelineModel | BoostedModel:
    """Fit scaler, label index and classifier as one pipeline model, or boosted trees,
    which need neither; both kinds predict, weigh features, save and load alike."""
    if kind == "gradient_boosting":
        return fit_boosting(train, label, features, rounds, RATE, BOOST_DEPTH)
    # every level of the trees is a pass
    data = spread(train.select(label, *features), train.count()).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        indexer = index_labels(data, label)
        decode = IndexToString(
            inputCol="prediction", outputCol="predicted_class", labels=list(indexer.labels)
        )
        stages = [*assemble_scale(features), indexer, _classifier(kind, seed, trees), decode]
        return Pipeline(stages=stages).fit(data)
    finally:
        data.unpersist()


def class_names(model: PipelineModel | BoostedModel) -> list[str]:
    if isinstance(model, BoostedModel):
        return list(model.classes)
    return list(next(s for s in model.stages if isinstance(s, IndexToString)).getLabels())


def predict(model: PipelineModel | BoostedModel, df: DataFrame, version: str = "v1", keep=()) -> DataFrame:
    """Class, confidence, class-to-probability map, weights of the features and model
    version of every row; a model without named features gives no weights."""
    if isinstance(model, BoostedModel):
        staged = model.transform(df).withColumn("_p", F.col("probability"))
    else:
        # the label index is for training only
        stages = [s for s in model.stages if not s.__class__.__name__.startswith("StringIndexer")]
        staged = PipelineModel(stages).transform(df).withColumn("_p", vector_to_array("probability"))
    names = F.array(*[F.lit(c) for c in class_names(model)])
    pairs = [x for name, weight in feature_weights(model) for x in (F.lit(name), F.lit(weight))]
    contributions = F.create_map(*pairs).cast("map<string,double>")
    return staged.select(
        *keep,
        F.col("predicted_class").alias("classification"),
        F.array_max("_p").alias("confidence"),
        F.map_from_arrays(names, F.col("_p")).alias("class_probabilities"),
        contributions.alias("feature_contributions"),
        F.lit(version).alias("model_version"),
    )


def confusion(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """``(label, prediction, n)``: at most classes squared rows."""
    return pred.groupBy(F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(
        F.count(F.lit(1)).alias("n")
    )


def classification_report(conf: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class, from the confusion counts."""
    both = conf.select(
        F.explode(
            F.array(
                F.struct(
                    F.col("label").alias("class"), F.col("n").alias("actual"), F.lit(0).cast("bigint").alias("predicted"),
                    F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0).alias("hit"),
                ),
                F.struct(
                    F.col("prediction").alias("class"), F.lit(0).cast("bigint").alias("actual"),
                    F.col("n").alias("predicted"), F.lit(0).cast("bigint").alias("hit"),
                ),
            )
        ).alias("_c")
    ).select("_c.*")
    sums = both.groupBy("class").agg(*[F.sum(c).alias(c) for c in ("actual", "predicted", "hit")])
    rates = sums.select(
        "class",
        F.coalesce(F.try_divide("hit", "predicted"), F.lit(0.0)).alias("precision"),
        F.coalesce(F.try_divide("hit", "actual"), F.lit(0.0)).alias("recall"),
        F.col("actual").alias("support"),
    )
    p, r = F.col("precision"), F.col("recall")
    return rates.withColumn("f1_score", F.coalesce(F.try_divide(p * r * 2, p + r), F.lit(0.0)))


def evaluate(conf: DataFrame) -> DataFrame:
    """One row: accuracy and support-weighted precision, recall and F1."""
    report = classification_report(conf)
    total = F.sum("support")
    return report.agg(
        F.try_divide(F.sum(F.col("recall") * F.col("support")), total).alias("accuracy"),
        *[
            F.try_divide(F.sum(F.col(m) * F.col("support")), total).alias(m)
            for m in ("precision", "recall", "f1_score")
        ],
        total.alias("test_samples"),
    )


def sample_predictions(pred: DataFrame, key: str, label: str, prediction: str, n: int = 10) -> DataFrame:
    """The first ``n`` rows by key, for a report."""
    return pred.orderBy(key).limit(n).select(
        key, F.col(label).alias("true_label"), F.col(prediction).alias("predicted_label")
    )


def cross_validate(
    df: DataFrame, label: str, key: str, features, kind: str = "random_forest", k: int = 5,
    seed: int = 42, trees: int = TREES, rounds: int = ROUNDS,
) -> DataFrame:
    """Accuracy per fold with mean and deviation.  One distributed fit per fold."""
    folded = fold_column(df.select(key, label, *features), label, key, k, seed).persist(
        StorageLevel.MEMORY_AND_DISK
    )
    try:
        scores = []
        for fold in range(k):
            model = train_lead_model(
                folded.where(F.col("fold") != fold), label, features, kind, seed, trees, rounds
            )
            held = predict(model, folded.where(F.col("fold") == fold), keep=(label,))
            hit = F.avg((F.col("classification") == F.col(label)).cast("double"))
            scores.append((fold, held.agg(hit).first()[0]))
    finally:
        folded.unpersist()
    table = df.sparkSession.createDataFrame(scores, "fold int, accuracy double")
    summary = table.agg(
        F.avg("accuracy").alias("cv_mean"), F.stddev_pop("accuracy").alias("cv_std")
    )
    return table.withColumns(
        {
            "cv_mean": summary.select("cv_mean").scalar(),
            "cv_std": summary.select("cv_std").scalar(),
        }
    )


def feature_weights(model: PipelineModel | BoostedModel) -> list[tuple[str, float]]:
    """Name and importance of each feature."""
    if isinstance(model, BoostedModel):
        return model.importances()
    assembler = next((s for s in model.stages if isinstance(s, VectorAssembler)), None)
    if assembler is None:
        return []
    weights = model.stages[-2].featureImportances.toArray()
    return [(n, float(w)) for n, w in zip(assembler.getInputCols(), weights)]


def feature_importance(model: PipelineModel | BoostedModel, spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(feature_weights(model), "feature string, importance double")


def train_text_classifier(
    df: DataFrame, text: str, label: str, buckets: int = 1 << 18, iterations: int = 20
) -> PipelineModel:
    """(text, label) examples: hashed term counts, inverse document frequency,
    logistic regression."""
    indexer = index_labels(df, label)
    return Pipeline(
        stages=[
            RegexTokenizer(inputCol=text, outputCol="_tok", pattern=r"[\p{L}\p{N}_']+", gaps=False),
            HashingTF(inputCol="_tok", outputCol="_tf", numFeatures=buckets),
            IDF(inputCol="_tf", outputCol="features"),
            indexer,
            LogisticRegression(maxIter=iterations, regParam=0.01),
            IndexToString(inputCol="prediction", outputCol="predicted_class", labels=list(indexer.labels)),
        ]
    ).fit(df)


def save_model(
    model: PipelineModel | BoostedModel, root: str, version: str, spark: SparkSession, metrics: dict | None = None
) -> None:
    """Write the model and one metadata row below ``root/version``."""
    base = f"{root.rstrip('/')}/{version}"
    if isinstance(model, BoostedModel):
        save_boosting(model, f"{base}/boosted", spark)
        names = model.features
    else:
        model.write().overwrite().save(f"{base}/model")
        assembler = next((s for s in model.stages if isinstance(s, VectorAssembler)), None)
        names = list(assembler.getInputCols()) if assembler else []
    row = (
        version,
        names,
        class_names(model),
        json.dumps(metrics or {}, sort_keys=True),
        datetime.now(timezone.utc),
    )
    spark.createDataFrame(
        [row],
        "version string, feature_names array<string>, classes array<string>, "
        "metrics string, saved_at timestamp",
    ).write.mode("overwrite").parquet(f"{base}/metadata")


def load_model(root: str, version: str, spark: SparkSession) -> tuple[PipelineModel | BoostedModel, DataFrame]:
    base = f"{root.rstrip('/')}/{version}"
    metadata = spark.read.parquet(f"{base}/metadata")
    try:
        return load_boosting(f"{base}/boosted", spark), metadata
    except AnalysisException:  # no such folder: a pipeline
        return PipelineModel.load(f"{base}/model"), metadata

"""Machine learning on feature tables."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from calllens.operators import ml
from calllens.operators.boosting import fit_boosting
from calllens.operators.conversation import text_features
from calllens.session import scratch_dir, stored
from calllens.sources import tables
from catalog.registry import query

INPUTS = ("total_word_count", "unique_word_count", "sentence_count", "avg_sentence_length",
          "exclamation_count", "positive_word_ratio", "question_word_ratio")


def training(spark, sf):
    """Labelled documents: linguistic features and a three-way class.  Stored, as splits, folds
    and fits pass over them several times and the texts need be read once only."""
    labels = tables.read_table(spark, sf, "labels").withColumnRenamed("doc_id", "call_id")
    calls = tables.transcripts(spark, sf).join(labels.select("call_id"), "call_id", "left_semi")
    features = text_features(calls, positive=("that", "with", "der"), question_words=("in", "la", "und"))
    named = labels.select(
        "call_id",
        F.when(F.col("toxic") == 1, "Cold").when(F.col("quality") == 1, "Hot").otherwise("Warm").alias("lead_class"),
    )
    rows = features.join(named, "call_id").select("call_id", "lead_class", *[F.col(c).cast("double").alias(c) for c in INPUTS])
    return stored(rows, "training")


CLASS_SQL = "CASE WHEN toxic = 1 THEN 'Cold' WHEN quality = 1 THEN 'Hot' ELSE 'Warm' END"


@query("assemble_scale", "event_id:long value_scaled:d6 k_scaled:d6", """WITH x AS (
  SELECT event_id, value, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events) --final
SELECT event_id, (value - avg(value) OVER ()) / stddev_samp(value) OVER () AS value_scaled,
  (k - avg(k) OVER ()) / stddev_samp(k) OVER () AS k_scaled FROM x""")
def _(spark, sf):
    events = tables.read_table(spark, sf, "events").select(
        "event_id", "value", F.get_json_object("props", "$.k").cast("double").alias("k")
    )
    scaled = Pipeline(stages=ml.assemble_scale(["value", "k"])).fit(events).transform(events)
    parts = vector_to_array("features")
    return scaled.select("event_id", parts[0].alias("value_scaled"), parts[1].alias("k_scaled"))


@query("index_labels", "event_id:long event_type:str label:long", """--final
SELECT event_id, event_type, dense_rank() OVER (ORDER BY event_type) - 1 AS label FROM events""")
def _(spark, sf):
    events = tables.read_table(spark, sf, "events").select("event_id", "event_type")
    return ml.index_labels(events, "event_type").transform(events)


@query("stratified_split", "event_id:long event_type:str is_test:bool", """WITH placed AS (
  SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY md5('42:' || CAST(event_id AS VARCHAR)), event_id) AS r,
    count(*) OVER (PARTITION BY event_type) AS n FROM events) --final
SELECT event_id, event_type, r <= ceil(n * 0.2::DOUBLE) AS is_test FROM placed""")
def _(spark, sf):
    events = tables.read_table(spark, sf, "events").select("event_id", "event_type")
    return ml.stratified_split(events, "event_type", "event_id")


@query("fold_column", "event_id:long fold:long", """WITH placed AS (
  SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY md5('42:' || CAST(event_id AS VARCHAR)), event_id) AS r FROM events) --final
SELECT event_id, r % 5 AS fold FROM placed""")
def _(spark, sf):
    events = tables.read_table(spark, sf, "events").select("event_id", "event_type")
    return ml.fold_column(events, "event_type", "event_id", 5)


# a fixed rule stands in for a model, so the metrics can be checked exactly
GUESS_SQL = f"""guess AS (SELECT {CLASS_SQL} AS label, doc_id,
  CASE WHEN n_chars > 4000 THEN 'Cold' WHEN lang = 'en' THEN 'Hot' ELSE 'Warm' END AS prediction FROM labels JOIN documents USING (doc_id)),
conf AS (SELECT label, prediction, count(*) AS n FROM guess GROUP BY label, prediction),
cls AS (SELECT DISTINCT label AS class FROM conf UNION SELECT DISTINCT prediction FROM conf),
report AS (SELECT class, coalesce((SELECT sum(n) FROM conf WHERE label = class), 0) AS support,
  coalesce((SELECT sum(n) FROM conf WHERE prediction = class), 0) AS predicted,
  coalesce((SELECT sum(n) FROM conf WHERE prediction = class AND label = class), 0) AS hit FROM cls),
rates AS (SELECT class, support, coalesce(hit / nullif(predicted, 0)::DOUBLE, 0) AS precision, coalesce(hit / nullif(support, 0)::DOUBLE, 0) AS recall FROM report),
scored AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1_score FROM rates)"""


def _guess(spark, sf):
    docs = tables.read_table(spark, sf, "documents").select("doc_id", "n_chars", "lang")
    labels = tables.read_table(spark, sf, "labels")
    return labels.join(docs, "doc_id").select(
        "doc_id",
        F.when(F.col("toxic") == 1, "Cold").when(F.col("quality") == 1, "Hot").otherwise("Warm").alias("label"),
        F.when(F.col("n_chars") > 4000, "Cold").when(F.col("lang") == "en", "Hot").otherwise("Warm").alias("prediction"),
    )


@query("confusion", "label:str prediction:str n:long", f"WITH {GUESS_SQL} --final\nSELECT * FROM conf")
def _(spark, sf):
    return ml.confusion(_guess(spark, sf))


@query("classification_report", "class:str precision:d6 recall:d6 f1_score:d6 support:long", f"WITH {GUESS_SQL} --final\nSELECT * FROM scored")
def _(spark, sf):
    return ml.classification_report(ml.confusion(_guess(spark, sf)))


@query("evaluate", "accuracy:d6 precision:d6 recall:d6 f1_score:d6 test_samples:long", f"""WITH {GUESS_SQL} --final
SELECT (SELECT sum(n) FROM conf WHERE label = prediction) / sum(support)::DOUBLE AS accuracy, sum(precision * support) / sum(support) AS precision,
  sum(recall * support) / sum(support) AS recall, sum(f1_score * support) / sum(support) AS f1_score, sum(support) AS test_samples FROM scored""")
def _(spark, sf):
    return ml.evaluate(ml.confusion(_guess(spark, sf)))


@query("sample_predictions", "doc_id:long true_label:str predicted_label:str", f"""WITH {GUESS_SQL} --final
SELECT doc_id, label AS true_label, prediction AS predicted_label FROM guess ORDER BY doc_id LIMIT 10""")
def _(spark, sf):
    return ml.sample_predictions(_guess(spark, sf), "doc_id", "label", "prediction")


PREDICTED = "call_id:long lead_class:str classification:str confidence:d6 model_version:str"


@query("random_forest", PREDICTED)
def _(spark, sf):
    split = ml.stratified_split(training(spark, sf), "lead_class", "call_id")
    model = ml.train_lead_model(split.where(~F.col("is_test")), "lead_class", INPUTS)
    return ml.predict(model, split.where("is_test"), keep=("call_id", "lead_class"))


@query("gradient_boosting", PREDICTED)
def _(spark, sf):
    split = ml.stratified_split(training(spark, sf), "lead_class", "call_id")
    model = ml.train_lead_model(split.where(~F.col("is_test")), "lead_class", INPUTS, "gradient_boosting")
    return ml.predict(model, split.where("is_test"), keep=("call_id", "lead_class"))


@query("cross_validate", "fold:long accuracy:d6 cv_mean:d6 cv_std:d6")
def _(spark, sf):
    return ml.cross_validate(training(spark, sf), "lead_class", "call_id", INPUTS)


@query("feature_importance", "feature:str importance:d6")
def _(spark, sf):
    model = ml.train_lead_model(training(spark, sf), "lead_class", INPUTS)
    return ml.feature_importance(model, spark)


@query("saved_model", PREDICTED)
def _(spark, sf):
    split = ml.stratified_split(training(spark, sf), "lead_class", "call_id")
    root = scratch_dir(spark, "models")
    ml.save_model(ml.train_lead_model(split.where(~F.col("is_test")), "lead_class", INPUTS), root, "v1", spark)
    model, metadata = ml.load_model(root, "v1", spark)
    version = metadata.select("version").first()[0]
    return ml.predict(model, split.where("is_test"), version, keep=("call_id", "lead_class"))


@query("text_classifier", "call_id:long lead_class:str predicted_class:str")
def _(spark, sf):
    labels = tables.read_table(spark, sf, "labels").select(
        F.col("doc_id").alias("call_id"), F.when(F.col("quality") == 1, "good").otherwise("poor").alias("lead_class")
    )
    examples = tables.transcripts(spark, sf).select("call_id", "text").join(labels, "call_id")
    split = ml.stratified_split(examples, "lead_class", "call_id")
    return ml.train_text_classifier(split.where(~F.col("is_test")), "text", "lead_class").transform(split.where("is_test"))


@query("embedding_classes", "vec_id:long class:str classification:str confidence:d6")
def _(spark, sf):
    vectors = tables.read_table(spark, sf, "embeddings")
    names = [f"e{i}" for i in range(64)]
    wide = vectors.select(
        "vec_id", F.col("label").cast("string").alias("class"),
        *[F.get("embedding", F.lit(i)).cast("double").alias(n) for i, n in enumerate(names)],
    )
    split = ml.stratified_split(wide, "class", "vec_id")
    model = ml.train_lead_model(split.where(~F.col("is_test")), "class", names)
    return ml.predict(model, split.where("is_test"), keep=("vec_id", "class"))


# what is exact about learned models: the rows held out, their classes, and sums of shares

HELD_SQL = f"""labelled AS (SELECT doc_id AS call_id, {CLASS_SQL} AS lead_class FROM labels WHERE doc_id IN (SELECT doc_id FROM documents)),
placed AS (SELECT *, row_number() OVER (PARTITION BY lead_class ORDER BY md5('42:' || CAST(call_id AS VARCHAR)), call_id) AS r,
  count(*) OVER (PARTITION BY lead_class) AS n FROM labelled),
held AS (SELECT call_id, lead_class FROM placed WHERE r <= ceil(n * 0.2::DOUBLE))"""
MODEL_SQL = f"""WITH {HELD_SQL} --final
SELECT call_id, lead_class, ['Cold', 'Hot', 'Warm'] AS classes, 1.0 AS total, TRUE AS known, TRUE AS best FROM held"""
MODEL = "call_id:long lead_class:str classes:list total:d6 known:bool best:bool"


def exact_parts(predicted):
    shares = F.map_values("class_probabilities")
    return predicted.select(
        "call_id", "lead_class", F.array_sort(F.map_keys("class_probabilities")).alias("classes"),
        F.aggregate(shares, F.lit(0.0), lambda a, x: a + x).alias("total"),
        F.map_contains_key("class_probabilities", F.col("classification")).alias("known"),
        (F.col("confidence") == F.array_max(shares)).alias("best"),
    )


@query("random_forest_rows", MODEL, MODEL_SQL)
def _(spark, sf):
    split = ml.stratified_split(training(spark, sf), "lead_class", "call_id")
    model = ml.train_lead_model(split.where(~F.col("is_test")), "lead_class", INPUTS, trees=10)
    return exact_parts(ml.predict(model, split.where("is_test"), keep=("call_id", "lead_class")))


@query("gradient_boosting_rows", MODEL, MODEL_SQL)
def _(spark, sf):
    split = ml.stratified_split(training(spark, sf), "lead_class", "call_id")
    model = ml.train_lead_model(split.where(~F.col("is_test")), "lead_class", INPUTS, "gradient_boosting", rounds=3)
    return exact_parts(ml.predict(model, split.where("is_test"), keep=("call_id", "lead_class")))


# two rounds of one split each, on a feature of two values: every step in SQL
def _round(before: str, after: str) -> str:
    """The scores after one more round: softmax, gradients, and a Newton step per value of the feature."""
    return f"""{before}_p AS (SELECT call_id, y, x, class, f, exp(f) / sum(exp(f)) OVER (PARTITION BY call_id) AS p FROM {before}),
{before}_r AS (SELECT *, CASE WHEN y = class THEN 1 ELSE 0 END - p AS r FROM {before}_p),
{before}_v AS (SELECT class, x, 0.5 * 2 / 3.0 * sum(r) / sum(abs(r) * (1 - abs(r))) AS v FROM {before}_r GROUP BY class, x),
{after} AS (SELECT call_id, y, r.x, r.class, f + v AS f FROM {before}_r AS r JOIN {before}_v AS v ON v.class = r.class AND v.x = r.x)"""


@query("boosted_rounds", "call_id:long cold:d6 hot:d6 warm:d6", f"""WITH rows_in AS (SELECT doc_id AS call_id, {CLASS_SQL} AS y, CASE WHEN n_chars > 1500 THEN 1 ELSE 0 END AS x FROM labels JOIN documents USING (doc_id)),
prior AS (SELECT y AS class, ln(count(*) / (SELECT count(*) FROM rows_in)::DOUBLE) AS f FROM rows_in GROUP BY y),
s0 AS (SELECT call_id, y, x, class, f FROM rows_in, prior),
{_round('s0', 's1')},
{_round('s1', 's2')},
told AS (SELECT call_id, class, exp(f) / sum(exp(f)) OVER (PARTITION BY call_id) AS p FROM s2) --final
SELECT call_id, max(p) FILTER (WHERE class = 'Cold') AS cold, max(p) FILTER (WHERE class = 'Hot') AS hot, max(p) FILTER (WHERE class = 'Warm') AS warm FROM told GROUP BY call_id""")
def _(spark, sf):
    docs = tables.read_table(spark, sf, "documents").select(F.col("doc_id").alias("call_id"), (F.col("n_chars") > 1500).cast("int").alias("x"))
    labels = tables.read_table(spark, sf, "labels").select(
        F.col("doc_id").alias("call_id"),
        F.when(F.col("toxic") == 1, "Cold").when(F.col("quality") == 1, "Hot").otherwise("Warm").alias("y"),
    )
    rows = labels.join(docs, "call_id")
    scored = fit_boosting(rows, "y", ["x"], rounds=2, rate=0.5, depth=1).transform(rows)
    return scored.select("call_id", *[F.get("probability", F.lit(i)).alias(c) for i, c in enumerate(("cold", "hot", "warm"))])


@query("saved_model_rows", "call_id:long lead_class:str same:bool", f"WITH {HELD_SQL} --final\nSELECT call_id, lead_class, TRUE AS same FROM held")
def _(spark, sf):
    split = ml.stratified_split(training(spark, sf), "lead_class", "call_id")
    root = scratch_dir(spark, "models")
    model = ml.train_lead_model(split.where(~F.col("is_test")), "lead_class", INPUTS, trees=10)
    ml.save_model(model, root, "v1", spark)
    held = split.where("is_test")
    before = ml.predict(model, held, keep=("call_id", "lead_class"))
    after = ml.predict(ml.load_model(root, "v1", spark)[0], held, keep=("call_id",))
    both = after.select("call_id", F.col("classification").alias("c"), F.col("confidence").alias("p"))
    same = (F.col("c") == F.col("classification")) & (F.abs(F.col("p") - F.col("confidence")) < 1e-12)
    return before.join(both, "call_id").withColumn("same", same)


@query("feature_importance_names", "features:list total:d6", f"--final\nSELECT [{', '.join(repr(c) for c in sorted(INPUTS))}] AS features, 1.0 AS total")
def _(spark, sf):
    model = ml.train_lead_model(training(spark, sf), "lead_class", INPUTS, trees=10)
    weights = ml.feature_importance(model, spark)
    return weights.agg(F.array_sort(F.collect_list("feature")).alias("features"), F.sum("importance").alias("total"))


@query("cross_validate_folds", "fold:long rows:long accurate:bool", f"""WITH labelled AS (SELECT doc_id AS call_id, {CLASS_SQL} AS lead_class FROM labels WHERE doc_id IN (SELECT doc_id FROM documents)),
placed AS (SELECT row_number() OVER (PARTITION BY lead_class ORDER BY md5('42:' || CAST(call_id AS VARCHAR)), call_id) % 3 AS fold FROM labelled) --final
SELECT fold, count(*) AS rows, TRUE AS accurate FROM placed GROUP BY fold""")
def _(spark, sf):
    data = training(spark, sf)
    rated = ml.cross_validate(data, "lead_class", "call_id", INPUTS, k=3, trees=5)
    sizes = ml.fold_column(data, "lead_class", "call_id", 3).groupBy("fold").agg(F.count(F.lit(1)).alias("rows"))
    inside = F.col("accuracy").between(0, 1) & (F.abs(F.col("cv_mean") - F.col("accuracy")) <= 1)
    return rated.join(sizes, "fold").withColumn("accurate", inside)


@query("text_classifier_rows", "call_id:long lead_class:str known:bool", """WITH labelled AS (SELECT doc_id AS call_id, CASE WHEN quality = 1 THEN 'good' ELSE 'poor' END AS lead_class FROM labels WHERE doc_id IN (SELECT doc_id FROM documents)),
placed AS (SELECT *, row_number() OVER (PARTITION BY lead_class ORDER BY md5('42:' || CAST(call_id AS VARCHAR)), call_id) AS r, count(*) OVER (PARTITION BY lead_class) AS n FROM labelled) --final
SELECT call_id, lead_class, TRUE AS known FROM placed WHERE r <= ceil(n * 0.2::DOUBLE)""")
def _(spark, sf):
    labels = tables.read_table(spark, sf, "labels").select(
        F.col("doc_id").alias("call_id"), F.when(F.col("quality") == 1, "good").otherwise("poor").alias("lead_class")
    )
    split = ml.stratified_split(tables.transcripts(spark, sf).select("call_id", "text").join(labels, "call_id"), "lead_class", "call_id")
    model = ml.train_text_classifier(split.where(~F.col("is_test")), "text", "lead_class")
    return model.transform(split.where("is_test")).withColumn("known", F.col("predicted_class").isin("good", "poor"))

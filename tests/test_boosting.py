"""Softmax boosting against a plain version that tries every split on every row."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from calllens.operators import boosting, ml


def plain(rows, classes, rounds, rate, depth):
    """``rows`` of (features, label); returns the scores of each row and the losses."""
    n, k = len(rows), len(classes)
    shares = [sum(y == c for _, y in rows) / n for c in classes]
    scores = [[math.log(s) for s in shares] for _ in rows]
    losses = []

    def leaf(members, r):
        g, h = sum(r[i] for i in members), sum(abs(r[i]) * (1 - abs(r[i])) for i in members)
        return rate * (k - 1) / k * g / h if h > 1e-150 else 0.0

    def grow(members, r, left):
        """Values of the members' leaves."""
        best = None
        if left:
            total = sum(r[i] for i in members)
            for j in range(len(rows[0][0])):
                for cut in sorted({rows[i][0][j] for i in members})[:-1]:
                    low = [i for i in members if rows[i][0][j] <= cut]
                    high = [i for i in members if rows[i][0][j] > cut]
                    gl, gh = sum(r[i] for i in low), sum(r[i] for i in high)
                    gain = gl * gl / len(low) + gh * gh / len(high) - total * total / len(members)
                    if gain > 1e-12 and (best is None or gain > best[0] + 1e-12):
                        best = gain, low, high
        if best is None:
            return dict.fromkeys(members, leaf(members, r))
        return grow(best[1], r, left - 1) | grow(best[2], r, left - 1)

    for _ in range(rounds):
        p = [[math.exp(s) / sum(map(math.exp, row)) for s in row] for row in scores]
        losses.append(-sum(math.log(p[i][classes.index(y)]) for i, (_, y) in enumerate(rows)) / n)
        for c, name in enumerate(classes):
            r = [(y == name) - p[i][c] for i, (_, y) in enumerate(rows)]
            for i, value in grow(list(range(n)), r, depth).items():
                scores[i][c] += value
    return scores, losses


def table(spark, rows):
    return spark.createDataFrame([(i, *x, y) for i, (x, y) in enumerate(rows)], "id int, a double, b double, y string")


def drawn(seed, n):
    draw = random.Random(seed)
    out = []
    for _ in range(n):
        a, b = draw.randrange(7), draw.randrange(5) / 2
        out.append(((float(a), b), draw.choices("xyz", weights=[1 + a, 1 + 4 * b, 3])[0]))
    return out


@pytest.mark.parametrize("depth", [1, 2, 3])
def test_equal_to_every_split(spark, depth):
    rows = drawn(depth, 60)
    model = boosting.fit_boosting(table(spark, rows), "y", ["a", "b"], 2, 0.3, depth, 200)
    scores, losses = plain(rows, ["x", "y", "z"], 2, 0.3, depth)
    got = model.scores(np.array([x for x, _ in rows]))
    assert got == pytest.approx(np.array(scores)) and model.losses == pytest.approx(losses)


def test_two_rounds_by_hand(spark):
    """Two values, two classes, half of each: one split tells them apart."""
    rows = [((0.0, 0.0), "n")] * 2 + [((1.0, 0.0), "y")] * 2
    model = boosting.fit_boosting(table(spark, rows), "y", ["a", "b"], 2, 1.0, 1, 4)
    # round 1: p = 1/2, gradients +-1/2, weights 1/4: a step of (1/2) (1 / 0.5) = 1
    # round 2: p = e / (e + 1/e), so gradients +-(1 - p) and weights (1 - p) p: a step of 1 / (2 p)
    p = math.e / (math.e + 1 / math.e)
    step = 1 + 0.5 / p
    base = math.log(0.5)
    assert model.scores(np.array([[0.0, 0.0], [1.0, 0.0]])) == pytest.approx(
        np.array([[base + step, base - step], [base - step, base + step]])
    )
    assert model.losses == pytest.approx([math.log(2), -math.log(p)])


def test_loss_falls_in_every_round_and_scores_are_stored_again(spark):
    model = boosting.fit_boosting(table(spark, drawn(5, 300)), "y", ["a", "b"], boosting.KEPT_ROUNDS + 3, 0.2, 3)
    assert all(x > y for x, y in zip(model.losses, model.losses[1:])) and len(model.losses) == boosting.KEPT_ROUNDS + 3
    # as stored scores and as trees alike
    rows = drawn(5, 300)
    p = boosting.softmax(model.scores(np.array([x for x, _ in rows])))
    after = -np.mean([math.log(p[i]["xyz".index(y)]) for i, (_, y) in enumerate(rows)])
    assert after < model.losses[-1]


def test_odd_rows(spark):
    rows = [(1, 1.0, None, "y"), (2, None, float("nan"), "x"), (3, 2.0, 0.0, None), (4, 1.0, None, "y"), (5, None, 5.0, "x")]
    df = spark.createDataFrame(rows, "id int, a double, b double, y string")
    model = boosting.fit_boosting(df, "y", ["a", "b"], 3, 0.5, 2)
    got = {r.id: (r.predicted_class, sum(r.probability)) for r in model.transform(df).collect()}
    assert {i: got[i][0] for i in (1, 2, 4, 5)} == {1: "y", 2: "x", 4: "y", 5: "x"}
    assert all(s == pytest.approx(1) for _, s in got.values())
    one = boosting.fit_boosting(df.where("y = 'x'"), "y", ["a"], 1)
    assert one.transform(df).select("predicted_class").distinct().collect()[0][0] == "x"
    with pytest.raises(ValueError):
        boosting.fit_boosting(df.limit(0), "y", ["a"])
    with pytest.raises(ValueError):
        boosting.fit_boosting(df, "y", ["a"], bins=1000)


def test_saved_and_loaded(spark, tmp_path):
    df = table(spark, drawn(7, 80))
    model = ml.train_lead_model(df, "y", ["a", "b"], "gradient_boosting", rounds=3)
    ml.save_model(model, str(tmp_path), "v2", spark, {"accuracy": 0.5})
    back, metadata = ml.load_model(str(tmp_path), "v2", spark)
    assert metadata.first().classes == ["x", "y", "z"] and back.losses == model.losses
    columns = ["id", "classification", "confidence", "class_probabilities", "feature_contributions"]
    assert sorted(map(str, ml.predict(model, df, keep=("id",)).select(*columns).collect())) == sorted(
        map(str, ml.predict(back, df, keep=("id",)).select(*columns).collect())
    )
    weights = {r.feature: r.importance for r in ml.feature_importance(model, spark).collect()}
    assert sum(weights.values()) == pytest.approx(1) and set(weights) == {"a", "b"}
    assert ml.predict(back, df, keep=("y",)).where(F.col("y") == F.col("classification")).count() > 40


def test_rows_of_one_partition_are_dealt_over_the_cores(spark, monkeypatch):
    dealt = {}

    def stored(df, purpose, keep=boosting.stored):
        dealt.setdefault(purpose, df.rdd.getNumPartitions())
        return keep(df, purpose)

    monkeypatch.setattr(boosting, "stored", stored)
    df = spark.range(20_000, numPartitions=1).selectExpr("cast(id % 10 as double) AS a", "if(id % 10 < 5, 'x', 'y') AS y")
    model = boosting.fit_boosting(df, "y", ["a"], rounds=1, depth=1)
    assert dealt == {"boosting-data": 1, "boosting-rows": 4}
    assert model.rounds[0][0].threshold[0] == 4.0


def test_rows_are_read_from_any_part_of_a_batch():
    x = np.arange(12, dtype="u1").reshape(-1, 2)
    f = np.arange(18, dtype="<f8").reshape(-1, 3)
    for kind in (pa.binary(), pa.large_binary()):
        held = {"y": pa.array(range(6), pa.int32()), "x": pa.array([r.tobytes() for r in x], kind), "f": pa.array([r.tobytes() for r in f], kind)}
        table = pa.RecordBatch.from_pydict(held)
        for part in (table, table.slice(2, 3), table.slice(0, 0)):
            got = boosting._rows(part, 2, 3)
            at = part.column("y").to_numpy()
            assert (got[0] == x[at]).all() and (got[1] == at).all() and (got[2] == f[at]).all()

import random

import numpy as np
import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from conftest import by_key, rows
from fixtures import customer, order, product, store
from storelens.operators import forest, learning, network
from storelens.operators.features import AGGREGATES, churn_dataset, customer_features, orders_in_window
from storelens.operators.metrics import binary_metrics, class_report, confusion_matrix, roc_points
from storelens.plans import churn
from storelens.sources import files, models

CUTOFF, START, END = "2026-05-31", "2026-06-01", "2026-08-31"


@pytest.fixture(scope="module")
def shop(spark):
    customers = [customer(i) for i in range(1, 8)]
    orders = [
        order(1, 1, 1, "2026-05-31", quantity=2, discount="0.50"),             # on the cutoff day
        order(2, 2, 1, "2026-05-01"), order(3, 2, 1, "2026-06-01"),            # first day of the window
        order(4, 3, 1, "2026-05-01"), order(5, 3, 1, "2026-08-31"),            # last day
        order(6, 4, 1, "2026-05-01"), order(7, 4, 1, "2026-09-01"),            # one day late
        order(8, 5, 1, "2026-04-01", returned=1, days=None),
        order(9, 5, 1, "2026-07-01", returned=1),                              # returned, but activity
        order(10, 6, 1, "2026-06-15"),                                         # no history
        order(11, 99, 1, "2026-05-01"),                                        # unknown customer
    ]
    return store(spark, customers, [product(1)], orders)


def test_churn_dataset(shop):
    data = by_key(churn_dataset(shop.orders, shop.customers, CUTOFF, START, END), "customer_id")
    assert {k: v["churn"] for k, v in data.items()} == {1: 1, 2: 0, 3: 0, 4: 1, 5: 0}
    assert data[1]["days_since_last_order"] == 0 and data[1]["total_spending"] == 100.0
    five = data[5]
    assert (five["total_spending"], five["avg_order_value"], five["return_rate"], five["avg_delivery_days"]) == (0.0, 100.0, 1.0, None)


def test_dataset_and_features_agree(shop):
    dataset = by_key(churn_dataset(shop.orders, shop.customers, CUTOFF, START, END), "customer_id")
    features = by_key(customer_features(shop.orders, shop.customers, CUTOFF), "customer_id")
    assert dataset.keys() == features.keys()
    for key, row in dataset.items():
        assert [row[c] for c in AGGREGATES] == [features[key][c] for c in AGGREGATES]


def test_later_orders_do_not_leak_into_features(spark, shop):
    later = shop.orders.unionByName(spark.createDataFrame(
        [order(50, 1, 1, "2026-06-01", quantity=99)], shop.orders.schema))
    before = rows(customer_features(shop.orders, shop.customers, CUTOFF).orderBy("customer_id"))
    assert rows(customer_features(later, shop.customers, CUTOFF).orderBy("customer_id")) == before


def test_window_counts(shop):
    assert dict(rows(orders_in_window(shop.orders, START, END))) == {2: 1, 3: 1, 5: 1, 6: 1}


def test_summaries(shop):
    data = churn_dataset(shop.orders, shop.customers, CUTOFF, START, END)
    assert sorted(rows(churn.class_balance(data))) == [(0, 3, 60.0), (1, 2, 40.0)]
    assert rows(churn.feature_nulls(data)) == [("avg_delivery_days", 1)]
    summary = by_key(churn.feature_summary(data), "feature")
    assert summary["total_spending"]["p50"] == 100.0 and summary["avg_delivery_days"]["count"] == 4
    assert summary["age"]["std"] == 0.0 and "customer_id" not in summary


def synthetic(spark, n=600):
    """Rows in the shape of the churn dataset whose label follows recency."""
    rng = random.Random(11)
    data = []
    for i in range(n):
        days = rng.randint(0, 200)
        p = 1 / (1 + np.exp(-(days - 90) / 25))
        data.append((i, rng.randint(1, 30), rng.uniform(0, 9e4), rng.uniform(100, 9e3), days, rng.random(),
                     None if i % 17 == 0 else rng.uniform(1, 9), None if i % 9 == 0 else rng.randint(18, 80),
                     rng.choice(["Gold", "Premium", "Silver", "Standard"]), int(rng.random() < p)))
    return spark.createDataFrame(data, "customer_id bigint, total_orders bigint, total_spending double, "
                                       "avg_order_value double, days_since_last_order int, return_rate double, "
                                       "avg_delivery_days double, age int, membership_type string, churn int")


@pytest.fixture(scope="module")
def study(spark):
    return churn.ChurnStudy(synthetic(spark))


def test_split_is_stratified_and_repeatable(spark, study):
    again = learning.stratified_split(synthetic(spark).repartition(7), "customer_id", "churn")
    assert sorted(rows(again.select("customer_id", "split"))) == sorted(rows(study.rows.select("customer_id", "split")))
    for label in (0, 1):
        sizes = study.rows.where(F.col("churn") == label).groupBy("split").count().collect()
        n = {r["split"]: r["count"] for r in sizes}
        assert n["train"] == (n["train"] + n["test"]) * 4 // 5


def test_folds_are_stratified(study):
    folds = learning.stratified_folds(study.train, "customer_id", "churn")
    for label in (0, 1):
        sizes = [r["count"] for r in folds.where(F.col("churn") == label).groupBy("fold").count().collect()]
        assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1


def prepared(frame, columns):
    """Median imputation, population scaling and one-hot columns in pandas."""
    x = frame[columns].astype(float)
    x = x.fillna(x.median())
    x = (x - x.mean()) / x.std(ddof=0).replace(0, 1)
    for tier in sorted(frame["membership_type"].unique()):
        x[tier] = (frame["membership_type"] == tier).astype(float)
    return x.to_numpy()


def test_logistic_model_minimises_the_penalised_sum_of_losses(study):
    frame = study.train.toPandas()
    x, y = prepared(frame, learning.NUMERIC_FEATURES), frame["churn"].to_numpy()
    design = np.column_stack([x, np.ones(len(x))])
    penalty = np.diag([1.0] * x.shape[1] + [0.0])
    w = np.zeros(design.shape[1])
    for _ in range(50):  # Newton steps on ½‖w‖² + sum of the logistic losses
        p = 1 / (1 + np.exp(-design @ w))
        gradient = design.T @ (p - y) + penalty @ w
        w -= np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]) + penalty + 1e-10 * np.eye(len(w)), gradient)
    last = study.model(churn.LOGISTIC).stages[-1]
    assert np.allclose(last.coefficients.toArray(), w[:-1], atol=1e-3)
    assert last.intercept == pytest.approx(w[-1], abs=1e-3)


def test_scorecard_gives_the_pipeline_probability(study):
    from storelens.operators.scoring import score
    model = study.model(churn.LOGISTIC)
    card = learning.scorecard_of(model)
    unseen = study.test.withColumn("membership_type", F.when(F.col("customer_id") % 7 == 0, "Unheard of")
                                   .otherwise(F.col("membership_type")))
    pipeline = dict(rows(learning.with_probability(model, unseen).select("customer_id", "score")))
    numbers = dict(rows(score(unseen, card).select("customer_id", "churn_probability")))
    assert pipeline.keys() == numbers.keys()
    assert all(numbers[k] == pytest.approx(v, abs=1e-12) for k, v in pipeline.items())


def test_reloaded_models_predict_the_same(spark, study, tmp_path):
    model = study.model(churn.LOGISTIC)
    models.save_pipeline(model, str(tmp_path / "churn"))
    before = rows(learning.with_probability(model, study.test).select("customer_id", "score").orderBy("customer_id"))
    again = models.load_pipeline(str(tmp_path / "churn"))
    assert rows(learning.with_probability(again, study.test).select("customer_id", "score").orderBy("customer_id")) == before
    card = learning.scorecard_of(again)
    assert card == learning.scorecard_of(model)
    from storelens.operators.scoring import score
    assert dict(rows(score(study.test, card).select("customer_id", "churn_probability"))) == pytest.approx(dict(before), abs=1e-12)
    models.save_scorecard(spark, card, str(tmp_path / "card"))
    assert models.load_scorecard(spark, str(tmp_path / "card")) == card


def test_metrics_and_comparison(spark, study, tmp_path):
    study.pipelines = dict(study.pipelines, **{churn.FOREST: lambda: learning.forest_pipeline(20)})
    table = by_key(study.comparison([churn.LOGISTIC, churn.FOREST, churn.NETWORK]), "model")
    assert table[churn.LOGISTIC]["roc_auc"] > 0.75
    assert table[churn.LOGISTIC]["model_size"] == 12
    assert table[churn.NETWORK]["model_size"] == 11 * 32 + 32 + 32 * 16 + 16 + 16 + 1 == 929
    assert table[churn.FOREST]["gap"] == table[churn.FOREST]["train_auc"] - table[churn.FOREST]["roc_auc"]
    row = study.cross_validation(churn.LOGISTIC).first()
    assert table[churn.LOGISTIC]["mean_auc"] == row.mean_auc and table[churn.NETWORK]["mean_auc"] is None
    forest = study.cross_validation(churn.FOREST).first()
    assert table[churn.FOREST]["mean_auc"] == forest.mean_auc and 0.6 < forest.mean_auc < 1
    assert 0.7 < row.mean_auc < 1 and 0 <= row.std_auc < 0.2
    weights = study.coefficients().collect()
    assert weights[-1].feature == "days_since_last_order" and len(weights) == 11
    meta = study.metadata(CUTOFF, START, END)
    files.write_metadata(meta, str(tmp_path / "meta"))
    read = files.read_metadata(spark, str(tmp_path / "meta")).first()
    assert read.membership_types == ["Gold", "Premium", "Silver", "Standard"]
    assert read.target_window == [START, END] and read.test_metrics.roc_auc == round(table[churn.LOGISTIC]["roc_auc"], 3)


def test_every_held_out_row_is_evaluated(spark):
    """A forest that may learn from few rows is still validated on whole folds, and its gap is that of what it has seen."""
    study = churn.ChurnStudy(synthetic(spark), forest_rows=60)
    study.pipelines = dict(study.pipelines, **{churn.FOREST: lambda: learning.forest_pipeline(5)})
    n = study.train.count()
    for name in (churn.FOREST, churn.LOGISTIC):
        areas = study.fold_areas(name).collect()
        assert [r.fold for r in areas] == [0, 1, 2, 3, 4] and sum(r.held_out_rows for r in areas) == n
        assert all(min(r.held_out_rows, 60) <= n / 5 + 2 for r in areas)
        for r in areas:
            assert r.fitted_rows < 110 if name == churn.FOREST else r.fitted_rows == n - r.held_out_rows
    folds = study._folds[5]
    fitted = study.pipelines[churn.LOGISTIC]().fit(folds.where("fold <> 2"))
    area = learning.evaluate("x", fitted, folds.where("fold = 2")).first().roc_auc
    assert study.fold_areas(churn.LOGISTIC).where("fold = 2").first().auc == pytest.approx(area, abs=1e-9)
    mean = study.cross_validation(churn.LOGISTIC).first()
    values = [r.auc for r in study.fold_areas(churn.LOGISTIC).collect()]
    assert mean.mean_auc == pytest.approx(np.mean(values)) and mean.std_auc == pytest.approx(np.std(values))
    row = study.comparison([churn.FOREST], []).first()
    seen = learning.evaluate("x", study.model(churn.FOREST), study._fitted_on(churn.FOREST)).first().roc_auc
    assert row.train_auc == seen and row.gap == seen - row.roc_auc and seen > 0.8


def test_a_fold_without_a_class_has_no_area(spark):
    df = synthetic(spark).limit(40).withColumn("fold", F.col("churn").cast("int"))
    areas = by_key(learning.fold_areas("x", learning.logistic_pipeline(), df, 3), "fold")
    assert areas[0]["auc"] is None and areas[2]["held_out_rows"] == 0 and areas[2]["auc"] is None
    assert learning.mean_area(spark.createDataFrame(
        [("x", 0, None), ("x", 1, 0.5), ("x", 2, 0.7)], "model string, fold int, auc double")).first().mean_auc == pytest.approx(0.6)


def test_split_takes_digests_in_order(spark):
    """The split by threshold is the split by position, whatever the size of a class."""
    data = [(k, label) for label, n in ((0, 1), (1, 4), (2, 5), (3, 333), (None, 10)) for k in range(n)]
    df = spark.createDataFrame(data, "k int, label int").withColumn("k", F.col("k") + 1000 * F.coalesce("label", F.lit(9)))
    found = learning.stratified_split(df, "k", "label").withColumn("d", learning.digest(F.col("k"), learning.SEED)).collect()
    for label in (0, 1, 2, 3, None):
        own = sorted((r for r in found if r.label == label), key=lambda r: r.d)
        assert [r.split for r in own] == ["train"] * (len(own) * 4 // 5) + ["test"] * (len(own) - len(own) * 4 // 5)
    assert "Exchange" not in learning.stratified_split(df, "k", "label")._jdf.queryExecution().executedPlan().toString()
    folds = learning.stratified_folds(df, "k", "label", 5).collect()
    for label, n in ((0, 1), (1, 4), (2, 5), (3, 333), (None, 10)):
        sizes = [sum(r.fold == f and r.label == label for r in folds) for f in range(5)]
        assert sum(sizes) == n and max(sizes) - min(sizes) <= 1


# -- network ---------------------------------------------------------------------------------------------------

def test_gradient_equals_finite_differences():
    rng = np.random.default_rng(3)
    layers = [5, 7, 4, 1]
    weights = network.initial(layers, 1) + rng.normal(0, 0.1, network.size_of(layers))
    x, y, mask = rng.normal(size=(40, 5)), (rng.random(40) < 0.4) * 1.0, network.kept_units(np.arange(40), 3, 7, 0.2, 9)
    gradient = network.loss_and_gradient(weights, layers, x, y, mask)[1]
    for k in range(len(weights)):
        step = np.zeros_like(weights)
        step[k] = 1e-6
        up, down = (network.loss_and_gradient(weights + s, layers, x, y, mask)[0] for s in (step, -step))
        assert gradient[k] == pytest.approx((up - down) / 2e-6, abs=1e-4)


def test_dropout_masks_come_from_keys():
    keys = np.random.default_rng(1).integers(-2**63, 2**63 - 1, 20_000)
    mask = network.kept_units(keys, 5, 8, 0.2, 42)
    assert set(np.unique(mask)) == {0.0, 1.25} and abs((mask == 0).mean() - 0.2) < 0.01
    assert (network.kept_units(keys[::-1], 5, 8, 0.2, 42)[::-1] == mask).all()
    other = network.kept_units(keys, 6, 8, 0.2, 42)
    assert abs(((mask == 0) & (other == 0)).mean() - 0.04) < 0.01
    assert abs(np.corrcoef(mask.T) - np.eye(8)).max() < 0.05


def curved(spark, n=2500):
    """A label that no linear model tells: inside or outside of a ring."""
    rng = random.Random(6)
    data = [(k, rng.uniform(-1, 1), rng.uniform(-1, 1)) for k in range(n)]
    return spark.createDataFrame([(k, int(0.25 < a * a + b * b < 0.7), a, b) for k, a, b in data], "id int, y int, a double, b double") \
        .select("id", "y", array_to_vector(F.array("a", "b")).alias("features")).repartition(3)


def test_network_learns_and_stops(spark, tmp_path):
    df = curved(spark).cache()
    plan = network.Training(rate=0.02, epochs=60, patience=4)
    model = network.ReluNetwork("y", "id", plan).fit(df)
    losses = model.getOrDefault(model.losses)
    best = int(np.argmin(losses))
    assert model.best_epoch == best + 1
    assert len(losses) == plan.epochs or len(losses) - best - 1 == plan.patience
    scored = model.transform(df).withColumn("score", F.col("probability")[1])
    assert binary_metrics(scored, "y").first().roc_auc > 0.9
    # The weights kept are those of the best epoch: the rows held out have its loss.
    held_out = network.ReluNetwork("y", "id", plan)._packed(df).where(f"batch = {network.VALIDATION}").collect()
    whole = [network.loss_and_gradient(model.weights, [2, 32, 16, 1], np.frombuffer(r.x).reshape(r.n, -1), np.frombuffer(r.y))[0]
             for r in held_out]
    assert sum(whole) / sum(r.n for r in held_out) == pytest.approx(losses[best], abs=1e-9)
    # However the rows are dealt out, the sums are the same but for the last digits.
    again = network.ReluNetwork("y", "id", network.Training(rate=0.02, epochs=3)).fit(df.repartition(7))
    once = network.ReluNetwork("y", "id", network.Training(rate=0.02, epochs=3)).fit(df.coalesce(1))
    assert np.allclose(again.weights, once.weights, atol=1e-6)
    model.write().overwrite().save(str(tmp_path / "net"))
    read = network.NetworkModel.load(str(tmp_path / "net"))
    assert rows(read.transform(df).select("id", "probability").orderBy("id")) == rows(
        model.transform(df).select("id", "probability").orderBy("id"))


def test_network_in_a_saved_pipeline(study, tmp_path):
    model = study.model(churn.NETWORK)
    models.save_pipeline(model, str(tmp_path / "net"))
    before = rows(learning.with_probability(model, study.test).select("customer_id", "score").orderBy("customer_id"))
    after = learning.with_probability(models.load_pipeline(str(tmp_path / "net")), study.test)
    assert rows(after.select("customer_id", "score").orderBy("customer_id")) == before
    assert study.metrics(churn.NETWORK).first().roc_auc > 0.7


def test_network_of_few_rows(spark):
    df = curved(spark, 3)
    model = network.ReluNetwork("y", "id", network.Training(epochs=2)).fit(df)
    assert len(model.getOrDefault(model.losses)) == 2 and model.transform(df).count() == 3


def test_forest_learns_from_a_bounded_draw(spark):
    study = churn.ChurnStudy(synthetic(spark), forest_rows=100)
    drawn = study._fitted_on(churn.FOREST)
    assert 60 < drawn.count() < 140 and study._fitted_on(churn.LOGISTIC).count() == study.train.count()
    assert sorted(rows(drawn)) == sorted(rows(study._fitted_on(churn.FOREST)))


def scores(spark, pairs):
    return spark.createDataFrame([(l, float(s)) for l, s in pairs], "label int, score double")


@pytest.mark.parametrize("pairs, area", [
    ([(0, .1), (0, .2), (1, .8), (1, .9)], 1.0), ([(1, .1), (0, .9)], 0.0), ([(0, .5), (1, .5), (1, .5)], 0.5),
    ([(0, .4), (1, .4), (0, .2), (1, .7)], 0.875), ([(1, .4), (1, .9)], None)])
def test_area_under_curve(spark, pairs, area):
    assert binary_metrics(scores(spark, pairs)).first().roc_auc == area


def test_area_equals_the_evaluator(spark):
    rng = random.Random(2)
    pairs = [(rng.randint(0, 1), round(rng.random(), 2)) for _ in range(500)]
    df = scores(spark, pairs).withColumn("raw", array_to_vector(F.array(1 - F.col("score"), F.col("score"))))
    expected = BinaryClassificationEvaluator(rawPredictionCol="raw", numBins=0).evaluate(df)
    assert binary_metrics(df).first().roc_auc == pytest.approx(expected, abs=1e-12)


def test_threshold_metrics(spark):
    row = binary_metrics(scores(spark, [(1, .5), (1, .4), (0, .6), (0, .1), (1, .9)])).first()
    assert row.accuracy == pytest.approx(3 / 5) and row.precision == pytest.approx(2 / 3)
    assert row.recall == pytest.approx(2 / 3) and row.f1 == pytest.approx(2 / 3)


def test_nothing_predicted_positive(spark):
    row = binary_metrics(scores(spark, [(1, .1), (0, .2)])).first()
    assert (row.precision, row.recall, row.f1) == (0.0, 0.0, 0.0)


def test_roc_points(spark):
    points = sorted(rows(roc_points(scores(spark, [(0, .4), (1, .4), (0, .2), (1, .7)]))), key=lambda r: (r[0], r[1]))
    assert points == [(0.0, 0.0, None), (0.0, 0.5, 0.7), (0.5, 1.0, 0.4), (1.0, 1.0, 0.2)]


def test_class_report(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "a")], "label string, pred string")
    report = by_key(class_report(df, ["a", "b", "c"]), "class")
    assert report["a"]["precision"] == 0.5 and report["a"]["recall"] == 0.5 and report["a"]["support"] == 2
    assert report["c"]["f1"] == 0.0
    macro = report["macro avg"]
    assert macro["f1"] == pytest.approx((0.5 + 2 / 3 + 0) / 3) and macro["accuracy"] == 0.5
    assert sorted(rows(confusion_matrix(df))) == [("a", "a", 1), ("a", "b", 1), ("b", "b", 1), ("c", "a", 1)]


def test_newest_order_as_cutoff(shop):
    from storelens.operators.features import latest_features
    found = by_key(latest_features(shop.orders, shop.customers), "customer_id")
    same = by_key(customer_features(shop.orders, shop.customers, "2026-09-01"), "customer_id")
    assert found == same and found[4]["days_since_last_order"] == 0 and found[6]["days_since_last_order"] == 78


# -- forest ----------------------------------------------------------------------------------------------------

def bins_by_hand(values, bins):
    """Bounds halfway between neighbours, nearest to equal numbers of rows."""
    v = np.sort(values)
    distinct = np.unique(v)
    if len(distinct) <= bins:
        return [float((a + b) / 2) for a, b in zip(distinct, distinct[1:])]
    ends = np.searchsorted(v, distinct, "right")[:-1]
    found = set()
    for k in range(1, bins):
        away = np.abs(ends - k * len(v) / bins)
        # Of two that are equally near, the upper one.
        at = len(away) - 1 - int(np.argmin(away[::-1]))
        found.add(float((distinct[at] + distinct[at + 1]) / 2))
    return sorted(found)


def test_bins_come_from_all_values(spark):
    rng = np.random.default_rng(5)
    columns = [rng.normal(size=700), rng.integers(0, 9, 700) * 1.0, np.where(rng.random(700) < 0.6, 0.0, rng.random(700)), np.ones(700)]
    df = spark.createDataFrame([(list(map(float, r)),) for r in zip(*columns)], "x array<double>") \
        .repartition(5).select(array_to_vector("x").alias("features"))
    assert forest.cuts(df, 32) == [pytest.approx(bins_by_hand(c, 32)) for c in columns]


def split_by_hand(x, y, weight, leaf):
    """The bin after which a split leaves the smallest sum of impurities, and its gain."""
    def impurity(own):
        n, pos = weight[own].sum(), (weight * y)[own].sum()
        return 2 * pos * (n - pos) / n if n else 0.0
    best = (1e-6, None)
    for b in range(31):
        low = x <= b
        if min(weight[low].sum(), weight[~low].sum()) >= leaf:
            best = max(best, (impurity(x >= 0) - impurity(low) - impurity(~low), -b))
    return best[1]


@pytest.mark.parametrize("leaf", [1, 5, 40])
def test_a_tree_takes_the_best_splits(leaf, monkeypatch):
    monkeypatch.setattr(forest, "AT_ONCE", 3)
    rng = np.random.default_rng(leaf)
    x = rng.integers(0, 32, (500, 1)).astype(np.uint8)
    y = (rng.random(500) < np.where((x[:, 0] // 5) % 2 == 0, 0.9, 0.2)).astype(np.uint8)
    plan = forest.Growth(leaf=leaf, depth=6, seed=3)
    weight = np.random.default_rng([3, 8]).poisson(1.0, 500)

    def predicted(own, depth):
        """Chances by row of the tree by hand, siblings of one prediction joined: (chances, is a leaf, positive)."""
        n, pos = weight[own].sum(), (weight * y)[own].sum()
        b = split_by_hand(x[own, 0].astype(int), y[own], weight[own], leaf) if depth < 6 else None
        leaf_of = {int(k): pos / n for k in own}
        if b is None:
            return leaf_of, True, pos / n > 0.5
        parts = [predicted(own[side], depth + 1) for side in (x[own, 0] <= -b, x[own, 0] > -b)]
        if all(p[1] for p in parts) and parts[0][2] == parts[1][2]:
            return leaf_of, True, pos / n > 0.5
        return parts[0][0] | parts[1][0], False, None

    wanted = predicted(np.arange(500), 0)[0]
    found = forest.chances(forest.grow(x, y, 8, plan), x)
    assert found == pytest.approx([wanted[k] for k in range(500)])


def test_forest_does_as_sparks(spark, tmp_path):
    """Its size, its area and what it has learned by heart are those of Spark's, and it does not depend on partitions."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    data = synthetic(spark, 1500)
    train, test = data.where("customer_id % 4 > 0"), data.where("customer_id % 4 = 0")
    stages = learning.forest_pipeline(40).getStages()
    own = Pipeline(stages=stages).fit(train)
    theirs = Pipeline(stages=stages[:-1] + [RandomForestClassifier(
        labelCol="churn", numTrees=40, minInstancesPerNode=5, maxDepth=30, seed=1)]).fit(train)
    assert learning.model_size(own) == pytest.approx(learning.model_size(theirs), rel=0.1)
    for part in (train, test):
        a, b = (learning.evaluate("x", m, part).first().roc_auc for m in (own, theirs))
        assert a == pytest.approx(b, abs=0.03)
    before = dict(rows(learning.with_probability(own, test).select("customer_id", "score")))
    again = Pipeline(stages=stages).fit(train.repartition(7))
    assert dict(rows(learning.with_probability(again, test.repartition(3)).select("customer_id", "score"))) == before
    models.save_pipeline(own, str(tmp_path / "forest"))
    read = models.load_pipeline(str(tmp_path / "forest"))
    assert dict(rows(learning.with_probability(read, test).select("customer_id", "score"))) == before
    assert learning.model_size(read) == learning.model_size(own)


def test_trees_stay_in_a_table(spark):
    """The driver has bounds and a table, one row per tree."""
    model = learning.forest_pipeline(7).fit(synthetic(spark, 200)).stages[-1]
    assert model.trees.count() == 7 and not hasattr(model, "_java_obj") and "Scan" in model.trees._jdf.queryExecution().toString()


def test_nothing_is_drawn_unless_asked_for(spark, monkeypatch):
    def refuse(*_):
        raise AssertionError("rows were drawn")
    monkeypatch.setattr(churn, "drawn", refuse)
    monkeypatch.setattr(learning, "drawn", refuse)
    study = churn.ChurnStudy(synthetic(spark))
    study.pipelines = dict(study.pipelines, **{churn.FOREST: lambda: learning.forest_pipeline(3)})
    assert study.comparison([churn.FOREST]).first().mean_auc > 0.5
    n = study.train.count()
    assert all(r.fitted_rows == n - r.held_out_rows for r in study.fold_areas(churn.FOREST).collect())

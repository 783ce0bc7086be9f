import tempfile

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from patronlens.functions import lineage
from patronlens.operators import clv, profiles
from patronlens.plans import clv_queries, inputs

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def people(spark):
    return inputs.shop_profiles(spark, FOLDER), inputs.shop_affinity(spark, FOLDER)


def test_forest_predicts_and_survives_a_reload(spark, people):
    config = clv.TrainingConfig("random_forest", params={"numTrees": 5, "maxDepth": 4}, groups=("engagement", "temporal"))
    predictor, found = clv.train(*people, config)
    m = found.first()
    assert m["rmse"] >= m["mae"] >= 0 and sum(w for _, w in predictor.weights) == pytest.approx(1.0)
    path = tempfile.mkdtemp(prefix="spark-")
    predictor.save(path)
    first = predictor.predict(*people).orderBy("customer_id").collect()
    assert first == clv.Predictor.load(path).predict(*people).orderBy("customer_id").collect()
    assert all(r["predicted_clv"] >= 0 and 0 <= r["confidence"] <= 1 and len(r["top_features"]) == 5 for r in first)


def _tree_column(tree):
    """A fitted regression tree as a nested condition over the feature columns of the vector."""
    values = vector_to_array("features")

    def walk(node):
        if node.subtreeDepth() == 0:
            return F.lit(float(node.prediction()))
        split = node.split()
        return F.when(values[split.featureIndex()] <= F.lit(float(split.threshold())), walk(node.leftChild())).otherwise(walk(node.rightChild()))

    return walk(tree._call_java("rootNode"))


def test_leaf_table_holds_the_predictions_of_the_trees(spark, people):
    config = clv.TrainingConfig("random_forest", params={"numTrees": 4, "maxDepth": 10})
    predictor, _ = clv.train(*people, config)
    rows = clv.as_vectors(clv.build_features(*people, predictor.names), predictor.names)
    trees = predictor.model.trees
    leaves = predictor.model.transform(rows, {predictor.model.leafCol: "leaves"}).select("customer_id", "leaves", *[_tree_column(t).alias(f"t{i}") for i, t in enumerate(trees)]).limit(200).collect()
    held = {(r.tree, r.leaf): r.guess for r in clv.leaf_table(predictor.model).collect()}
    assert leaves and all(held[i, int(r["leaves"][i])] == r[f"t{i}"] for r in leaves for i in range(4))
    sure = {r.customer_id: r.confidence for r in predictor.predict(*people).collect()}
    for r in leaves:
        guesses = np.array([r[f"t{i}"] for i in range(4)])
        want = 0.5 if guesses.mean() == 0 else min(1.0, max(0.0, 1 - guesses.std() / abs(guesses.mean())))
        assert sure[r.customer_id] == pytest.approx(want, abs=1e-3)


def test_ridge_folds_equal_a_fit_of_each_fold(spark, people):
    config = clv.TrainingConfig("ridge", groups=("engagement", "temporal", "behavior"))
    table = clv.training_table(*people, config)
    folds = clv.time_folds(table, 5)
    rows = folds.select("target", "fold", vector_to_array("features").alias("x")).collect()
    for test, (beta, intercept) in enumerate(clv.ridge_folds(folds, 5, 2.0), 1):
        x, y = (np.array([v for v, r in zip(values, rows, strict=True) if r.fold < test]) for values in ([r.x for r in rows], [r.target for r in rows]))
        xc, yc = x - x.mean(0), y - y.mean()
        want = np.linalg.solve(xc.T @ xc + 2.0 * np.eye(x.shape[1]), xc.T @ yc)
        assert np.allclose(x @ beta + intercept, xc @ want + y.mean(), rtol=1e-6)
    found = {r.fold: r for r in clv.cross_validate(table, config).collect()}
    assert set(found) == {1, 2, 3, 4, 5} and sum(r.n for r in found.values()) == sum(r.fold > 0 for r in rows)


def test_tree_folds_see_earlier_rows_only(spark, people):
    config = clv.TrainingConfig("random_forest", splits=2, params={"numTrees": 2, "maxDepth": 2}, groups=("engagement",))
    table = clv.training_table(*people, config)
    rows = {r.fold: r for r in clv.cross_validate(table, config).collect()}
    folds = clv.cut(clv.time_folds(table, 2))
    for i in (1, 2):
        past = folds.where(F.col("fold") < i)
        model = clv.estimator(config, past.count()).fit(past)
        want = clv.metrics(model.transform(folds.where(F.col("fold") == i))).first()
        assert rows[i].n == want.n and rows[i].mae == pytest.approx(want.mae)


def test_ablation_equals_one_pass_for_each_feature(spark, people):
    config = clv.TrainingConfig("random_forest", params={"numTrees": 3, "maxDepth": 4}, groups=("engagement", "temporal"))
    predictor, _ = clv.train(*people, config)
    rows = clv.cut(clv.build_features(*people, predictor.names))
    got = {(r.customer_id, r.feature): r.contribution for r in clv.ablation_contributions(predictor.model, rows, predictor.names).collect()}
    assert len(got) == rows.count() * len(predictor.names)
    full = {r.customer_id: r.prediction for r in predictor.model.transform(clv.as_vectors(rows, predictor.names)).collect()}
    for name in predictor.names[:3]:
        mean = rows.agg(F.avg(name)).first()[0]
        for r in predictor.model.transform(clv.as_vectors(rows.withColumn(name, F.lit(mean)), predictor.names)).collect():
            assert got[r.customer_id, name] == pytest.approx(full[r.customer_id] - r.prediction)
    plan = clv.ablation_contributions(predictor.model, rows, predictor.names)._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan


@pytest.mark.parametrize("model", ["gradient_boosting", "random_forest", "ridge"])
def test_queries_train_the_whole_model(model):
    assert clv_queries._config(model) == clv.TrainingConfig(model)
    assert not {"_SMALL", "_GROUPS"} & set(vars(clv_queries))


def test_target_is_not_among_its_own_features():
    assert not {"total_revenue", "avg_order_value", "revenue_per_session"} & set(clv.TrainingConfig().names) and len(clv.names_of()) == 48
    assert "total_revenue" in clv.TrainingConfig(keep_target_as_feature=True).names


def test_holdout_is_the_most_recent_part(spark, people):
    table = clv.training_table(*people, clv.TrainingConfig(groups=("engagement",)))
    past, recent = clv.time_holdout(table)
    assert past.agg(F.max("last_seen")).first()[0] < recent.agg(F.min("last_seen")).first()[0]
    assert past.count() + recent.count() == table.count()


def test_time_folds_and_holdout_follow_positions(spark):
    """1504 rows and five splits: test folds of 250 rows each, the remainder goes to the first training fold."""
    table = spark.range(1504).selectExpr("cast(id as string) as customer_id", "timestamp_seconds(id * 60) as last_seen")
    folds = {r["fold"]: r["count"] for r in clv.time_folds(table, 5).groupBy("fold").count().collect()}
    assert folds == {0: 254, 1: 250, 2: 250, 3: 250, 4: 250, 5: 250}
    past, recent = clv.time_holdout(table, 0.2)
    assert (past.count(), recent.count()) == (1203, 301)


def test_queries_take_the_leading_category_from_the_pass_of_the_profiles(spark, people, monkeypatch):
    """The same features as from the affinities, without a second pass over the events or their table."""
    names = ("category_count", *profiles.LEADING)
    rows = inputs.shop_profiles(spark, FOLDER, leading=True)
    got, want = ({r["customer_id"]: r for r in clv.build_features(p, a, names).collect()} for p, a in ((rows, None), people))
    assert got.keys() == want.keys() and any(r["top_category_purchases"] for r in want.values())
    for customer, r in want.items():
        assert all(got[customer][n] == pytest.approx(r[n], rel=1e-12) for n in names)
    assert not set(profiles.LEADING) & set(people[0].columns)
    monkeypatch.setattr(inputs, "_WRITTEN", {})
    clv_queries.clv_cross_validation(spark, FOLDER).collect()
    assert {name for _, _, name in inputs._WRITTEN} == {"shop_profiles"}


def test_training_table_has_as_many_parts_as_its_rows_need(spark, monkeypatch):
    many = spark.range(0, 100, 1, 40)
    assert [lineage.few_parts(many).rdd.getNumPartitions(), lineage.few_parts(many.limit(0)).count()] == [1, 0]
    monkeypatch.setattr(lineage, "FEW_ROWS", 30)
    assert lineage.few_parts(many).rdd.getNumPartitions() == 4
    monkeypatch.setattr(lineage, "MOST_ROWS", 9)
    parts = lineage.few_parts(many)
    assert parts.rdd.getNumPartitions() == 12 and sorted(r.id for r in parts.collect()) == list(range(100))
    monkeypatch.undo()
    table = clv.training_table(_rows_in_parts(spark, 40), None, clv.TrainingConfig("ridge", groups=("engagement",)))
    assert table.rdd.getNumPartitions() == 1 and table.count() == 100


def _rows_in_parts(spark, parts):
    counts = {n: F.col("id") % 7 for n in clv.FEATURES["engagement"]}
    more = {"tenure_days": 3, "preferred_day_of_week": 1, "preferred_hour_of_day": 1, "total_revenue": 5, "total_purchases": 2, "days_since_last_purchase": 1, "mobile_session_ratio": 0.5, "top_category_score": 1.0, "top_category_purchases": 1.0, "category_concentration": 1.0}
    return spark.range(0, 100, 1, parts).select(F.col("id").alias("customer_id"), *[c.alias(n) for n, c in counts.items()], *[F.lit(v).alias(n) for n, v in more.items()], F.lit("regular").alias("behavior_type"), F.timestamp_seconds("id").alias("last_seen"))

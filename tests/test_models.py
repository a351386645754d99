"""Training, registry and tree attributions."""

import itertools
import math
import time

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from paceforge import testbed
from paceforge.operators import attribution, boosting, cleaning, encoding, forest, reports, scoring, training
from paceforge.plans import analysis, flow, queries_models
from paceforge.sources import registry

FEATURES = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def prepared(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(900, 4))
    y = 6 + x[:, 0] + np.where(x[:, 1] > 0, x[:, 2], -1) + rng.normal(0, 0.05, 900)
    rows = [(i, float(y[i]), *[float(v) if rng.random() > 0.02 else None for v in x[i]]) for i in range(900)]
    df = spark.createDataFrame(rows, "activity_id long, pace_minutes double, a double, b double, c double, d double")
    return training.prepare(df, FEATURES)[0].cache()


@pytest.fixture(scope="module")
def model(prepared):
    return training.fit_model(prepared, FEATURES, {"maxIter": 8, "maxDepth": 4, "stepSize": 0.3})


def test_split_shares(prepared):
    shares = {r["split"]: r["count"] / 900 for r in prepared.groupBy("split").count().collect()}
    assert abs(shares["train"] - 0.6) < 0.06 and abs(shares["validation"] - 0.2) < 0.05


def test_split_ignores_partitioning(prepared):
    a = {r[0]: r[1] for r in prepared.select("activity_id", "split").collect()}
    b = encoding.hash_split(prepared.drop("split").repartition(7)).select("activity_id", "split").collect()
    assert a == {r[0]: r[1] for r in b}


def test_model_beats_the_mean(model, prepared):
    metrics = training.evaluate(model, prepared)
    assert metrics["r2"] > 0.5
    again = training.fit_model(prepared, FEATURES, {"maxIter": 8, "maxDepth": 4, "stepSize": 0.3})
    assert training.evaluate(again, prepared) == metrics


def test_means_come_from_training_rows_only(model, prepared):
    surrogate = model.stages[0].surrogateDF.first()
    mean = prepared.filter("split = 'train'").agg(F.avg("a")).first()[0]
    assert surrogate["a"] == pytest.approx(mean)


def test_attributions_add_up(spark, model, prepared):
    long = attribution.attributions(model, prepared, FEATURES, keep=["activity_id", "label"])
    base = attribution.expected_value(attribution.leaf_paths(model, spark))
    sums = {r[0]: r[1] for r in long.groupBy("activity_id").agg(F.sum("shap")).collect()}
    scored = model.transform(prepared).select("activity_id", "prediction").collect()
    assert len(sums) == len(scored)
    assert all(abs(sums[r[0]] + base - r[1]) < 1e-6 for r in scored)
    assert long.columns == ["activity_id", "label", "feature", "value", "shap"]


def _conditional(paths, x, known):
    """Expected prediction when only the features in ``known`` are given."""
    total = 0.0
    for p in paths:
        weight = p.value
        for f, low, high, share in zip(p.features, p.low, p.high, p.share):
            weight *= float(low < x[f] <= high) if f in known else share
        total += weight
    return total


def test_attributions_match_brute_force(spark, model):
    paths = attribution.leaf_paths(model, spark)
    rows = np.random.default_rng(5).normal(size=(6, 4))
    got = attribution.attribute(rows, paths)
    for x, phi in zip(rows, got):
        for i in range(4):
            want = 0.0
            others = [j for j in range(4) if j != i]
            for k in range(4):
                for chosen in itertools.combinations(others, k):
                    weight = math.factorial(k) * math.factorial(3 - k) / math.factorial(4)
                    want += weight * (_conditional(paths, x, {*chosen, i}) - _conditional(paths, x, set(chosen)))
            assert phi[i] == pytest.approx(want, abs=1e-9)


def test_attribution_blocks_change_nothing(spark, model):
    paths = attribution.leaf_paths(model, spark)
    rows = np.random.default_rng(6).normal(size=(37, 4))
    whole = attribution.attribute(rows, paths)
    assert attribution.attribute(rows, paths, cells=1) == pytest.approx(whole, abs=1e-12)
    assert attribution.attribute(rows, attribution.leaf_arrays(paths), cells=500) == pytest.approx(whole, abs=1e-12)
    assert not attribution.attribute(rows, []).any()


def test_tables_give_what_the_leaves_give(spark, model):
    paths = attribution.leaf_paths(model, spark)
    rows = np.random.default_rng(8).normal(size=(50, 4))
    cuts = [c for p in paths for c in p.high if np.isfinite(c)]
    rows[:20, :] = np.array(cuts[:20])[:, None]  # on the borders
    want = attribution.attribute(rows, paths)
    deep = attribution.Path(np.arange(4), np.arange(4) - 1.5, np.arange(4) + 0.5, np.full(4, 0.3), 2.0)
    for most in (1, 3, 8, 12):
        tables = attribution.leaf_groups(paths, most)
        assert all(len(g.cuts) <= most for g in tables.groups)
        for kept in (0, 10**6):
            assert attribution.Lookup(tables, kept)(rows, cells=40) == pytest.approx(want, abs=1e-12)
    # a leaf of eight conditions, where seven fit, meets the rows themselves
    mixed = attribution.leaf_groups([*paths, deep], 7)
    assert sum(len(g.value) for g in mixed.rest) >= 1
    assert attribution.Lookup(mixed)(rows) == pytest.approx(attribution.attribute(rows, [*paths, deep]), abs=1e-12)
    assert not attribution.Lookup(attribution.leaf_groups([]))(rows).any()


def test_a_hundred_trees_are_looked_up():
    """Ten thousand rows and 3,200 leaves in seconds; meeting every leaf took ten."""
    rng = np.random.default_rng(9)
    cuts, paths = np.sort(rng.normal(size=(36, 31)), axis=1), []

    def grow(node, bounds, depth):
        if depth == 0:
            names = sorted(bounds)
            low, high, share = (np.array([bounds[f][k] for f in names]) for k in range(3))
            paths.append(attribution.Path(np.array(names), low, high, share, float(rng.normal())))
            return
        f = int(rng.integers(36))
        cut, (low, high, share) = cuts[f, rng.integers(31)], bounds.get(f, (-np.inf, np.inf, 1.0))
        grow(node, {**bounds, f: (low, min(high, cut), share * 0.4)}, depth - 1)
        grow(node, {**bounds, f: (max(low, cut), high, share * 0.6)}, depth - 1)

    for _ in range(100):
        grow(0, {}, 5)
    x = rng.normal(size=(10_000, 36))
    look = attribution.Lookup(attribution.leaf_groups(paths))
    begun = time.process_time()
    got = look(x)
    assert time.process_time() - begun < 4
    assert got[:40] == pytest.approx(attribution.attribute(x[:40], paths), abs=1e-12)


def test_a_thousand_deep_rounds_are_attributed_in_blocks():
    """A hundred thousand leaves of seven features: additive, and in seconds."""
    rng = np.random.default_rng(7)
    paths = []
    for _ in range(100_000):
        d = int(rng.integers(1, 8))
        cut = rng.normal(size=d)
        paths.append(attribution.Path(np.sort(rng.choice(30, d, replace=False)), cut - 1, cut + 1, rng.uniform(0.1, 0.9, d), float(rng.normal())))
    x = rng.normal(size=(60, 30))
    leaves = attribution.leaf_arrays(paths)
    begun = time.time()
    got = attribution.attribute(x, leaves).sum(axis=1) + attribution.expected_value(paths)
    assert time.time() - begun < 60
    want = [sum(p.value for p in paths if ((r[p.features] > p.low) & (r[p.features] <= p.high)).all()) for r in x[:3]]
    assert got[:3] == pytest.approx(want, rel=1e-6, abs=1e-6)


def test_search_and_comparison(prepared):
    trials = training.random_search(prepared, FEATURES, trials=2, maxIter=2, maxDepth=2)
    assert trials.count() == 2 and trials.filter("mae IS NULL").count() == 0
    assert training.draw_params(3, seed=1) == training.draw_params(3, seed=1)
    runs = training.compare(
        prepared, FEATURES, {"shallow": {"maxIter": 1, "maxDepth": 1}, "deep": {"maxIter": 6, "maxDepth": 4, "stepSize": 0.3}}
    )
    assert scoring.best_run(runs).first()["config"] == "deep"
    folds = training.cross_validate(prepared, FEATURES, {"maxDepth": [1, 3]}, maxIter=2, stepSize=0.5)
    assert folds.count() == 2
    with pytest.raises(ValueError, match="2187"):
        training.cross_validate(prepared, FEATURES, training.FULL_GRID, limit=100)


def test_patience_equals_separate_fits(prepared):
    """One long fit cut to its best round is the fit of that many rounds, and the curve is theirs."""
    params = {"maxDepth": 4, "stepSize": 0.9, "subsamplingRate": 0.5}
    curve = [r["mae"] for r in training.round_curve(prepared, FEATURES, {**params, "maxIter": 9}).orderBy("round").collect()]
    for rounds in (1, 4, 9):
        alone = training.fit_model(prepared, FEATURES, {**params, "maxIter": rounds}, patience=100)
        inputs = training.fit_inputs(prepared.filter("split = 'train'"), FEATURES)
        rows = training.model_rows(prepared, inputs)
        trees = training._fit({**params, "maxIter": rounds}, rows.filter("split = 'train'"))
        full = scoring.regression_metrics(trees.transform(rows.filter("split = 'validation'"))).first()["mae"]
        assert full == pytest.approx(curve[rounds - 1], rel=1e-9)
        assert len(alone.stages[-1].treeWeights) == int(np.argmin(curve[:rounds])) + 1
    patient = training.fit_model(prepared, FEATURES, {**params, "maxIter": 9}, patience=2)
    kept = forest.best_round(curve, 2)
    assert len(patient.stages[-1].treeWeights) == kept
    assert training.evaluate(patient, prepared, "validation")["mae"] == pytest.approx(curve[kept - 1], rel=1e-9)
    chosen = training.round_curve(prepared, FEATURES, {**params, "maxIter": 9}, patience=2).filter("chosen").collect()
    assert [r["round"] for r in chosen] == [kept]


def test_best_round():
    assert forest.best_round([5.0, 4.0, 4.5, 4.6, 3.0], 2) == 2 and forest.best_round([5.0, 4.0, 4.5, 4.6, 3.0], 3) == 5
    assert forest.best_round([1.0, 1.0, 2.0], 50) == 1 and forest.best_round([3.0], 1) == 1


def test_shortened_models_can_be_saved(model, prepared, tmp_path):
    short = forest.first_rounds(model.stages[-1], 3)
    saved = PipelineModel(stages=[*model.stages[:-1], short])
    saved.write().save(str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m"))
    assert len(again.stages[-1].treeWeights) == 3
    a, b = (m.transform(prepared).agg(F.sum("prediction")).first()[0] for m in (saved, again))
    assert a == pytest.approx(b)


def test_node_arrays_predict_like_the_model(spark, model, prepared):
    inputs = model.transform(prepared).select("features", "prediction").collect()
    nodes = forest.Forest.of(forest.node_table(model.stages[-1], spark))
    got = nodes.contributions(np.array([r["features"].toArray() for r in inputs])).sum(axis=1)
    assert got == pytest.approx(np.array([r["prediction"] for r in inputs]))


def test_grid_points_share_fits_and_a_restart_fits_nothing(prepared, tmp_path, monkeypatch):
    grid = {"maxDepth": [1, 3], "maxIter": [2, 4], "stepSize": [0.5]}
    runs = str(tmp_path / "runs")
    fits = []
    plain = training._regressor
    monkeypatch.setattr(training, "_regressor", lambda params: fits.append(params) or plain(params))
    first = {tuple(sorted(r["params"].items())): r["mae"] for r in training.cross_validate(prepared, FEATURES, grid, runs=runs).collect()}
    assert len(first) == 4 and len(fits) == 2 * 3 and {f["maxIter"] for f in fits} == {4}
    alone = training.cross_validate(prepared, FEATURES, {"maxDepth": [3], "maxIter": [2], "stepSize": [0.5]}).first()
    assert alone["mae"] == pytest.approx(first[(("maxDepth", "3"), ("maxIter", "2"), ("stepSize", "0.5"))], rel=1e-9)
    fits.clear()
    again = {tuple(sorted(r["params"].items())): r["mae"] for r in training.cross_validate(prepared, FEATURES, grid, runs=runs).collect()}
    assert again == first and not fits
    trials = training.random_search(prepared, FEATURES, trials=2, runs=runs + "2", maxIter=2, maxDepth=2)
    fits.clear()
    more = training.random_search(prepared, FEATURES, trials=3, runs=runs + "2", maxIter=2, maxDepth=2)
    assert len(fits) == 1
    same = {r["config"]: r["mae"] for r in trials.collect()}
    assert {r["config"]: r["mae"] for r in more.collect() if r["config"] in same} == same


def test_the_registered_search_covers_the_whole_grid(prepared, monkeypatch):
    monkeypatch.setattr(queries_models, "_rows", lambda spark, sf: (prepared, FEATURES))
    searched = []
    monkeypatch.setattr(training, "cross_validate", lambda rows, features, grid, **options: searched.append((grid, options)))
    queries_models.cv_search(None, "")
    (grid, options), rates = searched[0], ["0.6", "0.8", "1.0"]
    assert grid == {
        "maxDepth": [3, 5, 7], "stepSize": [0.01, 0.05, 0.1], "maxIter": [100, 500, 1000], "minInstancesPerNode": [1, 3, 5],
        "subsamplingRate": [float(r) for r in rates], "featureSubsetStrategy": rates, "minInfoGain": [0.0, 0.1, 0.2],
    }
    assert options.get("folds", 3) == 3 and options.get("limit") is None and math.prod(len(v) for v in grid.values()) == 2187


def test_the_whole_grid_is_fitted_and_nothing_beside_it(spark, prepared, monkeypatch):
    """Every point has its error from the fits of its three folds; no model is fitted that the search does not use."""
    asked = []

    def counted(self, held, rounds, points):
        asked.extend((held, tuple(sorted((k, str(v)) for k, v in p.items()))) for p in points)
        return [{r: held + r + p["maxDepth"] / 10 for r in rounds} for p in points]

    monkeypatch.setattr(training._TaskFits, "errors", counted)
    monkeypatch.setattr(training, "_fit", lambda *_: 1 / 0)
    monkeypatch.setattr(queries_models, "_prepared", lambda spark, sf: (prepared, FEATURES))
    monkeypatch.setattr(queries_models, "_ROWS", {})
    monkeypatch.setattr(queries_models, "_FITTED", {})
    rows = queries_models.cv_search(spark, "here").collect()
    assert len(rows) == 2187 == len({tuple(sorted(r["params"].items())) for r in rows})
    assert all(r["mae"] == pytest.approx(1 + int(r["params"]["maxIter"]) + int(r["params"]["maxDepth"]) / 10) for r in rows)
    assert len(asked) == len(set(asked)) == 2187 and {dict(p)["maxIter"] for _, p in asked} == {"1000"}


def test_fits_in_tasks_are_those_of_spark(prepared, monkeypatch):
    """Bins, samples, ties and leaves as GBTRegressor has them, whatever the parameters."""
    rounded = prepared.withColumn("d", F.round("d")).withColumn("c", F.lit(1.0)).cache()  # equal values, and a feature without a split
    grids = [
        {"maxDepth": [4], "maxIter": [3, 8], "stepSize": [0.4], "subsamplingRate": [0.6], "featureSubsetStrategy": ["0.6"], "minInstancesPerNode": [3], "minInfoGain": [0.0, 0.4]},
        {"maxDepth": [0, 7], "maxIter": [6], "stepSize": [0.2], "subsamplingRate": [1.0], "featureSubsetStrategy": ["1.0"], "minInstancesPerNode": [1], "minInfoGain": [0.2]},
    ]
    of = lambda rows: {tuple(sorted(r["params"].items())): r["mae"] for r in rows.collect()}
    jobs = []
    plain = training._fit
    monkeypatch.setattr(training, "_fit", lambda params, rows: jobs.append(params) or plain(params, rows))
    got = [of(training.cross_validate(rounded, FEATURES, grid, seed=7)) for grid in grids]
    assert not jobs and len(set(got[0].values())) == 4
    monkeypatch.setattr(boosting, "MOST_ROWS", 0)
    want = [of(training.cross_validate(rounded, FEATURES, grid, seed=7)) for grid in grids]
    assert len(jobs) == 12
    for a, b in zip(got, want):
        assert a == pytest.approx(b, rel=1e-9)


def test_search_leaves_to_spark_what_tasks_do_not_know(prepared, monkeypatch):
    jobs = []
    plain = training._fit
    monkeypatch.setattr(training, "_fit", lambda params, rows: jobs.append(params) or plain(params, rows))
    for options in ({"lossType": "absolute"}, {"featureSubsetStrategy": "sqrt"}):
        assert training.cross_validate(prepared, FEATURES, {"maxDepth": [2]}, maxIter=2, **options).first()["mae"] > 0
    assert len(jobs) == 6
    assert boosting.kept_features("0.6", 41) == 25 and boosting.kept_features("1.0", 4) == boosting.kept_features("all", 4) == 4
    assert boosting.kept_features("2", 4) is None and boosting.kept_features("0.0", 4) is None


def test_named_configurations(prepared, monkeypatch):
    small = {n: {**c, "maxIter": 3} for n, c in training.NAMED_CONFIGS.items()}
    monkeypatch.setattr(training, "NAMED_CONFIGS", small)
    runs = training.compare_named(prepared, FEATURES)
    assert {r["config"] for r in runs.collect()} == {"wide", "deep"} and scoring.best_run(runs).first()["config"] in small


def test_requests_without_history_or_values_count_as_zero(spark, model):
    schema = "request_id int, a double, last_7_runs array<struct<distance:double,average_heart_rate:double>>"
    requests = spark.createDataFrame([(1, 0.4, None), (2, None, [(5.0, 150.0)]), (3, 0.4, [])], schema)
    out = {r["request_id"]: r for r in scoring.score_requests(requests, model, FEATURES).collect()}
    plain = spark.createDataFrame([(1, 0.4, 0.0, 0.0, 0.0), (2, 0.0, 0.0, 0.0, 0.0)], "request_id int, a double, b double, c double, d double")
    want = {r["request_id"]: r["prediction"] for r in model.transform(plain).collect()}
    assert out[1]["prediction"] == out[3]["prediction"] == pytest.approx(want[1]) and out[2]["prediction"] == pytest.approx(want[2])
    assert out[2]["a"] == 0 and ":" in out[1]["predicted_pace"]


def test_registry(spark, model, prepared, tmp_path):
    root = str(tmp_path / "models")
    for version, mae in (("20240101", 0.5), ("20240301", 0.4), ("20240201", 0.3)):
        registry.save_model(model, root, "pace_gbt", version, FEATURES, {"mae": mae}, {"maxDepth": 4}, "test")
    registry.save_model(model, root, "pace_gbt", "20240301", FEATURES, {"mae": 0.2})
    table = {r["version"]: r["metrics"]["mae"] for r in registry.registered(spark, root).collect()}
    assert table == {"20240101": 0.5, "20240301": 0.2, "20240201": 0.3}
    loaded, features, path = registry.load_latest(spark, root, "pace")
    assert features == FEATURES and "/pace_gbt/20240301/" in path
    a = model.transform(prepared).agg(F.sum("prediction")).first()[0]
    assert loaded.transform(prepared).agg(F.sum("prediction")).first()[0] == pytest.approx(a)
    with pytest.raises(FileNotFoundError):
        registry.load_latest(spark, root, "other")


def test_a_save_that_dies_leaves_the_old_version(model, prepared, spark, tmp_path, monkeypatch):
    root = str(tmp_path / "models")
    first = registry.save_model(model, root, "gbt", "1", FEATURES, {"mae": 0.5})
    short = PipelineModel(stages=[*model.stages[:-1], forest.first_rounds(model.stages[-1], 2)])
    with monkeypatch.context() as broken:
        broken.setattr(registry.json, "dumps", lambda record: 1 / 0)  # after the model, before its record
        with pytest.raises(ZeroDivisionError):
            registry.save_model(short, root, "gbt", "1", FEATURES, {"mae": 0.1})
    loaded, _, path = registry.load_latest(spark, root)
    assert path == first and len(loaded.stages[-1].treeWeights) == 8
    second = registry.save_model(short, root, "gbt", "1", FEATURES, {"mae": 0.1})
    loaded, _, path = registry.load_latest(spark, root)
    assert path == second and len(loaded.stages[-1].treeWeights) == 2
    assert len(PipelineModel.load(f"{first}/model").stages[-1].treeWeights) == 8


def test_importance(spark, model):
    ranked = reports.importance_rank(training.gain_importance(model, FEATURES, spark)).collect()
    assert [r["rank"] for r in ranked] == list(range(1, len(ranked) + 1)) and {r["feature"] for r in ranked} >= {"a", "b", "c"}
    nodes = forest.node_table(model.stages[-1], spark).filter("feature = 0").collect()
    table = {r["feature"]: r for r in training.gain_importance(model, FEATURES, spark).collect()}
    assert table["a"]["splits"] == len(nodes)
    assert table["a"]["importance"] == pytest.approx(sum(r["gain"] * r["rows"] for r in nodes) / len(nodes))


def test_one_hot(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("c",)], "k string")
    out = encoding.one_hot_drop_first(df, ["k"])
    assert out.columns == ["k_b", "k_c"]
    assert [tuple(r) for r in out.collect()] == [(1, 0), (0, 0), (0, 0), (0, 1)]
    with pytest.raises(ValueError, match="categories"):
        encoding.one_hot_drop_first(df, ["k"], limit=2)


def test_sparse_categories_equal_the_columns(spark, sf):
    customers = testbed.table(spark, sf, "customer").selectExpr("c_custkey AS k", "c_mktsegment AS segment", "if(c_custkey % 9 = 0, null, cast(c_nationkey AS string)) AS nation")
    fitted = [encoding.fit_categories(customers, c) for c in ("segment", "nation")]
    sparse = encoding.one_hot_sparse(customers, fitted).select("k", vector_to_array("segment__vector").alias("s"), vector_to_array("nation__vector").alias("n"))
    dense = encoding.one_hot_drop_first(customers, ["segment", "nation"])
    names = [c for c in dense.columns if c != "k"]
    want = {r["k"]: [float(r[c]) for c in names] for r in dense.collect()}
    assert {r["k"]: list(r["s"]) + list(r["n"]) for r in sparse.collect()} == want
    unseen = spark.createDataFrame([(1, "NEW", None)], "k int, segment string, nation string")
    row = encoding.one_hot_sparse(unseen, fitted).first()
    assert row["segment__vector"].numNonzeros() == 0 and row["segment__vector"].size == fitted[0].count - 1


def test_a_million_categories(spark):
    df = spark.range(1_000_000).selectExpr("id", "concat('v', id) AS v")
    fitted = encoding.fit_categories(df, "v")
    assert fitted.count == 1_000_000
    out = encoding.one_hot_sparse(df.filter("id % 100000 = 7"), [fitted]).collect()
    assert len(out) == 10 and all(r["v__vector"].size == 999_999 and r["v__vector"].numNonzeros() == 1 for r in out)


def test_categories_in_the_training_set(spark):
    rows = [(i, 5.0 + (i % 3), float(i % 7), [None, "b", "a"][i % 3]) for i in range(300)]
    df = spark.createDataFrame(rows, "activity_id long, pace_minutes double, x double, kind string")
    prepared, features = training.prepare(df, ["x"], categorical=["kind"])
    assert features == ["x", "kind__vector"]
    model = training.fit_model(prepared, features, {"maxIter": 4, "maxDepth": 2, "stepSize": 0.5})
    assert training.evaluate(model, prepared)["mae"] < 0.6  # the filled mode shares a category with one of the others


def test_history_rollup_cases(spark):
    schema = "id int, last_7_runs array<struct<distance:double,elapsed_time:double,average_heart_rate:double>>"
    rows = [
        (1, None),
        (2, []),
        (3, [(5.0, 1.0, 150.0), (7.0, 1.0, None), (None, 1.0, 140.0)]),
        (4, [(None, 1.0, None)]),
    ]
    out = scoring.history_rollup(spark.createDataFrame(rows, schema)).orderBy("id").collect()
    got = [(r["7d_avg_distance"], r["7d_total_distance"], r["7d_avg_heart_rate"]) for r in out]
    assert got == [(None, None, None), (None, None, None), (6.0, 12.0, 145.0), (None, None, None)]


def test_align(spark):
    df = spark.createDataFrame([(1, 2.0, "x")], "activity_id long, b double, t string")
    assert tuple(encoding.align_features(df, ["z", "b"], ["activity_id"]).first()) == (1, 0.0, 2.0)
    assert encoding.align_features(df, None, ["activity_id"]).columns == ["activity_id", "b"]


def test_pivot_undoes_unpivot(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0), (2, None, 5.0)], "activity_id long, x double, y double")
    long = encoding.unpivot_features(df, ["x", "y"], ["activity_id"], value="shap")
    back = encoding.pivot_attributions(long, ["x", "y"]).orderBy("activity_id").collect()
    assert [tuple(r) for r in back] == [(1, 2.0, 3.0), (2, None, 5.0)]


def test_analyses_of_a_fitted_model(spark, sf):
    rows = flow.features(testbed.activities(spark, sf).transform(cleaning.filter_valid_runs), lags=4)
    prepared, features = training.prepare(rows, "with_pace_with_time", keep=["runner_id", "date"])
    assert "pace_t-1" in features and "pace_diff" not in features and "moving_time" in features
    model = training.fit_model(prepared, features, {"maxIter": 3, "maxDepth": 3, "stepSize": 0.3})
    shap = analysis.explain(model, prepared, features)
    assert shap.count() == prepared.count() * len(features)
    everything = analysis.all_runs(shap, 5)
    assert everything["impact"].count() == 5 and everything["totals"].count() == 1
    assert analysis.latest_run(shap)["improvement"].count() == 5
    trend = analysis.over_time(shap, 3, 4)
    assert trend["monthly"].count() == 4 and trend["weekly"].select("feature").distinct().count() == 4
    assert trend["weekly_trend"].filter("trend IS NOT NULL").count() > 0
    assert trend["bounds"].first()["runs"] == prepared.count() and trend["summary"].count() == 0
    named = analysis.over_time(shap, None, features=["distance", "nothing"])
    assert [r[0] for r in named["unknown"].collect()] == ["nothing"]


def test_queries_with_fits_of_their_own_fit_nothing_else(spark, prepared, monkeypatch):
    """The default model is no part of a curve of rounds nor of a search."""
    asked, fit = [], training._fit

    def counted(params, rows):
        asked.append(dict(params))
        return fit({**params, "maxIter": 2, "maxDepth": 2}, rows)

    monkeypatch.setattr(training, "_fit", counted)
    monkeypatch.setattr(queries_models, "_prepared", lambda spark, sf: (prepared, FEATURES))
    monkeypatch.setattr(queries_models, "_ROWS", {}, raising=False)
    monkeypatch.setattr(queries_models, "_FITTED", {})
    assert queries_models.gbt_rounds(spark, "here").count() == 2
    assert asked == [{}]
    asked.clear()
    queries_models.cv_search(spark, "here")
    assert sorted(p["maxDepth"] for p in asked) == [3, 3, 3, 5, 5, 5]


def test_large_fits_are_dealt_out_in_equal_rounds_of_all_cores(spark, prepared, monkeypatch):
    """Kept in their order while the fit runs, and let go then; small ones stay as they were."""
    seen, plain = [], training._regressor

    class Watched:
        def __init__(self, params):
            self.inner = plain(params)

        def fit(self, ordered):
            places = ordered.rdd.mapPartitions(lambda part: [[r["place"] for r in part]]).collect()
            seen.append((len(places), ordered.is_cached, sum(map(len, places)), all(p == sorted(p) for p in places)))
            return self.inner.fit(ordered)

    monkeypatch.setattr(training, "_regressor", Watched)
    rows = training.model_rows(prepared, training.fit_inputs(prepared.filter("split = 'train'"), FEATURES)).filter("split = 'train'")
    n, cores = rows.count(), spark.sparkContext.defaultParallelism
    small = training._fit({"maxIter": 2, "maxDepth": 2}, rows)
    monkeypatch.setattr(training, "SMALL_ROWS", 0, raising=False)
    monkeypatch.setattr(training, "TASK_ROWS", 100, raising=False)
    kept = len(spark.sparkContext._jsc.getPersistentRDDs())
    large = training._fit({"maxIter": 2, "maxDepth": 2, "subsamplingRate": 1.0, "featureSubsetStrategy": "all"}, rows)
    assert not seen[0][1] and seen[1] == (cores * math.ceil(n / (100 * cores)), True, n, True)
    assert len(spark.sparkContext._jsc.getPersistentRDDs()) <= kept
    assert len(small.treeWeights) == len(large.treeWeights) == 2


def test_a_fit_writes_the_rows_it_uses_without_vectors(prepared, monkeypatch):
    written, stage = [], training.stage
    monkeypatch.setattr(training, "stage", lambda df, label: written.append(stage(df, label)) or written[-1])
    training.fit_model(prepared, FEATURES, {"maxIter": 1, "maxDepth": 1})
    training.fit_model(prepared, FEATURES, {"maxIter": 1, "maxDepth": 1}, early_stopping=False)
    assert len(written) == 2
    for table in written:
        assert {f.dataType.typeName() for f in table.schema} == {"double", "string"}
        assert {r[0] for r in table.select("split").distinct().collect()} == {"train", "validation"}

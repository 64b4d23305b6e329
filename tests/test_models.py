from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyloom.operators.anomaly import density, forest, neighbours, report, stats
from tallyloom.operators.anomaly.detector import AnomalyDetector, MultiDimensionalDetector
from tallyloom.operators.features import Scaler
from tallyloom.operators.forecast import autoregression, ensemble, evaluate
from tallyloom.operators.forecast.models import SalesForecastModel

SMALL_FOREST = {"numTrees": 12, "maxDepth": 5}


def points(seed=1):
    rng = np.random.default_rng(seed)
    return np.vstack([rng.normal(0, 1, (150, 2)), rng.normal(8, .1, (80, 2)), rng.uniform(-20, 20, (20, 2)),
                      np.tile([3.0, 3.0], (40, 1))])


def brute_lof(x, y=None, k=20):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    def near(d):
        idx = np.argsort(d, axis=1, kind="stable")[:, :k]
        return idx, np.take_along_axis(d, idx, 1)
    idx, dd = near(d)
    kd = dd[:, -1]
    lrd = 1 / (np.maximum(kd[idx], dd).mean(1) + 1e-10)
    if y is None:
        return lrd[idx].mean(1) / lrd
    idx, dd = near(np.sqrt(((y[:, None] - x[None]) ** 2).sum(-1)))
    return lrd[idx].mean(1) * (np.maximum(kd[idx], dd).mean(1) + 1e-10)


def test_lof_is_exact(spark):
    x = points()
    df = spark.createDataFrame(pd.DataFrame(x, columns=["a", "b"]))
    ref, index = neighbours.fit(df, ["a", "b"])
    got = {tuple(r.x): r.lof for r in ref.collect()}
    assert np.allclose([got[tuple(p)] for p in x], brute_lof(x))
    y = np.random.default_rng(9).uniform(-30, 30, (25, 2))
    new = spark.createDataFrame(pd.DataFrame(y, columns=["a", "b"]))
    same = Scaler(["a", "b"], {"a": 0.0, "b": 0.0}, {"a": 1.0, "b": 1.0})
    scored = neighbours.score(new, ref, ["a", "b"], same).toPandas().sort_values(["a", "b"])
    order = np.lexsort((y[:, 1], y[:, 0]))
    assert np.allclose(scored["lof"], brute_lof(x, y)[order])
    again = neighbours.score(new, ref, ["a", "b"], same, index=index).toPandas().sort_values(["a", "b"])
    assert np.allclose(again["lof"], scored["lof"])


@pytest.mark.parametrize("d", [1, 2, 3])
def test_dbscan_is_exact(spark, d, monkeypatch):
    monkeypatch.setattr(density, "SALT_ROWS", 10)
    rng = np.random.default_rng(d)
    x = np.vstack([rng.normal(0, .6, (250, d)), rng.uniform(-4, 4, (60, d)) * (20 if d == 1 else 1), np.tile(np.full(d, 3.9), (4, 1))])
    dist = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)) <= 0.5
    core = dist.sum(1) >= 5
    want = ~(dist & core[None, :]).any(1)
    cols = [f"c{i}" for i in range(d)]
    pdf = pd.DataFrame(x, columns=cols)
    pdf["i"] = range(len(x))
    got = density.noise_flags(spark.createDataFrame(pdf), cols).orderBy("i").toPandas()
    assert (got["is_anomaly_ml"].to_numpy() == want).all() and 0 < want.sum() < len(x)


def test_forest_ranks_outliers(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(0, 1, (2_000, 3))
    x[:10] += 12
    pdf = pd.DataFrame(x, columns=["a", "b", "c"]).assign(i=range(2_000))
    df = spark.createDataFrame(pdf)
    model = forest.fit_forest(df, ["a", "b", "c"], 0.05, trees=50, key=["i"])
    got = forest.detect(df, model).toPandas().sort_values("anomaly_score", ascending=False)
    assert set(got["i"][:10]) == set(range(10))
    assert abs(got["is_anomaly_ml"].mean() - 0.05) < 0.002
    again = forest.fit_forest(df.repartition(7), ["a", "b", "c"], 0.05, trees=50, key=["i"])
    assert again.threshold == model.threshold


def test_detector_keeps(spark, tmp_path):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame(pd.DataFrame({"total_amount": rng.exponential(50, 400), "quantity": rng.integers(1, 6, 400).astype(float),
                                             "transaction_id": [str(i) for i in range(400)]}))
    for kind in ("isolation_forest", "zscore", "iqr", "dbscan"):
        fitted = AnomalyDetector(kind, key=["transaction_id"]).fit(df, ["total_amount", "quantity"])
        fitted.save(spark, f"{tmp_path}/{kind}")
        back = AnomalyDetector.load(spark, f"{tmp_path}/{kind}")
        a = fitted.transform(df).orderBy("transaction_id").select("is_anomaly", "anomaly_score").collect()
        assert a == back.transform(df).orderBy("transaction_id").select("is_anomaly", "anomaly_score").collect()
    single = spark.createDataFrame([(5000.0,)], "total_amount double")
    hit = AnomalyDetector("zscore").fit(df, ["total_amount", "quantity"]).transform(single).first()
    assert hit.is_anomaly == 1 and hit.severity_z == "critical"
    with pytest.raises(RuntimeError):
        AnomalyDetector().transform(df)
    many = MultiDimensionalDetector().add_dimension("a", ["total_amount"], "zscore").add_dimension("bad", ["nothing"], "zscore").fit(df)
    out = many.transform(df)
    assert "bad" in many.errors and {"anomaly_a", "score_a", "anomaly_dimensions"} <= set(out.columns)


def test_explain(spark):
    df = spark.createDataFrame([("1", 100.0, 1.0), ("2", 10.0, 1.0)], "id string, total_amount double, quantity double")
    fitted = stats.ColumnStats({"total_amount": 20.0, "quantity": 5.0}, {"total_amount": 10.0, "quantity": 1.0}, {})
    got = {r.id: r for r in report.explain(df, fitted, ["total_amount", "quantity"]).collect()}
    assert got["1"].summary == "Primary cause: total_amount is higher than normal"
    assert [f.feature for f in got["1"].contributing_factors] == ["total_amount", "quantity"]
    assert got["1"].explanations == ["total_amount is 400.0% higher than expected", "quantity is 80.0% lower than expected"]
    assert got["2"].recommendation == "Low volume despite normal revenue - check pricing"
    assert report.summary(report.breakdown(df.withColumn("is_anomaly", F.lit(0)), __import__("datetime").datetime(2024, 1, 1))).first().message


def daily_frame(spark, n=160, segments=("x",)):
    rng = np.random.default_rng(4)
    rows = []
    for s in segments:
        y = 500 + 50 * np.sin(np.arange(n) / 7) + rng.normal(0, 5, n)
        rows += [(s, date(2024, 1, 1) + timedelta(days=i), float(v), float(i % 7), float(y[i - 1]) if i else 0.0) for i, v in enumerate(y)]
    return spark.createDataFrame(rows, "region string, date date, total_revenue double, day_of_week double, revenue_lag_1 double")


def test_ridge_closed_form(spark):
    df = daily_frame(spark).drop("region")
    model = SalesForecastModel("linear")
    model.prepare_features(df)
    model._fit(df)
    pdf = df.orderBy("date").toPandas()
    x = pdf[model.columns].to_numpy()
    x = (x - x.mean(0)) / x.std(0)
    y = pdf["total_revenue"].to_numpy()
    want = np.linalg.solve(x.T @ x + np.eye(x.shape[1]), x.T @ (y - y.mean()))
    assert np.allclose(model.coefficients, want, rtol=1e-5)


def test_recursion_by_hand(spark):
    df = daily_frame(spark, segments=("x", "y"))
    model = SalesForecastModel("linear", segment=("region",))
    model.train(df)
    got = model.forecast(df, 3).filter("region = 'y'").orderBy("step").toPandas()
    pdf = df.filter("region = 'y'").orderBy("date").toPandas()
    values, day = list(pdf["total_revenue"]), pdf["date"].max()
    for i in range(3):
        day += timedelta(days=1)
        raw = {"day_of_week": day.weekday(), "revenue_lag_1": values[-1]}
        x = [(raw[c] - model.scaler.means[c]) / model.scaler.stds[c] for c in model.columns]
        p = float(np.dot(x, model.coefficients) + model.intercept)
        half = 1.96 * 0.1 * np.std(values, ddof=1)
        assert abs(got["value"][i] - p) < 1e-6 and abs(got["confidence_upper"][i] - p - half) < 1e-6
        values.append(p)
    assert got["date"].iloc[-1] == day


def test_forest_model(spark, tmp_path):
    df = daily_frame(spark).drop("region")
    model = SalesForecastModel("random_forest", params=SMALL_FOREST, parallelism=3)
    scores = model.train(df)
    assert set(scores) == {"rmse", "mae", "mape", "r2", "direction_accuracy"} and scores["mape"] < 20
    rows = model.predict_rows(df, confidence=True).toPandas()
    assert (rows["confidence_lower"] <= rows["prediction"]).all() and (rows["std"] >= 0).all()
    assert abs(sum(v for _, v in model.importances) - 1) < 1e-6
    model.save(spark, f"{tmp_path}/m")
    back = SalesForecastModel.load(spark, f"{tmp_path}/m")
    assert back.forecast(df, 4).collect() == model.forecast(df, 4).collect()
    assert model.forecast(df, 30).count() == 30
    with pytest.raises(ValueError):
        model.forecast(df, 99)
    with pytest.raises(RuntimeError):
        SalesForecastModel().forecast(df)


def test_boosting_export_agrees_with_spark(spark):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor
    df = daily_frame(spark, 60).drop("region")
    model = SalesForecastModel("gradient_boosting", params={"maxIter": 5, "maxDepth": 3}, exact=False)
    model.prepare_features(df)
    model._fit(df)
    v = VectorAssembler(inputCols=model.columns, outputCol="features").transform(model.scaler.transform(df))
    v = v.withColumnRenamed("total_revenue", "label").select("date", "features", "label").coalesce(1)
    ours = model.predict_rows(df).orderBy("date").toPandas()["prediction"]
    theirs = GBTRegressor(seed=42, maxIter=5, maxDepth=3, stepSize=0.1).fit(v).transform(v).orderBy("date").toPandas()["prediction"]
    assert np.allclose(ours, theirs)


def test_ar_recovers_coefficients(spark):
    rng = np.random.default_rng(8)
    phi, d = np.array([0.5, -0.3]), [0.0, 0.0]
    for _ in range(3_000):
        d.append(phi @ [d[-1], d[-2]] + rng.normal())
    y = 1000 + np.cumsum(d)
    pdf = pd.DataFrame({"date": [date(2000, 1, 1) + timedelta(days=i) for i in range(len(y))], "total_revenue": y})
    fitted = autoregression.fit(spark.createDataFrame(pdf), p=2)
    row = fitted.first()
    assert np.allclose(row.phi, phi, atol=0.05) and abs(row.sigma2 - 1) < 0.1
    ahead = autoregression.forecast(fitted, 3).orderBy("step").toPandas()
    assert (ahead["confidence_upper"] - ahead["confidence_lower"]).is_monotonic_increasing


@pytest.mark.parametrize("phi", [[0.5, -0.3], [0.95], [-0.7, 0.1, 0.2]])
def test_exact_likelihood_is_that_of_the_whole_covariance(spark, phi):
    """Against the Gaussian density with the stationary covariance, and against all neighbours of the estimate."""
    rng, p = np.random.default_rng(3), len(phi)
    d = [0.0] * p
    for _ in range(300):
        d.append(np.dot(phi, d[::-1][:p]) + rng.normal())
    d = np.array(d[-60:])
    y = 500 + np.cumsum(np.append(0, d))
    days = pd.DataFrame({"date": [date(2000, 1, 1) + timedelta(days=i) for i in range(len(y))], "total_revenue": y})

    def dense(c):
        steps = [1.0]
        for _ in range(3_000):
            steps.append(np.dot(c[:len(steps)], steps[::-1][:p]))
        steps = np.array(steps)
        lags = np.array([steps[:len(steps) - k] @ steps[k:] for k in range(len(d))])
        v = lags[np.abs(np.subtract.outer(range(len(d)), range(len(d))))]
        s2 = d @ np.linalg.solve(v, d) / len(d)
        return -0.5 * (len(d) * (np.log(2 * np.pi * s2) + 1) + np.linalg.slogdet(v)[1]), s2
    frame = spark.createDataFrame(days)
    near = [list(np.array(phi) * f) for f in (1.0, 0.5, 0.9)]
    for r in autoregression.likelihoods(frame, near).collect():
        assert r.n == 60 and np.allclose([r.loglik, r.sigma2], dense(np.array(near[r.candidate])), rtol=1e-8)
    best = autoregression.fit(frame, p, exact=True).first()
    top = dense(np.array(best.phi))[0]
    assert np.isclose((2 * (p + 1) - best.aic) / 2, top) and np.isclose(best.sigma2, dense(np.array(best.phi))[1])
    for k in range(p):
        for step in (-1e-3, 1e-3):
            moved = np.array(best.phi)
            moved[k] += step
            if autoregression.partial_autocorrelations(moved) is not None:
                assert dense(moved)[0] <= top
    with pytest.raises(ValueError):
        autoregression.likelihoods(frame, [[1.2]])


def test_ensemble(spark):
    weights = ensemble.weights_from_mape(spark.createDataFrame([("a", 10.0), ("b", 30.0), ("c", None)], "model string, mape double"))
    got = {r.model: r.weight for r in weights.collect()}
    assert np.isclose(got["a"], 0.75) and np.isclose(got["b"], 0.25) and np.isclose(got["c"], 1 / 3)
    f = spark.createDataFrame([("a", date(2024, 1, 1), 10.0), ("b", date(2024, 1, 1), 20.0)], "model string, date date, value double")
    row = ensemble.combine(f, weights).first()
    assert np.isclose(row.value, 12.5) and np.isclose(row.confidence_upper, 12.5 + 1.96 * 5) and row.individual == {"a": 10.0, "b": 20.0}


def test_metrics(spark):
    y, p = [1.0, 2.0, 0.0, 4.0], [1.5, 1.0, 1.0, 5.0]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(y, p))], "date int, y double, p double")
    m = evaluate.metrics(df, "y", "p").first()
    assert np.isclose(m.rmse, np.sqrt((0.25 + 1 + 1 + 1) / 4)) and np.isclose(m.mape, (0.5 + 0.5 + 0.25) / 3 * 100)
    assert np.isclose(m.direction_accuracy, 100 / 3)

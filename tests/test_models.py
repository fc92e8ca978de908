import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from fieldspark.config import ForestConfig, ScoreConfig
from fieldspark.functions.columns import hyperbolic_rate, severity
from fieldspark.operators import anomaly, decline, features, forecast, iforest, intervals, metrics, portfolio, scoring
from fieldspark.operators.ranking import global_rank
from fieldspark.plans.analysis import analyze


def rate(qi, di, b, t):
    return qi * math.exp(-di * t) if b < 1e-4 else qi / (1 + b * di * t) ** (1 / b)


def panel(spark, series: dict, expected=None):
    rows = []
    for a, ys in series.items():
        for t, y in enumerate(ys):
            rows.append((a, f"{2020 + t // 12}-{t % 12 + 1:02d}-01", t, float(y), float(expected[a][t]) if expected else None))
    return spark.createDataFrame(rows, "asset_id string, period string, t int, actual double, expected double").withColumn(
        "period", F.col("period").cast("date"))


def test_decline_fit_recovers_parameters(spark):
    rng = random.Random(1)
    noisy = [rate(5000, 0.05, 0.6, t) * (1 + rng.gauss(0, 0.01)) for t in range(36)]
    clean = [rate(4000, 0.04, 0.6, t) for t in range(24)]
    steep = [10000 * 0.5 ** t for t in range(12)]
    out = {r.asset_id: r for r in decline.fit_quality(decline.fit_decline(panel(spark, {"n": noisy, "c": clean, "s": steep}))).collect()}
    assert out["c"].qi == pytest.approx(4000, rel=0.02) and out["c"].di == pytest.approx(0.04, rel=0.1)
    assert out["n"].r_squared > 0.98 and out["c"].confidence >= out["n"].confidence
    assert 1e-4 <= out["s"].di <= 0.9 and 0 <= out["s"].b <= 1 and out["s"].r_squared > 0.95


def test_bad_series_are_set_aside(spark):
    p = panel(spark, {"short": [5, 4, 3, 2], "zero": [5, 4, 0, 3, 2, 1], "ok": [6, 5, 4, 3, 2, 1]})
    good, bad = decline.usable_series(decline.series_arrays(p))
    assert [r.asset_id for r in good.collect()] == ["ok"] and {r.asset_id for r in bad.collect()} == {"short", "zero"}


def test_horizon_rates_fall(spark):
    fits = decline.fit_decline(panel(spark, {"c": [rate(4000, 0.04, 0.6, t) for t in range(24)]}))
    r = decline.horizon_rates(fits, (F.col("n") - 1).cast("double")).first()
    assert r.rate_30d > r.rate_90d > r.rate_180d > r.rate_365d and 0 <= r.current_decline_pct < 20


def test_exponential_limit(spark):
    r = spark.range(1).select(hyperbolic_rate(F.lit(100.0), F.lit(0.1), F.lit(0.0), F.lit(5.0)).alias("e"),
                              hyperbolic_rate(F.lit(100.0), F.lit(0.1), F.lit(1.0), F.lit(5.0)).alias("h")).first()
    assert r.e == pytest.approx(100 * math.exp(-0.5)) and r.h == pytest.approx(100 / 1.5)


CASES = [  # expected, actual, score, complexity
    (10000, 9900, 0.10, 0.30, "LOW"), (1420000, 1170000, 0.94, 0.60, None)]


def scored(spark, rows, config=ScoreConfig()):
    df = spark.createDataFrame([(f"A{i}", float(e), float(a), s, c) for i, (e, a, s, c, *_) in enumerate(rows)],
                               "asset_id string, expected double, actual double, anomaly_score double, complexity double")
    return scoring.priority_score(scoring.recovery(df, config), config)


def test_golden_scores(spark):
    low, ref = scored(spark, CASES).orderBy("asset_id").collect()
    assert low.priority == "LOW"
    assert ref.loss_part == pytest.approx(5.28, abs=0.01) and ref.anomaly_part == pytest.approx(23.5)
    assert ref.complexity_part == pytest.approx(-6.0) and ref.raw_score == pytest.approx(27.22, abs=0.01) and ref.priority == "CRITICAL"
    other = scored(spark, CASES[1:], ScoreConfig(recovery_rate=0.8889)).first()
    assert other.raw_score == pytest.approx(27.72, abs=0.01) and other.score == pytest.approx(92.4, abs=0.05)


def test_score_edges(spark):
    rows = scored(spark, [(10000, 10500, 0.2, 0.2), (10000, 5000, 0.1, 0.2), (0, 0, 0.0, 1.5)]).orderBy("asset_id").collect()
    assert rows[0].warnings == ["NO_GAP"] and rows[0].recovery_volume == 0
    assert rows[1].warnings == ["LOSS_WITHOUT_ANOMALY"] and all(0 <= r.score <= 100 for r in rows)


def test_recommendation_codes(spark):
    df = scored(spark, [(10000, 8000, 0.92, 0.95), (10000, 9960, 0.1, 0.2)]).withColumns({
        "deviation_pct": (F.col("actual") - F.col("expected")) / F.col("expected") * 100, "severity": severity(F.col("anomaly_score"))})
    a, b = scoring.recommend(df).orderBy("asset_id").collect()
    codes = [r.code for r in a.recommendations]
    assert codes == sorted(codes) and {"INVESTIGATE_DEVIATION", "VERIFY_OPERATIONAL_PARAMETERS", "FIELD_VERIFICATION_RECOMMENDED",
                                       "COMPLEXITY_FEASIBILITY_REVIEW"} <= set(codes)
    assert [r.code for r in b.recommendations] == ["MONITOR_ASSET"]
    for r in a.recommendations:
        clean = spark.range(1).select(scoring.sanitize_text(F.lit(r.action)).alias("t")).first().t
        assert clean == r.action


@pytest.mark.parametrize("text, hit", [("VALVE  failure", True), ("Confirmed", True), ("pump check", False)])
def test_sanitize(spark, text, hit):
    out = spark.range(1).select(scoring.sanitize_text(F.lit(text)).alias("t")).first().t
    assert (out == scoring.NEUTRAL) is hit


def injected():
    exp = [5000 * 0.97 ** t for t in range(36)]
    return exp, [v * (0.85 if t >= 30 else 1.0) for t, v in enumerate(exp)]


def test_detector_flags_the_injected_months(spark):
    exp, act = injected()
    p = panel(spark, {"A": act}, {"A": exp})
    out = anomaly.detector_scores(p, ForestConfig(trees=20))
    assert {r.t for r in anomaly.detect_windows(out).collect()} >= set(range(30, 36))
    ev = anomaly.evaluate_detector(out).first()
    assert ev.tp + ev.fp + ev.fn + ev.tn == 36 and ev.recall == 1.0 and 0 <= ev.roc_auc <= 1


def test_short_series_get_no_forest_but_the_rule(spark):
    p = panel(spark, {"A": [5.0] * 10 + [4.0]}, {"A": [5.0] * 11})
    out = anomaly.detector_scores(p, ForestConfig(trees=3)).orderBy("t").collect()
    assert len(out) == 11 and {r.score_reason for r in out} == {"TOO_FEW_ROWS"} and all(r.iso_score is None for r in out)
    assert [r.anomaly_score for r in out[:-1]] == [0.0] * 10 and out[-1].anomaly_score == pytest.approx(1.0)


def test_rows_outside_every_sample_are_scored(spark):
    exp = [100.0] * 300
    act = [100.0 + (i * 7919) % 13 for i in range(299)] + [400.0]
    p = panel(spark, {"A": act, "B": act[:40]}, {"A": exp, "B": exp[:40]})
    cfg = ForestConfig(trees=5, sample=32)
    out = anomaly.detector_scores(p, cfg)
    rows = out.collect()
    assert len(rows) == 340 and all(r.raw_score is not None and r.score_reason is None for r in rows)
    feats = features.anomaly_features(p)
    forest = iforest.pack(iforest.grow_nodes(feats, "t", anomaly.FEATURES, config=cfg), config=cfg)
    walked = {(r.asset_id, r.t): r.raw_score for r in iforest.score_rows(feats, forest, anomaly.FEATURES, config=cfg).collect()}
    assert all(r.raw_score == pytest.approx(walked[r.asset_id, r.t], abs=1e-9) for r in rows)


def _forest_input(spark):
    rng = random.Random(5)
    rows = [("A", i, rng.gauss(0, 1), rng.gauss(0, 1)) for i in range(200)] + [("A", 200, 9.0, 9.0)] + [("B", 0, 1.0, 1.0)]
    return spark.createDataFrame(rows, "asset_id string, t int, x double, y double")


def test_forest_ranks_an_outlier_first(spark):
    cfg = ForestConfig(trees=25, sample=64)
    df = _forest_input(spark)
    forest = iforest.pack(iforest.grow_nodes(df, "t", ["x", "y"], config=cfg, presample=True), config=cfg)
    top = iforest.score_rows(df, forest, ["x", "y"], config=cfg).where("asset_id = 'A'").orderBy(F.desc("raw_score")).first()
    assert top.t == 200 and 0.5 < top.raw_score <= 1


def test_tree_samples_are_the_smallest_hashes_whatever_the_bound(spark):
    cfg = ForestConfig(trees=5, sample=12)
    rows = [("A", str(i)) for i in range(700)] + [("B", str(i)) for i in range(7)] + [(None, str(i)) for i in range(40)]
    df = spark.createDataFrame(rows, "asset_id string, _rk string")
    want = set()
    for key in ("A", "B", None):
        for tree in range(1, 6):
            ranked = sorted((hashlib.md5(f"{cfg.seed}:{tree}:{r}".encode()).hexdigest(), r) for k, r in rows if k == key)
            want |= {(key, tree, r) for _, r in ranked[:12]}
    for expected in (None, 2.0, 0.01):  # the last two have to widen
        got = iforest.tree_samples(df, ["asset_id"], cfg, expected).collect()
        assert len(got) == len(want) and {(r.asset_id, r.tree, r._rk) for r in got} == want
    pooled = iforest.tree_samples(df.where("asset_id = 'A'").select("_rk"), [], cfg, 3.0).collect()
    assert {("A", r.tree, r._rk) for r in pooled} == {w for w in want if w[0] == "A"}
    assert iforest.tree_samples(df.limit(0), ["asset_id"], cfg).count() == 0
    assert iforest.tree_samples(df.limit(0).select("_rk"), [], cfg).count() == 0


def test_forest_does_not_depend_on_partitioning(spark):
    cfg = ForestConfig(trees=4, sample=32)
    df = _forest_input(spark)
    results = []
    for d, pre in ((df.coalesce(1), False), (df.repartition(8, "x").orderBy("y"), True)):
        grown = iforest.grow(d, "t", ["x", "y"], config=cfg, presample=pre)
        results.append(sorted(tuple(r) for r in grown.select("asset_id", "tree", "t", "node", "depth", "size").collect()))
    assert results[0] == results[1] and max(r[5] for r in results[0]) >= 1
    sizes = {}
    for a, tree, *_ in results[0]:
        sizes[(a, tree)] = sizes.get((a, tree), 0) + 1
    assert all(n == 32 for (a, _), n in sizes.items() if a == "A")


def test_auc_against_pairs(spark):
    rng = random.Random(2)
    rows = [("g" if i % 3 else "h", rng.random() < 0.4, round(rng.random(), 2)) for i in range(300)] + [("one", True, 0.5)]
    df = spark.createDataFrame(rows, "k string, y boolean, s double")
    got = {r.k: r.roc_auc for r in metrics.auc(df, "y", "s", ["k"]).collect()}
    for k in ("g", "h"):
        pos = [s for kk, y, s in rows if kk == k and y]
        neg = [s for kk, y, s in rows if kk == k and not y]
        want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
        assert got[k] == pytest.approx(want)
    assert got["one"] == 0.5
    assert metrics.auc(df, "y", "s", ["k"], bins=3).where("k = 'g'").first().roc_auc == pytest.approx(got["g"])


def test_interval_cover_against_brute_force(spark):
    rng = random.Random(4)
    rows = [("A" if rng.random() < 0.7 else "B", rng.randint(0, 300)) for _ in range(300)]
    known = [("A" if rng.random() < 0.7 else "B", float(s), float(s + rng.randint(-1, 40))) for s in (rng.randint(0, 300) for _ in range(25))]
    out = intervals.mark_covered(spark.createDataFrame(rows, "k string, t int"), spark.createDataFrame(known, "k string, s double, e double"),
                                 ("k",), "t", "s", "e", 7.0).collect()
    assert len(out) == len(rows)
    for r in out:
        assert r.covered == any(k == r.k and s <= r.t <= e for k, s, e in known)


def test_interval_cover_of_very_long_intervals_and_nulls(spark):
    rng = random.Random(6)
    rows = [(rng.choice(["A", "B", None]), rng.choice([None, rng.randint(-50, 10 ** 9)]), i) for i in range(400)]
    rows += [("A", 5 * 10 ** 8, 1000 + i) for i in range(3)]  # repeated rows stay
    known = [("A", -40.0, 2.0), ("A", 10.0, 9.0), ("A", 4e8, 6e8), ("A", 4.5e8, 4.6e8), ("B", 7e8, 7e8 + 1), ("B", None, 1e9),
             (None, 0.0, 1e9)]
    df = spark.createDataFrame(rows, "k string, t long, `a.b` int")
    out = intervals.mark_covered(df, spark.createDataFrame(known, "k string, s double, e double"), ("k",), "t", "s", "e", 16.0).collect()
    assert sorted(r["a.b"] for r in out) == sorted(i for _, _, i in rows)
    for r in out:
        assert r.covered == any(r.k is not None and r.t is not None and k == r.k and s is not None and s <= r.t <= e for k, s, e in known)
    empty = intervals.mark_covered(df, spark.createDataFrame([], "k string, s double, e double"), ("k",), "t", "s", "e", 16.0)
    assert empty.where("covered").count() == 0 and empty.count() == len(rows)
    assert intervals.mark_covered(df.limit(0), spark.createDataFrame(known, "k string, s double, e double"), ("k",), "t", "s", "e", 16.0).count() == 0


def test_global_rank_is_dense_under_ties(spark):
    df = spark.range(5000).select(F.concat(F.lit("A-"), F.lpad(F.col("id").cast("string"), 5, "0")).alias("a"), F.when(F.col("id") % 3 == 0, 0.0).otherwise(F.col("id") * 1.0).alias("s"))
    out = global_rank(df, [F.col("s").desc(), F.col("a").asc()]).toPandas().sort_values("rank")
    assert list(out["rank"]) == list(range(1, 5001))
    want = df.toPandas().sort_values(["s", "a"], ascending=[False, True])
    assert list(out.a) == list(want.a)


def test_rollout_and_points(spark):
    state = spark.createDataFrame([("A", [10.0] * 20, 10.0, 0.01, 0.5, 2.0)], "asset_id string, series array<double>, qi double, di double, b double, residual_std double")
    pts = forecast.forecast_points(forecast.rollout(state, 6), 6).orderBy("step").collect()
    assert [p.step for p in pts] == list(range(1, 7)) and [p.day for p in pts] == [30, 61, 91, 122, 152, 183]
    assert all(0 <= p.lower <= p.forecast <= p.upper for p in pts)
    w = 0.35 * min(1 / 3, 1.5)
    assert pts[0].forecast == pytest.approx((1 - w) * 10 + w * rate(10, 0.01, 0.5, 20))
    with pytest.raises(ValueError):
        forecast.forecast_slice(state, 45)


def test_backtest_has_no_pairs_without_actuals(spark):
    p = panel(spark, {"A": [rate(5000, 0.05, 0.6, t) for t in range(36)]})
    pairs = forecast.backtest_pairs(p).collect()
    assert {r.horizon_days for r in pairs} == {30, 90, 180}
    assert all(r.cut + {30: 1, 90: 3, 180: 6}[r.horizon_days] - 1 <= 35 for r in pairs)
    m = {r.horizon_days: r for r in forecast.backtest_metrics(forecast.backtest_pairs(p)).collect()}
    assert m[30].folds == 13 and m[None].folds == 13 + 11 + 8 and m[30].mape < 15


def test_status_overlay_rejects_unknown_states(spark):
    an = spark.createDataFrame([("A", 1), ("B", 1)], "asset_id string, period int")
    ev = spark.createDataFrame([("A", 1, "RESOLVED", 1), ("A", 1, "GONE", 2)], "asset_id string, period int, status string, event_ts int")
    out, rejected = portfolio.apply_status_events(an, ev)
    assert {r.asset_id: r.status for r in out.collect()} == {"A": "RESOLVED", "B": "UNACKNOWLEDGED"} and rejected.count() == 1


def test_analysis_keeps_every_asset_and_tests_the_forecaster_in_use(spark):
    noisy = random.Random(3)
    series = {"A": [5000 * 0.96 ** t * noisy.uniform(0.9, 1.1) for t in range(40)], "B": [300 * 0.97 ** t for t in range(11)]}
    p = panel(spark, series, {k: list(v) for k, v in series.items()})
    assets = spark.createDataFrame([(k, "f", "b", "ACTIVE", 2000, 1e5, 5000.0, 0.04, 0.6) for k in series],
                                   "asset_id string, field_name string, basin string, status string, onstream_year int, intervention_cost double, qi double, di double, b double")
    run = lambda **kw: {r.asset_id: r for r in analyze(p, assets, forest=ForestConfig(trees=3), trees=3, **kw).collect()}
    kept, boosted = run(), run(base="gbt", origins=[30])
    assert set(kept) == set(boosted) == {"A", "B"} and kept["B"].backtest is None
    assert kept["A"].backtest.mae != boosted["A"].backtest.mae and boosted["A"].backtest_horizons


def test_model_backtest_covers_each_assets_own_last_third(spark):
    noisy = random.Random(4)
    lengths = {"L": 50, "S": 33, "XS": 12}
    series = {k: [(400 + 50 * i) * 0.98 ** t * noisy.uniform(0.9, 1.1) for t in range(n)] for i, (k, n) in enumerate(lengths.items())}
    p = panel(spark, series, {k: list(v) for k, v in series.items()})
    assert forecast.shared_origins(p) == [21, 27, 33, 39, 45]
    cuts = {(r.asset_id, r.cut) for r in forecast.backtest_model(p, trees=1).collect()}
    assert cuts == {("S", 21), ("S", 27), ("L", 33), ("L", 39), ("L", 45)}
    assert forecast.backtest_model(p.where("asset_id = 'XS'"), trees=1).count() == 0
    assets = spark.createDataFrame([(k, "f", "b", "ACTIVE", 2000, 1e5, 5000.0, 0.04, 0.6) for k in series],
                                   "asset_id string, field_name string, basin string, status string, onstream_year int, intervention_cost double, qi double, di double, b double")
    out = {r.asset_id: r.backtest for r in analyze(p, assets, base="gbt", trees=1, forest=ForestConfig(trees=2)).collect()}
    assert out["L"].folds and out["S"].folds and out["XS"] is None


def test_pooled_fit_deals_many_rows_evenly_and_pins_them(spark, monkeypatch):
    from checks import forecasting

    few, cores = forecast.FEW_ROWS, 12
    assert forecast.fit_tasks(few, cores) == 1 and forecast.fit_tasks(few + 1, cores) == cores
    assert forecast.fit_tasks(25_000_000, cores) == 36  # whole waves

    series = {f"A-{i}": [100.0 - t + i for t in range(30 if i else 90)] for i in range(9)}
    given = panel(spark, series).repartition(2, "asset_id")
    assets = spark.createDataFrame([(a, 100.0, 0.01, 0.5, 1.0, 2000) for a in series], "asset_id string, qi double, di double, b double, intervention_cost double, onstream_year int")
    monkeypatch.setattr(forecasting.b, "monthly", lambda *_: given)
    monkeypatch.setattr(forecasting.b, "assets", lambda *_: assets)
    seen = []
    real = forecast.GBTRegressor.fit
    monkeypatch.setattr(forecast.GBTRegressor, "fit", lambda self, df: seen.append(df) or real(self.setMaxIter(2), df))
    monkeypatch.setattr(forecast, "FEW_ROWS", 10)
    _, rows, model = forecasting.gbt(spark, "")
    assert "Scan ExistingRDD" in rows._jdf.queryExecution().toString() and model.getNumTrees == 2
    sizes = [len(p) for p in seen[0].rdd.glom().collect()]
    cores = spark.sparkContext.defaultParallelism
    assert sum(sizes) == rows.count() == 77 + 8 * 17 and len(sizes) == cores and max(sizes) - min(sizes) <= rows.rdd.getNumPartitions()

"""Fitted detectors: the stored trees are those of the forest, scores of new rows are on the stored scale."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldspark.config import ForestConfig
from fieldspark.functions import isolation
from fieldspark.operators import anomaly, features, iforest
from tests.test_models import injected, panel


def series(n, seed):
    r = random.Random(seed)
    return [100 * 0.99 ** t * r.uniform(0.9, 1.1) for t in range(n)]


def test_flat_trees_against_a_walk_by_node_names():
    r = np.random.default_rng(1)
    x, extra = r.normal(size=(60, 3)), np.linspace(0, 3, 33)
    tree, row = isolation.sample_rows([str(i) for i in range(60)], [3, 5, 9], 32, 7)
    node, depth, size, splits = isolation.grow(x, tree, row, 5, "k:")
    flat = isolation.flatten(tree, node, depth, size, splits, extra)
    inner = {(t, n): (f, c) for t, n, f, c in splits}
    leaf = {(int(t), int(n)): d + extra[s] for t, n, d, s in zip(tree, node, depth, size, strict=True)}
    want = []
    for v in np.concatenate([x, 10 * x]):
        total = 0.0
        for t in (3, 5, 9):
            n = 1
            while (t, n) in inner:
                f, c = inner[t, n]
                n = 2 * n + (v[f] >= c)
            total += leaf.get((t, n), np.floor(np.log2(n)))
        want.append(total)
    assert flat.path_sums(np.concatenate([x, 10 * x]), 5) == pytest.approx(want, rel=1e-12)
    assert np.array_equal(flat.path_sums(x, 5), flat.path_sums(x, 5, block=10))


@pytest.mark.parametrize("cfg", [ForestConfig(trees=12, sample=256), ForestConfig(trees=9, sample=16), ForestConfig(trees=3, sample=16, leaf_correction=False)])
def test_model_scores_equal_the_packed_forest(spark, cfg):
    p = panel(spark, {"A": series(60, 1), "B": series(30, 2)}, {"A": [100.0] * 60, "B": [90.0] * 30})
    feats = features.anomaly_features(p)
    forest = iforest.pack(iforest.grow_nodes(feats, "t", anomaly.FEATURES, config=cfg), config=cfg)
    want = {(x.asset_id, x.t): x.raw_score for x in iforest.score_rows(feats, forest, anomaly.FEATURES, config=cfg).collect()}
    model = iforest.fit_model(feats, "t", anomaly.FEATURES, config=cfg)
    for slices in (None, F.floor(F.col("t") / 7)):
        got = {(x.asset_id, x.t): x.raw_score for x in iforest.score_model(feats, model, "t", anomaly.FEATURES, config=cfg, slices=slices).collect()}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
    presampled = iforest.fit_model(feats, "t", anomaly.FEATURES, config=cfg, presample=True)
    again = {(x.asset_id, x.t): x.raw_score for x in iforest.score_model(feats, presampled, "t", anomaly.FEATURES, config=cfg).collect()}
    assert all(again[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_fitted_detector_scores_later_months_on_its_own_scale(spark, tmp_path):
    exp, act = injected()
    p = panel(spark, {"A": act, "N": act[:10]}, {"A": exp, "N": exp[:10]})
    cfg = ForestConfig(trees=30)
    anomaly.fit_detector(p.where("t < 30"), cfg, version="2026-01").write.parquet(str(tmp_path / "model"))
    model = spark.read.parquet(str(tmp_path / "model"))
    assert {x.asset_id for x in model.collect()} == {"A"} and model.select("version").distinct().first()[0] == "2026-01"
    out = {(x.asset_id, x.t): x for x in anomaly.score_with(p, model, cfg).collect()}
    assert len(out) == 46 and all(out["N", t].score_reason == "NO_MODEL" and out["N", t].raw_score is None for t in range(10))
    assert all(out["A", t].anomaly_score >= 0.5 for t in range(30, 36))
    one = {x.t: x for x in anomaly.score_with(p.where("asset_id = 'A' AND t BETWEEN 31 AND 33"), model, cfg).collect()}
    assert one[33].iso_score == out["A", 33].iso_score  # a row's score depends on the model and on its own look-back alone
    fitted = {(x.asset_id, x.t): x.iso_score for x in anomaly.detector_scores(p.where("t < 30"), cfg).collect()}
    assert all(out["A", t].iso_score == pytest.approx(fitted["A", t], abs=1e-9) for t in range(30))


def test_detector_of_nothing(spark):
    p = panel(spark, {"A": series(20, 3)}, {"A": [100.0] * 20})
    assert anomaly.fit_detector(p.limit(0), ForestConfig(trees=2)).count() == 0
    model = anomaly.fit_detector(p, ForestConfig(trees=2))
    assert anomaly.score_with(p.limit(0), model, ForestConfig(trees=2)).count() == 0


def test_rows_of_a_small_key_go_once_and_leaves_give_the_walk(spark, monkeypatch, tmp_path):
    r = np.random.default_rng(3)
    x, extra = r.normal(size=(50, 3)), np.linspace(0, 3, 65)
    tree, row = isolation.sample_rows([str(i) for i in range(50)], [2, 4, 7], 64, 7)
    grown = isolation.grow(x, tree, row, 6, "k:")
    sums, trees = isolation.path_sums(x, tree, row, *grown, 6, extra)
    assert trees == 3 and np.array_equal(sums, isolation.flatten(tree, *grown, extra).path_sums(x, 6))
    feats = features.anomaly_features(panel(spark, {"A": series(60, 1), "B": series(30, 2)}, {"A": [100.0] * 60, "B": [90.0] * 30}))
    cfg, real, place = ForestConfig(trees=20, sample=40), isolation.sample_rows, str(tmp_path / "calls")
    want = {(x.asset_id, x.t): x.raw_score for x in iforest.score_rows(
        feats, iforest.pack(iforest.grow_nodes(feats, "t", anomaly.FEATURES, config=cfg), config=cfg), anomaly.FEATURES, config=cfg).collect()}

    def noted(row_keys, trees, sample, seed):
        with open(place, "a") as f:
            f.write(f"{len(row_keys)} {len(trees)}\n")
        return real(row_keys, trees, sample, seed)

    monkeypatch.setattr(isolation, "sample_rows", noted)
    got = {(x.asset_id, x.t): x.raw_score for x in iforest.score_every(feats, "t", anomaly.FEATURES, config=cfg).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
    calls = sorted(tuple(map(int, c.split())) for c in open(place).read().splitlines())
    big = max(n for n, _ in calls)  # more rows than a sample: a task for each tree group
    assert [t for n, t in calls if n < big] == [20] and sorted(t for n, t in calls if n == big) == [2, 2, 2, 2, 3, 3, 3, 3]

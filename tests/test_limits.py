"""Inputs beyond former limits, and inputs that used to give wrong answers."""

import numpy as np
import pytest

from tabloom.operators import dates, neighbors, outliers
from tabloom.operators.metrics.reduction import component_correlation, component_histograms, eigenvalue_spectrum
from tabloom.operators.models import graphs, linear, trees
from tabloom.operators.tuning import DISTRIBUTIONS, GRIDS, grid_search
from tabloom.plans.lineage import lineage_path, lineage_roots


def test_a_stray_text_does_not_switch_dates_off(spark):
    rows = [(i, f"2024-01-{i % 28 + 1:02d}") for i in range(98)] + [(98, "1234567"), (99, "x" * 200)]
    out, found = dates.convert_dates(spark.createDataFrame(rows, "id int, day string"))
    assert found == ["day"] and out.where("day is null").count() == 2
    plain = spark.createDataFrame([(str(20240101 + i),) for i in range(20)], "n string")
    assert dates.date_columns(plain) == []


def test_paths_of_any_length_and_cycles(spark):
    chain = spark.createDataFrame([(i, i - 1 if i else None) for i in range(160)], "id long, source_dataset_id long")
    path = {r.id: r.depth for r in lineage_path(chain, 159).collect()}
    assert path == {i: 159 - i for i in range(160)}
    cycle = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 4), (5, 5), (5, None)], "id long, source_dataset_id long")
    assert {r.id: r.depth for r in lineage_path(cycle, 1).collect()} == {1: 0, 2: 1, 3: 2}
    with pytest.raises(ValueError, match="own ancestor"):
        lineage_roots(cycle)
    twice = spark.createDataFrame([(1, None), (2, 1), (2, 1)], "id long, source_dataset_id long")
    assert sorted(tuple(r) for r in lineage_roots(twice).collect()) == [(1, 1, 0), (2, 1, 1)]


def test_unknown_and_correlation_distances(spark):
    r = np.random.default_rng(0)
    x = r.normal(size=(40, 5))
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "id int, a double, b double, c double, d double, e double")
    with pytest.raises(ValueError, match="unknown metric"):
        neighbors.nearest(df, df, "id", list("abcde"), 3, "nonsense")
    found = neighbors.nearest(df, df, "id", list("abcde"), 3, "correlation", exclude_self=True).collect()
    want = 1 - np.corrcoef(x)
    np.fill_diagonal(want, np.inf)
    for row in found:
        assert row.distance == pytest.approx(np.sort(want[row.left_key])[row["rank"] - 1], abs=1e-9)


def test_perplexity_ignores_incomplete_rows(spark):
    rows = [(i, float(i % 7), None if i % 4 == 0 else float(i)) for i in range(60)]
    graph = graphs.perplexity_graph(spark.createDataFrame(rows, "id int, a double, b double"), "id", ["a", "b"], 5.0)
    assert graph.agg({"p": "sum"}).first()[0] == pytest.approx(1.0, abs=1e-9)


def test_forest_removal_keeps_repeated_keys(spark):
    rows = [(i % 20, float(i % 11)) for i in range(240)] + [(3, 900.0)]
    df = spark.createDataFrame(rows, "id int, v double")
    kept = outliers.handle_outliers(df, "isolation_forest", "remove", 0.01, ["v"], "id")
    assert 200 < kept.count() <= 240 and kept.where("v > 100").count() == 0


def test_search_survives_failing_trials(spark):
    df = spark.createDataFrame([(i, float(i % 5), float(i % 2)) for i in range(60)], "id int, x double, k double")
    found = grid_search(df, "naive_bayes", ["x"], "k", "id", {"var_smoothing": [1e-9, "broken"]}, cv=2)
    rows = {r["rank"]: r for r in found.trials.collect()}
    assert len(rows) == 2 and rows[2].mean_score is None and rows[1].mean_score == found.best_score
    for space in (GRIDS, DISTRIBUTIONS):
        assert "sigmoid" not in space["svm_classifier"]["kernel"]


def test_wide_inputs_are_not_cut(spark):
    names = [f"c{i}" for i in range(12)]
    df = spark.createDataFrame([tuple(float((i * (j + 2)) % (j + 5)) for j in range(12)) for i in range(30)], ", ".join(f"{n} double" for n in names))
    assert component_correlation(df, names).count() == 144
    assert {r[0] for r in component_histograms(df, names, 4).collect()} == set(names)
    assert component_histograms(df, names, 4, limit=2).select(component_histograms(df, names, 4).columns[0]).distinct().count() == 2
    assert eigenvalue_spectrum(df, names).count() == 12 and eigenvalue_spectrum(df, names, 3).count() == 3


def test_solver_and_depth_choices():
    assert linear._solver(["x"] * 4096) == "normal" and linear._solver(["x"] * 5000) == "l-bfgs"
    for depth in (0, -1):
        rule = trees.lightgbm_settings(max_depth=depth)["rule"]
        assert rule.leaves == 31 and rule.open(1000, 1e9, 10**9)

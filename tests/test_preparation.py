"""Cleaning, encoding, outliers and scoring on edge inputs."""

import pytest
from pyspark.sql import functions as F

from tabloom.functions.names import match_names, rename_to
from tabloom.functions.parsing import epoch_seconds, to_moment, to_number
from tabloom.operators import missing, outliers, profiling, scaling, selection
from tabloom.operators.construct import polynomial_features
from tabloom.operators.encoding import fit_auto_encoding, fit_encoder
from tabloom.operators.metrics import classification, regression
from tabloom.operators.metrics.common import histogram
from tabloom.operators.split import train_test, with_fold
from tabloom.plans.prepare import fit_preparation
from tabloom.plans.train import train_model
from tabloom.sources import files
from tabloom.streaming.scoring import score_stream, write_scores


def test_number_and_date_texts(spark):
    texts = ["1", " 2.5 ", "1d", "1e3", "abc", "", "2024-01-02", "2024/01/02", "01/02/2024", "Jan 2 2024", "2 Jan 2024", "2024-01-02 00:00:05.5", "12:30", "2024-13-02"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r.t: (r.n, r.s) for r in df.select("t", to_number(F.col("t")).alias("n"), epoch_seconds(to_moment(F.col("t"))).alias("s")).collect()}
    assert [got[t][0] for t in texts[:6]] == [1.0, 2.5, None, 1000.0, None, None]
    day = 1704153600.0
    assert [got[t][1] for t in texts[6:11]] == [day] * 5
    assert got["2024-01-02 00:00:05.5"][1] == day + 5.5
    assert got["12:30"][1] is None and got["2024-13-02"][1] is None


def test_types_of_edge_columns(spark):
    df = spark.createDataFrame(
        [("1", "2024-01-01", None, "x", True, "12.5"), ("2", "2024-05-01 10:00", None, "1", False, "n/a")],
        "a string, b string, c string, d string, e boolean, f string",
    )
    assert profiling.infer_types(df) == {
        "a": "numeric", "b": "datetime", "c": "categorical", "d": "categorical", "e": "numeric", "f": "categorical",
    }
    assert set(profiling.infer_types(df.where("a = '9'")).values()) == {"categorical", "numeric"}


def test_nan_counts_as_missing(spark):
    df = spark.createDataFrame([(1, float("nan")), (2, None), (3, 5.0)], "id int, v double")
    row = profiling.missing_and_distinct(df, ["v"]).first()
    assert (row.missing_count, row.unique_count) == (2, 1)
    assert [r.v for r in missing.fit_filler(df, "mean", ["v"]).apply(df).orderBy("id").collect()] == [5.0] * 3
    assert profiling.numeric_statistics(df, ["v"]).first().mean == 5.0


def test_all_null_column_stays_null(spark):
    df = spark.createDataFrame([(1, None), (2, None)], "id int, v double")
    for strategy in ("mean", "median", "most_frequent"):
        filler = missing.fit_filler(df, strategy, ["v"])
        assert filler.values["v"] is None
        assert filler.apply(df).where("v is null").count() == 2


def test_integer_mean_is_not_cut(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "v int")
    assert sorted(r.v for r in missing.fit_filler(df, "mean", ["v"]).apply(df).collect()) == [1.0, 1.5, 2.0]


def test_unseen_categories(spark):
    fit = spark.createDataFrame([("a", 1.0), ("b", 3.0), ("a", 2.0)], "c string, y double")
    new = spark.createDataFrame([("a",), ("z",), (None,)], "c string")
    with pytest.raises(Exception, match="unseen category"):
        fit_encoder(fit, "label", "c").apply(new).collect()
    assert [tuple(r) for r in fit_encoder(fit, "onehot", "c").apply(new).collect()] == [(1.0, 0.0), (0.0, 0.0), (0.0, 0.0)]
    with pytest.raises(Exception, match="unseen category"):
        fit_encoder(fit, "onehot", "c", handle_unknown="error").apply(new).collect()
    assert [r.c for r in fit_encoder(fit, "target", "c", "y").apply(new).collect()] == [1.5, 2.0, 2.0]
    assert [r.c for r in fit_encoder(fit, "frequency", "c").apply(new).collect()] == [2.0, 0.0, 0.0]


def test_single_category_takes_one_bit(spark):
    df = spark.createDataFrame([("a",), ("a",)], "c string")
    encoder = fit_encoder(df, "binary", "c")
    assert encoder.apply(df).columns == ["c_bin_0"]
    assert [r.c for r in encoder.invert(encoder.apply(df)).collect()] == ["a", "a"]
    with pytest.raises(ValueError, match="cannot be inverted"):
        fit_encoder(df, "hash", "c").invert(df)


def test_text_target_encoding(spark):
    df = spark.createDataFrame([("a", "no"), ("a", "yes"), ("b", "yes")], "c string, y string")
    assert [r.c for r in fit_encoder(df, "target", "c", "y").apply(df).collect()] == [0.5, 0.5, 1.0]
    numbers = spark.createDataFrame([("a", "10"), ("b", "20")], "c string, y string")
    assert [r.c for r in fit_encoder(numbers, "target", "c", "y").apply(numbers).collect()] == [10.0, 20.0]


def test_auto_encoding_reports_errors(spark):
    df = spark.createDataFrame([(1, "a", "u")], "id int, c string, d string")
    fitted = fit_auto_encoding(df, [{"column_name": "c", "encoding_method": "target"}, {"column_name": "id", "encoding_method": "none"}])
    assert fitted.errors == [("c", "target encoding needs a target column")]
    assert fitted.apply(df).columns == ["id", "c", "d_u"]


def test_constant_and_empty_scaling(spark):
    df = spark.createDataFrame([(7.0,), (7.0,)], "v double")
    for method in ("standard", "minmax", "robust"):
        assert [r.v for r in scaling.fit_scaler(df, method).apply(df).collect()] == [0.0, 0.0]
        assert scaling.fit_scaler(df.limit(0), method).parameters == {}


def test_outlier_edges(spark):
    df = spark.createDataFrame([(i, float(i % 5)) for i in range(50)] + [(90, 500.0), (91, None)], "id int, v double")
    bounds = outliers.fit_bounds(df, "iqr", 1.5, ["v"])
    assert [r.id for r in outliers.outlier_rows(df, "id", bounds).collect()] == [90]
    assert outliers.remove(df, bounds).count() == 50  # a tested column also loses its null row
    assert outliers.clip(df, bounds).where("v is null").count() == 1
    calm = df.where("id < 90 or id = 91")
    assert outliers.remove(calm, outliers.fit_bounds(calm, "iqr", 1.5, ["v"])).count() == 51
    with pytest.raises(ValueError, match="only action='remove'"):
        outliers.handle_outliers(df, "isolation_forest", "clip", 0.1, ["v"], "id")
    kept = outliers.handle_outliers(df.where("v is not null"), "isolation_forest", "remove", 0.03, ["v"], "id")
    assert kept.where("id = 90").count() == 0


def test_forest_scores_do_not_depend_on_partitions(spark):
    base = spark.range(600).selectExpr("id", "cast(id * 37 % 101 as double) as v")
    totals = []
    for partitions in (1, 16):
        df = base.repartition(partitions)
        forest = outliers.fit_isolation_forest(df, "id", ["v"], trees=10, sample=64)
        totals.append(forest.score(df, "id").agg(F.sum("anomaly_score")).first()[0])
    assert totals[0] == pytest.approx(totals[1], abs=1e-9)


def test_odd_column_names(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0)], "`row id` int, `a (x)` double, `b.c` double")
    assert polynomial_features(df, ["a (x)", "b.c"]).columns[-3:] == ["a (x)^2", "a (x) b.c", "b.c^2"]
    assert rename_to(df, ["row_id", "A_x"]).columns == ["row_id", "A_x", "b.c"]
    assert match_names(["a b", "a_b"], ["a_b"]) == {"a_b": "a_b"}
    assert scaling.fit_scaler(df, "standard", ["b.c"]).apply(df).first()["b.c"] == 0.0
    assert selection.by_variance(df, 0.0, ["a (x)", "b.c"]).selected == []


def test_split_is_stable_and_disjoint(spark):
    df = spark.range(5000)
    train, test = train_test(df, "id")
    assert train.join(test, "id").count() == 0 and train.count() + test.count() == 5000
    assert 900 < test.count() < 1100
    again = train_test(df.repartition(13), "id")[1]
    assert again.join(test, "id").count() == test.count()
    assert with_fold(df, "id", 5).groupBy("fold").count().count() == 5


def test_metrics_of_one_class_and_constant_truth(spark):
    df = spark.createDataFrame([(1, 1, 0.5), (1, 0, 0.5)], "y int, p int, s double")
    got = {r.metric: r.value for r in classification.classification_metrics(df, "y", "p").collect()}
    assert got["accuracy"] == 0.5 and got["precision"] == 1.0 and got["recall"] == 0.5
    assert classification.roc_auc(df, "y", {1: "s"}).first().value is None
    flat = spark.createDataFrame([(2.0, 2.0), (2.0, 2.0)], "y double, p double")
    got = {r.metric: r.value for r in regression.regression_metrics(flat, "y", "p").collect()}
    assert got["r2"] == 1.0 and got["mse"] == 0.0
    assert regression.interval_analysis(flat, "y", "p").count() == 0
    assert histogram(flat, {"y": F.col("y")}, 4).agg(F.sum("n")).first()[0] == 2


def test_missing_target_is_an_error(spark):
    df = spark.createDataFrame([(1, 2.0, None), (2, 1.0, 3.0)], "id int, x double, y double")
    with pytest.raises(ValueError, match="missing values"):
        fit_preparation(df, "id", "y", missing="mean")
    with pytest.raises(ValueError, match="no target"):
        train_model(df, "id", "linear_regression")


def customers(spark):
    return spark.range(400).selectExpr(
        "id", "cast(id * 37 % 101 as double) as x", "case when id % 9 = 0 then null else cast(id * 53 % 97 as double) end as `Z 1`",
        "concat('c', id % 4) as kind", "cast(2.0 * (id * 37 % 101) + id % 4 as double) as y",
    )


def test_scoring_repeats_training_preparation(spark):
    df = customers(spark)
    done = train_model(df, "id", "linear_regression", "y", missing="mean", scale="standard", scale_target=True)
    got = {r.metric: r.value for r in done.metrics.collect()}
    assert got["r2"] > 0.999 and got["prediction_max"] > 50
    new = df.drop("y").withColumnRenamed("Z 1", "z_1")
    scored = done.bundle.score(new)
    both = scored.join(done.scored.select("id", F.col("prediction").alias("p")), "id")
    assert both.count() == done.scored.count() and both.where("abs(prediction - p) > 1e-9").count() == 0
    assert {"Z 1", "kind", "prediction"} <= set(scored.columns)
    levels = {r.check_name for r in done.bundle.findings(new.drop("kind")).collect()}
    assert levels == {"missing_column", "missing_values"}


def test_scoring_a_stream(spark, tmp_path):
    df = customers(spark)
    done = train_model(df, "id", "linear_regression", "y", missing="mean", scale="minmax")
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    df.drop("y").write.parquet(source)
    stream = spark.readStream.schema(df.drop("y").schema).parquet(source)
    query = write_scores(score_stream(done.bundle, stream), out, str(tmp_path / "log"))
    query.awaitTermination(120)
    batch = done.bundle.score(df.drop("y"))
    assert spark.read.parquet(out).join(batch.select("id", F.col("prediction").alias("p")), "id").where("abs(prediction - p) < 1e-9").count() == 400


def test_file_formats(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 2.5), (2, None, None)], "id int, t string, v double")
    for fmt in ("csv", "json", "parquet"):
        path = str(tmp_path / f"x.{fmt}")
        files.write_dataset(df, path, fmt)
        back = files.read_dataset(spark, path, "jsonl" if fmt == "json" else None)
        assert sorted(map(str, back.select("id", "t", "v").collect())) == sorted(map(str, df.collect()))
    with pytest.raises(ValueError, match="unsupported file format"):
        files.read_dataset(spark, "x.xlsx")
    array = tmp_path / "array.json"
    array.write_text('[{"a": 1, "b": "x"}, {"a": 2}]')
    assert files.read_dataset(spark, str(array)).count() == 2
    assert files.derived_name("t_encoded_scaled_processed") == "t_processed"
    assert files.from_records(spark, [{"a": 1.0}, {"b": "z"}]).columns == ["a", "b"]

"""Dates, missing values, scaling, outliers, constructed and selected features."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.operators import construct, dates, missing, outliers, scaling, selection

from .base import F1, F2, F3, F5, duck_moment, query, rd, rounded, rows, union


def _epoch(c: str) -> str:
    return f"CAST(epoch({duck_moment(c)}) AS DOUBLE)"


@query("c1_dates_to_epoch", f"SELECT id, num_text, {_epoch('date_90')} AS date_90, date_70, {_epoch('date_100')} AS date_100 FROM ({F3}) t")
def c1(spark, sf):
    done, _ = dates.convert_dates(rows(spark, sf, F3), categorical=["cat"])
    return done.select("id", "num_text", "date_90", "date_70", "date_100")


@query("c3_drop_missing", f"SELECT id, price, priority, cust FROM ({F1}) t WHERE price IS NOT NULL AND priority IS NOT NULL")
def c3(spark, sf):
    return missing.drop_missing(rows(spark, sf, F1), ["price", "priority", "y"], "y").select("id", "price", "priority", "cust")


def _fill_sql(aggregate: str) -> str:
    return (
        f"WITH t AS ({F1}) SELECT id, {rd(f'coalesce(price, (SELECT {aggregate}(price) FROM t))')} AS price,"
        f" {rd(f'coalesce(cust, (SELECT {aggregate}(cust) FROM t))')} AS cust FROM t"
    )


def _filled(spark, sf, strategy, columns, **options):
    frame = rows(spark, sf, F1)
    return missing.fit_filler(frame, strategy, columns, "y", **options).apply(frame)


@query("c4_fill_mean", _fill_sql("avg"))
def c4(spark, sf):
    return rounded(_filled(spark, sf, "mean", ["price", "cust"]).select("id", "price", "cust"))


@query("c5_fill_median", _fill_sql("median"))
def c5(spark, sf):
    return rounded(_filled(spark, sf, "median", ["price", "cust"]).select("id", "price", "cust"))


MODE = "(SELECT {c} FROM t WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"


@query(
    "c6_fill_most_frequent",
    f"WITH t AS ({F1}) SELECT id, coalesce(cust, {MODE.format(c='cust')}) AS cust, coalesce(priority, {MODE.format(c='priority')}) AS priority FROM t",
)
def c6(spark, sf):
    return _filled(spark, sf, "most_frequent", ["cust", "priority"]).select("id", "cust", "priority")


@query("c7_fill_constant", f"SELECT id, coalesce(price, -1) AS price, coalesce(cust, -1) AS cust FROM ({F1}) t")
def c7(spark, sf):
    return _filled(spark, sf, "constant", ["price", "cust"], fill_value=-1.0).select("id", "price", "cust")


@query(
    "c8_categorical_fallback",
    f"WITH t AS ({F1}) SELECT id, {rd('coalesce(price, (SELECT avg(price) FROM t))')} AS price,"
    f" coalesce(priority, {MODE.format(c='priority')}) AS priority FROM t",
)
def c8(spark, sf):
    return rounded(_filled(spark, sf, "mean", ["price", "priority"]).select("id", "price", "priority"))


def _donor_sql(gap: str, shared: str) -> str:
    return f"""
    SELECT id, avg(v) AS v FROM (
      SELECT r.id, d.{gap} AS v, row_number() OVER (PARTITION BY r.id ORDER BY abs(r.{shared} - d.{shared}), d.id) AS n
      FROM t r JOIN t d ON d.{gap} IS NOT NULL AND d.{shared} IS NOT NULL
      WHERE r.{gap} IS NULL AND r.{shared} IS NOT NULL) q WHERE n <= 5 GROUP BY id"""


@query(
    "c9_fill_neighbors",
    f"WITH t AS ({F1}), p AS ({_donor_sql('price', 'cust')}), c AS ({_donor_sql('cust', 'price')})"
    f" SELECT t.id, {rd('coalesce(t.price, p.v, (SELECT avg(price) FROM t))', 4)} AS price,"
    f" {rd('coalesce(t.cust, c.v, (SELECT avg(cust) FROM t))', 4)} AS cust FROM t LEFT JOIN p ON p.id = t.id LEFT JOIN c ON c.id = t.id",
)
def c9(spark, sf):
    return rounded(missing.fill_by_neighbors(rows(spark, sf, F1), "id", ["price", "cust"]).select("id", "price", "cust"), 4)


@query("c10_fill_trees")
def c10(spark, sf):
    frame = rows(spark, sf, F1).select("id", "price", "cust", "y")
    return missing.fill_by_trees(frame, "id", ["price", "cust", "y"], rounds=2, trees=10)


@query(
    "c11_target_guard",
    f"SELECT CAST(count(*) - count(price) AS BIGINT) AS missing_price, true AS rejected, false AS y_rejected FROM ({F1}) t",
)
def c11(spark, sf):
    frame = rows(spark, sf, F1)
    outcome = {}
    for c in ("price", "y"):
        try:
            missing.check_target(frame, c)
            outcome[c] = False
        except ValueError:
            outcome[c] = True
    counts = missing.missing_counts(frame, ["price"])
    return counts.select(
        F.col("missing_count").alias("missing_price"), F.lit(outcome["price"]).alias("rejected"), F.lit(outcome["y"]).alias("y_rejected")
    )


@query(
    "c12_missing_report",
    union([
        f"SELECT '{c}' AS column_name, CAST(count(*) - count({c}) AS BIGINT) AS missing_before, CAST(0 AS BIGINT) AS missing_after FROM ({F1}) t"
        for c in ("price", "priority", "cust")
    ]),
)
def c12(spark, sf):
    frame = rows(spark, sf, F1)
    columns = ["price", "priority", "cust"]
    return missing.missing_report(frame, missing.fit_filler(frame, "median", columns).apply(frame), columns)


SCALED = ["price", "size", "constant"]


def _scale_sql(center: str, spread: str) -> str:
    parts = ", ".join(
        rd(f"({c} - (SELECT {center.format(c=c)} FROM t)) / coalesce(nullif((SELECT {spread.format(c=c)} FROM t), 0), 1)") + f" AS {c}"
        for c in SCALED
    )
    return f"WITH t AS ({F2}) SELECT id, {parts} FROM t"


def _scaled(spark, sf, method):
    frame = rows(spark, sf, F2)
    return rounded(scaling.fit_scaler(frame, method, SCALED).apply(frame).select("id", *SCALED))


@query("c13_standard_scale", _scale_sql("avg({c})", "stddev_pop({c})"))
def c13(spark, sf):
    return _scaled(spark, sf, "standard")


@query("c14_minmax_scale", _scale_sql("min({c})", "max({c}) - min({c})"))
def c14(spark, sf):
    return _scaled(spark, sf, "minmax")


@query("c15_robust_scale", _scale_sql("median({c})", "quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)"))
def c15(spark, sf):
    return _scaled(spark, sf, "robust")


@query(
    "c16_target_scaler",
    union([
        f"SELECT '{r}' AS role, 'standard' AS method, '{c}' AS column_name, {rd(f'avg({c})')} AS center, {rd(f'stddev_pop({c})')} AS scale FROM ({F5}) t"
        for r, c in [("features", "x1"), ("features", "x2"), ("target", "y")]
    ]),
)
def c16(spark, sf):
    frame = rows(spark, sf, F5)
    one, two = scaling.fit_scalers(frame, "standard", ["x1", "x2"], ["y"])
    return rounded(one.table(spark).unionByName(two.table(spark)))


@query("c17_inverse_scale", f"SELECT id, {rd('x1')} AS x1, {rd('x2')} AS x2, {rd('y')} AS prediction FROM ({F5}) t")
def c17(spark, sf):
    frame = rows(spark, sf, F5)
    one, two = scaling.fit_scalers(frame, "robust", ["x1", "x2"], ["y"])
    scaled = two.apply(one.apply(frame)).withColumnRenamed("y", "prediction")
    return rounded(two.invert(one.invert(scaled), {"prediction": "y"}).select("id", "x1", "x2", "prediction"))


def _limits(method: str, c: str, t: float) -> tuple[str, str]:
    if method == "iqr":
        q = f"(SELECT quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) FROM t)"
        return (
            f"((SELECT quantile_cont({c}, 0.25) FROM t) - {t} * {q})", f"((SELECT quantile_cont({c}, 0.75) FROM t) + {t} * {q})"
        )
    return (
        f"(SELECT avg({c}) - {t} * stddev_samp({c}) FROM t)", f"(SELECT avg({c}) + {t} * stddev_samp({c}) FROM t)"
    )


def _count_sql(method: str, t: float) -> str:
    parts = []
    for c in ("price", "size"):
        low, high = _limits(method, c, t)
        parts.append(
            f"SELECT '{c}' AS column_name, CAST(count(*) FILTER (WHERE {c} < {low} OR {c} > {high}) AS BIGINT) AS outlier_count,"
            f" {rd(f'100.0 * count(*) FILTER (WHERE {c} < {low} OR {c} > {high}) / count(*)')} AS percentage,"
            f" {rd(low)} AS lower_bound, {rd(high)} AS upper_bound FROM t"
        )
    return f"WITH t AS ({F2}) " + union(parts)


@query("o1_detect_iqr", _count_sql("iqr", 1.5))
def o1(spark, sf):
    frame = rows(spark, sf, F2)
    return rounded(outliers.outlier_counts(frame, outliers.fit_bounds(frame, "iqr", 1.5, ["price", "size"])))


_LOW, _HIGH = _limits("iqr", "price", 1.5)


@query("o1_outlier_rows", f"WITH t AS ({F2}) SELECT 'price' AS column_name, id FROM t WHERE price < {_LOW} OR price > {_HIGH}")
def o1b(spark, sf):
    frame = rows(spark, sf, F2)
    return outliers.outlier_rows(frame, "id", outliers.fit_bounds(frame, "iqr", 1.5, ["price"]))


@query("o2_detect_zscore", _count_sql("zscore", 2.5))
def o2(spark, sf):
    frame = rows(spark, sf, F2)
    return rounded(outliers.outlier_counts(frame, outliers.fit_bounds(frame, "zscore", 2.5, ["price", "size"])))


@query("o3_isolation_forest")
def o3(spark, sf):
    frame = rows(spark, sf, F2)
    forest = outliers.fit_isolation_forest(frame, "id", ["price", "size", "digit"], 0.02)
    return forest.score(frame, "id")


@query("o4_clip", f"WITH t AS ({F2}) SELECT id, {rd(f'greatest(least(price, {_HIGH}), {_LOW})')} AS price FROM t")
def o4(spark, sf):
    return rounded(outliers.handle_outliers(rows(spark, sf, F2), "iqr", "clip", 1.5, ["price"]).select("id", "price"))


@query("o5_remove", f"WITH t AS ({F2}) SELECT id, price FROM t WHERE price BETWEEN {_LOW} AND {_HIGH}")
def o5(spark, sf):
    return outliers.handle_outliers(rows(spark, sf, F2), "iqr", "remove", 1.5, ["price", "size"]).select("id", "price")


def _swap_sql(by: str) -> str:
    return (
        f"WITH t AS ({F2}) SELECT id, {rd(f'CASE WHEN price < {_LOW} OR price > {_HIGH} THEN (SELECT {by}(price) FROM t) ELSE price END')} AS price FROM t"
    )


@query("o6_replace_mean", _swap_sql("avg"))
def o6(spark, sf):
    return rounded(outliers.handle_outliers(rows(spark, sf, F2), "iqr", "replace_mean", 1.5, ["price"]).select("id", "price"))


@query("o7_replace_median", _swap_sql("median"))
def o7(spark, sf):
    return rounded(outliers.handle_outliers(rows(spark, sf, F2), "iqr", "replace_median", 1.5, ["price"]).select("id", "price"))


_LOW2, _HIGH2 = (b.replace(" FROM t)", " FROM u)") for b in (_LOW, _HIGH))


@query(
    "o8_before_after",
    f"WITH t AS ({F2}), u AS (SELECT id, price FROM t WHERE price BETWEEN {_LOW} AND {_HIGH})"
    f" SELECT 'price' AS column_name, CAST((SELECT count(*) FROM t WHERE price < {_LOW} OR price > {_HIGH}) AS BIGINT) AS outliers_before,"
    f" CAST((SELECT count(*) FROM u WHERE price < {_LOW2} OR price > {_HIGH2}) AS BIGINT) AS outliers_after",
)
def o8(spark, sf):
    frame = rows(spark, sf, F2)
    after = outliers.handle_outliers(frame, "iqr", "remove", 1.5, ["price"])
    return outliers.before_after(frame, after, "iqr", 1.5, ["price"])


@query(
    "f1_polynomial_features",
    f'SELECT id, size, digit, {rd("size * size")} AS "size^2", {rd("size * digit")} AS "size digit", {rd("digit * digit")} AS "digit^2",'
    f' {rd("size * size * size")} AS "size^3", {rd("size * size * digit")} AS "size^2 digit", {rd("size * digit * digit")} AS "size digit^2",'
    f' {rd("digit * digit * digit")} AS "digit^3" FROM ({F2}) t',
)
def f1(spark, sf):
    frame = rows(spark, sf, F2).select("id", "size", "digit")
    return rounded(construct.polynomial_features(frame, ["size", "digit"], 3))


@query(
    "f2_interactions",
    f'SELECT id, {rd("size * digit")} AS "size digit", {rd("size * price")} AS "size price", {rd("digit * price")} AS "digit price" FROM ({F2}) t',
)
def f2(spark, sf):
    frame = rows(spark, sf, F2).select("id", "size", "digit", "price")
    done = construct.polynomial_features(frame, ["size", "digit", "price"], 2, interaction_only=True)
    return rounded(done.drop("size", "digit", "price"))


@query(
    "f3_select_variance",
    union([
        f"SELECT '{c}' AS column_name, 'variance' AS method, var_pop({c}) > 10 AS selected, {rd(f'var_pop({c})')} AS score FROM ({F2}) t"
        for c in ("price", "size", "size2", "digit", "constant")
    ]),
)
def f3(spark, sf):
    picked = selection.by_variance(rows(spark, sf, F2), 10.0, ["price", "size", "size2", "digit", "constant"])
    return rounded(picked.report(spark))


@query(
    "f4_select_correlation",
    f"""
    WITH t AS ({F2}), p AS (
      SELECT abs(corr(price, size)) AS ps, abs(corr(price, size2)) AS p2, abs(corr(size, size2)) AS s2,
             abs(corr(price, digit)) AS pd, abs(corr(size, digit)) AS sd, abs(corr(size2, digit)) AS d2 FROM t)
    SELECT 'price' AS column_name, 'correlation' AS method, true AS selected, CAST(0 AS DOUBLE) AS score
    UNION ALL SELECT 'size', 'correlation', ps <= 0.9, {rd('ps')} FROM p
    UNION ALL SELECT 'size2', 'correlation', greatest(p2, s2) <= 0.9, {rd('greatest(p2, s2)')} FROM p
    UNION ALL SELECT 'digit', 'correlation', greatest(pd, sd, d2) <= 0.9, {rd('greatest(pd, sd, d2)')} FROM p
    """,
)
def f4(spark, sf):
    picked = selection.by_correlation(rows(spark, sf, F2), 0.9, ["price", "size", "size2", "digit"])
    return rounded(picked.report(spark))


@query("f5_select_importance")
def f5(spark, sf):
    frame = rows(spark, sf, F2)
    return selection.by_importance(frame, "type", columns=["price", "size", "size2", "digit", "constant"], trees=20).report(spark)


@query("f6_recursive_elimination")
def f6(spark, sf):
    frame = rows(spark, sf, F2)
    return selection.by_elimination(frame, "price", 2, ["size", "size2", "digit", "constant"], trees=10).report(spark)


@query("f7_selection_layout", f"SELECT size, size2, digit, id, brand, type, price FROM ({F2}) t")
def f7(spark, sf):
    frame = rows(spark, sf, F2)
    return selection.by_variance(frame, 1.0, ["size", "size2", "digit", "constant", "price"], "price").apply(frame)


def _anova(c: str) -> str:
    return f"""SELECT '{c}' AS column_name, {rd('(sum(n * power(m - g, 2)) / (count(*) - 1)) / (sum(n * v) / (sum(n) - count(*)))')} AS score
    FROM (SELECT type, count(*) AS n, avg({c}) AS m, var_pop({c}) AS v, (SELECT avg({c}) FROM t) AS g FROM t GROUP BY type) q"""


@query("f8_anova_scores", f"WITH t AS ({F2}) " + union([_anova(c) for c in ("price", "size", "size2", "digit")]))
def f8(spark, sf):
    picked = selection.by_f_score(rows(spark, sf, F2), "type", 2, ["price", "size", "size2", "digit"])
    return rounded(picked.report(spark).select("column_name", "score"))


@query(
    "f8_regression_scores",
    f"WITH t AS ({F2}) " + union([
        f"SELECT '{c}' AS column_name, {rd(f'power(corr({c}, price), 2) / (1 - power(corr({c}, price), 2)) * (count(*) - 2)')} AS score FROM t"
        for c in ("size", "size2", "digit")
    ]),
)
def f8b(spark, sf):
    picked = selection.by_f_score(rows(spark, sf, F2), "price", 2, ["size", "size2", "digit"])
    return rounded(picked.report(spark).select("column_name", "score"))

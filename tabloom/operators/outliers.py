"""Outlier detection and treatment."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import numeric_columns, ref, replace_columns
from ..functions.parsing import clean_number
from .lookup import rows_table
from .ordering import exact_quantiles

EULER = 0.5772156649015329


@dataclass
class Bounds:
    method: str
    threshold: float
    limits: dict[str, tuple[float, float]] = field(default_factory=dict)

    def flag(self, column: str) -> Column:
        """True for a value outside the bounds, false for null."""
        low, high = self.limits[column]
        v = clean_number(ref(column))
        return F.coalesce((v < F.lit(low)) | (v > F.lit(high)), F.lit(False))


def fit_bounds(
    df: DataFrame, method: str = "iqr", threshold: float = 1.5, columns: Sequence[str] | None = None,
    categorical: Sequence[str] = (),
) -> Bounds:
    """Quartile or z-score bounds; a column without spread or values has none."""
    columns = numeric_columns(df, columns, categorical)
    value = {c: clean_number(ref(c)) for c in columns}
    limits = {}
    if method == "iqr":
        for c, (q25, q75) in exact_quantiles(df, value, [0.25, 0.75]).items():
            if q25 is not None:
                reach = threshold * (q75 - q25)
                limits[c] = (q25 - reach, q75 + reach)
    elif method == "zscore":
        row = df.agg(
            *[F.struct(F.avg(value[c]).alias("m"), F.stddev_samp(value[c]).alias("s")).alias(c) for c in columns]
        ).first()
        for c in columns:
            m, s = row[c]
            if m is not None and s:
                limits[c] = (m - threshold * s, m + threshold * s)
    else:
        raise ValueError(f"unknown outlier method {method!r}")
    return Bounds(method, threshold, limits)


def outlier_counts(df: DataFrame, bounds: Bounds) -> DataFrame:
    """Count, percentage and bounds per column from one aggregate."""
    row = df.agg(F.count("*").alias("_rows"), *[F.count_if(bounds.flag(c)).alias(c) for c in bounds.limits]).first()
    rows = [
        (c, row[c], 100.0 * row[c] / row["_rows"] if row["_rows"] else 0.0, low, high)
        for c, (low, high) in bounds.limits.items()
    ]
    return rows_table(
        df.sparkSession, rows,
        "column_name string, outlier_count long, percentage double, lower_bound double, upper_bound double",
    )


def outlier_rows(df: DataFrame, key: str, bounds: Bounds) -> DataFrame:
    """(column_name, key) of every value outside its bounds."""
    marks = F.array(
        *[F.when(bounds.flag(c), F.lit(c)) for c in bounds.limits]
    )
    return df.select(F.explode(F.array_compact(marks)).alias("column_name"), ref(key))


def clip(df: DataFrame, bounds: Bounds) -> DataFrame:
    new = {}
    for c, (low, high) in bounds.limits.items():
        v = clean_number(ref(c))
        # least and greatest skip nulls, so a missing value needs its own branch
        new[c] = F.when(v.isNotNull(), F.greatest(F.least(v, F.lit(high)), F.lit(low)))
    return replace_columns(df, new)


def remove(df: DataFrame, bounds: Bounds) -> DataFrame:
    """Keep rows inside the bounds, one column after the other.

    A column is only tested when it still has an outlier among the rows kept so far,
    and its missing values then fail the test too.
    """
    for c, (low, high) in bounds.limits.items():
        if df.agg(F.count_if(bounds.flag(c))).first()[0]:
            df = df.where(clean_number(ref(c)).between(low, high))
    return df


def replacements(df: DataFrame, bounds: Bounds, by: str) -> dict[str, float | None]:
    """Mean or median of each bounded column, outliers included."""
    columns = list(bounds.limits)
    if by not in ("mean", "median"):
        raise ValueError(f"unknown replacement {by!r}")
    if not columns:
        return {}
    if by == "mean":
        return df.agg(*[F.avg(clean_number(ref(c))).alias(c) for c in columns]).first().asDict()
    return {c: q[0] for c, q in exact_quantiles(df, {c: ref(c) for c in columns}, [0.5]).items()}


def put(df: DataFrame, bounds: Bounds, values: dict[str, float | None]) -> DataFrame:
    return replace_columns(
        df, {c: F.when(bounds.flag(c), F.lit(values[c])).otherwise(clean_number(ref(c))) for c in bounds.limits}
    )


def replace(df: DataFrame, bounds: Bounds, by: str) -> DataFrame:
    """Replace outliers by the mean or median of the whole column, outliers included."""
    return put(df, bounds, replacements(df, bounds, by))


@dataclass
class Treatment:
    """A fitted handling of outliers. New rows are clipped or replaced like the fitted ones, and never dropped."""

    action: str
    bounds: Bounds
    values: dict[str, float | None] = field(default_factory=dict)
    forest: IsolationForest | None = None

    def treat(self, df: DataFrame) -> DataFrame:
        """The fitted rows, without those that the action removes."""
        if self.forest is not None:
            return df.where(self.forest.anomaly(df) <= F.lit(self.forest.cut)) if self.forest.trees else df
        return remove(df, self.bounds) if self.action == "remove" else self.apply(df)

    def apply(self, df: DataFrame) -> DataFrame:
        if self.action == "remove":
            return df
        here = Bounds(self.bounds.method, self.bounds.threshold, {c: v for c, v in self.bounds.limits.items() if c in df.columns})
        return clip(df, here) if self.action == "clip" else put(df, here, self.values)


def fit_treatment(
    df: DataFrame, method: str = "iqr", action: str = "clip", threshold: float = 1.5,
    columns: Sequence[str] | None = None, key: str | None = None,
) -> Treatment:
    if method == "isolation_forest":
        if action != "remove":
            raise ValueError("isolation forest flags whole rows: only action='remove' applies")
        forest = fit_isolation_forest(df, key, numeric_columns(df, columns), contamination=threshold)
        return Treatment(action, Bounds(method, threshold), forest=forest)
    bounds = fit_bounds(df, method, threshold, columns)
    by = action.removeprefix("replace_")
    return Treatment(action, bounds, {} if action in ("clip", "remove") else replacements(df, bounds, by))


def handle_outliers(
    df: DataFrame, method: str = "iqr", action: str = "clip", threshold: float = 1.5,
    columns: Sequence[str] | None = None, key: str | None = None,
) -> DataFrame:
    return fit_treatment(df, method, action, threshold, columns, key).treat(df)


def before_after(
    before: DataFrame, after: DataFrame, method: str, threshold: float, columns: Sequence[str]
) -> DataFrame:
    """Outlier counts before and after, each against bounds of its own table."""
    left = outlier_counts(before, fit_bounds(before, method, threshold, columns))
    right = outlier_counts(after, fit_bounds(after, method, threshold, columns))
    return left.select("column_name", F.col("outlier_count").alias("outliers_before")).join(
        right.select("column_name", F.col("outlier_count").alias("outliers_after")), "column_name"
    )


def path_constant(n: float) -> float:
    """Mean depth of an unsuccessful search in a binary tree of n points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (np.log(n - 1.0) + EULER) - 2.0 * (n - 1.0) / n


def grow_tree(points: np.ndarray, generator: np.random.Generator, limit: int) -> list[tuple]:
    """Random splits as (feature, cut, left child, right child, path length at a leaf)."""
    nodes: list[tuple] = []

    def grow(rows: np.ndarray, depth: int) -> int:
        place = len(nodes)
        nodes.append((-1, 0.0, -1, -1, depth + path_constant(len(rows))))
        low, high = rows.min(axis=0), rows.max(axis=0)
        wide = np.nonzero(high > low)[0]
        if depth >= limit or len(rows) <= 1 or not len(wide):
            return place
        f = int(generator.choice(wide))
        cut = float(generator.uniform(low[f], high[f]))
        under = rows[:, f] <= cut
        if under.all():
            return place
        left = grow(rows[under], depth + 1)
        right = grow(rows[~under], depth + 1)
        nodes[place] = (f, cut, left, right, 0.0)
        return place

    grow(points, 0)
    return nodes


def tree_depths(x: np.ndarray, tree: tuple[np.ndarray, ...]) -> np.ndarray:
    feature, cut, left, right, length = tree
    at = np.zeros(len(x), dtype=int)
    moving = feature[at] >= 0
    while moving.any():
        rows = np.nonzero(moving)[0]
        node = at[rows]
        under = x[rows, feature[node]] <= cut[node]
        at[rows] = np.where(under, left[node], right[node])
        moving[rows] = feature[at[rows]] >= 0
    return length[at]


@dataclass
class IsolationForest:
    columns: list[str]
    means: dict[str, float]
    trees: list[tuple[np.ndarray, ...]]
    sample_size: int
    cut: float = 0.5

    def anomaly(self, df: DataFrame) -> Column:
        """The score of each row as a column, so that nothing has to be joined back."""
        # the forest is bounded: trees x at most twice the sample size nodes
        shared = df.sparkSession.sparkContext.broadcast(self.trees)
        norm = path_constant(self.sample_size) or 1.0

        @F.pandas_udf("double")
        def run(values: pd.Series) -> pd.Series:
            if not len(values):
                return pd.Series([], dtype=float)
            x = np.stack(values.to_numpy()).astype(float)
            depth = np.mean([tree_depths(x, t) for t in shared.value], axis=0)
            return pd.Series(2.0 ** (-depth / norm))

        return run(F.array(*[F.coalesce(clean_number(ref(c)), F.lit(self.means[c])) for c in self.columns]))

    def _scores(self, df: DataFrame, key: str) -> DataFrame:
        return df.select(ref(key), self.anomaly(df).alias("anomaly_score"))

    def score(self, df: DataFrame, key: str) -> DataFrame:
        return self._scores(df, key).withColumn("is_outlier", F.col("anomaly_score") > F.lit(self.cut))


def fit_isolation_forest(
    df: DataFrame, key: str, columns: Sequence[str], contamination: float | None = None,
    trees: int = 100, sample: int = 256, seed: int = 42,
) -> IsolationForest:
    """Trees on key-hashed samples of at most ``sample`` rows each.

    A row is offered to a tree only when its hash falls under a threshold that lets
    through somewhat more than the sample, so one pass yields all samples and only
    about ``trees * sample`` rows are shuffled.
    """
    columns = list(columns)
    row = df.agg(F.count("*").alias("_rows"), *[F.avg(clean_number(ref(c))).alias(c) for c in columns]).first()
    means = {c: row[c] if row[c] is not None else 0.0 for c in columns}
    rows = row["_rows"]
    size = min(sample, rows)
    if not rows:
        return IsolationForest(columns, means, [], 0)
    share = min(1.0, 2.0 * sample / rows + 64.0 / rows)
    draw = F.array(*[F.lit(t) for t in range(trees)])
    offered = df.select(
        ref(key).alias("_key"),
        F.array(*[F.coalesce(clean_number(ref(c)), F.lit(means[c])) for c in columns]).alias("_x"),
        F.explode(
            F.filter(
                F.transform(
                    draw,
                    lambda t: F.struct(
                        t.alias("tree"),
                        F.pmod(F.xxhash64(ref(key).cast("string"), t, F.lit(seed)), F.lit(2**31)).alias("spot"),
                    ),
                ),
                lambda s: s["spot"] < F.lit(int(share * 2**31)),
            )
        ).alias("_draw"),
    ).select("_key", "_x", "_draw.tree", "_draw.spot")
    limit = int(np.ceil(np.log2(max(size, 2))))

    def build(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["spot", "_key"]).head(size)
        tree = int(part["tree"].iloc[0])
        generator = np.random.default_rng([seed, tree])
        nodes = grow_tree(np.stack(part["_x"].to_numpy()).astype(float), generator, limit)
        out = pd.DataFrame(nodes, columns=["feature", "cut", "left_node", "right_node", "length"])
        return out.assign(tree=tree, node=range(len(nodes)))

    built = offered.groupBy("tree").applyInPandas(
        build, "feature int, cut double, left_node int, right_node int, length double, tree int, node int"
    ).toPandas()
    forest = []
    for _, part in built.sort_values(["tree", "node"]).groupby("tree"):
        forest.append(tuple(part[c].to_numpy() for c in ("feature", "cut", "left_node", "right_node", "length")))
    fitted = IsolationForest(columns, means, forest, size)
    if contamination is not None and 0 < contamination < 0.5:
        scores = fitted._scores(df, key)
        fitted.cut = exact_quantiles(scores, {"s": F.col("anomaly_score")}, [1 - contamination])["s"][0]
    return fitted


def isolation_outliers(df: DataFrame, key: str, columns: Sequence[str], threshold: float = 1.5) -> DataFrame:
    """Rows flagged by the forest, counted for every column without bounds."""
    scored = fit_isolation_forest(df, key, columns, threshold).score(df, key)
    row = scored.agg(F.count("*").alias("rows"), F.count_if("is_outlier").alias("hits")).first()
    rows = [(c, row.hits, 100.0 * row.hits / row.rows if row.rows else 0.0) for c in columns]
    return rows_table(df.sparkSession, rows, "column_name string, outlier_count long, percentage double")

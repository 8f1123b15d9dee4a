"""Training from raw rows to metrics, and declarative runs."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import numeric_columns, ref, text_columns
from ..operators.encoding import AutoEncoding
from ..operators.lookup import rows_table
from ..operators.metrics.classification import classification_metrics, roc_auc
from ..operators.metrics.clustering import calinski_harabasz, davies_bouldin, silhouette_score
from ..operators.metrics.common import metric_rows
from ..operators.metrics.reduction import reconstruction_error, reduction_summary
from ..operators.metrics.regression import regression_metrics, value_statistics
from ..operators.models.catalog import feature_importance, fit_named, fit_unsupervised, is_classifier, kind_of
from ..operators.models.decomposition import Pca
from ..operators.outliers import Treatment
from ..operators.profiling import infer_types
from ..operators.scoring import Preparation, ScoringBundle, align, needed, restore
from ..operators.split import train_test
from ..operators.tuning import bayesian_search, grid_search, random_search
from ..sources.files import read_dataset, result_document
from ..sources.registry import Registry
from ..sources.shared import settle
from .prepare import fit_outliers, fit_polynomial, fit_preparation, fit_selection
from .store import Store, kept_path


@dataclass
class Training:
    algorithm: str
    parameters: dict
    bundle: ScoringBundle | None
    scored: DataFrame
    metrics: DataFrame
    importance: DataFrame | None
    notes: list[str] = field(default_factory=list)

    def document(self) -> DataFrame:
        return result_document(
            self.metrics, algorithm=self.algorithm, parameters=json.dumps(self.parameters, sort_keys=True)
        )

    def register(self, registry: Registry, dataset: str, path: str = "", store: Store | None = None) -> str:
        """Add the model to the registry; with a store its bundle is kept and the path says where."""
        if store is not None:
            if self.bundle is None:
                raise ValueError(f"{self.algorithm} has no model for new rows to keep")
            path = kept_path(self.algorithm, store.save(self.algorithm, self.bundle))
        values = {r.metric: r.value for r in self.metrics.collect()}
        return registry.append(
            "models",
            [{
                "dataset_id": dataset, "algorithm": self.algorithm, "parameters": json.dumps(self.parameters),
                "metrics": json.dumps(values), "path": path,
            }],
        )[0]


def evaluate(scored: DataFrame, target: str, model, average: str | None = None) -> DataFrame:
    """All metrics of the model's kind as (metric, value)."""
    if model.classes is None:
        stats = value_statistics(scored, target, "prediction")
        parts = F.array(*[
            F.struct(F.concat_ws("_", "series", F.lit(s)).alias("metric"), F.col(s).cast("double").alias("value"))
            for s in ("mean", "std", "min", "max")
        ])
        return regression_metrics(scored, target, "prediction").unionByName(stats.select(F.inline(parts)))
    out = classification_metrics(scored, target, "prediction", average)
    shown = [c for c in model.classes if f"probability_{c}" in scored.columns]
    if not shown:
        return out
    used = shown[1:] if len(shown) == 2 else shown
    return out.unionByName(roc_auc(scored, target, {c: f"probability_{c}" for c in used}))


def train_model(
    df: DataFrame,
    key: str,
    algorithm: str,
    target: str | None = None,
    features: Sequence[str] | None = None,
    roles: Sequence[dict] = (),
    parameters: dict | None = None,
    missing: str | None = None,
    encoding: Sequence[dict] = (),
    scale: str | None = None,
    scale_target: bool = False,
    test_size: float = 0.2,
    seed: int = 42,
    fit_scope: str = "train",
    average: str | None = None,
) -> Training:
    """Dates, fills, encoding, scaling, split, fit, predict, un-scale, metrics.

    The target comes from the argument or from the column flagged ``is_target``.
    Preparation is fitted on the train split; ``fit_scope='all'`` fits it on all rows.
    Clusterings and reductions need no target and no split; ``scored`` then has the clusters,
    components or graph edges of all rows, and there is a bundle where new rows can be scored.
    """
    target = target or next((r["column_name"] for r in roles if r.get("is_target")), None)
    if kind_of(algorithm) in ("clustering", "reduction"):
        excluded = {r["column_name"] for r in roles if r.get("is_excluded")}
        chosen = [c for c in (features or df.columns) if c not in (key, target) and c not in excluded]
        return _train_unsupervised(df, key, algorithm, target, chosen, parameters or {}, missing, encoding, scale)
    if target is None:
        raise ValueError("no target column: pass one or flag a column as is_target")
    excluded = {r["column_name"] for r in roles if r.get("is_excluded")}
    features = [c for c in (features or df.columns) if c not in (key, target) and c not in excluded]
    base = df.select(ref(key), *[ref(c) for c in features], ref(target))
    train, test = train_test(base, key, test_size, seed)
    fitted = fit_preparation(
        train if fit_scope == "train" else base, key, target, missing, encoding=encoding, scale=scale,
        scale_target=scale_target and not is_classifier(algorithm),
    )
    ready = fitted.df if fit_scope == "train" else train_test(fitted.df, key, test_size, seed)[0]
    inputs = [c for c in ready.columns if c not in (key, target)]
    texts = text_columns(ready, inputs)
    if texts:
        raise ValueError(f"text features must be encoded first: {', '.join(texts)}")
    ready = ready.persist()
    model = fit_named(algorithm, ready, inputs, target, key, **(parameters or {}))
    if not hasattr(model, "votes"):
        # only neighbour voting goes back to its training rows
        ready.unpersist()
    prepared = fitted.preparation.apply(test)
    scored = model.predict(align(prepared, inputs, [key, target]))
    scored = restore(scored, "prediction", fitted.target_scaler, None, target)
    kinds = infer_types(base.select(*[ref(c) for c in features]))
    bundle = ScoringBundle(
        key, list(features), kinds, fitted.preparation, inputs, model, target, fitted.target_scaler
    )
    spark = df.sparkSession
    notes = fitted.notes + [f"{k} {v}" for k, v in model.notes.items()]
    return Training(
        algorithm, parameters or {}, bundle, scored, evaluate(scored, target, model, average),
        feature_importance(model, spark), notes,
    )


def _train_unsupervised(df, key, algorithm, target, features, parameters, missing, encoding, scale) -> Training:
    """Clusters or components of all rows, with the metrics that need no target."""
    goal = [target] if algorithm == "lda" and target else []
    base = df.select(ref(key), *[ref(c) for c in features], *[ref(c) for c in goal])
    fitted = fit_preparation(base, key, goal[0] if goal else None, missing, encoding=encoding, scale=scale)
    inputs = [c for c in fitted.df.columns if c not in (key, *goal)]
    texts = text_columns(fitted.df, inputs)
    if texts:
        raise ValueError(f"text features must be encoded first: {', '.join(texts)}")
    ready = settle(align(fitted.df, inputs, [key, *goal]), "unsupervised")
    model, found, notes = fit_unsupervised(algorithm, ready, inputs, key, goal[0] if goal else None, **parameters)
    found = settle(found, algorithm)
    kinds = infer_types(base.select(*[ref(c) for c in features]))
    bundle = None if model is None else ScoringBundle(key, list(features), kinds, fitted.preparation, inputs, model)
    metrics = _cluster_metrics(found, key, inputs) if kind_of(algorithm) == "clustering" else _reduction_metrics(ready, found, inputs, model)
    return Training(algorithm, parameters, bundle, found, metrics, None, fitted.notes + [f"{k} {v}" for k, v in notes.items()])


def _cluster_metrics(found: DataFrame, key: str, inputs: list[str]) -> DataFrame:
    """Numbers of clusters and noise rows; scores of the rows in clusters, by squared distances in one pass."""
    row = found.agg(
        F.count_distinct(F.when(F.col("cluster") >= 0, F.col("cluster"))).alias("k"), F.count_if(F.col("cluster") < 0).alias("noise")
    )
    out = metric_rows(row, {"n_clusters": F.col("k"), "n_noise": F.col("noise")})
    if row.first().k < 2:
        return out
    clean = found.where("cluster >= 0")
    for part in (
        silhouette_score(clean, key, inputs, "cluster", "squared").where("metric = 'silhouette_score'"),
        davies_bouldin(clean, inputs, "cluster"), calinski_harabasz(clean, inputs, "cluster"),
    ):
        out = out.unionByName(part)
    return out


def _reduction_metrics(ready: DataFrame, found: DataFrame, inputs: list[str], model) -> DataFrame:
    if model is None:
        return metric_rows(found.agg(F.count("*").alias("n")), {"n_edges": F.col("n")})
    out = reduction_summary(ready, inputs, model.components)
    if isinstance(model, Pca):
        total = rows_table(ready.sparkSession, [("explained_variance_ratio", float(model.ratio.sum()))], "metric string, value double")
        out = out.unionByName(total).unionByName(reconstruction_error(ready, model))
    return out


SEARCHES = {"grid": grid_search, "random": random_search, "bayesian": bayesian_search}


def run_pipeline(spark, spec: Sequence[dict], df: DataFrame | None = None) -> dict[str, object]:
    """Run steps in the given order over one dataset.

    Every fitted step stays in ``steps``, and the bundle of the training replays them all, so
    it scores raw rows of the source. Rows that a step removes are left out of fitting only.
    Each step is ``{"step": name, ...options}`` with the names source, preprocess,
    outliers, polynomial, select, tune and train. Tuned parameters flow into training;
    parameters fixed on the training step win.
    """
    state: dict[str, object] = {"df": df, "key": None, "target": None, "best": {}, "steps": [], "raw": df}
    for node in spec:
        options = {k: v for k, v in node.items() if k != "step"}
        name = node["step"]
        frame, key, target = state["df"], state["key"], state["target"]
        if name == "source":
            state["key"], state["target"] = options["key"], options.get("target")
            if "path" in options:
                state["df"] = state["raw"] = read_dataset(spark, options["path"], options.get("format"))
        elif name == "preprocess":
            fitted = fit_preparation(frame, key, target, **options)
            state["df"], state["preparation"] = fitted.df, fitted.preparation
            state["steps"] += fitted.preparation.steps
            if fitted.target_scaler is not None:
                earlier = state.get("target_scaler")
                state["target_scaler"] = earlier.then(fitted.target_scaler, target) if earlier else fitted.target_scaler
        elif name in FITS:
            step = FITS[name](frame, key, target, options)
            state["steps"].append(step)
            state["df"] = step.treat(frame) if isinstance(step, Treatment) else step.apply(frame)
        elif name == "tune":
            inputs = [c for c in numeric_columns(frame) if c not in (key, target)]
            search = SEARCHES[options.pop("method", "grid")]
            found = search(frame, options.pop("algorithm"), inputs, target, key, **options)
            state["tuning"], state["best"] = found, found.best_parameters
        elif name == "train":
            parameters = {**state["best"], **options.pop("parameters", {})}
            done = train_model(frame, key, target=target, parameters=parameters, **options)
            if done.bundle is not None:
                done.bundle = _whole_bundle(done.bundle, state)
                scaler = state.get("target_scaler")
                if scaler is not None and done.bundle.target:
                    done.scored = scaler.invert(done.scored, {"prediction": target, target: target})
                    done.metrics = evaluate(done.scored, target, done.bundle.model, options.get("average"))
            state["training"] = done
        else:
            raise ValueError(f"unknown step {name!r}")
    return state


FITS = {"outliers": fit_outliers, "polynomial": fit_polynomial, "select": fit_selection}


def _whole_bundle(bundle: ScoringBundle, state: dict) -> ScoringBundle:
    """The bundle with the steps of all nodes before it, so that it takes raw rows of the source."""
    steps = [*state["steps"], *bundle.preparation.steps]
    wanted = needed(steps, bundle.features)
    required = [c for c in state["raw"].columns if c in wanted and c not in (bundle.key, bundle.target)]
    coders = [e for s in state["steps"] if isinstance(s, AutoEncoding) for e in s.encoders if e.column == bundle.target]
    before = state.get("target_scaler")
    scaler = bundle.target_scaler
    if before is not None and bundle.target in before.parameters:
        scaler = before.then(scaler, bundle.target)
    return replace(
        bundle, required=required, types=infer_types(state["raw"].select(*[ref(c) for c in required])),
        preparation=Preparation(steps), target_scaler=scaler,
        target_encoder=coders[-1] if coders and coders[-1].method in ("label", "ordinal") else None,
    )

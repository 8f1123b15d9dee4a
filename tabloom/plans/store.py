"""Keeping fitted steps, models and bundles, and scoring with them later.

A kept object is a manifest beside parameter tables: category tables and training rows as Parquet,
``pyspark.ml`` models in their own format, arrays as one table, and everything small as JSON. The
manifest of a version is written last and renamed into place, so a save that breaks off leaves
nothing that a reader sees. Only the kinds listed here are built again; a manifest cannot name others.
"""

from __future__ import annotations

import base64
import dataclasses
import datetime
import decimal
import importlib
import json
import math
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.construct import Products
from ..operators.encoding import AutoEncoding, Encoder
from ..operators.missing import Filler
from ..operators.models import base, bayes, cluster, decomposition, graphs, histogram, linear, margin, nearest, neural, trees
from ..operators.outliers import Bounds, IsolationForest, Treatment
from ..operators.scaling import Scaler
from ..operators.scoring import DateStep, Preparation, ScoringBundle
from ..operators.selection import Selection
from ..sources.files import write_dataset
from ..sources.registry import Registry

KINDS = {
    kind.__name__: kind
    for kind in (
        Filler, Encoder, AutoEncoding, Scaler, DateStep, Bounds, IsolationForest, Treatment, Products, Selection, Preparation,
        ScoringBundle, base.MlClassifier, base.MlRegressor, base.RestClassifier, linear.LinearModel, bayes.NaiveBayes,
        nearest.NearestClassifier, margin.KernelMap, margin.MarginClassifier, margin.MarginRegressor, neural.Network,
        neural.NetworkFit, trees.EncodedFit, histogram.BoostedTrees, cluster.Centers, cluster.Mixture, decomposition.Projection, decomposition.Pca,
        graphs.FuzzyProjection,
    )
}
ML = "pyspark.ml."


class Store:
    """Versions of named objects under one folder that all executors reach."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _files(self, path: str):
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return place, place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self, name: str) -> list[int]:
        """Finished versions, oldest first."""
        place, files = self._files(f"{self.folder}/{name}/manifests")
        if not files.exists(place):
            return []
        found = [f.getPath().getName() for f in files.listStatus(place)]
        return sorted(int(f.removesuffix(".json")) for f in found if f.endswith(".json"))

    def save(self, name: str, value: object) -> int:
        """Write a new version and give its number."""
        parts = f"{self.folder}/{name}/parts-{uuid.uuid4().hex}"
        writer = _Writer(parts)
        tree = writer.pack(value)
        for i, table in enumerate(writer.tables):
            table.write.parquet(f"{parts}/table-{i}")
        for i, model in enumerate(writer.models):
            model.write().save(f"{parts}/model-{i}")
        if writer.arrays:
            rows = [(i, a.dtype.str, [int(n) for n in a.shape], bytearray(np.ascontiguousarray(a).tobytes())) for i, a in enumerate(writer.arrays)]
            self.spark.createDataFrame(rows, "place int, kind string, shape array<long>, data binary").write.parquet(f"{parts}/arrays")
        text = json.dumps({"parts": parts.rsplit("/", 1)[1], "arrays": len(writer.arrays), "value": tree})
        return self._commit(name, text)

    def _commit(self, name: str, text: str) -> int:
        draft, files = self._files(f"{self.folder}/{name}/draft-{uuid.uuid4().hex}")
        out = files.create(draft, False)
        out.write(bytearray(text.encode("utf-8")))
        out.close()
        number = max(self.versions(name), default=0) + 1
        while True:
            place, _ = self._files(f"{self.folder}/{name}/manifests/{number}.json")
            files.mkdirs(place.getParent())
            if not files.exists(place) and files.rename(draft, place):
                return number
            number += 1

    def load(self, name: str, version: int | None = None) -> object:
        """The newest version, or a given one. Tables are read when they are used."""
        known = self.versions(name)
        if version is None and known:
            version = known[-1]
        if version not in known:
            raise ValueError(f"{name!r} has no version {version}; kept: {known}")
        text = self.spark.read.text(f"{self.folder}/{name}/manifests/{version}.json", wholetext=True).first()[0]
        manifest = json.loads(text)
        return _Reader(self.spark, f"{self.folder}/{name}/{manifest['parts']}", manifest["arrays"]).unpack(manifest["value"])


class _Writer:
    def __init__(self, parts: str):
        self.parts = parts
        self.tables: list[DataFrame] = []
        self.models: list[object] = []
        self.arrays: list[np.ndarray] = []

    def pack(self, v: object) -> object:
        if isinstance(v, np.generic):
            v = v.item()
        if v is None or isinstance(v, (bool, int, str)):
            return v
        if isinstance(v, float):
            return v if math.isfinite(v) else {"float": str(v)}
        if isinstance(v, list):
            return [self.pack(x) for x in v]
        if isinstance(v, tuple):
            return {"tuple": [self.pack(x) for x in v]}
        if isinstance(v, dict):
            return {"pairs": [[self.pack(k), self.pack(x)] for k, x in v.items()]}
        if isinstance(v, np.ndarray):
            if v.dtype == object:
                raise TypeError("an array of objects cannot be kept")
            self.arrays.append(v)
            return {"array": len(self.arrays) - 1}
        if isinstance(v, DataFrame):
            self.tables.append(v)
            return {"table": len(self.tables) - 1, "schema": v.schema.json()}
        if isinstance(v, datetime.datetime):
            return {"time": v.isoformat()}
        if isinstance(v, datetime.date):
            return {"date": v.isoformat()}
        if isinstance(v, decimal.Decimal):
            return {"decimal": str(v)}
        if isinstance(v, (bytes, bytearray)):
            return {"bytes": base64.b64encode(v).decode()}
        if type(v).__module__.startswith(ML) and hasattr(v, "write"):
            self.models.append(v)
            return {"model": len(self.models) - 1, "class": f"{type(v).__module__}:{type(v).__name__}"}
        if KINDS.get(type(v).__name__) is type(v):
            return {"kind": type(v).__name__, "fields": {f.name: self.pack(getattr(v, f.name)) for f in dataclasses.fields(v)}}
        raise TypeError(f"{type(v).__name__} cannot be kept")


class _Reader:
    def __init__(self, spark: SparkSession, parts: str, arrays: int):
        self.spark, self.parts = spark, parts
        found = spark.read.parquet(f"{parts}/arrays").collect() if arrays else []
        self.arrays = {r.place: np.frombuffer(bytes(r.data), np.dtype(r.kind)).reshape(r.shape).copy() for r in found}

    def unpack(self, v: object) -> object:
        if isinstance(v, list):
            return [self.unpack(x) for x in v]
        if not isinstance(v, dict):
            return v
        if "kind" in v:
            return KINDS[v["kind"]](**{k: self.unpack(x) for k, x in v["fields"].items()})
        if "pairs" in v:
            return {self.unpack(k): self.unpack(x) for k, x in v["pairs"]}
        if "tuple" in v:
            return tuple(self.unpack(x) for x in v["tuple"])
        if "array" in v:
            return self.arrays[v["array"]]
        if "table" in v:
            schema = T.StructType.fromJson(json.loads(v["schema"]))
            return self.spark.read.schema(schema).parquet(f"{self.parts}/table-{v['table']}")
        if "model" in v:
            module, name = v["class"].split(":")
            if not module.startswith(ML):
                raise ValueError(f"{module} is no part of pyspark.ml")
            return getattr(importlib.import_module(module), name).load(f"{self.parts}/model-{v['model']}")
        plain = {
            "float": float, "time": datetime.datetime.fromisoformat, "date": datetime.date.fromisoformat,
            "decimal": decimal.Decimal, "bytes": base64.b64decode,
        }
        (name, text), = v.items()
        return plain[name](text)


def kept_path(name: str, version: int) -> str:
    """How the registry names a kept object."""
    return f"{name}@{version}"


def load_registered(registry: Registry, store: Store, model_id: str) -> object:
    """The bundle of a registered model."""
    row = registry.table("models").where(F.col("id") == model_id).select("path").first()
    if row is None or "@" not in (row.path or ""):
        raise ValueError(f"model {model_id!r} is not kept")
    name, version = row.path.rsplit("@", 1)
    return store.load(name, int(version))


def predict_registered(
    registry: Registry, store: Store, model_id: str, df: DataFrame, path: str, dataset: str | None = None,
    fmt: str = "parquet",
) -> str:
    """Score rows with a registered model, write them, and record the prediction; gives its id."""
    scored = load_registered(registry, store, model_id).score(df)
    write_dataset(scored, path, fmt)
    rows = df.sparkSession.read.format(fmt).option("header", True).load(path).count()
    return registry.append(
        "predictions", [{"model_id": model_id, "input_dataset_id": dataset, "path": path, "row_count": rows}]
    )[0]
